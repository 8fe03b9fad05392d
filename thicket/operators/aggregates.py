"""Means, bags, histograms and feature vectors.

All are aggregates with partial sums. Null values don't count; the mean of
nothing is NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.order import global_rank


def keyed_fold(rows: DataFrame, by: Sequence[str], **folds: Column) -> DataFrame:
    """Any aggregates of each key."""
    return rows.groupBy(*by).agg(*(f.alias(name) for name, f in folds.items()))


def merge_maps(rows: DataFrame, column: str, combine: Callable[[Column], Column] = F.sum) -> DataFrame:
    """key, value: the union of a map column over all rows, the values of a key combined."""
    return rows.select(F.explode(column).alias("key", "value")).groupBy("key").agg(combine(F.col("value")).alias("value"))


# --- means -----------------------------------------------------------------


def mean_parts(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n and total of each key, which add up over parts of the rows."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("total"))


def merge_means(*parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def mean_of(parts: DataFrame) -> DataFrame:
    """``parts`` with mean; NaN of nothing."""
    return parts.withColumn("mean", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.lit(float("nan"))))


# --- bags: rows (key, weight), with any group columns ---------------------------


def bag(rows: DataFrame, key: str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*by, F.col(key).alias("key")).agg(F.sum(w).alias("weight"))


def normalised(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weights divided by their sum in each group; the sums are joined, so a large group stays in many tasks."""
    if not by:
        total = rows.agg(F.sum("weight").alias("_total"))
        return rows.crossJoin(F.broadcast(total)).withColumn("weight", F.col("weight") / F.col("_total")).drop("_total")  # one row
    total = rows.groupBy(*by).agg(F.sum("weight").alias("_total"))
    return rows.join(total, list(by)).withColumn("weight", F.col("weight") / F.col("_total")).drop("_total")


def scaled(rows: DataFrame, k: float) -> DataFrame:
    return rows.withColumn("weight", F.col("weight") * k)


def normed_list(rows: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Each of a group's n occurrences weighs 1/n."""
    return normalised(bag(rows, key, by=by), by)


def weighted_union(*bags: tuple[float, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (scaled(b, k) for k, b in bags)).groupBy("key").agg(F.sum("weight").alias("weight"))


def by_frequency(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("weight").desc(), "key")


# --- histograms -----------------------------------------------------------------


@dataclass(frozen=True)
class Binning:
    """bin: a column of bin numbers 0 to n - 1 (null out of range); edges of a bin number."""

    n: int
    low: float
    high: float
    kind: str = "linear"

    def bin(self, x: Column) -> Column:
        if self.kind == "integral":
            return F.when((x >= self.low) & (x < self.low + self.n), (x - self.low).cast("int"))
        if self.kind == "log":
            inside = F.when((x >= self.low) & (x <= self.high), F.log(F.when(x > 0, x).cast("double")))
            low, width = F.log(F.lit(float(self.low))), (F.log(F.lit(float(self.high))) - F.log(F.lit(float(self.low)))) / self.n
        else:
            inside = F.when((x >= self.low) & (x <= self.high), x.cast("double"))
            low, width = F.lit(float(self.low)), F.lit((float(self.high) - float(self.low)) / self.n)
        return F.least(F.floor((inside - low) / width).cast("int"), F.when(inside.isNotNull(), F.lit(self.n - 1)))

    def edges(self, bin_: Column) -> tuple[Column, Column]:
        if self.kind == "integral":
            return bin_ + self.low, bin_ + self.low
        low, high = (F.log(F.lit(float(x))) if self.kind == "log" else F.lit(float(x)) for x in (self.low, self.high))
        a, b = (low + (high - low) / self.n * (bin_ + k) for k in (0, 1))
        return (F.exp(a), F.exp(b)) if self.kind == "log" else (a, b)


def linear(n: int, low: float, high: float) -> Binning:
    """n bins of one width; the last holds its upper bound too."""
    return Binning(n, low, high)


def logarithmic(n: int, low: float, high: float) -> Binning:
    return Binning(n, low, high, "log")


def integral(n: int, low: int) -> Binning:
    """One bin for each whole number from ``low`` on."""
    return Binning(n, low, low + n - 1, "integral")


def histogram(rows: DataFrame, value: str, binning: Binning, by: Sequence[str] = ()) -> DataFrame:
    """bin, n of the bins that hold a value; values out of range don't count."""
    return rows.select(*by, binning.bin(F.col(value)).alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def all_bins(counts: DataFrame, binning: Binning) -> DataFrame:
    """bin, low, high, n of every bin."""
    low, high = binning.edges(F.col("bin"))
    every = counts.sparkSession.range(binning.n).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").fillna(0, ["n"]).select("bin", low.alias("low"), high.alias("high"), "n")


def bounded_histogram(rows: DataFrame, value: str, binning: Binning) -> DataFrame:
    """place (low, in, high), bin (null out of range), n: what lies outside counts too."""
    x = F.col(value)
    place = F.when(x < binning.low, "low").when(x > binning.high, "high").otherwise("in")
    return rows.where(x.isNotNull()).select(place.alias("place"), binning.bin(x).alias("bin")).groupBy("place", "bin").agg(F.count(F.lit(1)).alias("n"))


# --- feature vectors: rows with an array column -----------------------------------


def features_from(rows: DataFrame, names: Sequence[str], item: Sequence[str], default: float | None = 0.0, combine: Callable[[Column], Column] = F.sum) -> DataFrame:
    """item, features: rows (item, feature, value) as vectors in the order of ``names``.

    Values of one feature are combined, unknown features ignored, and lacking
    ones the default; with no default they are an error.
    """
    value = lambda n: combine(F.when(F.col("feature") == n, F.col("value")))

    def made(n: str) -> Column:
        v = value(n).cast("double")
        if default is not None:
            return F.coalesce(v, F.lit(float(default)))
        return F.coalesce(v, F.raise_error(F.concat(F.lit(f"no value of feature {n} for "), F.to_json(F.struct(*item)))).cast("double"))

    return rows.groupBy(*item).agg(F.array(*(made(n) for n in names)).alias("features"))


def vector_sum(rows: DataFrame, column: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """Element-wise sum of each key's vectors, and n of them."""
    each = rows.select(*by, F.posexplode(column).alias("pos", "x"))
    return each.groupBy(*by, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v"), F.max("n").alias("n")).select(*by, F.transform("_v", lambda v: v["x"]).alias(column), "n")


def mean_and_deviation(rows: DataFrame, column: str = "features") -> DataFrame:
    """One row: mean and population deviation of each dimension, as arrays."""
    each = rows.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"))
    packed = each.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "dev"))).alias("_v"))
    return packed.select(F.transform("_v", lambda v: v["mean"]).alias("mean"), F.transform("_v", lambda v: v["dev"]).alias("dev"))


def _by(dev: Column) -> Column:
    return F.transform(dev, lambda d: F.when((d == 0) | d.isNull(), F.lit(1.0)).otherwise(d))


def z_normalised(rows: DataFrame, stats: DataFrame, column: str = "features") -> DataFrame:
    """(x - mean) / deviation; a deviation of 0 counts as 1."""
    s = stats.select(F.col("mean").alias("_m"), _by(F.col("dev")).alias("_d"))
    out = F.zip_with(F.zip_with(F.col(column), F.col("_m"), lambda x, m: x - m), F.col("_d"), lambda x, d: x / d)
    return rows.crossJoin(F.broadcast(s)).withColumn(column, out).drop("_m", "_d")  # one row


def z_restored(rows: DataFrame, stats: DataFrame, column: str = "features") -> DataFrame:
    s = stats.select(F.col("mean").alias("_m"), _by(F.col("dev")).alias("_d"))
    out = F.zip_with(F.zip_with(F.col(column), F.col("_d"), lambda x, d: x * d), F.col("_m"), lambda x, m: x + m)
    return rows.crossJoin(F.broadcast(s)).withColumn(column, out).drop("_m", "_d")  # one row


def numbered(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "index") -> DataFrame:
    """A running number from 0; without a key over all rows, by ranges of the order."""
    if not by:
        return global_rank(rows, [F.col(c) if isinstance(c, str) else c for c in order], name)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def python_fold(rows: DataFrame, by: Sequence[str], f: Callable, schema: str) -> DataFrame:
    """Any fold of a key's rows in Python: ``f`` maps a pandas frame to one. For keys whose rows fit in a task."""
    return rows.groupBy(*by).applyInPandas(f, schema)
