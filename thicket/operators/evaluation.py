"""Evaluation of rankings and agreement of assessors.

Rankings are rows (query_id, doc_id, rank) and any further key columns such as
the method; qrels are rows (query_id, doc_id, relevance). A document is
relevant from ``least`` on. Documents without a judgement aren't relevant;
repeated judgements count once; a query's measure is null where nothing is
relevant to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def relevant(qrels: DataFrame, least: int = 1) -> DataFrame:
    return qrels.where(F.col("relevance") >= least).select("query_id", "doc_id").distinct()


def total_relevant(qrels: DataFrame, least: int = 1) -> DataFrame:
    """query_id, n_relevant."""
    return relevant(qrels, least).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))


def with_judgements(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``run`` with relevance, 0 where a document isn't judged."""
    return run.join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left").fillna(0, ["relevance"])


def of_judged_queries(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def unjudged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels, ["query_id", "doc_id"], "left_anti")


def measures(run: DataFrame, qrels: DataFrame, by: Sequence[str] = ("query_id",), least: int = 1) -> DataFrame:
    """For each key: n_relevant, average_precision, r_precision, reciprocal_rank.

    Only relevant documents are windowed: the i-th at rank r gives i / r.
    """
    judged = relevant(qrels, least)
    hits = run.join(judged, ["query_id", "doc_id"], "left_semi").join(total_relevant(qrels, least), "query_id")
    hits = hits.withColumn("_hit", F.row_number().over(Window.partitionBy(*by).orderBy("rank")))
    found = hits.groupBy(*by).agg(
        F.sum(F.col("_hit") / F.col("rank")).alias("_sum"),
        F.count_if(F.col("rank") <= F.col("n_relevant")).alias("_in_r"),
        F.min("rank").alias("_first"),
    )
    keys = run.select(*by).distinct().join(total_relevant(qrels, least), "query_id", "left")
    joined = keys.join(found, list(by), "left")
    n = F.col("n_relevant")
    return joined.select(
        *by,
        F.coalesce(n, F.lit(0)).alias("n_relevant"),
        F.when(n > 0, F.coalesce("_sum", F.lit(0.0)) / n).alias("average_precision"),
        F.when(n > 0, F.coalesce("_in_r", F.lit(0)) / n).alias("r_precision"),
        F.when(n > 0, F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("reciprocal_rank"),
    )


def prefix_precision(run: DataFrame, qrels: DataFrame, by: Sequence[str] = ("query_id",), least: int = 1) -> DataFrame:
    """``run`` with is_relevant, n_hits (relevant ones down to this rank) and precision."""
    known = relevant(qrels, least).withColumn("is_relevant", F.lit(True))
    rows = run.join(known, ["query_id", "doc_id"], "left").fillna(False, ["is_relevant"])
    w = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("n_hits", F.sum(F.col("is_relevant").cast("long")).over(w)).withColumn("precision", F.col("n_hits") / F.col("rank"))


def mean_average_precision(run: DataFrame, qrels: DataFrame, least: int = 1) -> DataFrame:
    """One row: the mean over the run's queries, where one without relevant documents counts 0."""
    return measures(run, qrels, least=least).agg(F.avg(F.coalesce("average_precision", F.lit(0.0))).alias("map"))


def map_by_method(run: DataFrame, qrels: DataFrame, least: int = 1) -> DataFrame:
    """method, map, n_queries; queries without judgements or without relevant documents don't count."""
    each = measures(run, qrels, ("method", "query_id"), least).where("n_relevant > 0")
    return each.groupBy("method").agg(F.avg("average_precision").alias("map"), F.count(F.lit(1)).alias("n_queries"))


def metric_rows(run: DataFrame, qrels: DataFrame, least: int = 1, complete: bool = False) -> DataFrame:
    """metric, query_id, value: map, Rprec and recip_rank of each query and of ``all``.

    ``complete``: judged queries that the run lacks count with 0.
    """
    each = measures(run, qrels, least=least).where("n_relevant > 0")
    if complete:
        lacking = total_relevant(qrels, least).join(each, "query_id", "left_anti")
        zero = [F.lit(0.0).alias(c) for c in ("average_precision", "r_precision", "reciprocal_rank")]
        each = each.unionByName(lacking.select("query_id", "n_relevant", *zero))
    each = each.withColumn("query_id", F.col("query_id").cast("string"))
    pairs = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(c).alias("value")) for name, c in (("map", "average_precision"), ("Rprec", "r_precision"), ("recip_rank", "reciprocal_rank"))))
    rows = each.select("query_id", F.explode(pairs).alias("m")).select("m.metric", "query_id", "m.value")
    return rows.unionByName(rows.groupBy("metric").agg(F.avg("value").alias("value")).withColumn("query_id", F.lit("all")))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("subject", F.col("category").alias("ka")).join(b.select("subject", F.col("category").alias("kb")), "subject")


def _kappa(agree: Column, chance: Column, n: Column) -> Column:
    po, pe = agree / n, chance / (n * n)
    return F.when(n > 0, F.when(pe == 1, F.lit(NAN)).otherwise(1 - (1 - po) / (1 - pe))).otherwise(F.lit(NAN))


def cohen_kappa(a: DataFrame, b: DataFrame) -> DataFrame:
    """kappa of two assessors' rows (subject, category), over the subjects that both have; NaN where undefined."""
    pairs = _pairs(a, b)
    counts = pairs.groupBy("ka", "kb").agg(F.count(F.lit(1)).cast("double").alias("n"))
    of_a, of_b = counts.groupBy("ka").agg(F.sum("n").alias("na")), counts.groupBy("kb").agg(F.sum("n").alias("nb"))
    chance = of_a.join(of_b, F.col("ka") == F.col("kb")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0.0)).alias("chance"))
    agreed = counts.agg(F.coalesce(F.sum(F.when(F.col("ka") == F.col("kb"), F.col("n"))), F.lit(0.0)).alias("agree"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"))
    return agreed.crossJoin(chance).select(_kappa(F.col("agree"), F.col("chance"), F.col("n")).alias("kappa"))  # two rows of one each


def cohen_kappa_classes(a: DataFrame, b: DataFrame, classes: Sequence[Sequence]) -> DataFrame:
    """kappa where any two categories of a class agree; a pair of several classes counts once."""
    spark = a.sparkSession
    allowed = spark.createDataFrame(sorted({(x, y) for c in classes for x in c for y in c}), "ka " + (kind := a.schema["category"].dataType.simpleString()) + ", kb " + kind)
    counts = _pairs(a, b).groupBy("ka", "kb").agg(F.count(F.lit(1)).cast("double").alias("n"))
    of_a, of_b = counts.groupBy("ka").agg(F.sum("n").alias("na")), counts.groupBy("kb").agg(F.sum("n").alias("nb"))
    zero = F.lit(0.0)
    chance = allowed.join(of_a, "ka").join(of_b, "kb").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), zero).alias("chance"))
    agreed = counts.join(allowed, ["ka", "kb"], "left_semi").agg(F.coalesce(F.sum("n"), zero).alias("agree"))
    total = counts.agg(F.coalesce(F.sum("n"), zero).alias("n"))
    return agreed.crossJoin(chance).crossJoin(total).select(_kappa(F.col("agree"), F.col("chance"), F.col("n")).alias("kappa"))  # rows of one each


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """kappa of rows (assessor, subject, category); subjects with one rating don't count; NaN where undefined."""
    cell = ratings.groupBy("subject", "category").agg(F.count(F.lit(1)).cast("double").alias("n"))
    per = cell.groupBy("subject").agg(F.sum("n").alias("ni"), F.sum(F.col("n") * F.col("n")).alias("inner")).where("ni > 1")
    observed = per.agg(F.avg((F.col("inner") / F.col("ni") - 1) / (F.col("ni") - 1)).alias("p"))
    share = cell.join(per.select("subject"), "subject", "left_semi").groupBy("category").agg(F.sum("n").alias("n"))
    expected = share.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("pe"))
    kappa = F.when(F.col("pe") == 1, F.lit(NAN)).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe")))
    return observed.crossJoin(expected).select(F.coalesce(kappa, F.lit(NAN)).alias("kappa"))  # rows of one each


def score_with(metric, rankings: DataFrame) -> float:
    """Any measure: a function of a ranking to a table of one number."""
    return metric(rankings).first()[0]


