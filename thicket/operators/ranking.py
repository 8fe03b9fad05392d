"""Rankings: rows (query_id, doc_id, score, rank) with rank 1 the best.

Equal scores are ordered by doc_id, so that every result is the same on each
run. A rank below a cut is found by Spark's group limit: each task keeps the
best k of a query before anything is shuffled. Null keys are keys of their
own; NaN stands above all numbers (``finite`` removes it); an empty table gives
an empty ranking.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank(rows: DataFrame, k: int | None = None, by: Sequence[str] = ("query_id",), score: str = "score", tie: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``rows`` with rank, the best ``k`` of each key where that is given."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), *tie)
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def top_k(rows: DataFrame, k: int, score: str = "score", tie: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The best ``k`` of all rows, best first."""
    return rows.orderBy(F.col(score).desc(), *tie).limit(k)


def descending(rows: DataFrame, score: str = "score", tie: Sequence[str] = ("doc_id",)) -> DataFrame:
    return rows.orderBy(F.col(score).desc(), *tie)


def take_top(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.where(F.col("rank") <= k)


def trusted(rows: DataFrame, place: str, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """A ranking whose order is given by ``place`` (a line number), whatever the scores."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(place)))


def keep(ranking: DataFrame, condition: Column, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The rows that meet the condition, in the order they had, ranked from 1."""
    return trusted(ranking.where(condition), "rank", by)


def rescore(ranking: DataFrame, score: Column, k: int | None = None, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """New scores and the ranks that follow; with ``k`` only the best k of the old ranking are scored."""
    rows = ranking if k is None else take_top(ranking, k)
    return rank(rows.drop("rank").withColumn("score", score), by=by)


def finite(rows: DataFrame, score: str = "score") -> DataFrame:
    return rows.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < float("inf")))


def merge_runs(runs: Sequence[DataFrame], k: int, method: str | None = None) -> DataFrame:
    """The best ``k`` of each query over all runs, without zero scores, ranked from 1."""
    rows = reduce(DataFrame.unionByName, runs).where(F.col("score") != 0).drop("rank")
    merged = rank(rows, k)
    return merged if method is None else merged.withColumn("method", F.lit(method))


def merge_cut(rankings: Sequence[DataFrame], per_input: int | None, n: int | None, by: Sequence[str] = ("query_id", "param_set")) -> DataFrame:
    """The best ``per_input`` of each ranking, then the best ``n`` of them all, for each key; finite scores only."""
    cut = [rank(finite(r).drop("rank"), per_input, by) for r in rankings]
    return rank(reduce(DataFrame.unionByName, cut).drop("rank"), n, by)


def nested(ranking: DataFrame, by: Sequence[str] = ("query_id",), item: Sequence[str] = ("rank", "score", "doc_id")) -> DataFrame:
    """One row a key with its ranking as an array; for rankings that have been cut."""
    return ranking.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*item))).alias("ranking"))
