"""Retrieval models over the index tables.

A query is rows (query_id, term, weight). Postings are cut down to query terms
by a join before anything is grouped; the documents that hold a query term
are the candidates. Scores of query likelihood are natural logarithms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from thicket.functions.text import ln
from thicket.operators.index import Index, with_lengths


#: Different query terms that are pushed into the scans of an index.
TERMS_MOST = 10_000
#: Rows of queries (some 100 bytes each) that may travel to every worker.
QUERY_ROWS = 100_000
#: Numbers (8 bytes each) of the table of queries x terms that may travel to every worker, and of a block of documents x terms there.
QUERY_VALUES = 4_000_000
BLOCK_VALUES = 1_000_000
#: Scores closer than this may change places when they are rounded.
MARGIN = 1e-6


@dataclass(frozen=True)
class NoSmoothing:
    def probability(self, tf: Column, length: Column, background: Column) -> Column:
        return F.when(length > 0, tf / length).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Dirichlet:
    mu: float = 1000.0

    def probability(self, tf: Column, length: Column, background: Column) -> Column:
        return (tf + self.mu * background) / (length + self.mu)


@dataclass(frozen=True)
class Laplace:
    def probability(self, tf: Column, length: Column, background: Column) -> Column:
        return (tf + 1.0) / (length + 2.0)


@dataclass(frozen=True)
class JelinekMercer:
    alpha: float = 0.5

    def probability(self, tf: Column, length: Column, background: Column) -> Column:
        return self.alpha * F.when(length > 0, tf / length).otherwise(F.lit(0.0)) + (1 - self.alpha) * background


def query_rows(spark: SparkSession, queries: dict[str, list[str] | dict[str, float]]) -> DataFrame:
    """query_id, term, weight; repeated terms of a list add up."""
    rows = []
    for q, terms in queries.items():
        weights: dict[str, float] = {}
        for t, w in terms.items() if isinstance(terms, dict) else ((t, 1.0) for t in terms):
            weights[t] = weights.get(t, 0.0) + float(w)
        rows += [(q, t, w) for t, w in weights.items()]
    return spark.createDataFrame(rows, "query_id string, term string, weight double")


def each_once(queries: DataFrame) -> DataFrame:
    """The queries with every term once and weight 1, however often it was given."""
    return queries.select("query_id", "term").distinct().withColumn("weight", F.lit(1.0))


def narrowed(index: Index, queries: DataFrame) -> Index:
    """``index`` with the postings and statistics of the queries' terms alone.

    The terms go into the scans' filters, so a stored index, which is sorted
    by term, is read in part. Beyond ``TERMS_MOST`` terms the joins that follow do it.
    """
    terms = [r.term for r in queries.where("term is not null").select("term").distinct().limit(TERMS_MOST + 1).collect()]
    if len(terms) > TERMS_MOST:
        return index
    asked = F.col("term").isin(terms)
    return Index(index.postings.where(asked), index.documents, index.term_stats.where(asked), index.corpus)


def few(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``rows``, of which there are no more than of the queries, broadcast where these are few."""
    return F.broadcast(rows) if queries.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS else rows


def candidates(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, term, weight, tf: the query terms that documents hold."""
    kept = [c for c in ("doc_len",) if c in index.postings.columns]
    return index.postings.join(queries, "term").select("query_id", "doc_id", "term", "weight", "tf", *kept)


def with_statistics(index: Index, rows: DataFrame) -> DataFrame:
    """df, cf (0 where unknown) and the one row of corpus totals."""
    stats = rows.join(index.term_stats, "term", "left").fillna(0, ["df", "cf"])
    return stats.crossJoin(F.broadcast(index.corpus))  # one row


def bm25_weight(tf: Column, df: Column, length: Column, n_docs: Column, n_tokens: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (n_tokens / n_docs)))


def bm25(index: Index, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score; a query's distinct terms count once each."""
    index = narrowed(index, queries)
    stats = with_statistics(index, queries.select("query_id", "term").distinct())
    rows = with_lengths(index, index.postings.join(few(stats, queries), "term"))
    w = bm25_weight(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("n_docs"), F.col("n_tokens"), k1, b)
    return rows.groupBy("query_id", "doc_id").agg(F.sum(w).alias("score"))


def bm25_best(index: Index, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Of ``bm25`` all rows that can be among a query's ``k`` best, whether scores are rounded (to six digits or more) before or not.

    An index that keeps its documents' rows is scored row by row against all
    queries, and a task gives out its best alone: rows of documents x queries
    are never made. Without such rows, and for more queries than
    ``QUERY_VALUES`` holds, it is ``bm25``.
    """
    if index.rows is None or not isinstance(index.rows.schema["doc_id"].dataType, T.IntegralType):
        return bm25(index, queries, k1, b)
    pairs = queries.select("query_id", "term").where("term is not null").distinct().limit(QUERY_ROWS + 1).collect()
    names, terms = list(dict.fromkeys(r.query_id for r in pairs)), list(dict.fromkeys(r.term for r in pairs))
    if len(pairs) > QUERY_ROWS or len(names) * len(terms) > QUERY_VALUES:
        return bm25(index, queries, k1, b)
    place, column = {n: i for i, n in enumerate(names)}, {t: i for i, t in enumerate(terms)}
    n_docs, n_tokens = index.corpus.first()
    weights = np.zeros((len(terms), len(names)))
    df = {r.term: r.df for r in index.term_stats.join(F.broadcast(queries.select("term").distinct()), "term", "left_semi").collect()}  # counted above
    for r in pairs:
        n = df.get(r.term, 0)
        weights[column[r.term], place[r.query_id]] = np.log(1 + (n_docs - n + 0.5) / (n + 0.5)) * (k1 + 1)
    id_types = [to_arrow_type(index.rows.schema["doc_id"].dataType), to_arrow_type(queries.schema["query_id"].dataType)]
    held = index.rows.sparkSession.sparkContext.broadcast((names, terms, weights))

    def best(found: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The rows that stay; ``least`` becomes each query's k-th best score. Of equal scores the k first documents stay."""
        found = found[np.lexsort((found["id"], found["known"], -found["score"], found["query"]))]
        first = np.searchsorted(found["query"], np.arange(len(least)))
        size = np.searchsorted(found["query"], np.arange(len(least)), "right") - first
        full = np.flatnonzero(size >= k)
        least[full] = found["score"][first[full] + k - 1]
        new = np.r_[True, (found["query"][1:] != found["query"][:-1]) | (found["score"][1:] != found["score"][:-1])][: len(found)]
        starts = np.flatnonzero(new)
        among = np.arange(len(found)) - np.repeat(starts, np.diff(np.r_[starts, len(found)]))
        return found[(found["score"] >= least[found["query"]] - MARGIN) & (among < k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, weights = held.value
        vocabulary, least = pa.array(terms, pa.string()), np.full(len(names), -np.inf)
        kept = np.zeros(0, [("query", np.int32), ("score", float), ("known", bool), ("id", np.int64)])
        step = max(1, BLOCK_VALUES // max(1, len(terms), len(names)))
        for batch in (x.slice(i, step) for x in batches for i in range(0, x.num_rows, step)):
            pairs, sizes = batch.column(2).flatten(), pc.list_value_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
            at = pc.index_in(pairs.field("term"), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
            tf, row = pairs.field("tf").to_numpy(zero_copy_only=False).astype(float), np.repeat(np.arange(len(sizes)), sizes)
            length = batch.column(1).to_numpy(zero_copy_only=False)[row]
            used = at >= 0
            block = np.zeros((len(sizes), len(terms)))
            block[row[used], at[used]] = (tf / (tf + k1 * (1 - b + b * length / (n_tokens / n_docs))))[used]
            scores = block @ weights
            d, q = np.nonzero((scores > 0) & (scores >= least - MARGIN))
            ids = batch.column(0)
            made = np.zeros(len(d), kept.dtype)
            made["query"], made["score"] = q, scores[d, q]
            made["known"], made["id"] = ids.is_valid().to_numpy(zero_copy_only=False)[d], ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)[d]
            kept = best(np.concatenate([kept, made]), least)
        ids = pa.array(kept["id"], mask=~kept["known"]).cast(id_types[0])
        yield pa.RecordBatch.from_arrays([pa.array(names, id_types[1]).take(pa.array(kept["query"])), ids, pa.array(kept["score"])], ["query_id", "doc_id", "score"])

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {index.rows.schema['doc_id'].dataType.simpleString()}, score double"
    return index.rows.select("doc_id", "doc_len", "counts").mapInArrow(run, schema)


def tf_idf(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score: sum of tf ln(N / (1 + df)), in linear scale and with its sign."""
    index = narrowed(index, queries)
    stats = with_statistics(index, queries.select("query_id", "term").distinct())
    rows = index.postings.join(few(stats, queries), "term")
    return rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.log(F.col("n_docs") / (1 + F.col("df")))).alias("score"))


def query_likelihood(index: Index, queries: DataFrame, smoothing, background: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """query_id, doc_id, score: ln of the product of p(term)^weight over all query terms.

    Terms that a candidate lacks count with tf 0: the candidate's counts meet
    in a map and are looked up for each of the query's terms, so absent terms
    need no rows. ``background`` maps (cf, n_tokens) to P(term); cf / n_tokens
    by default.
    """
    index = narrowed(index, queries)
    p = background or (lambda cf, n: cf / n)
    stats = with_statistics(index, queries).withColumn("p", p(F.col("cf"), F.col("n_tokens")).cast("double"))
    query = stats.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight", "p"))).alias("terms"))
    found = candidates(index, few(queries, queries))
    key = [c for c in ("query_id", "doc_id", "doc_len") if c in found.columns]
    held = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tfs"))
    rows = with_lengths(index, held.join(few(query, queries), "query_id"))

    def term(t: Column) -> Column:
        tf = F.coalesce(F.element_at("tfs", t["term"]), F.lit(0)).cast("double")
        return t["weight"] * ln(smoothing.probability(tf, F.col("doc_len").cast("double"), t["p"]))

    score = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + term(t))
    return rows.select("query_id", "doc_id", score.alias("score"))


def unseen_half(cf: Column, n: Column) -> Column:
    """cf / T, and 0.5 / T for a term that the corpus lacks."""
    return F.when(cf > 0, cf).otherwise(F.lit(0.5)) / n


def unseen_entity(cf: Column, n: Column) -> Column:
    return F.when(cf > 0, cf).otherwise(F.lit(0.05)) / n


def score(index: Index, queries: DataFrame, model: Callable[[Index, DataFrame], DataFrame]) -> DataFrame:
    """Any model: a function of the index and the query rows to (query_id, doc_id, score)."""
    return model(index, queries)


def relevance_model(ranked: DataFrame, postings: DataFrame, log_scores: bool = False) -> DataFrame:
    """query_id, term, weight: term distributions of the ranked documents, weighted by score, normalised.

    With ``log_scores`` the scores are logarithms; the largest is taken off
    before they are raised, which the normalisation cancels.
    """
    weight = F.exp(F.col("score") - F.max("score").over(Window.partitionBy("query_id"))) if log_scores else F.col("score")
    docs = ranked.withColumn("_w", weight)
    rows = postings.join(docs.select("query_id", "doc_id", "_w"), "doc_id")
    length = rows.groupBy("query_id", "doc_id").agg(F.sum("tf").alias("_len"))
    bag = rows.join(length, ["query_id", "doc_id"]).groupBy("query_id", "term").agg(F.sum(F.col("_w") * F.col("tf") / F.col("_len")).alias("_sum"))
    return bag.select("query_id", "term", (F.col("_sum") / F.sum("_sum").over(Window.partitionBy("query_id"))).alias("weight"))
