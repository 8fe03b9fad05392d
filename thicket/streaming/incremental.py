"""Incremental indexing and statistics by Structured Streaming.

Every micro-batch is written below a folder of its own number, so a batch that
is run again after a failure replaces what it wrote. ``compact`` rewrites the
batches' small files as one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from thicket.operators import index as I
from thicket.operators.ranking import rank

TABLES = ("postings", "documents", "term_stats", "corpus")


def write_batch(docs: DataFrame, path: str, batch: int, text: str = "text") -> None:
    """Index one batch as segment ``batch``; the same batch again replaces it."""
    I.write(I.build(docs, text), f"{path}/segment={batch:010d}", mode="overwrite")


def index_stream(docs: DataFrame, path: str, checkpoint: str, text: str = "text", **trigger) -> StreamingQuery:
    """Index a streaming table (doc_id, text, ...) below ``path`` as it comes."""
    writer = docs.writeStream.foreachBatch(lambda df, batch: write_batch(df, path, batch, text)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def segments(spark: SparkSession, path: str) -> list[str]:
    """The segments that are there, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("segment="))


def open_segments(spark: SparkSession, path: str) -> I.Index:
    """All segments as one index; their statistics add up, as a document is in one segment."""
    found = segments(spark, path)
    if not found:
        raise FileNotFoundError(path)
    parts = [I.open_index(spark, p) for p in found]
    table = lambda name: spark.read.parquet(*(f"{p}/{name}" for p in found))
    return I.Index(table("postings"), table("documents"), I.merge_term_statistics(*(p.term_stats for p in parts)), I.merge_corpus_statistics(*(p.corpus for p in parts)))


def compact(spark: SparkSession, path: str, to: str, files: int | None = None) -> I.Index:
    """One segment of all, written to a new folder; readers change over when it is complete."""
    I.write(open_segments(spark, path), f"{to}/segment={0:010d}", files=files)
    return open_segments(spark, to)


def term_statistics_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df, cf so far, for output mode ``complete`` or ``update``; a document comes once and whole."""
    # in a sorted array a term's first place is where it differs from the one before
    rows = docs.select(F.array_sort(I.X.tokenise(F.col(text))).alias("_all"))
    marked = F.transform("_all", lambda x, i: F.struct(x.alias("term"), (~x.eqNullSafe(F.get("_all", i - 1))).cast("long").alias("first")))
    return rows.select(F.explode(marked).alias("t")).groupBy("t.term").agg(F.sum("t.first").alias("df"), F.count(F.lit(1)).alias("cf"))


def top_k_stream(scored: DataFrame, path: str, checkpoint: str, k: int, **trigger) -> StreamingQuery:
    """The best ``k`` of each query of a streaming table (query_id, doc_id, score), kept below ``path``.

    Batch n reads the table that batch n - 1 left and writes its own, so a
    batch can be run again.
    """

    def merge(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = latest(spark, path, batch)
        rows = df.select("query_id", "doc_id", "score")
        if before is not None:
            rows = rows.unionByName(before.select(rows.columns))
        rank(rows.distinct(), k).write.mode("overwrite").parquet(f"{path}/batch={batch:010d}")

    return scored.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def top_k_state(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` so far of each query of a streaming table (query_id, doc_id, score), for output mode ``update``.

    A query's state is its ``k`` rows; a batch returns the rankings of the
    queries that it changes: query_id, doc_id, score, rank. A pair that comes
    again with the same score counts once. Rows of a hot query come in
    Arrow batches, never all at once. Null and NaN scores are left out; null
    doc_ids are too.
    """
    doc = scored.schema["doc_id"].dataType.simpleString()
    key = scored.schema["query_id"].dataType.simpleString()

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.drop_duplicates().sort_values(["score", "doc_id"], ascending=[False, True], kind="stable").head(k)

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = pd.DataFrame({"doc_id": list(state.get[0]), "score": list(state.get[1])}) if state.exists else None
        now = before
        for batch in batches:
            rows = batch[["doc_id", "score"]]
            now = best(rows if now is None or now.empty else pd.concat([now, rows], ignore_index=True))
        if now is None or (before is not None and now.reset_index(drop=True).equals(before)):
            return
        state.update((now["doc_id"].tolist(), now["score"].tolist()))
        yield pd.DataFrame({"query_id": [name[0]] * len(now), "doc_id": now["doc_id"].to_numpy(), "score": now["score"].to_numpy(), "rank": range(1, len(now) + 1)})

    rows = scored.select("query_id", "doc_id", F.col("score").cast("double").alias("score")).where("doc_id is not null and score is not null and not isnan(score)")
    return rows.groupBy("query_id").applyInPandasWithState(
        update, f"query_id {key}, doc_id {doc}, score double, rank int", f"docs array<{doc}>, scores array<double>", "update", GroupStateTimeout.NoTimeout
    )


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table of the last batch, or of the last before a number."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []
    names = [n for n in names if n.startswith("batch=") and (before is None or int(n[6:]) < before)]
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def observed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row count that listeners see as ``name``."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
