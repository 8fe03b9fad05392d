"""Word embeddings: rows (term, vec), all of one dimension."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.batches import parts
from thicket.functions.text import vector_dot
from thicket.operators.index import repeats
from thicket.operators.phrases import Trie, longest_joined
from thicket.scratch import materialize

#: Numbers of an embedding (8 bytes each) that may travel to every worker.
BROADCAST_VALUES = 5_000_000
#: Numbers of the vectors that a worker adds up at a time.
BLOCK_VALUES = 4_000_000


def dimension(embedding: DataFrame, vec: str = "vec") -> int:
    row = embedding.select(F.size(vec)).first()
    return row[0] if row else 0


def sums(rows: DataFrame, by: Sequence[str], dim: int, vec: str = "vec") -> DataFrame:
    """by, vec: element-wise sums; partial sums before the shuffle, no row for each element."""
    return rows.groupBy(*by).agg(F.array(*(F.coalesce(F.sum(F.col(vec)[i].cast("double")), F.lit(0.0)) for i in range(dim))).alias(vec))


def embed_terms(docs: DataFrame, embedding: DataFrame, terms: str = "terms") -> DataFrame:
    """doc_id, vec: the sum over the terms that have a vector; the zero vector without any.

    An embedding of up to ``BROADCAST_VALUES`` numbers travels to every worker,
    which adds up a row's vectors by itself. A larger one is joined; equal terms
    of a document are counted first, so one row a term is joined.
    """
    if embedding.count() * (dim := dimension(embedding)) <= BROADCAST_VALUES:
        summed = _embed_rows(docs.select("doc_id", terms), embedding, dim)
        return sums(summed, ("doc_id",), dim) if repeats(docs) else summed
    counted = docs.select("doc_id", F.explode_outer(terms).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("_n"))
    rows = counted.join(embedding, "term", "left").withColumn("vec", F.transform("vec", lambda x: x.cast("double") * F.col("_n")))
    return sums(rows, ("doc_id",), dimension(embedding))


def _embed_rows(docs: DataFrame, embedding: DataFrame, dim: int) -> DataFrame:
    """``embed_terms`` of each row by itself."""
    vectors: dict[str, np.ndarray] = {}
    for r in embedding.where("term is not null and vec is not null").select("term", "vec").collect():
        vectors[r.term] = vectors.get(r.term, 0.0) + np.asarray([0.0 if x is None else x for x in r.vec], np.float64)
    held = docs.sparkSession.sparkContext.broadcast((list(vectors), np.array(list(vectors.values())).reshape(len(vectors), dim)))
    step = max(1, BLOCK_VALUES // max(1, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = held.value
        vocabulary = pa.array(names, pa.string())
        for batch in (p for b in batches for p in parts(b, 1, step)):
            sizes = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            at = pc.index_in(batch.column(1).flatten(), value_set=vocabulary, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
            at, out = at[at >= 0], np.zeros((len(sizes), dim))
            for i in range(0, len(at), step):  # a long row comes in several blocks
                here = row[i : i + step]
                starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
                out[here[starts]] += np.add.reduceat(values[at[i : i + step]], starts)
            ends = pa.array(np.arange(len(sizes) + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["doc_id", "vec"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, vec array<double>")


def embed_text(docs: DataFrame, embedding: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, vec: the sum over leftmost longest matches of the vocabulary in the text's characters.

    An embedding of up to ``BROADCAST_VALUES`` numbers travels to every worker;
    a larger one is joined with what its terms match.
    """
    dim = dimension(embedding)
    if embedding.count() * dim > BROADCAST_VALUES:
        return _embed_joined(docs.select("doc_id", F.col(text).alias("text")), embedding)
    rows = [(r.term, np.asarray(r.vec, np.float64)) for r in embedding.collect()]
    held = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie([(t, v) for t, v in held.value if t])
        for batch in batches:
            out = [sum((v for _, _, v in trie.sequential(t or "") if v is not None), np.zeros(dim)).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "vec"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, vec array<double>")


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _embed_joined(docs: DataFrame, embedding: DataFrame) -> DataFrame:
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "embed-rows")
    words = embedding.where("term <> ''").select(_characters(F.col("term")).alias("tokens"), F.col("term").alias("phrase_id"))
    found = longest_joined(rows.select(F.col("_row").alias("doc_id"), _characters(F.col("text")).alias("tokens")), words)
    terms = found.where("phrase_id is not null").groupBy("doc_id").agg(F.collect_list("phrase_id").alias("terms"))
    summed = embed_terms(rows.select(F.col("_row").alias("doc_id")).join(terms, "doc_id", "left"), embedding)
    return rows.select("_row", "doc_id").join(summed.toDF("_row", "vec"), "_row").select("doc_id", "vec")


def nearest(embedding: DataFrame, vector: Sequence[float], k: int, key: str = "term", vec: str = "vec") -> DataFrame:
    """key, score: the k rows with the largest dot product with one vector."""
    query = F.array(*(F.lit(float(x)) for x in vector))
    return embedding.select(key, vector_dot(F.col(vec), query).alias("score")).orderBy(F.col("score").desc(), key).limit(k)
