"""The inverted index as four tables.

postings(term, doc_id, tf[, positions]), documents(doc_id, doc_len and what
else is known of them), term_stats(term, df, cf), corpus(n_docs, n_tokens).
On disk postings and term_stats are sorted by term within term-hash files, so
that a lookup reads few row groups.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions import text as X
from thicket.functions.batches import parts
from thicket.operators.ranking import rank


@dataclass
class Index:
    postings: DataFrame
    documents: DataFrame
    term_stats: DataFrame
    corpus: DataFrame
    #: doc_id, doc_len, counts: the same postings, a row a document; None where they aren't kept so.
    rows: DataFrame | None = None


def term_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, term: one row an occurrence."""
    return docs.select("doc_id", F.explode(X.tokenise(F.col(text))).alias("term"))


def term_frequencies(terms: DataFrame) -> DataFrame:
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def counted(docs: DataFrame, text: str = "text", terms: Collection[str] | None = None) -> DataFrame:
    """doc_id, doc_len, counts: of each row by itself its number of terms and an array of (term, tf); with ``terms`` of these alone.

    A row holds all its terms, so nothing is shuffled.
    """
    wanted = None if terms is None else frozenset(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(X.LATIN_TERM).findall
        for batch in (p for b in batches for p in parts(b, 1)):
            lengths, ends, held, tfs = [], [0], [], []
            for t in batch.column(1).to_pylist():
                found = find(t) if t else []
                lengths.append(len(found))
                counts = Counter(found if wanted is None else filter(wanted.__contains__, found))
                held += counts.keys()
                tfs += counts.values()
                ends.append(len(held))
            pairs = pa.StructArray.from_arrays([pa.array(held, pa.string()), pa.array(tfs, pa.int64())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["doc_id", "doc_len", "counts"])

    folded = docs.select("doc_id", X.fold_case(F.col(text)).alias("text"))
    return folded.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc_len bigint, counts array<struct<term:string,tf:bigint>>")


def repeats(docs: DataFrame) -> bool:
    """Whether rows share a doc_id or have none; reads the ids alone."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or doc_id is null").isEmpty()


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, term, tf of the documents; shuffled only where rows share a doc_id or have none."""
    rows = counted(docs, text).select("doc_id", F.explode("counts").alias("c")).select("doc_id", "c.term", "c.tf")
    return rows.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")) if repeats(docs) else rows


def top_terms(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id, term, tf, rank: each document's ``k`` most frequent terms, cut where they are counted."""
    if repeats(docs):
        return rank(frequencies(docs, text), k, by=("doc_id",), score="tf", tie=("term",))
    ordered = F.sort_array(F.transform("counts", lambda c: F.struct((-c["tf"]).alias("n"), c["term"].alias("term"))))
    best = counted(docs, text).select("doc_id", F.posexplode(F.slice(ordered, 1, k)).alias("at", "c"))
    return best.select("doc_id", "c.term", (-F.col("c.n")).alias("tf"), (F.col("at") + 1).alias("rank"))


def document_lengths(tf: DataFrame) -> DataFrame:
    return tf.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))


def term_statistics(tf: DataFrame) -> DataFrame:
    """df and cf of each term in one aggregate."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("n_tokens"))


def vocabulary_statistics(tf: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Statistics of the vocabulary's terms; corpus totals are to be taken of the unfiltered rows."""
    return term_statistics(tf.join(vocabulary.select("term").distinct(), "term", "left_semi"))


def merge_term_statistics(*parts: DataFrame) -> DataFrame:
    """Statistics of disjoint document sets, added up."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def merge_corpus_statistics(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def build(docs: DataFrame, text: str = "text", store: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """Index documents by their Latin-1 terms; a document without terms has length 0.

    ``store`` writes the postings and reads them back, so that the other tables
    are made of them and the texts are read once.
    """
    tf = frequencies(docs, text).select("term", "doc_id", "tf")
    if store is not None:
        tf = store(tf)
    lengths = docs.select(*(c for c in docs.columns if c != text)).join(document_lengths(tf), "doc_id", "left").fillna(0, ["doc_len"])
    return Index(tf, lengths, term_statistics(tf), corpus_statistics(lengths))


def build_for(docs: DataFrame, terms: Collection[str], text: str = "text", store: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """What ``build`` makes, with the postings and statistics of some terms alone; lengths and corpus totals are whole.

    The texts are read once, and a document's few counts are stored with its
    length; the postings have doc_len, so that they needn't meet the documents.
    """
    if repeats(docs):
        whole, asked = build(docs, text, store), F.col("term").isin(list(terms))
        return Index(whole.postings.where(asked), whole.documents, whole.term_stats.where(asked), whole.corpus)
    rows = counted(docs, text, terms)
    if store is not None:
        rows = store(rows)
    tf = rows.select("doc_id", "doc_len", F.explode("counts").alias("c")).select("c.term", "doc_id", "c.tf", "doc_len")
    lengths = rows.select("doc_id", "doc_len")
    return Index(tf, lengths, term_statistics(tf), corpus_statistics(lengths), rows)


def with_lengths(index: Index, rows: DataFrame) -> DataFrame:
    """``rows`` of the index's postings with their documents' doc_len."""
    return rows if "doc_len" in rows.columns else rows.join(index.documents.select("doc_id", "doc_len"), "doc_id")


def positional_postings(terms: DataFrame) -> DataFrame:
    """term, doc_id, tf, positions of rows (doc_id, term, token_pos, char_pos), in the order of token_pos."""
    at = F.struct("token_pos", "char_pos")
    return terms.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list(at)).alias("positions"))


def write(index: Index, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """Parquet tables below ``path``; by default an existing index is an error."""
    n = files or int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.postings.repartition(n, "term").sortWithinPartitions("term", "doc_id").write.mode(mode).parquet(f"{path}/postings")
    index.documents.write.mode(mode).parquet(f"{path}/documents")
    index.term_stats.repartition(max(1, n // 8), "term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/term_stats")
    index.corpus.coalesce(1).write.mode(mode).parquet(f"{path}/corpus")


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "documents", "term_stats", "corpus")))


def lookup(index: Index, terms: list[str]) -> DataFrame:
    """Postings of the terms with their documents; absent terms have no rows. The filter reaches the scan."""
    found = index.postings.where(F.col("term").isin(terms))
    return found if "doc_len" in found.columns else found.join(index.documents, "doc_id")


def lookup_document(index: Index, doc_id: int) -> DataFrame:
    return index.documents.where(F.col("doc_id") == doc_id)


def all_postings(index: Index) -> DataFrame:
    return index.postings.orderBy("term", "doc_id")


def missing_documents(index: Index) -> DataFrame:
    """Integrity: postings whose document is unknown."""
    return index.postings.join(index.documents, "doc_id", "left_anti")


def collect_postings(postings: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, postings: the query terms that each document holds, as an array of (term, tf)."""
    return postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("postings"))


def inverted(postings: DataFrame) -> DataFrame:
    """term, postings: an array of (doc_id, tf) by doc_id."""
    return postings.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def segment_offsets(segments: DataFrame, segment: str = "segment", order: Column | None = None) -> DataFrame:
    """segment, n, offset: the document ids of a merge start at the sum of the sizes before.

    One row a segment meets in the window.
    """
    sizes = segments.groupBy(segment).agg((F.max("doc_id") + 1).alias("n"))
    w = Window.orderBy(order if order is not None else F.col(segment)).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(segment, "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))


def merge(indexes: list[Index]) -> Index:
    """One index of several; ids are shifted by the segments before."""
    base, postings, documents = 0, None, None
    for i in indexes:
        p = i.postings.withColumn("doc_id", F.col("doc_id") + base)
        d = i.documents.withColumn("doc_id", F.col("doc_id") + base)
        postings = p if postings is None else postings.unionByName(p)
        documents = d if documents is None else documents.unionByName(d)
        last = i.documents.agg(F.max("doc_id")).first()[0]
        base += 0 if last is None else last + 1
    return Index(postings, documents, merge_term_statistics(*(i.term_stats for i in indexes)), merge_corpus_statistics(*(i.corpus for i in indexes)))


def next_id(index: Index) -> int:
    """The first free document id; ids start at 1."""
    return (index.documents.agg(F.max("doc_id")).first()[0] or 0) + 1


def entity_index(annotations: DataFrame) -> Index:
    """Of rows (doc_id, entity): an index whose terms are entities; the length is the number of annotations."""
    tf = annotations.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("tf")).withColumnRenamed("entity", "term")
    lengths = document_lengths(tf)
    return Index(tf.select("term", "doc_id", "tf"), lengths, term_statistics(tf), corpus_statistics(lengths))


def keep_latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Of rows with one key the last by ``order``."""
    w = Window.partitionBy(key).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
