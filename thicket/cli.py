"""Command line: ``python -m thicket MODE ...`` (or ``spark-submit``).

Paths are anything that Spark reads; ``@file`` as an input stands for the paths
in that file. Rankings, statistics and indexes are folders of Spark files.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import text as X
from thicket.operators import evaluation as E
from thicket.operators import index as I
from thicket.operators import ltr as L
from thicket.operators import models as M
from thicket.operators import ranking as R
from thicket.plans import querytree as Q
from thicket.sources import documents as D
from thicket.sources import formats as S
from thicket.sources import html as H
from thicket.streaming import incremental as N

MODES: dict[str, tuple[Callable, Callable]] = {}


def mode(*arguments: tuple[list[str], dict]) -> Callable:
    """Register a function of (spark, arguments) as the mode of its name."""

    def add(f: Callable[[SparkSession, argparse.Namespace], DataFrame | None]) -> Callable:
        def describe(parser: argparse.ArgumentParser) -> None:
            for names, options in arguments:
                parser.add_argument(*names, **options)

        MODES[f.__name__.replace("_", "-")] = (f, describe)
        return f

    return add


def arg(*names: str, **options) -> tuple[list[str], dict]:
    return list(names), options


FORMAT = arg("-f", "--format", default="test", choices=sorted(D.FORMATS), help="format of the documents")
INPUTS = arg("inputs", nargs="+")
OUT = arg("-o", "--output", required=True)


def whole(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect())


def read(spark: SparkSession, kind: str, inputs: list[str]) -> DataFrame:
    paths = [p for i in inputs for p in S.expand(spark, i)]
    docs = [D.read_documents(spark, kind, p) for p in paths]
    found = docs[0]
    for d in docs[1:]:
        found = found.unionByName(d)
    return found


def identified(docs: DataFrame) -> DataFrame:
    """With doc_id: the archive and the name, which never change with the order of the files."""
    return docs.withColumn("doc_id", F.concat_ws("/", "archive", "doc_name"))


def vocabulary_of(queries: dict[str, Q.Node]) -> set[tuple[str, ...]]:
    return set().union(*(Q.field_terms(q, "text") for q in queries.values()))


@mode(arg("-q", "--queries", required=True), FORMAT, OUT, INPUTS)
def corpus_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    """Statistics of the queries' tokens and phrases."""
    docs = Q.prepared(identified(read(spark, a.format, a.inputs)))
    stats, corpus = Q.corpus_statistics(docs, vocabulary_of(Q.parse_queries(whole(spark, a.queries))))
    stats.write.parquet(f"{a.output}/term_stats")
    corpus.write.parquet(f"{a.output}/corpus")


@mode(OUT, INPUTS)
def merge_corpus_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    """Statistics of disjoint document sets, added up."""
    tables = lambda name: [spark.read.parquet(f"{p}/{name}") for p in a.inputs]
    I.merge_term_statistics(*tables("term_stats")).write.parquet(f"{a.output}/term_stats")
    I.merge_corpus_statistics(*tables("corpus")).write.parquet(f"{a.output}/corpus")


@mode(arg("-q", "--queries", required=True), arg("-p", "--parameters", required=True), arg("-s", "--stats", required=True), arg("-e", "--entities"), arg("-n", "--count", type=int, default=10), arg("--raw-query-terms", action="store_true"), FORMAT, OUT, INPUTS)
def score(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rank documents by query trees: results.json and a run."""
    queries = Q.parse_queries(whole(spark, a.queries), a.raw_query_terms)
    parameters = Q.parse_parameters(whole(spark, a.parameters))
    docs = identified(read(spark, a.format, a.inputs))
    background = Q.background(spark.read.parquet(f"{a.stats}/term_stats"), spark.read.parquet(f"{a.stats}/corpus"), vocabulary_of(queries))
    prepared, entity_bg = Q.prepared(docs), None
    if a.entities:
        made = I.open_index(spark, a.entities)
        entities = made.postings.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("entities"))
        known = entities.join(made.documents.select("doc_id", F.col("doc_len").alias("entity_len")), "doc_id").withColumnRenamed("doc_id", "_entity_doc")
        prepared = prepared.join(known, F.col("_entity_doc") == X.strip_stream_time(F.col("doc_name")), "left").drop("_entity_doc")
        wanted = set().union(*(Q.field_terms(q, "freebase_id") for q in queries.values()))
        entity_bg = Q.background(made.term_stats, made.corpus, wanted, 0.05)
    best = Q.score(prepared, queries, parameters, a.count, background, entity_bg)
    results = Q.with_postings(best, docs, queries)
    Q.write_results(results, f"{a.output}/results.json")
    run = best.select(F.concat_ws("-", "query_id", "param_set").alias("query_id"), F.col("doc.doc_name").alias("doc_id"), "rank", "score", F.lit("thicket").alias("method"))
    S.write_run(run, f"{a.output}/run")


@mode(OUT, arg("-k", "--per-input", type=int), arg("-n", "--count", type=int), INPUTS)
def merge_rankings(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best documents of several results.json, for each query and parameter set."""
    found = [Q.read_results(spark, p).withColumn("doc_id", F.concat_ws("/", "archive", "doc_name")) for p in a.inputs]
    merged = R.merge_cut(found, a.per_input, a.count)
    Q.write_results(merged.withColumn("doc", F.struct("doc_name", "archive", "length")), a.output)


@mode(FORMAT, OUT, INPUTS)
def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Build an index; an existing one is an error."""
    docs = identified(read(spark, a.format, a.inputs))
    words = docs.select("doc_id", F.explode(X.index_words(F.col("text"))).alias("term"))
    tf = I.term_frequencies(words).select("term", "doc_id", "tf")
    lengths = docs.select("doc_id", "archive", "doc_name", F.coalesce(F.size(F.filter(X.split_words(X.strip_punctuation(F.col("text"))), X.has_alphanumeric)), F.lit(0)).cast("long").alias("doc_len"))
    I.write(I.Index(tf, lengths, I.term_statistics(tf), I.corpus_statistics(lengths)), a.output)


@mode(arg("index"), arg("terms", nargs="+"), arg("-m", "--model", default="bm25", choices=["bm25", "tfidf", "ql"]), arg("--mu", type=float, default=1000.0), arg("-n", "--count", type=int, default=10))
def query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The best documents of an index for some terms."""
    made, rows = I.open_index(spark, a.index), M.query_rows(spark, {"q": a.terms})
    model = {"bm25": M.bm25, "tfidf": M.tf_idf, "ql": lambda i, q: M.query_likelihood(i, M.each_once(q), M.Dirichlet(a.mu))}[a.model]
    return R.top_k(model(made, rows), a.count).select("doc_id", "score")


@mode(arg("index"), arg("terms", nargs="*"))
def count_postings(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """How many documents hold each term."""
    stats = I.open_index(spark, a.index).term_stats
    return (stats.where(F.col("term").isin(a.terms)) if a.terms else stats).orderBy("term")


@mode(arg("index"), arg("terms", nargs="*"))
def dump_postings(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """term, doc_id, tf, in order."""
    made = I.open_index(spark, a.index)
    return (made.postings.where(F.col("term").isin(a.terms)) if a.terms else made.postings).orderBy("term", "doc_id")


@mode(OUT, arg("index"))
def compact(spark: SparkSession, a: argparse.Namespace) -> None:
    """One segment of an incremental index's many."""
    N.compact(spark, a.index, a.output)


@mode(OUT, INPUTS)
def entity_index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Index entity annotations."""
    I.write(I.entity_index(S.entity_documents(S.read_annotations(spark, a.inputs))), a.output)


@mode(OUT, INPUTS)
def merge_entity_indexes(spark: SparkSession, a: argparse.Namespace) -> None:
    """One index of several; of a document that many have, the last one's postings count."""
    parts = [I.open_index(spark, p) for p in a.inputs]
    numbered = [p.documents.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    documents = numbered[0]
    for d in numbered[1:]:
        documents = documents.unionByName(d)
    last = I.keep_latest(documents, "doc_id", F.col("_part"))
    postings = None
    for i, p in enumerate(parts):
        rows = p.postings.withColumn("_part", F.lit(i))
        postings = rows if postings is None else postings.unionByName(rows)
    kept = postings.join(last.select("doc_id", "_part"), ["doc_id", "_part"], "left_semi").select("term", "doc_id", "tf")
    lengths = last.drop("_part")
    I.write(I.Index(kept, lengths, I.term_statistics(kept), I.corpus_statistics(lengths)), a.output)


@mode(arg("index"), arg("document"))
def entities_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A document's entities as JSON."""
    rows = I.open_index(spark, a.index).postings.where(F.col("doc_id") == a.document)
    return S.json_array(rows.select("term", "tf"))


@mode(arg("index"))
def list_documents(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return I.open_index(spark, a.index).documents.orderBy("doc_id")


@mode(FORMAT, OUT, arg("-w", "--wanted", required=True, help="lines of archive, tab, name"), INPUTS)
def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Selected documents as Parquet."""
    wanted = spark.read.csv(a.wanted, sep="\t", schema="archive string, doc_name string")
    D.extract(read(spark, a.format, a.inputs), wanted).write.parquet(a.output)


@mode(FORMAT, INPUTS)
def names(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """archive and name of every document."""
    return read(spark, a.format, a.inputs).select("archive", "doc_name")


@mode(arg("qrels"), arg("run"), arg("--metrics", action="store_true", help="every measure of every query"), arg("--complete", action="store_true"))
def evaluate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Mean average precision by method; the run's order of lines is its ranking."""
    qrels = S.read_qrels(spark, a.qrels, "binary" if not a.metrics else "graded")
    run = R.trusted(S.read_run(spark, a.run).drop("rank"), "line", ("query_id", "method"))
    return E.metric_rows(run, qrels, complete=a.complete) if a.metrics else E.map_by_method(run, qrels)


@mode(OUT, arg("-k", "--count", type=int, default=1000), arg("-m", "--method", default="merged"), INPUTS)
def merge_runs(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best documents of each query over several runs."""
    runs = [S.read_run(spark, p).select("query_id", "doc_id", "score") for p in a.inputs]
    S.write_run(R.merge_runs(runs, a.count, a.method), a.output)


FEATURE = arg("features", nargs="+", help="NAME=RUN")


def feature_runs(spark: SparkSession, features: list[str]) -> dict[str, DataFrame]:
    pairs = [f.partition("=") for f in features]
    if bad := [n for n, sep, path in pairs if not (n and sep and path)]:
        raise ValueError(f"NAME=RUN expected: {bad}")
    return {n: S.read_run(spark, path) for n, _, path in pairs}


@mode(arg("-q", "--qrels", required=True), OUT, arg("--seed", type=int, default=0), FEATURE)
def learn(spark: SparkSession, a: argparse.Namespace) -> None:
    """Weights of runs as features; OUTPUT holds them as JSON."""
    space, rows = L.features_of_runs(feature_runs(spark, a.features))
    qrels = S.read_qrels(spark, a.qrels)
    model, _ = L.learn(space, L.with_relevance(rows, qrels), L.totals_of(qrels), a.seed)
    L.save_model(model, spark, a.output)


@mode(arg("-m", "--model", required=True), OUT, arg("--method", default="l2r"), FEATURE)
def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    """A run by a model; a feature that the model has and the runs lack is an error."""
    model = L.load_model(spark, a.model)
    space, rows = L.features_of_runs(feature_runs(spark, a.features))
    S.write_run(model.rerank(rows, space), a.output, a.method)


@mode(INPUTS)
def html_clean(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Title and body of HTML files."""
    files = spark.read.option("wholetext", "true").text(a.inputs)
    return H.clean_pages(files.withColumnRenamed("value", "html"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("thicket", description=__doc__)
    modes = top.add_subparsers(dest="mode", required=True)
    for name, (f, describe) in MODES.items():
        describe(modes.add_parser(name, help=(f.__doc__ or "").split("\n")[0]))
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    found = MODES[a.mode][0](spark or SparkSession.builder.appName("thicket").getOrCreate(), a)
    if found is not None:
        # a table for the terminal is read row by row
        for row in found.toLocalIterator():
            print(*("" if x is None else x for x in row), sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
