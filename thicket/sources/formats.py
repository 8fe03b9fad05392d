"""Text formats of retrieval experiments, read and written through Spark's own readers.

Each reader takes any path, or list of paths, that Spark reads. Lines that
belong to no record are skipped or an error, as each docstring says.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Paths = str | Sequence[str]


def expand(spark: SparkSession, argument: str) -> list[str]:
    """``@file`` stands for the lines of a file, all else for itself."""
    if not argument.startswith("@"):
        return [argument.removeprefix("file://") if argument.startswith("file:///") else argument]
    return [r.value.strip() for r in spark.read.text(argument[1:]).collect() if r.value.strip()]


def lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """value, path, line: lines with their file and a number that grows within it."""
    text = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return text.select("value", F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") * 2 ** 20 + F.monotonically_increasing_id() % 2 ** 33).alias("line"))


def words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def _fail(message: Column) -> Column:
    return F.raise_error(message)


# --- qrels and runs ---------------------------------------------------------------


def read_qrels(spark: SparkSession, paths: Paths, scale: str = "graded") -> DataFrame:
    """query_id, doc_id, relevance of lines with four words; others are skipped.

    scale: ``graded`` (whole numbers), ``binary`` (0 or 1) or ``text``; a value
    outside the scale is an error.
    """
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(words(F.col("value")).alias("w")).where(F.size("w") == 4)
    rel = F.col("w")[3]
    if scale == "graded":
        rel = F.coalesce(F.regexp_extract(rel, r"^[-+]?\d+", 0).try_cast("int"), _fail(F.concat(F.lit("relevance: "), rel)).cast("int"))
    elif scale == "binary":
        rel = F.when(rel.isin("0", "1"), rel.cast("int")).otherwise(_fail(F.concat(F.lit("binary relevance: "), rel)).cast("int"))
    return rows.select(F.col("w")[0].alias("query_id"), F.col("w")[2].alias("doc_id"), rel.alias("relevance"))


def is_positive(relevance: Column, scale: str = "graded") -> Column:
    return F.lit(True) if scale == "text" else relevance > 0


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", F.col("relevance").cast("string")).alias("value")).write.text(path)


def qrels_by_query(qrels: DataFrame) -> DataFrame:
    """query_id, entries: an array of (doc_id, relevance)."""
    return qrels.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "relevance"))).alias("entries"))


def read_run(spark: SparkSession, paths: Paths) -> DataFrame:
    """query_id, doc_id, rank, score, method, path, line; six words or more a line, blank lines skipped, others an error."""
    rows = lines(spark, paths).withColumn("w", words(F.col("value"))).where(F.size("w") > 0)
    w = F.when(F.size("w") >= 6, F.col("w")).otherwise(_fail(F.concat(F.lit("no run line: "), F.col("value"))).cast("array<string>"))
    rows = rows.withColumn("w", w)
    place = F.coalesce(F.col("w")[3].try_cast("int"), _fail(F.concat(F.lit("rank: "), F.col("value"))).cast("int"))
    score = F.coalesce(F.col("w")[4].try_cast("double"), _fail(F.concat(F.lit("score: "), F.col("value"))).cast("double"))
    return rows.select(F.col("w")[0].alias("query_id"), F.col("w")[2].alias("doc_id"), place.alias("rank"), score.alias("score"), F.col("w")[5].alias("method"), "path", "line")


def write_run(run: DataFrame, path: str, method: str | None = None) -> None:
    name = F.lit(method) if method is not None else F.col("method")
    line = F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"), name)
    run.repartitionByRange("query_id", "rank").sortWithinPartitions("query_id", "rank").select(line.alias("value")).write.text(path)


def read_queries_tsv(spark: SparkSession, paths: Paths) -> DataFrame:
    """query_id, terms, names, entities: four fields between tabs, the last three divided by blanks."""
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 2)
    part = lambda i: F.coalesce(words(F.get("f", F.lit(i))), F.array().cast("array<string>"))
    return rows.select(F.col("f")[0].alias("query_id"), part(1).alias("terms"), part(2).alias("names"), part(3).alias("entities"))


# --- documents ---------------------------------------------------------------------


def records(spark: SparkSession, paths: Paths, end: str) -> DataFrame:
    """value, archive: what stands between two ends; blank remainders are skipped."""
    text = spark.read.option("lineSep", end).text(paths if isinstance(paths, str) else list(paths))
    return text.select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("archive")).where(F.col("value").rlike(r"\S"))


def _element(text: Column, tag: str) -> Column:
    found = F.regexp_extract(text, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)
    return F.when(text.rlike(rf"(?s)<{tag}>.*?</{tag}>"), found)


def read_robust(spark: SparkSession, paths: Paths) -> DataFrame:
    """archive, doc_name, header, date, headline, text of ``<DOC>`` elements; one without a DOCNO is an error."""
    rows = records(spark, paths, "</DOC>").withColumn("doc", F.regexp_extract("value", r"(?s)^\s*<DOC>\s*(.*)$", 1))
    name = F.coalesce(_element(F.col("doc"), "DOCNO"), _fail(F.concat(F.lit("no document: "), F.substring("value", 1, 200))).cast("string"))
    head = r"(?s)^<DOCNO>.*?</DOCNO>\s*"
    rest, out = F.regexp_replace("doc", head, ""), {}
    for column, tag in (("header", "DOCHDR"), ("date", "DATE"), ("headline", "HEADLINE")):
        rows = rows.withColumn("_rest", rest)
        own = F.col("_rest").startswith(f"<{tag}>")
        rows = rows.withColumn(column, F.when(own, _element(F.col("_rest"), tag)))
        rest = F.when(own, F.regexp_replace("_rest", rf"(?s)^<{tag}>.*?</{tag}>\s*", "")).otherwise(F.col("_rest"))
        out[column] = column
    return rows.withColumn("doc_name", name).withColumn("text", rest).select("archive", "doc_name", *out, "text")


def read_news_topics(spark: SparkSession, paths: Paths) -> DataFrame:
    """number, doc_id, url, entities (id, mentions, link) of ``<top>`` elements."""
    rows = records(spark, paths, "</top>")
    v = F.col("value")
    blocks = F.regexp_extract_all(v, F.lit(r"(?s)<entity>(.*?)</entity>"), F.lit(1))
    mentions = lambda e: F.transform(F.regexp_extract_all(e, F.lit(r"(?s)<mention>\s*(.*?)\s*</mention>"), F.lit(1)), lambda m: m)
    one = lambda e, tag: F.regexp_extract(e, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)
    entities = F.transform(blocks, lambda e: F.struct(one(e, "id").alias("id"), mentions(e).alias("mentions"), one(e, "link").alias("link")))
    number = F.coalesce(F.regexp_extract(v, r"(?s)<num>\s*Number:\s*(\d+)", 1).try_cast("int"), _fail(F.concat(F.lit("no topic: "), F.substring("value", 1, 200))).cast("int"))
    return rows.select(number.alias("number"), one(v, "docid").alias("doc_id"), one(v, "url").alias("url"), entities.alias("entities"))


def read_test_documents(spark: SparkSession, paths: Paths) -> DataFrame:
    """archive, doc_name, text of lines ``name:content``."""
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths))
    parts = F.split("value", ":", 2)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("archive"), parts[0].alias("doc_name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def read_annotations(spark: SparkSession, paths: Paths) -> DataFrame:
    """archive, doc_name, annotations (surface, begin, end, posterior, posterior_context, entity).

    A document is a line ``archive#name``, a line of six fields between tabs
    for each annotation, and a blank line. A line of other fields is an error.
    """
    rows = records(spark, paths, "\n\n").withColumn("l", F.split(F.trim(F.col("value"), F.lit("\n")), "\n"))
    head = F.split(F.col("l")[0], "#", 2)
    fields = F.filter(F.slice("l", 2, F.size("l")), lambda x: x != "")

    def annotation(line: Column) -> Column:
        f = F.split(line, "\t")
        f = F.when(F.size(f) == 6, f).otherwise(_fail(F.concat(F.lit("no annotation: "), line)).cast("array<string>"))
        return F.struct(f[0].alias("surface"), f[1].cast("int").alias("begin"), f[2].cast("int").alias("end"), f[3].cast("double").alias("posterior"), f[4].cast("double").alias("posterior_context"), f[5].alias("entity"))

    return rows.select(head[0].alias("archive"), F.get(head, F.lit(1)).alias("doc_name"), F.transform(fields, annotation).alias("annotations"))


def entity_documents(annotations: DataFrame) -> DataFrame:
    """doc_name (without its time stamp), entity: a row an annotation, as the entity index takes them."""
    return annotations.select(F.regexp_replace("doc_name", "^[^-]*-?", "").alias("doc_id"), F.explode("annotations.entity").alias("entity"))


# --- embeddings ----------------------------------------------------------------------


def read_embedding(spark: SparkSession, paths: Paths, kind: str | None = None) -> DataFrame:
    """term, vec (floats) of GloVe or word2vec text; word2vec begins with a line of two numbers.

    ``kind`` glove or word2vec; by default the first line tells. A vector of
    another length than the first is an error.
    """
    text = spark.read.text(paths if isinstance(paths, str) else list(paths))
    first = text.first()
    if first is None:
        raise ValueError("empty embedding")
    head = first.value.split()
    if kind is None:
        kind = "word2vec" if len(head) == 2 else "glove"
    dim = int(head[1]) if kind == "word2vec" else len(head) - 1
    rows = text.where(F.col("value") != "")
    if kind == "word2vec":
        rows = rows.where(F.col("value") != first.value)
    f = F.split(F.rtrim("value"), "[ \t]")
    rows = rows.select(F.when(F.size(f) == dim + 1, f).otherwise(_fail(F.concat(F.lit("no vector: "), F.substring("value", 1, 100))).cast("array<string>")).alias("f"))
    return rows.select(F.col("f")[0].alias("term"), F.slice("f", 2, dim).cast("array<float>").alias("vec"))


def json_array(rows: DataFrame) -> DataFrame:
    """One row: all rows as a JSON array; for small tables."""
    return rows.select(F.to_json(F.struct("*")).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("]")).alias("value"))
