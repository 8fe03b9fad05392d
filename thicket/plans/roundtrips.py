"""Queries of what is written and read back: formats, index life cycle, streams; and of vectors, spaces and sets.

Each writes the driver's tables in some format, or into an index, and reads
them again; its SQL says what must come back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions import text as X
from thicket.functions.stopwords import read_stop_words
from thicket.operators import aggregates as A
from thicket.operators import evaluation as E
from thicket.operators import index as I
from thicket.operators import ltr as L
from thicket.operators import ranking as R
from thicket.operators import vectors as V
from thicket.plans.catalogue import TERMS, TF, TOK, query, ranked_sql, table
from thicket.scratch import fresh_path, materialize
from thicket.sources import archives, compressed, documents, formats
from thicket.streaming import incremental as S

# --- qrels, runs, queries ------------------------------------------------------------

_QRELS = "qrels AS (SELECT 'quality' AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, quality AS relevance FROM labels WHERE quality IS NOT NULL UNION ALL SELECT 'toxic', CAST(doc_id AS VARCHAR), toxic FROM labels WHERE toxic IS NOT NULL)"


def label_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    each = [labels.select(F.lit(c).alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col(c).alias("relevance")) for c in ("quality", "toxic")]
    return each[0].union(each[1]).where("relevance is not null")


def written_qrels(spark: SparkSession, sf_dir: str, scale: str = "graded") -> DataFrame:
    path = fresh_path(spark, "qrels")
    formats.write_qrels(label_qrels(spark, sf_dir), path)
    return formats.read_qrels(spark, path, scale)


@query(f"WITH {_QRELS} SELECT query_id, doc_id, relevance FROM qrels")
def qrels_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_qrels(spark, sf_dir)


@query(f"WITH {_QRELS} SELECT query_id, doc_id, relevance, relevance > 0 AS positive FROM qrels")
def qrels_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_qrels(spark, sf_dir, "binary").withColumn("positive", formats.is_positive(F.col("relevance"), "binary"))


@query(f"WITH {_QRELS} SELECT query_id, doc_id, CAST(relevance AS VARCHAR) AS relevance FROM qrels")
def qrels_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_qrels(spark, sf_dir, "text")


@query(f"WITH {_QRELS} SELECT query_id, string_agg(doc_id || ':' || relevance, ' ' ORDER BY doc_id, relevance) AS entries FROM qrels GROUP BY query_id")
def qrels_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = formats.qrels_by_query(written_qrels(spark, sf_dir))
    return grouped.select("query_id", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["doc_id"], e["relevance"].cast("string"))), " ").alias("entries"))


@query(f"WITH {_QRELS} SELECT query_id, count(*) FILTER (relevance >= 1) AS n_relevant FROM qrels GROUP BY query_id")
def relevant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.total_relevant(written_qrels(spark, sf_dir))


_RUN = "SELECT lang AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, CAST(n_chars AS DOUBLE) AS score, source AS method FROM documents"


def written_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("score"), F.col("source").alias("method"))
    path = fresh_path(spark, "run")
    formats.write_run(R.rank(docs), path)
    return formats.read_run(spark, path)


@query(f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({_RUN})")
def run_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_run(spark, sf_dir).select("query_id", "doc_id", "rank", "score", "method")


@query(f"SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM ({_RUN}) WHERE score >= 500 AND method <> 'src1'")
def ranking_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a run file's places is trusted, and rows taken out leave no gap."""
    run = R.trusted(written_run(spark, sf_dir), "rank")
    return R.keep(run, (F.col("score") >= 500) & (F.col("method") != "src1")).select("query_id", "doc_id", "rank")


@query(f"SELECT query_id, string_agg(doc_id, ' ' ORDER BY rank) AS best FROM ({_RUN}) WHERE rank <= 5 GROUP BY query_id")
def ranking_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.nested(R.take_top(written_run(spark, sf_dir), 5))
    return best.select("query_id", F.array_join(F.transform("ranking", lambda r: r["doc_id"]), " ").alias("best"))


@query(f"WITH {_QRELS}, run AS (SELECT 'quality' AS query_id, doc_id FROM ({_RUN})) SELECT query_id, doc_id FROM run ANTI JOIN qrels USING (query_id, doc_id)")
def run_unjudged(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = written_run(spark, sf_dir).withColumn("query_id", F.lit("quality"))
    return E.unjudged(run, written_qrels(spark, sf_dir)).select("query_id", "doc_id")


@query("SELECT CAST(item_id AS VARCHAR) AS query_id, string_agg(w, ' ' ORDER BY i) AS terms, string_agg(w, ' ' ORDER BY i) FILTER (i < 2) AS names, CAST(item_id AS VARCHAR) AS entities FROM (SELECT item_id, unnest(string_split_regex(trim(text), '\\s+')) AS w, unnest(range(len(string_split_regex(trim(text), '\\s+')))) AS i FROM benchmark) GROUP BY item_id")
def queries_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.trim("text"), r"\s+")
    rows = table(spark, sf_dir, "benchmark").select(F.concat_ws("\t", F.col("item_id").cast("string"), F.array_join(words, " "), F.array_join(F.slice(words, 1, 2), " "), F.col("item_id").cast("string")).alias("value"))
    path = fresh_path(spark, "queries")
    rows.write.text(path)
    read = formats.read_queries_tsv(spark, path)
    return read.select("query_id", *(F.array_join(c, " ").alias(c) for c in ("terms", "names", "entities")))


# --- documents -----------------------------------------------------------------------


def robust_path(spark: SparkSession, sf_dir: str) -> str:
    """The documents as ``<DOC>`` elements; every third has no headline, every fifth is HTML."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<html><body><p>"), F.col("lang"), F.lit("</p></body></html>"))).otherwise(F.concat(F.lit("body: "), F.regexp_replace("text", "[<>]", " "), F.lit(".")))
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<HEADLINE> of "), F.col("source"), F.lit(" </HEADLINE>\n")))
    value = F.concat(F.lit("<DOC>\n<DOCNO> D-"), F.col("doc_id").cast("string"), F.lit(" </DOCNO>\n<DATE>"), F.col("n_chars").cast("string"), F.lit("</DATE>\n"), head, body)
    path = fresh_path(spark, "robust")
    docs.select(value.alias("value")).write.option("lineSep", "</DOC>\n").option("compression", "gzip").text(path)
    return path


_ROBUST = "SELECT 'D-' || doc_id AS doc_name, CAST(n_chars AS VARCHAR) AS date, CASE WHEN doc_id % 3 <> 0 THEN 'of ' || source END AS headline, CASE WHEN doc_id % 5 = 0 THEN {html} ELSE 'body: ' || regexp_replace(text, '[<>]', ' ', 'g') || '.' END AS text FROM documents WHERE text IS NOT NULL"


@query("SELECT doc_name, date, headline, md5(text) AS text FROM (" + _ROBUST.format(html="'<html><body><p>' || lang || '</p></body></html>'") + ")")
def robust_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.read_robust(spark, robust_path(spark, sf_dir)).select("doc_name", "date", "headline", F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT doc_name, md5(trim(text)) AS text FROM (" + _ROBUST.format(html="lang") + ")")
def robust_html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the name of the format; HTML bodies are cleaned."""
    docs = documents.read_documents(spark, "robust-html", robust_path(spark, sf_dir))
    return docs.select("doc_name", F.md5(F.trim("text").cast("binary")).alias("text"))


@query("SELECT 'D-' || doc_id AS doc_name FROM documents WHERE text IS NOT NULL AND lang = 'de'")
def documents_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a list of archives and names asks for."""
    docs = materialize(documents.read_documents(spark, "robust", robust_path(spark, sf_dir)), "robust-read")
    german = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("doc_name"))
    wanted = docs.select("archive", "doc_name").join(german, "doc_name")
    return documents.extract(docs, wanted).select("doc_name")


@query("SELECT CAST(item_id AS INTEGER) AS number, 'd' || item_id AS doc_id, 'http://x/' || item_id AS url, CASE WHEN item_id % 2 = 0 THEN 'e' || item_id || '=a b|c@l' ELSE '' END AS entities FROM benchmark")
def news_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id").cast("string")
    entity = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("<entity>\n<id> e"), i, F.lit(" </id>\n<mention>a b</mention>\n<mention> c </mention>\n<link>l</link>\n</entity>\n"))).otherwise("")
    value = F.concat(F.lit("<top>\n<num> Number: "), i, F.lit(" </num>\n<docid>d"), i, F.lit("</docid>\n<url>http://x/"), i, F.lit("</url>\n"), entity)
    path = fresh_path(spark, "topics")
    table(spark, sf_dir, "benchmark").select(value.alias("value")).write.option("lineSep", "</top>\n").text(path)
    read = formats.read_news_topics(spark, path)
    shown = F.array_join(F.transform("entities", lambda e: F.concat(e["id"], F.lit("="), F.array_join(e["mentions"], "|"), F.lit("@"), e["link"])), ";")
    return read.select("number", "doc_id", "url", shown.alias("entities"))


@query("SELECT 'c' || c_custkey AS doc_name, c_name || ': ' || c_mktsegment AS text FROM customer")
def test_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a name, a colon and a content that may hold colons."""
    path = fresh_path(spark, "lines")
    table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(":"), F.col("c_name"), F.lit(": "), F.col("c_mktsegment")).alias("value")).write.text(path)
    return documents.read_documents(spark, "test", path).select("doc_name", "text")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as annotated documents, their events as annotations."""
    line = F.concat_ws("\t", F.col("event_type"), F.col("event_id").cast("string"), (F.col("event_id") + 3).cast("string"), F.col("value").cast("string"), F.lit("0.5"), F.concat(F.lit("/m/"), F.col("event_type")))
    docs = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    path = fresh_path(spark, "annotations")
    docs.select(F.concat(F.lit("part#17-u"), F.col("user_id").cast("string"), F.lit("\n"), F.col("lines")).alias("value")).write.option("lineSep", "\n\n").text(path)
    return formats.read_annotations(spark, path)


@query('SELECT \'part\' AS archive, \'17-u\' || user_id AS doc_name, event_type AS surface, CAST(event_id AS INTEGER) AS "begin", CAST(event_id + 3 AS INTEGER) AS "end", value AS posterior, \'/m/\' || event_type AS entity FROM events WHERE value IS NOT NULL')
def annotations_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotated(spark, sf_dir).select("archive", "doc_name", F.explode("annotations").alias("a"))
    return rows.select("archive", "doc_name", "a.surface", "a.begin", "a.end", "a.posterior", "a.entity")


@query("SELECT 'u' || user_id AS doc_id, '/m/' || event_type AS term, count(*) AS tf FROM events WHERE value IS NOT NULL GROUP BY ALL")
def annotations_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity index of annotations; document names lose their time stamp."""
    made = I.entity_index(formats.entity_documents(annotated(spark, sf_dir)))
    return made.postings.select("doc_id", "term", "tf")


_VECTORS = "SELECT 'v' || vec_id AS term, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS squares FROM embeddings"


def written_embedding(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    path = fresh_path(spark, kind)
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(" "), F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("value"))
    if kind == "word2vec":
        n, dim = rows.count(), table(spark, sf_dir, "embeddings").select(F.size("embedding")).first()[0]
        head = spark.createDataFrame([(0, f"{n} {dim}")], "at int, value string")
        rows = head.unionByName(rows.withColumn("at", F.lit(1))).coalesce(1).sortWithinPartitions("at").select("value")
    rows.write.text(path)
    read = formats.read_embedding(spark, path)
    squares = X.vector_dot(F.col("vec"), F.col("vec"))
    return read.select("term", F.size("vec").alias("dim"), F.round(squares, 5).alias("squares"))


@query(_VECTORS)
def embedding_glove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_embedding(spark, sf_dir, "glove")


@query(_VECTORS)
def embedding_word2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_embedding(spark, sf_dir, "word2vec")


# --- files ---------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer")
def compressed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of plain, gzip and bzip2 files, told apart by their content."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name").alias("value"))
    path = fresh_path(spark, "packed")
    for k, kind in enumerate(("none", "gzip", "bzip2")):
        rows.where(F.col("c_custkey") % 3 == k).select("value").write.option("compression", kind).text(f"{path}/{kind}")
    read = compressed.read_lines(spark, f"{path}/*/*")
    return read.select(F.split("value", ",")[0].cast("long").alias("c_custkey"), F.split("value", ",")[1].alias("c_name"))


@query("SELECT n_name FROM nation WHERE n_regionkey < 3")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``@list`` stands for the paths in a file."""
    path = fresh_path(spark, "listed")
    table(spark, sf_dir, "nation").select("n_name", "n_regionkey").write.partitionBy("n_regionkey").text(path)
    spark.createDataFrame([(f"{path}/n_regionkey={k}",) for k in range(3)], "value string").write.text(f"{path}-list")
    return formats.lines(spark, formats.expand(spark, f"@{path}-list")).select(F.col("value").alias("n_name"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return formats.json_array(nation).select(F.explode(F.from_json("value", f"array<struct<{', '.join(f'{n}: {t}' for n, t in nation.dtypes)}>>")).alias("r")).select("r.*")


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents")
def latin1_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as UTF-8, and as ISO-8859-1 where all their characters allow; either is told from the bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    narrow = ~F.col("text").rlike(r"[^\x00-\x7FÀ-ÿ]")
    data = F.when(narrow & (F.col("doc_id") % 2 == 0) & ~F.col("text").rlike(r"[À-ÿ][\u0080-¿]"), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    # two Latin-1 letters in a row could be read as UTF-8 only if the second were a sign below U+00C0
    return docs.select("doc_id", F.md5(X.latin1_fallback(data).cast("binary")).alias("text"))


@query("SELECT p_partkey, p_size FROM part")
def scientific_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are known by their logarithm, printed and read."""
    shown = X.scientific(F.log(F.col("p_size").cast("double")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(shown.cast("double")).cast("int").alias("p_size"))


@query("WITH s AS (SELECT DISTINCT n_name FROM nation WHERE n_regionkey = 1) SELECT n_nationkey FROM nation ANTI JOIN s USING (n_name)")
def stop_words_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "stop")
    nation = table(spark, sf_dir, "nation")
    nation.where("n_regionkey = 1").select(F.concat(F.lit(" "), F.col("n_name"), F.lit(" \n")).alias("value")).write.text(path)
    kept = X.drop_stop_words(F.array("n_name"), read_stop_words(spark, path))
    return nation.where(F.size(kept) > 0).select("n_nationkey")


# --- web archives and stream items ----------------------------------------------------


@query("SELECT 'p' || page_id AS doc_name, octet_length(encode(html)) AS n, md5(html) AS text FROM pages WHERE html IS NOT NULL AND page_id IS NOT NULL")
def warc_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as an archive's HTTP responses, among records of other types."""
    pages = table(spark, sf_dir, "pages").where("html is not null and page_id is not null").select(F.col("page_id").cast("string").alias("i"), F.encode("html", "UTF-8").alias("body"))
    http = F.concat(F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "UTF-8"), "body")
    length = F.octet_length(http).cast("string")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: p"), F.col("i"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    other = F.encode(F.concat(F.lit("WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: m"), F.col("i"), F.lit("\r\nContent-Type: text/plain\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")), "UTF-8")
    record = F.concat(other, F.encode(head, "UTF-8"), http, F.encode(F.lit("\r\n"), "UTF-8"))
    path = fresh_path(spark, "responses")
    pages.select(record.cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    read = archives.read_warc_responses(spark, path)
    return read.select("doc_name", F.octet_length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT CAST(item_id AS VARCHAR) AS doc_id, md5(regexp_replace(text, '[^\\x{00}-\\x{FE}]', '', 'g')) AS text FROM benchmark")
def structured_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as WARC records of XML fields; characters from U+00FF on are gone."""
    item = F.array(F.struct(F.col("text").alias("text"), F.lit(True).alias("tokenised")))
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), F.create_map(F.lit("body"), item).alias("fields"), F.create_map(F.lit("X-Lang"), F.lit("en")).alias("metadata"))
    path = fresh_path(spark, "structured")
    archives.write_structured(docs, path)
    whole = compressed.read_files(spark, path).select(F.col("content").cast("string").alias("c"))
    each = whole.select(F.explode(F.regexp_extract_all("c", F.lit(r"(?s)(WARC-TREC-ID: .*?</body>)"), F.lit(1))).alias("r"))
    return each.select(F.regexp_extract("r", r"^WARC-TREC-ID: (\S+)", 1).alias("doc_id"), F.md5(F.regexp_extract("r", r"(?s)<body>(.*)</body>$", 1).cast("binary")).alias("text"))


def _big(n: F.Column, width: int) -> F.Column:
    return F.unhex(F.lpad(F.hex(n), 2 * width, "0"))


def _field(kind: int, number: int, *value: F.Column) -> F.Column:
    return F.concat(F.unhex(F.lit(f"{kind:02x}{number:04x}")), *value)


def _string(number: int, text: F.Column) -> F.Column:
    data = F.encode(text, "UTF-8")
    return _field(11, number, _big(F.octet_length(data), 4), data)


@query("SELECT 'archived-' || conv_id || '-' || turn AS doc_name, text, make_timestamp(CAST(1330000000 + conv_id AS BIGINT) * 1000000) AS stream_time FROM conversations WHERE text IS NOT NULL AND turn % 2 = 0")
def stream_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as thrift stream items, every second without visible text."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    name = F.concat(F.lit("archived-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    stop = F.unhex(F.lit("00"))
    visible = F.when(F.col("turn") % 2 == 0, _string(5, F.col("text"))).otherwise(F.unhex(F.lit("")))
    body = _field(12, 7, _string(2, F.lit("UTF-8")), visible, stop)
    time = _field(12, 10, F.concat(F.unhex(F.lit("040001")), _double(F.col("conv_id") + 1330000000), stop))
    item = F.concat(_field(8, 1, F.unhex(F.lit("00000002"))), _string(2, name), body, _string(9, name), time, stop)
    path = fresh_path(spark, "items")
    # items follow each other without a separator; the last item's end is the writer's
    whole = rows.groupBy((F.col("conv_id") % 4).alias("g")).agg(F.array_join(F.array_sort(F.collect_list(F.hex(item))), "").alias("h"))
    whole.select(F.unhex(F.expr("substring(h, 1, length(h) - 2)")).cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return archives.visible_documents(archives.read_stream_items(spark, path)).select("doc_name", "text", "stream_time")


def _double(n: F.Column) -> F.Column:
    """The big-endian bytes of a whole number as a double."""
    exponent = F.floor(F.log2(n.cast("double"))).cast("long")
    bits = F.pow(F.lit(2.0), 52 - exponent).cast("long") * n + (exponent + 1022) * F.lit(1 << 52)
    return _big(bits, 8)


# --- index life cycle -----------------------------------------------------------------

_BTF = TF.replace("FROM documents d LEFT JOIN", "FROM docs d LEFT JOIN").replace("FROM documents)", "FROM docs)")
_BENCH = "docs AS (SELECT item_id AS doc_id, text FROM benchmark)"


def benchmark_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def stored(spark: SparkSession, docs: DataFrame) -> I.Index:
    path = fresh_path(spark, "index")
    I.write(I.build(docs), path)
    return I.open_index(spark, path)


@query(f"WITH {_BENCH}, {_BTF} SELECT term, doc_id, tf FROM tf")
def index_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built, written, opened, and all its postings read in order."""
    return I.all_postings(stored(spark, benchmark_documents(spark, sf_dir))).select("term", "doc_id", "tf")


@query(f"WITH {_BENCH}, {_BTF} SELECT doc_id, CAST(doc_len AS BIGINT) AS doc_len FROM dl WHERE doc_id = 7")
def index_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.lookup_document(stored(spark, benchmark_documents(spark, sf_dir)), 7).select("doc_id", "doc_len")


@query(f"WITH {_BENCH}, {_BTF} SELECT count(*) AS n_docs, (SELECT count(*) FROM st) AS n_terms, (SELECT max(doc_id) + 1 FROM docs) AS next_id, CAST(0 AS BIGINT) AS missing FROM docs")
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stored(spark, benchmark_documents(spark, sf_dir))
    missing = I.missing_documents(made).agg(F.count(F.lit(1)).alias("missing"))
    terms = made.term_stats.agg(F.count(F.lit(1)).alias("n_terms"))
    return made.corpus.select("n_docs").join(terms).join(missing).withColumn("next_id", F.lit(I.next_id(made)).cast("long"))


@query(f"WITH {_BENCH}, {_BTF} SELECT term, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM tf GROUP BY term")
def index_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = I.inverted(I.build(benchmark_documents(spark, sf_dir)).postings)
    return made.select("term", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), " ").alias("postings"))


_MERGED = "docs AS (SELECT item_id AS doc_id, text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id + 1 + (SELECT max(item_id) FROM benchmark WHERE item_id % 2 = 0), text FROM benchmark WHERE item_id % 2 = 1)"


@query(f"WITH {_MERGED}, {_BTF} SELECT term, doc_id, tf, CAST(doc_len AS BIGINT) AS doc_len, df, CAST(cf AS BIGINT) AS cf FROM tf JOIN dl USING (doc_id) JOIN st USING (term)")
def index_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two written indexes as one; the second's ids follow the first's."""
    docs = benchmark_documents(spark, sf_dir)
    made = I.merge([stored(spark, docs.where(F.col("doc_id") % 2 == k)) for k in (0, 1)])
    return made.postings.join(made.documents, "doc_id").join(made.term_stats, "term").select("term", "doc_id", "tf", "doc_len", "df", "cf")


def streamed(spark: SparkSession, df: DataFrame, parts: int) -> DataFrame:
    """A streaming table that has ``df`` in batches of one file."""
    path = fresh_path(spark, "stream")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def segments_path(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "segments")
    S.index_stream(streamed(spark, benchmark_documents(spark, sf_dir), 3), path, fresh_path(spark, "offsets")).awaitTermination()
    return path


@query(f"WITH {_BENCH}, {_BTF} SELECT term, df, CAST(cf AS BIGINT) AS cf FROM st")
def segments_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed batch by batch, the segments opened as one."""
    return S.open_segments(spark, segments_path(spark, sf_dir)).term_stats


@query(f"WITH {_BENCH}, {_BTF} SELECT term, doc_id, tf, CAST(doc_len AS BIGINT) AS doc_len FROM tf JOIN dl USING (doc_id)")
def segments_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.compact(spark, segments_path(spark, sf_dir), fresh_path(spark, "compacted"))
    return made.postings.join(made.documents, "doc_id").select("term", "doc_id", "tf", "doc_len")


@query(f"WITH {_BENCH}, {_BTF} SELECT term, df, CAST(cf AS BIGINT) AS cf FROM st")
def stream_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that grow with each batch; the last complete table."""
    path = fresh_path(spark, "statistics")
    counts = S.term_statistics_stream(streamed(spark, benchmark_documents(spark, sf_dir), 3))
    writer = counts.writeStream.outputMode("complete").foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch:010d}"))
    writer.option("checkpointLocation", fresh_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return S.latest(spark, path)


@query(ranked_sql("SELECT lang AS query_id, doc_id, CAST(n_chars AS DOUBLE) AS score FROM documents", 7))
def stream_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each key over a stream's batches."""
    scored = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("score"))
    path = fresh_path(spark, "best")
    S.top_k_stream(streamed(spark, scored, 3), path, fresh_path(spark, "offsets"), 7).awaitTermination()
    return S.latest(spark, path).select("query_id", "doc_id", "score", "rank")


@query(ranked_sql("SELECT lang AS query_id, doc_id, CAST(n_chars AS DOUBLE) AS score FROM documents", 7))
def stream_best_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by keyed state; of each key the last ranking that a batch sent."""
    scored = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("score"))
    path = fresh_path(spark, "changed")
    writer = S.top_k_state(streamed(spark, scored, 3), 7).writeStream.outputMode("update").foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch:010d}"))
    writer.option("checkpointLocation", fresh_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    sent = spark.read.parquet(path).withColumn("last", F.max("batch").over(Window.partitionBy("query_id")))
    return sent.where("batch = last").select("query_id", "doc_id", "score", "rank")


# --- folds, sets, spaces, vectors -----------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, max(l_extendedprice) AS dearest FROM lineitem GROUP BY ALL")
def folds_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.keyed_fold(table(spark, sf_dir, "lineitem"), ("l_returnflag", "l_linestatus"), n=F.count(F.lit(1)), quantity=F.round(F.sum("l_quantity"), 2), dearest=F.max("l_extendedprice"))


@query("SELECT c_nationkey, count(*) AS n, round(max(c_acctbal) - min(c_acctbal), 2) AS spread FROM customer GROUP BY c_nationkey")
def folds_in_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fold(rows):
        return rows.iloc[:1][["c_nationkey"]].assign(n=len(rows), spread=round(rows.c_acctbal.max() - rows.c_acctbal.min(), 2))

    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    return A.python_fold(rows, ("c_nationkey",), fold, "c_nationkey int, n long, spread double")


@query("SELECT event_type AS key, CAST(count(*) AS DOUBLE) AS weight, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY event_type")
def bag_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = A.by_frequency(A.bag(table(spark, sf_dir, "events"), "event_type"))
    order = [F.col("weight").desc(), "key"]
    return R.rank(counted.withColumn("all", F.lit(1)), by=("all",), score="weight", tie=("key",)).select("key", "weight", F.col("rank").cast("long").alias("place")).orderBy(*order)


_SETS = "s AS (SELECT user_id, list(DISTINCT event_type) AS types FROM events WHERE event_id % 40 = 0 GROUP BY user_id)"


def type_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 40 = 0").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))


@query(f"WITH {_SETS} SELECT user_id, list_has_any(types, ['click', 'error']) AS any_of, array_to_string(list_sort(list_filter(['click', 'error', 'view'], lambda x: NOT list_contains(types, x))), ' ') AS lacking, len(types) AS n FROM s")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built as distinct values; intersected, subtracted and counted."""
    asked = F.array(*(F.lit(x) for x in ("click", "error", "view")))
    rows = type_sets(spark, sf_dir)
    return rows.select("user_id", F.arrays_overlap("types", F.array(F.lit("click"), F.lit("error"))).alias("any_of"), F.array_join(F.array_sort(F.array_except(asked, "types")), " ").alias("lacking"), F.size("types").cast("long").alias("n"))


_SPACE = "f AS (SELECT l_orderkey, sum(l_discount) AS d, sum(l_quantity) AS q, sum(l_tax) AS t FROM lineitem GROUP BY l_orderkey)"


def order_features(spark: SparkSession, sf_dir: str) -> tuple[L.Space, DataFrame]:
    space = L.Space.of(("tax", "discount", "quantity"))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.sum(f"l_{n}").alias(n) for n in space.names))
    return space, sums.select("l_orderkey", F.array(*space.names).alias("features"))


@query(f"WITH {_SPACE} SELECT l_orderkey, round(t, 6) AS tax, round(q, 6) AS quantity FROM f")
def space_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of another space, in its order, by name."""
    space, rows = order_features(spark, sf_dir)
    to = L.Space(("tax", "quantity"))
    out = space.project(F.col("features"), space.common(to))
    common = space.common(to)
    return rows.select("l_orderkey", *(F.round(out[common.index(n)], 6).alias(n) for n in to.names))


@query(f"WITH {_SPACE} SELECT l_orderkey, round(d, 6) AS old_discount, round(q + 1, 6) AS old_quantity, round(2 * t, 6) AS twice_tax FROM f")
def space_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spaces side by side, one renamed; a value added at one index."""
    space, rows = order_features(spark, sf_dir)
    left, right = space.renamed(lambda n: f"old_{n}"), L.Space(("twice_tax",))
    whole = left.stack(right)
    moved = L.accumulate(F.col("features"), left.index("old_quantity"), 1.0)
    stacked = F.concat(moved, F.array(F.col("features")[space.index("tax")] * 2))
    return rows.select("l_orderkey", *(F.round(stacked[whole.index(n)], 6).alias(n) for n in ("old_discount", "old_quantity", "twice_tax")))


@query(f"WITH {_SPACE} SELECT l_orderkey, round(0.5 * d + 2 * q - t, 6) AS score FROM f")
def model_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    space, rows = order_features(spark, sf_dir)
    path = fresh_path(spark, "model")
    L.save_model(L.Model(space, (0.5, 2.0, -1.0)), spark, path)
    model = L.load_model(spark, path)
    return rows.select("l_orderkey", F.round(L.dot(space.project(F.col("features"), model.space), model.weights), 6).alias("score"))


@query("SELECT CAST(n AS INTEGER) AS place, round(CASE WHEN n = 40 THEN 0 WHEN n % 2 = 0 THEN 0.0001 * power(2, n // 2 + 1) ELSE -0.0001 * power(2, n // 2 + 1) END, 9) AS step FROM range(41) t(n)")
def ascent_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of steps for one weight."""
    return spark.createDataFrame([(i, round(s, 9)) for i, s in enumerate(L.STEPS)], "place int, step double")


@query("WITH s AS (SELECT stddev_pop(l_tax) AS t, stddev_pop(l_quantity) AS q FROM lineitem), w AS (SELECT 0.6 / t AS t, 0.8 / q AS q FROM s) SELECT 'tax' AS name, round(t, 6) AS weight FROM w UNION ALL SELECT 'quantity', round(q, 6) FROM w")
def weights_denormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of length 1 for z-normalised features, as weights for the features themselves."""
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_tax", "l_quantity").alias("features"))
    deviation = A.mean_and_deviation(rows).first()["dev"]
    raw = L.denormalised(L.unit(np.array([3.0, 4.0])), deviation)
    return spark.createDataFrame([(n, round(float(w), 6)) for n, w in zip(("tax", "quantity"), raw, strict=True)], "name string, weight double")


_FOLD = "q AS (SELECT DISTINCT source AS query_id FROM documents), n AS (SELECT count(*) AS n FROM q), f AS (SELECT query_id, CAST((row_number() OVER (ORDER BY query_id) - 1) // (CASE WHEN n >= 10 THEN n // 5 + 1 ELSE n // 5 END) AS INTEGER) AS fold FROM q, n)"


@query(f"WITH {_FOLD} SELECT fold, count(*) AS held, (SELECT count(*) FROM documents) - count(*) AS rest FROM documents JOIN f ON source = query_id GROUP BY fold")
def folds_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's held-out rows and the rows that its model is trained on."""
    data = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id")
    at = L.fold_numbers(data, 5).collect()
    folds = [[r.query_id for r in at if r.fold == k] for k in range(max(r.fold for r in at) + 1)]
    made = L.k_folds(data, folds, lambda i, rows: rows.count())
    sizes = [held.agg(F.lit(k).alias("fold"), F.count(F.lit(1)).alias("held"), F.lit(n).cast("long").alias("rest")) for k, (held, n) in enumerate(made)]
    whole = sizes[0]
    for s in sizes[1:]:
        whole = whole.unionByName(s)
    return whole


@query("SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * 3 * i)), 4) AS weighted, round(CAST(embedding[1] AS DOUBLE) + embedding[2], 5) AS two FROM embeddings")
def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    places = F.transform(v, lambda _, i: (i + 1).cast("double"))
    weighted = F.aggregate(X.vector_zip(X.vector_scale(v, 3.0), places, "*"), F.lit(0.0), lambda s, x: s + x)
    two = X.vector_zip(F.slice(v, 1, 1), F.slice(v, 2, 1), "+")[0]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(weighted, 4).alias("weighted"), F.round(two, 5).alias("two"))


@query("SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS unit_norm FROM embeddings")
def vector_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.vector_norm(X.vector_unit(F.col("embedding").cast("array<double>"))), 6).alias("unit_norm"))


@query("WITH v AS (SELECT term, list(x ORDER BY i) AS vec FROM (SELECT term, i, length(term) * (i + 1) AS x FROM (VALUES ('the'), ('and'), ('th')) t(term), range(3) r(i)) GROUP BY term), c AS (SELECT item_id AS doc_id, len(regexp_extract_all(text, 'the')) AS a, len(regexp_extract_all(text, 'and')) AS b, len(regexp_extract_all(text, 'th')) - len(regexp_extract_all(text, 'the')) AS c FROM benchmark) SELECT doc_id, CAST(3 * a + 3 * b + 2 * c AS DOUBLE) AS x, CAST(2 * (3 * a + 3 * b + 2 * c) AS DOUBLE) AS y FROM c")
def text_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of vectors over the leftmost longest matches of a vocabulary in the characters."""
    words = spark.createDataFrame([(t, [float(len(t) * (i + 1)) for i in range(3)]) for t in ("the", "and", "th")], "term string, vec array<double>")
    made = V.embed_text(benchmark_documents(spark, sf_dir), words)
    return made.select("doc_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


# --- tokens with positions ------------------------------------------------------------

_WORDS = "a AS (SELECT item_id AS doc_id, regexp_extract_all(text, '\\S+') AS ts, string_split_regex(text, '\\S+') AS ss FROM benchmark), w AS (SELECT doc_id, unnest(range(len(ts))) AS i, unnest(ts) AS token, unnest(ss[1:len(ts)]) AS gap FROM a), p AS (SELECT doc_id, i, token, sum(length(gap)) OVER o + sum(length(token)) OVER o - length(token) AS b FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))"


@query(f'WITH {_WORDS} SELECT doc_id, CAST(i AS INTEGER) AS token_pos, token, CAST(b AS INTEGER) AS "begin", CAST(b + length(token) - 1 AS INTEGER) AS "end" FROM p')
def tokens_positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benchmark_documents(spark, sf_dir).select("doc_id", F.explode(X.tokens_with_positions(F.col("text"))).alias("t"))
    return rows.select("doc_id", "t.token_pos", "t.token", "t.char_pos.begin", "t.char_pos.end")


@query(f"WITH {_WORDS} SELECT doc_id, string_agg(regexp_replace(lower(replace(token, 'ß', 'ss')), '[^\\p{{L}}]', '', 'g'), ' ' ORDER BY i) AS terms FROM p WHERE length(regexp_replace(lower(replace(token, 'ß', 'ss')), '[^\\p{{L}}]', '', 'g')) > 2 GROUP BY doc_id")
def terms_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded letters of positioned tokens, short ones gone."""
    rows = benchmark_documents(spark, sf_dir).select("doc_id", X.streaming_terms(X.tokens_with_positions(F.col("text"))).alias("t"))
    return rows.select("doc_id", F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("terms"))


@query(f"WITH {_WORDS} SELECT doc_id, CAST(min(i) AS INTEGER) AS first, CAST(min(b) AS INTEGER) AS \"begin\", CAST(max(b + length(token) - 1) AS INTEGER) AS \"end\" FROM p WHERE i BETWEEN 2 AND 5 GROUP BY doc_id")
def spans_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benchmark_documents(spark, sf_dir).select("doc_id", F.slice(X.tokens_with_positions(F.col("text")), 3, 4).alias("t")).where(F.size("t") > 0)
    span = X.merge_positions(F.transform("t", lambda x: F.struct(x["token_pos"].alias("token_pos"), x["char_pos"].alias("char_pos"))))
    return rows.select("doc_id", span.alias("s")).select("doc_id", F.col("s.token_pos").alias("first"), "s.char_pos.begin", "s.char_pos.end")


@query("SELECT doc_id, regexp_replace(source || '-' || lang || '-' || doc_id, '^[^-]*-', '') AS name FROM documents")
def stream_time_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("-", "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_stream_time(name).alias("name"))


@query(f"WITH t AS (SELECT doc_id, unnest({TOK}) AS term FROM documents) SELECT doc_id, term, count(*) AS n FROM t WHERE term IN {TERMS} GROUP BY ALL")
def terms_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a progress observation beside them."""
    rows = S.observed(I.term_rows(table(spark, sf_dir, "documents")), "terms")
    return rows.where(F.col("term").isin(*TERMS)).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
