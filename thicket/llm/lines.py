"""Line dedup by site-relative frequency.

For every site (the host of web pages; any column for other documents) the share of its pages that hold a line is counted; a
line on more than ``RATIO`` of the site's pages, and on ``MIN_PAGES`` at
least, is boilerplate and goes from all of them. Pages of a site with the same
text count as one, so that copies of a page don't make its lines boilerplate.

Lines are compared without the white space at their ends and travel as two
64-bit hashes; blank lines always stay. The boilerplate lines of a site are
few (a page's mean number of lines divided by RATIO bounds them) and are
joined to the site's pages as one list; the texts move only where the sites
are too many to broadcast these lists.

Defined cases: a null text stays null and has no lines; null is a site of its
own; repeated rows count once and are all cleaned; an empty table gives an
empty result. Other columns pass through unchanged; names that start with
``_line_`` are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.scratch import materialize

RATIO, MIN_PAGES = 0.05, 3
#: Lists of boilerplate lines are broadcast up to so many lines in all (16 bytes each).
BROADCAST_LINES = 500_000
HOST = "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
UNSEEN = "(?is)<(?:script[^a-z].*?</script[^>]*>|style[^a-z].*?</style[^>]*>|!--.*?-->)"
BLOCK_TAG = "(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[^a-z0-9>][^>]*)?>"


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key(line: Column) -> Column:
    return F.xxhash64(bare(line))


def boilerplate(docs: DataFrame, site: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """_line_site, _line_keys: the hashes of each site's boilerplate lines."""
    pages = docs.where(F.col("text").isNotNull()).select(site.alias("_line_site"), F.xxhash64("text", F.octet_length("text")).alias("_line_page"), "text")
    total = pages.select("_line_site", "_line_page").distinct().groupBy("_line_site").agg(F.count(F.lit(1)).alias("_line_pages"))
    each = pages.select("_line_site", "_line_page", F.explode(F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: bare(x) != ""), key))).alias("_line_key"))
    # equal pages are one: the second aggregate counts pages, the first makes them distinct before they move
    counts = each.distinct().groupBy("_line_site", "_line_key").agg(F.count(F.lit(1)).alias("_line_n")).where(F.col("_line_n") >= min_pages)
    common = counts.withColumnRenamed("_line_site", "_line_at").join(total, F.col("_line_at").eqNullSafe(F.col("_line_site"))).where(F.col("_line_n") > F.lit(ratio) * F.col("_line_pages"))
    return common.groupBy("_line_site").agg(F.collect_list("_line_key").alias("_line_keys"))


def with_clean(docs: DataFrame, site: Column, **kw) -> DataFrame:
    """``docs`` with _line_all and _line_kept: arrays of its lines before and after."""
    common = materialize(boilerplate(docs, site, **kw), "boilerplate")
    held = common.agg(F.sum(F.size("_line_keys"))).first()[0] or 0
    if held <= BROADCAST_LINES:
        common = F.broadcast(common)
    joined = docs.join(common, site.eqNullSafe(F.col("_line_site")), "left")
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("_line_keys").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("_line_keys"), key(x)) | (bare(x) == "")))
    return joined.withColumn("_line_all", lines).withColumn("_line_kept", kept)


def drop_boilerplate(docs: DataFrame, site: str = "source", **kw) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``; every row and column stays.

    Where the documents have ``n_chars`` it follows the new text.
    """
    clean = F.array_join("_line_kept", "\n")
    made = with_clean(docs, F.col(site), **kw).withColumn("text", clean)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("text").isNull() | (F.size("_line_all") == F.size("_line_kept")), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return made.select(docs.columns)


def host(url: Column) -> Column:
    """The host of a URL, A-Z in lower case; empty where it has none, null for null."""
    return F.regexp_extract(F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), HOST, 1)


def page_text(html: Column) -> Column:
    """A page's visible text, a line for each run between block tags; other tags, scripts, styles and comments are gone."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, "\n"), BLOCK_TAG, "\n"), "<[^>]*>", "")


def drop_page_boilerplate(pages: DataFrame, **kw) -> DataFrame:
    """``pages`` (url, html and any other columns) with ``text``: the page's lines without its host's boilerplate."""
    if "text" in pages.columns:
        raise ValueError("the pages have a column named text already")
    texts = materialize(pages.withColumn("text", page_text(F.col("html"))), "page-texts")
    made = with_clean(texts, host(F.col("url")), **kw)
    return made.select(*pages.columns, F.array_join("_line_kept", "\n").alias("text"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_chars, kept_md5 of each row of ``pages``.

    A null html has no lines and an empty rest; pages without a url or without
    a host in it are the pages of one site each.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host(F.col("url")).alias("host"), page_text(F.col("html")).alias("text"))
    # the texts are needed three times and cost more to make than to read
    made = with_clean(materialize(pages, "page-texts"), F.col("host"))
    text = F.coalesce(F.array_join("_line_kept", "\n"), F.lit(""))
    n, kept = (F.coalesce(F.when(F.col("text").isNotNull(), F.size(c)), F.lit(0)) for c in ("_line_all", "_line_kept"))
    return made.select("page_id", "host", n.cast("long").alias("n_lines"), (n - kept).cast("long").alias("n_dropped"), F.length(text).cast("long").alias("kept_chars"), F.md5(text.cast("binary")).alias("kept_md5"))


OP4_SQL = rf"""
WITH docs AS (
  SELECT page_id, regexp_extract(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{HOST}', 1) AS host, row_number() OVER () AS rid,
    regexp_replace(regexp_replace(regexp_replace(html, '{UNSEEN}', chr(10), 'g'), '{BLOCK_TAG}', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages
), totals AS (
  SELECT host, count(DISTINCT text) AS pages FROM docs WHERE text IS NOT NULL GROUP BY host
), raw AS (
  SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM docs WHERE text IS NOT NULL
), lines AS (
  SELECT rid, host, text, line, n, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM raw
), common AS (
  SELECT l.host, l.bare FROM (SELECT host, bare, count(DISTINCT text) AS n FROM lines WHERE bare <> '' GROUP BY host, bare) l
  JOIN totals p ON l.host IS NOT DISTINCT FROM p.host WHERE l.n >= {MIN_PAGES} AND l.n > {RATIO}::DOUBLE * p.pages
), kept AS (
  SELECT l.rid, count(*) AS n_kept, string_agg(l.line, chr(10) ORDER BY l.n) AS text
  FROM lines l LEFT JOIN common c ON l.host IS NOT DISTINCT FROM c.host AND l.bare = c.bare WHERE c.bare IS NULL GROUP BY l.rid
), sizes AS (
  SELECT rid, count(*) AS n FROM lines GROUP BY rid
)
SELECT d.page_id, d.host, coalesce(s.n, 0) AS n_lines, coalesce(s.n, 0) - coalesce(k.n_kept, 0) AS n_dropped,
  length(coalesce(k.text, '')) AS kept_chars, md5(coalesce(k.text, '')) AS kept_md5
FROM docs d LEFT JOIN sizes s USING (rid) LEFT JOIN kept k USING (rid)
"""
