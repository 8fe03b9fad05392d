"""Mixing sources to target weights.

The words of each source are summed, the targets follow from the weights by
water-filling, and each document is emitted ``floor(rate)`` times plus one
hash-seeded Bernoulli copy with the rate's fraction as its probability.

All of it is DataFrame expressions. Whole texts are read once to be counted;
only (doc_id, source, size) goes on, and no shuffle carries text.

Defined cases: a null text counts 0 words and is taken at its source's rate;
sources are ordered by code point with null last and null is a source of its
own; a source of 0 words has target 0 and no copies; rows that repeat a doc_id
share its draw; an empty table gives an empty result. Names that start with
``_mix_`` are the operator's own; other extra columns pass through ``mix``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators.order import global_rank
from thicket.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Draws among which each source's is chosen; see ``rates``.
DRAWS = 16
#: The rates go to all executors up to so many sources (some 50 bytes each); above, by a shuffle.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, k: int, seed: int = 0) -> Column:
    """The document's k-th uniform draw in [0, 2**32)."""
    digest = F.md5(F.concat(F.lit(f"mix-{seed}-{k // 4}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1 + 8 * (k % 4), 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size, target: the weights in turn share ``share`` of all words.

    A target stops at ``most`` times its source's size and the excess is shared
    again by weight until none is above. Each round is one aggregate over the
    table of sources; the arithmetic is in whole numbers up to the last division.
    """
    num, den = share
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.lit(None).cast("long")
    for i, w in enumerate(weights):
        turn = F.when(F.col("_mix_at") % len(weights) == i, F.lit(w).cast("long")).otherwise(turn)
    ranked = materialize(global_rank(per, [F.col("source").asc_nulls_last()], "_mix_at").select("source", "source_size", turn.alias("_mix_w")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0

    def whole(x: Column | int) -> Column:
        return F.lit(Decimal(x)).cast("decimal(38,0)") if isinstance(x, int) else x.cast("decimal(38,0)")

    capped, cap, held = F.lit(False), F.col("source_size") * most, None
    while True:
        row = ranked.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("_mix_w"))), F.lit(0)), F.count(F.when(capped, 1))).first()
        above, free = num * total - den * row[0], den * row[1]
        if row[2] == held or not free:
            break
        held = row[2]
        capped = whole(F.col("_mix_w")) * whole(above) >= whole(cap) * whole(free)
    target = F.when(capped, cap.cast("double")).otherwise((F.col("_mix_w") * F.lit(above)).cast("double") / F.lit(float(max(free, 1))))
    return ranked.select("source", "source_size", target.alias("target"))


def attach(df: DataFrame, small: DataFrame, n_small: int) -> DataFrame:
    """``df`` with the row of its source; a broadcast only where the sources have been counted."""
    small = small.withColumnRenamed("source", "_mix_source")
    if n_small <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    return df.join(small, df["source"].eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")


def rates(sizes: DataFrame, seed: int = 0, **kw) -> tuple[DataFrame, int]:
    """source, source_size, target, _mix_whole, _mix_part, _mix_draw; and the number of sources.

    _mix_part is the extra copy's probability in 2**32nds. Of DRAWS fixed draws
    a source uses the one whose taken words come nearest to its target (the
    first of equals): still one seeded coin a document, but a few long
    documents can't carry a small source far from its target.
    """
    per = targets(sizes, **kw)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("_mix_whole", F.floor(rate).cast("long")).withColumn("_mix_part", F.floor((rate - F.floor(rate)) * F.lit(float(2**32))).cast("long"))
    per = materialize(per, "rates")
    n = per.count()
    tried = attach(sizes, per, n).groupBy("source").agg(*(F.sum(F.when(draw(F.col("doc_id"), k, seed) < F.col("_mix_part"), F.col("size")).otherwise(0)).alias(f"_mix_{k}") for k in range(DRAWS)))
    off = F.array(*(F.struct(F.abs(F.col("source_size") * F.col("_mix_whole") + F.col(f"_mix_{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)))
    tried = tried.withColumnRenamed("source", "_mix_source")
    chosen = per.join(tried, F.col("source").eqNullSafe(F.col("_mix_source"))).select(*per.columns, F.array_min(off)["k"].alias("_mix_draw"))
    return materialize(chosen, "draws"), n


def copies(seed: int = 0) -> Column:
    """How often a document with its source's rates attached is taken."""
    hit = F.lit(False)
    for k in range(DRAWS):
        hit = F.when(F.col("_mix_draw") == k, draw(F.col("doc_id"), k, seed) < F.col("_mix_part")).otherwise(hit)
    return F.col("_mix_whole") + F.when(hit, 1).otherwise(0)


def mix(docs: DataFrame, seed: int = 0, **kw) -> DataFrame:
    """``docs`` (doc_id, text, source and any other columns), each row as often as the mix takes it."""
    sizes = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    per, n = rates(sizes, seed, **kw)
    taken = attach(docs, per.select("source", "_mix_whole", "_mix_part", "_mix_draw"), n).withColumn("_mix_copies", copies(seed))
    return taken.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*(docs[c] for c in docs.columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document of ``documents``: doc_id, size, source_size, target, taken, copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    per, n = rates(sizes)
    return attach(sizes, per, n).withColumn("copies", copies()).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP1_SQL = rf"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sizes GROUP BY source
), w AS (
  SELECT source, pos, source_size, 2 * source_size AS cap, CASE pos % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM per
), ordered AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) - cap AS capped, sum(w) OVER () - sum(w) OVER o + w AS free, sum(source_size) OVER () AS total
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, pos ROWS UNBOUNDED PRECEDING)
), fill AS (  -- the first source in this order that stays under its cap sets the level
  SELECT CAST(3 * total - 2 * capped AS HUGEINT) AS above, CAST(2 * free AS HUGEINT) AS free FROM ordered
  WHERE CAST(w AS HUGEINT) * CAST(3 * total - 2 * capped AS HUGEINT) < CAST(cap AS HUGEINT) * CAST(2 * free AS HUGEINT)
  ORDER BY CAST(cap AS DOUBLE) / w, pos LIMIT 1
), t AS (
  SELECT w.source, w.source_size, CASE WHEN f.above IS NULL OR w.w * f.above >= w.cap * f.free THEN CAST(w.cap AS DOUBLE) ELSE CAST(w.w * f.above AS DOUBLE) / CAST(f.free AS DOUBLE) END AS target
  FROM w LEFT JOIN fill f ON true
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
), p AS (
  SELECT source, source_size, target, CAST(floor(rate) AS BIGINT) AS whole, CAST(floor((rate - floor(rate)) * 4294967296.0) AS BIGINT) AS part FROM r
), coins AS (
  SELECT s.doc_id, s.source, s.size, k, CAST('0x' || substr(md5('mix-0-' || CAST(k // 4 AS VARCHAR) || ':' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), CAST(1 + 8 * (k % 4) AS INTEGER), 8) AS BIGINT) AS u
  FROM sizes s, range(0, 16) g(k)
), tried AS (
  SELECT c.source, c.k, abs(max(p.source_size) * max(p.whole) + sum(CASE WHEN c.u < p.part THEN c.size ELSE 0 END) - max(p.target)) AS off
  FROM coins c JOIN p ON c.source IS NOT DISTINCT FROM p.source GROUP BY c.source, c.k
), best AS (
  SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, k) AS n FROM tried) WHERE n = 1
)
SELECT c.doc_id, c.size, p.source_size, p.target,
  c.size * (p.whole + CASE WHEN c.u < p.part THEN 1 ELSE 0 END) AS taken, p.whole + CASE WHEN c.u < p.part THEN 1 ELSE 0 END AS copies
FROM coins c JOIN best b ON c.source IS NOT DISTINCT FROM b.source AND c.k = b.k JOIN p ON c.source IS NOT DISTINCT FROM p.source
"""
