"""Licence scan: ordered signature rules with a keyword prefilter.

One gate regex over the raw text leaves the few documents that can have a
detection. These are normalised (``license_rules``), each rule whose keyword
occurs is matched, and of the detections those go that lie inside one of
higher priority, or inside a longer one of the same. All of it is DataFrame
expressions over one row: no shuffle, no join, no Python.

Defined cases: a null or empty text has no words, no places and no labels;
equal places of equal rules count once in the labels; very long texts are
scanned whole; an empty table gives an empty result; other columns than doc_id
and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.license_rules import GATE, rules

RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"apache license": "apache", "general public license": "gpl", "mit license": "mit"}
_ANY_BASE = "(?:" + "|".join(BASE) + ")"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal(text: Column) -> Column:
    """Lower case, words divided by single blanks, a blank at either end."""
    lower = F.translate(text, _UPPER, _UPPER.lower())
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, BETWEEN, " ")), F.lit(" "))


def rule_table() -> Column:
    return F.array(*(F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(keyword).alias("keyword"), F.lit(regex).alias("regex")) for label, priority, keyword, regex in rules()))


def places(norm: Column, rule: Column) -> Column:
    """label, priority, start, end of the rule's matches."""
    matched = F.regexp_extract_all(norm, rule["regex"], F.lit(0))
    pieces = F.split(norm, rule["regex"], -1)
    sizes = F.filter(F.zip_with(pieces, matched, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m"))), lambda x: x["m"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    walked = F.aggregate(
        sizes,
        zero,
        lambda acc, x: F.struct((acc["at"] + x["p"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["p"]).alias("start"), (acc["at"] + x["p"] + x["m"]).alias("end")))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.transform(walked, lambda x: F.struct(rule["label"].alias("label"), rule["priority"].alias("priority"), x["start"].alias("start"), x["end"].alias("end")))


def detections(norm: Column) -> Column:
    applies = F.filter(rule_table(), lambda r: F.contains(norm, r["keyword"]))
    return F.flatten(F.transform(applies, lambda r: places(norm, r)))


def unsuppressed(found: Column) -> Column:
    def hides(g: Column, h: Column) -> Column:
        inside = (g["start"] <= h["start"]) & (g["end"] >= h["end"])
        longer = g["end"] - g["start"] > h["end"] - h["start"]
        return inside & ((g["priority"] > h["priority"]) | ((g["priority"] == h["priority"]) & longer))

    return F.filter(found, lambda h: ~F.exists(found, lambda g: hides(g, h)))


def blanks(prefix: Column) -> Column:
    return F.length(prefix) - F.length(F.replace(prefix, F.lit(" "), F.lit("")))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"), F.when(text.rlike(GATE), normal(text)).alias("norm"))
    norm = F.col("norm")
    base = rf"(?<= ){_ANY_BASE}(?= )"
    # what stands before the first place: not regexp_instr, which counts UTF-16 units where substring counts code points
    ahead = F.split(norm, base, 2)[0]
    before = F.regexp_extract(norm, rf"(?s)^(.* ){_ANY_BASE} .*$", 1)
    rows = rows.withColumn("n_base", F.coalesce(F.regexp_count(norm, F.lit(base)), F.lit(0)).cast("long"))
    hit = F.col("n_base") > 0
    rows = rows.withColumns({
        "first_word": F.when(hit, blanks(ahead) - 1).cast("long"),
        "last_word": F.when(hit, blanks(before) - 1).cast("long"),
        "_base": F.array_compact(F.array(*(F.when(F.contains(norm, F.lit(f" {phrase} ")), F.lit(label)) for phrase, label in BASE.items()))),
        "_found": F.when(norm.isNotNull(), detections(norm)).otherwise(F.array().cast("array<struct<label:string,priority:int,start:int,end:int>>")),
    })
    rows = rows.withColumn("detections", unsuppressed(F.col("_found")))
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda x: x["label"]))))
    # a tag or address names its licence for certain, a mere sign of terms hardly
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda x: x["priority"])), F.lit(0)) / 4.0, F.when(hit, 0.5).otherwise(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "detections")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of ``documents``.

    Words are counted from 0 in whole texts, whatever planes their characters
    are of. A null or empty text has no words and no labels and score 0; equal
    rows give equal rows.
    """
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
