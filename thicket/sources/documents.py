"""Document sources by the name of their format: archive, doc_name, text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.text import looks_like_html
from thicket.sources import archives, formats, html


def _robust_html(spark: SparkSession, path: str) -> DataFrame:
    """Robust documents; bodies that look like HTML are cleaned."""
    docs = formats.read_robust(spark, path)
    return docs.withColumn("text", F.when(looks_like_html(F.col("text")), html.cleaned(F.col("text"))["body"]).otherwise(F.col("text")))


FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "test": formats.read_test_documents,
    "robust": formats.read_robust,
    "robust-html": _robust_html,
    "kba": lambda spark, path: archives.visible_documents(archives.read_stream_items(spark, path)),
    "warc": archives.read_warc_responses,
}


def read_documents(spark: SparkSession, kind: str, path: str) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known are {sorted(FORMATS)}")
    return FORMATS[kind](spark, path).select("archive", "doc_name", "text")


def extract(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose (archive, doc_name) is wanted."""
    return docs.join(wanted.select("archive", "doc_name").distinct(), ["archive", "doc_name"], "left_semi")
