"""Files in any of gzip (of several members too), bzip2 and xz, told apart by their first bytes.

Spark reads ``.gz`` and ``.bz2`` by itself; these readers add xz and names that
tell nothing. A file is decompressed by one task as a stream.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: First bytes of each format; fixed values.
MAGIC = {"gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00"}
SUFFIX = {".gz": "gzip", ".bz2": "bzip2", ".xz": "xz"}


def detect(content: bytes) -> str | None:
    return next((k for k, m in MAGIC.items() if content.startswith(m)), None)


def guess(path: str) -> str | None:
    """By the name alone."""
    return next((k for s, k in SUFFIX.items() if path.lower().endswith(s)), None)


def opened(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    kind = detect(content)
    return {"gzip": lambda: gzip.GzipFile(fileobj=raw), "bzip2": lambda: bz2.BZ2File(raw), "xz": lambda: lzma.LZMAFile(raw)}.get(kind, lambda: raw)()


def decompress(content: bytes) -> bytes:
    return opened(content).read()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content: whole files, decompressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pydict({"path": pa.array([name.as_py()]), "content": pa.array([decompress(content.as_py())], pa.binary())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, content binary")


def read_lines(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """path, line, value: the lines of decompressed files, bad UTF-8 read as ISO-8859-1."""

    def text(line: bytes) -> str:
        try:
            return line.decode()
        except UnicodeDecodeError:
            return line.decode("iso-8859-1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[str] = []
                at = 0
                for line in opened(content.as_buffer().to_pybytes()):
                    held.append(text(line.rstrip(b"\r\n")))
                    if len(held) == rows:
                        yield pa.RecordBatch.from_pydict({"path": pa.array([name] * rows), "line": pa.array(range(at, at + rows), pa.int64()), "value": pa.array(held)})
                        at, held = at + rows, []
                if held:
                    yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(held)), "line": pa.array(range(at, at + len(held)), pa.int64()), "value": pa.array(held)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, line long, value string")
