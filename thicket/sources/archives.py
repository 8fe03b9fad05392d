"""Binary archives: WARC responses, structured documents for other engines as WARC, and thrift stream items.

Archives are read whole by Spark's binary reader, one task a file, decompressed
as streams and parsed record by record.
"""

from __future__ import annotations

import codecs
import io
import struct
from collections.abc import Iterator
from email.message import Message

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.sources.compressed import opened

# --- WARC -----------------------------------------------------------------------


def warc_records(source: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and content of each record; ValueError where one is cut short."""
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        fields: dict[str, str] = {}
        while (line := source.readline()) and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields.get("content-length", "0"))
        content = source.read(n)
        if len(content) < n:
            raise ValueError(f"{len(content)} of {n} bytes of a record")
        yield fields, content


def media_type(value: str) -> tuple[str, dict[str, str]]:
    m = Message()
    m["content-type"] = value
    return m.get_content_type(), {k.lower(): v for k, v in (m.get_params() or [])[1:]}


def response_text(fields: dict[str, str], content: bytes) -> tuple[str, str] | None:
    """Record id and decoded body of an HTTP response with a known charset; None of any other record."""
    kind, parameters = media_type(fields.get("content-type", ""))
    if kind != "application/http" or parameters.get("msgtype", "").lower() != "response" or "warc-record-id" not in fields:
        return None
    head, sep, body = content.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return None
    headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("iso-8859-1").split("\r\n")[1:]))
    if "charset" not in (found := media_type(headers.get("content-type", ""))[1]):
        return None
    try:
        codec = codecs.lookup(found["charset"])
    except LookupError:
        return None
    return fields["warc-record-id"].strip("<>"), codec.decode(body, "replace")[0]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def _rows(out: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(names), kinds, strict=True)], names)


def read_warc_responses(spark: SparkSession, path: str, batch_rows: int = 256) -> DataFrame:
    """archive, doc_name, text of the archives' responses."""
    names, kinds = ["archive", "doc_name", "text"], [pa.string()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out: list[tuple] = []
                for fields, body in warc_records(opened(content.as_buffer().to_pybytes())):
                    if (found := response_text(fields, body)) is not None:
                        out.append((archive, *found))
                    if len(out) == batch_rows:
                        yield _rows(out, names, kinds)
                        out = []
                if out:
                    yield _rows(out, names, kinds)

    return _files(spark, path).mapInArrow(run, "archive string, doc_name string, text string")


def structured_record(doc_id: str, fields: dict[str, list[tuple[str, bool]]], metadata: dict[str, str]) -> bytes:
    """A WARC record of fields as XML elements; characters from U+00FF on go, untokenised fields say so."""
    parts = ["<text>\n"]
    for name in sorted(fields):
        for text, tokenised in fields[name]:
            kept = "".join(c for c in text if ord(c) < 255)
            parts.append(f"<{name}{'' if tokenised else ' tokenizeTagContent=false'}>{kept}</{name}>\n")
    parts.append("</text>\n")
    body = "".join(parts).encode()
    head = [("WARC-TREC-ID", doc_id), ("Content-Length", str(len(body))), *sorted(metadata.items())]
    return b"WARC/0.16\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def write_structured(docs: DataFrame, path: str) -> None:
    """``docs`` (doc_id, fields: map to arrays of (text, tokenised), metadata: map) as gzip WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            rows = batch.to_pylist()
            out = [b"WARC/0.16\r\nContent-Length: 0\r\n\r\n\r\n\r\n"] if first else []
            first = False
            for r in rows:
                fields = {k: [(v["text"], bool(v["tokenised"])) for v in vs or []] for k, vs in r["fields"] or []}
                out.append(structured_record(r["doc_id"], fields, dict(r["metadata"] or [])))
            # the writer's line separator is each record's last CR LF
            yield pa.RecordBatch.from_pydict({"record": pa.array([x[:-2] for x in out], pa.binary())})

    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "fields", "metadata").mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


# --- thrift stream items ------------------------------------------------------------

_NUMBER = {2: ">b", 3: ">b", 4: ">d", 6: ">h", 8: ">i", 10: ">q"}


class Thrift:
    """Thrift's binary protocol, without a schema: structs are dicts by field number."""

    def __init__(self, source: io.BufferedIOBase):
        self.source = source

    def take(self, n: int) -> bytes:
        data = self.source.read(n)
        if len(data) < n:
            raise ValueError("a thrift value is cut short")
        return data

    def unpack(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def value(self, kind: int):
        if kind in _NUMBER:
            return self.unpack(_NUMBER[kind])
        if kind == 11:
            return self.take(self.unpack(">i"))
        if kind == 12:
            return self.struct(self.take(1)[0])
        if kind in (14, 15):
            of, n = self.take(1)[0], self.unpack(">i")
            return [self.value(of) for _ in range(n)]
        if kind == 13:
            k, v, n = self.take(1)[0], self.take(1)[0], self.unpack(">i")
            return [(self.value(k), self.value(v)) for _ in range(n)]
        raise ValueError(f"thrift type {kind}")

    def struct(self, kind: int) -> dict:
        out = {}
        while kind:
            number = self.unpack(">h")
            out[number] = self.value(kind)
            kind = self.take(1)[0]
        return out


def thrift_items(source: io.BufferedIOBase) -> Iterator[dict]:
    while kind := source.read(1):
        yield Thrift(source).struct(kind[0])


def _text(x: bytes | None) -> str | None:
    return None if x is None else x.decode("utf-8", "replace")


def _content(item: dict | None) -> dict | None:
    return None if item is None else {"encoding": _text(item.get(2)), "media_type": _text(item.get(3)), "clean_html": _text(item.get(4)), "clean_visible": _text(item.get(5))}


ITEM = "struct<encoding:string,media_type:string,clean_html:string,clean_visible:string>"
#: Field numbers of a stream item; fixed values: 1 version, 2 document, 3 url, 6 source, 7 body, 9 stream id, 10 time, 11 other content.


def read_stream_items(spark: SparkSession, path: str, batch_rows: int = 256) -> DataFrame:
    """archive, version, doc_name, url, source, stream_id, stream_time, body, other of thrift files in any compression."""
    item = pa.struct([(n, pa.string()) for n in ("encoding", "media_type", "clean_html", "clean_visible")])
    names = ["archive", "version", "doc_name", "url", "source", "stream_id", "seconds", "body", "other"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), item, pa.map_(pa.string(), item)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out: list[tuple] = []
                for x in thrift_items(opened(content.as_buffer().to_pybytes())):
                    other = [(_text(k), _content(v)) for k, v in x.get(11) or []]
                    out.append((archive, x[1], _text(x[2]), _text(x.get(3)), _text(x.get(6)), _text(x[9]), float(x[10][1]), _content(x.get(7)), other))
                    if len(out) == batch_rows:
                        yield _rows(out, names, kinds)
                        out = []
                if out:
                    yield _rows(out, names, kinds)

    schema = f"archive string, version int, doc_name string, url string, source string, stream_id string, seconds double, body {ITEM}, other map<string,{ITEM}>"
    made = _files(spark, path).mapInArrow(run, schema)
    return made.withColumn("stream_time", F.timestamp_seconds("seconds")).drop("seconds")


def visible_documents(items: DataFrame) -> DataFrame:
    """archive, doc_name, text, stream_time of the items with a body whose visible text is known."""
    return items.where(F.col("body.clean_visible").isNotNull()).select("archive", "doc_name", F.col("body.clean_visible").alias("text"), "stream_time")
