"""Legacy web archives (ARC) converted to WARC.

An ARC file starts with a version block that names the version and the fields
of the header lines to come: version 1 has five, version 2 ten. Each record is
one header line, as many bytes as the line's last field declares, and a line
end. The converter reads archives of many such records and synthesises what
WARC asks for: record identifiers, W3C dates, types, and payload digests. A
record's identifier is made from the archive's path and the record's place in
it, so it is unique, and a revisit names its response's own.

Both kinds of archive are gzip files with one member a record, as their
readers expect. An archive is one row of up to ``ARCHIVE_BYTES`` (or one longer
record) and is written by Spark's text writer as one file, so it reaches any
store that Spark writes. That writer ends each file with a separator; it is
set to the byte zero, which is also the last of a gzip member (``closed``).
Archives are read back with Spark's binary file reader, parsed by their
declared lengths, and each revisit's page is found through the identifier.

Defined cases: a null html is an empty payload; a null url is ``about:blank``;
white space in a url is percent-encoded, as header fields can't hold it; a
null page_id is carried as absent and is never the page that others revisit;
rows that repeat the largest page_id of a payload are all responses, each with
an identifier of its own; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.texts import map_batches
from thicket.scratch import delete_path, fresh_path, materialize

LEAST_REVISIT = 1000
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Payloads with equal digests are broadcast up to so many (some 200 bytes each).
BROADCAST_GROUPS = 200_000
#: Bytes of records in an archive, and of rows that are handed on at once.
ARCHIVE_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
#: gzip's level: members are short, and the higher levels take three times as long for a tenth less.
LEVEL = 1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The HTTP body, or the whole block where it is no HTTP response."""
        if not self.block.startswith(b"HTTP/"):
            return self.block
        head, sep, body = self.block.partition(b"\r\n\r\n")
        return body if sep else self.block.partition(b"\n\n")[2]


def arc_version_block(version: int, origin: str = "converter", name: str = "archive.arc", date: str = "20240101000000") -> bytes:
    content = f"{version} 0 {origin}\n{' '.join(ARC_FIELDS[version])}\n".encode()
    tail = f"text/plain {len(content)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(content)}"
    return f"filedesc://{name} 0.0.0.0 {date} {tail}\n".encode() + content + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, content_type: str, block: bytes, code: str = "200", offset: int = 0, name: str = "archive.arc") -> bytes:
    middle = f"{content_type} " if version == 1 else f"{content_type} {code} - - {offset} {name} "
    return f"{url} {ip} {date} {middle}{len(block)}\n".encode() + block + b"\n"


def read_arc(source: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """Records after the version block; ValueError where a header doesn't parse or bytes lack."""
    names: tuple[str, ...] | None = None
    while line := source.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if names is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an ARC file starts with a version block")
            block = exactly(source, declared(parts[-1]))
            first, _, second = block.partition(b"\n")
            version = declared(first.split(b" ")[0].decode())
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            names = tuple(second.decode().split("\n")[0].split()) or ARC_FIELDS[version]
            continue
        if len(parts) != len(names):
            raise ValueError(f"{len(parts)} fields in a header line of {len(names)}")
        fields = dict(zip(names, parts, strict=True))
        yield ArcRecord(fields, exactly(source, declared(fields["Archive-length"])))


def declared(text: str) -> int:
    if not re.fullmatch(r"[0-9]+", text):
        raise ValueError(f"no length: {text[:40]}")
    return int(text)


def exactly(source: io.BufferedIOBase, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise ValueError(f"{len(data)} of {n} declared bytes")
    return data


def w3c_date(arc_date: str) -> str:
    """ARC dates have 14 digits, older ones fewer; what lacks is the earliest."""
    d = (arc_date + "00000101000000"[len(arc_date):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*what: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(what))}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def to_warc(arc: ArcRecord, own_id: str, refers_to: str | None = None) -> bytes:
    """The equivalent WARC record: a response (a resource where it isn't HTTP), or a revisit of the record ``refers_to``."""
    f, http = arc.fields, arc.block.startswith(b"HTTP/")
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response" if http else "resource"),
        ("WARC-Record-ID", own_id),
        ("WARC-Date", w3c_date(f["Archive-date"])),
        ("WARC-Target-URI", f["URL"]),
        ("WARC-IP-Address", f["IP-address"]),
        ("Content-Type", "application/http; msgtype=response" if http else f["Content-type"]),
        ("WARC-Payload-Digest", base32_sha1(arc.payload)),
    ]
    block = arc.block
    if refers_to:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)]
        block = arc.block[: len(arc.block) - len(arc.payload)]
    fields.append(("WARC-Block-Digest", base32_sha1(block)))
    return warc_record(fields, block)


def warcinfo(name: str = "archive.warc.gz") -> bytes:
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return warc_record(fields, b"format: WARC File Format 1.1\r\nsoftware: thicket\r\n")


def read_warc(source: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by the declared lengths."""
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := source.readline()) and line.strip():
            k, _, v = line.decode("utf-8", "surrogateescape").rstrip("\r\n").partition(":")
            fields[k] = v.strip(" ")
        yield fields, exactly(source, declared(fields["Content-Length"]))


def opened(content: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def http_block(body: bytes, page_id: int | None = None) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(body) + body


def http_number(block: bytes, name: bytes) -> int | None:
    """A header of the HTTP response as a number; None where there is no such header."""
    found = re.search(rb"\r\n" + name + rb": ([0-9]+|-[0-9]+)\r\n", block.partition(b"\r\n\r\n")[0] + b"\r\n")
    return int(found[1]) if found else None


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")


def member(record: bytes, level: int = LEVEL) -> bytes:
    return gzip.compress(record, level, mtime=0)


def closed(archive: bytes) -> bytes:
    """``archive`` but for its last byte, which is zero: the writer's separator puts it back.

    A member ends with its content's length; the byte is the length's highest,
    which is zero below 16 MB. After a longer member an empty one is added.
    """
    return (archive if archive[-1] == 0 else archive + member(b""))[:-1]


def archives(records: Iterator[bytes], head: Callable[[int], bytes], level: int = LEVEL) -> Iterator[pa.RecordBatch]:
    """One row an archive: its ``head`` and records, a gzip member each."""
    n, size, held = 0, 0, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"archive": pa.array([closed(member(head(n), level) + b"".join(held))], pa.binary())})

    for record in records:
        held.append(member(record, level))
        size += len(record)
        if size >= ARCHIVE_BYTES:
            yield out()
            n, size, held = n + 1, 0, []
    if held:
        yield out()


def save(made: DataFrame, path: str) -> None:
    made.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    """``pages`` (page_id, url, html) as ARC archives below ``path``, of either version."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version = 1 + task % 2

        def records() -> Iterator[bytes]:
            for batch in batches:
                for i, url, body in zip(*batch.columns, strict=True):
                    yield arc_record(version, clean_url(url.as_py()), "0.0.0.0", "20240101000000", "text/html", http_block(body.as_py(), i.as_py()))

        yield from archives(records(), lambda n: arc_version_block(version, name=f"pages-{task}-{n}.arc.gz"))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    save(rows.mapInArrow(run, "archive binary"), path)


ARC_ROW = ("URL", "IP-address", "Archive-date", "Content-type")


def arc_records(spark: SparkSession, path: str, blocks: bool) -> DataFrame:
    """own_id, page_id, size, digest (of the payload) of each record of the ARC archives; with ``blocks`` also its fields and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                rows, held = [], 0
                for n, arc in enumerate(read_arc(opened(content.as_buffer()))):
                    payload = arc.payload
                    row = (record_id(name.as_py(), n), http_number(arc.block, b"X-Page-Id"), len(payload), hashlib.sha1(payload).hexdigest())
                    rows.append((*row, *(arc.fields[c] for c in ARC_ROW), arc.block) if blocks else row)
                    held += len(arc.block)
                    if held >= BATCH_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    names = ["own_id", "page_id", "size", "digest"] + (["url", "ip", "date", "kind", "block"] if blocks else [])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * 4 + [pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "own_id string, page_id long, size long, digest string" + (", url string, ip string, date string, kind string, block binary" if blocks else ""))


def attached(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``few``, which are broadcast up to a number that is counted first."""
    few = materialize(few, f"by-{key.replace('_', '-')}")
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_GROUPS else few, key, "left")


def convert(spark: SparkSession, arc_path: str, path: str) -> None:
    """The ARC archives below ``arc_path`` as WARC archives below ``path``; payloads that occur again become revisits.

    Of equal payloads of ``LEAST_REVISIT`` bytes that with the largest page_id stays.
    """
    last = F.struct("page_id", "own_id")
    groups = arc_records(spark, arc_path, blocks=False).where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max(last).alias("kept"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 and kept.page_id is not null").select("digest", F.col("kept.page_id").alias("kept_page"), F.col("kept.own_id").alias("kept_id"))
    rows = attached(arc_records(spark, arc_path, blocks=True), groups, "digest")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("kept_page")), F.col("kept_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def records() -> Iterator[bytes]:
            for batch in batches:
                for own, *fields, block, target in zip(*batch.columns, strict=True):
                    arc = ArcRecord(dict(zip(ARC_ROW, (f.as_py() for f in fields), strict=True)), block.as_py())
                    yield to_warc(arc, own.as_py(), target.as_py())

        yield from archives(records(), lambda n: warcinfo(f"{path}/{task}-{n}.warc.gz"))

    save(rows.select("own_id", "url", "ip", "date", "kind", "block", refers.alias("target")).mapInArrow(run, "archive binary"), path)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """own_id, page_id, payload_bytes, payload_digest, record_type, target of the archives' responses and revisits; digests are checked."""

    def f(batch: pa.RecordBatch) -> dict:
        out: list[list] = [[] for _ in range(6)]
        for content in batch.column(0):
            for fields, block in read_warc(opened(content.as_buffer())):
                if fields["WARC-Type"] not in ("response", "revisit"):
                    continue
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                size = http_number(block, b"Content-Length")
                if fields["WARC-Type"] == "response":
                    payload = ArcRecord({}, block).payload
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its header says")
                row = (fields["WARC-Record-ID"], http_number(block, b"X-Page-Id"), size, digest, fields["WARC-Type"], fields.get("WARC-Refers-To"))
                for o, x in zip(out, row, strict=True):
                    o.append(x)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return {n: pa.array(o, k) for n, o, k in zip(("own_id", "page_id", "payload_bytes", "payload_digest", "record_type", "target"), out, kinds, strict=True)}

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_batches(files, f, "own_id string, page_id long, payload_bytes long, payload_digest string, record_type string, target string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the page of the record that WARC-Refers-To names)."""
    rows = materialize(warc_records(spark, path), "warc-records")
    # the targets are one row a group of copies, so a large group doesn't meet in one task here
    wanted = rows.where("target is not null").select(F.col("target").alias("own_id")).distinct()
    targets = rows.join(wanted, "own_id", "left_semi").select(F.col("own_id").alias("target"), F.col("page_id").alias("refers_to"))
    return attached(rows.drop("own_id"), targets, "target").drop("target")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of ``pages``.

    The pages are written as ARC archives, these are converted to WARC
    archives, and the result is what the WARC archives say.
    """
    arc, path = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    convert(spark, arc, path)
    delete_path(spark, arc)
    return read_archives(spark, path)


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT digest, max(page_id) AS kept, count(*) AS c FROM p WHERE n >= 1000 GROUP BY digest
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN g.c > 1 AND p.page_id IS DISTINCT FROM g.kept AND g.kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.c > 1 AND p.page_id IS DISTINCT FROM g.kept THEN g.kept END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest
"""
