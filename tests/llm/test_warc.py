"""ARC to WARC: exact round trips and the contract's dedup."""

import gzip
import hashlib
import io
import zlib

import pytest

from thicket.llm import warc
from thicket.scratch import fresh_path


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_and_lengths(version):
    bodies = [b"", b"x\n\nfiledesc://trap 0 0 text/plain 3\n", b"\r\n\r\nWARC/1.1\r\n", bytes(range(256))]
    data = warc.arc_version_block(version)
    for i, b in enumerate(bodies):
        data += warc.arc_record(version, f"http://a/{i}", "1.2.3.4", "20010203040506", "text/html", warc.http_block(b))
    got = list(warc.read_arc(io.BytesIO(data)))
    assert [r.payload for r in got] == bodies
    assert tuple(got[0].fields) == warc.ARC_FIELDS[version]
    packed = b"".join(gzip.compress(warc.to_warc(r, warc.record_id(version, i))) for i, r in enumerate(got))
    back = list(warc.read_warc(warc.opened(packed)))
    assert [warc.ArcRecord({}, b).payload for _, b in back] == bodies
    assert back[0][0]["WARC-Date"] == "2001-02-03T04:05:06Z" and len({f["WARC-Record-ID"] for f, _ in back}) == 4
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data.replace(b"text/html", b"text html", 1))))


def test_short_dates_and_resources():
    assert warc.w3c_date("1999") == "1999-01-01T00:00:00Z"
    arc = warc.ArcRecord({"URL": "dns:x", "IP-address": "0", "Archive-date": "19990102", "Content-type": "text/dns"}, b"raw")
    assert b"WARC-Type: resource" in warc.to_warc(arc, "<urn:x>") and arc.payload == b"raw"


def test_pages_round_trip(spark):
    big, other, edge = "é" * 600 + "\r\n\r\nWARC/1.1\r\n", "b" * 1000, "c" * 999
    rows = [(1, "http://a b\n", big), (5, None, big), (3, "u", big), (7, "u", other), (8, "u", other), (8, "u", other), (9, "u", edge), (10, "u", edge), (11, "u", None), (12, "u", ""), (None, "u", big), (None, "u", "d" * 2000), (None, "u", "d" * 2000)]
    pages = spark.createDataFrame([(*r, "kept?") for r in rows], "page_id long, url string, html string, kept string")
    arc, path = fresh_path(spark, "arc-test"), fresh_path(spark, "warc-test")
    warc.write_arc(pages.repartition(3), arc)
    warc.convert(spark, arc, path)
    got = sorted((tuple(r) for r in warc.read_archives(spark, path).collect()), key=repr)
    top = {big: 5, other: 8}

    def expect(i, html):
        data = (html or "").encode()
        ref = top.get(html)
        ref = ref if ref != i else None
        return (i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if ref else "response", ref)

    assert got == sorted((expect(i, h) for i, _, h in rows), key=repr)


def test_records_can_be_found_by_their_ids(spark):
    """Each id is one record's, each WARC-Refers-To is the id of a response with the same digest; one gzip member a record."""
    rows = [(i, "u", "p" * 1500) for i in range(20)] + [(19, "u", "p" * 1500), (30, "u", "q" * 1200), (31, "u", "q" * 1200), (32, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    arc, path = fresh_path(spark, "arc-ids"), fresh_path(spark, "warc-ids")
    warc.write_arc(pages.coalesce(2), arc)
    warc.convert(spark, arc, path)
    records, members = [], 0
    for (content,) in spark.read.format("binaryFile").load(path).select("content").collect():
        records += list(warc.read_warc(warc.opened(content)))
        rest = bytes(content)
        while rest:
            one = zlib.decompressobj(31)
            one.decompress(rest)
            rest, members = one.unused_data, members + 1
    assert members == len(records)
    by_id = {f["WARC-Record-ID"]: f for f, _ in records}
    assert len(by_id) == len(records)
    revisits = [f for f, _ in records if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 20
    for f in revisits:
        target = by_id[f["WARC-Refers-To"]]
        assert target["WARC-Type"] == "response" and target["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]


def test_long_records_and_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    rows = list(warc.archives(iter([b"x" * (17 << 20), b"y" * 1000, b"z" * 1000, b"w" * 2000]), lambda n: b"head", 1))
    assert len(rows) == 2
    whole = [gzip.decompress(r.column(0)[0].as_py() + b"\0") for r in rows]
    assert whole == [b"head" + b"x" * (17 << 20), b"head" + b"y" * 1000 + b"z" * 1000 + b"w" * 2000]


def test_empty(spark):
    arc, path = fresh_path(spark, "arc-empty"), fresh_path(spark, "warc-empty")
    warc.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), arc)
    warc.convert(spark, arc, path)
    assert warc.read_archives(spark, path).count() == 0
