"""Readers and writers, by round trips and hand-made files."""

import bz2
import gzip
import lzma
import struct

import pytest
from pyspark.sql import functions as F

from thicket.sources import archives, compressed, documents, formats, html


def put(path, text):
    path.write_text(text)
    return str(path)


def test_qrels_and_runs(spark, tmp_path):
    path = put(tmp_path / "qrel", "q1 0 d1 1\nq1 0 d2 -2\n\nshort line\nq2 0 d3 0\n")
    qrels = formats.read_qrels(spark, path)
    assert {tuple(r) for r in qrels.collect()} == {("q1", "d1", 1), ("q1", "d2", -2), ("q2", "d3", 0)}
    with pytest.raises(Exception, match="binary relevance"):
        formats.read_qrels(spark, path, "binary").collect()
    assert {r.relevance for r in formats.read_qrels(spark, path, "text").collect()} == {"1", "-2", "0"}
    formats.write_qrels(qrels, str(tmp_path / "again"))
    assert formats.read_qrels(spark, str(tmp_path / "again")).exceptAll(qrels).count() == 0
    assert {r.query_id: len(r.entries) for r in formats.qrels_by_query(qrels).collect()} == {"q1": 2, "q2": 1}

    run = formats.read_run(spark, put(tmp_path / "run", "q Q0 d1 1 -2.5 m extra\n\n q\tQ0 d2 2 1e-3 m\n"))
    assert [tuple(r)[:5] for r in run.orderBy("line").collect()] == [("q", "d1", 1, -2.5, "m"), ("q", "d2", 2, 0.001, "m")]
    formats.write_run(run, str(tmp_path / "run2"))
    assert formats.read_run(spark, str(tmp_path / "run2")).select("doc_id", "score").exceptAll(run.select("doc_id", "score")).count() == 0
    with pytest.raises(Exception, match="no run line"):
        formats.read_run(spark, put(tmp_path / "bad", "q Q0 d1 1\n")).collect()


def test_list_files_and_tsv_queries(spark, tmp_path):
    names = put(tmp_path / "list", "a.txt\n\nb.txt\n")
    assert formats.expand(spark, f"@{names}") == ["a.txt", "b.txt"] and formats.expand(spark, "file:///x") == ["/x"]
    row = formats.read_queries_tsv(spark, put(tmp_path / "q.tsv", "q1\tfoo bar\tName\t/m/1 /m/2\nq2\tx\n")).orderBy("query_id").collect()
    assert (row[0].terms, row[0].entities, row[1].names) == (["foo", "bar"], ["/m/1", "/m/2"], [])


def test_robust_documents(spark, tmp_path):
    path = put(tmp_path / "ft.dat", "<DOC>\n<DOCNO> A-1 </DOCNO>\n<DATE>now</DATE>\n<HEADLINE>\nHi\n</HEADLINE>\nbody <P>one</P>\n</DOC>\n<DOC>\n<DOCNO>A-2</DOCNO>\n<TEXT>x</TEXT>\n</DOC>\n\n")
    rows = {r.doc_name: r for r in formats.read_robust(spark, path).collect()}
    assert (rows["A-1"].date, rows["A-1"].headline, rows["A-1"].header, rows["A-1"].text.strip(), rows["A-1"].archive) == ("now", "Hi", None, "body <P>one</P>", "ft.dat")
    assert rows["A-2"].text.strip() == "<TEXT>x</TEXT>"
    with pytest.raises(Exception, match="no document"):
        formats.read_robust(spark, put(tmp_path / "bad.dat", "<DOC>nothing</DOC>")).collect()


def test_topics_annotations_and_test_documents(spark, tmp_path):
    top = "<top>\n<num> Number: 7 </num><docid>D</docid><url>u</url><entities><entity><id> 7.1 </id><mention>A</mention><mention>B</mention><link>l</link></entity></entities></top>\n"
    (topic,) = formats.read_news_topics(spark, put(tmp_path / "topics", top)).collect()
    assert (topic.number, topic.doc_id) == (7, "D") and [(e.id, e.mentions, e.link) for e in topic.entities] == [("7.1", ["A", "B"], "l")]
    ann = formats.read_annotations(spark, put(tmp_path / "ann", "arc#1-d1\nObama\t3\t8\t0.9\t0.5\t/m/1\nRome\t9\t12\t0.8\t0.4\t/m/2\n\narc#1-d2\n\n"))
    rows = {r.doc_name: r.annotations for r in ann.collect()}
    assert [(a.surface, a.begin, a.entity) for a in rows["1-d1"]] == [("Obama", 3, "/m/1"), ("Rome", 9, "/m/2")] and rows["1-d2"] == []
    assert {tuple(r) for r in formats.entity_documents(ann).collect()} == {("d1", "/m/1"), ("d1", "/m/2")}
    docs = documents.read_documents(spark, "test", put(tmp_path / "docs", "a:x: y\nb:\nc\n"))
    assert {(r.doc_name, r.text) for r in docs.collect()} == {("a", "x: y"), ("b", ""), ("c", "")}
    wanted = spark.createDataFrame([("docs", "a")], "archive string, doc_name string")
    assert documents.extract(docs, wanted).count() == 1
    with pytest.raises(ValueError):
        documents.read_documents(spark, "nope", "x")


def test_embedding_files(spark, tmp_path):
    glove = formats.read_embedding(spark, put(tmp_path / "g", "the 0.5 1\ncat\t-1\t2e-1\n"))
    assert {r.term: list(r.vec) for r in glove.collect()} == {"the": [0.5, 1.0], "cat": [-1.0, pytest.approx(0.2)]}
    w2v = formats.read_embedding(spark, put(tmp_path / "w", "2 3\na 1 2 3\nb 4 5 6 \n"))
    assert {r.term: list(r.vec) for r in w2v.collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    with pytest.raises(Exception, match="no vector"):
        formats.read_embedding(spark, put(tmp_path / "x", "a 1 2\nb 1\n")).collect()


def test_any_compression(spark, tmp_path):
    text = "ä line\nsecond\n".encode()
    for name, data in (("a.gz", gzip.compress(text) + gzip.compress(b"third\n")), ("b.bz2", bz2.compress(text)), ("c.xz", lzma.compress(text)), ("d", text), ("e", lzma.compress(text))):
        (tmp_path / name).write_bytes(data)
    rows = compressed.read_lines(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.line)):
        got.setdefault(r.path[-4:].split("/")[-1], []).append(r.value)
    assert got == {"a.gz": ["ä line", "second", "third"], ".bz2": ["ä line", "second"], "c.xz": ["ä line", "second"], "d": ["ä line", "second"], "e": ["ä line", "second"]}
    assert compressed.detect(lzma.compress(b"")) == "xz" and compressed.guess("x.XZ") == "xz" and compressed.guess("x") is None
    assert {bytes(r.content) for r in compressed.read_files(spark, str(tmp_path / "*[z2]")).collect()} == {text, text + b"third\n"}


def test_html_cleaning(spark):
    page = "<HTML><head><TITLE>A &amp; B</TITLE></head><body>x<nav>menu</nav><ARTICLE>one<p>two<script>var a='<p>';</script><b>three</b></p><br/>four</ARTICLE>after</body></html>"
    title, body = html.clean(page)
    assert title == "A & B" and body.split() == ["one", "twothree", "four"]
    assert html.clean("<body>a<div>b</div></body>")[1].split() == ["a", "b"]
    assert html.clean("no tags") == ("", "") and html.clean("") == ("", "")
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert {r.page_id: r.title for r in html.clean_pages(df).collect()} == {1: "A & B", 2: None}


def record(kind, body, **fields):
    head = {"WARC-Record-ID": "<urn:1>", "Content-Type": kind, "Content-Length": str(len(body))} | {k.replace("_", "-"): v for k, v in fields.items()}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def test_warc_responses(spark, tmp_path):
    ok = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>\xe4</p>"
    no_charset = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nx"
    data = record("application/warc-fields", b"a: b\r\n") + record("application/http; msgtype=response", ok) + record("application/http; msgtype=request", ok) + record("application/http; msgtype=response", no_charset)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data))
    rows = archives.read_warc_responses(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("x.warc.gz", "urn:1", "<p>ä</p>")]
    (tmp_path / "x.warc.gz").write_bytes(data[:-20])
    with pytest.raises(Exception, match="bytes of a record"):
        archives.read_warc_responses(spark, str(tmp_path)).collect()


def test_structured_documents_as_warc(spark, tmp_path):
    rows = [("hello", {"field1": [("heĀllo", True)], "field2": [("sea turtle", False)]}, {"meta1": "world"})]
    docs = spark.createDataFrame(rows, "doc_id string, fields map<string,array<struct<text:string,tokenised:boolean>>>, metadata map<string,string>")
    archives.write_structured(docs.coalesce(1), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*.gz")
    records = list(archives.warc_records(compressed.opened(file.read_bytes())))
    assert records[0][1] == b"" and records[1][0]["warc-trec-id"] == "hello" and records[1][0]["meta1"] == "world"
    assert records[1][1] == b"<text>\n<field1>hello</field1>\n<field2 tokenizeTagContent=false>sea turtle</field2>\n</text>\n"


def test_thrift_stream_items(spark, tmp_path):
    text = lambda n, s: struct.pack(">bhi", 11, n, len(s)) + s
    content = text(3, b"text/html") + text(5, "sichtbär".encode()) + b"\0"
    item = struct.pack(">bhi", 8, 1, 2) + text(2, b"doc") + struct.pack(">bh", 12, 7) + content + text(9, b"1-doc") + struct.pack(">bh", 12, 10) + struct.pack(">bhd", 4, 1, 86400.5) + b"\0" + struct.pack(">bhbbi", 13, 11, 11, 12, 0) + b"\0"
    empty = struct.pack(">bhi", 8, 1, 2) + text(2, b"none") + text(9, b"2") + struct.pack(">bh", 12, 10) + struct.pack(">bhd", 4, 1, 0.0) + b"\0" + b"\0"
    (tmp_path / "a.sc.xz").write_bytes(lzma.compress(item + empty))
    items = archives.read_stream_items(spark, str(tmp_path))
    rows = {r.doc_name: r for r in items.withColumn("t", F.unix_timestamp("stream_time")).collect()}
    assert rows["doc"].body.clean_visible == "sichtbär" and rows["doc"].t == 86400 and rows["none"].body is None
    assert [(r.doc_name, r.text) for r in documents.read_documents(spark, "kba", str(tmp_path)).collect()] == [("doc", "sichtbär")]


def test_json_array(spark):
    assert formats.json_array(spark.createDataFrame([(1,), (2,)], "a int")).first()[0] == '[{"a":1},{"a":2}]'
