"""Every mode, from documents to evaluated rankings."""

import pytest

from thicket import cli
from thicket.plans import querytree as Q

DOCS = "d1:The cat sat. The cat, the mat!\nd2:a dog sat on the cat\nd3:birds only\n"
QUERIES = '[{"name": "q", "child": {"type": "scoring_model", "field": "text", "terms": ["cat", "the cat"], "retrieval_model": {"type": "ql", "smoothing": {"type": "dirichlet", "mu": "{{mu}}"}}}}]'
PARAMS = '[{"name": "p", "params": [{"name": "mu", "value": 10}]}]'


@pytest.fixture(scope="module")
def work(tmp_path_factory):
    w = tmp_path_factory.mktemp("cli")
    for name, text in (("docs", DOCS), ("queries", QUERIES), ("params", PARAMS), ("qrels", "q 0 d1 1\nq 0 d2 0\n"), ("wanted", "docs\td3\n"), ("ann", "a#1-d1\nX\t0\t1\t0.5\t0.5\t/m/1\n\n")):
        (w / name).write_text(text)
    return w


def run(spark, capsys, *arguments):
    assert cli.main([str(a) for a in arguments], spark) == 0
    return [line.split("\t") for line in capsys.readouterr().out.splitlines()]


def test_scoring(spark, capsys, work):
    run(spark, capsys, "corpus-stats", "-q", work / "queries", "-o", work / "stats", work / "docs")
    run(spark, capsys, "merge-corpus-stats", "-o", work / "both", work / "stats", work / "stats")
    assert spark.read.parquet(str(work / "both" / "corpus")).first().n_tokens == 30
    run(spark, capsys, "score", "-q", work / "queries", "-p", work / "params", "-s", work / "stats", "-o", work / "out", work / "docs")
    best = {r.doc_name: r for r in Q.read_results(spark, str(work / "out" / "results.json")).collect()}
    assert best["d1"]["rank"] == 1 and [p.term for p in best["d1"].postings] == ["cat", "the cat"]
    run(spark, capsys, "merge-rankings", "-k", 1, "-n", 5, "-o", work / "merged.json", work / "out" / "results.json", work / "out" / "results.json")
    assert {r.doc_name for r in Q.read_results(spark, str(work / "merged.json")).collect()} == {"d1"}


def test_indexes(spark, capsys, work):
    run(spark, capsys, "index", "-o", work / "index", work / "docs")
    assert [r[0] for r in run(spark, capsys, "query", work / "index", "cat", "mat")] == ["docs/d1", "docs/d2"]
    assert run(spark, capsys, "count-postings", work / "index", "cat") == [["cat", "2", "3"]]
    assert run(spark, capsys, "dump-postings", work / "index", "sat") == [["sat", "docs/d1", "1"], ["sat", "docs/d2", "1"]]
    assert len(run(spark, capsys, "list-documents", work / "index")) == 3
    assert run(spark, capsys, "names", work / "docs")[0] == ["docs", "d1"]
    run(spark, capsys, "extract", "-w", work / "wanted", "-o", work / "some", work / "docs")
    assert spark.read.parquet(str(work / "some")).first().doc_name == "d3"


def test_entities(spark, capsys, work):
    run(spark, capsys, "entity-index", "-o", work / "e1", work / "ann")
    run(spark, capsys, "merge-entity-indexes", "-o", work / "e2", work / "e1", work / "e1")
    assert run(spark, capsys, "entities-of", work / "e2", "d1") == [['[{"term":"/m/1","tf":1}]']]


def test_runs_and_learning(spark, capsys, work):
    (work / "a.run").write_text("q Q0 d2 1 2.0 m\nq Q0 d1 2 1.0 m\n")
    (work / "b.run").write_text("q Q0 d1 1 9.0 m\nq Q0 d2 2 1.0 m\n")
    assert run(spark, capsys, "evaluate", work / "qrels", work / "a.run") == [["m", "0.5", "1"]]
    assert ["recip_rank", "all", "0.5"] in run(spark, capsys, "evaluate", "--metrics", work / "qrels", work / "a.run")
    run(spark, capsys, "merge-runs", "-k", 1, "-o", work / "m.run", work / "a.run", work / "b.run")
    assert spark.read.text(str(work / "m.run")).first().value == "q Q0 d1 1 9.0 merged"
    run(spark, capsys, "learn", "-q", work / "qrels", "-o", work / "model", f"a={work / 'a.run'}", f"b={work / 'b.run'}")
    run(spark, capsys, "predict", "-m", work / "model", "-o", work / "l.run", f"a={work / 'a.run'}", f"b={work / 'b.run'}")
    assert run(spark, capsys, "evaluate", work / "qrels", work / "l.run") == [["l2r", "1.0", "1"]]
    with pytest.raises(ValueError, match="NAME=RUN"):
        run(spark, capsys, "learn", "-q", work / "qrels", "-o", work / "x", "nothing")


def test_pages(spark, capsys, work):
    (work / "p.html").write_text("<html><title>T</title><body>b</body></html>")
    assert run(spark, capsys, "html-clean", work / "p.html") == [["T", "b"]]
