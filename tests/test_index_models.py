"""Index, statistics and retrieval models on a tiny corpus, and by properties on random ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from thicket.functions import text as X
from thicket.functions.stopwords import read_stop_words
from thicket.operators import index as I
from thicket.operators import models as M
from thicket.operators import ranking as R

CORPUS = [(1, "the cat sat"), (2, "the dog sat sat"), (3, "a bird")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string")


@pytest.fixture(scope="module")
def built(docs):
    return I.build(docs)


def scores(df):
    return {r.doc_id: r.score for r in df.collect()}


def test_worked_examples(spark, built):
    q = M.query_rows(spark, {"q": ["cat", "sat"]})
    assert scores(M.bm25(built, q)) == pytest.approx({1: 1.450833, 2: 0.590862}, abs=1e-6)
    assert scores(M.query_likelihood(built, q, M.Dirichlet(10))) == pytest.approx({1: -2.916347, 2: -3.498778}, abs=1e-6)
    assert scores(M.query_likelihood(built, q, M.JelinekMercer(0.6))) == pytest.approx({1: -2.507380, 2: -3.949763}, abs=1e-6)
    assert scores(M.query_likelihood(built, q, M.Laplace())) == pytest.approx({1: -1.832581, 2: -2.484907}, abs=1e-6)
    twice = M.each_once(M.query_rows(spark, {"q": ["cat", "sat", "cat"]}))
    assert scores(M.query_likelihood(built, twice, M.Laplace()))[1] == pytest.approx(-1.832581, abs=1e-6)
    none = scores(M.query_likelihood(built, q, M.NoSmoothing()))
    assert none[1] == pytest.approx(math.log(1 / 9)) and none[2] == -math.inf


def test_tf_idf_keeps_its_sign(spark, built):
    s = scores(M.tf_idf(built, M.query_rows(spark, {"q": ["sat", "cat"]})))
    assert s == pytest.approx({1: math.log(3 / 3) + math.log(3 / 2), 2: 2 * math.log(3 / 3)})


def test_relevance_model_adds_up(spark, built):
    ranked = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 1.0)], "query_id string, doc_id long, score double")
    got = {r.term: r.weight for r in M.relevance_model(ranked, built.postings).collect()}
    assert got["cat"] == pytest.approx(2 / 3 / 3) and sum(got.values()) == pytest.approx(1)
    logs = M.relevance_model(ranked.withColumn("score", F.log("score")), built.postings, log_scores=True)
    assert {r.term: r.weight for r in logs.collect()} == pytest.approx(got)


def test_statistics_and_lookups(built):
    assert {r.term: (r.df, r.cf) for r in built.term_stats.collect()}["sat"] == (2, 3)
    assert tuple(built.corpus.first()) == (3, 9)
    assert {(r.doc_id, r.tf) for r in I.lookup(built, ["sat", "unknown"]).collect()} == {(1, 1), (2, 2)}
    assert I.missing_documents(built).count() == 0
    assert I.next_id(built) == 4


def test_empty_corpus_and_null_texts(spark):
    empty = I.build(spark.createDataFrame([], "doc_id long, text string"))
    assert tuple(empty.corpus.first()) == (0, 0) and empty.postings.count() == 0
    nulls = I.build(spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string"))
    assert {(r.doc_id, r.doc_len) for r in nulls.documents.collect()} == {(1, 0), (2, 0), (3, 1)}


def test_written_index_is_read_back_and_never_overwritten(spark, built, tmp_path):
    I.write(built, str(tmp_path / "index"), files=2)
    again = I.open_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, built.postings.collect()))
    with pytest.raises(Exception, match="exists"):
        I.write(built, str(tmp_path / "index"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_merged_index_holds_what_its_parts_hold(spark, seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(3):
        rows = [(i, " ".join("".join(rng.choice("abcde") for _ in range(3)) for _ in range(rng.randrange(1, 6)))) for i in range(rng.randrange(1, 5))]
        parts.append(rows)
    frames = [spark.createDataFrame(p, "doc_id long, text string") for p in parts]
    merged = I.merge([I.build(f) for f in frames])
    want, base = set(), 0
    for p in parts:
        for i, t in p:
            for w in set(t.split()):
                want.add((w, base + i, t.split().count(w)))
        base += max(i for i, _ in p) + 1
    assert {tuple(r) for r in merged.postings.collect()} == want
    whole = I.term_statistics(merged.postings)
    assert sorted(map(tuple, merged.term_stats.collect())) == sorted(map(tuple, whole.collect()))
    # documents to postings and back
    back = {(r.doc_id, x.term, x.tf) for r in I.collect_postings(merged.postings, [w for w, _, _ in want]).collect() for x in r.postings}
    assert back == {(d, w, n) for w, d, n in want}


def test_segment_offsets(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 4), ("b", 2), ("c", 0)], "segment string, doc_id long")
    assert {r.segment: r.offset for r in I.segment_offsets(rows).collect()} == {"a": 0, "b": 5, "c": 8}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_k_is_sort_and_take(spark, k):
    rng = random.Random(k)
    rows = [("q", i, float(rng.randrange(6))) for i in range(30)]
    df = spark.createDataFrame(rows, "query_id string, doc_id long, score double")
    want = [(d, s) for _, d, s in sorted(rows, key=lambda r: (-r[2], r[1]))][:k]
    assert [(r.doc_id, r.score) for r in R.top_k(df, k).collect()] == want
    assert [(r.doc_id, r.score) for r in R.rank(df, k).orderBy("rank").collect()] == want


def test_rankings_are_cut_merged_and_rescored(spark):
    a = spark.createDataFrame([("q", 1, 3.0), ("q", 2, 2.0), ("q", 3, 0.0)], "query_id string, doc_id long, score double")
    b = spark.createDataFrame([("q", 4, 2.5), ("q", 5, float("nan")), ("q", 6, float("inf"))], "query_id string, doc_id long, score double")
    merged = R.merge_runs([a, R.finite(b)], 10, "m").orderBy("rank").collect()
    assert [(r.doc_id, r.rank, r.method) for r in merged] == [(1, 1, "m"), (4, 2, "m"), (2, 3, "m")]
    cut = R.merge_cut([x.withColumn("param_set", F.lit("p")) for x in (a, b)], 1, 5)
    assert {r.doc_id for r in cut.collect()} == {1, 4}
    ranked = R.rank(a)
    assert [r.doc_id for r in R.rescore(ranked, -F.col("score")).orderBy("rank").collect()] == [3, 2, 1]
    assert [(r.doc_id, r.rank) for r in R.keep(ranked, F.col("doc_id") != 1).orderBy("rank").collect()] == [(2, 1), (3, 2)]


def test_tokens_positions_and_stop_words(spark, tmp_path):
    df = spark.createDataFrame([("Straße! it's\U0001F600 x, ünd",), (None,), ("",)], "text string")
    rows = df.select(X.tokenise(F.col("text")).alias("t"), X.positioned(F.col("text")).alias("p")).collect()
    assert rows[0].t == ["strasse", "it", "s", "x", "ünd"]
    assert [(p.token, p.token_pos, p.char_pos.begin, p.char_pos.end) for p in rows[0].p] == [("Straße", 0, 0, 5), ("it's\U0001F600", 1, 8, 12), ("x", 2, 14, 14), ("ünd", 3, 17, 19)]
    assert rows[1].t is None and rows[1].p is None and rows[2].t == [] and rows[2].p == []
    (tmp_path / "stop.txt").write_text("foo\n\n bar \n")
    assert read_stop_words(spark, str(tmp_path / "stop.txt")) == {"foo", "bar"}


def test_entities_sum_over_documents(spark):
    rows = spark.createDataFrame([(1, "e"), (1, "e"), (2, "e"), (2, "f")], "doc_id long, entity string")
    made = I.entity_index(rows)
    assert {(r.term, r.df, r.cf) for r in made.term_stats.collect()} == {("e", 2, 3), ("f", 1, 1)}
    latest = I.keep_latest(spark.createDataFrame([("d", 1), ("d", 3), ("c", 2)], "doc string, at int"), "doc", F.col("at"))
    assert {tuple(r) for r in latest.collect()} == {("d", 3), ("c", 2)}
