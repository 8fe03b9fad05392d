"""Evaluation, agreement, aggregates, phrases and vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from thicket.functions import text as X
from thicket.operators import aggregates as A
from thicket.operators import evaluation as E
from thicket.operators import phrases as P
from thicket.operators import vectors as V


def run_of(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, rank int, method string")


def test_average_precision_of_the_worked_example(spark):
    run = run_of(spark, [("q", "a", 1, "m"), ("q", "b", 2, "m"), ("q", "c", 3, "m"), ("r", "a", 1, "m"), ("s", "a", 1, "m")])
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "c", 1), ("q", "z", 1), ("q", "b", 0), ("r", "a", 0)], "query_id string, doc_id string, relevance int")
    got = {r.query_id: r for r in E.measures(run, qrels).collect()}
    assert got["q"].average_precision == pytest.approx(0.555556, abs=1e-6)
    assert got["q"].r_precision == pytest.approx(2 / 3) and got["q"].reciprocal_rank == 1
    assert got["r"].average_precision is None and got["s"].average_precision is None
    assert E.mean_average_precision(run, qrels).first()[0] == pytest.approx(0.555556 / 3, abs=1e-6)
    assert E.map_by_method(run, qrels).first().n_queries == 1
    every = {(r.metric, r.query_id): r.value for r in E.metric_rows(run, qrels).collect()}
    assert every["map", "all"] == every["map", "q"]
    fewer = E.metric_rows(run.where("query_id = 's'"), qrels, complete=True)
    assert {(r.metric, r.query_id): r.value for r in fewer.collect()}["map", "all"] == 0
    assert {r.query_id for r in E.of_judged_queries(run, qrels).collect()} == {"q", "r"}


@pytest.mark.parametrize("seed", range(4))
def test_both_forms_of_average_precision_agree(spark, seed):
    rng = random.Random(seed)
    docs = [f"d{i}" for i in range(12)]
    rng.shuffle(docs)
    good = set(rng.sample(docs, 4))
    run = run_of(spark, [("q", d, i + 1, "m") for i, d in enumerate(docs[:9])])
    qrels = spark.createDataFrame([("q", d, int(d in good)) for d in docs], "query_id string, doc_id string, relevance int")
    prefix = E.prefix_precision(run, qrels).where("is_relevant").agg(F.coalesce(F.sum("precision"), F.lit(0.0)) / 4).first()[0]
    assert E.measures(run, qrels).first().average_precision == pytest.approx(prefix)


def ratings(spark, rows):
    return spark.createDataFrame(rows, "subject string, category string")


def test_kappas(spark):
    a = ratings(spark, [("s1", "x"), ("s2", "x"), ("s3", "y"), ("s4", "y")])
    b = ratings(spark, [("s1", "x"), ("s2", "y"), ("s3", "y"), ("s4", "y"), ("s5", "x")])
    assert E.cohen_kappa(a, b).first()[0] == pytest.approx(0.5)
    assert E.cohen_kappa_classes(a, b, [["x"], ["y"]]).first()[0] == pytest.approx(0.5)
    assert math.isnan(E.cohen_kappa_classes(a, b, [["x", "y"]]).first()[0])  # all agree, as chance does
    assert math.isnan(E.cohen_kappa(a, ratings(spark, [("other", "x")])).first()[0])
    rows = [("1", "s1", "x"), ("1", "s2", "x"), ("1", "s3", "y"), ("2", "s1", "x"), ("2", "s2", "y"), ("2", "s3", "y"), ("3", "s1", "x"), ("3", "s2", "y"), ("3", "lone", "y")]
    assert E.fleiss_kappa(spark.createDataFrame(rows, "assessor string, subject string, category string")).first()[0] == pytest.approx(0.555556, abs=1e-6)


def test_means_bags_and_maps(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", 6.0), ("b", None)], "k string, v double")
    got = {r.k: r.mean for r in A.mean_of(A.merge_means(A.mean_parts(df.where("v < 3"), "v", ("k",)), A.mean_parts(df.where("v is null or v >= 3"), "v", ("k",)), by=("k",))).collect()}
    assert got["a"] == pytest.approx(11 / 3) and math.isnan(got["b"])
    bag = A.normed_list(spark.createDataFrame([("x",), ("x",), ("y",)], "w string"), "w")
    assert {r.key: r.weight for r in bag.collect()} == pytest.approx({"x": 2 / 3, "y": 1 / 3})
    union = A.weighted_union((3.0, bag), (1.0, bag))
    assert [r.key for r in A.by_frequency(union).collect()] == ["x", "y"]
    maps = spark.createDataFrame([({"a": 1, "b": 2},), ({"a": 5},)], "m map<string,long>")
    assert {r.key: r.value for r in A.merge_maps(maps, "m").collect()} == {"a": 6, "b": 2}


def test_histograms_close_their_last_bin(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 2.4, 2.5, 9.99, 10.0, 11.0, None)], "x double")
    bins = A.linear(4, 0, 10)
    assert {r.bin: r.n for r in A.histogram(df, "x", bins).collect()} == {0: 2, 1: 1, 3: 2}
    every = A.all_bins(A.histogram(df, "x", bins), bins).orderBy("bin").collect()
    assert [(r.low, r.high, r.n) for r in every] == [(0, 2.5, 2), (2.5, 5, 1), (5, 7.5, 0), (7.5, 10, 2)]
    assert {(r.place, r.bin): r.n for r in A.bounded_histogram(df, "x", bins).collect()}[("low", None)] == 1
    logs = A.logarithmic(3, 1, 1000)
    assert {r.bin: r.n for r in A.histogram(spark.createDataFrame([(1.0,), (50.0,), (1000.0,), (0.0,)], "x double"), "x", logs).collect()} == {0: 1, 1: 1, 2: 1}
    whole = A.integral(3, 5)
    assert {r.bin: r.n for r in A.histogram(spark.createDataFrame([(4,), (5,), (7,), (8,)], "x int"), "x", whole).collect()} == {0: 1, 2: 1}


def test_feature_vectors(spark):
    rows = spark.createDataFrame([("i", "b", 1.0), ("i", "b", 2.0), ("i", "zz", 9.0), ("j", "a", 4.0)], "item string, feature string, value double")
    got = {r.item: r.features for r in A.features_from(rows, ("a", "b"), ("item",), default=-1).collect()}
    assert got == {"i": [-1, 3], "j": [4, -1]}
    with pytest.raises(Exception, match="no value of feature"):
        A.features_from(rows, ("a", "b"), ("item",), default=None).collect()
    data = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    stats = A.mean_and_deviation(data)
    z = A.z_normalised(data, stats)
    assert sorted(r.features for r in z.collect()) == [[-1, 0], [1, 0]]
    assert sorted(r.features for r in A.z_restored(z, stats).collect()) == [[1, 5], [3, 5]]
    assert A.vector_sum(data).first().features == [4, 10]


def test_trie_scans_for_the_longest(spark, monkeypatch):
    trie = P.Trie([("hello", 1), ("hello world", 2), ("hello bears", 3)])
    text = "there is a hello in the hello bears trie"
    assert [v for _, _, v in trie.sequential(text) if v] == [1, 3]
    assert trie.lookup("hello world") == 2 and trie.lookup("hello w") is None
    both = trie.union(P.Trie([("hello", 10), ("x", 4)]), lambda a, b: a + b)
    assert dict(both.items()) == {tuple("hello"): 11, tuple("hello world"): 2, tuple("hello bears"): 3, ("x",): 4}
    docs = spark.createDataFrame([(1, "a b a b c".split()), (2, []), (3, None), (4, ["b"])], "doc_id long, tokens array<string>")
    phrases = P.phrase_table(spark, {"ab": ["a", "b"], "abc": ["a", "b", "c"], "b": ["b"]})
    longest = {(r.doc_id, r.start, r.end, r.phrase_id) for r in P.longest_matches(docs, phrases).collect()}
    assert longest == {(1, 0, 2, "ab"), (1, 2, 5, "abc"), (4, 0, 1, "b")}
    twice = phrases.unionByName(spark.createDataFrame([("z", ["b"]), ("none", []), ("null", None)], phrases.schema))
    odd = docs.unionByName(docs.where("doc_id = 1"))
    for n in (100, 0):
        monkeypatch.setattr(P, "BROADCAST_PHRASES", n)
        got = sorted((r.doc_id, r.start, r.end, r.phrase_id) for r in P.longest_matches(odd, twice).collect())
        assert got == sorted([(1, 0, 2, "ab"), (1, 2, 5, "abc")] * 2 + [(4, 0, 1, "z")])
        assert P.longest_matches(docs.where("doc_id = 4"), phrases.where("phrase_id = 'ab'")).collect() == [(4, 0, 1, None)]
    found = {(r.doc_id, r.phrase_id, r.start) for r in P.overlapping(docs, phrases).collect()}
    assert found == {(1, "ab", 0), (1, "ab", 2), (1, "abc", 2), (1, "b", 1), (1, "b", 3), (4, "b", 0)}
    assert P.overlapping(docs, phrases.limit(0)).count() == 0


def test_embeddings(spark, monkeypatch):
    emb = spark.createDataFrame([("cat", [1.0, 2.0]), ("c", [10.0, 0.0]), ("at", [0.5, 0.5])], "term string, vec array<float>")
    docs = spark.createDataFrame([(1, ["cat", "cat", "dog"], "a cat at"), (2, [], ""), (3, None, None)], "doc_id long, terms array<string>, text string")
    assert {r.doc_id: r.vec for r in V.embed_terms(docs, emb).collect()} == {1: [2, 4], 2: [0, 0], 3: [0, 0]}
    assert {r.doc_id: r.vec for r in V.embed_text(docs, emb).collect()} == {1: [1.5, 2.5], 2: [0, 0], 3: [0, 0]}
    monkeypatch.setattr(V, "BROADCAST_VALUES", 0)
    odd = docs.unionByName(docs.where("doc_id = 1")).unionByName(spark.createDataFrame([(4, [], "\U0001f600at")], docs.schema))
    assert sorted((r.doc_id, r.vec) for r in V.embed_text(odd, emb).collect()) == [(1, [1.5, 2.5]), (1, [1.5, 2.5]), (2, [0, 0]), (3, [0, 0]), (4, [0.5, 0.5])]
    assert [(r.term, r.score) for r in V.nearest(emb, [1, 1], 2).collect()] == [("c", 10), ("cat", 3)]


def test_numbers_over_all_rows(spark):
    rows = spark.range(1000).selectExpr("(id * 37) % 1000 AS k", "id AS v").repartition(7)
    got = {r.k: r.at for r in A.numbered(rows, ["k"], name="at").collect()}
    assert got == {k: k for k in range(1000)}
    down = {r.k: r.at for r in A.numbered(rows, [F.col("k").desc()], name="at").collect()}
    assert down == {k: 999 - k for k in range(1000)}
    assert A.numbered(rows.limit(0), ["k"]).collect() == []


def test_random_vectors(spark):
    rows = spark.range(50).select(X.random_vector(3, -1, 1, seed=4).alias("v")).collect()
    assert rows == spark.range(50).select(X.random_vector(3, -1, 1, seed=4).alias("v")).collect()
    assert all(len(r.v) == 3 and all(-1 <= x <= 1 for x in r.v) for r in rows) and len({tuple(r.v) for r in rows}) == 50
