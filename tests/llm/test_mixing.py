"""Mixing against a plain model of its rules."""

import random

import pytest
from pyspark.sql import functions as F

from thicket.llm import mixing as X


def brute_targets(sizes: dict, weights=(3, 1, 2)) -> dict:
    """Water-filling by repeated sharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            return share | {s: 2 * sizes[s] for s in capped}
        capped |= over
        if len(capped) == len(names):
            return {s: 2 * sizes[s] for s in names}


def rows_of(seed, sources, n=300):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.randrange(0, 80)), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed,sources", [(1, ["a", "b", "c", "d"]), (2, ["a"] * 9 + ["b", None]), (3, ["é", "z", "Z", None, "aa"])])
def test_targets_and_taken_words(spark, seed, sources, tmp_path):
    rows = rows_of(seed, sources)
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = X.op1_mixing(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    source = {i: s for i, _, s in rows}
    taken: dict = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r["size"] and r.taken == r["size"] * r.copies
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(80, 0.05 * t)
    again = {r.doc_id: r.taken for r in X.op1_mixing(spark, str(tmp_path)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_rows_are_emitted_whole(spark):
    rows = rows_of(5, ["a", "b", "b", "b"], 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("own")).withColumn("target", F.lit(7))
    mixed = X.mix(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(counts.values()) <= {1, 2} and {(r.doc_id, r.text) for r in mixed.collect()} <= {(i, t) for i, t, _ in rows}


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "x y", "a"), (3, "x y z", "a"), (3, "x y z", "a"), (4, " \t\n", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert X.mix(docs).count() >= 3
    assert X.mix(docs.limit(0)).count() == 0
    assert X.mix(docs.where("source = 'empty'")).count() == 0
