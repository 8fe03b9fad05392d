"""Coordinate ascent, feature spaces, folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import ltr as L

ROWS = [("q", "a", [1.0, 10.0], 1), ("q", "b", [1.0, -1.0], 1), ("q", "c", [-1.0, 10.0], 0), ("q", "d", [-1.0, -1.0], 0)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS, "query_id string, doc_id string, features array<double>, relevance int").coalesce(1).persist()


def test_ascent_finds_the_top_of_any_objective():
    steps = L.naive_ascent(lambda w: -(w[0] ** 2 + (w[1] - 10) ** 2), [1.0, 2.0], normalise=lambda w: w)
    for _ in range(30):
        score, w = next(steps)
    assert abs(w[0]) < 10 and abs(w[1] - 10) < 10 and score > -10


def test_ascent_ranks_relevant_documents_first(spark, data):
    totals = L.totals_of(data)
    score, w = next(L.coordinate_ascent(data, totals, [0.0, 10.0], seed=1))
    assert score == pytest.approx(1.0) and w[0] > 0 and w[0] > 2 * w[1] and np.linalg.norm(w) == pytest.approx(1)
    model, best = L.learn(L.Space(("x", "y")), data, totals, drop=0, most=1)
    assert best == pytest.approx(1.0)
    again = L.Model.from_json(model.to_json())
    assert again.weights == pytest.approx(model.weights)
    assert [r.doc_id for r in again.rerank(data).orderBy("rank").collect()][:2] == ["a", "b"] or best == 1


def test_grid_scores_match_a_direct_count(spark, data):
    got = L.grid_scores(data, L.totals_of(data), np.array([0.0, 1.0]), 0, [0.0, 100.0])
    # by y alone a and c tie, the smaller id first: relevant at 1 and 3 of 4
    assert got == pytest.approx([(1 + 2 / 3) / 2, 1.0])
    assert L.grid_scores(data, L.totals_of(data), np.array([0.0, 1.0]), 0, [0.0], cutoff=1) == pytest.approx([0.5])


def test_mini_batches_and_convergence(spark, data):
    got = L.until_converged(L.mini_batched_and_evaluated(data, L.totals_of(data), [1.0, 1.0], batch_size=2), drop=0, most=2)
    assert len(got) == 2 and got[-1][0] == pytest.approx(1.0)
    assert [s for s, _ in L.until_converged(iter([(0.1, 0), (0.5, 0), (0.9, 0), (0.9, 1), (1.0, 2)]), drop=1)] == [0.5, 0.9, 0.9]


def test_iterates_are_traced():
    lines = []
    steps = [(0.5, np.ones(1)), (0.75, np.ones(1))]
    assert list(L.traced(iter(steps), lines.append)) == steps
    assert lines == ["iteration 0: score 0.5, relative change nan", "iteration 1: score 0.75, relative change 0.5"]


def test_spaces_and_runs(spark):
    run = lambda rows: spark.createDataFrame(rows, "query_id string, doc_id string, score double")
    space, rows = L.features_of_runs({"b": run([("q", "d", 2.0)]), "a": run([("q", "d", 1.0)])})
    assert space.names == ("a", "b") and rows.first().features == [1.0, 2.0]
    _, lacking = L.features_of_runs({"a": run([("q", "d", 1.0)]), "b": run([("q", "e", 1.0)])})
    with pytest.raises(Exception, match="no value of feature"):
        lacking.collect()
    big = L.Space(("a", "b", "c"))
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "features array<double>")
    assert row.select(big.project(F.col("features"), L.Space(("a", "c")))).first()[0] == [1, 3]
    assert row.select(L.accumulate(F.col("features"), 1, 5.0)).first()[0] == [1, 7, 3]
    with pytest.raises(KeyError):
        L.Space(("a",)).project(F.col("features"), big)
    assert big.common(L.Space(("c", "x"))).names == ("c",) and L.Space(("a",)).lacking(big) == ["b", "c"]
    assert L.denormalised([2.0, 3.0], [4.0, 0.0]).tolist() == [0.5, 3.0]
    qrels = spark.createDataFrame([("q", "d", 1)], "query_id string, doc_id string, relevance int")
    assert {r.relevance for r in L.with_relevance(run([("q", "d", 1.0), ("q", "e", 1.0)]), qrels).collect()} == {0, 1}


def test_folds(spark, data):
    assert L.sequential_folds(list(range(7)), 3) == [[0, 1, 2], [3, 4, 5], [6]]
    assert L.sequential_folds([1, 2, 3, 4, 5], 3) == [[1], [2], [3], [4], [5]]
    with pytest.raises(ValueError):
        L.sequential_folds([1], 3)
    rows = data.union(data.withColumn("query_id", F.lit("r")))
    made = L.k_folds_and_restarts(rows, [["q"], ["r"]], 2, 7, lambda fold, restart, seed, part: (fold, restart, part.count()))
    assert [(t.count(), r) for t, r in made] == [(4, [(0, 0, 4), (0, 1, 4)]), (4, [(1, 0, 4), (1, 1, 4)])]


def test_models_are_saved(spark, tmp_path):
    model = L.Model(L.Space(("a", "b")), (0.25, -1.0))
    L.save_model(model, spark, str(tmp_path / "model"))
    assert L.load_model(spark, str(tmp_path / "model")) == model
