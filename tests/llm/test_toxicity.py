"""Toxicity: features, held-out accuracy, what is never an input, odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import toxicity as T

CALM = "meadow river lantern harvest window garden silver morning bread letter".split()
RUDE = "grubling snarfoul vexhag".split()


def corpus(spark, n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(CALM) for _ in range(rng.randrange(20, 60))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE) + rng.choice(["", "s", "ed"]))
        rows.append((i, " ".join(words), "en", "src", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    model = T.fit(docs, labels)
    scored = T.with_scores(docs, model).join(labels, "doc_id").withColumn("held", T.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r.held]
    assert len(held) > 50 and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held for r in scored)
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in held]) > 0.97
    assert len(model[0]) < 3000  # most weights are zero


def test_held_out_labels_are_never_seen(spark):
    docs, labels = corpus(spark, 200)
    lied = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for a, b in zip(T.fit(docs, labels), T.fit(docs, lied), strict=True):
        assert np.array_equal(a, b)


def test_the_pipeline_keeps_civil_rows_whole(spark):
    docs, labels = corpus(spark, 300)
    extra = docs.withColumn("score", F.lit("mine")).select("lang", "score", "text", "doc_id")
    kept = T.keep_civil(extra, T.fit(docs, labels))
    assert kept.columns == extra.columns
    ids = {r.doc_id for r in kept.collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(ids & toxic) < 3 and len(ids) > 235


def test_odd_rows_and_tables(spark):
    docs, labels = corpus(spark, 100)
    odd = spark.createDataFrame([(None, "grubling"), (5, None), (6, ""), (6, ""), (7, "x " * 200_000)], "doc_id long, text string")
    model = T.fit(docs, labels)
    got = T.with_scores(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    empty_docs, empty_labels = docs.limit(0), labels.limit(0)
    assert T.with_scores(docs, T.fit(docs, empty_labels)).agg(F.max("score")).first()[0] < 1e-6
    assert T.with_scores(empty_docs, T.fit(empty_docs, labels)).count() == 0
    one_kind = T.fit(docs, labels.where("toxic = 1"))
    assert T.with_scores(docs, one_kind).agg(F.min("score")).first()[0] > 0.999
    assert T.fit(docs, labels.withColumn("toxic", F.lit(None).cast("int")))[2] < 0


def test_features():
    assert len(T.places(None)) == 0 and len(T.places(b" ... ")) == 0
    assert np.array_equal(T.places(b"Good day"), T.places(b"good, DAY!"))
    assert not np.array_equal(np.unique(T.places(b"a b")), np.unique(T.places(b"b a")))
    w = T.Ftrl(8)
    w.step(np.array([1, 2]), 1.0)
    assert w.weights(np.array([0]))[0] == 0 and w.bias() > 0


def plain_ftrl(rows, order):
    """FTRL-proximal by one coordinate at a time, over dicts."""
    z, n = {}, {}

    def weight(k):
        if k == "bias":
            return -z.get(k, 0.0) / ((T.BETA + n.get(k, 0.0) ** 0.5) / T.ALPHA)
        v = z.get(k, 0.0)
        if abs(v) <= T.L1:
            return 0.0
        return -(v - (T.L1 if v > 0 else -T.L1)) / ((T.BETA + n.get(k, 0.0) ** 0.5) / T.ALPHA + T.L2)

    for i in order:
        places, y = rows[i]
        used = [*places, "bias"]
        w = {k: weight(k) for k in used}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for k in used:
            sigma = ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / T.ALPHA
            z[k] = z.get(k, 0.0) + g - sigma * w[k]
            n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z if k != "bias" and weight(k)}, weight("bias")


def test_against_plain_ftrl():
    rng = random.Random(5)
    rows = [(sorted(rng.sample(range(60), 12)) + [1000 + i], int(i % 4 == 0)) for i in range(80)]
    rows = [(sorted({*p, 7}) if y else p, y) for p, y in rows]
    orders = np.random.default_rng(11)
    order = [i for _ in range(T.EPOCHS) for i in orders.permutation(len(rows))]
    want, bias = plain_ftrl(rows, order)
    at, w, b = T.train([np.array(p, np.int32) for p, _ in rows], [y for _, y in rows])
    assert set(at.tolist()) == set(want) and abs(b - bias) < 1e-9
    assert all(abs(want[k] - x) < 1e-9 for k, x in zip(at.tolist(), w.tolist(), strict=True))


def test_repeated_ids_stay_bounded(spark):
    docs, labels = corpus(spark, 100)
    again = docs.union(docs.where("doc_id < 5").crossJoin(spark.range(200)).drop("id"))
    for a, b in zip(T.fit(docs, labels), T.fit(again, labels), strict=True):
        assert np.array_equal(a, b)  # equal rows count once
    other = again.withColumn("text", F.concat("text", F.lit(" "), F.monotonically_increasing_id().cast("string")))
    assert T.fit(other, labels, rows=90)[2] != 0


def test_places_travel_in_few_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 50, 3000):
        at = rng.integers(0, 1 << T.BITS, n)
        assert np.array_equal(T.unpacked(T.packed(at)), np.unique(at))
    assert len(T.packed(rng.integers(0, 1 << T.BITS, 3000))) < 6002
