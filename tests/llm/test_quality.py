"""Quality rules against a plain count."""

import random
import re
from collections import Counter

import numpy as np

from thicket.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_against_brute_force():
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a a a a", "a b a b a b", "x\x1cy\x85z é#|", "l\nl\n\n \nl \nl"]
    texts += [rng.choice([" ", "\n"]).join(rng.choice(["a", "b", "ç", "d#", "E!"]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    texts.append("w " * 100_000)
    for t in texts:
        assert quality.count_rules(t.encode() if t is not None else None)[:5] == brute(t), t


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    x[:20] += 8
    score = quality.Forest(x).score(x)
    assert score[:20].min() > np.quantile(score[20:], 0.98)


def test_junk_is_rejected_and_clean_kept(spark):
    rng = random.Random(5)
    vocab = ["word", "other", "thing", "people", "is", "the", "of"] + [f"v{i}" for i in range(300)]

    def clean():
        return " ".join(rng.choice(vocab) for _ in range(rng.randint(60, 300)))

    def junk():
        return " ".join(rng.choice(vocab) + rng.choice(["***", "$$$", "&&&"]) for _ in range(rng.randint(60, 300)))

    rows = [(i, clean() if i % 5 else junk(), "x") for i in range(600)]
    docs = spark.createDataFrame(rows + [(9001, None, None), (9002, "", None), (None, clean(), None), (9003, "short one", None)], "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), None) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    out = quality.quality(docs, labels).collect()
    assert len(out) == 604
    by = {r.doc_id: r for r in out}
    assert not any(by[i].kept for i in (9001, 9002, 9003)) and by[9001].base_failed
    kept = [by[i].kept for i in range(600) if i % 5]
    assert sum(kept) >= 0.95 * len(kept)
    assert sum(by[i].kept for i in range(0, 600, 5)) <= 6
    for i in (1, 5, 9001):
        assert tuple(by[i][c] for c in quality.COUNTS) == brute(dict((a, b) for a, b, _ in rows).get(i))


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b c " * 40)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, labels).count() == 1
    assert quality.quality(docs.limit(0), labels).count() == 0


def one_path(forest, tree, row):
    node, depth = 0, 0
    while forest.feature[tree, node] >= 0:
        node, depth = 2 * node + (2 if row[forest.feature[tree, node]] > forest.value[tree, node] else 1), depth + 1
    return forest.length[tree, node], depth


def test_verdict_against_one_row_at_a_time(spark):
    """Path lengths, scores and verdicts by following each tree for each row."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        words = [rng.choice(["alpha", "beta", "of", "the", f"v{i % 40}", f"u{rng.randrange(500)}"]) for _ in range(rng.randint(30, 120))]
        rows.append((i, " ".join(w + "###" if i % 7 == 0 else w for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(300)], "doc_id long, quality int")
    stats = quality.statistics(docs)
    forest, cut = quality.fit(stats, labels)
    for tree in range(0, quality.TREES, 16):
        lengths = [one_path(forest, tree, x) for x in quality.features(quality.as_arrays(stats))]
        assert all(depth <= length <= depth + quality.average_path(quality.SUBSAMPLE) for length, depth in lengths)
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    table = quality.as_arrays(stats.orderBy("doc_id"))
    for i, x in enumerate(quality.features(table)):
        mean = np.mean([one_path(forest, t, x)[0] for t in range(quality.TREES)])
        score = 2.0 ** -(mean / float(quality.average_path(forest.m)))
        n, _, _, _, repeat = brute(rows[i][1])
        failed = n < 50 or 100 * repeat > 50 * n
        assert abs(got[i].anomaly - score) < 1e-5 and got[i].base_failed == failed
        if abs(score - cut) > 1e-9:
            assert got[i].kept == (not failed and score <= cut)


def test_samples_are_bounded(spark):
    many = spark.range(4000).selectExpr("id % 7 as doc_id", "id % 3 as x").union(spark.range(1000).selectExpr("id", "id as x"))
    assert quality.bounded(many, 100, "s").count() <= 100
