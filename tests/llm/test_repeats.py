"""Repeat removal against a table of all windows."""

import hashlib
import random

from thicket.llm import phrases, repeats

L = 20


def brute(rows, window=L):
    big = repeats.LAST
    texts = [(big if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in texts:
        for p in range(len(t) - window + 1):
            w = t[p : p + window]
            first[w] = min(first.get(w, (d, p)), (d, p))
    out = []
    for (d, t), (doc_id, _) in zip(texts, rows):
        gone = [False] * len(t)
        for p in range(len(t) - window + 1):
            if (d, p) > first[t[p : p + window]]:
                gone[p : p + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, parts=3, **kw):
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, data string").repartition(parts)
    return sorted((tuple(r) for r in repeats.remove_repeats(docs, L, 8, **kw).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    passage = ["".join(rng.choice("abé ") for _ in range(rng.randint(10, 70))) for _ in range(6)]
    rows = []
    for i in range(70):
        text = "".join(rng.choice(passage) if rng.random() < 0.4 else "".join(rng.choice("abcdefg ") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 8)))
        rows.append((rng.randint(0, 10**6), text))
    rows += rows[:5] + [(None, rows[7][1]), (None, rows[8][1] + "x"), (5, None), (6, ""), (7, "a" * 300), (8, "a" * 19), (9, "ab" * 400), (rows[9][0], rows[10][1])]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_long_texts_are_cut_with_an_overlap(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BITS", 9)
    rows = corpus(3)
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    b = repeats.Batch(batch, L, 8)
    covered = set()
    for p, doc, at in b.blocks():
        for d, a, n in zip(doc.tolist(), at.tolist(), (p.last - p.first + 1).tolist()):
            for k in range(n):
                assert (d, a + k) not in covered
                covered.add((d, a + k))
    assert covered == {(i, k) for i, (_, t) in enumerate(rows) for k in range(len((t or "").encode()) - L + 1)}


def test_equal_windows_have_equal_triggers():
    rng = random.Random(5)
    shared = bytes(rng.choice(b"abcdefgh ") for _ in range(60))
    seen = set()
    for _ in range(50):
        text = bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(0, 90)))
        p = phrases.Phrases([text + shared + text[::-1]], 40, 12)
        for k in range(21):
            s = len(text) + k
            i = [a <= s <= b for a, b in zip(p.first.tolist(), p.last.tolist())].index(True)
            seen.add((k, int(p.trigger[i]) - s, int(p.key[i])))
    assert len(seen) == 21


def test_empty_and_nothing_repeated(spark):
    assert run(spark, []) == []
    rows = [(1, "abcdefghijklmnopqrstuvwxyz"), (2, None)]
    assert run(spark, rows, 1) == brute(rows)


def test_all_texts_move_above_the_bound(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TELL_MOST", 0)
    rows = corpus(6)
    assert run(spark, rows) == brute(rows)
