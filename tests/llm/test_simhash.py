"""SimHash near-dedup against all pairs."""

import random

import numpy as np
import xxhash

from thicket.llm import simhash


def brute(rows, budget=2):
    prints = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    low = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            low[c] = min(d, low.get(c, d))
    return sorted(((d, f"{p:016x}", low.get(c)) for (d, _), p, c in zip(rows, prints, comp)), key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    prints = simhash.fingerprints(docs)
    out = simhash.components_of(prints).collect()
    return sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in out), key=repr)


def test_documents_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}é" for i in range(40)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 30, 200]))]
        rows.append((i * 3, " ".join(words)))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "X"
            rows.append((i * 3 + 1, "\n".join(words)))
    rows += [(500, None), (499, ""), (501, "  "), (None, rows[0][1]), (rows[3][0], rows[3][1]), (600, "A b C"), (601, "a  B c"), (700, "long " * 40000)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def pairs_brute(values, budget):
    return {(min(a, b), max(a, b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= budget}


def test_trie_walk_finds_all_pairs():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = set(base)
    while len(values) < 400:
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    value = np.array(sorted(values), np.uint64)
    for budget in (0, 1, 2, 3):
        got = set()
        for x, y in simhash.trie_pairs(value, np.array([0]), np.array([len(value)]), 64, budget):
            got |= {(int(value[a]), int(value[b])) for a, b in zip(x, y)}
        assert got == pairs_brute(sorted(values), budget)


def test_large_nodes_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_MOST", 10)
    rng = random.Random(3)
    values = {0x1234567890ABCDEF}
    while len(values) < 300:
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 3)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    out = simhash.components_of(spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, fp long")).collect()
    comp = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert [r.component_id for r in sorted(out, key=lambda r: r.doc_id)] == comp
