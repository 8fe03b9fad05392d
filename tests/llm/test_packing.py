"""Best-fit packing: an exact plan check and a comparison with item-by-item packing."""

import random

import pytest

from thicket.llm import packing as P


def check(rows, capacities):
    """No overlaps, nothing beyond a bin, each bin as small as its contents allow."""
    bins: dict = {}
    for r in rows:
        if r.bin is None:
            assert r["size"] == 0 and r.capacity is None
        else:
            bins.setdefault(r.bin, []).append(r)
    for items in bins.values():
        capacity = {r.capacity for r in items}
        assert len(capacity) == 1
        at = 0
        for r in sorted(items, key=lambda r: r.offset):
            assert r.offset == at
            at += r["size"]
        (capacity,) = capacity
        assert capacity == min(c for c in capacities if c >= at)
    return bins


@pytest.mark.parametrize("seed", [1, 2])
def test_every_token_is_in_one_place(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(0, 60), rng.randrange(0, 700), rng.randrange(0, 9000)]) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")
    rows = P.pack(docs, "tokens").collect()
    bins = check(rows, P.CAPACITIES)
    for i, n in enumerate(sizes):
        pieces = sorted((r.start, r["size"]) for r in rows if r.doc_id == i)
        assert sum(s for _, s in pieces) == n and [s for s, _ in pieces] == [k * 4096 for k in range(len(pieces))]
    used, room = sum(sizes), sum(b[0].capacity for b in bins.values())
    assert used / room > 0.97
    assert sorted(map(tuple, rows)) == sorted(map(tuple, P.pack(docs.repartition(7), "tokens").collect()))


def test_the_cost_decides_among_bin_sizes():
    cheap_small = P.Plan({10: 8}, (10, 40), lambda c: {10: 1.0, 40: 100.0}[c])
    assert set(cheap_small.bin_capacity.tolist()) == {10} and cheap_small.bins == 8
    cheap_large = P.Plan({10: 8}, (10, 40), lambda c: {10: 100.0, 40: 1.0}[c])
    assert cheap_large.bins == 2 and set(cheap_large.bin_capacity.tolist()) == {40}
    # 30 + 10 fill a bin of 40 that is foreseen; the last 30 has nothing to go with and takes the smaller bin
    mixed = P.Plan({30: 2, 10: 1}, (32, 40), lambda c: float(c))
    assert sorted(mixed.bin_capacity.tolist()) == [32, 40]
    with pytest.raises(ValueError):
        P.Plan({50: 1}, (10, 40))


def one_by_one(sizes, capacities, cost):
    """Best fit with one item at a time; a bin is opened where the plan's own rule says so."""
    plan = P.Plan({}, capacities, cost)
    histogram = {s: sizes.count(s) for s in set(sizes)}
    foreseen = P.Foreseen(histogram)
    bins: list[list[int]] = []  # room, used
    for s in sorted(histogram, reverse=True):
        for k in range(histogram[s]):
            fit = [b for b in bins if b[0] >= s]
            if not fit:
                foreseen.left[s] = histogram[s] - k
                capacity, n = plan._cheapest(s, foreseen)
                bins += [[capacity, 0] for _ in range(n)]
                fit = bins[-n:]
            tightest = min(fit, key=lambda b: b[0])
            tightest[0] -= s
            tightest[1] += s
        del foreseen.left[s]
        foreseen.sizes.pop()
    return sorted(used for _, used in bins)


@pytest.mark.parametrize("seed", range(12))
def test_same_bins_as_item_by_item(seed):
    rng = random.Random(seed)
    capacities = [(100,), (100,), (32, 64, 100), (50, 100)][seed % 4]
    most = rng.choice([20, 60, 100])
    sizes = [rng.randrange(1, most + 1) for _ in range(rng.choice([20, 300, 700]))]
    plan = P.Plan({s: sizes.count(s) for s in set(sizes)}, capacities)
    used = sorted(u for u, n in zip(plan.bin_used.tolist(), plan.bin_count.tolist(), strict=True) for _ in range(n))
    assert used == one_by_one(sizes, capacities, P.plain_cost) and len(used) == plan.bins
    assert sum(used) == sum(sizes)
    if len(capacities) == 1:  # the plain rule: the tightest open bin, else a new one
        rooms: list[int] = []
        for s in sorted(sizes, reverse=True):
            fit = [i for i, r in enumerate(rooms) if r >= s]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= s
            else:
                rooms.append(100 - s)
        assert sorted(100 - r for r in rooms) == used


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, 5), (1, 0), (2, 4096), (2, 4097), (3, 10_000_000)], "doc_id long, tokens long")
    rows = P.pack(docs, "tokens").collect()
    check(rows, P.CAPACITIES)
    assert sum(r["size"] for r in rows) == 5 + 4096 + 4097 + 10_000_000
    assert P.pack(docs.limit(0), "tokens").count() == 0
    assert P.pack(docs.where("tokens = 0"), "tokens").first().bin is None
