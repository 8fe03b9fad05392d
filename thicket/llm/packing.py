"""Variable-capacity best-fit packing of documents into training sequences.

Bins may have any of several capacities and stay open. Largest items go first,
each into the open bin with the least room that holds it. Where none does, the
bin size is opened that costs least for each token: the items that a new bin
of each capacity would hold are taken from those that are neither placed nor
foreseen for a bin opened before. Finally each bin shrinks to the smallest
permitted capacity that holds its contents.

Only sizes matter to the packing, and there are no more different sizes than
the largest capacity: the plan is made from the histogram of sizes, for all
bins of equal contents at once, and places each item where one item at a time
would be placed. So the plan takes the same memory for any number of
documents, is the same on every run, and packs the whole corpus together, not
shard by shard. Items then look up their bin by their rank among the items of
their size.

Defined cases: a document longer than the largest capacity is cut into pieces
of that capacity and a rest; a document without words (or a null text) has no
tokens, goes to no bin (bin and capacity null) and stays in the result;
repeated rows are items of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.mixing import words
from thicket.operators.order import global_rank

CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its tokens, in tokens.
OVERHEAD = 16


def plain_cost(capacity: int) -> float:
    return capacity + OVERHEAD


class Plan:
    """For each size, the rank intervals of its items and where they go.

    start: first rank; each: items of this size in a bin; first_bin, offset: of
    the interval's bins. bin_start, bin_used, bin_capacity: of runs of bins
    with equal contents.
    """

    def __init__(self, histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = plain_cost):
        self.capacities, self.cost = sorted(capacities), cost
        if histogram and not 1 <= min(histogram) <= max(histogram) <= self.capacities[-1]:
            raise ValueError("sizes must be between 1 and the largest capacity")
        self.bins = 0
        #: Runs of open bins (first, number, used) by their room, and the rooms in order.
        self._open: dict[int, list[tuple[int, int, int]]] = {}
        self._rooms: list[int] = []
        foreseen = Foreseen(histogram)
        rows = []
        for s in sorted(histogram, reverse=True):
            left, taken = histogram[s], 0
            foreseen.left[s] = left
            while left:
                at = bisect_left(self._rooms, s)
                if at == len(self._rooms):
                    foreseen.left[s] = left
                    capacity, n = self._cheapest(s, foreseen)
                    self._keep(capacity, self.bins, n, 0)
                    self.bins += n
                    continue
                room = self._rooms[at]
                first, number, used = self._open[room].pop()
                if not self._open[room]:
                    del self._open[room], self._rooms[at]
                # the tightest bin takes items until none fits, as its room only becomes less
                each = room // s
                full = min(number, left // each)
                runs = [(full, each)] if full else []
                if full < number and full * each < left:
                    runs.append((1, left - full * each))
                for n, k in runs:
                    rows.append((s, taken, k, first, used))
                    self._keep(room - k * s, first, n, used + k * s)
                    first, number, taken, left = first + n, number - n, taken + n * k, left - n * k
                if number:
                    self._keep(room, first, number, used)
            del foreseen.left[s]
            foreseen.sizes.pop()
        rows.sort()
        self.size, self.start, self.each, self.first_bin, self.offset = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [()] * 5))
        runs = sorted(run for held in self._open.values() for run in held)
        self.bin_start, self.bin_count, self.bin_used = (np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else [()] * 3))
        self.bin_capacity = np.array(self.capacities, np.int64)[np.searchsorted(self.capacities, self.bin_used)]

    def _keep(self, room: int, first: int, number: int, used: int) -> None:
        if room not in self._open:
            insort(self._rooms, room)
            self._open[room] = []
        self._open[room].append((first, number, used))

    def _cheapest(self, s: int, foreseen: "Foreseen") -> tuple[int, int]:
        """The capacity to open for size ``s``, and how many bins of equal foreseen contents."""
        offers = []
        for capacity in self.capacities:
            if capacity >= s:
                pattern, used = foreseen.fill(capacity)
                offers.append((self.cost(next(c for c in self.capacities if c >= used)) / used, capacity, pattern))
        _, capacity, pattern = min(offers)
        n = min(foreseen.left[z] // k for z, k in pattern)
        for z, k in pattern:
            foreseen.left[z] -= n * k
        return capacity, n

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """bin, offset, capacity of the rank-th item of a size."""
        wide = np.int64(1) << 40
        at = np.searchsorted(self.size * wide + self.start, size * wide + rank, "right") - 1
        k = rank - self.start[at]
        to = self.first_bin[at] + k // self.each[at]
        return to, self.offset[at] + k % self.each[at] * size, self.bin_capacity[np.searchsorted(self.bin_start, to, "right") - 1]


class Foreseen:
    """The items that no bin so far was opened for, by size; the largest size is the one to be placed."""

    def __init__(self, histogram: dict[int, int]):
        self.left, self.sizes = dict(histogram), sorted(histogram)

    def fill(self, room: int) -> tuple[list[tuple[int, int]], int]:
        """What a new bin would hold: the largest items that fit, again and again."""
        pattern, whole = [], room
        at = len(self.sizes)
        while room and (at := bisect_right(self.sizes, room, 0, at)):
            at -= 1
            s = self.sizes[at]
            if k := min(self.left[s], room // s):
                pattern.append((s, k))
                room -= s * k
        return pattern, whole - room


def items(docs: DataFrame, tokens: str, most: int) -> DataFrame:
    """doc_id, piece, start, size: documents cut at the largest capacity; one row of size 0 without tokens."""
    n = F.col(tokens).cast("long")
    pieces = F.when(n > most, F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / most).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    cut = docs.select("doc_id", n.alias("_pack_n"), F.explode(pieces).alias("piece"))
    return cut.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("_pack_n") - F.col("piece") * most).alias("size"))


def pack(docs: DataFrame, tokens: str, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = plain_cost) -> DataFrame:
    """doc_id, piece, start, size, bin, offset, capacity of each piece of ``docs`` (doc_id, ``tokens``)."""
    ranked = global_rank(items(docs, tokens, max(capacities)), [F.col(c).asc_nulls_last() for c in ("size", "doc_id", "piece")], "_pack_at")
    # one row a size: max(capacities) + 1 at most
    histogram = {r["size"]: r["n"] for r in ranked.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = np.zeros(max(capacities) + 2, np.int64), 0
    for s in sorted(histogram):
        before[s] = total
        total += histogram[s]
    plan = Plan({s: n for s, n in histogram.items() if s > 0}, capacities, cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            none = size == 0
            out = [np.zeros(len(size), np.int64) for _ in range(3)]
            for o, x in zip(out, plan.find(size[~none], (at - before[size])[~none]) if len(plan.size) else [0] * 3, strict=True):
                o[~none] = x
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(o, mask=none) for o in out)], ["doc_id", "piece", "start", "size", "bin", "offset", "capacity"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "size", "_pack_at").mapInArrow(run, f"doc_id {kind}, piece long, start long, size long, bin long, offset long, capacity long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each row of ``documents`` stands; a token is a word here."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs.select("doc_id", words(F.col("text")).alias("tokens")), "tokens")
