"""SimHash near-dedup by a binary trie self-join.

Every text gets a 64-bit fingerprint of its word shingles. Equal fingerprints
are one row from then on. Two fingerprints are linked if they differ in at
most two bits; the pairs are found by walking pairs of nodes of a binary trie
together, adding up the bits in which they differ and leaving a pair as soon
as that passes the budget. Linked fingerprints form components.

The walk is dealt out by the trie's upper levels. Of four 16-bit blocks at
least two are equal in any linked pair, so six tries, one for each choice of
two blocks as the upper 32 levels, hold every pair below one of their nodes
at depth 32 with no error so far. A node with more than ``NODE_MOST``
fingerprints is dealt again: its lower 32 bits have four 8-bit blocks of
which two are equal, so again six tries, now of 16 levels; such a node holds
at most 65,536 different fingerprints, whatever the input.

Defined cases: a null or empty text has no words and the fingerprint zero;
fewer words than a shingle has make one shingle; a row without doc_id gets its
fingerprint and the component's smallest doc_id; equal rows stay separate rows
of one component; an empty table gives an empty result. Other columns of the
documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.components import components
from thicket.llm.texts import map_batches, texts_of, words
from thicket.scratch import materialize

SEED = 42
#: Shingles whose bits are added up at once.
BLOCK = 1 << 15
NODE_MOST = 2048
#: Node pairs that are expanded at once, and pairs of fingerprints compared one by one.
FRONTIER, LEAF = 1 << 18, 16
CHOICES = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def shingle_hashes(text: bytes | None, n: int = 3) -> Iterator[np.ndarray]:
    """XXH64 of the text's n-word shingles, in blocks."""
    found = words((text or b"").lower())
    if not found:
        return
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(found) < n:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(found) - n + 1], ends[n - 1 :]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), BLOCK):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; unsigned."""
    ones, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, n):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def f(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, n) for t in texts_of(batch, "text")], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, "doc_id long, fp long")


def blocks(value: np.ndarray, width: int, chosen: tuple[int, int]) -> np.ndarray:
    """``value`` of four ``width``-bit blocks with the chosen two in front."""
    order = [*chosen, *(k for k in range(4) if k not in chosen)]
    mask, out = np.uint64((1 << width) - 1), np.zeros_like(value)
    for k in order:
        out = (out << np.uint64(width)) | ((value >> np.uint64(width * (3 - k))) & mask)
    return out


def dealt(fp: np.ndarray, table: int) -> np.ndarray:
    """The fingerprint's bits in the order of a table's trie: 0 to 5, or 6 to 41 where dealt twice."""
    if table < 6:
        return blocks(fp, 16, CHOICES[table])
    first, second = divmod(table - 6, 6)
    once = blocks(fp, 16, CHOICES[first])
    low = np.uint64(0xFFFFFFFF)
    return (once & ~low) | blocks(once & low, 8, CHOICES[second])


def trie_pairs(value: np.ndarray, lo: np.ndarray, hi: np.ndarray, levels: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``value`` that differ in at most ``budget`` bits, both in one range.

    value: uint64, ascending and distinct within each range lo..hi, equal there
    but for the last ``levels`` bits. A trie node is a range of ``value``; a
    node pair is two of them with the bits in which they differ so far.
    """
    stack = [(levels - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            for s in (slice(0, half), slice(half, None)):
                stack.append((bit, *(x[s] for x in (alo, ahi, blo, bhi, err))))
            continue
        small = (ahi - alo) * (bhi - blo) <= LEAF if bit >= 0 else np.ones(len(alo), bool)
        if small.any():
            na, nb = (ahi - alo)[small], (bhi - blo)[small]
            at = np.repeat(np.arange(len(na)), na * nb)
            k = np.arange(len(at)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            x, y = alo[small][at] + k // nb[at], blo[small][at] + k % nb[at]
            near = (x < y) & (np.bitwise_count(value[x] ^ value[y]) <= budget)
            yield x[near], y[near]
        keep = ~small
        if not keep.any():
            continue
        alo, ahi, blo, bhi, err = (x[keep] for x in (alo, ahi, blo, bhi, err))
        before = np.concatenate([[0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (before[ahi] - before[alo]), bhi - (before[bhi] - before[blo])
        own = alo == blo
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        parts.append(tuple(x[~own] for x in (amid, ahi, blo, bmid, err + 1)))  # of a node with itself, the mirror of the one before
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (alo < ahi) & (blo < bhi) & (err <= budget) & ~((alo == blo) & (ahi - alo < 2))
        stack.append((bit - 1, *(x[live] for x in (alo, ahi, blo, bhi, err))))


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs' components, each member but the first with the first."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    touched: set[int] = set()
    for xs, ys in pairs:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                touched.update((x, y))
    members = [i for i in sorted(touched) if find(i) != i]
    return np.array(members, np.int64), np.array([find(i) for i in members], np.int64)


def links_of(table: np.ndarray, key: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links below the nodes (table, key); fingerprints are distinct within a node."""
    value = np.zeros_like(fp)
    for t in np.unique(table):
        value[table == t] = dealt(fp[table == t], int(t))
    order = np.lexsort((value, key, table))
    table, key, fp, value = table[order], key[order], fp[order], value[order]
    start = np.flatnonzero(np.concatenate([[True], (table[1:] != table[:-1]) | (key[1:] != key[:-1])]))
    end = np.append(start[1:], len(fp))
    many = end - start > 1
    a, b = spanning(trie_pairs(value, start[many], end[many], 32, budget), len(fp))
    return fp[b], fp[a]


def walk_partition(budget: int):
    """Over a partition sorted by (table, key): links of each node, whatever the batches' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = links_of(*cols, budget)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            cols = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)).view(np.uint64)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1:].max(initial=-1)) + 1
            held = [c[last:] for c in cols]
            if last:
                yield out([c[:last] for c in cols])
        if held is not None and len(held[0]):
            yield out(held)

    return run


def block_at(value: F.Column, width: int, k: int) -> F.Column:
    return F.shiftrightunsigned(value, width * (3 - k)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def similar_links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """a, b: links that connect the distinct ``fp`` of ``fps`` as all pairs within ``budget`` (at most 2) do."""
    if budget > 2:
        raise ValueError("the six tries find pairs with up to two differing bits")
    fp = F.col("fp")
    tables = F.array(*(F.struct(F.lit(t).alias("table"), (block_at(fp, 16, i) * 65536 + block_at(fp, 16, j)).alias("key")) for t, (i, j) in enumerate(CHOICES)))
    rows = fps.select(F.explode(tables).alias("t"), "fp").select("t.table", "t.key", "fp")
    large = materialize(rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NODE_MOST).select("table", "key"), "large-nodes")
    if large.head(1):
        hot = rows.join(large, ["table", "key"])
        low = F.lit(0).cast("long")
        for t, chosen in enumerate(CHOICES):
            rest = [k for k in range(4) if k not in chosen]
            low = F.when(F.col("table") == t, block_at(fp, 16, rest[0]) * 65536 + block_at(fp, 16, rest[1])).otherwise(low)
        again = F.array(*(F.struct((6 + F.col("table") * 6 + t).alias("table"), (F.col("key") * 65536 + block_at(F.col("low"), 8, i) * 256 + block_at(F.col("low"), 8, j)).alias("key")) for t, (i, j) in enumerate(CHOICES)))
        deeper = hot.withColumn("low", low).select(F.explode(again).alias("t"), "fp").select("t.table", "t.key", "fp")
        rows = rows.join(large, ["table", "key"], "left_anti").unionByName(deeper)
    return rows.repartition("table", "key").sortWithinPartitions("table", "key").mapInArrow(walk_partition(budget), "a long, b long")


def components_of(prints: DataFrame, budget: int = 2) -> DataFrame:
    """``prints`` (doc_id, fp and any other columns) with component_id: the smallest doc_id reachable."""
    each = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(similar_links(each.select("fp"), budget)).toDF("fp", "root")
    rooted = each.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(rooted.join(lowest, "root").select("fp", "component_id"), "component-of")
    return prints.join(of, "fp").select(*prints.columns, "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``documents``."""
    prints = materialize(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "prints")
    return components_of(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
