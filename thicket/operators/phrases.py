"""Phrases in token arrays.

A phrase table has rows (phrase_id, tokens). Overlapping matches are found
without Python: the windows of the lengths that occur are joined to the
phrases. Leftmost longest matches need a walk from left to right and take a
trie in Python workers, or beyond a bound the join's matches.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from thicket.functions.batches import parts
from thicket.functions.text import merge_positions
from thicket.scratch import materialize

#: A phrase table with up to so many rows is broadcast (some 100 bytes each).
BROADCAST_PHRASES = 100_000
#: Different first tokens of phrases that are looked for before windows are made.
FIRST_TOKENS = 1_000
#: Tokens that a worker walks at a time (some 100 bytes each, and as many for what is found).
PART_TOKENS = 200_000


class Trie:
    """A prefix map from token sequences to values; a later value of one key replaces the former."""

    def __init__(self, entries: Sequence[tuple[Sequence[Hashable], object]] = ()):
        self.root: dict = {}
        for key, value in entries:
            self.insert(key, value)

    _END = object()

    def insert(self, key: Sequence[Hashable], value: object) -> None:
        node = self.root
        for x in key:
            node = node.setdefault(x, {})
        node[Trie._END] = value

    def lookup(self, key: Sequence[Hashable]) -> object | None:
        node = self.root
        for x in key:
            if (node := node.get(x)) is None:
                return None
        return node.get(Trie._END)

    def items(self) -> Iterator[tuple[tuple, object]]:
        stack: list[tuple[tuple, dict]] = [((), self.root)]
        while stack:
            prefix, node = stack.pop()
            for k, v in node.items():
                if k is Trie._END:
                    yield prefix, v
                else:
                    stack.append(((*prefix, k), v))

    def union(self, other: Trie, combine: Callable[[object, object], object] = lambda a, b: a) -> Trie:
        out = Trie(list(self.items()))
        for k, v in other.items():
            have = out.lookup(k)
            out.insert(k, v if have is None else combine(have, v))
        return out

    def longest(self, tokens: Sequence[Hashable], start: int) -> tuple[int, object] | None:
        """End and value of the longest key that begins at ``start``."""
        node, best = self.root, None
        for i in range(start, len(tokens)):
            if (node := node.get(tokens[i])) is None:
                break
            if Trie._END in node:
                best = (i + 1, node[Trie._END])
        return best

    def sequential(self, tokens: Sequence[Hashable], matched: bool = False) -> Iterator[tuple[int, int, object | None]]:
        """start, end, value of leftmost longest matches; value None for a token outside any, which ``matched`` leaves out."""
        if matched:
            end = 0
            for i in [i for i, t in enumerate(tokens) if t in self.root]:
                if i >= end and (found := self.longest(tokens, i)):
                    end = found[0]
                    yield i, *found
            return
        i = 0
        while i < len(tokens):
            end, value = self.longest(tokens, i) or (i + 1, None)
            yield i, end, value
            i = end


def shifted(array: Column, k: int) -> Column:
    """Array of structs of ``k`` elements in a row, as fields "0" to "k-1".

    Zipping the array with itself reads it ``k`` times in all; looking elements
    up by place would evaluate it anew for each of them.
    """
    n = F.greatest(F.size(array) - (k - 1), F.lit(0))
    return F.arrays_zip(*(F.slice(array, i + 1, n).alias(str(i)) for i in range(k)))


def _runs(tokens: str, k: int) -> Column:
    """Array of (start, phrase_tokens): the runs of ``k`` tokens."""
    return F.transform(shifted(F.coalesce(tokens, F.array().cast("array<string>")), k), lambda z, i: F.struct(i.alias("start"), F.array(*(z.getField(str(j)) for j in range(k))).alias("phrase_tokens")))


def windows(docs: DataFrame, lengths: Sequence[int], tokens: str = "tokens", first: Sequence[str] | None = None) -> DataFrame:
    """doc columns, start, phrase_tokens: each run of as many tokens as a phrase can have, which begins with one of ``first``."""
    begins = (lambda runs: runs) if first is None else (lambda runs: F.filter(runs, lambda r: r["phrase_tokens"][0].isin(first)))
    found = F.concat(*(begins(_runs(tokens, k)) for k in lengths))
    return docs.withColumn("_w", F.explode(found)).select(*docs.columns, "_w.start", "_w.phrase_tokens")


def phrase_lengths(phrases: DataFrame) -> list[int]:
    """The lengths that occur, which are few."""
    return sorted(r[0] for r in phrases.select(F.size("tokens")).distinct().collect() if r[0] > 0)


def overlapping(docs: DataFrame, phrases: DataFrame, tokens: str = "tokens") -> DataFrame:
    """doc columns without the tokens, phrase_id, start, length: every phrase at every place."""
    lengths = phrase_lengths(phrases)
    table = phrases.select("phrase_id", F.col("tokens").alias("phrase_tokens"))
    if not lengths:
        return docs.drop(tokens).withColumn("_none", F.lit(0)).join(table.limit(0), F.lit(False)).select(*(c for c in docs.columns if c != tokens), "phrase_id", F.lit(0).alias("start"), F.lit(0).alias("length"))
    if phrases.count() <= BROADCAST_PHRASES:
        table = F.broadcast(table)
    first = [r[0] for r in phrases.where(F.size("tokens") > 0).select(F.col("tokens")[0]).distinct().limit(FIRST_TOKENS + 1).collect()]
    found = windows(docs, lengths, tokens, first if len(first) <= FIRST_TOKENS and None not in first else None).join(table, "phrase_tokens")
    return found.select(*(c for c in docs.columns if c != tokens), "phrase_id", "start", F.size("phrase_tokens").alias("length"))


def phrase_positions(docs: DataFrame, phrases: DataFrame, terms: str = "terms") -> DataFrame:
    """doc_id, phrase_id, position: phrases among filtered terms (an array of structs with ``term`` and a position).

    Dropped words don't part what stands beside them; a phrase's position runs
    from its first to its last term.
    """
    named = docs.select("doc_id", terms, F.transform(terms, lambda x: x["term"]).alias("_tokens"))
    found = overlapping(named, phrases, "_tokens")
    return found.select("doc_id", "phrase_id", merge_positions(F.slice(F.col(terms), F.col("start") + 1, F.col("length"))).alias("position"))


def contains_all(tokens: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, sorted(set(wanted)))))) == len(set(wanted))


def longest_matches(docs: DataFrame, phrases: DataFrame, tokens: str = "tokens", matched: bool = False) -> DataFrame:
    """doc_id, start, end, phrase_id (null outside any phrase): leftmost longest, without overlaps.

    With ``matched`` the tokens outside any phrase have no rows.

    Of equal phrases the largest id counts; phrases without tokens match
    nothing. Up to ``BROADCAST_PHRASES`` phrases travel to every worker as a
    trie; more are joined with the documents' windows.
    """
    distinct = phrases.where(F.size("tokens") > 0).groupBy("tokens").agg(F.max("phrase_id").alias("phrase_id"))
    named = docs.select("doc_id", F.col(tokens).alias("tokens"))
    if distinct.count() > BROADCAST_PHRASES:
        return longest_joined(named, distinct, matched)
    kind = phrases.schema["phrase_id"].dataType
    entries = [(tuple(r.tokens), r.phrase_id) for r in distinct.collect()]
    held = docs.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(held.value)
        for batch in (p for b in batches for p in parts(b, 1, PART_TOKENS)):
            yield _match_rows(batch.column(0), (trie.sequential(row or [], matched) for row in batch.column(1).to_pylist()), to_arrow_type(kind))

    return named.mapInArrow(run, _match_schema(docs, kind))


def _match_schema(docs: DataFrame, kind: T.DataType) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, end int, phrase_id {kind.simpleString()}"


def _match_rows(ids: pa.Array, found: Iterable[Iterable[tuple[int, int, object]]], kind: pa.DataType) -> pa.RecordBatch:
    of, starts, ends, values = [], [], [], []
    for i, row in enumerate(found):
        for start, end, value in row:
            of.append(i)
            starts.append(start)
            ends.append(end)
            values.append(value)
    columns = [ids.take(pa.array(of, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, kind)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "phrase_id"])


def longest_joined(docs: DataFrame, phrases: DataFrame, matched: bool = False) -> DataFrame:
    """``longest_matches`` of documents (doc_id, tokens) for distinct phrases of any number.

    The longest phrase at each place comes from a join; then one document's
    places at a time are walked from left to right. With ``matched`` documents
    and tokens outside any phrase have no rows, and the tokens aren't met again.
    """
    kind = phrases.schema["phrase_id"].dataType
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "phrase-rows")
    key = ["_row", "doc_id"] if matched else ["_row"]
    places = overlapping(rows.select(*key, "tokens"), phrases).groupBy(*key, "start").agg(F.max(F.struct("length", "phrase_id")).alias("m"))
    longest = places.groupBy(*key).agg(F.collect_list(F.struct("start", (F.col("start") + F.col("m.length")).alias("end"), F.col("m.phrase_id").alias("value"))).alias("places"))
    if matched:
        joined = longest.select("doc_id", F.lit(0).alias("n"), "places")
    else:
        joined = rows.join(longest, "_row", "left").select("doc_id", F.coalesce(F.size("tokens"), F.lit(0)).alias("n"), "places")

    def walk(n: int, places: list[dict]) -> Iterator[tuple[int, int, object]]:
        if matched:
            end = 0
            for p in sorted(places, key=lambda p: p["start"]):
                if p["start"] >= end:
                    end = p["end"]
                    yield p["start"], end, p["value"]
            return
        at = {p["start"]: (p["end"], p["value"]) for p in places}
        i = 0
        while i < n:
            end, value = at.get(i, (i + 1, None))
            yield i, end, value
            i = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield _match_rows(batch.column(0), (walk(n, places or []) for n, places in pairs), to_arrow_type(kind))

    return joined.mapInArrow(run, _match_schema(docs, kind))


def phrase_table(spark: SparkSession, phrases: dict[str, Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in phrases.items()], "phrase_id string, tokens array<string>")
