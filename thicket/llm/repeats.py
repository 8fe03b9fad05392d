"""Removal of repeated strings by prefix-free parsing.

Every byte covered by a ``window``-byte string that also starts earlier (in a
document with a smaller doc_id, or earlier in the same one) goes. Equivalent:
of the windows with the same bytes all but the first in corpus order are
marked, and the marked windows' bytes are cut.

Rolling-hash triggers cut the texts into phrases (``phrases.py``), each the
place of a run of windows. The dictionary is the set of different phrases with
the place of the first; the parse is what a text's phrases are in it. Both are
kept in the order of 127-bit fingerprints and not of the bytes: which windows
are equal, and which comes first in the corpus, is all that is asked, and an
order of all suffixes by their bytes would have to move every suffix's bytes.

The texts are scanned four times, and what moves is packed fingerprints:

1. each batch sends the keys (trigger grams) of its phrases once; keys in two
   batches, or with different phrases in one, are repeated;
2. each batch sends its first phrase of every repeated key; a key whose
   phrases are all equal is settled, its later phrases are marked whole; the
   other keys are contested (their phrases agree in part at most);
3. contested phrases are cut into cells of up to ``CELL`` windows that share a
   core of bytes, and the cells are treated as the phrases were, by core;
4. each batch sends the windows of its contested cells, once each; of equal
   windows the later ones are marked.

Within a batch the later of equal phrases or windows are marked at once, so a
key sends one row a batch whatever share of the corpus holds it. Repeated and
contested keys travel as bit filters of bounded size (``FILTER_BITS``); false
hits cost rows and change no result. Texts move once, at the end, and only
those that lose bytes where these can be told apart cheaply (``TELL_MOST``).

Defined cases: a null or empty text has 0 bytes and loses none; a null doc_id
stands after all others; rows that repeat a doc_id count as one place, so the
same start in both is neither's earlier one; texts longer than a block are cut
with an overlap; an empty table gives an empty result. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.parts import slots, tasks_for
from thicket.llm.phrases import BLOCK_BITS, Phrases, mixed
from thicket.llm.texts import give_back, portions, texts_of
from thicket.scratch import materialize

WINDOW, GRAM, CELL = 100, 56, 16
LAST = (1 << 63) - 1
#: Bits of a key filter at most: 32 MB.
FILTER_BITS = 28
#: Bytes of text whose phrases are sorted at once.
PORTION = 12 << 20
#: Documents with marks are told apart by a broadcast up to so many (16 bytes each); above, all texts move.
TELL_MOST = 1_000_000
SCHEMA = "part int, doc_id long, tag long, data binary"

Columns = tuple[np.ndarray, ...]


class Batch:
    """An Arrow batch of (doc_id, text) as blocks of phrases."""

    def __init__(self, batch: pa.RecordBatch, window: int, gram: int):
        self.texts = [t or b"" for t in texts_of(batch, "text")]
        self.ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
        self.tags = np.array([zlib.crc32(t) for t in self.texts], np.int64)
        self.window, self.gram = window, gram

    def pieces(self) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        room = (1 << BLOCK_BITS) - 1
        docs, at, cut, used = [], [], [], 0
        for i, text in enumerate(self.texts):
            start = 0
            while len(text) - start >= self.window:
                piece = text[start : start + room]
                if used + len(piece) > room:
                    yield docs, at, cut
                    docs, at, cut, used = [], [], [], 0
                docs.append(i)
                at.append(start)
                cut.append(piece)
                used += len(piece)
                if start + len(piece) == len(text):
                    break
                start += len(piece) - self.window + 1
        if cut:
            yield docs, at, cut

    def blocks(self) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray]]:
        """Phrases with each one's document (its index here) and first start in it."""
        for docs, at, cut in self.pieces():
            p = Phrases(cut, self.window, self.gram)
            if len(p.first):
                yield p, np.array(docs)[p.text], p.first - p.start[p.text] + np.array(at)[p.text]


def joined(columns: list[Columns], kinds: str) -> Columns:
    if not columns:
        return tuple(np.zeros(0, k) for k in kinds.split())
    return tuple(np.concatenate(x) for x in zip(*columns, strict=True))


def firsts(new: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For rows in order of (group, doc, at), where groups begin at ``new``: which stand at their group's first place."""
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    return (doc == doc[head]) & (at == at[head])


def changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def merged(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, n: np.ndarray) -> Columns:
    """Marked windows in order, those in a row made one run."""
    order = np.lexsort((at, tag, doc))
    doc, tag, at, n = (x[order].astype(np.int64) for x in (doc, tag, at, n))
    new = changes(doc, tag)
    # the furthest end so far; runs of other documents lie below by their number
    base = np.cumsum(new) << 40
    end = np.maximum.accumulate(base + at + n) if len(doc) else at
    gap = new.copy()
    gap[1:] |= (base + at)[1:] > end[:-1]
    start = np.flatnonzero(gap)
    stop = end[np.append(start[1:], len(doc)) - 1] - base[start] if len(doc) else at
    return doc[start], tag[start], at[start], stop - at[start]


def marked(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, n: np.ndarray, parts: np.ndarray) -> dict | None:
    """Marks, packed by the part of their documents."""
    doc, tag, at, n = merged(doc, tag, at, n)
    out = sent((doc, tag.astype(np.uint32), at.astype(np.uint32), n.astype(np.uint32)), mixed(doc.view(np.uint64) + tag.astype(np.uint64)), parts)
    return out and out | {"doc_id": pc.cast(out["part"], pa.int64())}


def sent(columns: Columns, route: np.ndarray, parts: np.ndarray) -> dict | None:
    """Packed columns by part, a row for each of ``parts`` that gets any; ``route`` is a hash whose upper bits choose it."""
    if not len(route):
        return None
    part = ((route >> np.uint64(40)) * np.uint64(len(parts)) >> np.uint64(24)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, columns = part[order], tuple(c[order] for c in columns)
    cut = np.flatnonzero(changes(part))
    ends = np.append(cut[1:], len(part))
    data = [len_prefixed([c[a:b] for c in columns]) for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
    none = pa.nulls(len(cut), pa.int64())
    return {"part": pa.array(parts[part[cut]]), "doc_id": none, "tag": none, "data": pa.array(data, pa.binary())}


def len_prefixed(columns: list[np.ndarray]) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(c.tobytes() for c in columns)


def unpacked(data: bytes, kinds: str) -> Columns:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds.split():
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return tuple(out)


def scan(docs: DataFrame, f: Callable[[Batch], Iterator[dict | None]], window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, most=PORTION):
                for out in f(Batch(part, window, gram)):
                    if out is not None:
                        yield pa.RecordBatch.from_pydict(out)
        give_back()

    return docs.mapInArrow(run, SCHEMA)


def gather(rows: DataFrame, tasks: int, kinds: str, f: Callable[[Columns], Iterator[dict | None]], schema: str = SCHEMA) -> DataFrame:
    """Each part's packed columns together in one task; rows that are marks already pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = []
        for batch in batches:
            marks = batch.filter(batch.column(1).is_valid())
            if marks.num_rows:
                yield marks
            for valid, data in zip(batch.column(1).is_valid(), batch.column(3), strict=True):
                if not valid.as_py():
                    have.append(unpacked(data.as_buffer().to_pybytes(), kinds))
        whole = joined(have, kinds)
        have.clear()
        for out in f(whole):
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)
        del whole
        give_back()

    return rows.repartition(tasks, "part").mapInArrow(run, schema)


def phrase_columns(blocks: Iterator[tuple[Phrases, np.ndarray, np.ndarray]]) -> Columns:
    """key, whole, document, first start, windows of the blocks' phrases or cells."""
    return joined([(p.key >> np.uint64(1), p.whole, doc, at, p.last - p.first + 1) for p, doc, at in blocks], "u8 u8 i8 i8 i8")


def first_of(b: Batch, p: Phrases, doc: np.ndarray, at: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Of the picked phrases' equal ones in a block, those at the first place."""
    pick = pick[np.lexsort((at[pick], b.ids[doc[pick]], p.whole[pick], p.key[pick]))]
    return pick[firsts(changes(p.key[pick], p.whole[pick]), b.ids[doc[pick]], at[pick])]


def cell_blocks(b: Batch, wanted: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray]]:
    """The cells of the phrases with a wanted key."""
    for p, doc, at in b.blocks():
        pick = first_of(b, p, doc, at, np.flatnonzero(wanted(p.key >> np.uint64(1))))
        if len(pick):
            n = p.first[pick]
            c = p.cells(pick, CELL)
            of = np.searchsorted(np.sort(n), c.first, "right") - 1
            back = np.argsort(n)[of]
            yield c, doc[pick][back], at[pick][back] + c.first - n[back]


def key_filter(rows: DataFrame, most: int = 63) -> Callable[[np.ndarray], np.ndarray] | None:
    """A test for the 63-bit keys in ``rows`` (data: packed keys, of which the upper ``most`` bits count); None if there are none.

    The bits are set in parts by the keys' upper bits, each part in one task,
    and meet in the driver: 2**FILTER_BITS of them at most.
    """
    spark = rows.sparkSession
    n = rows.select(F.sum(F.length("data") / 8)).first()[0]
    if not n:
        return None
    bits = min(FILTER_BITS, most, max(16, int(np.ceil(np.log2(16 * n)))))
    part_bits = max(0, bits - 20)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.concatenate([np.frombuffer(x.as_buffer().to_pybytes(), np.uint64) for x in batch.column(0)])
            place = np.unique(keys >> np.uint64(63 - bits)).astype(np.int64)
            part = place >> (bits - part_bits)
            cut = np.flatnonzero(changes(part))
            yield pa.RecordBatch.from_pydict({"part": pa.array(part[cut].astype(np.int32)), "data": pa.array([x.astype(np.uint32).tobytes() for x in np.split(place & ((1 << (bits - part_bits)) - 1), cut[1:])], pa.binary())})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made.setdefault(part, np.zeros(1 << (bits - part_bits), bool))[np.frombuffer(data, np.uint32)] = True
        for part, x in made.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": pa.array([np.packbits(x).tobytes()], pa.binary())})

    whole = np.zeros((1 << bits) // 8, np.uint8)
    size = len(whole) >> part_bits
    made = rows.select("data").mapInArrow(split, "part int, data binary").repartition("part").mapInArrow(build, "part int, data binary")
    for row in made.collect():
        whole[row.part * size : (row.part + 1) * size] = np.frombuffer(row.data, np.uint8)
    shared = spark.sparkContext.broadcast(whole)

    def test(key: np.ndarray) -> np.ndarray:
        place = (key >> np.uint64(63 - bits)).astype(np.int64)
        return (shared.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0

    return test


def keys_row(keys: np.ndarray) -> dict | None:
    """Keys for a filter, marked by part -1."""
    if not len(keys):
        return None
    return {"part": pa.array([-1], pa.int32()), "doc_id": pa.nulls(1, pa.int64()), "tag": pa.nulls(1, pa.int64()), "data": pa.array([keys.tobytes()], pa.binary())}


def marks_of(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id (null as LAST), tag (the text's CRC-32), data: the marked windows as (start, count) pairs; one row a text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = tasks_for(spark, total)
    parts = slots(tasks)

    def many(key: np.ndarray, whole: np.ndarray) -> Columns:
        """Of phrases in order of key and whole: each key once and whether it has different phrases."""
        new = changes(key)
        n = np.add.reduceat(changes(key, whole).astype(np.int64), np.flatnonzero(new)) if len(key) else np.zeros(0, np.int64)
        return key[new], n > 1

    def send_keys(b: Batch) -> Iterator[dict | None]:
        key, whole, *_ = phrase_columns(b.blocks())
        order = np.lexsort((whole, key))
        key, several = many(key[order], whole[order])
        yield sent(((key << np.uint64(1)) | several,), key << np.uint64(1), parts)

    def repeated(columns: Columns) -> Iterator[dict | None]:
        x = np.sort(columns[0])
        key = x >> np.uint64(1)
        new = np.flatnonzero(changes(key))
        n = np.diff(np.append(new, len(key)))
        last = new + n - 1
        yield keys_row(key[new][(n > 1) | ((x[last] if len(x) else x) & np.uint64(1) > 0)])

    def send_firsts(b: Batch, columns: Columns, wanted: Callable[[np.ndarray], np.ndarray] | None) -> Iterator[dict | None]:
        """Marks for what is later in the batch; the first phrase (or cell) of each wanted key."""
        key, whole, doc, at, n = columns
        ids, tags = b.ids[doc], b.tags[doc]
        order = np.lexsort((at, ids, whole, key))
        key, whole, ids, tags, at, n = (c[order] for c in (key, whole, ids, tags, at, n))
        first = firsts(changes(key, whole), ids, at)
        yield marked(ids[~first], tags[~first], at[~first], n[~first], parts)
        key, whole, ids, tags, at, n = (c[first] for c in (key, whole, ids, tags, at, n))
        several = np.repeat(many(key, whole)[1], np.diff(np.append(np.flatnonzero(changes(key)), len(key))))
        # a key with different phrases goes once: it is contested whatever the others send
        pick = (wanted(key) if wanted is not None else np.ones(len(key), bool)) & (~several | changes(key))
        key, whole, ids, tags, at, n, several = (c[pick] for c in (key, whole, ids, tags, at, n, several))
        yield sent(((key << np.uint64(1)) | several, whole, ids, tags.astype(np.uint32), at.astype(np.uint32), n.astype(np.uint8)), key << np.uint64(1), parts)

    def settle(columns: Columns) -> Iterator[dict | None]:
        key, whole, ids, tags, at, n = columns
        order = np.lexsort((at, ids, whole, key >> np.uint64(1)))
        key, whole, ids, tags, at, n = (c[order] for c in (key, whole, ids, tags, at, n))
        several, key = key & np.uint64(1) > 0, key >> np.uint64(1)
        rest = ~firsts(changes(key, whole), ids, at) & ~several
        yield marked(ids[rest], tags[rest], at[rest], n[rest], parts)
        new = np.flatnonzero(changes(key))
        if len(new):
            contested = (np.add.reduceat(changes(key, whole).astype(np.int64), new) > 1) | (np.add.reduceat(several.astype(np.int64), new) > 0)
            yield keys_row(key[new][contested])

    def none(key: np.ndarray) -> np.ndarray:
        return np.zeros(len(key), bool)

    kinds = "u8 u8 i8 u4 u4 u1"
    seen = materialize(gather(scan(docs, send_keys, window, gram), tasks, "u8", repeated), "repeated-keys")
    is_repeated = key_filter(seen) or none  # phrases that are repeated in one batch alone are settled there
    settled = materialize(gather(scan(docs, lambda b: send_firsts(b, phrase_columns(b.blocks()), is_repeated), window, gram), tasks, kinds, settle), "phrases")
    marks = settled.where("doc_id is not null")
    is_contested = key_filter(settled.where("doc_id is null"))
    if is_contested is not None:
        cells = materialize(gather(scan(docs, lambda b: send_firsts(b, phrase_columns(cell_blocks(b, is_contested)), None), window, gram), tasks, kinds, settle), "cells")
        marks = marks.unionByName(cells.where("doc_id is not null"))
        is_open = key_filter(cells.where("doc_id is null"))
        if is_open is not None:

            def send_windows(b: Batch) -> Iterator[dict | None]:
                out = []
                for c, doc, at in cell_blocks(b, is_contested):
                    pick = first_of(b, c, doc, at, np.flatnonzero(is_open(c.key >> np.uint64(1))))
                    n = (c.last - c.first + 1)[pick]
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start = np.repeat(c.first[pick], n) + step
                    out.append((c.order.of(start, start + window), c.check.of(start, start + window).astype(np.uint32), np.repeat(doc[pick], n), np.repeat(at[pick], n) + step))
                one, two, doc, at = joined(out, "u8 u4 i8 i8")
                ids, tags = b.ids[doc], b.tags[doc]
                order = np.lexsort((at, ids, two, one))
                one, two, ids, tags, at = (c[order] for c in (one, two, ids, tags, at))
                first = firsts(changes(one, two), ids, at)
                yield marked(ids[~first], tags[~first], at[~first], np.ones(int((~first).sum()), np.int64), parts)
                one, two, ids, tags, at = (c[first] for c in (one, two, ids, tags, at))
                order = np.lexsort((at, tags, ids))
                yield sent(tuple(c[order] for c in (one, two, ids, tags.astype(np.uint32), at.astype(np.uint32))), one[order], parts)

            def later(columns: Columns) -> Iterator[dict | None]:
                one, two, ids, tags, at = columns
                order = np.lexsort((at, ids, two, one))
                one, two, ids, tags, at = (c[order] for c in (one, two, ids, tags, at))
                rest = ~firsts(changes(one, two), ids, at)
                yield marked(ids[rest], tags[rest], at[rest], np.ones(int(rest.sum()), np.int64), parts)

            marks = marks.unionByName(materialize(gather(scan(docs, send_windows, window, gram), tasks, "u8 u4 i8 u4 u4", later), "windows"))

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [unpacked(x.as_buffer().to_pybytes(), "i8 u4 u4 u4") for batch in batches for x in batch.column(1)]
        doc, tag, at, n = merged(*joined(have, "i8 u4 u4 u4"))
        if len(doc):
            new = np.flatnonzero(changes(doc, tag))
            data = [x.tobytes() for x in np.split(np.column_stack([at, n]), new[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[new]), "tag": pa.array(tag[new]), "data": pa.array(data, pa.binary())})

    return materialize(marks.select(F.col("doc_id").cast("int").alias("part"), "data").repartition(tasks, "part").mapInArrow(by_document, "doc_id long, tag long, data binary"), "marks")


def cut(text: bytes, data: bytes, window: int) -> tuple[int, int, str]:
    """Bytes removed, runs removed, SHA-256 of what is left."""
    pairs = np.frombuffer(data, np.int64).reshape(-1, 2)
    start, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 0] + pairs[:, 1] - 1 + window)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    lo = start[new]
    hi = end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    kept, at = hashlib.sha256(), 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return int((hi - lo).sum()), len(lo), kept.hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    marks = marks_of(docs, window, gram)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_place", F.coalesce("doc_id", F.lit(LAST))).withColumn("_tag", F.crc32("text"))
    told = marks.select(F.col("doc_id").alias("_place"), F.col("tag").alias("_tag"))
    whole = None
    if told.count() <= TELL_MOST:
        whole = rows.join(F.broadcast(told), ["_place", "_tag"], "left_anti")
        rows = rows.join(F.broadcast(told), ["_place", "_tag"], "left_semi")
    rows = rows.join(marks.toDF("_place", "_tag", "_marks"), ["_place", "_tag"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, data in zip(texts_of(batch, "text"), batch.column(2).to_pylist(), strict=True):
                out.append((len(text), *(cut(text, data, window) if data else (0, 0, hashlib.sha256(text).hexdigest()))))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {c: pa.array([o[i] for o in out], pa.string() if i == 3 else pa.int64()) for i, c in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256"))})

    made = rows.select("doc_id", "text", "_marks").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if whole is not None:
        zero = F.lit(0).cast("long")
        made = made.unionByName(whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))
    return made


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``documents``.

    A null text is empty; rows that repeat a doc_id count as one place.
    """
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every window's bytes as hex digits; windows whose hash is met once are left out before the bytes are compared.
OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS rid FROM documents),
b AS (SELECT rid, doc, p, substr(h, 800 * p + 1, 998) AS part FROM (SELECT rid, coalesce(doc_id, 9223372036854775807) AS doc, h, unnest(range((length(h) // 2 + 300) // 400)) AS p FROM d)),
k AS MATERIALIZED (SELECT rid, doc, n, s, hash(s) AS k FROM (SELECT rid, doc, 400 * p + i AS n, substr(part, 2 * i + 1, 200) AS s FROM (SELECT rid, doc, p, part, unnest(range(least(400, length(part) // 2 - 99))) AS i FROM b))),
w AS (SELECT rid, doc, n, s FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
m AS (SELECT rid, n FROM (SELECT rid, n, doc, min(doc) OVER (PARTITION BY s) AS doc0, min(n) OVER (PARTITION BY s, doc) AS n0 FROM w) WHERE doc > doc0 OR n > n0),
g AS (SELECT rid, n, sum(CASE WHEN n > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY n) AS run FROM (SELECT rid, n, coalesce(lag(n) OVER (PARTITION BY rid ORDER BY n), -1000) AS before FROM m)),
runs AS (SELECT rid, min(n) AS a, max(n) + 100 AS b FROM g GROUP BY rid, run),
c AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb FROM runs GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN c.rid IS NULL THEN h ELSE list_aggregate(list_transform(range(1, len(la) + 2), lambda i: substr(h, CASE WHEN i = 1 THEN 1 ELSE 2 * lb[i - 1] + 1 END, 2 * (CASE WHEN i > len(la) THEN length(h) // 2 ELSE la[i] END - CASE WHEN i = 1 THEN 0 ELSE lb[i - 1] END))), 'string_agg', '') END)) AS kept_sha256
FROM d LEFT JOIN c USING (rid)
"""
