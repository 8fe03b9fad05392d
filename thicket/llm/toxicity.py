"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features are the presence of words, word pairs and skip pairs (one word left
out), hashed into 2**BITS places; a longer word also counts by its first
``STEMS`` bytes, so that its inflected forms share a weight. The proximal step's L1 term keeps most
weights at exactly zero, so the model is a short list of places and weights.

The model is trained by one task on a bounded sample of the labelled rows
(``TRAIN_ROWS`` at most, chosen by a hash of doc_id): the labels are broadcast
to the scan, which hashes the features, and only their places move. Every
document's whole text is then scored.

Defined cases: a null or empty text has no features and the bias as its score;
a null doc_id is scored, is not held out and never a labelled row; different
labels or texts of a repeated doc_id are all used, equal rows once (where the
rows of repeated ids are over twice ``TRAIN_ROWS``, a hash of their texts
chooses among them); a table without labels of both kinds gives the share of
toxic labels (0 without any) to every document; an empty table gives an empty
result. Only doc_id and text of the documents are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.texts import give_back, map_batches, portions, texts_of

BITS = 20
TRAIN_ROWS = 24_000
EPOCHS = 4
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 0.1
#: Letters of any language and digits stay, A-Z in lower case; all else divides words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LAST, _ONE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xA0761D6478BD642F)


def places(text: bytes | None) -> np.ndarray:
    """The hashed features of a text, with repeats."""
    found = (text or b"").translate(_TABLE).split()
    if not found:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(zlib.crc32, found), np.uint64, len(found)) * _ONE
    parts = [w, w[:-1] * _PAIR + w[1:]]
    if len(w) > 2:
        parts.append(w[:-2] * _SKIP + (w[2:] ^ _LAST))
    for n in STEMS:
        parts.append(np.fromiter([zlib.crc32(x[:n], n) for x in found if len(x) > n], np.uint64) * _LAST)
    h = np.concatenate(parts)
    h = (h ^ (h >> np.uint64(31))) * _LAST
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def packed(found: np.ndarray) -> bytes:
    """The different places in order, as steps of two bytes where all are so short."""
    at = np.unique(found).astype(np.int64)
    step = np.diff(at, prepend=0)
    return step.astype(np.uint16 if not len(step) or step.max() < 1 << 16 else np.uint32).tobytes() + (b"\0" if not len(step) or step.max() < 1 << 16 else b"\1")


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data[:-1], np.uint32 if data[-1] else np.uint16), dtype=np.int64).astype(np.int32)


class Ftrl:
    """z and n of each place; the weight follows from them."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias, without L1
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha))

    def step(self, at: np.ndarray, y: float) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        # every coordinate has its own rate, by the squares of its own gradients
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        self.z[-1] += g - (np.sqrt(self.n[-1] + g * g) - np.sqrt(self.n[-1])) / self.alpha * b
        self.n[-1] += g * g


def train(found: list[np.ndarray], toxic: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Places with a weight, the weights, the bias, from the different places of each row."""
    if len(set(toxic)) < 2:
        share = min(max(float(np.mean(toxic)) if toxic else 0.0, 1e-9), 1 - 1e-9)
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share)))
    # each step moves z by less than one, so a place in too few rows never passes L1: leaving it out changes nothing
    rows = np.zeros(1 << BITS, np.int64)
    for at in found:
        rows[at] += 1
    found = [at[rows[at] * EPOCHS > L1] for at in found]
    model, rng = Ftrl(1 << BITS), np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(found)):
            model.step(found[i], float(toxic[i]))
    w = model.weights(slice(0, 1 << BITS))
    at = np.flatnonzero(w)
    return at, w[at], model.bias()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model, from labelled rows that aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_label_id"), F.col("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "_label_id"), F.lit(1_000_000)) < int(0.95 * rows / n * 1_000_000))
    # bounded by ``rows``: the share above leaves room for chance
    pairs = docs.select("doc_id", "text").join(F.broadcast(known.distinct()), F.col("doc_id") == F.col("_label_id"))
    key = F.xxhash64("text", "doc_id")
    many = pairs.count()
    if many > 2 * rows:
        pairs = pairs.where(F.pmod(key, F.lit(1_000_000)) < int(1.9 * rows / many * 1_000_000))

    def hashed(batch: pa.RecordBatch) -> dict:
        data = [packed(places(t)) for t in texts_of(batch, "text")]
        return {"doc_id": batch.column(0), "key": batch.column(1), "toxic": batch.column(2), "data": pa.array(data, pa.binary())}

    sample = map_batches(pairs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "toxic", "text"), hashed, "doc_id long, key long, toxic int, data binary")
    if many > 2 * rows:
        sample = sample.dropDuplicates(["doc_id", "key", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, toxic, before = [], [], None
        for batch in batches:
            for i, k, y, data in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                if (i, k, y) != before:
                    found.append(unpacked(data.as_py()))
                    toxic.append(int(y > 0))
                before = i, k, y
        at, w, bias = train(found, toxic)
        give_back()
        yield pa.RecordBatch.from_pydict({"place": pa.array([*at.tolist(), -1], pa.int64()), "weight": pa.array([*w.tolist(), bias])})

    # a bounded sample, in one task by intent: the updates are sequential
    model = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "key", "toxic").mapInArrow(run, "place long, weight double").toArrow()
    place, weight = np.asarray(model.column("place")), np.asarray(model.column("weight"))
    bias = float(weight[place < 0][0]) if (place < 0).any() else train([], [])[2]
    return place[place >= 0], weight[place >= 0], bias


def scorer(model: tuple[np.ndarray, np.ndarray, float]):
    at, w, bias = model
    dense = np.zeros(1 << BITS, np.float64)
    dense[at] = w

    def score(text: bytes | None) -> float:
        p = places(text)
        p = np.unique(p[dense[p] != 0])
        return float(1 / (1 + np.exp(-np.clip(dense[p].sum() + bias, -35, 35))))

    return score


def with_scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``docs`` (doc_id, text) with score."""

    def f(batch: pa.RecordBatch) -> dict:
        score = made.setdefault("score", None) or made.update(score=scorer(model)) or made["score"]
        return {"doc_id": batch.column(0), "score": pa.array([round(score(t), 9) for t in texts_of(batch, "text")], pa.float64())}

    made: dict = {}
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, "doc_id long, score double")


def keep_civil(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], most: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``most`` or more; all columns, any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            for part in portions(batch):
                yield part.filter(pa.array([score(t) < most for t in texts_of(part, "text")], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``documents``."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_scores(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
