"""Quality rules: an isolation forest on rule statistics.

Each document's rule statistics are counted once and written. The forest is
fitted on the subsamples that the trees of an isolation forest draw anyway, here
from all labelled rows (from all rows where labels lack). The cut-off
is set on the scores of all labelled rows; every document is then scored.

Defined cases: a null or empty text has no words, fails the base rules and is
not kept; a null doc_id is scored like any other and is never a labelled row;
labels of a doc_id that repeats are all used; without labelled rows of both
kinds the cut-off is ``DEFAULT_CUT``; an empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.texts import WHITE, code_points, map_batches, texts_of, words
from thicket.scratch import materialize

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
TREES, SUBSAMPLE = 128, 256
#: Rows that the trees draw together.
FIT_ROWS = TREES * SUBSAMPLE
#: Cut-offs that are told apart: their multiples of 1 / CUTS.
CUTS = 1_000_000
#: Share of labelled bad rows in the forest's sample, at most.
CONTAMINATION = 0.04
#: Share of the labelled good rows that the cut-off may reject.
FALSE_REJECTS = 0.03
DEFAULT_CUT = 0.65
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_lines", "n_marks", "n_distinct")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + EXTRA)


def repeated(ids: np.ndarray, n_ids: int, width: int = 3) -> int:
    """Places covered by ``width``-word windows that occur twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for k in range(1, width):
        if n_ids >= 1 << 31:
            raise ValueError("a text with over 2**31 different words")
        # renumbering keeps the pair below 2**62 at any vocabulary
        key = key * n_ids + ids[k : k + n]
        if k < width - 1:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def count_rules(text: bytes | None) -> tuple[int, ...]:
    """COUNTS and EXTRA of a text."""
    text = text or b""
    found = words(text)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int64, len(found))
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    white = len(text) - len(text.translate(None, WHITE))
    return (
        len(found),
        code_points(text) - white,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(ids, len(seen)),
        len(text) - len(text.translate(None, UPPER)),
        len(lines),
        len(text) - len(text.translate(None, b"!?|")),
        len(seen),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and EXTRA of each document."""

    def f(batch: pa.RecordBatch) -> dict:
        rows = [count_rules(t) for t in texts_of(batch, "text")]
        return {"doc_id": batch.column(0)} | {c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(COUNTS + EXTRA)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, SCHEMA)


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios, so that a text's length by itself is no anomaly."""
    n, chars, lines = (np.maximum(1.0, x[c].astype(float)) for c in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        x["n_symbols"] / chars,
        x["n_marks"] / chars,
        x["n_upper"] / chars,
        x["n_repeat_words"] / n,
        x["n_dup_lines"] / lines,
        np.clip(chars / n, 0, 40),
    ])


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as flat arrays: trees x nodes, children of i at 2i+1 and 2i+2."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.m = max(2, min(subsample, len(x)))
        self.depth = int(np.ceil(np.log2(self.m)))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, np.int16)
        self.value = np.zeros((trees, nodes))
        self.length = np.zeros((trees, nodes))
        for t in range(trees):
            self._grow(x[rng.choice(len(x), self.m, replace=len(x) < self.m)], t, 0, 0, rng)

    def _grow(self, x: np.ndarray, t: int, node: int, depth: int, rng: np.random.Generator) -> None:
        low, high = x.min(0), x.max(0)
        split = np.flatnonzero(high > low)
        if depth == self.depth or len(x) < 2 or not len(split):
            self.length[t, node] = depth + average_path(len(x))
            return
        f = int(rng.choice(split))
        cut = rng.uniform(low[f], high[f])
        left = x[:, f] <= cut
        self.feature[t, node], self.value[t, node] = f, cut
        self._grow(x[left], t, 2 * node + 1, depth + 1, rng)
        self._grow(x[~left], t, 2 * node + 2, depth + 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for anomalies, below 0.5 for the rest."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, length in zip(self.feature, self.value, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > value[node]), node)
            total += length[node]
        return 2.0 ** -(total / len(self.feature) / average_path(np.array(self.m)))


def bounded(df: DataFrame, rows: int, salt: str) -> DataFrame:
    """At most ``rows`` of ``df`` (the share leaves room for chance), by a hash over its columns: the same on each run.

    Where there are more, equal rows count once, so that one row repeated
    without end can't fill the sample.
    """
    n = df.count()
    if n > rows:
        df = df.where(F.pmod(F.xxhash64(F.lit(salt), *df.columns), F.lit(1_000_000)) < int(0.95 * rows / n * 1_000_000)).dropDuplicates()
    return df


def as_arrays(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {c: np.asarray(table.column(c)) for c in table.column_names}


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float]:
    """The forest and the score from which a document is an anomaly.

    The trees draw from the labelled good rows and few bad ones, ``CONTAMINATION``
    of the good at most: enough for their splits to span what bad rows do, too
    few for these to look usual. The cut-off is the one that, over all labelled
    rows, catches most of the bad and rejects at most ``FALSE_REJECTS`` of the
    good ones; scores are counted by ``CUTS`` steps, so the driver gets
    as many rows at most.
    """
    passed = stats.where(~base_failed())
    known = labels.where("quality is not null").select(F.col("doc_id").alias("_label_id"), (F.col("quality") > 0).alias("good"))
    joined = materialize(passed.join(known, F.col("doc_id") == F.col("_label_id")).drop("_label_id"), "labelled")
    seen = {r.good: r["count"] for r in joined.groupBy("good").count().collect()}
    if len(seen) < 2:
        # the trees' own subsamples, drawn from all rows
        x = features(as_arrays(bounded(passed, TREES * SUBSAMPLE, "forest").orderBy("doc_id", *COUNTS, *EXTRA)))
        return Forest(x if len(x) else np.zeros((2, 6))), DEFAULT_CUT
    order = [F.xxhash64(F.lit("forest"), "doc_id"), "doc_id", *COUNTS, *EXTRA]
    usual = features(as_arrays(bounded(joined.where("good"), FIT_ROWS, "labels").orderBy(*order)))
    few = max(1, int(CONTAMINATION * len(usual)))
    # a multiple of what is needed, of which the first are taken
    forest = Forest(np.concatenate([usual, features(as_arrays(bounded(joined.where("not good"), 8 * few, "labels").orderBy(*order).limit(few)))]))

    def score(batch: pa.RecordBatch) -> dict:
        x = {c: np.asarray(batch.column(i)) for i, c in enumerate(batch.schema.names[:-1])}
        return {"cut": pa.array(np.ceil(forest.score(features(x)) * CUTS).astype(np.int64)), "good": batch.column(batch.num_columns - 1)}

    scored = map_batches(joined.select("doc_id", *COUNTS, *EXTRA, "good"), score, "cut long, good boolean")
    counted = as_arrays(scored.groupBy("cut").agg(F.sum(F.col("good").cast("long")).alias("good"), F.count(F.lit(1)).alias("n")).orderBy("cut"))
    rejected = 1 - np.cumsum(counted["good"]) / seen[True]
    caught = 1 - np.cumsum(counted["n"] - counted["good"]) / seen[False]
    gain = np.where(rejected <= FALSE_REJECTS, caught - rejected, -1)
    return forest, float(counted["cut"][int(gain.argmax())] / CUTS)


def apply_forest(stats: DataFrame, forest: Forest, cut: float) -> DataFrame:
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = {c: np.asarray(batch.column(batch.schema.get_field_index(c))) for c in COUNTS + EXTRA}
        score = forest.score(features(x))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score <= cut)], [*batch.schema.names, "anomaly", "usual"])

    return map_batches(stats, f, SCHEMA + ", anomaly double, usual boolean")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly and kept of each document."""
    stats = materialize(statistics(docs), "rules")
    scored = apply_forest(stats, *fit(stats, labels))
    return scored.select("doc_id", *COUNTS, base_failed().alias("base_failed"), F.round("anomaly", 6).alias("anomaly"), (~base_failed() & F.col("usual")).alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept of each row of ``documents``.

    A null or empty text counts nothing, fails the base rules and isn't kept.
    """
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
