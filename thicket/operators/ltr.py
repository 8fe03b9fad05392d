"""Learning to rank: linear models fitted by coordinate ascent.

Features are arrays in the order of a sorted list of names. Rankings of all
queries stay in the cluster; each coordinate's whole grid of steps is measured
by one job that returns a number a step, and only the weights live in the
driver.
"""

from __future__ import annotations

import json
import logging
import math
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.operators.aggregates import features_from, numbered
from thicket.operators.ranking import rank

_log = logging.getLogger(__name__)

#: Steps tried for a weight: up and down by powers of two, and none.
STEPS = tuple(s * 0.0001 * 2**n for n in range(1, 21) for s in (1, -1)) + (0.0,)


# --- feature spaces ------------------------------------------------------------


@dataclass(frozen=True)
class Space:
    """Named dimensions, sorted and without repeats."""

    names: tuple[str, ...]

    @staticmethod
    def of(names: Sequence[str]) -> Space:
        return Space(tuple(sorted(set(names))))

    def __len__(self) -> int:
        return len(self.names)

    def index(self, name: str) -> int:
        return self.names.index(name)

    def renamed(self, f: Callable[[str], str]) -> Space:
        return Space(tuple(f(n) for n in self.names))

    def project(self, features: Column, to: Space) -> Column:
        """The features of a space whose names this one has all."""
        if lacking := [n for n in to.names if n not in self.names]:
            raise KeyError(f"no features {lacking}")
        return F.array(*(features[self.index(n)] for n in to.names))

    def common(self, other: Space) -> Space:
        return Space.of([n for n in self.names if n in other.names])

    def lacking(self, other: Space) -> list[str]:
        return sorted(set(other.names) - set(self.names))

    def equivalent(self, other: Space) -> bool:
        return set(self.names) == set(other.names)

    def stack(self, other: Space) -> Space:
        """The space of concatenated vectors; names must differ."""
        if clash := set(self.names) & set(other.names):
            raise ValueError(f"both have {sorted(clash)}")
        return Space(self.names + other.names)


def dot(features: Column, weights: Sequence[float]) -> Column:
    w = F.array(*(F.lit(float(x)) for x in weights))
    return F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def accumulate(features: Column, at: int, x: float | Column) -> Column:
    """The vector with ``x`` added at one index."""
    return F.transform(features, lambda v, i: F.when(i == at, v + x).otherwise(v))


# --- data ---------------------------------------------------------------------------


def features_of_runs(runs: dict[str, DataFrame]) -> tuple[Space, DataFrame]:
    """(query_id, doc_id, features): each run's score is a feature; a document that a run lacks is an error."""
    space = Space.of(list(runs))
    rows = reduce(DataFrame.unionByName, (r.select("query_id", "doc_id", F.lit(name).alias("feature"), F.col("score").alias("value")) for name, r in runs.items()))
    return space, features_from(rows, space.names, ("query_id", "doc_id"), default=None)


def with_relevance(features: DataFrame, qrels: DataFrame) -> DataFrame:
    known = qrels.select("query_id", "doc_id", "relevance")
    return features.join(known, ["query_id", "doc_id"], "left").fillna(0, ["relevance"])


def totals_of(judged: DataFrame, least: int = 1) -> DataFrame:
    """query_id, n_relevant of qrels or of the data itself."""
    return judged.groupBy("query_id").agg(F.count_if(F.col("relevance") >= least).alias("n_relevant"))


# --- the model ----------------------------------------------------------------------


def unit(weights: np.ndarray) -> np.ndarray | None:
    norm = float(np.sqrt((weights * weights).sum()))
    return None if norm < 1e-12 or not math.isfinite(norm) else weights / norm


def denormalised(weights: Sequence[float], deviation: Sequence[float]) -> np.ndarray:
    """Weights for raw features, of weights for z-normalised ones."""
    d = np.asarray(deviation, float)
    return np.asarray(weights, float) / np.where(d == 0, 1.0, d)


@dataclass(frozen=True)
class Model:
    space: Space
    weights: tuple[float, ...]

    def to_json(self) -> str:
        return json.dumps(dict(zip(self.space.names, self.weights, strict=True)))

    @staticmethod
    def from_json(text: str) -> Model:
        found = json.loads(text)
        space = Space.of(list(found))
        return Model(space, tuple(float(found[n]) for n in space.names))

    def rerank(self, features: DataFrame, space: Space | None = None, k: int | None = None) -> DataFrame:
        """The features' documents with score and rank in each query."""
        x = F.col("features") if space is None else space.project(F.col("features"), self.space)
        return rank(features.withColumn("score", dot(x, self.weights)), k)


# --- training -------------------------------------------------------------------------


def grid_scores(data: DataFrame, totals: DataFrame, weights: np.ndarray, dim: int, steps: Sequence[float], cutoff: int | None = None, least: int = 1) -> list[float]:
    """Mean average precision after each step of one weight: one job, one number a step.

    A step's score is the old one plus step x feature. With ``cutoff`` only the
    old ranking's best documents count, an approximation.
    """
    rows = data.select("query_id", "doc_id", (F.col("relevance") >= least).alias("good"), dot(F.col("features"), weights).alias("old"), F.col("features")[dim].alias("x"))
    if cutoff is not None:
        rows = rank(rows, cutoff, score="old").drop("rank")
    grid = F.array(*(F.lit(float(s)) for s in steps))
    tried = rows.withColumn("scores", F.transform(grid, lambda s: F.col("old") + s * F.col("x"))).select("query_id", "doc_id", "good", F.posexplode("scores").alias("step", "score"))
    ranked = rank(tried, by=("query_id", "step"))
    hits = ranked.where("good").withColumn("hit", F.row_number().over(Window.partitionBy("query_id", "step").orderBy("rank")))
    sums = hits.groupBy("query_id", "step").agg(F.sum(F.col("hit") / F.col("rank")).alias("sum")).join(totals, "query_id").where("n_relevant > 0")
    found = {r.step: r.total for r in sums.groupBy("step").agg(F.sum(F.col("sum") / F.col("n_relevant")).alias("total")).collect()}
    n = data.select("query_id").distinct().count()
    return [found.get(i, 0.0) / n if n else math.nan for i in range(len(steps))]


def coordinate_ascent(data: DataFrame, totals: DataFrame, start: Sequence[float], seed: int = 0, cutoff: int | None = None, least: int = 1) -> Iterator[tuple[float, np.ndarray]]:
    """Score and weights after each round over all dimensions, without end. data: query_id, doc_id, features, relevance."""

    def best(w: np.ndarray, score: float, dim: int) -> tuple[float, np.ndarray]:
        allowed = [s for s in STEPS if unit(w + s * np.eye(len(w))[dim]) is not None]
        scores = grid_scores(data, totals, w, dim, allowed, cutoff, least)
        if any(map(math.isnan, scores)):
            raise ValueError("a score is not a number")
        # of equal scores the last, which is no step
        at = max(range(len(allowed)), key=lambda i: (scores[i], i))
        return scores[at], unit(w + allowed[at] * np.eye(len(w))[dim])

    yield from _rounds(start, seed, best)


def naive_ascent(objective: Callable[[np.ndarray], float], start: Sequence[float], seed: int = 0, normalise: Callable[[np.ndarray], np.ndarray | None] = unit) -> Iterator[tuple[float, np.ndarray]]:
    """The same for any objective of the weights; steps to a value that is no number are left out."""

    def best(w: np.ndarray, score: float, dim: int) -> tuple[float, np.ndarray]:
        tried = []
        for s in STEPS:
            v = normalise(w + s * np.eye(len(w))[dim])
            if v is not None and not math.isnan(x := objective(v)):
                tried.append((x, len(tried), v))
        return (max(tried, key=lambda t: t[:2])[0::2]) if tried else (score, w)

    yield from _rounds(start, seed, best, normalise)


def _rounds(start: Sequence[float], seed: int, best, normalise=unit) -> Iterator[tuple[float, np.ndarray]]:
    w = normalise(np.asarray(start, float))
    if w is None or not len(w):
        raise ValueError("no features, or all weights are zero")
    rng, score = random.Random(seed), math.nan
    while True:
        for dim in rng.sample(range(len(w)), len(w)):
            score, w = best(w, score, dim)
        yield score, w


def until_converged(iterates: Iterator[tuple[float, np.ndarray]], drop: int = 2, most: int = 100, relative: float = 1e-2) -> list[tuple[float, np.ndarray]]:
    """Iterates after the first ``drop``, ``most`` at most, up to the first that changes the score by less than ``relative``."""
    out: list[tuple[float, np.ndarray]] = []
    for i, it in enumerate(iterates):
        if i < drop:
            continue
        out.append(it)
        if len(out) >= most or (len(out) > 1 and abs(out[-1][0] - out[-2][0]) <= relative * abs(out[-2][0])):
            return out
    return out


def traced(iterates: Iterator[tuple[float, np.ndarray]], report: Callable[[str], object] = _log.info) -> Iterator[tuple[float, np.ndarray]]:
    """The same iterates; each one's score and its change since the one before are reported."""
    before = math.nan
    for i, (score, w) in enumerate(iterates):
        change = (score - before) / abs(before) if before else math.nan
        report(f"iteration {i}: score {score:.6g}, relative change {change:.3g}")
        before = score
        yield score, w


def mini_batches(data: DataFrame, totals: DataFrame, start: Sequence[float], seed: int = 0, batch_steps: int = 1, batch_size: int = 100, least: int = 1) -> Iterator[np.ndarray]:
    """Weights after each step; the steps of a batch see the queries drawn for it (with replacement, then each once)."""
    queries = [r[0] for r in data.select("query_id").distinct().orderBy("query_id").collect()]
    if not queries:
        raise ValueError("no rankings")
    rng, w = random.Random(seed), np.asarray(start, float)
    while True:
        drawn = sorted({queries[rng.randrange(len(queries))] for _ in range(batch_size)})
        part = data.where(F.col("query_id").isin(drawn))
        steps = coordinate_ascent(part, totals, w, rng.randrange(1 << 30), least=least)
        for _ in range(batch_steps):
            w = next(steps)[1]
            yield w


def mini_batched_and_evaluated(data: DataFrame, totals: DataFrame, start: Sequence[float], seed: int = 0, batch_steps: int = 1, batch_size: int = 100, eval_steps: int = 0, least: int = 1) -> Iterator[tuple[float, np.ndarray]]:
    """Score on all data and weights of every iterate after ``eval_steps`` others."""
    steps = mini_batches(data, totals, start, seed, batch_steps, batch_size, least)
    while True:
        for _ in range(eval_steps):
            next(steps)
        w = next(steps)
        yield grid_scores(data, totals, w, 0, [0.0], least=least)[0], w


def learn(space: Space, data: DataFrame, totals: DataFrame, seed: int = 0, batch_size: int | None = None, least: int = 1, **convergence) -> tuple[Model, float]:
    """The last iterate of an ascent from equal weights; each is logged. data: query_id, doc_id, features, relevance."""
    kept = data.persist()
    try:
        start = [1.0] * len(space)
        steps = coordinate_ascent(kept, totals, start, seed, least=least) if batch_size is None else mini_batched_and_evaluated(kept, totals, start, seed, batch_size=batch_size, least=least)
        score, w = until_converged(traced(steps), **convergence)[-1]
    finally:
        kept.unpersist()
    return Model(space, tuple(float(x) for x in w)), score


# --- cross-validation ---------------------------------------------------------------


def sequential_folds(items: Sequence, k: int) -> list[list]:
    """Runs of one length; the last is shorter, or there are more than ``k`` where the items are few."""
    size = len(items) // k + 1 if len(items) >= 2 * k else len(items) // k
    if size == 0:
        raise ValueError(f"fewer than {k} items")
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def fold_numbers(queries: DataFrame, k: int) -> DataFrame:
    """query_id, fold: ``sequential_folds`` of the distinct queries in their order, as a table."""
    distinct = queries.select("query_id").distinct()
    n = distinct.count()
    size = n // k + 1 if n >= 2 * k else n // k
    if size == 0:
        raise ValueError(f"fewer than {k} queries")
    return numbered(distinct, ["query_id"], name="_at").select("query_id", F.floor(F.col("_at") / size).cast("int").alias("fold"))


def k_folds(data: DataFrame, folds: Sequence[Sequence], train: Callable[[int, DataFrame], object]) -> list[tuple[DataFrame, object]]:
    """Of each fold its test rows and what ``train`` made of the others."""
    out = []
    for i, fold in enumerate(folds):
        held = F.col("query_id").isin(list(fold))
        out.append((data.where(held), train(i, data.where(~held))))
    return out


def k_folds_and_restarts(data: DataFrame, folds: Sequence[Sequence], restarts: int, seed: int, train: Callable[[int, int, int, DataFrame], object]) -> list[tuple[DataFrame, list]]:
    rng = random.Random(seed)
    seeds = [rng.randrange(1 << 30) for _ in range(restarts)]
    return k_folds(data, folds, lambda i, rows: [train(i, r, s, rows) for r, s in enumerate(seeds)])


def save_model(model: Model, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Model:
    return Model.from_json("".join(r.value for r in spark.read.text(path).collect()))
