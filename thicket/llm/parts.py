"""Part numbers that Spark's hash partitioning deals out evenly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

#: Bytes that a task gathers.
TASK_BYTES = 1 << 26


def tasks_for(spark: SparkSession, n_bytes: int | None) -> int:
    """As many tasks as the session asks for, more where each would gather over ``TASK_BYTES``."""
    return min(1 << 20, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n_bytes or 0) // TASK_BYTES)))


def spark_hash(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash (Murmur3) of int columns; it only decides evenness, never results."""
    k = x.astype(np.uint32) * np.uint32(0xCC9E2D51)
    k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
    h = np.uint32(seed) ^ k
    h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def slots(tasks: int) -> np.ndarray:
    """One part number for each of ``tasks`` partitions, by partition."""
    out = np.full(tasks, -1, np.int32)
    start, step = 0, max(1024, 4 * tasks)
    while (out < 0).any():
        x = np.arange(start, start + step, dtype=np.int32)
        at = spark_hash(x) % tasks
        out[at[::-1]] = np.where(out[at[::-1]] < 0, x[::-1], out[at[::-1]])
        start += step
    return out
