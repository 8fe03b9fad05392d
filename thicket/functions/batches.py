"""Arrow batches in parts of bounded size, so that a worker's memory doesn't depend on how long the rows of a batch are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters or elements of a part; a longer row is a part of its own.
PART = 1 << 20


def parts(batch: pa.RecordBatch, column: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """``batch`` cut where the texts or arrays of a column add up to ``most``."""
    values = batch.column(column)
    size = pc.list_value_length(values) if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, end - start)
        start = end
