"""Texts as UTF-8 bytes in Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

WHITE = b" \t\n\r\x0b\x0c"
#: Bytes of text that are taken from a batch at once.
PORTION = 4 << 20


def words(text: bytes) -> list[bytes]:
    r"""The runs of ``[^\x20\x09-\x0D]``: bytes.split() divides at just these six."""
    return text.split()


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def portions(batch: pa.RecordBatch, name: str = "text", most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows with at most ``most`` bytes of text, or one longer text."""
    column = batch.column(batch.schema.get_field_index(name))
    size = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Freed memory goes back to the system: idle workers stay beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """``f`` over Arrow batches, in portions where there is a text; a dict of columns becomes a batch."""
    name = "text" if "text" in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, name) if name else [batch] if batch.num_rows else []:
                out = f(part)
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out
        give_back()

    return df.mapInArrow(run, schema)
