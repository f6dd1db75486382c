"""Arrow batches of texts, cut so that one step works on a bounded number of bytes."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

STEP_BYTES = 2 << 20
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches: one is held whole on both sides, outside the heap and in the worker, and by default is
    10,000 rows however long their texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives freed memory back, where there is one."""
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def text_bytes(column: pa.Array) -> np.ndarray:
    """Byte length of every entry, nulls as 0."""
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` text bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = np.cumsum(text_bytes(batch.column(column))) // limit
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch
        pa.default_memory_pool().release_unused()  # idle workers share the executor's memory
    if trim := _trim():
        trim(0)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
