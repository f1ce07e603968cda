"""How texts reach Python: small Arrow batches, a bounded number of characters at a time, and memory
given back when a task ends, since workers live on and serve later stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to Python (a single larger row is a batch of its own).
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by BATCH_BYTES, unless they are smaller already."""
    now = spark.conf.get(_SETTING, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory of this process to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow over small batches, after each of which the worker gives its memory back."""
    small_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            give_back()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(each(batches))
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list]]:
    """Ranges of consecutive texts of about ``most`` bytes, one text at least, as Python strings."""
    if not len(column):
        return
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    reach = np.cumsum(size + 16)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + most, side="right")))
        yield at, end, column.slice(at, end - at).to_pylist()
        at = end


def packed(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = matrix.shape[1] * matrix.dtype.itemsize
    buffer = pa.py_buffer(np.ascontiguousarray(matrix).tobytes())
    return pa.Array.from_buffers(pa.binary(width), len(matrix), [None, buffer]).cast(pa.binary()) if width else pa.array([b""] * len(matrix), pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type | str) -> np.ndarray:
    """A matrix from equally long binary values, none of them null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = offsets[column.offset], offsets[column.offset + len(column)]
    return np.frombuffer(column.buffers()[2], np.uint8)[first:last].view(kind).reshape(len(column), -1)
