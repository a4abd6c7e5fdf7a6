"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import mmap
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from graphtide.session import own_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work for mapInArrow, after which the worker returns freed memory to the system: workers live on, and a step's memory shouldn't add to the next one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and its offsets, without copying; nulls become empty."""
    filled = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(filled.type):
        kind = np.int64
    else:
        filled, kind = filled.cast(pa.string()), np.int32
    _, offsets, data = filled.buffers()
    offsets = np.frombuffer(offsets, kind)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most `most` units together; a longer text is a range of its own."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, stop
        start = stop


def rows(offsets: np.ndarray) -> np.ndarray:
    """For each unit of concatenated texts the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) over all pairs."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(np.asarray(starts, np.int64), lengths)


def ship(spark: SparkSession, name: str, parts: Iterable[bytes]) -> str:
    """Writes the parts one after the other as a file in the shared folder and ships it to the executors.

    Returns the name for `shipped`. An executor that comes later fetches the file again.
    """
    name = f"{name}-{uuid.uuid4().hex}"
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{own_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        for part in parts:
            for at in range(0, len(part), 1 << 22):
                out.write(bytearray(part[at : at + (1 << 22)]))
    finally:
        out.close()
    sc.addFile(path.toString())
    return name


def shipped(name: str) -> memoryview:
    """The file as this worker sees it, memory-mapped read-only."""
    if name not in _MAPPED:
        with open(SparkFiles.get(name), "rb") as f:
            size = f.seek(0, 2)
            _MAPPED[name] = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if size else b"")
    return _MAPPED[name]


_MAPPED: dict[str, memoryview] = {}
