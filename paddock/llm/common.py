"""Shared helpers: tables in the cluster's shared folder and vectorised views of text columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: text units (bytes) handled at once inside a task; bounds the memory of the numpy arrays
CHUNK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_own_names(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same columns, named so that they cannot clash with an operator's: doc_id, text and c0, c1, ...
    `toDF` with the old names undoes it."""
    return docs.toDF(*["doc_id" if c == id_col else "text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)])


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where the setting is missing and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (nulls empty) as one array, and the n + 1 row bounds."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows of about `limit` text bytes (a longer row stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bounds = flat(batch.column(text))[1]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task: Python workers live on, and all of an executor's
    workers share its memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def numbers(column: pa.Array, null: int = -(2**63)) -> np.ndarray:
    """An integer column as int64; nulls become the smallest value."""
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i], starts[i] + 1, ... (lengths[i] of them) one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


# ---- hashing ---------------------------------------------------------------------------------

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(7).integers(1, 2**64, 256, np.uint64, endpoint=False)


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit values each; depends on their order."""
    out = left * _A
    out += right
    out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    return out


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive codes (uint64); empty if there are fewer."""
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    power, size, out, done = codes, 1, None, 0
    while True:
        if k & size:
            if out is None:
                out = power
            else:
                n = len(codes) - done - size + 1
                out = mix(out[:n], power[done : done + n])
            done += size
        if done == k:
            return out
        power = mix(power[:-size], power[size:])
        size *= 2


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


class Words:
    """Words of a chunk of texts: 64-bit hashes, byte places and row bounds. A word is a stretch of bytes of
    one kind other than 0 (separators) inside a row."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> None:
        kind = kinds[data]
        inside = kind != 0
        first, last = inside.copy(), inside.copy()
        if len(data):
            change = kind[1:] != kind[:-1]
            edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
            change[edges - 1] = True
            first[1:] &= change
            last[:-1] &= change
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, bounds)  # word bounds of each row
        lengths = self.ends - self.starts
        if len(lengths) == 0:
            self.hashes = np.zeros(0, np.uint64)
            return
        bytes_at = np.flatnonzero(inside)
        within = np.arange(len(bytes_at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        values = _TABLE[data[bytes_at]] * powers(int(lengths.max()))[within]
        sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
        self.hashes = mix(sums, lengths.astype(np.uint64))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 256)
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, 0xA0761D6478BD642F, np.uint64))])
    return _POWERS


def byte_kinds(*ranges: tuple[int, int, int]) -> np.ndarray:
    """Kinds of the 256 bytes: 1 outside the ranges (first, last, kind)."""
    out = np.ones(256, np.uint8)
    for low, high, kind in ranges:
        out[low : high + 1] = kind
    return out
