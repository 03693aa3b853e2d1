"""Shared pieces of the corpus operators.

Text is handled as the UTF-8 bytes of whole Arrow columns: words, lines and
shingles of all rows of a batch are found with a few numpy passes, and no
Python object is made for a word.  A null text is an empty text everywhere.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; a longer single text is one pass.
SLICE_BYTES = 1 << 20
REPO = str(Path(__file__).resolve().parents[2])

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words cut at white space, and of words of digits, letters and all non-ASCII.
NON_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = True
ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[128:] = True
NON_NEWLINE = np.ones(256, bool)
NON_NEWLINE[10] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _INVERSE = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
_STEP = [pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(64)]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept by the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + 4096), np.uint64(base))
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > 8 * SLICE_BYTES:
            return out
        have = _powers[base] = out
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows on end, and len + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows, in runs of about SLICE_BYTES of text."""
    for batch in batches:
        _, at = buffers(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


class Words:
    """Runs of `inside` bytes of each row: byte starts and ends, row numbers, 64-bit hashes of the bytes."""

    def __init__(self, texts: pa.Array, inside: np.ndarray, lower: bool = False):
        self.data, self.at = buffers(texts)
        if lower:
            self.data = _LOWER[self.data]
        n, self.rows = len(self.data), len(self.at) - 1
        mask = np.zeros(n + 1, bool)
        mask[:n] = inside[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before = np.zeros(n + 1, bool)
        before[1:] = mask[:-1]
        self.starts = np.flatnonzero(mask & (~before | edge))
        self.ends = np.flatnonzero(before & (~mask | edge))
        self.row = np.searchsorted(self.at, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, self.at)  # of each row, and the total
        self.count = np.diff(self.first)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power(_BASE, n), out=sums[1:])
            self._sums = sums
            self.hash = self._hash(self.starts, self.ends)

    def _hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self._sums[ends] - self._sums[starts]) * _power(_INVERSE, len(self.data) + 1)[starts] + (ends - starts).astype(np.uint64))

    def stem(self, k: int, which: np.ndarray) -> np.ndarray:
        """Hashes of the first k bytes of the given words, equal to those of such whole words."""
        return self._hash(self.starts[which], self.starts[which] + k)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words within a row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return first, shingle_hash([self.hash[first + j] for j in range(k)])


def shingle_hash(parts: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.full(len(parts[0]), np.uint64(len(parts)), np.uint64)
        for j, part in enumerate(parts):
            total = total + part * np.uint64(_STEP[j + 1])
        return _mix(total)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batches of bounded size, the package on the workers' path, and a folder for checkpoints.

    The folder is the cluster's spark.checkpoint.dir; only where it is unset
    (tests, local runs) a folder of this machine is taken.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, env.get("PYTHONPATH", "")]))
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file:///tmp/netloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that checkpoints have cut off; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store, through Spark's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def pieces_of(spark: SparkSession, rows: int, each: int, least: int = 1, most: int = 200_000) -> int:
    """How many partitions give about `each` rows, at least the session's shuffle partitions."""
    return int(min(most, max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))))
