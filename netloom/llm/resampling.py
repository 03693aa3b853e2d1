"""Importance resampling towards a target distribution, by hashed word features.

A document's features are its runs of 1 to n words, hashed into buckets.  A
bucket's gain is the logarithm of its share in the target over its share in the
documents; a document's weight is the mean gain of its features.  Gumbel noise
on the weights and a cut at the highest scores draw without replacement.

Long texts are skewed work: they are split at word boundaries into chunks that
are dealt out over all tasks.  A chunk carries n - 1 words of the next one, so
that it sees whole every feature that starts in it, and it counts those only.
Counts and gains of a document's chunks are summed by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .order import prefix_sums

#: Bytes of text in a chunk, about; texts up to that are one chunk.
CHUNK_BYTES = 1 << 15
#: Words beyond so many bytes get their checksum one by one.
_LONG_WORD = 64

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


def crc_over(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers carried on over data[start:end] of each; a register is the checksum with all bits turned."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, left, out = starts[order], length[order], state[order]
    long = int(np.searchsorted(-left, -_LONG_WORD, "left"))
    for i in range(long):
        out[i] = zlib.crc32(data[at[i] : at[i] + left[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for k in range(int(left[long]) if long < len(left) else 0):
        some = slice(long, int(np.searchsorted(-left, -k, "left")))
        now = out[some]
        out[some] = _TABLE[(now ^ data[at[some] + k]) & 255] ^ (now >> 8)
    back = np.empty_like(out)
    back[order] = out
    return back


class Features:
    """Words and feature buckets of each row; `owned` words of a row start features, all of them where it is -1."""

    def __init__(self, texts: pa.Array, owned: np.ndarray, n: int, buckets: int):
        w = T.Words(texts, T.ALNUM, lower=True)
        own = np.where(owned < 0, w.count, np.minimum(owned, w.count))
        self.words = own
        mine = np.arange(len(w.row)) - w.first[w.row] < own[w.row]
        first = np.flatnonzero(mine)
        state = crc_over(np.full(len(first), 0xFFFFFFFF, np.uint32), w.data, w.starts[first], w.ends[first])
        rows, bucket = [], []
        for k in range(1, n + 1):
            rows.append(w.row[first])
            bucket.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
            if k == n:
                break
            inside = first + k < w.first[w.row[first] + 1]
            first, state = first[inside], state[inside]
            state = _TABLE[(state ^ np.uint32(32)) & 255] ^ (state >> 8)
            state = crc_over(state, w.data, w.starts[first + k], w.ends[first + k])
        self.row, self.bucket = np.concatenate(rows), np.concatenate(bucket).astype(np.int64)


def split(text: pa.Array, n: int, size: int) -> list[tuple[int, int, bytes]]:
    """(chunk, owned words, bytes) of one text: about `size` bytes of whole words, and n - 1 words that follow."""
    w = T.Words(text, T.ALNUM, lower=True)
    out, a, total = [], 0, len(w.starts)
    while a < total:
        b = max(a + 1, int(np.searchsorted(w.ends, w.starts[a] + size, "right")))
        out.append((len(out), b - a, w.data[w.starts[a] : w.ends[min(total, b + n - 1) - 1]].tobytes()))
        a = b
    return out or [(0, 0, b"")]


def chunks(texts: DataFrame, n: int, size: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, key, head, owned, text): rows of texts, the long ones split and dealt out.

    `head` is 1 on the first chunk of a row, `key` a hash of its text, `owned`
    the words whose features are the chunk's own (-1: all).
    """
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.octet_length("text") > size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = split(batch.column("text").slice(i, 1), n, size)
                some = lambda c: pa.array([batch.column(c)[i].as_py()] * len(made), pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [some("doc_id"), some("key"), pa.array([int(c == 0) for c, _, _ in made], pa.int64()), pa.array([c for c, _, _ in made], pa.int64()), pa.array([o for _, o, _ in made], pa.int64()), pa.array([b.decode() for _, _, b in made])],
                    names=["doc_id", "key", "head", "chunk", "owned", "text"],
                )

    pieces = rows.where(long).mapInArrow(cut, "doc_id long, key long, head long, chunk long, owned long, text string")
    dealt = pieces.repartition("doc_id", "key", "chunk").drop("chunk")
    whole = rows.where(~long).select("doc_id", "key", F.lit(1).cast("long").alias("head"), F.lit(-1).cast("long").alias("owned"), "text")
    return whole.unionByName(dealt)


def histogram(parts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all chunks; `buckets` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in T.slices(batches):
            total += np.bincount(Features(batch.column("text"), batch.column("owned").to_numpy(), n, buckets).bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in parts.select("owned", "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source) of each bucket."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(y) + 1) * (s + b) / ((int(x) + 1) * (t + b)))) for x, y in zip(source, target)], np.int64)


def weights(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, key, n_words, n_features, weight) of every row of documents; weight is the floored mean gain, 0 without features.

    Texts of one chunk need no sum.  Chunks of long texts are summed by doc_id
    and text; rows that repeat both share a sum, which their number divides.
    """
    parts = chunks(documents, n)
    gain = gains(histogram(parts, n, buckets), histogram(chunks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n), n, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            f = Features(batch.column("text"), batch.column("owned").to_numpy(), n, buckets)
            # sums of whole numbers below 2^53: exact in doubles
            total = np.bincount(f.row, weights=gain[f.bucket], minlength=batch.num_rows).astype(np.int64)
            arrays = [batch.column(c) for c in ("doc_id", "key", "head", "owned")] + [pa.array(f.words.astype(np.int64)), pa.array(np.bincount(f.row, minlength=batch.num_rows)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "head", "owned", "n_words", "n_features", "gain"])

    found = parts.mapInArrow(run, "doc_id long, key long, head long, owned long, n_words long, n_features long, gain long").checkpoint()
    sums = ("n_words", "n_features", "gain")
    long = found.where("owned >= 0").groupBy("doc_id", "key").agg(F.sum("head").alias("rows"), *[F.sum(c).alias(c) for c in sums])
    long = long.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select("doc_id", "key", *[F.expr(f"{c} div rows").alias(c) for c in sums])
    every = found.where("owned < 0").select("doc_id", "key", *sums).unionByName(long)
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0).cast("long")
    return every.select("doc_id", "key", "n_words", "n_features", mean.alias("weight"))


def scores(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, key, n_words, n_features, weight, score, rank) of every row; rank is null where the row is not drawn.

    score is the weight plus Gumbel noise in thousandths, whose uniform number
    is a hash of seed and doc_id.  Of the N rows with at least `least_words`
    words the floor(percent N / 100) highest scores are drawn, ties to the
    smaller doc_id, a null one first.

    Null and empty texts have no features and weight 0.  Rows go by themselves:
    repeated ids have the same noise and are drawn on their own weights.  An
    empty target leaves the gains to the smoothing; an empty table gives an
    empty table.  Other columns are not looked at.
    """
    T.prepare(documents.sparkSession)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    weighed = weights(documents, target, n, buckets).withColumn("score", F.col("weight") + noise).checkpoint()
    rows = weighed.withColumns({"_late": (F.col("n_words") < least_words).cast("int"), "_one": F.lit(1).cast("long"), "_row": F.monotonically_increasing_id()})
    drawn = percent * rows.where("_late = 0").count() // 100
    ranked = prefix_sums(rows, [], [F.col("_late"), F.col("score").desc(), F.col("doc_id"), F.col("_row")], "_one", "rank")
    return ranked.select("doc_id", "key", "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def resample(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """The drawn rows of documents, all columns; rows equal in doc_id and text are drawn together."""
    drawn = scores(documents, target, n, buckets, percent, least_words, seed).where("rank is not null").select(F.col("doc_id").alias("_id"), F.col("key").alias("_text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    return documents.join(drawn, same, "left_semi")
