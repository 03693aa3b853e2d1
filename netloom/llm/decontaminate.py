"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Every benchmark item is cut into windows of `window` consecutive words (a
shorter item is one window).  A window is the set of its `shingle`-word
shingles; a document contains it only if it holds all of them, so the
necessary prefix of a window is one token, and the rarest serves best: the
shingles of the benchmark are ordered by their number of occurrences over all
documents, and a window with a shingle that no document has is out at once.
The join is on that rarest shingle.  Length (the window ends inside the
document) and position (it starts inside it) bound the pairs, and the words
around the occurrence, which travel with it, are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Bits of the shingle filter that tasks carry: 1 MB, whatever the benchmark's size.
FILTER_BITS = 1 << 23
#: A hot shingle's occurrences are dealt over so many join keys.
SALTS = 32


def _words(texts: pa.Array) -> T.Words:
    return T.Words(texts, T.ALNUM, lower=True)


def _windows(window: int, shingle: int):
    """(window's words, item, shingles in order) of each item, with repeats inside an item dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            w = _words(batch.column("text"))
            k = shingle
            for row, item in enumerate(batch.column("item_id").to_pylist()):
                lo, hi = w.first[row], w.first[row + 1]
                if lo == hi:
                    continue
                n = min(window, hi - lo)
                seen = {}
                for at in range(lo, hi - n + 1):
                    seen[b" ".join(map(w.word, range(at, at + n)))] = at
                size = min(k, n)
                starts = np.arange(lo, hi - size + 1)
                grams = T.shingle_hash([w.hash[starts + j] for j in range(size)]).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "win": pa.array([x.decode() for x in seen], pa.string()),
                        "item_id": pa.array([None if item is None else str(item)] * len(seen), pa.string()),
                        "len": pa.array([n] * len(seen), pa.int32()),
                        "size": pa.array([size] * len(seen), pa.int32()),
                        "grams": pa.array([grams[at - lo : at - lo + n - size + 1] for at in seen.values()], pa.list_(pa.int64())),
                    }
                )

    return run


def _occurrences(bits: bytes, sizes: list[int], window: int):
    """Of each document its number of words, and each shingle that the filter lets pass with the words around it."""
    table = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            w = _words(batch.column("text"))
            rows, grams, places, froms, around, sized = [], [], [], [], [], []
            for size in sizes:
                first, gram = w.shingles(size)
                bit = gram & np.uint64(FILTER_BITS - 1)
                hit = np.flatnonzero((table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                for at, g in zip(first[hit].tolist(), gram[hit].view(np.int64).tolist()):
                    row = w.row[at]
                    lo = max(w.first[row], at - (window - size))
                    hi = min(w.first[row + 1], at + window)
                    rows.append(row)
                    grams.append(g)
                    sized.append(size)
                    places.append(at - w.first[row])
                    froms.append(lo - w.first[row])
                    around.append([x.decode() for x in map(w.word, range(lo, hi))])
            n = batch.num_rows
            ids = batch.column("key")
            none = lambda kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(w.count, pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.list_(pa.string()))],
                names=["key", "n_words", "gram", "size", "place", "begin", "around"],
            )
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.nulls(len(rows), pa.int64()), pa.array(grams, pa.int64()), pa.array(sized, pa.int32()), pa.array(places, pa.int64()), pa.array(froms, pa.int64()), pa.array(around, pa.list_(pa.string()))],
                    names=["key", "n_words", "gram", "size", "place", "begin", "around"],
                )

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (sorted item ids as strings), spans.

    `spans` lists (start, len) in words of each window found.  Null and empty
    texts have no words and no hits; items without words are ignored, and those
    without an item_id hit words but are not listed; an empty benchmark hits nothing; repeated documents are reported one by one, and
    repeated items each count.  Other columns are ignored, whatever they are
    called.  Rows that share a doc_id are told apart by the text's hash; rows
    equal in both are counted together and given back as often as they came.
    """
    return _contamination(documents, benchmark, window, shingle).drop("h")


def _contamination(documents: DataFrame, benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """contamination, with the text's hash as h."""
    spark = T.prepare(documents.sparkSession)
    wins = (
        benchmark.select("item_id", "text")
        .mapInArrow(_windows(window, shingle), "win string, item_id string, len int, size int, grams array<long>")
        .checkpoint()
    )
    word = F.shiftright(F.col("bit").bitwiseAND(F.lit(FILTER_BITS - 1)), 6)
    cells = (
        wins.select(F.explode("grams").alias("bit"))
        .select(word.alias("cell"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
    )
    table = np.zeros(FILTER_BITS // 64, np.int64)  # at most so many cells come to the driver
    for row in cells.toLocalIterator():
        table[row.cell] = row.bits
    sizes = [r.size for r in wins.select("size").distinct().collect()]  # at most `shingle` values
    found = (
        documents.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
        .mapInArrow(
            _occurrences(table.tobytes(), sorted(sizes), window),
            "key struct<doc_id: bigint, h: bigint>, n_words long, gram long, size int, place long, begin long, around array<string>",
        )
        .checkpoint()
    )
    counts = found.where("n_words is not null").select("key", "n_words")
    occurrences = found.where("gram is not null").drop("n_words")
    df = occurrences.groupBy("gram", "size").agg(F.count("*").alias("df"))

    kinds = wins.groupBy("win", "len", "size").agg(F.collect_set("item_id").alias("items"), F.first("grams").alias("grams"))
    prefix = (
        kinds.select("win", "len", "size", "items", F.size("grams").alias("n_grams"), F.posexplode("grams").alias("offset", "gram"))
        .join(df, ["gram", "size"])
        .groupBy("win")
        .agg(
            F.count("*").alias("there"),
            F.first("n_grams").alias("n_grams"),
            F.first("len").alias("len"),
            F.first("size").alias("size"),
            F.first("items").alias("items"),
            F.min(F.struct("df", "gram", "offset")).alias("rarest"),
        )
        .where("there = n_grams")
        .select("items", "len", "size", F.split("win", " ").alias("words"), "rarest.gram", "rarest.offset", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    start = F.col("place") - F.col("offset")
    hits = (
        occurrences.withColumn("salt", F.pmod(F.xxhash64("key", "place"), F.lit(SALTS)).cast("int"))
        .join(prefix, ["gram", "size", "salt"])
        .where((start >= F.col("begin")) & (start + F.col("len") <= F.col("begin") + F.size("around")))
        .where(F.slice("around", (start - F.col("begin") + 1).cast("int"), F.col("len")) == F.col("words"))
        .select("key", start.alias("start"), "len", "items")
    )
    per = hits.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["to"], s["start"]))).cast("long").alias("n"),
            F.greatest(a["to"], s["start"] + s["len"]).alias("to"),
        ),
    )["n"]
    return counts.join(per.withColumn("n_hit", covered), counts["key"].eqNullSafe(per["key"]), "left").select(
        counts["key.doc_id"].alias("doc_id"),
        counts["key.h"].alias("h"),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start: bigint, len: int>>")).alias("spans"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """The rows of `documents`, all columns, without those of which a benchmark window occurs."""
    bad = _contamination(documents, benchmark, window, shingle).where("n_hit > 0").select("doc_id", "h").distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(documents["text"]) == bad["h"]), "left_anti")
