"""Token counts by section: whole documents are encoded once, and their tokens dealt to spans of characters.

A token belongs to the section that holds most of its characters; where two
hold equally many, to the earlier one; a token of no section's characters is
counted as outside.  With rule="start" a token belongs to the section of its
first character instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .encode import encoder


def deal(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, finish: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none), and whether it crosses a section's edge.

    Tokens and sections are in order, and sections do not overlap.
    """
    n = len(begin)
    if not n:
        return np.full(len(starts), -1), np.zeros(len(starts), bool)
    stop = np.maximum(ends, starts + 1)
    first = np.searchsorted(finish, starts, "right")  # the first section that ends after the token starts
    last = np.searchsorted(begin, stop, "left") - 1  # the last one that begins before it ends
    inside = np.minimum(first, n - 1)
    whole = (first <= last) & (first < n) & (begin[inside] <= starts) & (stop <= finish[inside])
    out = np.where(whole, inside, -1)
    crossing = ~whole & (first <= last) & (first < n)
    for i in np.flatnonzero(crossing):  # few: an interval join of what the edges cut
        if rule == "start":
            out[i] = first[i] if begin[first[i]] <= starts[i] else -1
            continue
        over = [min(stop[i], finish[s]) - max(starts[i], begin[s]) for s in range(first[i], last[i] + 1)]
        out[i] = first[i] + int(np.argmax(over))
    return out, crossing


def token_counts(documents: DataFrame, spans: Column, path: str, rule: str = "most") -> DataFrame:
    """Per row: doc_id, n_tokens, counts (a number for each span, in order), n_outside, n_crossing.

    `spans` is array<struct<start, end>> of characters, in order and without
    overlap; null or empty: every token is outside, and empty spans get none.
    Null and empty texts have no tokens.  Repeated rows are counted each for
    itself; other columns are ignored.
    """
    T.prepare(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(spans, F.array()).cast("array<struct<start: bigint, end: bigint>>").alias("spans"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            n_tokens, (_, starts, ends) = encoder(path, spans=True).encode(batch.column("text"))
            at = np.concatenate([[0], np.cumsum(n_tokens)])
            lists = batch.column("spans")
            flat, cut = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            begin, finish = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            counts, outside, crossing = [], [], []
            for i in range(batch.num_rows):
                which = np.flatnonzero(finish[cut[i] : cut[i + 1]] > begin[cut[i] : cut[i + 1]]) + cut[i]
                section, over = deal(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], begin[which], finish[which], rule)
                each = np.zeros(cut[i + 1] - cut[i], np.int64)
                each[which - cut[i]] = np.bincount(section[section >= 0], minlength=len(which))
                counts.append(each)
                outside.append(int((section < 0).sum()))
                crossing.append(int(over.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(counts, pa.list_(pa.int64())), pa.array(outside, pa.int64()), pa.array(crossing, pa.int64())],
                names=["doc_id", "n_tokens", "counts", "n_outside", "n_crossing"],
            )

    return rows.mapInArrow(run, "doc_id long, n_tokens long, counts array<bigint>, n_outside long, n_crossing long")


def head_body_tail(text: str = "text") -> Column:
    """Spans of the first sentence (to the first full stop), the last line, and what is between."""
    text = F.coalesce(F.col(text), F.lit(""))
    n = F.length(text)
    stop = F.instr(text, ".")
    head = F.when(stop > 0, stop).otherwise(n)
    tail = F.greatest(head, n - F.length(F.substring_index(text, "\n", -1)))
    spans = [(F.lit(0), head), (head, tail), (tail, n)]
    return F.array(*(F.struct(a.cast("long").alias("start"), b.cast("long").alias("end")) for a, b in spans))
