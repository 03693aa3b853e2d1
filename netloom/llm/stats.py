"""Statistics of whole documents, many rows at a time, and the labelled sample that models learn from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Frequent function words of the four languages.
FUNCTION_WORDS = (
    "the of and to in a is was for that with on as it by from at this be are he "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine "
    "de la le et les des en un une du que est pour qui dans par sur au pas "
    "el los se del las por con para una su al lo como más y"
).split()
#: Rows of labels, at most, that a model learns from.
SAMPLE_LABELS = 20_000

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(["#*$%&|<>", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", ".", ",", "!?", "|", "-_=~/\\@:;\"'()[]{}+^`"], 1):
    _CLASS[[ord(c) for c in _chars if not (_i == 1 and c == "|")]] = _i
SYMBOL, DIGIT, UPPER, LOWER, STOP, COMMA, SHOUT, PIPE, OTHER = range(1, 10)

#: In the order of DocStats.matrix().
FEATURES = (
    "log_words", "log_chars", "word_length", "symbols", "pipes", "digits", "upper", "stops", "commas", "shouts", "other_marks",
    "non_ascii", "distinct_words", "repeated_words", "same_as_previous", "dup_lines", "line_length", "function_words", "short_words", "long_words",
)


def _known(words: list[str]) -> np.ndarray:
    w = T.Words(pa.array(words), T.NON_SPACE)
    return np.unique(w.hash)


_FUNCTION = _known([v for w in FUNCTION_WORDS for v in (w, w.capitalize(), w + ",", w + ".")])


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


class DocStats:
    """Counts of each row of a slice; words are runs of anything but white space."""

    def __init__(self, texts: pa.Array):
        w = T.Words(texts, T.NON_SPACE)
        n = w.rows
        kind = _CLASS[w.data]
        begins = (w.data & 0xC0) != 0x80  # of characters
        row_of = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.at])
        self.rows, self.words = n, w
        self.n_words = w.count.astype(np.int64)
        self.n_chars = row_of(begins)
        self.word_chars = row_of(begins & T.NON_SPACE[w.data])
        self.by_kind = np.bincount(np.repeat(np.arange(n), np.diff(w.at)) * 10 + kind, minlength=10 * n).reshape(n, 10)
        self.non_ascii = row_of(w.data >= 0xC0)
        self.n_symbols = self.by_kind[:, SYMBOL] + self.by_kind[:, PIPE]
        per = lambda mask: np.bincount(w.row[mask], minlength=n)

        order = np.lexsort((w.hash, w.row))
        row, word = w.row[order], w.hash[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
        self.distinct = np.bincount(row[new], minlength=n)
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
        self.same = per(same)

        first, gram = w.shingles(3)
        order = np.lexsort((gram, w.row[first]))
        f, g = first[order], gram[order]
        equal = (g[1:] == g[:-1]) & (w.row[f[1:]] == w.row[f[:-1]]) if len(g) else np.zeros(0, bool)
        twice = np.zeros(len(g), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        covered = np.zeros(len(w.hash), bool)
        for j in range(3):
            covered[f[twice] + j] = True
        self.n_repeat_words = per(covered)

        lines = T.Words(texts, T.NON_NEWLINE)
        filled = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
        row, line = lines.row[filled], lines.hash[filled]
        self.n_lines = np.bincount(row, minlength=n)
        order = np.lexsort((line, row))
        row, line = row[order], line[order]
        self.n_dup_lines = np.bincount(row[1:][(row[1:] == row[:-1]) & (line[1:] == line[:-1])], minlength=n) if len(row) else np.zeros(n, np.int64)
        length = w.ends - w.starts
        self.function = per(_member(w.hash, _FUNCTION))
        self.short, self.long = per(length <= 2), per(length >= 15)

    def matrix(self) -> np.ndarray:
        words, chars = np.maximum(1, self.n_words), np.maximum(1, self.n_chars)
        k = self.by_kind
        letters = np.maximum(1, k[:, UPPER] + k[:, LOWER])
        return np.column_stack(
            [
                np.log1p(self.n_words), np.log1p(self.n_chars), self.word_chars / words, self.n_symbols / chars, k[:, PIPE] / words,
                k[:, DIGIT] / chars, k[:, UPPER] / letters, k[:, STOP] / words, k[:, COMMA] / words, k[:, SHOUT] / words, k[:, OTHER] / chars,
                self.non_ascii / chars, self.distinct / words, self.n_repeat_words / words, self.same / words,
                self.n_dup_lines / np.maximum(1, self.n_lines), np.log1p(self.n_chars / np.maximum(1, self.n_lines)), self.function / words, self.short / words, self.long / words,
            ]
        ).astype(float)


def crc_of(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def labelled(documents: DataFrame, labels: DataFrame, target: str, learn: Column, most: int = SAMPLE_LABELS) -> DataFrame:
    """(doc_id, label, text) of at most about `most` labelled rows that `learn` allows, chosen by a hash of doc_id.

    Several labels of one document count as their largest; null labels don't
    count.  The chosen labels are few by that bound, so they are broadcast.  Of
    documents that share a doc_id the one whose text has the least hash is
    taken, so that rows are as few as labels.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("label")).where(learn)
    total = known.count()
    share = min(1.0, most / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))


def scored(documents: DataFrame, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text")).astype(float), pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def vectors(rows: DataFrame, vector: Callable[[pa.Array], np.ndarray], parts: int = 8) -> DataFrame:
    """(doc_id, label, x) of labelled rows, in a fixed number of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            x = vector(batch.column("text"))
            at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel(), pa.float64()))], names=["doc_id", "label", "x"]
            )

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(run, "doc_id long, label int, x array<double>").repartition(parts, "doc_id").checkpoint()


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, labels and the matrix of a batch of vectors()."""
    x = batch.column("x")
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return batch.column("doc_id").to_numpy(), batch.column("label").to_numpy(), flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
