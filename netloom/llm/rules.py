"""Quality rules: fixed document counts, and gradient-boosted trees that judge what passes them.

The trees are grown on the driver from a bounded labelled sample, on binned
statistics, with the logistic loss.  Features of MONOTONE can only lower the
chance of a good document as they rise: a split that would raise it is not
taken, and the values below a split are bounded by its middle.  The forest is
flattened into numpy node arrays, which all rows of a batch walk together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats
from . import text as T

TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 60, 4, 64, 0.2, 20, 1.0
#: Features whose rise never makes a document better.
MONOTONE = {"symbols", "pipes", "repeated_words", "same_as_previous", "dup_lines"}
#: The chance of a good document from which the verdict is to keep it.
KEEP = 0.5


@dataclass
class Forest:
    """Node i of the flat arrays: go left if x[feature] <= threshold; a leaf has itself as both children."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, falling: np.ndarray, trees: int = TREES) -> Forest:
    """Boosted trees of the chance of y = 1; `falling` marks the features that can only lower it."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    score = np.full(n, bias)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + RIDGE), lo, hi))

    def split(rows: np.ndarray, grad, hess, depth: int, lo: float, hi: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        me = len(nodes)
        nodes.append([0, 0.0, me, me, RATE * leaf(g, h, lo, hi)])
        if depth == DEPTH or len(rows) < 2 * LEAST_ROWS:
            return me
        best, at = 1e-6, None
        for j in range(k):
            m = len(edges[j])
            if not m:
                continue
            b = binned[rows, j]
            gs = np.cumsum(np.bincount(b, grad[rows], m + 1))[:-1]
            hs = np.cumsum(np.bincount(b, hess[rows], m + 1))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=m + 1))[:-1]
            vl, vr = np.clip(-gs / (hs + RIDGE), lo, hi), np.clip(-(g - gs) / (h - hs + RIDGE), lo, hi)
            gain = gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - g**2 / (h + RIDGE)
            gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = 0
            if falling[j]:
                gain[vr > vl] = 0
            i = int(gain.argmax())
            if gain[i] > best:
                best, at = gain[i], (j, i, vl[i], vr[i])
        if at is None:
            return me
        j, i, vl, vr = at
        low = binned[rows, j] <= i
        middle = (vl + vr) / 2
        left = split(rows[low], grad, hess, depth + 1, middle if falling[j] else lo, hi)
        right = split(rows[~low], grad, hess, depth + 1, lo, middle if falling[j] else hi)
        nodes[me][:4] = [j, edges[j][i], left, right]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        first = len(nodes)
        roots.append(split(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
        tree = Forest(*_flat(nodes), np.array([first]), 0.0)
        score += tree.raw(x)
    return Forest(*_flat(nodes), np.array(roots), bias)


def _flat(nodes: list[list[float]]) -> tuple[np.ndarray, ...]:
    a = np.array(nodes)
    return a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]


def fit(documents: DataFrame, labels: DataFrame, target: str) -> Forest | None:
    rows = stats.vectors(stats.labelled(documents, labels, target, F.lit(True)), lambda texts: stats.DocStats(texts).matrix())
    got = [(r.doc_id, r.x, r.label) for r in rows.toLocalIterator()]  # at most stats.SAMPLE_LABELS rows
    y = np.array([g[2] for g in got], float)
    if not 0 < y.sum() < len(y):
        return None
    got.sort(key=lambda g: g[0])
    return grow(np.array([g[1] for g in got]), np.array([g[2] for g in got], float), np.array([f in MONOTONE for f in stats.FEATURES]))


def quality_rules(documents: DataFrame, labels: DataFrame, target: str = "quality", least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, chance, kept.

    base_failed: under `least_words` words, or over `repeat_percent` percent of
    the words in repeated 3-word windows.  kept: not base_failed, and the
    trees' chance of a good document is KEEP or more; without usable labels the
    base rules decide alone.  Null and empty texts have no words and fail.
    Repeated rows get equal results; other columns are ignored.
    """
    T.prepare(documents.sparkSession)
    forest = fit(documents, labels, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            s = stats.DocStats(batch.column("text"))
            chance = forest.chance(s.matrix()) if forest else np.ones(batch.num_rows)
            failed = (s.n_words < least_words) | (100 * s.n_repeat_words > repeat_percent * s.n_words)
            counts = [pa.array(c.astype(np.int64)) for c in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(failed), pa.array(chance), pa.array(~failed & (chance >= KEEP))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chance", "kept"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chance double, kept boolean"
    )
