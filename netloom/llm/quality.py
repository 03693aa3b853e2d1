"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .text import prepare

#: Cosines that stand for the Gaussian kernel, its width in standard deviations, ridge weight, seed.
COSINES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 20


def pool_adjacent(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the isotonic regression of labels on scores: block centres and values."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # label sum, weight, score sum
    for s, y in zip(scores[order].tolist(), labels[order].tolist()):
        blocks.append([y, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y2, w2, s2 = blocks.pop()
            blocks[-1][0] += y2
            blocks[-1][1] += w2
            blocks[-1][2] += s2
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = self.standard(x)
        return np.column_stack([np.ones(len(z)), z, np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, texts: pa.Array) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats.DocStats(texts).matrix()), *self.knots), 0, 1)


def _summed(rows: DataFrame, parts) -> tuple[np.ndarray, ...]:
    """Sums over all rows of the arrays that `parts(label, x)` gives, added up partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                ids, y, x = stats.rows_of(batch)
                got = parts(ids, y, x)
                total = got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": [[a.astype(float).tobytes() for a in total]], "shapes": [[list(a.shape) for a in total]]}, schema=pa.schema([("sums", pa.list_(pa.binary())), ("shapes", pa.list_(pa.list_(pa.int64())))]))

    out = None
    for row in rows.mapInArrow(run, "sums array<binary>, shapes array<array<bigint>>").collect():  # a row for each of a fixed number of partitions
        got = [np.frombuffer(bytes(s)).reshape(shape) for s, shape in zip(row.sums, row.shapes)]
        out = got if out is None else [a + b for a, b in zip(out, got)]
    return out


def fit(documents: DataFrame, labels: DataFrame, target: str, learn: Column) -> Model | None:
    """Learns from at most stats.SAMPLE_LABELS labelled rows: four fifths fit the ridge, one fifth calibrates it.

    Without labels, or with one class only, there is no model.
    """
    rows = stats.vectors(stats.labelled(documents, labels, target, learn), lambda texts: stats.DocStats(texts).matrix())
    fitting = lambda ids: (ids * 2654435761 >> 8) % 5 > 0
    sums = _summed(rows, lambda ids, y, x: [np.array([len(y), y.sum()]), x.sum(0), (x * x).sum(0)])
    if sums is None or not 0 < sums[0][1] < sums[0][0]:
        return None
    n = sums[0][0]
    mean = sums[1] / n
    scale = np.sqrt(np.maximum(sums[2] / n - mean**2, 1e-12))
    rng = np.random.default_rng(SEED)
    model = Model(mean, scale, rng.normal(size=(len(mean), COSINES)) / WIDTH, rng.uniform(0, 2 * np.pi, COSINES), np.zeros(1), (np.zeros(1), np.zeros(1)))

    def equations(ids, y, x):
        use = fitting(ids)
        z = model.features(x[use])
        return [z.T @ z, z.T @ y[use].astype(float)]

    left, right = _summed(rows, equations)
    model.weights = np.linalg.solve(left + RIDGE * n * np.eye(len(right)) / len(right), right)
    pairs = []
    for row in rows.toLocalIterator():  # bounded by the sample
        if not fitting(np.array([row.doc_id]))[0]:
            pairs.append((row.x, row.label))
    if not pairs:
        pairs = [(row.x, row.label) for row in rows.toLocalIterator()]
    scores = model.raw(np.array([p[0] for p in pairs]))
    model.knots = pool_adjacent(scores, np.array([p[1] for p in pairs], float))
    return model


def quality_scores(documents: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score of every row; rows with crc32(doc_id) mod folds = held are never learnt from.

    The score is the calibrated chance of label 1, from the text alone; null
    and empty texts have the score of a text without words.  Without a usable
    label every score is 0.5.  Repeated rows get equal scores; other columns
    are ignored.
    """
    prepare(documents.sparkSession)
    model = fit(documents, labels, target, stats.crc_of() % folds != held)
    score = model.score if model else lambda texts: np.full(len(texts), 0.5)
    return stats.scored(documents, score).select("doc_id", (stats.crc_of() % folds == held).alias("held_out"), "score")
