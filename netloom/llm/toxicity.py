"""Toxicity by weak supervision.

Many voters look at a document: lexicon voters (a word, or the first bytes of
a word, that the labelled sample shows almost only in toxic texts) and pattern
voters (shouting, and the like).  A generative label model, whose parameters
are the voters' accuracies and a tree of correlations between them within
either class, is estimated by expectation-maximisation from the votes alone.
A linear classifier is trained on its posterior labels and scores every text.
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

# Insults that are voters before any label is seen.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown dumb dumbass fool imbecile jerk freak creep garbage vermin retard "
    "arschloch dummkopf abschaum versager widerlich blödmann connard crétin imbécile abruti ordure minable idiota imbécil estúpido basura asqueroso inútil"
).split()
#: Word beginnings, in bytes, that can be lexicon entries besides whole words.
STEMS = (4, 5, 6, 7)
#: A lexicon entry occurs in so many toxic sample texts, and in this share of them, and has this precision there.
LEAST_TOXIC, LEAST_SHARE, PRECISION = 6, 0.02, 0.6
#: Lexicon voters at most, and rounds of expectation-maximisation.
VOTERS, ROUNDS = 256, 30
#: Rounds that learn the tree of correlations anew; the least information (in nats of all rows) of a branch; imagined rows for each chance, by class.
TREES, LEAST_GAIN, FEW = 4, 6.0, (0.2, 0.2)
#: Share of the labelled rows whose labels say where the label model starts; ridge of the classifier.
SEEDS, RIDGE = 0.25, 1e-3
#: Pattern voters: name, which statistic (of stats.FEATURES), threshold.
PATTERNS = (("shouting", "shouts", 0.2), ("capitals", "upper", 0.5), ("symbols", "symbols", 0.05), ("repeats", "repeated_words", 0.5), ("runs", "same_as_previous", 0.2))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, T.Words]:
    """Row and hash of every word and every stem of a longer word."""
    w = T.Words(texts, T.ALNUM, lower=True)
    rows, hashes = [w.row], [w.hash]
    for k in STEMS:
        longer = np.flatnonzero(w.ends - w.starts > k)
        rows.append(w.row[longer])
        hashes.append(w.stem(k, longer))
    return np.concatenate(rows), np.concatenate(hashes), w


def _evidence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    order_row, hashes, w = _tokens(texts)
    order = np.lexsort((hashes, order_row))
    row, h = order_row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice the labelled texts, toxic and not, that hold a token."""
    for batch in T.slices(batches):
        row, h = _evidence(batch.column("text"))
        toxic = batch.column("label").to_numpy(zero_copy_only=False)[row] > 0
        unique, code = np.unique(h, return_inverse=True)
        bad = np.bincount(code[toxic], minlength=len(unique))
        good = np.bincount(code[~toxic], minlength=len(unique))
        yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(bad, pa.int64()), pa.array(good, pa.int64())], names=["token", "bad", "good"])


@dataclass
class Model:
    lexicon: np.ndarray  # ascending
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        x = _inputs((votes(texts, self.lexicon) > 0).astype(np.float32))
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def votes(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """How often each lexicon voter fires in each row, then 0 or 1 of the pattern voters."""
    row, h, w = _tokens(texts)
    out = np.zeros((w.rows, len(lexicon) + len(PATTERNS)))
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        hit = lexicon[at] == h
        np.add.at(out, (row[hit], at[hit]), 1)
    x = stats.DocStats(texts).matrix()
    for j, (_, name, least) in enumerate(PATTERNS):
        out[:, len(lexicon) + j] = x[:, stats.FEATURES.index(name)] >= least
    return out


def _inputs(fired: np.ndarray) -> np.ndarray:
    """Of the classifier: whether each voter fired, how many did, whether any of the lexicon did."""
    lexicon = fired[:, : fired.shape[1] - len(PATTERNS)]
    return np.column_stack([fired, np.log1p(lexicon.sum(1)), lexicon.any(1)]).astype(np.float32)


@dataclass
class LabelModel:
    """Chance of label 1, and of each voter to fire given the label and what its parent voter did.

    The pairwise correlations are parameters: each class's joint distribution
    of the votes is a tree, fire[j, y, v] is the chance of voter j where the
    label is y and voter parent[j] (none: -1) has voted v.
    """

    share: float
    parent: np.ndarray
    fire: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Exact chance of label 1 of each row of votes (0 or 1)."""
        logit = np.full(len(fired), np.log(self.share / (1 - self.share)))
        for j, up in enumerate(self.parent):
            seen = fired[:, up].astype(np.int64) if up >= 0 else np.zeros(len(fired), np.int64)
            yes = np.log(self.fire[j, 1] / self.fire[j, 0])
            no = np.log((1 - self.fire[j, 1]) / (1 - self.fire[j, 0]))
            logit += np.where(fired[:, j] > 0, yes[seen], no[seen])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _pairs(fired: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted counts of rows in which both of two voters fire; each voter's own on the diagonal."""
    return ((fired * weight[:, None].astype(np.float32)).T @ fired).astype(float)


def _tree(both: list[np.ndarray], total: list[float]) -> np.ndarray:
    """Parents of the tree of largest mutual information between voters within the classes (ties: least number)."""
    k = len(both[0])
    gain = np.zeros((k, k))
    for c, n in zip(both, total):
        n = max(n, 1e-9)
        one = np.diag(c)
        cells = (c, one[:, None] - c, one[None, :] - c, n - one[:, None] - one[None, :] + c)
        sides = ((one, one), (one, n - one), (n - one, one), (n - one, n - one))
        for x, (rows, columns) in zip(cells, sides):
            expected = rows[:, None] * columns[None, :] / n
            gain += np.where((x > 1e-9) & (expected > 1e-9), x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0)
    parent, inside = np.full(k, -1), np.zeros(k, bool)
    best, via = np.full(k, -1.0), np.full(k, -1)
    for _ in range(k):  # the heaviest spanning tree, one voter at a time
        j = int(np.where(inside, -np.inf, best).argmax())
        inside[j], parent[j] = True, via[j]
        nearer = ~inside & (gain[j] > best) & (gain[j] > LEAST_GAIN)
        best[nearer], via[nearer] = gain[j][nearer], j
    return parent


def _estimate(fired: np.ndarray, times: np.ndarray, p: np.ndarray, parent: np.ndarray | None) -> LabelModel:
    """The likeliest model (with a few imagined rows for each parameter) of votes with posteriors p; a None tree is learnt, too."""
    both = [_pairs(fired, times * (1 - p)), _pairs(fired, times * p)]
    total = [float((times * (1 - p)).sum()), float((times * p).sum())]
    if parent is None:
        parent = _tree(both, total)
    fire = np.empty((len(parent), 2, 2))
    for y in (0, 1):
        one = np.diag(both[y])
        alone = (one + 0.5 * FEW[y]) / (total[y] + FEW[y] + 0.5)
        up = np.maximum(parent, 0)
        joint = both[y][np.arange(len(parent)), up]
        # each chance leans on the voter's own by as much as FEW rows would
        with_it = (joint + 2 * alone) / (one[up] + 2)
        without = (one - joint + 2 * alone) / (total[y] - one[up] + 2)
        fire[:, y, 0] = np.where(parent >= 0, without, alone)
        fire[:, y, 1] = np.where(parent >= 0, with_it, alone)
    share = float(np.clip(total[1] / max(sum(total), 1e-9), 1e-3, 1 - 1e-3))
    return LabelModel(share, parent, np.clip(fire, 1e-4, 1 - 1e-4))


def label_model(fired: np.ndarray, times: np.ndarray, start: np.ndarray) -> LabelModel:
    """Expectation-maximisation over distinct rows of votes and how often each occurs; no label takes part.

    `start` holds the posteriors of the first round.  The tree of correlations
    is learnt anew in the first rounds and then stays.
    """
    p = np.asarray(start, float)
    model = None
    for turn in range(ROUNDS):
        model = _estimate(fired, times, p, None if turn < TREES else model.parent)
        p = model.posterior(fired)
    return model


def linear(x: np.ndarray, target: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on posterior labels, with a little ridge, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x), np.float32)])
    w = np.zeros(a.shape[1])
    n = times.sum()
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (times * (q - target)) / n + ridge * w
        bend = (a * (times * np.maximum(q * (1 - q), 1e-4))[:, None].astype(np.float32)).T @ a / n + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _patterns(lexicon: np.ndarray):
    """Of each row of texts the voters that fired, as packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            bits = np.packbits(votes(batch.column("text"), lexicon) > 0, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bits], pa.binary()), batch.column("seed")], names=["bits", "seed"])

    return run


def fit(documents: DataFrame, labels: DataFrame, target: str, learn) -> Model | None:
    """Learns from at most stats.SAMPLE_LABELS labelled rows; without toxic and other ones there is no model.

    Labels find the lexicon voters, and those of SEEDS of the rows say where
    the label model starts.  What it then estimates, and what the classifier
    learns, comes from the votes of all the rows alone.  Equal texts count
    once, as toxic if one of them is.
    """
    rows = stats.labelled(documents, labels, target, learn).groupBy(F.xxhash64("text").alias("h")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    rows = rows.withColumn("seed", F.when(F.pmod("h", F.lit(100)) < int(100 * SEEDS), F.col("label"))).select("label", "seed", "text").checkpoint()
    counts = rows.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    if not counts.n or not 0 < (counts.bad or 0) < counts.n:
        return None
    bad, good = F.sum("bad").alias("bad"), F.sum("good").alias("good")
    found = (
        rows.mapInArrow(_mine, "token long, bad long, good long")
        .groupBy("token")
        .agg(bad, good)
        .where((F.col("bad") >= max(LEAST_TOXIC, LEAST_SHARE * counts.bad)) & (F.col("bad") >= PRECISION * (F.col("bad") + F.col("good"))))
        .orderBy(F.col("bad").desc(), "token")
        .limit(VOTERS)  # the number of voters is a parameter
        .collect()
    )
    seeds = T.Words(pa.array(INSULTS), T.ALNUM, lower=True).hash
    lexicon = np.unique(np.concatenate([np.array([r.token for r in found], np.int64).view(np.uint64), seeds]))
    voters = len(lexicon) + len(PATTERNS)
    # distinct patterns of votes with their numbers: bounded by the sample, 40 bytes each
    patterns = rows.mapInArrow(_patterns(lexicon), "bits binary, seed int").groupBy("bits").agg(F.count("*").alias("n"), F.count("seed").alias("seeds"), F.coalesce(F.sum("seed"), F.lit(0)).alias("toxic")).orderBy("bits").collect()
    fired = np.unpackbits(np.frombuffer(b"".join(bytes(r.bits) for r in patterns), np.uint8).reshape(len(patterns), -1), axis=1)[:, :voters].astype(np.float32)
    times, seeded, toxic = (np.array([r[c] for r in patterns], float) for c in ("n", "seeds", "toxic"))
    used = np.flatnonzero(fired.any(0))  # a voter that never fires tells nothing
    share = counts.bad / counts.n
    # the start: one voter's firing in seed rows of either label, each voter by itself
    yes = np.log(((fired.T @ toxic) + 0.5 * share) / (toxic.sum() + 0.5) / (((fired.T @ (seeded - toxic)) + 0.5 * (1 - share)) / ((seeded - toxic).sum() + 0.5)))
    start = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + fired @ np.maximum(yes, 0), -6, 6)))
    p = label_model(fired[:, used], times, start).posterior(fired[:, used])
    x = _inputs(fired)
    mean = times @ x / times.sum()
    scale = np.maximum(np.sqrt(np.maximum(times @ (x * x) / times.sum() - mean**2, 0)), 1e-3)
    weights, bias = linear(((x - mean) / scale).astype(np.float32), p, times)
    return Model(lexicon, weights, bias, mean, scale)


def toxicity_scores(documents: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score of every row; rows with crc32(doc_id) mod folds = held are never learnt from.

    The score is the chance of label 1, from the whole text alone; null and
    empty texts have that of a text in which no voter fires.  Without usable
    labels every score is 0: nothing is rejected.  Repeated rows get equal
    scores; other columns are ignored.
    """
    T.prepare(documents.sparkSession)
    model = fit(documents, labels, target, stats.crc_of() % folds != held)
    score = model.score if model else lambda texts: np.zeros(len(texts))
    return stats.scored(documents, score).select("doc_id", (stats.crc_of() % folds == held).alias("held_out"), "score")


def without_toxic(documents: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of `documents`, all columns, that score under `least`."""
    T.prepare(documents.sparkSession)
    model = fit(documents, labels, "toxic", stats.crc_of() % 3 != 1)
    if not model:
        return documents
    # the score is the text's alone, so rows go by their text, whatever their doc_id
    bad = stats.scored(documents.select(F.xxhash64("text").alias("doc_id"), "text"), model.score).where(F.col("score") >= least).select(F.col("doc_id").alias("h")).distinct()
    return documents.join(bad, F.xxhash64(documents["text"]) == bad["h"], "left_anti")
