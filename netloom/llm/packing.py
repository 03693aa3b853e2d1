"""Best-fit packing of documents into sequences, by a configuration linear program.

A configuration is a multiset of piece lengths that fits a sequence; the
program covers the histogram of lengths with as few configurations as it can.
Multiplicative weights solve it: each length has a price, a knapsack dynamic
program prices the best configuration around every length, lengths that lag
behind their share of the demand grow dearer and those ahead cheaper, and the
prices bound from below what any packing needs.  The fractional solution is
rounded, what is left is solved again, and only the last pieces, which no good
configuration holds any more, are packed largest first.

Only the histogram (a row for each length, at most the sequence length) comes
to the driver, so the program does not grow with the number of documents; the
plan goes back as a table of (length, ranks) -> places, of the same kind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .encode import encoder

#: Rounds of the multiplicative weights, and pricings in each at most; how fast a length that lags behind by a whole round grows dearer; solutions of what is left, at most.
ROUNDS, TRIES, ETA, SOLUTIONS = 4, 12, 0.02, 12
#: Of two multisets of a length the one of fewer, longer pieces is a little dearer at first: short pieces fill many gaps.
STEEP = 1.002
#: How much worse filled than the fractional solution on average a configuration may be that is rounded up.
WORSE = 0.004
_RANK_BITS = 48


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each capacity up to the given one the dearest multiset's price, and an index into lengths (ascending) that it holds, or -1 where one token less does as well."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1, np.int32)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = fits[c]
        if n:
            value = best[c - lengths[:n]] + prices[:n]
            i = int(value.argmax())
            if value[i] > best[c]:
                best[c], taken[c] = value[i], i
    return best, taken


def _traced(taken: np.ndarray, lengths: np.ndarray, capacity: int) -> list[int]:
    out, c = [], capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out.append(int(taken[c]))
            c -= int(lengths[taken[c]])
    return out


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float]:
    """Configurations ((index, times), ...) with how often each is used, fractionally, and a lower bound of the sequences that any packing needs.

    Every round asks for one more share of each length's demand.  A length
    that lags is put into the dearest configuration around it, as often as no
    other length of it runs more than a round ahead.
    """
    weight: dict[tuple, float] = {}
    covered, prices, bound = np.zeros(len(sizes)), (sizes / capacity) ** STEEP, 0.0
    share = demand / rounds
    for turn in range(1, rounds + 1):
        room = np.minimum((turn + 1) * share, demand) - covered
        for again in range(TRIES):
            # lengths that have run a round ahead wait
            free = np.flatnonzero(room > 1e-9) if again else np.arange(len(sizes))
            if not len(free):
                break
            best, taken = _knapsack(sizes[free], prices[free], capacity)
            if not again:
                bound = max(bound, float(demand @ prices) / best[capacity])
            moved = False
            for i in free[np.argsort(-sizes[free], kind="stable")].tolist():
                lacks = turn * share[i] - covered[i]
                if lacks <= 1e-9:
                    continue
                rest = free[_traced(taken, sizes[free], capacity - int(sizes[i]))]
                kinds, times = np.unique(np.append(rest, i), return_counts=True)
                step = min(float((room[kinds] / times).min()), lacks / float(times[kinds == i][0]))
                if step <= 1e-9:
                    continue
                key = tuple(zip(kinds.tolist(), times.tolist()))
                weight[key] = weight.get(key, 0.0) + step
                covered[kinds] += times * step
                room[kinds] -= times * step
                moved = True
            if not moved:
                break
        prices = prices * np.exp(ETA * np.clip((turn * share - covered) / share, -2, 2))
    return weight, bound


def configurations(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration, how often) that hold every piece of the histogram exactly once."""
    return _planned(histogram, capacity, rounds)[0]


def _planned(histogram: dict[int, int], capacity: int, rounds: int) -> tuple[list[tuple[dict[int, int], int]], float, float]:
    """The plan, a lower bound of its sequences, and the share of all tokens that the program placed."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return [], 0.0, 1.0
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    tokens = lambda: int(left @ lengths)
    total, lower = tokens(), 0.0

    def use(kinds: list[int], times: list[int], often: int) -> None:
        for i, t in zip(kinds, times):
            left[i] -= t * often
        plan.append(({int(lengths[i]): t for i, t in zip(kinds, times)}, often))

    # full pieces need no program
    if lengths[-1] == capacity:
        lower += int(left[-1])
        use([len(lengths) - 1], [1], int(left[-1]))
    first = True
    for _ in range(SOLUTIONS if rounds else 0):
        live = np.flatnonzero(left)
        if not len(live):
            break
        weight, bound = solve(lengths[live], left[live].astype(float), capacity, rounds)
        if first:
            lower, first = lower + bound, False
        full = {key: sum(int(lengths[live[i]]) * t for i, t in key) / capacity for key in weight}
        mean = sum(full[key] * x for key, x in weight.items()) / max(sum(weight.values()), 1e-9)
        before = tokens()
        # whole uses first, then one more of the best filled of which a part is left over
        for up in (False, True):
            for key, x in sorted(weight.items(), key=(lambda kx: (-full[kx[0]], -(kx[1] % 1), kx[0])) if up else (lambda kx: (-kx[1], kx[0]))):
                if full[key] < mean - WORSE:
                    continue
                often = min(min(int(left[live[i]]) // t for i, t in key), 1 if up else int(x + 1e-9))
                if often:
                    use([int(live[i]) for i, _ in key], [t for _, t in key], often)
        if before - tokens() < 0.02 * before:
            break
    placed = 1 - tokens() / total
    # the rest: largest first, each filled with the largest that fit
    while left.any():
        room, chosen = capacity, {}
        top = len(lengths)
        while room > 0:
            top = min(top, int(np.searchsorted(lengths, room, "right")))
            there = np.flatnonzero(left[:top])
            if not len(there):
                break
            i = int(there[-1])
            n = int(min(left[i], room // lengths[i]))
            chosen[i] = n
            room -= n * int(lengths[i])
            top = i
        use(list(chosen), list(chosen.values()), min(int(left[i]) // n for i, n in chosen.items()))
    return plan, lower, placed


def _places(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For each run of ranks of a length: key (length and first rank), first sequence, pieces per sequence, offset."""
    rows, ranks, sequence = [], {}, 0
    for chosen, often in plan:
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            first = ranks.get(length, 0)
            rows.append(((length << _RANK_BITS) | first, sequence, n, offset))
            ranks[length] = first + n * often
            offset += n * length
        sequence += often
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def _cutter(path: str, end_id: int | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            counts, (flat, *_) = encoder(path).encode(batch.column("text"))
            at = np.concatenate([[0], np.cumsum(counts)])
            tail = np.array([end_id] if end_id is not None else [], np.uint32)
            rows = []
            for i in range(batch.num_rows):
                ids = np.concatenate([flat[at[i] : at[i + 1]], tail])
                for piece, start in enumerate(range(0, max(len(ids), 1), capacity)):
                    cut = ids[start : start + capacity]
                    rows.append((i, piece, start, len(cut), zlib.crc32(cut.astype("<u4").tobytes())))
            row, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pack(documents: DataFrame, path: str, capacity: int = 4096, end_id: int | None = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are pieces of the end id alone (without an end id, of
    no tokens, at offset 0 of sequence -1).  Repeated rows are packed each for
    itself.  An empty table gives no rows; other columns are ignored.
    """
    spark = T.prepare(documents.sparkSession)
    pieces = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_cutter(path, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
        .checkpoint()
        .withColumn("part", F.spark_partition_id())
        .checkpoint()  # a piece's part stays what it was
    )
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n")).checkpoint()
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    histogram.pop(0, None)
    key, sequence, each, offset = _places(configurations(histogram, capacity))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = (
        pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
        .join(before, ["length", "part"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).cast("long").alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            if len(key):
                i = np.maximum(0, np.searchsorted(key, (length << _RANK_BITS) | rank, "right") - 1)
                r = rank - (key[i] & ((1 << _RANK_BITS) - 1))
                seq, off = sequence[i] + r // each[i], offset[i] + r % each[i] * length
            else:
                seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            seq, off = np.where(length == 0, -1, seq), np.where(length == 0, 0, off)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
