"""Trailing windows and cooldowns over events in arrival order.

`seq` is the arrival order and `ts_us` the event time in microseconds.  A
window of W covers (ts - W, ts] and sees only what has arrived, so events that
share a time are told apart by seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import first_at_or_after, kept, ranked, stored

#: Length of a time chunk, in windows: a chunk of 2 repeats half of the rows as the halo of the next one.
CHUNK_WINDOWS = 2
#: Hits of one key, at most, that a cooldown folds as one array; keys with more go through pointers.
MOST_COLLECTED = 4096


def _slot(time: Column, width_us: int) -> Column:
    """The number of the time slot, rounded down before 1970, too."""
    return ((time - F.pmod(time, F.lit(width_us))) / width_us).cast("long")


def with_halo(df: DataFrame, back_us: int, ahead_us: int = 0) -> DataFrame:
    """df cut into time chunks, `_chunk`; rows that rows of another chunk look at are in that one, too, with `_halo` true.

    A row sees what lies up to `back_us` before it and `ahead_us` after it, so
    windows over (key, chunk) tell what windows over the key would, and a key
    with most of the rows is spread over its time.
    """
    width = CHUNK_WINDOWS * max(1, back_us, ahead_us)
    own = _slot(F.col("ts_us"), width)
    seen_by = F.sequence(_slot(F.col("ts_us") - ahead_us, width), _slot(F.col("ts_us") + back_us, width))
    return df.withColumn("_chunk", F.explode(seen_by)).withColumn("_halo", F.col("_chunk") != own)


def counts_at_arrival(df: DataFrame, keys: list[str], window_us: int, counted: dict[str, Column | None]) -> DataFrame:
    """df with a column for each of `counted`: how many such events of the key the window holds when the row arrives, itself included (None: all).

    A RANGE frame also holds later arrivals of the same time; they are taken
    off.  Exact when no key's time runs backwards in arrival order.
    """
    frame = Window.partitionBy(*keys, "_chunk").orderBy("ts_us").rangeBetween(-(window_us - 1), 0)
    same = Window.partitionBy(*keys, "_chunk", "ts_us")
    so_far = same.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)

    def count(condition: Column | None) -> Column:
        one = F.lit(1) if condition is None else F.when(condition, 1)
        return F.count(one).over(frame) - (F.count(one).over(same) - F.count(one).over(so_far))

    out = with_halo(df, window_us - 1).withColumns({name: count(condition) for name, condition in counted.items()})
    return out.where(~F.col("_halo")).drop("_chunk", "_halo")


def distinct_at(df: DataFrame, keys: list[str], targets: list[str], window_us: int, name: str) -> DataFrame:
    """df with `name`: how many different targets the key's events in (ts - window, ts] have, those of the same time included.

    An event keeps its target in the windows of a stretch of time, up to the
    target's next event or the window's length.  Stretches of one target don't
    overlap, so the answer is a running sum of their beginnings less their
    ends: a number a row, not a set a row.  The sum runs inside time chunks,
    with what the chunks before have left open added.
    """
    whole = Window.partitionBy(*keys, *targets, "_chunk").orderBy("ts_us", "seq")
    ahead = with_halo(df, 0, window_us).withColumn("_next", F.lead("ts_us").over(whole))
    ends = ahead.where(~F.col("_halo")).drop("_chunk", "_halo").withColumn("_end", F.least(F.col("ts_us") + window_us, F.col("_next"))).drop("_next")
    width = CHUNK_WINDOWS * window_us
    begin = ends.drop("_end").withColumns({"_at": F.col("ts_us"), "_step": F.lit(1)})
    end = ends.groupBy(*keys, F.col("_end").alias("_at")).agg((-F.count("*")).cast("int").alias("_step"))
    points = begin.unionByName(end, allowMissingColumns=True).withColumn("_chunk", _slot(F.col("_at"), width))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    left = points.groupBy(*keys, "_chunk").agg(F.sum("_step").alias("_sum"))
    left = left.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_open"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    summed = points.withColumn(name, F.sum("_step").over(inside)).where("ts_us is not null")
    same = F.col("_chunk") == F.col("_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return summed.join(left, same).withColumn(name, F.col(name) + F.col("_open")).select(*df.columns, name)


def last_before(value: Column, keys: list[str]) -> Column:
    """The latest non-null value of the key up to the row, in arrival order."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))


def interarrival(keys: list[str]) -> Column:
    """Seconds since the key's previous event, never negative; null for the first."""
    gap = F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy(*keys).orderBy("seq"))
    return F.greatest(gap, F.lit(0)) / 1e6


def jitter(df: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Per key: samples, mean gap and coefficient of variation (population) of its gaps."""
    gaps = df.withColumn("gap", interarrival(keys))
    out = gaps.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd"))
    return out.where((F.col("n") >= least) & (F.col("mean_gap") > 0)).select(*keys, "n", "mean_gap", (F.col("sd") / F.col("mean_gap")).alias("cv"))


def cooldown(hits: DataFrame, keys: list[str], cooldown_us: int | str) -> DataFrame:
    """The hits that a greedy cooldown lets pass; cooldown_us may name a column that has one value for each key.

    A hit passes unless less than the cooldown has gone since the key's last
    one that passed; a clock that runs backwards lets it pass.  Keys with few
    hits are folded, each as one array.  A key with many is not one task's
    work: each of its hits points to the first that would pass after it, and
    doubling those pointers finds the ones that its first hit leads to.
    """
    columns = hits.columns
    wait = F.col(cooldown_us) if isinstance(cooldown_us, str) else F.lit(cooldown_us)
    hits = kept(hits.withColumns({"_key": F.to_json(F.struct(*keys)), "_wait": wait.cast("long")}))
    waits = hits.where("_wait > 0")
    many = waits.groupBy("_key").count().where(F.col("count") > MOST_COLLECTED).select("_key")
    free = hits.where("_wait <= 0").select(columns)
    if many.isEmpty():
        return _folded(waits, columns).unionByName(free)
    many = stored(many)
    hot = waits.join(many, "_key", "left_semi")
    passed = _led_to(stored(hot.select("_key", "seq", "ts_us", "_wait")))
    return _folded(waits.join(many, "_key", "left_anti"), columns).unionByName(hot.join(passed, ["_key", "seq"], "left_semi").select(columns)).unionByName(free)


def _folded(hits: DataFrame, columns: list[str]) -> DataFrame:
    """The greedy cooldown over each key as an array of at most MOST_COLLECTED hits."""
    row = F.struct("seq", "ts_us", "_wait", F.struct(*columns).alias("row"))
    rows = hits.select(F.array(F.struct(*columns)).alias("rows")).schema["rows"].dataType
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(rows).alias("passed"))

    def step(state: Column, hit: Column) -> Column:
        waits = F.coalesce((hit["ts_us"] - state["last"]).between(0, hit["_wait"] - 1), F.lit(False))
        return F.when(waits, state).otherwise(F.struct(hit["ts_us"].alias("last"), F.concat(state["passed"], F.array(hit["row"])).alias("passed")))

    passed = F.aggregate(F.sort_array(F.collect_list(row)), start, step)["passed"]
    return hits.groupBy("_key").agg(passed.alias("_passed")).select(F.explode("_passed").alias("_row")).select(*[F.col("_row")[c].alias(c) for c in columns])


def _led_to(hits: DataFrame) -> DataFrame:
    """(_key, seq) that pass, of hits (_key, seq, ts_us, _wait)."""
    placed = ranked(hits, "_key", "seq")
    after = placed.select("_key", (F.col("pos") - 1).alias("pos"), F.col("ts_us").alias("_then"))
    back = stored(placed.join(after, ["_key", "pos"]).where("_then < ts_us").select("_key").distinct())
    steady = placed.join(back, "_key", "left_anti").groupBy("_key", "ts_us", "_wait").agg(F.min("seq").alias("seq"))  # of one time only the first can pass
    pointers = first_at_or_after(stored(steady), "_key", "ts_us", F.col("ts_us") + F.col("_wait"), "seq", "next")
    if not back.isEmpty():
        pointers = pointers.unionByName(_next_outside(stored(placed.join(back, "_key", "left_semi"))))
    pointers = stored(pointers.where("next is not null"))
    reached = hits.groupBy("_key").agg(F.min("seq").alias("seq"))
    # what nothing points to leads nowhere that matters, unless it is the first
    ends = pointers.select("_key", F.col("next").alias("seq")).distinct().unionByName(reached)
    jump = stored(pointers.join(ends, ["_key", "seq"], "left_semi"))
    while not jump.isEmpty():  # jump goes 1, 2, 4, ... steps; reached has all that fewer steps lead to
        reached = stored(reached.unionByName(reached.join(jump, ["_key", "seq"]).select("_key", F.col("next").alias("seq"))))
        far = jump.select("_key", F.col("seq").alias("next"), F.col("next").alias("_far"))
        jump = stored(jump.join(far, ["_key", "next"]).select("_key", "seq", F.col("_far").alias("next")))
    return reached


def _next_outside(placed: DataFrame) -> DataFrame:
    """(_key, seq, next): the first later hit, in arrival order, of a time outside [ts, ts + wait).

    For clocks that run backwards.  Least and greatest times of runs of 1, 2,
    4, ... hits are tabled; each hit then passes over the longest run of hits
    that stay inside, in strides from long to short.
    """
    runs = [stored(placed.select("_key", "pos", F.col("ts_us").alias("_lo"), F.col("ts_us").alias("_hi")))]
    most = placed.agg(F.max("pos")).first()[0]
    while 2 ** len(runs) <= most:
        width = 2 ** (len(runs) - 1)
        second = runs[-1].select("_key", (F.col("pos") - width).alias("pos"), F.col("_lo").alias("_lo2"), F.col("_hi").alias("_hi2"))
        runs.append(stored(runs[-1].join(second, ["_key", "pos"], "left").select("_key", "pos", F.least("_lo", "_lo2").alias("_lo"), F.greatest("_hi", "_hi2").alias("_hi"))))
    at = placed.select("_key", "seq", "ts_us", "_wait", (F.col("pos") + 1).alias("pos"))
    for k in reversed(range(len(runs))):
        inside = (F.col("_lo") >= F.col("ts_us")) & (F.col("_hi") < F.col("ts_us") + F.col("_wait"))
        at = stored(at.join(runs[k], ["_key", "pos"], "left").withColumn("pos", F.when(inside, F.col("pos") + 2**k).otherwise(F.col("pos"))).drop("_lo", "_hi"))
    return at.select("_key", "seq", "pos").join(placed.select("_key", "pos", F.col("seq").alias("next")), ["_key", "pos"]).select("_key", "seq", "next")


def suppress_after(emitted: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    """The first `most` emissions of each key; those it drops never reached the cooldown."""
    if most is None:
        return emitted
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    return emitted.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
