"""Windows, cooldowns and as-of joins over keys that are larger than a task, against folds and brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netloom.functions import scalars
from netloom.operators import detectors, order, windows
from netloom.plans import config as C

SCHEMA = "seq long, ts_us long, k string, j int, x int"


def hits(seed, n, clock, keys=("hot",) * 6 + ("a", "b", None)):
    """n events in arrival order; `clock` gives the next time from the last one."""
    rnd, now, out = random.Random(seed), -200, []
    for seq in range(n):
        now = clock(rnd, now)
        out.append((seq * 3, now, rnd.choice(keys), rnd.choice([1, 1, 2]), rnd.randint(0, 4)))
    return out


STEADY = lambda rnd, now: now + rnd.choice([0, 0, 1, 2, 5, 40])
JITTER = lambda rnd, now: now + rnd.choice([-7, -1, 0, 1, 3, 9])
JUMPS = lambda rnd, now: rnd.randint(-300, 300)


def folded(rows, wait):
    last, out = {}, []
    for r in sorted(rows):
        key = r[2:4]
        if key not in last or not 0 <= r[1] - last[key] < wait:
            last[key] = r[1]
            out.append(r)
    return out


@pytest.mark.parametrize("clock,wait,most", [(STEADY, 30, 5), (STEADY, 3, 40), (STEADY, 5000, 5), (JITTER, 20, 5), (JUMPS, 50, 5), (JUMPS, 30, 4096), (STEADY, 0, 5)])
def test_cooldown_equals_the_fold(spark, monkeypatch, clock, wait, most):
    monkeypatch.setattr(windows, "MOST_COLLECTED", most)
    rows = hits(wait, 300, clock)
    got = windows.cooldown(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k", "j"], wait)
    assert Counter(map(tuple, got.collect())) == Counter(folded(rows, wait))
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())


def test_cooldown_of_nothing(spark):
    assert windows.cooldown(spark.createDataFrame([], SCHEMA), ["k"], 10).count() == 0


@pytest.mark.parametrize("window", [1, 2, 17, 400])
def test_counts_and_distinct_targets_over_chunks(spark, window):
    rows = hits(9, 250, STEADY)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counted = windows.counts_at_arrival(df, ["k"], window, {"n": None, "some": F.col("x") < 2})
    want = {}
    for seq, now, key, _, _ in rows:
        held = [r for r in rows if r[2] == key and now - window < r[1] <= now and r[0] <= seq]
        want[seq] = (len(held), sum(r[4] < 2 for r in held))
    assert {r.seq: (r.n, r.some) for r in counted.collect()} == want and counted.columns == [*df.columns, "n", "some"]
    distinct = windows.distinct_at(df, ["k"], ["j", "x"], window, "d")
    targets = lambda key, now: {r[3:] for r in rows if r[2] == key and now - window < r[1] <= now}
    assert {r.seq: r.d for r in distinct.collect()} == {seq: len(targets(key, now)) for seq, now, key, _, _ in rows}
    assert "collect_set" not in distinct._jdf.queryExecution().toString()
    assert windows.distinct_at(df.where("seq < 0"), ["k"], ["x"], window, "d").count() == 0


def test_a_hot_key_is_spread_over_its_time(spark):
    df = spark.range(4000).select(F.col("id").alias("seq"), (F.col("id") * 10).alias("ts_us"), F.lit("hot").alias("k"))
    spread = windows.with_halo(df, 199).groupBy("k", "_chunk").agg(F.count("*").alias("n"), F.sum(F.col("_halo").cast("int")).alias("halo")).collect()
    assert len(spread) > 90 and max(r.n for r in spread) <= 61 and sum(r.n - r.halo for r in spread) == 4000


def test_requests_within_the_window_are_looked_up_by_chunk(spark):
    rnd = random.Random(4)
    rows, now = [], 0
    for seq in range(300):
        now += rnd.choice([0, 1, 3, 30])
        out = rnd.random() < 0.4
        port = rnd.choice([53, 123])
        rows.append((seq, now, "outbound" if out else "inbound", rnd.choice(["p", "p", "q"]), "udp", None if out else port, port if out else None))
    df = spark.createDataFrame(rows, "seq long, ts_us long, direction string, peer_ip string, proto string, src_port int, dst_port int")
    for window in (2, 25):
        want = set()
        for seq, at, way, peer, _, port, _ in rows:
            asked = [r[1] for r in rows if r[0] < seq and r[2] == "outbound" and r[3] == peer and r[6] == port]
            if way == "inbound" and not (asked and 0 <= at - asked[-1] <= window):
                want.add(seq)
        for ordered in (True, False):
            assert {r.seq for r in detectors.unsolicited(df, [53, 123], window, ordered).collect()} == want


def test_ratios_are_rounded_by_their_exact_value(spark):
    rows = [(a / n,) for n in [*range(1, 121), 200, 400, 1000] for a in range(2 * n)] + [(x,) for x in (0.0, 0.00390624, 0.0049999999999999, 0.005, 0.125, 0.175, 0.994999, 0.995, 0.9999999, 123456.785)]
    got = spark.createDataFrame(rows, "x double").select("x", scalars.two_digits(F.col("x")).alias("text")).collect()
    assert [r for r in got if r.text != f"{r.x:.2f}"] == []


@pytest.mark.parametrize("ordered", [True, False])
def test_a_flood_of_forty_with_seven_answers_tells_the_exact_ratio(spark, ordered):
    """7 / 40 is a little less than 0.175."""
    rows = [(i, 1000 * (i + 1), "outbound" if i < 7 else "inbound", "9.9.9.9", "5.7.9.11", "tcp", *((80, 4000) if i < 7 else (4000, 80)), 18 if i < 7 else 2) for i in range(47)]
    p = spark.createDataFrame(rows, "seq long, ts_us long, direction string, peer_ip string, local_ip string, proto string, src_port int, dst_port int, tcp_flags int")
    out = F.col("direction") == "outbound"
    p = p.select("*", F.when(out, F.col("local_ip")).otherwise(F.col("peer_ip")).alias("src_ip"), F.when(out, F.col("peer_ip")).otherwise(F.col("local_ip")).alias("dst_ip"))
    (r,) = detectors.syn_flood(p, C.SynFloodCfg(threshold=40, window_s=60, cooldown_s=20, max_completion_ratio=0.5), ordered).collect()
    assert r.detail == "SYN flood on 5.7.9.11:80: 40 SYNs, 7 SYN-ACKs, completion ratio 0.17 in 60s"


def test_as_of_join_and_ranks(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "a", "a", "b"]), rnd.randint(0, 60), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, i long").repartition(5)
    got = {(r.k, r.i): r.nxt for r in order.first_at_or_after(df, "k", "t", F.col("t") + 7, "i", "nxt").collect()}
    first = lambda k, t: min(((u, j) for x, u, j in rows if x == k and u >= t), default=(0, None))[1]
    assert got == {(k, i): first(k, t + 7) for k, t, i in rows}
    by = {k: sorted(i for x, _, i in rows if x == k) for k in "ab"}
    assert all(by[r.k][r.pos - 1] == r.i for r in order.ranked(df, "k", "i").collect())


def test_what_is_stored_has_the_size_of_its_files(spark):
    """In a loop of joins an estimate that is multiplied doubles its digits with each round, and so the driver's time."""
    df = order.stored(spark.range(20).select("id", (F.col("id") + 1).alias("next")))
    for _ in range(5):
        df = order.stored(df.join(df.select(F.col("id").alias("next"), F.col("next").alias("far")), "next", "left").select("id", F.coalesce("far", "next").alias("next")))
    assert {(r.id, r.next) for r in df.collect()} == {(i, 20) for i in range(20)}
    assert len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10


def test_many_rounds_of_pointers_estimate_no_more_than_files(spark, monkeypatch):
    monkeypatch.setattr(windows, "MOST_COLLECTED", 5)
    rows = hits(20, 200, JITTER)
    got = windows.cooldown(spark.createDataFrame(rows, SCHEMA), ["k", "j"], 20)
    assert len(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 200
