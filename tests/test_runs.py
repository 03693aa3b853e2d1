"""What a run leaves: rotated files of a stream, and counters observed while it runs."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from netloom.plans.engine import Engine
from netloom.sinks import rotating
from netloom.sources import decode, pcap, scenario
from netloom.streaming import metrics


def start(df, check, **more):
    q = rotating.writer(df, **more).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def lines_of(out):
    return [(n, open(f"{out}/{n}").read()) for n in sorted(os.listdir(out)) if not n.startswith(".")]


def test_files_are_bounded_and_the_newest_stay(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.range(i * 100, i * 100 + 100, 1, 2).select(F.format_string("line-%06d", "id").alias("value")).write.mode("append").text(source)
        start(spark.readStream.text(source), str(tmp_path / "check"), path=out, max_bytes=120, keep=0)
    kept = lines_of(out)
    assert all(len(text) <= 120 for _, text in kept) and len({n.split("-")[1] for n, _ in kept}) == 3
    assert sorted(x for _, text in kept for x in text.split()) == [f"line-{i:06d}" for i in range(300)]
    spark.range(300, 310).select(F.format_string("line-%06d", "id").alias("value")).write.mode("append").text(source)
    start(spark.readStream.text(source), str(tmp_path / "check"), path=out, max_bytes=120, keep=4)
    left = lines_of(out)
    assert len(left) == 4 and left[:-1] != [] and sorted(x for _, t in left for x in t.split())[-10:] == [f"line-{i:06d}" for i in range(300, 310)]
    assert not [n for n in os.listdir(out) if n.startswith(".")]


def test_a_failed_batch_leaves_no_file_and_runs_again(spark, tmp_path):
    source, out, check, fuse = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "fuse")
    spark.range(0, 50, 1, 4).select(F.col("id").cast("string").alias("value")).write.text(source)

    def burn(batches):
        for batch in batches:
            if not os.path.exists(fuse) and "40" in batch.column("value").to_pylist():
                raise RuntimeError("burnt")
            yield batch

    df = spark.readStream.text(source).mapInArrow(burn, "value string")
    with pytest.raises(Exception, match="burnt"):
        start(df, check, path=out, max_bytes=20)
    assert not os.path.exists(out) or [n for n in os.listdir(out) if not n.startswith(".")] == []
    open(fuse, "w").close()
    start(df, check, path=out, max_bytes=20)
    assert sorted((x for _, t in lines_of(out) for x in t.split()), key=int) == [str(i) for i in range(50)]


def test_a_batch_that_runs_again_replaces_its_files(tmp_path):
    def staged(text):
        w = rotating.RotatingWriter({"path": str(tmp_path), "keep": "2"})
        name, stream = w.staging.create()
        stream.write(text)
        stream.close()
        return w, name

    for batch, part, text in ((1, "a", b"1"), (2, "a", b"2"), (2, "b", b"3"), (3, "a", b"4")):
        w, name = staged(text)
        w.commit([rotating.Lines([(name, part)]), None], batch)
    assert [t for _, t in lines_of(tmp_path)] == ["3", "4"]
    w, _ = staged(b"5")
    w.abort([], 4)
    assert [t for _, t in lines_of(tmp_path)] == ["3", "4"]
    with pytest.raises(ValueError):
        rotating.RotatingWriter({"path": str(tmp_path), "maxBytes": "0"})


def test_a_batch_job_is_counted_as_it_runs(spark):
    seen = [Observation(n) for n in ("raw", "packets", "alerts")]
    frames = scenario.frame_table(spark).unionByName(spark.createDataFrame([(1000, 0, b"short", 1)], "seq long, ts_ns long, frame binary, linktype int"))
    raw = metrics.watch_raw(decode.decode(frames), seen[0])
    packets = metrics.watch_packets(decode.packets(raw, [scenario.HOST]), seen[1])
    alerts = metrics.watch_alerts(Engine().detect(packets), seen[2])
    rows = alerts.collect()
    run = metrics.RunMetrics()
    for s in seen:
        run.add(s.get)
    got = run.counters()
    assert got["frames"] == len(scenario.frames()) + 1 and got["parse_errors"] == 1
    assert got["packets"] == got["inbound"] + got["outbound"] == len(scenario.frames()) and got["skipped"] == 0
    assert got["bytes"] == sum(len(f) for _, f in scenario.frames()) + 5
    by_rule = Counter(r.rule for r in rows)
    assert got["alerts"] == len(rows) and all(got[r] == n for r, n in by_rule.items())
    text = run.text(feed_entries=7)
    assert "# TYPE netloom_feed_entries gauge\nnetloom_feed_entries 7\n" in text and f"netloom_frames {got['frames']}\n" in text
    assert all(f'netloom_alerts_by_rule_total{{rule="{r}"}} {n}\n' in text for r, n in by_rule.items())


def test_streams_are_counted_and_no_batch_twice(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = metrics.RunMetrics()
    spark.streams.addListener(run)
    try:
        for name, part in (("1.pcap", scenario.frames()[:40]), ("2.pcap", scenario.frames()[40:])):
            with open(folder / name, "wb") as f:
                pcap.write_pcap(f, part)
            raw = metrics.watch_raw(pcap.stream(spark, str(folder), decoded=True))
            df = metrics.watch_packets(decode.packets(raw, [scenario.HOST]))
            q = df.groupBy("peer_ip").count().writeStream.outputMode("complete").format("noop").option("checkpointLocation", str(tmp_path / "check")).start()
            q.processAllAvailable()
            q.stop()
            wanted = len(scenario.frames()) if name == "2.pcap" else 40
            for _ in range(100):
                if run.counters()["frames"] >= wanted:
                    break
                time.sleep(0.1)
            assert run.counters()["frames"] == run.counters()["packets"] == wanted
    finally:
        spark.streams.removeListener(run)
    run.told("q", 5, Counter(frames=3), {"tracked_keys": 2})
    run.told("q", 5, Counter(frames=3), {"tracked_keys": 4})
    run.told("q", 6, Counter(), {"tracked_keys": 4})
    assert run.counters()["frames"] == len(scenario.frames()) + 3 and run.counters()["tracked_keys"] == 4
