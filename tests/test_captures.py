"""Captures as a source and a sink: filters ahead of decoding, streams that restart, files that appear whole."""

import io
import os
import random
import struct

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from netloom.sources import decode, files, pcap, scenario


def capture(path, frames):
    with open(path, "wb") as f:
        pcap.write_pcap(f, frames)


def test_written_captures_are_read_back_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    table = scenario.frame_table(spark).repartitionByRange(3, "seq").sortWithinPartitions("seq")
    pcap.write(table, out)
    got = pcap.read(spark, out).orderBy("seq").collect()
    assert [(r.ts_ns, bytes(r.frame)) for r in got] == scenario.frames()
    assert not [n for n in os.listdir(out) if n.startswith(".")] and len(os.listdir(out)) == 3
    fields = pcap.read(spark, "file://" + out, decoded=True).drop("seq")
    assert sorted(map(str, fields.collect())) == sorted(map(str, decode.decode(scenario.frame_table(spark)).drop("seq").collect()))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    bad = scenario.frame_table(spark).repartition(4).withColumn("ts_ns", F.when(F.col("seq") == 60, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("ts_ns")))
    with pytest.raises(Exception, match="broken"):
        pcap.write(bad, out)
    assert not os.path.exists(out) or os.listdir(out) == []


def test_peek_finds_what_the_decoder_finds():
    rnd = random.Random(5)
    whole = [f for _, f in scenario.frames()] + [scenario.udp("2606:4700::1", "2001:4860::2", 5353, 2, b"x")]
    whole += [f[:12] + b"\x81\x00\0\1" + f[12:] for f in whole[::9]]
    for _ in range(4000):
        f = bytearray(rnd.choice(whole))
        for _ in range(rnd.randrange(3)):
            f[rnd.randrange(min(len(f), 44))] = rnd.randrange(256)
        f = bytes(f[: rnd.randrange(len(f) + 1)] if rnd.random() < 0.3 else f)
        seen = decode.peek(f)
        try:
            row = decode.decode_frame(f)
        except decode.Undecodable:
            continue
        if seen is not None:
            assert seen == (row["ip_proto"], row.get("src_port"), row.get("dst_port"))


def test_filters_reach_the_reader_ahead_of_decoding(spark, tmp_path, monkeypatch):
    capture(tmp_path / "a.pcap", scenario.frames())
    reader = pcap.PushedReader({"path": str(tmp_path), "decoded": "true"})
    filters = [ds.EqualTo(("dst_port",), 22), ds.IsNotNull(("ip_proto",)), ds.GreaterThan(("ts_us",), scenario.BASE_NS // 1000)]
    assert list(reader.pushFilters(filters)) == filters
    calls = []
    real = decode.decode_frame
    monkeypatch.setattr(decode, "decode_frame", lambda f: calls.append(f) or real(f))
    rows = [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
    assert len(rows) == len(calls) == 5 and {r["dst_port"] for r in rows} == {22}
    monkeypatch.undo()
    where = (F.col("dst_port") == 22) | (F.col("ip_proto") == 1)
    before = [(r.seq, r.ip_proto) for r in pcap.read(spark, str(tmp_path), decoded=True).where(where & (F.col("ip_proto") <= 6)).orderBy("seq").collect()]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = pcap.read(spark, str(tmp_path), decoded=True).where(where & (F.col("ip_proto") <= 6))
        assert [(r.seq, r.ip_proto) for r in df.orderBy("seq").collect()] == before and len(before) == 21
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def numbered(n, size=40):
    return [(1_700_000_000_000_000_000 + i * 1000, struct.pack(">I", i) + bytes(size)) for i in range(n)]


def run_stream(spark, folder, out, check, **options):
    q = pcap.stream(spark, folder, **options).writeStream.format("parquet").option("checkpointLocation", check).trigger(processingTime="0 seconds").start(out)
    try:
        q.processAllAvailable()
        return sum(p["numInputRows"] > 0 for p in q.recentProgress)
    finally:
        q.stop()


@pytest.mark.parametrize("place", [None, "place/q1"])
def test_stream_restarts_without_repeats_and_keeps_order(spark, tmp_path, place):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    place = place and str(tmp_path / place)
    os.mkdir(folder)
    all_frames = numbered(70)
    capture(f"{folder}/0001.pcap", all_frames[:30])
    capture(f"{folder}/0002.pcap", all_frames[30:40])
    for name in ("0001.pcap", "0002.pcap"):
        os.utime(f"{folder}/{name}", (1, 1))
    batches = run_stream(spark, folder, out, check, max_bytes=600, place_file=place)
    assert batches >= (4 if place else 1)
    capture(f"{folder}/0003.pcap", all_frames[40:])
    batches = run_stream(spark, folder, out, check, max_bytes=600, place_file=place)
    assert batches >= (3 if place else 1)
    assert run_stream(spark, folder, out, check, max_bytes=600, place_file=place) == 0
    rows = spark.read.parquet(out).orderBy("seq").collect()
    assert [bytes(r.frame) for r in rows] == [f for _, f in all_frames] and len({r.seq for r in rows}) == 70
    assert [r.seq for r in rows] == [r.seq for r in pcap.read(spark, folder).orderBy("seq").collect()]


def test_stream_offsets(tmp_path):
    body = io.BytesIO()
    pcap.write_pcap(body, numbered(10, 0))
    whole = body.getvalue()
    (tmp_path / "b.pcap").write_bytes(whole[: 24 + 3 * 20 + 7])
    live = pcap.PcapStreamReader({"path": str(tmp_path), "growing": "true"})
    start = live.initialOffset()
    first = live.latestOffset()
    assert (first["byte"], first["record"]) == (24 + 60, 3) and live.latestOffset() == first
    (tmp_path / "b.pcap").write_bytes(whole)
    second = live.latestOffset()
    pieces = live.partitions(start, first) + live.partitions(first, second)
    got = [r for p in pieces for b in live.read(p) for r in b.column("seq").to_pylist()]
    assert got == list(range(10)) and live.partitions(second, second) == []
    assert [len(list(live.read(p))) for p in live.partitions(start, second)] == [1]
    # one record is taken where it alone is over the budget
    small = pcap.PcapStreamReader({"path": str(tmp_path), "maxBytesPerTrigger": "5", "placeFile": str(tmp_path / ".place")})
    assert small.latestOffset()["record"] == 1
    (tmp_path / "a.pcap").write_bytes(whole)
    with pytest.raises(pcap.PcapError, match="before b.pcap"):
        live.latestOffset()
    os.remove(tmp_path / "a.pcap")
    done = pcap.PcapStreamReader({"path": str(tmp_path)})
    assert done.latestOffset()["record"] == -1
    (tmp_path / "b.pcap").write_bytes(whole + whole[24:44])
    with pytest.raises(pcap.PcapError, match="grew"):
        done.latestOffset()
    with pytest.raises(pcap.PcapError, match="taken away"):
        done.partitions(start, second | {"number": 4})


def test_paths_of_files(tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"")
    for path in (str(tmp_path), f"file://{tmp_path}", str(tmp_path / "x.pcap")):
        found = [files.whole_path(path, f) for f in files.visible(path)]
        assert found == [("file://" if "://" in path else "") + str(tmp_path / "x.pcap")]
