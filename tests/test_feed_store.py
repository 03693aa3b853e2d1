"""Feeds that change, break and come back."""

import pytest

from netloom.operators import lookups
from netloom.sources.feed_store import FeedStore


def found(store, version=None):
    return {(r.source, r.family, r.prefix_len) for r in store.prefixes(version).collect()}


def test_a_broken_feed_keeps_its_last_state_while_others_move(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("1.2.3.0/24 # one\nnonsense\n")
    b.write_text("5.0.0.0/8\n2001:db8::/32\n")
    store = FeedStore(spark, str(tmp_path / "store"), most_bytes=1000)
    assert store.version() == 0 and store.prefixes().count() == 0
    paths = {"a/x": str(a), "b": str(b), "never": str(tmp_path / "missing.txt")}
    first = store.refresh(paths)
    assert (first["a/x"]["valid"], first["a/x"]["invalid"], first["never"]["state"]) == (1, 1, None) and first["never"]["error"]
    assert found(store) == {("a/x", 4, 24), ("b", 4, 8), ("b", 6, 32)}
    for broken in ("", "only words\n", "9.9.9.9\n" * 200):
        a.write_text(broken)
        b.write_text(f"5.0.0.0/{9 + len(broken) % 7}\n")
        now = store.refresh(paths)
        assert now["a/x"]["state"] == 1 and now["a/x"]["error"] and now["b"]["error"] is None and now["b"]["state"] == store.version()
        assert found(store) == {("a/x", 4, 24), ("b", 4, 9 + len(broken) % 7)}
    a.unlink()
    assert store.refresh(paths)["a/x"]["state"] == 1
    a.write_text("7.7.7.7\n")
    assert store.refresh(paths)["a/x"]["error"] is None
    assert ("a/x", 4, 32) in found(store) and found(store, 1) == {("a/x", 4, 24), ("b", 4, 8), ("b", 6, 32)}
    assert found(FeedStore(spark, f"file://{tmp_path}/store")) == found(store)
    store.refresh({"b": str(b)})
    assert {s for s, *_ in found(store)} == {"b"}


def test_a_batch_that_runs_again_sees_the_same_version(spark, tmp_path):
    feed, source, check = tmp_path / "f.txt", str(tmp_path / "in"), str(tmp_path / "check")
    store = FeedStore(spark, str(tmp_path / "store"))
    seen, fail = [], [True]

    def use(rows, prefixes, version, batch):
        hits = lookups.longest_prefix(rows, prefixes, "peer_ip", ["source"], "peer_ip").collect()
        seen.append((batch, version, [r.peer_ip for r in hits]))
        if batch == 1 and fail:
            fail.clear()
            raise RuntimeError("lost")

    def go():
        q = spark.readStream.schema("peer_ip string").json(source).writeStream.foreachBatch(store.each_batch("q", use)).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()

    def arrive(*ips):
        spark.createDataFrame([(i,) for i in ips], "peer_ip string").coalesce(1).write.mode("append").json(source)

    feed.write_text("200.0.0.1\n")
    store.refresh({"f": str(feed)})
    arrive("200.0.0.1", "200.0.0.2")
    go()
    feed.write_text("200.0.0.2\n")
    store.refresh({"f": str(feed)})
    arrive("200.0.0.1", "200.0.0.2")
    with pytest.raises(Exception, match="lost"):
        go()
    feed.write_text("200.0.0.3\n")
    store.refresh({"f": str(feed)})
    go()
    arrive("200.0.0.3")
    go()
    assert seen == [(0, 1, ["200.0.0.1"]), (1, 2, ["200.0.0.2"]), (1, 2, ["200.0.0.2"]), (2, 3, ["200.0.0.3"])]
    with pytest.raises(ValueError, match="before 2"):
        store.pinned("q", 1)
