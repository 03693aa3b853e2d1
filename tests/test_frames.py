"""The frame queries against their SQL, and that the shapes they mean to have do occur."""

import duckdb
import pytest

from netloom.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    return sorted(tuple(str(r[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", ["frames_decode", "frames_counters", "pcap_pushed_filters"])
def test_frames_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    told = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in told.description]
    got = catalog.QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(names)
    rows = got.collect()
    assert rows and rows_of(names, rows) == rows_of(names, [dict(zip(names, r)) for r in told.fetchall()])
    if name == "frames_decode":
        assert {r.error for r in rows} == {None, "too short", "unsupported", "ipv4 header", "ipv6 version"}
        assert {r.family for r in rows} == {None, 4, 6} and {r.fragmented for r in rows} == {None, False, True} == {r.first_fragment for r in rows}
        assert {r.ip_proto for r in rows} == {None, 1, 6, 17, 58} and {r.dns_response for r in rows} == {None, False, True}
