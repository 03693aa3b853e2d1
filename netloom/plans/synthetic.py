"""Packets derived from the `events` table, in Spark and in SQL word for word.

There is no packet table to query, so each event stands for a packet: its user
is the peer, its type the direction, and small numbers in it the ports, flags
and sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net

SERVICES = [22, 23, 80, 443, 3389, 4444, 53, 65000, 21, 445, 8080, 25, 5900, 31337, 3306, 1900]
REFLECTORS = [53, 123, 161, 389, 1900, 11211]
FLAGS = [2, 2, 2, 18, 0, 41, 3, 16]
QTYPES = [1, 16, 10, 28]
PEER_BASE, LOCAL_BASE = 3355443200, 84347147  # 200.0.0.0, 5.7.9.11
HOSTS = ["5.7.9.11", "5.7.9.12", "5.7.9.13"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select(
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "user_id",
        "event_type",
        "props",
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
        F.floor(F.col("value") * 10).cast("int").alias("size"),
    )


def packets(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The packets, with some more columns of events() as they are."""
    e = events(spark, sf_dir)
    pick = lambda values, i: F.element_at(F.lit(values), (i + 1).cast("int"))
    k, seq = F.col("k"), F.col("seq")
    e = e.withColumns(
        {
            "inbound": F.col("event_type").isin("click", "view", "error"),
            "peer": F.lit(PEER_BASE) + F.col("user_id") * 257,
            "local": F.lit(LOCAL_BASE) + k % 3,
            "proto": F.when(k % 10 < 6, "tcp").when(k % 10 < 9, "udp").otherwise("icmp"),
            "flags": pick(FLAGS, seq % 8),
        }
    )
    tcp, udp = F.col("proto") == "tcp", F.col("proto") == "udp"
    service, reflector, high = pick(SERVICES, k % 16), pick(REFLECTORS, k % 6), (40000 + k).cast("int")
    answer = ~F.col("inbound") & tcp & (F.col("flags") == 18)
    src_port = F.when(F.col("inbound"), F.when(udp, reflector).otherwise(high)).otherwise(F.when(answer, service).otherwise(high))
    dst_port = F.when(F.col("inbound"), service).otherwise(F.when(udp, reflector).when(answer, high).otherwise(service))
    peer, local = net.v4_text(F.col("peer")), net.v4_text(F.col("local"))
    return e.select(
        "seq",
        "ts_us",
        F.when(F.col("inbound"), "inbound").otherwise("outbound").alias("direction"),
        local.alias("local_ip"),
        peer.alias("peer_ip"),
        F.when(F.col("inbound"), peer).otherwise(local).alias("src_ip"),
        F.when(F.col("inbound"), local).otherwise(peer).alias("dst_ip"),
        "proto",
        F.when(tcp | udp, src_port).alias("src_port"),
        F.when(tcp | udp, dst_port).alias("dst_port"),
        F.when(tcp, F.col("flags")).alias("tcp_flags"),
        F.when(F.col("proto") == "icmp", F.lit(True)).alias("icmp_echo"),
        F.when(udp & ~F.col("inbound"), F.concat(F.lit("h"), k.cast("string"), F.lit("x"), (seq % 7).cast("string"), F.lit("."), "event_type", F.lit(".example.org"))).alias("qname"),
        F.when(udp & ~F.col("inbound"), pick(QTYPES, seq % 4)).alias("qtype"),
        F.lit(False).alias("dns_response"),
        F.col("size").alias("payload_len"),
        F.col("props").cast("binary").alias("payload"),
        F.col("peer").alias("peer4"),
        F.col("local").alias("local4"),
        *more,
    )


_V4 = "concat_ws('.', ({0} >> 24) & 255, ({0} >> 16) & 255, ({0} >> 8) & 255, {0} & 255)"

#: CTEs `events_` and `packets` for DuckDB.
SQL = f"""
events_ AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us, user_id, event_type, props,
         CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, CAST(floor(value * 10) AS INT) AS size
  FROM events),
shaped AS (
  SELECT *, event_type IN ('click', 'view', 'error') AS inbound, {PEER_BASE} + user_id * 257 AS peer4,
         CAST({LOCAL_BASE} + k % 3 AS BIGINT) AS local4,
         CASE WHEN k % 10 < 6 THEN 'tcp' WHEN k % 10 < 9 THEN 'udp' ELSE 'icmp' END AS proto,
         CAST(list_extract({FLAGS}, CAST(seq % 8 + 1 AS INT)) AS INT) AS flags,
         CAST(list_extract({SERVICES}, k % 16 + 1) AS INT) AS service,
         CAST(list_extract({REFLECTORS}, k % 6 + 1) AS INT) AS reflector, 40000 + k AS high
  FROM events_),
texted AS (SELECT *, {_V4.format("peer4")} AS peer_ip, {_V4.format("local4")} AS local_ip FROM shaped),
packets AS (
  SELECT seq, ts_us, CASE WHEN inbound THEN 'inbound' ELSE 'outbound' END AS direction, local_ip, peer_ip,
         CASE WHEN inbound THEN peer_ip ELSE local_ip END AS src_ip, CASE WHEN inbound THEN local_ip ELSE peer_ip END AS dst_ip, proto,
         CASE WHEN proto = 'icmp' THEN NULL WHEN inbound AND proto = 'udp' THEN reflector WHEN inbound THEN high
              WHEN proto = 'tcp' AND flags = 18 THEN service ELSE high END AS src_port,
         CASE WHEN proto = 'icmp' THEN NULL WHEN inbound THEN service WHEN proto = 'udp' THEN reflector
              WHEN proto = 'tcp' AND flags = 18 THEN high ELSE service END AS dst_port,
         CASE WHEN proto = 'tcp' THEN flags END AS tcp_flags, CASE WHEN proto = 'icmp' THEN true END AS icmp_echo,
         CASE WHEN proto = 'udp' AND NOT inbound THEN concat('h', k, 'x', seq % 7, '.', event_type, '.example.org') END AS qname,
         CASE WHEN proto = 'udp' AND NOT inbound THEN CAST(list_extract({QTYPES}, CAST(seq % 4 + 1 AS INT)) AS INT) END AS qtype,
         size AS payload_len, props AS payload, peer4, local4
  FROM texted)"""
