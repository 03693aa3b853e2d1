"""Every registered query with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..functions import rules as R
from ..functions import scalars as S
from ..operators import detectors, lookups, order, windows
from ..sinks import alerts as sinks
from ..sources import decode, feeds, flowlog, geo, pcap
from . import config as C
from . import frames as X
from . import synthetic as P
from .engine import Engine, alerts_by_rule

HOUR, DAY = 3600, 86400
US = 1_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Thresholds under which the events of a month make alerts.
CFG = C.RulesCfg(
    port_scan=C.PortScanCfg(min_targets=3, window_s=2 * DAY, cooldown_s=DAY),
    invalid_tcp_flags=C.CountCfg(threshold=3, window_s=2 * DAY, cooldown_s=2 * DAY),
    brute_force=C.BruteForceCfg(threshold=2, window_s=3 * DAY, cooldown_s=DAY),
    syn_flood=C.SynFloodCfg(threshold=4, window_s=2 * DAY, cooldown_s=DAY, max_completion_ratio=0.5),
    udp_flood=C.RateCfg(threshold=5, window_s=DAY, cooldown_s=DAY),
    icmp_flood=C.RateCfg(threshold=6, window_s=DAY, cooldown_s=DAY),
    reflection_amplification=C.ReflectionCfg(min_response_bytes=300, threshold=3, window_s=2 * DAY, cooldown_s=DAY),
    dns_tunnel=C.DnsTunnelCfg(entropy_threshold=4.05, qname_len_threshold=26, label_len_threshold=20, subdomain_threshold=6, txt_threshold=3, window_s=3 * DAY, cooldown_s=2 * DAY),
    icmp_tunnel=C.IcmpTunnelCfg(max_payload=200, threshold=2, window_s=4 * DAY, cooldown_s=DAY),
    beaconing=C.BeaconingCfg(min_samples=3, max_jitter_cv=0.6, window_s=20 * DAY, cooldown_s=2 * DAY, max_samples=4),
    threat_intel=C.SimpleCfg(cooldown_s=3 * DAY),
    suspicious_port=C.PortListCfg(cooldown_s=2 * DAY),
    new_listener=C.NewListenerCfg(min_sources=5, window_s=2 * DAY, cooldown_s=DAY),
    custom_signature=C.SimpleCfg(cooldown_s=DAY, suppress_after=5),
    signature=[
        C.SignatureCfg(name="seven", protocol="tcp", direction="in", content='"k|22|: 7'),
        C.SignatureCfg(name="web", ports=[80, 443], severity="low", msg="web port", sid=42),
        C.SignatureCfg(name="net", peer_cidr=["200.0.0.0/20"], direction="out", content="K|22|: 1", nocase=True, offset=2, depth=8),
    ],
)
INTEL = [("200.0.0.0/18", "broad"), ("200.0.8.0/21", "narrow"), ("200.0.20.40/32", "host"), ("200.0.96.0/20", "other"), ("2001:db8::/32", "six")]
GEO = [("200.0.0.0/17", 100, "AA"), ("200.0.32.0/19", 200, "BB"), ("200.0.64.0/22", 300, "CC")]
ALLOW = ["200.0.4.0/22", "200.0.64.0/19"]
LISTENING = [22, 80, 443]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_packets(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{P.SQL.strip()}{body}"


def _ip4(low: int, bits: int) -> str:
    return f"peer4 >> {32 - bits} = {low >> (32 - bits)}"


# ---- predicates and projections ----


@query(with_packets(" SELECT seq, tcp_flags, " + (FLAG_SQL := """
  CASE WHEN tcp_flags & 255 = 0 THEN 'NULL' WHEN tcp_flags & 41 = 41 AND tcp_flags & 22 = 0 THEN 'XMAS' WHEN tcp_flags & 3 = 3 THEN 'SYN+FIN'
       WHEN tcp_flags & 6 = 6 THEN 'SYN+RST' WHEN tcp_flags & 1 = 1 AND tcp_flags & 22 = 0 THEN 'FIN-only' ELSE 'invalid' END""") + """ AS combo,
  (tcp_flags & 255 = 0 OR tcp_flags & 3 = 3 OR tcp_flags & 6 = 6 OR (tcp_flags & 1 = 1 AND tcp_flags & 22 = 0)) AS is_invalid,
  (tcp_flags & 2 = 2 AND tcp_flags & 21 = 0) AS syn_only FROM packets WHERE proto = 'tcp'"""))  # fmt: skip
def decode_flags(spark, sf_dir):
    f = F.col("tcp_flags")
    return P.packets(spark, sf_dir).where("proto = 'tcp'").select("seq", "tcp_flags", S.combo_name(f).alias("combo"), S.is_invalid(f).alias("is_invalid"), S.is_syn_only(f).alias("syn_only"))


NEW = "proto = 'tcp' AND tcp_flags & 2 = 2 AND tcp_flags & 21 = 0"
INVALID = "proto = 'tcp' AND (tcp_flags & 255 = 0 OR tcp_flags & 3 = 3 OR tcp_flags & 6 = 6 OR (tcp_flags & 1 = 1 AND tcp_flags & 22 = 0))"


@query(with_packets(f" SELECT seq, peer_ip, dst_port FROM packets WHERE direction = 'inbound' AND {NEW}"))
def new_conn_filter(spark, sf_dir):
    return P.packets(spark, sf_dir).where((F.col("direction") == "inbound") & S.is_new_connection(F.col("proto"), F.col("tcp_flags"))).select("seq", "peer_ip", "dst_port")


def _range_sql(column: str) -> str:
    return " OR ".join(f"{column} BETWEEN {a} AND {b}" for a, b in map(net._v4_range, net.NOT_PUBLIC_V4))


@query(f"WITH a AS (SELECT c_custkey AS id, (c_custkey * 2654435761) % 4294967296 AS n FROM customer) SELECT id, {P._V4.format('n')} AS ip, NOT ({_range_sql('n')}) AS is_public FROM a")
def public_scope_v4(spark, sf_dir):
    n = (F.col("c_custkey") * 2654435761) % 4294967296
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), net.v4_text(n).alias("ip"))
    return df.withColumn("is_public", net.is_public_v4(net.v4_number(F.col("ip"))))


_HOST_FLAGS = "l_orderkey % 5 = 0 AS src_host, l_partkey % 3 = 0 AS dst_host, l_suppkey % 2 = 0 AS src_public, l_linenumber % 2 = 0 AS dst_public"


def _ends(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", *_HOST_FLAGS.split(", "))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN src_host THEN 'outbound' WHEN dst_host THEN 'inbound' END AS direction FROM (SELECT l_orderkey, l_linenumber, {_HOST_FLAGS} FROM lineitem) WHERE src_host OR dst_host")
def direction_classify(spark, sf_dir):
    way = net.direction(F.col("src_host"), F.col("dst_host"))
    return _ends(spark, sf_dir).select("l_orderkey", "l_linenumber", way.alias("direction")).where("direction is not null")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN src_host THEN 'outbound' WHEN dst_host THEN 'inbound' WHEN src_public THEN 'inbound' ELSE 'outbound' END AS direction FROM (SELECT l_orderkey, l_linenumber, {_HOST_FLAGS} FROM lineitem) WHERE src_host OR dst_host OR src_public OR dst_public")
def flow_direction_fallback(spark, sf_dir):
    way = net.flow_direction(F.col("src_host"), F.col("dst_host"), F.col("src_public"), F.col("dst_public"))
    return _ends(spark, sf_dir).select("l_orderkey", "l_linenumber", way.alias("direction")).where("direction is not null")


@query("SELECT p_partkey, proto FROM (SELECT p_partkey, p_partkey % 64 AS n, CASE p_partkey % 64 WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' WHEN 58 THEN 'icmp' ELSE concat('ip/', p_partkey % 64) END AS proto FROM part)")
def protocol_name(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", S.proto_name(F.col("p_partkey") % 64).alias("proto"))


@query("SELECT doc_id, regexp_matches(substr(hex(encode(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))), 5, 1024), '^(..)*74686520') AS folded, regexp_matches(substr(hex(encode(text)), 1, 128), '^(..)*5468') AS plain FROM documents")
def content_match(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    b = F.col("text").cast("binary")
    return d.select("doc_id", S.content_match(b, b"THE ", True, 2, 512).alias("folded"), S.content_match(b, b"Th", depth=64).alias("plain"))


# ---- scalar functions ----


@query("SELECT page_id, round(coalesce(list_sum(list_transform(list_distinct(string_split(url, '')), lambda c: -((length(url) - length(replace(url, c, ''))) / length(url)) * log2((length(url) - length(replace(url, c, ''))) / length(url)))), 0), 6) AS entropy FROM pages")
def qname_entropy(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.round(S.shannon_entropy(F.col("url")), 6).alias("entropy"))


_HOSTNAME = "split_part(split_part(url, '://', 2), '/', 1)"


@query(f"SELECT page_id, CAST(list_max(list_transform(string_split({_HOSTNAME}, '.'), lambda x: length(x))) AS INT) AS longest, array_to_string(string_split({_HOSTNAME}, '.')[-2:], '.') AS base FROM pages")
def qname_labels(spark, sf_dir):
    host = F.split_part(F.split_part(F.col("url"), F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", S.longest_label(host).alias("longest"), S.base_domain(host).alias("base"))


_SEVERITY = "CASE seq % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END"


# The rules as SQL has them: written out, so that a wrong value in the library shows.
_RULES_SQL = """(SELECT * FROM (VALUES
  (0, 'port-scan', 'T1046', 'TA0007', 'Discovery', 'recon,scan,discovery', 25),
  (1, 'invalid-tcp-flags', 'T1046', 'TA0007', 'Discovery', 'recon,scan,evasion', 25),
  (2, 'brute-force', 'T1110', 'TA0006', 'Credential Access', 'credential-access,brute-force', 40),
  (3, 'syn-flood', 'T1498.001', 'TA0040', 'Impact', 'dos,flood,availability', 50),
  (4, 'udp-flood', 'T1498', 'TA0040', 'Impact', 'dos,flood,availability', 38),
  (5, 'icmp-flood', 'T1498', 'TA0040', 'Impact', 'dos,flood,availability', 38),
  (6, 'reflection-amplification', 'T1498.002', 'TA0040', 'Impact', 'dos,amplification,availability', 50),
  (7, 'dns-tunnel', 'T1071.004', 'TA0011', 'Command and Control', 'exfiltration,c2,dns', 45),
  (8, 'icmp-tunnel', 'T1095', 'TA0011', 'Command and Control', 'tunneling,c2,icmp', 45),
  (9, 'beaconing', 'T1071', 'TA0011', 'Command and Control', 'c2,beaconing', 45),
  (10, 'threat-intel-hit', 'T1071', 'TA0011', 'Command and Control', 'threat-intel,known-bad', 55),
  (11, 'suspicious-port', 'T1571', 'TA0011', 'Command and Control', 'c2,backdoor', 30),
  (12, 'new-listener-probe', 'T1595', 'TA0043', 'Reconnaissance', 'recon,fingerprinting', 18),
  (13, 'custom-signature', 'T1071', 'TA0011', 'Command and Control', 'custom,signature', 35))
  v(rule_ord, rule, mitre, tactic, tactic_name, tags, weight))"""


@query(with_packets(f", s AS (SELECT seq, weight, {_SEVERITY} AS severity, payload_len AS count FROM packets JOIN {_RULES_SQL} ON rule_ord = seq % 14) SELECT seq, CAST(least(100, weight + CASE severity WHEN 'low' THEN 8 WHEN 'medium' THEN 18 ELSE 30 END + floor(least(ln(1 + count) * 6, 20))) AS INT) AS risk_score FROM s"))
def risk_score(spark, sf_dir):
    s = P.packets(spark, sf_dir).select("seq", (F.col("seq") % 14).cast("int").alias("rule_ord"), R.pick({0: "low", 1: "medium"}, F.col("seq") % 3, "high").alias("severity"), F.col("payload_len").alias("count"))
    s = s.join(F.broadcast(R.catalog(spark)), "rule_ord")
    return s.select("seq", R.risk_score(F.col("weight"), F.col("severity"), F.col("count")).alias("risk_score"))


@query(with_packets(f" SELECT rule, rule_ord, mitre, tactic, tactic_name, tags, weight, count(seq) AS packets FROM {_RULES_SQL} LEFT JOIN packets ON seq % 14 = rule_ord GROUP BY ALL"))
def rule_catalog(spark, sf_dir):
    """The catalog, and the packets whose number falls to each rule."""
    n = P.packets(spark, sf_dir).groupBy((F.col("seq") % 14).cast("int").alias("rule_ord")).agg(F.count("*").alias("packets"))
    return R.catalog(spark).join(n, "rule_ord", "left").na.fill(0, ["packets"]).withColumn("tags", F.array_join("tags", ",")).drop("level")


@query(with_packets(", p AS (SELECT peer_ip, list_sort(list_distinct(list(dst_port) FILTER (dst_port IS NOT NULL))) AS ports FROM packets GROUP BY peer_ip) SELECT peer_ip, concat(array_to_string(ports[1:4], ','), CASE WHEN len(ports) > 4 THEN concat(',+', len(ports) - 4) ELSE '' END) AS ports FROM p"))
def join_ports(spark, sf_dir):
    return P.packets(spark, sf_dir).groupBy("peer_ip").agg(F.collect_set("dst_port").alias("ports")).select("peer_ip", S.join_ports(F.col("ports"), 4).alias("ports"))


@query(with_packets(" SELECT seq, regexp_replace(local_ip, '[0-9]+$', '0') AS local_ip FROM packets"))
def redact_local(spark, sf_dir):
    return sinks.redact(P.packets(spark, sf_dir)).select("seq", "local_ip")


# ---- lookup joins ----

_INTEL_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({int(net.parse_prefix(c)[2].ljust(32, '0'), 2)}, {net.parse_prefix(c)[1]}, '{s}')" for c, s in INTEL if ":" not in c) + ") v(low, len, source))"
_GEO_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({int(net.parse_prefix(c)[2].ljust(32, '0'), 2)}, {net.parse_prefix(c)[1]}, {a}, '{cc}')" for c, a, cc in GEO) + ") v(low, len, asn, country))"
_ALLOW_SQL = " OR ".join(f"peer4 BETWEEN {a} AND {b}" for a, b in map(net._v4_range, ALLOW))


def _geo_table(spark):
    rows = [(*net.parse_prefix(c), a, cc) for c, a, cc in GEO]
    return spark.createDataFrame(rows, "family int, prefix_len int, prefix_bits string, asn long, country string")


@query(with_packets(f" SELECT seq, arg_max(source, len) AS source, CAST(max(len) AS INT) AS prefix_len FROM packets JOIN {_INTEL_SQL} i ON peer4 >> (32 - len) = low >> (32 - len) GROUP BY seq"))
def intel_lpm(spark, sf_dir):
    p = P.packets(spark, sf_dir).select("seq", "peer_ip")
    return lookups.longest_prefix(p, lookups.prefixes(spark, INTEL), "peer_ip", ["source"]).select("seq", "source", "prefix_len")


@query(with_packets(f", g AS (SELECT seq, arg_max(asn, len) AS asn, arg_max(country, len) AS country FROM packets JOIN {_GEO_SQL} i ON peer4 >> (32 - len) = low >> (32 - len) GROUP BY seq) SELECT p.seq, CAST(asn AS BIGINT) AS asn, country FROM packets p LEFT JOIN g USING (seq)"))
def geo_lpm_left(spark, sf_dir):
    p = P.packets(spark, sf_dir).select("seq", "peer_ip")
    return lookups.longest_prefix(p, _geo_table(spark), "peer_ip", ["asn", "country"], how="left").select("seq", "asn", "country")


_K = "s_suppkey % 60"
_OUTER, _INNER = f"{P.PEER_BASE} + {_K} * 1000", f"{P.PEER_BASE} + {_K} * 1000 + 100"


@query(with_packets(f""", k AS (SELECT DISTINCT {_K} AS k, {_OUTER} AS a, {_INNER} AS b FROM supplier),
ranges AS (SELECT a AS lo, a + 999 AS hi, 100 + k AS asn, 'OUT' AS country FROM k UNION ALL SELECT b, b + k * 37 % 800, 5000 + k, 'IN' FROM k)
SELECT seq, CAST(arg_min(asn, hi - lo) AS BIGINT) AS asn, arg_min(country, hi - lo) AS country FROM packets JOIN ranges ON peer4 BETWEEN lo AND hi GROUP BY seq"""))
def geo_ranges(spark, sf_dir):
    """Places from lines of unaligned ranges, one inside another, split into prefixes."""
    ip = lambda e: net.v4_text(F.expr(e))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    line = lambda lo, hi, asn, name: F.concat_ws(",", ip(lo), ip(hi), F.expr(asn).cast("string"), F.lit(name))
    outer, inner = line(_OUTER, f"{_OUTER} + 999", f"100 + {_K}", "OUT"), line(_INNER, f"{_INNER} + {_K} * 37 % 800", f"5000 + {_K}", "IN")
    places = geo.parse(s.select(F.explode(F.array(outer, inner)).alias("value")).distinct())
    return lookups.longest_prefix(P.packets(spark, sf_dir).select("seq", "peer_ip"), places, "peer_ip", ["asn", "country"]).select("seq", "asn", "country")


@query(with_packets(f" SELECT seq, peer_ip FROM packets WHERE NOT ({_ALLOW_SQL})"))
def allowlist_anti_join(spark, sf_dir):
    return lookups.without_prefixes(P.packets(spark, sf_dir), ALLOW).select("seq", "peer_ip")


_FEED = "CASE s_suppkey % 6 WHEN 0 THEN concat('200.0.', s_suppkey % 256, '.0/24 # feed') WHEN 1 THEN concat(' 200.1.', s_suppkey % 250, '.9') WHEN 2 THEN '# comment' WHEN 3 THEN concat('not-an-ip-', s_suppkey) WHEN 4 THEN concat('200.2.', s_suppkey % 200, '.77/16') ELSE concat('300.1.1.', s_suppkey % 200) END"


def _feed(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(f"{_FEED} AS value")


@query("SELECT DISTINCT n.prefix_len, n.network FROM (SELECT CASE s_suppkey % 6 WHEN 0 THEN {'prefix_len': 24, 'network': concat('200.0.', s_suppkey % 256, '.0')} WHEN 1 THEN {'prefix_len': 32, 'network': concat('200.1.', s_suppkey % 250, '.9')} WHEN 4 THEN {'prefix_len': 16, 'network': '200.2.0.0'} END AS n FROM supplier) WHERE n IS NOT NULL")
def feed_parse(spark, sf_dir):
    p = feeds.parse_feed(_feed(spark, sf_dir), "feed")
    number = F.conv(F.rpad("prefix_bits", 32, "0"), 2, 10).cast("bigint")
    return p.select("prefix_len", net.v4_text(number).alias("network"))


@query("SELECT count(*) FILTER (s_suppkey % 6 IN (0, 1, 4)) AS valid, count(*) FILTER (s_suppkey % 6 IN (3, 5)) AS invalid FROM supplier")
def feed_stats(spark, sf_dir):
    return feeds.feed_stats(_feed(spark, sf_dir))


@query("SELECT CAST(floor(v.value * 1) AS BIGINT) AS bucket, arg_max(source, feed) AS source FROM (SELECT s_suppkey % 2000 AS value, 'first' AS source, 0 AS feed FROM supplier UNION ALL SELECT 3 * s_suppkey % 2000, 'second', 1 FROM supplier) v GROUP BY 1")
def feed_merge(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    shape = lambda times, name: s.select(F.lit(4).alias("family"), F.lit(32).alias("prefix_len"), (times * F.col("s_suppkey") % 2000).cast("string").alias("prefix_bits"), F.lit(name).alias("source"))
    merged = lookups.merge_prefixes([shape(1, "first"), shape(3, "second")])
    return merged.select(F.col("prefix_bits").cast("bigint").alias("bucket"), "source")


_FLOW_LINE = "CASE o_orderkey % 4 WHEN 0 THEN concat('2 123 eni-1 200.', o_custkey % 200, '.1.9 5.7.9.11 51234 ', o_orderkey % 70000, ' 6 1 60 ', 1700000000 + o_orderkey, ' 1 ACCEPT OK') WHEN 1 THEN concat('{\"srcaddr\":\"5.7.9.11\",\"dstaddr\":\"200.', o_custkey % 200, '.2.2\",\"dstport\":\"', o_orderkey % 1000, '\",\"protocol\":17,\"start\":', o_orderkey, '}') WHEN 2 THEN 'version account-id' ELSE concat('2 1 2 10.0.0.1 10.0.0.', o_custkey % 256, ' 5 6 7 6 1 60 1 2 ACCEPT OK') END"


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'inbound' ELSE 'outbound' END AS direction, concat('200.', o_custkey % 200, CASE WHEN o_orderkey % 4 = 0 THEN '.1.9' ELSE '.2.2' END) AS peer_ip, CASE WHEN o_orderkey % 4 = 0 THEN 'tcp' ELSE 'udp' END AS proto, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 51234 END AS INT) AS src_port, CAST(CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 1000 WHEN o_orderkey % 70000 <= 65535 THEN o_orderkey % 70000 END AS INT) AS dst_port, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 END AS INT) AS tcp_flags, CASE WHEN o_orderkey % 4 = 0 THEN 1700000000000000 + o_orderkey * 1000000 ELSE o_orderkey * 1000000 END AS ts_us FROM orders WHERE o_orderkey % 4 IN (0, 1)")
def flowlog_parse(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.expr(_FLOW_LINE).alias("value"))
    return flowlog.packets(flowlog.parse(lines), ["5.7.9.11"]).select("seq", "direction", "peer_ip", "proto", "src_port", "dst_port", "tcp_flags", "ts_us")


# ---- windows ----


@query(with_packets(f" SELECT seq, peer_ip, count(*) OVER (PARTITION BY peer_ip ORDER BY ts_us RANGE BETWEEN {6 * HOUR * US - 1} PRECEDING AND CURRENT ROW) AS n FROM packets"))
def window_count(spark, sf_dir):
    p = P.packets(spark, sf_dir).select("seq", "ts_us", "peer_ip")
    return windows.counts_at_arrival(p, ["peer_ip"], 6 * HOUR * US, {"n": None}).select("seq", "peer_ip", "n")


@query(with_packets(f", p AS (SELECT seq, peer_ip, ts_us, dst_ip, dst_port FROM packets WHERE dst_port IS NOT NULL) SELECT a.seq, count(DISTINCT (b.dst_ip, b.dst_port)) AS targets FROM p a JOIN p b ON a.peer_ip = b.peer_ip AND b.ts_us > a.ts_us - {DAY * US} AND b.ts_us <= a.ts_us GROUP BY a.seq"))
def window_distinct_targets(spark, sf_dir):
    p = P.packets(spark, sf_dir).where("dst_port is not null").select("seq", "ts_us", "peer_ip", "dst_ip", "dst_port")
    return windows.distinct_at(p, ["peer_ip"], ["dst_ip", "dst_port"], DAY * US, "targets").select("seq", "targets")


@query(with_packets(", g AS (SELECT peer_ip, greatest(ts_us - lag(ts_us) OVER (PARTITION BY peer_ip ORDER BY seq), 0) / 1e6 AS gap FROM packets) SELECT peer_ip, count(*) AS n, round(avg(gap), 4) AS mean_gap, round(stddev_pop(gap) / avg(gap), 6) AS cv FROM g GROUP BY peer_ip HAVING count(*) >= 3 AND avg(gap) > 0"))
def interarrival_cv(spark, sf_dir):
    return windows.jitter(P.packets(spark, sf_dir), ["peer_ip"]).select("peer_ip", "n", F.round("mean_gap", 4).alias("mean_gap"), F.round("cv", 6).alias("cv"))


@query(with_packets(f", e AS (SELECT *, CASE WHEN direction = 'outbound' THEN src_ip ELSE dst_ip END AS end_ip, CASE WHEN direction = 'outbound' THEN src_port ELSE dst_port END AS end_port FROM packets WHERE (direction = 'outbound' AND proto = 'tcp' AND tcp_flags & 18 = 18) OR (direction = 'inbound' AND {NEW})), w AS (SELECT seq, direction, count(*) FILTER (direction = 'inbound') OVER f AS syns, count(*) FILTER (direction = 'outbound') OVER f AS answers FROM e WINDOW f AS (PARTITION BY end_ip, end_port ORDER BY ts_us RANGE BETWEEN {DAY * US - 1} PRECEDING AND CURRENT ROW)) SELECT seq, syns, answers, round(answers / syns, 6) AS ratio FROM w WHERE direction = 'inbound'"))
def completion_ratio(spark, sf_dir):
    p = P.packets(spark, sf_dir)
    out = F.col("direction") == "outbound"
    e = p.where((out & (F.col("proto") == "tcp") & S.has(F.col("tcp_flags"), 18)) | (~out & S.is_new_connection(F.col("proto"), F.col("tcp_flags"))))
    e = e.withColumns({"end_ip": F.when(out, F.col("src_ip")).otherwise(F.col("dst_ip")), "end_port": F.when(out, F.col("src_port")).otherwise(F.col("dst_port"))})
    e = windows.counts_at_arrival(e.select("seq", "ts_us", "direction", "end_ip", "end_port"), ["end_ip", "end_port"], DAY * US, {"syns": ~out, "answers": out})
    return e.where("direction = 'inbound'").select("seq", "syns", "answers", F.round(F.col("answers") / F.col("syns"), 6).alias("ratio"))


_UNSOLICITED = f"""u AS (
  SELECT *, last_value(CASE WHEN direction = 'outbound' THEN ts_us END IGNORE NULLS) OVER (PARTITION BY peer_ip, CASE WHEN direction = 'outbound' THEN dst_port ELSE src_port END ORDER BY seq ROWS UNBOUNDED PRECEDING) AS asked
  FROM packets WHERE proto = 'udp' AND CASE WHEN direction = 'outbound' THEN dst_port ELSE src_port END IN ({', '.join(map(str, C.REFLECTOR_PORTS))})),
unsolicited AS (SELECT * FROM u WHERE direction = 'inbound' AND NOT coalesce(ts_us - asked BETWEEN 0 AND {2 * DAY * US}, false))"""


@query(with_packets(f", {_UNSOLICITED} SELECT seq, peer_ip, src_port FROM unsolicited"))
def solicited_antijoin(spark, sf_dir):
    return detectors.unsolicited(P.packets(spark, sf_dir), C.REFLECTOR_PORTS, 2 * DAY * US).select("seq", "peer_ip", "src_port")


def _cooldown_sql(source: str, keys: str, cooldown_s: int, name: str = "c") -> str:
    """CTEs that end in {name}: the rows of `source` that a greedy cooldown lets pass."""
    same = " AND ".join(f"n.{k} IS NOT DISTINCT FROM r.{k}" for k in keys.split(", "))
    step = f"n.ts_us - r.last BETWEEN 0 AND {cooldown_s * US - 1}"
    return f"""
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seq) AS rn FROM {source}),
{name}_r AS (
  SELECT *, ts_us AS last, true AS emit FROM {name}_n WHERE rn = 1
  UNION ALL SELECT n.*, CASE WHEN {step} THEN r.last ELSE n.ts_us END, NOT ({step}) FROM {name}_r r JOIN {name}_n n ON n.rn = r.rn + 1 AND {same}),
{name} AS (SELECT * FROM {name}_r WHERE emit)"""


@query(with_packets("," + _cooldown_sql(f"(SELECT * FROM packets WHERE {INVALID})", "peer_ip", 5 * DAY) + " SELECT seq, peer_ip FROM c", True))
def cooldown(spark, sf_dir):
    p = P.packets(spark, sf_dir)
    return windows.cooldown(p.where((F.col("proto") == "tcp") & S.is_invalid(F.col("tcp_flags"))).select("seq", "ts_us", "peer_ip"), ["peer_ip"], 5 * DAY * US).select("seq", "peer_ip")


@query(with_packets("," + _cooldown_sql("packets", "peer_ip", DAY) + ", s AS (SELECT *, row_number() OVER (PARTITION BY peer_ip ORDER BY seq) AS k FROM c) SELECT seq, peer_ip FROM s WHERE k <= 3", True))
def suppress_after(spark, sf_dir):
    p = P.packets(spark, sf_dir).select("seq", "ts_us", "peer_ip")
    return windows.suppress_after(windows.cooldown(p, ["peer_ip"], DAY * US), ["peer_ip"], 3).select("seq", "peer_ip")


# ---- detectors ----

_ALERT = ["seq", "rule", "severity", "peer_ip", "detail", "count", "window_s", "risk_score"]


def _finished(drafts: DataFrame) -> DataFrame:
    return Engine().finish(drafts).select(*_ALERT)


def _finish_sql(rule: str, cfg, detail: str, count: str, source: str, window: bool = True) -> str:
    r = R.BY_NAME[rule]
    fixed = r.weight + R.SEVERITY_POINTS[cfg.severity]
    return f" SELECT seq, '{rule}' AS rule, '{cfg.severity}' AS severity, peer_ip, {detail} AS detail, CAST({count} AS BIGINT) AS count, CAST({cfg.window_s if window else 0} AS BIGINT) AS window_s, CAST(least(100, {fixed} + floor(least(ln(1 + {count}) * 6, 20))) AS INT) AS risk_score FROM {source}"


def _counting(rule: str, cfg, guard: str, keys: str, detail: str, source: str = "packets", before: str = "", extra: str = "") -> str:
    frame = f"count(*) OVER (PARTITION BY {keys} ORDER BY ts_us RANGE BETWEEN {cfg.window_s * US - 1} PRECEDING AND CURRENT ROW)"
    body = f", {before}h AS (SELECT * FROM (SELECT *, {frame} AS n FROM (SELECT * {extra} FROM {source} WHERE {guard})) WHERE n >= {cfg.threshold}),"
    return with_packets(body + _cooldown_sql("h", keys, cfg.cooldown_s) + _finish_sql(rule, cfg, detail, "n", "c"), True)


@query(_counting("invalid-tcp-flags", CFG.invalid_tcp_flags, INVALID, "peer_ip", f"concat('invalid TCP flags (', {FLAG_SQL}, '): ', n, ' packets in {CFG.invalid_tcp_flags.window_s}s')"))
def det_invalid_flags(spark, sf_dir):
    return _finished(detectors.invalid_tcp_flags(P.packets(spark, sf_dir), CFG.invalid_tcp_flags))


@query(_counting("udp-flood", CFG.udp_flood, "direction = 'inbound' AND proto = 'udp'", "dst_ip, end_port", f"concat('UDP flood on ', dst_ip, ': ', n, ' pkts in {CFG.udp_flood.window_s}s')", extra=", coalesce(dst_port, 0) AS end_port"))
def det_udp_flood(spark, sf_dir):
    return _finished(detectors.udp_flood(P.packets(spark, sf_dir), CFG.udp_flood))


@query(_counting("icmp-flood", CFG.icmp_flood, "direction = 'inbound' AND proto = 'icmp'", "dst_ip", f"concat('ICMP flood on ', dst_ip, ': ', n, ' pkts in {CFG.icmp_flood.window_s}s')"))
def det_icmp_flood(spark, sf_dir):
    return _finished(detectors.icmp_flood(P.packets(spark, sf_dir), CFG.icmp_flood))


_RX = CFG.reflection_amplification


@query(_counting("reflection-amplification", _RX, f"payload_len >= {_RX.min_response_bytes}", "peer_ip", f"concat('reflection/amplification: ', n, ' unsolicited ', src_port, '-source responses >= {_RX.min_response_bytes}B in {_RX.window_s}s')", "unsolicited", _UNSOLICITED + ", "))
def det_reflection(spark, sf_dir):
    return _finished(detectors.reflection(P.packets(spark, sf_dir), _RX))


_IT = CFG.icmp_tunnel


@query(_counting("icmp-tunnel", _IT, f"proto = 'icmp' AND payload_len >= {_IT.max_payload}", "peer_ip", f"concat('possible ICMP tunnel: ', n, ' oversized echo payloads >= {_IT.max_payload}B in {_IT.window_s}s')"))
def det_icmp_tunnel(spark, sf_dir):
    return _finished(detectors.icmp_tunnel(P.packets(spark, sf_dir), _IT))


_SF = CFG.syn_flood


@query(with_packets(f""", e AS (
  SELECT *, CASE WHEN direction = 'outbound' THEN src_ip ELSE dst_ip END AS end_ip, CASE WHEN direction = 'outbound' THEN src_port ELSE dst_port END AS end_port FROM packets
  WHERE (direction = 'outbound' AND proto = 'tcp' AND tcp_flags & 18 = 18) OR (direction = 'inbound' AND {NEW})),
w AS (SELECT *, count(*) FILTER (direction = 'inbound') OVER f AS n, count(*) FILTER (direction = 'outbound') OVER f AS answers FROM e
  WINDOW f AS (PARTITION BY end_ip, end_port ORDER BY ts_us RANGE BETWEEN {_SF.window_s * US - 1} PRECEDING AND CURRENT ROW)),
h AS (SELECT * FROM w WHERE direction = 'inbound' AND n >= {_SF.threshold} AND answers / n < {_SF.max_completion_ratio}),"""
    + _cooldown_sql("h", "end_ip, end_port", _SF.cooldown_s)
    + _finish_sql("syn-flood", _SF, f"concat('SYN flood on ', end_ip, ':', end_port, ': ', n, ' SYNs, ', answers, ' SYN-ACKs, completion ratio ', printf('%.2f', answers / n), ' in {_SF.window_s}s')", "n", "c"), True))
def det_syn_flood(spark, sf_dir):
    return _finished(detectors.syn_flood(P.packets(spark, sf_dir), _SF))


@query(with_packets(f", h AS (SELECT p.*, g.source FROM packets p JOIN (SELECT seq, arg_max(source, len) AS source FROM packets JOIN {_INTEL_SQL} i ON peer4 >> (32 - len) = low >> (32 - len) GROUP BY seq) g USING (seq))," + _cooldown_sql("h", "peer_ip", CFG.threat_intel.cooldown_s) + _finish_sql("threat-intel-hit", CFG.threat_intel, "concat('peer ', peer_ip, ' matches threat feed ''', source, '''')", "1", "c", False), True))
def det_threat_intel(spark, sf_dir):
    return _finished(detectors.threat_intel(P.packets(spark, sf_dir), CFG.threat_intel, lookups.prefixes(spark, INTEL)))


_BAD = ", ".join(map(str, C.BACKDOOR_PORTS))


@query(with_packets(f", h AS (SELECT *, CASE WHEN src_port IN ({_BAD}) THEN src_port ELSE dst_port END AS hit FROM packets WHERE src_port IN ({_BAD}) OR dst_port IN ({_BAD}))," + _cooldown_sql("h", "peer_ip", CFG.suspicious_port.cooldown_s) + _finish_sql("suspicious-port", CFG.suspicious_port, "concat('traffic on suspicious/backdoor port ', hit)", "1", "c", False), True))
def det_suspicious_port(spark, sf_dir):
    return _finished(detectors.suspicious_port(P.packets(spark, sf_dir), CFG.suspicious_port))


_CS = CFG.custom_signature
_SIGS = f"""sigs AS (
  SELECT *, 0 AS sig_ord, 'seven' AS sig_name, 'seven' AS sig_label, '{_CS.severity}' AS sev FROM packets WHERE proto = 'tcp' AND direction = 'inbound' AND instr(payload, '"k": 7') > 0
  UNION ALL SELECT *, 1, 'web', 'sid 42: web port', 'low' FROM packets WHERE src_port IN (80, 443) OR dst_port IN (80, 443)
  UNION ALL SELECT *, 2, 'net', 'net', '{_CS.severity}' FROM packets WHERE {_ip4(3355443200, 20)} AND direction = 'outbound' AND instr(lower(substr(payload, 3, 8)), 'k": 1') > 0)"""


@query(with_packets(f", {_SIGS} SELECT seq, sig_ord, sig_name FROM sigs"))
def signature_match(spark, sf_dir):
    p = P.packets(spark, sf_dir)
    names = F.filter(F.array(*(F.when(detectors.signature_column(s), F.struct(F.lit(i).alias("sig_ord"), F.lit(s.name).alias("sig_name"))) for i, s in enumerate(CFG.signature))), lambda x: x.isNotNull())
    return p.select("seq", F.explode(names).alias("s")).select("seq", "s.*")


@query(with_packets(f", {_SIGS}," + _cooldown_sql("sigs", "peer_ip, sig_name", _CS.cooldown_s) + f", k AS (SELECT *, row_number() OVER (PARTITION BY peer_ip, sig_name ORDER BY seq) AS nth FROM c) SELECT seq, 'custom-signature' AS rule, sev AS severity, peer_ip, concat('signature ''', sig_name, ''' [', sig_label, '] matched ', proto, ' ', direction, ' from ', peer_ip) AS detail, CAST(1 AS BIGINT) AS count, CAST(0 AS BIGINT) AS window_s, CAST(35 + CASE sev WHEN 'low' THEN 8 WHEN 'medium' THEN 18 ELSE 30 END + 4 AS INT) AS risk_score, sig_ord FROM k WHERE nth <= {_CS.suppress_after}", True))
def det_custom_signature(spark, sf_dir):
    return Engine().finish(detectors.custom_signature(P.packets(spark, sf_dir), _CS, CFG.signature)).select(*_ALERT, "sig_ord")


_MANY = 150
_NEEDLES = f"(SELECT i, chr(CAST(97 + i % 26 AS INT)) || chr(CAST(97 + i * 7 % 26 AS INT)) || chr(CAST(97 + i // 26 AS INT)) AS needle FROM range({_MANY}) t(i))"


@query(f"SELECT doc_id, count(i) AS matches, CAST(coalesce(sum(i), 0) AS BIGINT) AS ords FROM documents LEFT JOIN {_NEEDLES} ON contains(CASE i % 2 WHEN 0 THEN text ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, needle) AND (i % 3 > 0 OR doc_id % 50 = i % 50) AND (i % 5 > 0 OR doc_id % 2 = 0) GROUP BY doc_id")
def signature_match_many(spark, sf_dir):
    """Hundreds of signatures over whole texts as payloads: contents with and without case, some bound to a port or a protocol."""
    needle = lambda i: chr(97 + i % 26) + chr(97 + i * 7 % 26) + chr(97 + i // 26)
    signatures = [C.SignatureCfg(name=f"n{i}", content=needle(i), nocase=i % 2 == 1, ports=[] if i % 3 else [1000 + i % 50], protocol=None if i % 5 else "tcp") for i in range(_MANY)]
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "tcp").otherwise("udp").alias("proto"), F.lit("inbound").alias("direction"), F.lit(None).cast("int").alias("src_port"),
                 (1000 + F.col("doc_id") % 50).cast("int").alias("dst_port"), F.lit("200.0.0.1").alias("peer_ip"), F.col("text").cast("binary").alias("payload"))
    found = detectors.with_signatures(p, _CS, signatures).select("doc_id", F.col("_sigs.ord").alias("ord"))
    return found.select("doc_id", F.size("ord").cast("long").alias("matches"), F.aggregate("ord", F.lit(0).cast("long"), lambda a, x: a + x).alias("ords"))


def _fold_sql(guard: str, key: str, columns: str, first: str, step: str, names: str) -> str:
    """A fold over each key: `first` and `step` give the values of `names` at the first and every later row."""
    return f""", g AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS rn FROM packets WHERE {guard}),
r AS (SELECT {columns}, rn, {first} FROM g WHERE rn = 1
  UNION ALL SELECT {', '.join('g.' + c.strip() for c in columns.split(','))}, g.rn, {step} FROM r JOIN g ON g.rn = r.rn + 1 AND g.{key} = r.{key})"""


_PS = CFG.port_scan
_PS_NEW = f"list_append(list_filter(r.l, lambda x: x.u > g.ts_us - {_PS.window_s * US} AND NOT (x.h = g.dst_ip AND x.p = g.dst_port)), {{'h': g.dst_ip, 'p': g.dst_port, 'u': g.ts_us}})"
_PS_FULL = f"len({_PS_NEW}) >= {_PS.min_targets}"
_PS_OK = f"(r.last IS NULL OR NOT (g.ts_us - r.last BETWEEN 0 AND {_PS.cooldown_s * US - 1}))"
_COLS = "seq, peer_ip, ts_us, dst_ip, dst_port"


@query(with_packets(_fold_sql(
    f"direction = 'inbound' AND {NEW} AND dst_port IS NOT NULL", "peer_ip", _COLS,
    "[{'h': dst_ip, 'p': dst_port, 'u': ts_us}] AS l, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS hosts, CAST(NULL AS BIGINT) AS ports",
    f"CASE WHEN {_PS_FULL} THEN [] ELSE {_PS_NEW} END, CASE WHEN {_PS_FULL} AND {_PS_OK} THEN g.ts_us ELSE r.last END, CASE WHEN {_PS_FULL} AND {_PS_OK} THEN len({_PS_NEW}) END, len(list_distinct(list_transform({_PS_NEW}, lambda x: x.h))), len(list_distinct(list_transform({_PS_NEW}, lambda x: x.p)))", "")
    + _finish_sql("port-scan", _PS, f"concat(CASE WHEN hosts >= {_PS.min_targets} AND ports >= {_PS.min_targets} THEN 'horizontal+vertical' WHEN hosts >= {_PS.min_targets} THEN 'horizontal' ELSE 'vertical' END, ' scan: ', n, ' targets across ', hosts, ' hosts / ', ports, ' ports in {_PS.window_s}s')", "n", "r WHERE n IS NOT NULL"), True))
def det_port_scan(spark, sf_dir):
    return _finished(detectors.port_scan(P.packets(spark, sf_dir), _PS))


_BF = CFG.brute_force
_BF_NEW = f"list_append(list_filter(r.l, lambda x: x > g.ts_us - {_BF.window_s * US}), g.ts_us)"
_BF_FIRE = f"(len({_BF_NEW}) >= {_BF.threshold} AND (r.last IS NULL OR NOT (g.ts_us - r.last BETWEEN 0 AND {_BF.cooldown_s * US - 1})))"
_BF_PORTS = "list_distinct(list_append(r.ports, g.dst_port))"


@query(with_packets(_fold_sql(
    f"direction = 'inbound' AND {NEW} AND dst_port IN ({', '.join(map(str, C.AUTH_PORTS))})", "peer_ip", _COLS,
    "[ts_us] AS l, [dst_port] AS ports, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS listed",
    f"CASE WHEN {_BF_FIRE} THEN [] ELSE {_BF_NEW} END, CASE WHEN {_BF_FIRE} THEN [] ELSE {_BF_PORTS} END, CASE WHEN {_BF_FIRE} THEN g.ts_us ELSE r.last END, CASE WHEN {_BF_FIRE} THEN len({_BF_NEW}) END, array_to_string(list_sort({_BF_PORTS})[1:10], ',')", "")
    + _finish_sql("brute-force", _BF, f"concat('brute force: ', n, ' new connections to auth ports [', listed, '] in {_BF.window_s}s')", "n", "r WHERE n IS NOT NULL"), True))
def det_brute_force(spark, sf_dir):
    return _finished(detectors.brute_force(P.packets(spark, sf_dir), _BF))


_NL = CFG.new_listener
_NL_NEW = f"list_append(list_filter(r.l, lambda x: x.u > g.ts_us - {_NL.window_s * US} AND x.p <> g.peer_ip), {{'p': g.peer_ip, 'u': g.ts_us}})"
_NL_FIRE = f"(len({_NL_NEW}) >= {_NL.min_sources} AND (r.last IS NULL OR NOT (g.ts_us - r.last BETWEEN 0 AND {_NL.cooldown_s * US - 1})))"


@query(with_packets(_fold_sql(
    f"direction = 'inbound' AND {NEW} AND dst_port IS NOT NULL AND dst_port NOT IN ({', '.join(map(str, LISTENING))})", "dst_port", _COLS,
    "[{'p': peer_ip, 'u': ts_us}] AS l, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS n",
    f"CASE WHEN {_NL_FIRE} THEN [] ELSE {_NL_NEW} END, CASE WHEN {_NL_FIRE} THEN g.ts_us ELSE r.last END, CASE WHEN {_NL_FIRE} THEN len({_NL_NEW}) END", "")
    + _finish_sql("new-listener-probe", _NL, f"concat(n, ' distinct sources probing un-listened port ', dst_port, ' in {_NL.window_s}s')", "n", "r WHERE n IS NOT NULL"), True))
def det_new_listener(spark, sf_dir):
    return _finished(detectors.new_listener(P.packets(spark, sf_dir), _NL, LISTENING))


_BE = CFG.beaconing
_BE_NEW = f"list_filter(list_append(r.l, g.ts_us)[-{_BE.max_samples}:], lambda x: x > g.ts_us - {_BE.window_s * US})"
_BE_GAPS = f"list_transform(list_zip(({_BE_NEW})[1:-2], ({_BE_NEW})[2:]), lambda z: greatest(z[2] - z[1], 0) / 1e6)"
_BE_CV = f"list_stddev_pop({_BE_GAPS}) / list_avg({_BE_GAPS})"
_BE_FIRE = f"(len({_BE_NEW}) >= {_BE.min_samples} AND coalesce({_BE_CV} <= {_BE.max_jitter_cv}, false) AND (r.last IS NULL OR NOT (g.ts_us - r.last BETWEEN 0 AND {_BE.cooldown_s * US - 1})))"


@query(with_packets(_fold_sql(
    f"direction = 'outbound' AND {NEW}", "peer_ip", _COLS, "[ts_us] AS l, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS cv",
    f"CASE WHEN {_BE_FIRE} THEN [] ELSE {_BE_NEW} END, CASE WHEN {_BE_FIRE} THEN g.ts_us ELSE r.last END, CASE WHEN {_BE_FIRE} THEN len({_BE_NEW}) END, list_avg({_BE_GAPS}), {_BE_CV}", "")
    + _finish_sql("beaconing", _BE, f"concat('beaconing to ', peer_ip, ': ', n, ' connections, mean interval ', printf('%.1f', mean), 's, jitter CV ', printf('%.3f', cv), ' (<= {_BE.max_jitter_cv:g})')", "n", "r WHERE n IS NOT NULL"), True))
def det_beaconing(spark, sf_dir):
    return _finished(detectors.beaconing(P.packets(spark, sf_dir), _BE))


_DT = CFG.dns_tunnel
_DT_SET = "list_distinct(list_append(r.names, g.qname))"
_DT_TXT = f"CASE WHEN g.qtype IN (10, 16) THEN list_append(list_filter(r.txt, lambda x: x > g.ts_us - {_DT.window_s * US}), g.ts_us) ELSE r.txt END"
_DT_SUSP = f"CASE WHEN g.susp THEN list_append(list_filter(r.odd, lambda x: x > g.ts_us - {_DT.window_s * US}), g.ts_us) ELSE r.odd END"
_DT_WHY = f"(CASE WHEN len({_DT_TXT}) >= {_DT.txt_threshold} THEN 'txt' WHEN len({_DT_SET}) >= {_DT.subdomain_threshold} THEN 'names' WHEN len({_DT_SUSP}) >= 5 THEN 'odd' END)"
_DT_OK = f"({_DT_WHY} IS NOT NULL AND (r.last IS NULL OR NOT (g.ts_us - r.last BETWEEN 0 AND {_DT.cooldown_s * US - 1})))"
_DT_BITS = "list_sum(list_transform(list_distinct(string_split({q}, '')), lambda c: -((length({q}) - length(replace({q}, c, ''))) / length({q})) * log2((length({q}) - length(replace({q}, c, ''))) / length({q}))))"
_DT_TEXT = f"concat('possible DNS tunnel: ', CASE {_DT_WHY} WHEN 'txt' THEN concat('high TXT/NULL volume: ', len({_DT_TXT}), ' queries') WHEN 'names' THEN concat('many unique subdomains: ', len({_DT_SET})) ELSE concat(len({_DT_SUSP}), ' high-entropy/long qnames (last entropy ', printf('%.1f', {_DT_BITS.format(q='g.qname')}), ')') END, ' in {_DT.window_s}s')"
_DT_SUSPECT = f"(length(qname) >= {_DT.qname_len_threshold} OR list_max(list_transform(string_split(qname, '.'), lambda x: length(x))) >= {_DT.label_len_threshold} OR {_DT_BITS.format(q='qname')} >= {_DT.entropy_threshold})"


@query(with_packets(f""", g AS (SELECT *, {_DT_SUSPECT} AS susp, row_number() OVER (PARTITION BY peer_ip ORDER BY seq) AS rn FROM packets WHERE qname IS NOT NULL),
r AS (SELECT seq, peer_ip, rn, [qname] AS names, CASE WHEN qtype IN (10, 16) THEN [ts_us] ELSE [] END AS txt, CASE WHEN susp THEN [ts_us] ELSE [] END AS odd, CAST(NULL AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS detail FROM g WHERE rn = 1
  UNION ALL SELECT g.seq, g.peer_ip, g.rn, CASE WHEN len({_DT_SET}) >= {_DT.subdomain_threshold} THEN [] ELSE {_DT_SET} END, {_DT_TXT}, {_DT_SUSP}, CASE WHEN {_DT_OK} THEN g.ts_us ELSE r.last END, CASE WHEN {_DT_OK} THEN {_DT_TEXT} END FROM r JOIN g ON g.rn = r.rn + 1 AND g.peer_ip = r.peer_ip)"""
    + _finish_sql("dns-tunnel", _DT, "detail", "0", "r WHERE detail IS NOT NULL"), True))
def det_dns_tunnel(spark, sf_dir):
    return _finished(detectors.dns_tunnel(P.packets(spark, sf_dir), _DT))


# ---- engine and sinks ----


def _engine(spark) -> Engine:
    return Engine(CFG, ALLOW, lookups.prefixes(spark, INTEL), _geo_table(spark), LISTENING)


#: The query of each rule alone.
_ALONE = {r.name: f"det_{r.name.replace('-', '_')}" for r in R.RULES} | {
    "invalid-tcp-flags": "det_invalid_flags", "reflection-amplification": "det_reflection", "threat-intel-hit": "det_threat_intel", "new-listener-probe": "det_new_listener",
}


def _every_alert(allowed: bool) -> str:
    """CTEs that end in `alerts`: whole alerts of all rules over packets whose peer is not on the allowlist."""
    keep = lambda sql: sql.replace("FROM texted)", f"FROM texted WHERE NOT ({_ALLOW_SQL}))") if allowed else sql
    told = " UNION ALL ".join(f"SELECT seq, rule, severity, peer_ip, detail, count, window_s, risk_score, {'sig_ord' if rule == 'custom-signature' else '0'} AS sig_ord FROM ({keep(ORACLES[name])})" for rule, name in _ALONE.items())
    return with_packets(f""", told AS ({told}),
places AS (SELECT seq, CAST(arg_max(asn, len) AS BIGINT) AS asn, arg_max(country, len) AS country FROM packets JOIN {_GEO_SQL} i ON peer4 >> (32 - len) = low >> (32 - len) GROUP BY seq),
alerts AS (
  SELECT substr(sha256(concat_ws('#', t.seq, t.rule, t.sig_ord, t.peer_ip)), 1, 16) AS id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS time, t.rule, t.severity, direction, t.peer_ip,
         asn AS peer_asn, country AS peer_country, local_ip, proto, src_port, dst_port, detail, mitre, t.count, window_s, risk_score, tactic, tactic_name, tags, 'netloom' AS sensor, 1 AS schema_version, t.seq, rule_ord, CAST(sig_ord AS INT) AS sig_ord
  FROM told t JOIN packets p ON p.seq = t.seq LEFT JOIN places g ON g.seq = t.seq JOIN {_RULES_SQL} r ON r.rule = t.rule)""")


def _alerts(spark, sf_dir):
    return _engine(spark).detect(P.packets(spark, sf_dir))


@query(_every_alert(True) + " SELECT * FROM alerts")
def engine_all_rules(spark, sf_dir):
    """Whole alerts of all fourteen rules, in the order in which one host would have told them."""
    flat = {"time": S.rfc3339(F.col("time")), "tags": F.array_join("tags", ","), "src_port": F.col("ports.src"), "dst_port": F.col("ports.dst")}
    return Engine.in_order(_alerts(spark, sf_dir)).withColumns(flat).drop("ports")


@query("SELECT rule, alerts FROM (" + " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS alerts FROM ({ORACLES[name]})" for rule, name in _ALONE.items()) + ") WHERE alerts > 0")
def engine_counts_by_rule(spark, sf_dir):
    """All fourteen rules at once, without an allowlist, against the twins of the rules alone."""
    return alerts_by_rule(Engine(CFG, [], lookups.prefixes(spark, INTEL), _geo_table(spark), LISTENING).detect(P.packets(spark, sf_dir)))


# ---- frames ----


@query(f"WITH {X.FIELDS_SQL} SELECT seq, ts_us, " + ", ".join(f"CASE WHEN error IS NULL THEN {c} END AS {c}" for c in X.FIELDS) + ", CAST(CASE WHEN fault = 12 THEN 24 + 4 * (seq % 3) ELSE frame_len END AS INT) AS frame_len, error FROM fields")
def frames_decode(spark, sf_dir):
    """Every field of every frame; the payload of a message that asks for a name is left to its name."""
    text = F.when(F.col("qname").isNull(), F.col("payload").cast("string"))
    return decode.decode(X.shaped(spark, sf_dir)).withColumn("payload", text).select("seq", "ts_us", *X.FIELDS, "frame_len", "error")


@query(f"""WITH {X.FIELDS_SQL} SELECT count(*) AS frames, CAST(sum(CASE WHEN fault = 12 THEN 24 + 4 * (seq % 3) ELSE frame_len END) AS BIGINT) AS bytes, count(error) AS parse_errors,
  count(*) FILTER (error IS NULL AND NOT v6) AS packets, count(*) FILTER (error IS NULL AND v6) AS skipped FROM fields""")
def frames_counters(spark, sf_dir):
    """What a run over the frames has seen; the hosts have addresses of the old family only."""
    raw = decode.decode(X.shaped(spark, sf_dir))
    return decode.counters(raw, decode.packets(raw, P.HOSTS))


def _captured(spark, sf_dir) -> str:
    """A folder of captures of all events in their order."""
    folder = f"{order.shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    pcap.write(X.plain(spark, sf_dir).repartitionByRange("seq").sortWithinPartitions("seq"), folder)
    return folder


@query(X.replayed(_every_alert(True)) + " SELECT * EXCLUDE (id, seq) FROM alerts")
def pcap_replay(spark, sf_dir):
    """Captures written, read back, decoded and run through all rules: whole alerts but for what hangs on a frame's number."""
    packets = decode.packets(pcap.read(spark, _captured(spark, sf_dir), decoded=True), P.HOSTS)
    flat = {"time": S.rfc3339(F.col("time")), "tags": F.array_join("tags", ","), "src_port": F.col("ports.src"), "dst_port": F.col("ports.dst")}
    return _engine(spark).detect(packets).withColumns(flat).drop("ports", "id", "seq")


@query(X.replayed(P.SQL.strip()).join(["WITH ", ""]) + " SELECT ts_us, src_ip, dst_ip, src_port, tcp_flags, payload_len FROM packets WHERE proto = 'tcp' AND dst_port = 22 AND ts_us >= 1704067200000000")
def pcap_pushed_filters(spark, sf_dir):
    """One service's connections out of captures, sorted out ahead of decoding where the session lets sources take filters."""
    df = pcap.read(spark, _captured(spark, sf_dir), decoded=True)
    return df.where("ip_proto = 6 AND dst_port = 22 AND ts_us >= 1704067200000000").select("ts_us", "src_ip", "dst_ip", "src_port", "tcp_flags", "payload_len")


def _simple(spark, sf_dir):
    """Alerts of one cheap rule, for the sinks."""
    cfg = replace(CFG.suspicious_port)
    return Engine().finish(detectors.suspicious_port(P.packets(spark, sf_dir), cfg))


_SIMPLE_SQL = f", h AS (SELECT *, CASE WHEN src_port IN ({_BAD}) THEN src_port ELSE dst_port END AS hit FROM packets WHERE src_port IN ({_BAD}) OR dst_port IN ({_BAD}))," + _cooldown_sql("h", "peer_ip", CFG.suspicious_port.cooldown_s)


@query(with_packets(_SIMPLE_SQL + " SELECT 'suspicious-port' AS rule, count(*) AS alerts FROM c", True))
def alerts_count_by_rule(spark, sf_dir):
    return alerts_by_rule(_simple(spark, sf_dir))


@query(with_packets(_SIMPLE_SQL + ", f AS (SELECT peer_ip, min(seq) AS first_seq FROM c WHERE NOT (peer4 BETWEEN 3355444224 AND 3355445247) GROUP BY peer_ip) SELECT peer_ip, first_seq, 'suspicious-port' AS rule FROM f ORDER BY first_seq LIMIT 40", True))
def block_decisions(spark, sf_dir):
    return sinks.block_decisions(_simple(spark, sf_dir), "low", ["200.0.4.0/22"], 40)


def _member(name: str, value: str, bare: bool = False) -> str:
    """SQL of one member of a JSON object."""
    return f"'\"{name}\":' || {value}" if bare else f"'\"{name}\":\"' || {value} || '\"'"


def _object(*members: str) -> str:
    return "'{' || " + " || ',' || ".join(members) + " || '}'"


def _end_sql(ip: str, port: str) -> str:
    return f"'{{' || {_member('ip', ip)} || CASE WHEN {port} IS NULL THEN '' ELSE ',\"port\":' || {port} END || '}}'"


_TAG_LIST = "'[\"' || replace(tags, ',', '\",\"') || '\"]'"
_IN = "direction = 'inbound'"
_PLACE = "CASE WHEN peer_asn IS NULL THEN '' ELSE '\"peer_asn\":' || peer_asn || ',\"peer_country\":\"' || peer_country || '\",' END || "
_PORTS = "'{\"src\":' || coalesce(CAST(src_port AS VARCHAR), 'null') || ',\"dst\":' || coalesce(CAST(dst_port AS VARCHAR), 'null') || '}'"
_ALERT_JSON = _object(
    *(_member(c, c) for c in ("id", "time", "rule", "severity", "direction", "peer_ip")), _PLACE + _member("local_ip", "regexp_replace(local_ip, '[0-9]+$', '0')"), _member("proto", "proto"), _member("ports", _PORTS, True),
    _member("detail", "detail"), _member("mitre", "mitre"), *(_member(c, c, True) for c in ("count", "window_s", "risk_score")), _member("tactic", "tactic"), _member("tactic_name", "tactic_name"), _member("tags", _TAG_LIST, True),
    _member("sensor", "sensor"), _member("schema_version", "schema_version", True),
)
_LABELS = "'{\"mitre_technique_id\":\"' || mitre || '\"' || CASE WHEN peer_asn IS NULL THEN '' ELSE ',\"peer_country\":\"' || peer_country || '\",\"peer_asn\":' || peer_asn END || '}'"
_ECS_JSON = _object(
    _member("@timestamp", "time"),
    _member("event", _object(_member("kind", "'alert'"), _member("category", "'network'"), _member("module", "'netloom'"), _member("severity", "CASE severity WHEN 'low' THEN 2 WHEN 'medium' THEN 3 ELSE 5 END", True), _member("code", "rule"), _member("action", "rule"), _member("risk_score", "risk_score", True)), True),
    _member("source", _end_sql(f"CASE WHEN {_IN} THEN peer_ip ELSE local_ip END", "src_port"), True), _member("destination", _end_sql(f"CASE WHEN {_IN} THEN local_ip ELSE peer_ip END", "dst_port"), True),
    _member("network", _object(_member("transport", "proto"), _member("direction", "direction")), True), _member("rule", _object(_member("name", "rule"), _member("reference", "'https://attack.mitre.org/techniques/' || mitre")), True),
    _member("mitre", _object(_member("technique_id", "mitre"), _member("tactic_id", "tactic"), _member("tactic_name", "tactic_name")), True), _member("tags", _TAG_LIST, True), _member("labels", _LABELS, True), _member("message", "detail"),
    _member("netloom", _object(_member("count", "count", True), _member("window_s", "window_s", True)), True),
)


@query(_every_alert(True) + f" SELECT {_ECS_JSON} AS value FROM alerts")
def ecs_json(spark, sf_dir):
    """Documents of all rules' alerts."""
    return sinks.ecs(_alerts(spark, sf_dir))


@query(_every_alert(True) + f" SELECT {_ALERT_JSON} AS value FROM alerts")
def alert_json(spark, sf_dir):
    """Lines of all rules' alerts, redacted."""
    return sinks.json_lines(sinks.redact(_alerts(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
