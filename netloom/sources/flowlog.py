"""Cloud flow logs, as text or JSON lines, to packets. All of it runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..functions import scalars as S
from ..operators.lookups import address_bits, is_host
from .decode import only_public

# Spellings of each field, the first present one counts.
FIELDS = {
    "src": ["srcaddr", "src_ip", "srcIp", "sourceIPAddress"],
    "dst": ["dstaddr", "dst_ip", "dstIp", "destinationIPAddress"],
    "sport": ["srcport", "src_port", "srcPort"],
    "dport": ["dstport", "dst_port", "dstPort"],
    "proto": ["protocol"],
    "start": ["start", "start_time", "startTime"],
}


def _port(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(0, 65535), n)


def parse(lines: DataFrame) -> DataFrame:
    """(src, dst, sport, dport, proto, start) of each usable line; other columns are carried."""
    text = {"src": 3, "dst": 4, "sport": 5, "dport": 6, "proto": 7, "start": 10}
    rest = [c for c in lines.columns if c != "value"]
    # each line is trimmed once, then cut or parsed once; a filter on what a generator gives is not pushed below it, where it would parse the line again
    trimmed = lines.select(*rest, net.stripped("value").alias("_line"))
    is_json = F.col("_line").startswith("{")
    spelt = F.from_json(F.when(is_json, F.col("_line")), "map<string, string>")  # some names differ by case only
    cut = trimmed.select(*rest, spelt.alias("_json"), F.when(~is_json & ~F.col("_line").startswith("version"), F.split("_line", r"\s+")).alias("_words"))
    told = lambda c: F.coalesce(*(F.col("_json")[n] for n in FIELDS[c]), F.get("_words", text[c])).alias(c)
    usable = F.col("_json").isNotNull() | (F.size("_words") >= 13)
    found = cut.select(*rest, F.explode(F.when(usable, F.array(F.struct(*map(told, text))))).alias("_flow")).select(*rest, "_flow.*")
    valid = lambda c: F.when(c.contains(":"), net.v6_bits(F.when(c.contains(":"), c)).isNotNull()).otherwise(net.v4_number(c).isNotNull())
    number = F.col("proto").try_cast("int")
    return found.where(valid(F.col("src")) & valid(F.col("dst"))).select(
        *rest, "src", "dst", _port(F.col("sport")).alias("sport"), _port(F.col("dport")).alias("dport"), F.when(number.between(0, 255), number).otherwise(0).alias("proto"), F.coalesce(F.col("start").try_cast("bigint"), F.lit(0)).alias("start")
    )


def packets(flows: DataFrame, hosts: list[str] = ()) -> DataFrame:
    """Flows as packets: a TCP flow counts as one new connection; flows carry no payload, DNS or ICMP data."""
    public = lambda c: F.when(F.col(c).contains(":"), net.is_public_v6(address_bits(F.when(F.col(c).contains(":"), F.col(c))))).otherwise(net.is_public_v4(net.v4_number(F.col(c))))
    way = net.flow_direction(is_host(F.col("src"), list(hosts)), is_host(F.col("dst"), list(hosts)), public("src"), public("dst"))
    df = flows.withColumn("direction", way).where("direction is not null")
    inbound = F.col("direction") == "inbound"
    nothing = lambda kind: F.lit(None).cast(kind)
    name = S.proto_name(F.col("proto"))
    df = df.select(
        "seq",
        (F.col("start") * 1_000_000_000).alias("ts_ns"),
        (F.col("start") * 1_000_000).alias("ts_us"),
        F.timestamp_seconds("start").alias("ts"),
        "direction",
        F.when(inbound, F.col("dst")).otherwise(F.col("src")).alias("local_ip"),
        F.when(inbound, F.col("src")).otherwise(F.col("dst")).alias("peer_ip"),
        F.col("src").alias("src_ip"),
        F.col("dst").alias("dst_ip"),
        name.alias("proto"),
        F.col("proto").alias("ip_proto"),
        F.col("sport").alias("src_port"),
        F.col("dport").alias("dst_port"),
        F.when(name == "tcp", S.SYN).alias("tcp_flags"),
        nothing("boolean").alias("icmp_echo"),
        nothing("string").alias("qname"),
        nothing("int").alias("qtype"),
        nothing("boolean").alias("dns_response"),
        F.lit(0).alias("payload_len"),
        F.lit(b"").alias("payload"),
        F.lit(0).alias("ip_total_len"),
        F.lit(False).alias("fragmented"),
        F.lit(True).alias("first_fragment"),
    )
    return only_public(df)


def read(spark: SparkSession, path: str, hosts: list[str] = ()) -> DataFrame:
    """Flow-log files as packets; seq follows files and lines."""
    return packets(parse(spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())), hosts)


def stream(spark: SparkSession, path: str, hosts: list[str] = ()) -> DataFrame:
    """The same from a folder into which files are dropped; seq is the flow's start in us, with a hash of file and line to tell flows of one second apart."""
    lines = spark.readStream.text(path)
    apart = F.pmod(F.xxhash64("_metadata.file_path", "value"), F.lit(1_000_000))
    return packets(parse(lines.withColumn("seq", apart)).withColumn("seq", F.col("start") * 1_000_000 + F.col("seq")), hosts)
