"""Side inputs: blocklist feeds, listening ports, resolvers, and configuration files of the host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators import lookups


def tokens(lines: DataFrame) -> DataFrame:
    """The first word of each line before a comment."""
    word = F.regexp_extract(F.split("value", "#")[0], r"\S+", 0)
    return lines.select("*", word.alias("token")).where("token <> ''")


def _fields(token):
    """Family, prefix length and bits of a token; null parts where it is no prefix."""
    address, length = F.split(token, "/")[0], F.get(F.split(token, "/"), 1)
    v6 = address.contains(":")
    bits = lookups.address_bits(address)
    n = F.when(length.isNull(), F.length(bits)).otherwise(F.when(length.rlike("^[0-9]{1,3}$"), length.cast("int")))
    good = bits.isNotNull() & n.between(0, F.length(bits)) & (F.size(F.split(token, "/")) <= 2)
    return F.when(good, F.struct(F.when(v6, 6).otherwise(4).alias("family"), n.alias("prefix_len"), F.substring(bits, F.lit(1), n).alias("prefix_bits")))


def parse_feed(lines: DataFrame, source: str) -> DataFrame:
    """Prefixes of a feed's lines, host bits dropped; lines that are none are left out."""
    found = tokens(lines).select(_fields(F.col("token")).alias("p")).where("p is not null").select("p.*").distinct()
    return found.withColumn("source", F.lit(source))


def feed_stats(lines: DataFrame) -> DataFrame:
    ok = _fields(F.col("token")).isNotNull()
    return tokens(lines).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def load_feeds(spark: SparkSession, paths: dict[str, str], last_good: DataFrame | None = None) -> DataFrame:
    """All feeds as one prefix table; if it is empty, the last good one stays."""
    feeds = [parse_feed(spark.read.text(path), source) for source, path in paths.items()]
    merged = lookups.merge_prefixes(feeds) if feeds else None
    return last_good if last_good is not None and (merged is None or merged.isEmpty()) else merged


def listening_ports(lines: DataFrame) -> DataFrame:
    """Ports in state LISTEN of /proc/net/tcp and tcp6 lines."""
    words = F.split(net.stripped("value"), r"\s+")
    port = F.conv(F.element_at(F.split(F.get(words, 1), ":"), -1), 16, 10).cast("int")
    return lines.where(F.get(words, 3) == "0A").select(port.alias("port")).distinct()


def resolvers(lines: DataFrame) -> DataFrame:
    """Addresses of resolv.conf's nameserver lines."""
    words = F.split(net.stripped("value"), r"\s+")
    return lines.where(F.get(words, 0) == "nameserver").select(F.get(words, 1).alias("ip")).where(net.v4_number(F.col("ip")).isNotNull() | F.col("ip").contains(":")).distinct()
