"""Lookup joins: longest-prefix match, address lists, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net

PREFIXES = "family int, prefix_len int, prefix_bits string, source string"
#: Prefix tables of up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, MANY_LENGTHS = 200_000, 40


def prefixes(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    """A table of (cidr or address, source); entries that are neither are left out, the last source of a prefix stays."""
    rows = {}
    for token, source in entries:
        if (p := net.parse_prefix(token)) is not None:
            rows[p] = source
    return spark.createDataFrame([(*p, s) for p, s in rows.items()], PREFIXES)


def merge_prefixes(feeds: list[DataFrame]) -> DataFrame:
    """One table of several; where feeds share a prefix, the last one names it."""
    union = feeds[0].withColumn("feed", F.lit(0))
    for i, f in enumerate(feeds[1:], 1):
        union = union.unionByName(f.withColumn("feed", F.lit(i)))
    return union.groupBy("family", "prefix_len", "prefix_bits").agg(F.max_by("source", "feed").alias("source"))


def address_bits(ip) -> F.Column:
    """Bits of an address; IPv4 stays in the JVM."""
    number = net.v4_number(ip)
    v4 = F.lpad(F.bin(number), 32, "0")
    return F.when(ip.contains(":"), net.v6_bits(F.when(ip.contains(":"), ip))).otherwise(v4)


def longest_prefix(df: DataFrame, table: DataFrame, ip: str, columns: list[str], key: str = "seq", how: str = "inner") -> DataFrame:
    """The columns, and prefix_len, of the longest prefix of `table` that holds each row's address.

    A table of up to BROADCAST_ROWS prefixes in up to MANY_LENGTHS lengths is
    a chain of broadcast equi-joins, one for each length, without a shuffle.  A
    larger one is one equi-join for which a row asks for as many prefixes as
    there are lengths, at most 33 and 129; `key` tells the rows apart there.
    `how` is inner or left.
    """
    found = table.groupBy("family", "prefix_len").count().collect()  # at most 162 rows
    if sum(r["count"] for r in found) <= BROADCAST_ROWS and len(found) <= MANY_LENGTHS:
        out = df.withColumn("_bits", address_bits(F.col(ip)))
        longest = sorted(((r.prefix_len, r.family) for r in found), reverse=True)
        for i, (n, family) in enumerate(longest):
            side = table.where((F.col("family") == family) & (F.col("prefix_len") == n))
            side = F.broadcast(side.select(F.col("prefix_bits").alias(f"_prefix{i}"), F.struct(*columns, "prefix_len").alias(f"_hit{i}")))
            head = F.when(F.length("_bits") == (32 if family == 4 else 128), F.substring("_bits", 1, n))
            out = out.join(side, head == F.col(f"_prefix{i}"), "left")
        kept = [F.col(c) for c in df.columns]
        if not longest:
            kinds = dict(table.dtypes)
            out = out.select(*kept, *(F.lit(None).cast(kinds[c]).alias(c) for c in [*columns, "prefix_len"]))
        else:
            hit = F.coalesce(*(F.col(f"_hit{i}") for i in range(len(longest))))
            out = out.select(*kept, hit.alias("_hit")).select(*kept, *(F.col(f"_hit.{c}").alias(c) for c in [*columns, "prefix_len"]))
        return out if how == "left" else out.where("prefix_len is not null")
    lengths = {v: sorted(r.prefix_len for r in found if r.family == v) for v in (4, 6)}
    family = F.when(F.col(ip).contains(":"), 6).otherwise(4)
    asked = F.when(family == 6, F.lit(lengths[6] or [-1])).otherwise(F.lit(lengths[4] or [-1]))
    asks = (
        df.select(key, ip)
        .withColumn("_bits", address_bits(F.col(ip)))
        .withColumn("family", family)
        .select(key, "family", "_bits", F.explode(asked).alias("prefix_len"))
        .where("prefix_len >= 0")
        .withColumn("prefix_bits", F.expr("left(_bits, prefix_len)"))
    )
    best = asks.join(table, ["family", "prefix_len", "prefix_bits"]).groupBy(key).agg(*(F.max_by(c, "prefix_len").alias(c) for c in columns), F.max("prefix_len").alias("prefix_len"))
    return df.join(best, key, how)


def without_prefixes(df: DataFrame, cidrs: list[str], ip: str = "peer_ip") -> DataFrame:
    """Rows whose address is in none of the prefixes: an allowlist is a predicate, pushed to the scan."""
    if not cidrs:
        return df
    hit = net.in_v4(F.coalesce(net.v4_number(F.col(ip)), F.lit(-1)), cidrs)
    if any(":" in c for c in cidrs):
        hit = hit | (F.col(ip).contains(":") & net.in_v6(F.coalesce(address_bits(F.col(ip)), F.lit("")), cidrs))
    return df.where(~hit)


def is_host(ip, hosts: list[str]):
    return ip.isin(hosts) if hosts else F.lit(False)
