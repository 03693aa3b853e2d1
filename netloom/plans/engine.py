"""From packets to finished alerts: allowlist, detectors, geography, risk, order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from ..operators import detectors, lookups
from .config import RulesCfg


@dataclass
class Engine:
    """`intel` and `geo` are prefix tables (lookups.PREFIXES; geo with asn and country instead of source)."""

    rules: RulesCfg = field(default_factory=RulesCfg)
    allowlist: list[str] = field(default_factory=list)
    intel: DataFrame | None = None
    geo: DataFrame | None = None
    listening: list[int] = field(default_factory=list)
    sensor: str = "netloom"
    ordered: bool = True

    def drafts(self, packets: DataFrame) -> DataFrame:
        """Drafts of every enabled rule; the packets are read once."""
        found = detectors.drafts(lookups.without_prefixes(packets, self.allowlist), self.rules, self.intel, self.listening, self.ordered)
        return packets.sparkSession.createDataFrame([], detectors.DRAFT) if found is None else found

    def detect(self, packets: DataFrame) -> DataFrame:
        return self.finish(self.drafts(packets))

    def finish(self, drafts: DataFrame) -> DataFrame:
        """Alerts with identity, rule data, risk and, if there is a geo table, the peer's place."""
        out = drafts.join(F.broadcast(R.catalog(drafts.sparkSession)), "rule")
        out = out.withColumn("id", S.alert_id(F.col("seq"), F.col("rule"), F.col("sig_ord"), F.col("peer_ip")))
        if self.geo is not None:
            out = lookups.longest_prefix(out, self.geo, "peer_ip", ["asn", "country"], "id", "left")
        else:
            out = out.withColumns({"asn": F.lit(None).cast("long"), "country": F.lit(None).cast("string")})
        return out.select(
            "id",
            F.timestamp_micros("ts_us").alias("time"),
            "rule",
            "severity",
            "direction",
            "peer_ip",
            F.col("asn").alias("peer_asn"),
            F.col("country").alias("peer_country"),
            "local_ip",
            "proto",
            F.struct(F.col("src_port").alias("src"), F.col("dst_port").alias("dst")).alias("ports"),
            "detail",
            "mitre",
            "count",
            "window_s",
            R.risk_score(F.col("weight"), F.col("severity"), F.col("count")).alias("risk_score"),
            "tactic",
            "tactic_name",
            "tags",
            F.lit(self.sensor).alias("sensor"),
            F.lit(1).alias("schema_version"),
            "seq",
            "rule_ord",
            "sig_ord",
        )

    @staticmethod
    def in_order(alerts: DataFrame) -> DataFrame:
        """By event, then rule, then signature: the order in which one host would have told them."""
        return alerts.orderBy("seq", "rule_ord", "sig_ord")


def alerts_by_rule(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("rule").agg(F.count("*").alias("alerts"))
