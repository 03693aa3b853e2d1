"""The fourteen rules: names, order, MITRE ATT&CK data, tags and weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    mitre: str
    tactic: str
    tags: tuple[str, ...]
    weight: int
    level: str


# Technique, tactic, tags, base weight and Sigma level of each rule, in registry order.
RULES = (
    Rule("port-scan", "T1046", "TA0007", ("recon", "scan", "discovery"), 25, "medium"),
    Rule("invalid-tcp-flags", "T1046", "TA0007", ("recon", "scan", "evasion"), 25, "medium"),
    Rule("brute-force", "T1110", "TA0006", ("credential-access", "brute-force"), 40, "high"),
    Rule("syn-flood", "T1498.001", "TA0040", ("dos", "flood", "availability"), 50, "critical"),
    Rule("udp-flood", "T1498", "TA0040", ("dos", "flood", "availability"), 38, "high"),
    Rule("icmp-flood", "T1498", "TA0040", ("dos", "flood", "availability"), 38, "high"),
    Rule("reflection-amplification", "T1498.002", "TA0040", ("dos", "amplification", "availability"), 50, "critical"),
    Rule("dns-tunnel", "T1071.004", "TA0011", ("exfiltration", "c2", "dns"), 45, "medium"),
    Rule("icmp-tunnel", "T1095", "TA0011", ("tunneling", "c2", "icmp"), 45, "medium"),
    Rule("beaconing", "T1071", "TA0011", ("c2", "beaconing"), 45, "critical"),
    Rule("threat-intel-hit", "T1071", "TA0011", ("threat-intel", "known-bad"), 55, "critical"),
    Rule("suspicious-port", "T1571", "TA0011", ("c2", "backdoor"), 30, "low"),
    Rule("new-listener-probe", "T1595", "TA0043", ("recon", "fingerprinting"), 18, "low"),
    Rule("custom-signature", "T1071", "TA0011", ("custom", "signature"), 35, "medium"),
)
TACTICS = {
    "TA0006": "Credential Access",
    "TA0007": "Discovery",
    "TA0011": "Command and Control",
    "TA0040": "Impact",
    "TA0043": "Reconnaissance",
}
SEVERITIES = {"low": 0, "medium": 1, "high": 2}
SEVERITY_POINTS = {"low": 8, "medium": 18, "high": 30}

BY_NAME = {r.name: r for r in RULES}
ORDER = {r.name: i for i, r in enumerate(RULES)}


def catalog(spark: SparkSession) -> DataFrame:
    """The rules as a table of fourteen rows."""
    rows = [(r.name, i, r.mitre, r.tactic, TACTICS[r.tactic], list(r.tags), r.weight, r.level) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule string, rule_ord int, mitre string, tactic string, tactic_name string, tags array<string>, weight int, level string")


def pick(values: dict, by: Column, otherwise=None) -> Column:
    """The value of `values` at the column's key."""
    out = F.lit(otherwise)
    for key, value in values.items():
        out = F.when(by == key, F.lit(value)).otherwise(out)
    return out


def severity_points(severity: Column) -> Column:
    return pick(SEVERITY_POINTS, severity, 0)


def severity_order(severity: Column) -> Column:
    return pick(SEVERITIES, severity, -1)


def risk_score(weight: Column, severity: Column, count: Column) -> Column:
    """Weight and severity points plus the logarithm of the volume, at most 100."""
    volume = F.floor(F.least(F.log1p(count.cast("double")) * 6, F.lit(20.0)))
    return F.least(weight + severity_points(severity) + volume, F.lit(100)).cast("int")
