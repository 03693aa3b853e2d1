"""Alerts to JSON lines, ECS documents, block decisions, metrics text and webhooks."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions import rules as R
from ..functions import scalars as S

ECS_SEVERITY = {"low": 2, "medium": 3, "high": 5}
_JSON = [
    "id", "time", "rule", "severity", "direction", "peer_ip", "peer_asn", "peer_country", "local_ip", "proto", "ports", "detail", "mitre",
    "count", "window_s", "risk_score", "tactic", "tactic_name", "tags", "sensor", "schema_version",
]


def redact(alerts: DataFrame) -> DataFrame:
    """Local addresses with their last part blanked."""
    return alerts.withColumn("local_ip", net.mask_ip(F.col("local_ip")))


def json_lines(alerts: DataFrame) -> DataFrame:
    """One column `value`; an unknown place is left out, unknown ports are null."""
    df = alerts.withColumn("time", S.rfc3339(F.col("time")))
    ports = F.to_json("ports", {"ignoreNullFields": "false"})
    whole = F.to_json(F.struct(*(F.lit("@ports@").alias("ports") if c == "ports" else F.col(c) for c in _JSON)))
    return df.select(F.replace(whole, F.lit('"@ports@"'), ports).alias("value"))


def ecs(alerts: DataFrame, module: str = "netloom") -> DataFrame:
    """One column `value` of Elastic Common Schema documents; missing values are left out."""
    c = F.col
    inbound = c("direction") == "inbound"
    end = lambda ip, port: F.struct(ip.alias("ip"), port.alias("port"))
    peer, local = c("peer_ip"), c("local_ip")
    doc = F.struct(
        S.rfc3339(c("time")).alias("@timestamp"),
        F.struct(
            F.lit("alert").alias("kind"), F.lit("network").alias("category"), F.lit(module).alias("module"), R.pick(ECS_SEVERITY, c("severity")).alias("severity"),
            c("rule").alias("code"), c("rule").alias("action"), c("risk_score"),
        ).alias("event"),
        end(F.when(inbound, peer).otherwise(local), c("ports.src")).alias("source"),
        end(F.when(inbound, local).otherwise(peer), c("ports.dst")).alias("destination"),
        F.struct(c("proto").alias("transport"), c("direction")).alias("network"),
        F.struct(c("rule").alias("name"), F.concat(F.lit("https://attack.mitre.org/techniques/"), "mitre").alias("reference")).alias("rule"),
        F.struct(c("mitre").alias("technique_id"), c("tactic").alias("tactic_id"), c("tactic_name")).alias("mitre"),
        c("tags"),
        F.struct(c("mitre").alias("mitre_technique_id"), c("peer_country"), c("peer_asn")).alias("labels"),
        c("detail").alias("message"),
        F.struct(c("count"), c("window_s")).alias(module),
    )
    return alerts.select(F.to_json(doc).alias("value"))


def write_json(alerts: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """JSON lines in files of bounded length."""
    json_lines(alerts).write.mode("append").option("maxRecordsPerFile", rows_per_file).text(path)


def guarded(ip: Column, never: list[str]) -> Column:
    """Whether an address must not be blocked: metadata services, and what is listed."""
    cidrs = [*net.METADATA, *(c if "/" in c else c + ("/128" if ":" in c else "/32") for c in never)]
    v6 = ip.contains(":")
    bits = F.coalesce(net.v6_bits(F.when(v6, ip)), F.lit(""))
    return F.coalesce(net.in_v4(net.v4_number(ip), cidrs), F.lit(False)) | (v6 & net.in_v6(bits, cidrs))


def block_decisions(alerts: DataFrame, least: str = "high", never: list[str] = (), max_entries: int = 10_000) -> DataFrame:
    """(peer_ip, first_seq, rule): peers to block, each at its first alert severe enough, the first `max_entries` of them.

    Only decisions; nothing is blocked here.
    """
    severe = alerts.where(R.severity_order(F.col("severity")) >= R.SEVERITIES[least]).where(~guarded(F.col("peer_ip"), list(never)))
    first = severe.groupBy("peer_ip").agg(F.min(F.struct("seq", "rule_ord", "rule")).alias("f"))
    return first.select("peer_ip", F.col("f.seq").alias("first_seq"), F.col("f.rule").alias("rule")).orderBy("first_seq", "peer_ip").limit(max_entries)


def metrics_text(counters: dict[str, float], by_rule: dict[str, int], prefix: str = "netloom") -> str:
    """Counters in the Prometheus text format; every rule has a series."""
    lines = []
    for name, value in counters.items():
        kind = "gauge" if name.startswith(("tracked", "queue", "feed", "signatures")) else "counter"
        lines += [f"# TYPE {prefix}_{name} {kind}", f"{prefix}_{name} {value:g}"]
    lines.append(f"# TYPE {prefix}_alerts_by_rule_total counter")
    lines += [f'{prefix}_alerts_by_rule_total{{rule="{r.name}"}} {by_rule.get(r.name, 0)}' for r in R.RULES]
    return "\n".join(lines) + "\n"


def webhook(url: str, token: str | None = None, tries: int = 3, wait_s: float = 0.5, send: Callable | None = None):
    """A function for foreachBatch that posts a batch's alerts from the executors, with growing waits between tries.

    Its `totals` count the alerts delivered, and those given up after all tries.
    """

    def post(body: bytes) -> None:
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
        urllib.request.urlopen(request, timeout=10).close()

    deliver = send or post
    totals = {"delivered": 0, "failed": 0}

    def partition(batches):
        delivered = failed = 0
        for batch in batches:
            for value in batch["value"]:
                for attempt in range(tries):
                    try:
                        deliver(value.encode())
                        delivered += 1
                        break
                    except OSError:
                        if attempt + 1 < tries:
                            time.sleep(wait_s * 2**attempt)
                else:
                    failed += 1
        yield pd.DataFrame({"delivered": [delivered], "failed": [failed]})

    def batch(alerts: DataFrame, batch_id: int) -> None:
        found = json_lines(alerts).mapInPandas(partition, "delivered long, failed long").agg(F.sum("delivered"), F.sum("failed")).first()
        totals["delivered"] += found[0] or 0
        totals["failed"] += found[1] or 0

    batch.totals = totals
    return batch


def run_state(counters: dict, path: str, spark) -> None:
    """A run's counters as one JSON line."""
    spark.createDataFrame([(json.dumps(counters, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
