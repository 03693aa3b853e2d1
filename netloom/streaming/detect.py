"""Detectors over a stream of packets: the batch machines as keyed state.

State lives in a RocksDB store per key and goes after `ttl_s` without events,
which must be at least the window and the cooldown: no live key is ever lost.
Within a batch a key's events are handled in order of seq.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import detectors, kernels
from ..plans.config import RulesCfg


def configure(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Keyed(StatefulProcessor):
    def __init__(self, fold: detectors.Fold, ttl_s: int):
        self.fold, self.fresh, self.ttl_s = fold, pickle.dumps(fold.machine), ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "value binary", self.ttl_s * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        machine = pickle.loads(held[0] if held is not None else self.fresh)
        frame = pd.concat(list(rows)).sort_values("seq")
        frame = frame.astype(object).where(frame.notna(), None)
        out = []
        for e in map(detectors.Event._make, frame[list(kernels.FIELDS)].itertuples(index=False, name=None)):
            if found := machine.on(e):
                out.append(detectors.drafted(e, self.fold, found))
        self.state.update((pickle.dumps(machine),))
        if out:
            yield pd.DataFrame(out, columns=detectors._DRAFTED).astype({"seq": "int64", "ts_us": "int64", "src_port": "Int32", "dst_port": "Int32", "sig_ord": "int32"})

    def close(self) -> None:
        pass


def keyed(packets: DataFrame, fold: detectors.Fold) -> DataFrame:
    """The drafts of one machine over a stream of the packets that its rule looks at."""
    df = packets.select(F.to_json(F.struct(*fold.keys)).alias("_key"), *detectors.fields_of(packets))
    ttl_s = 2 * max(getattr(fold.section, "window_s", 0), fold.section.cooldown_s)
    return df.groupBy("_key").transformWithStateInPandas(Keyed(fold, ttl_s), detectors.DRAFT, "Append", "ProcessingTime")


def every(p: DataFrame, cfg: RulesCfg, listening: list[int] | None = None, intel: DataFrame | None = None) -> dict[str, DataFrame]:
    """A stream of drafts for each enabled rule.

    Threat intelligence is a stream-static prefix join ahead of the cooldown;
    its prefix table must be one that is broadcast.  Signatures are matched
    ahead of the cooldown of each peer and signature, which also holds how many
    have been told.
    """
    ready = detectors.folding(p)
    once = lambda rule, section, *keys: detectors.Fold(rule, section, keys, kernels.Once(section))
    folds = [*detectors.resetting(cfg, listening), *detectors.counting(cfg)]
    out = {f.rule: keyed(ready.where(detectors.guard(f.rule, f.section, listening)), f) for f in folds}
    if cfg.suspicious_port.enabled:
        seen = p.where(detectors.guard("suspicious-port", cfg.suspicious_port)).withColumn("label", detectors._backdoor_detail(cfg.suspicious_port))
        out["suspicious-port"] = keyed(seen, once("suspicious-port", cfg.suspicious_port, "peer_ip"))
    if cfg.threat_intel.enabled and intel is not None:
        listed = detectors.with_intel(p, intel).where("_listed is not null").withColumn("label", detectors.intel_detail())
        out["threat-intel-hit"] = keyed(listed, once("threat-intel-hit", cfg.threat_intel, "peer_ip"))
    if cfg.custom_signature.enabled and cfg.signature:
        hits = detectors.exploded_signatures(detectors.with_signatures(p, cfg.custom_signature, cfg.signature))
        told = hits.withColumns({"label": detectors.signature_detail(), "severity": F.col("sig.severity"), "sig_ord": F.col("sig.ord")})
        out["custom-signature"] = keyed(told, once("custom-signature", cfg.custom_signature, "peer_ip", "sig_name"))
    return out
