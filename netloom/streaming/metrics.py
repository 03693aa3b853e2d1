"""Counters of a run, observed while it runs: no table is read again for them.

`watch_raw`, `watch_packets` and `watch_alerts` put named observations into a
plan, batch or stream.  `RunMetrics` gathers what streams observe and what
Spark says of their state; a batch gives its observations to `add`.
"""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import rules as R
from ..sinks.alerts import metrics_text

RAW, PACKETS, ALERTS = "netloom_raw", "netloom_packets", "netloom_alerts"


def _named(name: str, observation: Observation | None):
    return observation if observation is not None else name


def watch_raw(raw: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Frames, their bytes, and those that could not be decoded."""
    return raw.observe(_named(RAW, observation), F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum("frame_len"), F.lit(0)).alias("bytes"), F.count("error").alias("parse_errors"))


def watch_packets(packets: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Packets of a host with a public peer, by direction."""
    ways = [F.count_if(F.col("direction") == way).alias(way) for way in ("inbound", "outbound")]
    return packets.observe(_named(PACKETS, observation), F.count(F.lit(1)).alias("packets"), *ways)


def watch_alerts(alerts: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Alerts of each rule."""
    return alerts.observe(_named(ALERTS, observation), F.count(F.lit(1)).alias("alerts"), *[F.count_if(F.col("rule") == r.name).alias(r.name) for r in R.RULES])


class RunMetrics(StreamingQueryListener):
    """Sums of what was observed, with the newest state of each stream's operators.

    Give it to spark.streams.addListener.  Each stream's batch counts once: a
    batch that is told again, as after a restart, replaces what it told before.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._last: dict[str, tuple[int, Counter]] = {}
        self._done: Counter = Counter()
        self._state: dict[str, dict[str, int]] = {}

    def add(self, observed: dict[str, int]) -> None:
        """Counts what one observation of a batch job has found."""
        with self._lock:
            self._done.update(observed)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found: Counter = Counter()
        for name in (RAW, PACKETS, ALERTS):
            if (row := p.observedMetrics.get(name)) is not None:
                found.update({k: v for k, v in row.asDict().items() if v is not None})
        state = {"tracked_keys": sum(s.numRowsTotal for s in p.stateOperators), "tracked_bytes": sum(s.memoryUsedBytes for s in p.stateOperators), "late_rows_dropped": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)}
        self.told(str(p.id), p.batchId, found, state)

    def told(self, query: str, batch: int, found: Counter, state: dict[str, int]) -> None:
        with self._lock:
            last = self._last.get(query)
            if last is not None and last[0] != batch:
                self._done.update(last[1])
            # an idle trigger tells of the same batch number, or of the next one with nothing in it
            self._last[query] = (batch, found if found or last is None or last[0] != batch else last[1])
            self._state[query] = state

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._state.pop(str(event.id), None)

    def counters(self) -> dict[str, int]:
        """Everything told so far, with what was skipped: frames that are neither errors nor packets of a host."""
        with self._lock:
            out = Counter(self._done)
            for _, found in self._last.values():
                out.update(found)
            for state in self._state.values():
                out.update(state)
        for name in ("frames", "bytes", "parse_errors", "packets", "alerts", "tracked_keys"):
            out.setdefault(name, 0)
        out["skipped"] = out["frames"] - out["parse_errors"] - out["packets"] if out["frames"] else 0
        return dict(out)

    def text(self, **gauges: float) -> str:
        """The metrics text of the counters, the alerts of each rule and more gauges such as the size of a feed."""
        told = self.counters()
        by_rule = {r.name: told.pop(r.name, 0) for r in R.RULES}
        return metrics_text(dict(sorted(told.items())) | gauges, by_rule)
