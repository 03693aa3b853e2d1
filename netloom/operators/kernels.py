"""State machines of the detectors: one object per key, fed with events in arrival order.

`on` takes an event (a named tuple with seq, ts_us and the fields of FIELDS)
and returns None or (detail, count).  The objects pickle, so the same machine
serves a batch fold and streaming state.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

#: Columns that machines read, beside the key.
FIELDS = ("seq", "ts_us", "direction", "peer_ip", "local_ip", "src_ip", "dst_ip", "proto", "src_port", "dst_port", "tcp_flags", "qname", "qtype", "payload_len", "label", "severity", "sig_ord")
SECOND = 1_000_000


@dataclass
class Machine:
    cfg: object
    last: int | None = None

    def allow(self, now: int) -> bool:
        if self.last is not None and 0 <= now - self.last < self.cfg.cooldown_s * SECOND:
            return False
        self.last = now
        return True

    def cutoff(self, now: int) -> int:
        return max(0, now - self.cfg.window_s * SECOND)


def _bump(times: deque, now: int, cutoff: int) -> int:
    times.append(now)
    return _prune(times, cutoff)


def _prune(times: deque, cutoff: int) -> int:
    while times and times[0] <= cutoff:
        times.popleft()
    return len(times)


@dataclass
class Recent(Machine):
    """Machines that hold when each of several things was last seen."""

    seen: dict = field(default_factory=dict)
    turned: bool = False

    def renew(self, key, now: int) -> int:
        """Notes the key, forgets what is older than the window; how many are left.

        The latest stand last, so the oldest are at the front and each is
        forgotten once; only after a clock has run backwards are all looked at.
        """
        seen, cutoff = self.seen, self.cutoff(now)
        self.turned = bool(seen) and (self.turned or now < seen[next(reversed(seen))])
        seen.pop(key, None)
        seen[key] = now
        if self.turned:
            for k in [k for k, t in seen.items() if t <= cutoff]:
                del seen[k]
        while seen and seen[first := next(iter(seen))] <= cutoff:
            del seen[first]
        return len(seen)


@dataclass
class Count(Machine):
    """So many events in the window: flags, floods, ICMP tunnels, what reflection leaves."""

    times: deque = field(default_factory=deque)
    text: str = "{label}: {count} in {window}s"

    def on(self, e):
        count = _bump(self.times, e.ts_us, self.cutoff(e.ts_us))
        if count >= self.cfg.threshold and self.allow(e.ts_us):
            return self.text.format(label=e.label, count=count, window=self.cfg.window_s, dst=e.dst_ip, sport=e.src_port, cfg=self.cfg), count


@dataclass
class PortScan(Recent):
    def on(self, e):
        least = self.cfg.min_targets
        n = self.renew((e.dst_ip, e.dst_port), e.ts_us)
        if n < least:
            return None
        hosts, ports = len({h for h, _ in self.seen}), len({p for _, p in self.seen})
        kind = ("horizontal+vertical" if ports >= least else "horizontal") if hosts >= least else "vertical"
        self.seen = {}  # even when the cooldown denies
        if self.allow(e.ts_us):
            return f"{kind} scan: {n} targets across {hosts} hosts / {ports} ports in {self.cfg.window_s}s", n


@dataclass
class BruteForce(Machine):
    times: deque = field(default_factory=deque)
    ports: set = field(default_factory=set)

    def on(self, e):
        count = _bump(self.times, e.ts_us, self.cutoff(e.ts_us))
        self.ports.add(e.dst_port)
        if count >= self.cfg.threshold and self.allow(e.ts_us):
            ordered = sorted(self.ports)
            listed = ",".join(map(str, ordered[:10])) + (f",+{len(ordered) - 10}" if len(ordered) > 10 else "")
            self.times, self.ports = deque(), set()
            return f"brute force: {count} new connections to auth ports [{listed}] in {self.cfg.window_s}s", count


@dataclass
class SynFlood(Machine):
    syns: deque = field(default_factory=deque)
    answers: deque = field(default_factory=deque)

    def on(self, e):
        cutoff = self.cutoff(e.ts_us)
        if e.direction == "outbound":
            _bump(self.answers, e.ts_us, cutoff)
            return None
        syns, answers = _bump(self.syns, e.ts_us, cutoff), _prune(self.answers, cutoff)
        ratio = answers / syns if syns else 1.0
        if syns >= self.cfg.threshold and ratio < self.cfg.max_completion_ratio and self.allow(e.ts_us):
            return f"SYN flood on {e.dst_ip}:{e.dst_port}: {syns} SYNs, {answers} SYN-ACKs, completion ratio {ratio:.2f} in {self.cfg.window_s}s", syns


@dataclass
class Reflection(Machine):
    asked: dict = field(default_factory=dict)
    times: deque = field(default_factory=deque)

    def on(self, e):
        if e.direction == "outbound":
            self.asked[e.dst_port] = e.ts_us
            return None
        asked = self.asked.get(e.src_port)
        if asked is not None and 0 <= e.ts_us - asked <= self.cfg.window_s * SECOND or e.payload_len < self.cfg.min_response_bytes:
            return None
        count = _bump(self.times, e.ts_us, self.cutoff(e.ts_us))
        if count >= self.cfg.threshold and self.allow(e.ts_us):
            return f"reflection/amplification: {count} unsolicited {e.src_port}-source responses >= {self.cfg.min_response_bytes}B in {self.cfg.window_s}s", count


def entropy(text: str) -> float:
    raw = text.encode()
    return -sum(n / len(raw) * math.log2(n / len(raw)) for n in (raw.count(b) for b in set(raw))) if raw else 0.0


@dataclass
class DnsTunnel(Machine):
    """The deques are pruned only when something is added, so old counts keep firing on later harmless names."""

    odd: deque = field(default_factory=deque)
    text: deque = field(default_factory=deque)
    names: set = field(default_factory=set)

    def on(self, e):
        cfg, cutoff = self.cfg, self.cutoff(e.ts_us)
        bits = entropy(e.qname)
        if bits >= cfg.entropy_threshold or len(e.qname) >= cfg.qname_len_threshold or max(map(len, e.qname.split("."))) >= cfg.label_len_threshold:
            _bump(self.odd, e.ts_us, cutoff)
        if e.qtype in (10, 16):
            _bump(self.text, e.ts_us, cutoff)
        self.names.add(e.qname)
        unique = len(self.names)
        if unique >= cfg.subdomain_threshold:
            self.names = set()  # before the cooldown has its say
        if len(self.text) >= cfg.txt_threshold:
            reason = f"high TXT/NULL volume: {len(self.text)} queries"
        elif unique >= cfg.subdomain_threshold:
            reason = f"many unique subdomains: {unique}"
        elif len(self.odd) >= 5:
            reason = f"{len(self.odd)} high-entropy/long qnames (last entropy {bits:.1f})"
        else:
            return None
        if self.allow(e.ts_us):
            return f"possible DNS tunnel: {reason} in {cfg.window_s}s", 0


def variation(times) -> tuple[float, float] | None:
    """(coefficient of variation, mean) of the gaps, negative ones as 0; None under three samples or without a mean."""
    times = list(times)
    if len(times) < 3:
        return None
    gaps = [max(0, b - a) / SECOND for a, b in zip(times, times[1:])]
    mean = sum(gaps) / len(gaps)
    if mean <= 0:
        return None
    return math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) / mean, mean


@dataclass
class Beaconing(Machine):
    times: deque = field(default_factory=deque)

    def on(self, e):
        cfg = self.cfg
        self.times.append(e.ts_us)
        while len(self.times) > cfg.max_samples:
            self.times.popleft()
        n = _prune(self.times, self.cutoff(e.ts_us))
        found = variation(self.times) if n >= cfg.min_samples else None
        if found and found[0] <= cfg.max_jitter_cv and self.allow(e.ts_us):
            self.times = deque()
            return f"beaconing to {e.peer_ip}: {n} connections, mean interval {found[1]:.1f}s, jitter CV {found[0]:.3f} (<= {cfg.max_jitter_cv:g})", n


@dataclass
class NewListener(Recent):
    def on(self, e):
        n = self.renew(e.peer_ip, e.ts_us)
        if n >= self.cfg.min_sources and self.allow(e.ts_us):
            self.seen = {}
            return f"{n} distinct sources probing un-listened port {e.dst_port} in {self.cfg.window_s}s", n


@dataclass
class Once(Machine):
    """Every event is a hit; `label` says why."""

    emitted: int = 0

    def on(self, e):
        most = getattr(self.cfg, "suppress_after", None)
        if most is not None and self.emitted >= most:
            return None
        if self.allow(e.ts_us):
            self.emitted += 1
            return e.label, 1
