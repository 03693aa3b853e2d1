"""Many signatures at once: one automaton over all contents, and a table of ports ahead of the rest.

A packet's candidates are the signatures whose content occurs in its payload,
those without content that name one of its ports, and the few that name
neither.  Only candidates have their conditions looked at, so the cost of a
packet goes with its length and its candidates, not with the number of
signatures, and the plan has one expression whatever that is.
"""

from __future__ import annotations

import ipaddress
import pickle
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import SignatureCfg

#: Up to so many signatures are column expressions of their own, which stay in the JVM.
FEW = 64
SIGS = "array<struct<ord: int, name: string, label: string, severity: string>>"
_UPPER = {i: i + 32 for i in range(65, 91)}  # ASCII letters only


class Index:
    """Signatures by content, by port, and the rest; picklable, so that it goes to every task."""

    def __init__(self, signatures: list[SignatureCfg]):
        from ..plans.snort import decode_content

        self.rows = [(s.protocol if s.protocol in ("tcp", "udp", "icmp") else None, s.direction + "bound" if s.direction in ("in", "out") else None, frozenset(s.ports), _ranges(s.peer_cidr)) for s in signatures]
        self.windows: list[tuple[int, int | None]] = [(s.offset or 0, s.depth) for s in signatures]
        self.by_port: dict[int, list[int]] = {}
        self.rest: list[int] = []
        contents: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
        for i, s in enumerate(signatures):
            if s.content is not None:
                text = decode_content(s.content).decode("latin-1")
                if text:  # no bytes never occur
                    contents[bool(s.nocase)].setdefault(text.translate(_UPPER) if s.nocase else text, []).append(i)
            elif s.ports:
                for port in set(s.ports):
                    self.by_port.setdefault(port, []).append(i)
            else:
                self.rest.append(i)
        self.automata = []
        for needles in contents:
            automaton = ahocorasick.Automaton()
            for text, ids in needles.items():
                automaton.add_word(text, (len(text), ids))
            if needles:
                automaton.make_automaton()
            self.automata.append(automaton if needles else None)

    def _in_payload(self, payload: bytes | None) -> set[int]:
        found: set[int] = set()
        if payload:
            plain = payload.decode("latin-1")
            for automaton, text in zip(self.automata, (plain, plain.translate(_UPPER) if self.automata[1] else "")):
                if automaton is not None:
                    for last, (length, ids) in automaton.iter(text):
                        begin, end = last + 1 - length, last + 1
                        for i in ids:
                            offset, depth = self.windows[i]
                            if begin >= offset and (depth is None or end <= offset + depth):
                                found.add(i)
        return found

    def match(self, proto, direction, src_port, dst_port, peer_ip, payload) -> list[int]:
        """Numbers of the signatures that a packet matches, in order."""
        candidates = self._in_payload(payload)
        candidates.update(self.by_port.get(src_port, ()), self.by_port.get(dst_port, ()), self.rest)
        address = None
        out = []
        for i in sorted(candidates):
            wanted_proto, wanted_way, ports, ranges = self.rows[i]
            if wanted_proto not in (None, proto) or wanted_way not in (None, direction) or ports and src_port not in ports and dst_port not in ports:
                continue
            if ranges is not None:
                address = address or _address(peer_ip)
                starts, ends = ranges
                at = bisect_right(starts, address) - 1
                if at < 0 or ends[at] < address:
                    continue
            out.append(i)
        return out


def _address(ip: str | None) -> tuple[int, int]:
    try:
        parsed = ipaddress.ip_address(ip or "")
        return parsed.version, int(parsed)
    except ValueError:
        return 0, 0


def _ranges(cidrs: list[str]) -> tuple[list, list] | None:
    """Disjoint sorted ranges (version, number) of networks; None if there are none."""
    if not cidrs:
        return None
    nets = [ipaddress.ip_network(c, strict=False) for c in cidrs]
    merged = [n for v in (4, 6) for n in ipaddress.collapse_addresses(x for x in nets if x.version == v)]
    return [(n.version, int(n.network_address)) for n in merged], [(n.version, int(n.broadcast_address)) for n in merged]


def matched(p: DataFrame, cfg, signatures: list[SignatureCfg]) -> DataFrame:
    """p with `_sigs`: (ord, name, label, severity) of each signature that a packet matches."""
    made = pickle.dumps((Index(signatures), [(i, s.name, s.label, s.severity or cfg.severity) for i, s in enumerate(signatures)]))
    shared = p.sparkSession.sparkContext.broadcast(made)  # a stated rule set, not data
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("name", pa.string()), ("label", pa.string()), ("severity", pa.string())]))
    loaded: dict[str, tuple] = {}

    @F.arrow_udf(SIGS)
    def match(proto: pa.Array, direction: pa.Array, src_port: pa.Array, dst_port: pa.Array, peer_ip: pa.Array, payload: pa.Array) -> pa.Array:
        if not loaded:
            loaded["index"] = pickle.loads(shared.value)
        index, told = loaded["index"]
        columns = (c.to_pylist() for c in (proto, direction, src_port, dst_port, peer_ip, payload))
        return pa.array([[dict(zip(("ord", "name", "label", "severity"), told[i])) for i in index.match(*row)] for row in zip(*columns)], kind)

    return p.withColumn("_sigs", match("proto", "direction", "src_port", "dst_port", "peer_ip", "payload"))
