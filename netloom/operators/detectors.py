"""The fourteen detectors: packets in, alert drafts out.

Rules that only count are windows over time chunks; what they find goes through
one cooldown for all rules.  Rules that reset what they have counted are state
machines, folded over each key in arrival order.  With ordered=False the
counting rules are machines, too, which is exact when a key's time runs
backwards in arrival order.

`drafts` runs all rules in one pass: each packet gets a mask of the rules whose
guard it meets, packets without any go, and what is left, without payloads, is
the only thing that rules read.  All machines share one shuffle, in which a
packet goes once for each kind of key that wants it.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions import rules as R
from ..functions import scalars as S
from ..plans.config import RulesCfg, SignatureCfg
from . import kernels, lookups, signature_index
from .kernels import SECOND
from .order import kept
from .windows import cooldown, counts_at_arrival, last_before, suppress_after, with_halo

DRAFT = "seq long, ts_us long, direction string, peer_ip string, local_ip string, proto string, src_port int, dst_port int, rule string, severity string, detail string, count long, window_s long, sig_ord int"
_EVENT = DRAFT.split(", rule")[0]
_CARRIED = [c.split()[0] for c in _EVENT.split(", ")]
_DRAFTED = [c.split()[0] for c in DRAFT.split(", ")]
#: What rules read of a packet, beside what they tell of it.
_READ = ["src_ip", "dst_ip", "tcp_flags", "icmp_echo", "qname", "qtype", "dns_response", "payload_len"]
Event = namedtuple("Event", kernels.FIELDS)


def _inbound() -> Column:
    return F.col("direction") == "inbound"


def _new_connection() -> Column:
    return S.is_new_connection(F.col("proto"), F.col("tcp_flags"))


# ---- guards: which packets a rule looks at ----


def _probe() -> Column:
    return _inbound() & _new_connection() & F.col("dst_port").isNotNull()


def _answer() -> Column:
    return (F.col("direction") == "outbound") & (F.col("proto") == "tcp") & S.has(F.col("tcp_flags"), S.SYN | S.ACK) & F.col("src_port").isNotNull()


def _asked(ports: list[int]) -> Column:
    return (F.col("direction") == "outbound") & F.col("dst_port").isin(ports)


def _backdoor(ports: list[int]) -> Column:
    hit = lambda c: F.when(F.col(c).isin(ports), F.col(c))
    return F.coalesce(hit("src_port"), hit("dst_port"))


def guard(rule: str, cfg, listening: list[int] | None = None) -> Column:
    """The condition under which `rule` looks at a packet; cfg is the rule's section."""
    flood = lambda proto: _inbound() & (F.col("proto") == proto)
    found = {
        "port-scan": lambda: _probe(),
        "invalid-tcp-flags": lambda: (F.col("proto") == "tcp") & S.is_invalid(F.col("tcp_flags")),
        "brute-force": lambda: _inbound() & _new_connection() & F.col("dst_port").isin(cfg.ports),
        "syn-flood": lambda: _answer() | _probe(),
        "udp-flood": lambda: flood("udp"),
        "icmp-flood": lambda: flood("icmp"),
        "reflection-amplification": lambda: (F.col("proto") == "udp") & (_asked(cfg.ports) | _inbound() & F.col("src_port").isin(cfg.ports)),
        "dns-tunnel": lambda: F.col("qname").isNotNull() & ~F.coalesce("dns_response", F.lit(False)),
        "icmp-tunnel": lambda: (F.col("proto") == "icmp") & F.col("icmp_echo") & (F.col("payload_len") >= cfg.max_payload),
        "beaconing": lambda: (F.col("direction") == "outbound") & _new_connection(),
        "suspicious-port": lambda: _backdoor(cfg.ports).isNotNull(),
        # unknown listeners make no probe
        "new-listener-probe": lambda: _probe() & ~F.col("dst_port").isin(listening) if listening else F.lit(False),
    }[rule]()
    return F.coalesce(found, F.lit(False))


def _seen(p: DataFrame, rule: str, cfg, listening: list[int] | None = None) -> DataFrame:
    """The packets that a rule looks at: by the mask where there is one."""
    if "_rules" in p.columns:
        return p.where(F.col("_rules").bitwiseAND(F.lit(1 << R.ORDER[rule])) != 0)
    return p.where(guard(rule, cfg, listening))


# ---- rules that count: hits, to be cooled down ----


def _hits(df: DataFrame, rule: str, cfg, keys: list[str], detail: Column, count, window_s: int, severity: Column | None = None, sig_ord: Column | None = None) -> DataFrame:
    """Drafts with the key and the length of their cooldown; no payload goes through a shuffle."""
    return df.select(
        *_CARRIED,
        F.lit(rule).alias("rule"),
        (F.lit(cfg.severity) if severity is None else severity).alias("severity"),
        detail.alias("detail"),
        (count if isinstance(count, Column) else F.lit(count)).cast("long").alias("count"),
        F.lit(window_s).cast("long").alias("window_s"),
        (F.lit(0) if sig_ord is None else sig_ord).cast("int").alias("sig_ord"),
        F.to_json(F.struct(*keys)).alias("cool_key"),
        F.lit(cfg.cooldown_s * SECOND).cast("long").alias("wait_us"),
    )


def cooled(hits: DataFrame, suppress: int | None = None) -> DataFrame:
    """Drafts that the cooldown of their rule and key lets pass; of signatures the first `suppress` of each key."""
    passed = cooldown(hits, ["rule", "cool_key"], "wait_us")
    if suppress is not None:
        named = F.col("rule") == "custom-signature"
        passed = suppress_after(passed.where(named), ["cool_key"], suppress).unionByName(passed.where(~named))
    return passed.select(_DRAFTED)


def _counted(df: DataFrame, keys: list[str], cfg, rule: str, detail: Column) -> DataFrame:
    found = counts_at_arrival(df, keys, cfg.window_s * SECOND, {"n": None}).where(F.col("n") >= cfg.threshold)
    return _hits(found, rule, cfg, keys, detail, F.col("n"), cfg.window_s)


def _n(text: str) -> list[Column]:
    """The pieces of a text around {n}."""
    before, after = text.split("{n}")
    return [F.lit(before), F.col("n").cast("string"), F.lit(after)]


def _invalid_flags_hits(p: DataFrame, cfg) -> DataFrame:
    df = _seen(p, "invalid-tcp-flags", cfg)
    detail = F.concat(F.lit("invalid TCP flags ("), S.combo_name(F.col("tcp_flags")), *_n(f"): {{n}} packets in {cfg.window_s}s"))
    return _counted(df, ["peer_ip"], cfg, "invalid-tcp-flags", detail)


def _with_ends(df: DataFrame) -> DataFrame:
    """The end that a flood is aimed at, and, of an answer, the one that it comes from."""
    return df.withColumns({"end_ip": F.when(_answer(), F.col("src_ip")).otherwise(F.col("dst_ip")), "end_port": F.when(_answer(), F.col("src_port")).otherwise(F.col("dst_port"))})


def _syn_flood_hits(p: DataFrame, cfg) -> DataFrame:
    keys = ["end_ip", "end_port"]
    both = counts_at_arrival(_with_ends(_seen(p, "syn-flood", cfg)), keys, cfg.window_s * SECOND, {"n": _inbound(), "answers": F.col("direction") == "outbound"})
    ratio = F.col("answers") / F.col("n")
    hits = both.where(_inbound() & (F.col("n") >= cfg.threshold)).where(ratio < cfg.max_completion_ratio)
    detail = F.concat(
        F.lit("SYN flood on "), "end_ip", F.lit(":"), F.col("end_port").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" SYNs, "),
        F.col("answers").cast("string"), F.lit(" SYN-ACKs, completion ratio "), S.two_digits(ratio), F.lit(f" in {cfg.window_s}s"),
    )
    return _hits(hits, "syn-flood", cfg, keys, detail, F.col("n"), cfg.window_s)


def _flood_hits(p: DataFrame, cfg, proto: str) -> DataFrame:
    port = F.coalesce("dst_port", F.lit(0)) if proto == "udp" else F.lit(0)
    df = _seen(p, f"{proto}-flood", cfg).withColumn("end_port", port.cast("int"))
    return _counted(df, ["dst_ip", "end_port"], cfg, f"{proto}-flood", F.concat(F.lit(f"{proto.upper()} flood on "), "dst_ip", *_n(f": {{n}} pkts in {cfg.window_s}s")))


def unsolicited(p: DataFrame, ports: list[int], window_us: int, ordered: bool = True) -> DataFrame:
    """Inbound UDP from a reflector port that no request of ours to that peer and port preceded within the window.

    With ordered times only requests within the window matter, so each time
    chunk of a peer is looked at by itself.
    """
    asked = _asked(ports)
    df = p.where((F.col("proto") == "udp") & (asked | _inbound() & F.col("src_port").isin(ports))).withColumn("service", F.when(asked, F.col("dst_port")).otherwise(F.col("src_port")))
    keys = ["peer_ip", "service"]
    if ordered:
        df, keys = with_halo(df, window_us), [*keys, "_chunk"]
    df = df.withColumn("asked_us", last_before(F.when(asked, F.col("ts_us")), keys))
    if ordered:
        df = df.where(~F.col("_halo")).drop("_chunk", "_halo")
    return df.where(_inbound() & ~F.coalesce((F.col("ts_us") - F.col("asked_us")).between(0, window_us), F.lit(False)))


def _reflection_hits(p: DataFrame, cfg) -> DataFrame:
    df = unsolicited(_seen(p, "reflection-amplification", cfg), cfg.ports, cfg.window_s * SECOND).where(F.col("payload_len") >= cfg.min_response_bytes)
    detail = F.concat(*_n("reflection/amplification: {n} unsolicited "), F.col("src_port").cast("string"), F.lit(f"-source responses >= {cfg.min_response_bytes}B in {cfg.window_s}s"))
    return _counted(df, ["peer_ip"], cfg, "reflection-amplification", detail)


def _icmp_tunnel_hits(p: DataFrame, cfg) -> DataFrame:
    detail = F.concat(*_n(f"possible ICMP tunnel: {{n}} oversized echo payloads >= {cfg.max_payload}B in {cfg.window_s}s"))
    return _counted(_seen(p, "icmp-tunnel", cfg), ["peer_ip"], cfg, "icmp-tunnel", detail)


def _backdoor_detail(cfg) -> Column:
    return F.concat(F.lit("traffic on suspicious/backdoor port "), _backdoor(cfg.ports).cast("string"))


def _suspicious_port_hits(p: DataFrame, cfg) -> DataFrame:
    return _hits(_seen(p, "suspicious-port", cfg), "suspicious-port", cfg, ["peer_ip"], _backdoor_detail(cfg), 1, 0)


def with_intel(p: DataFrame, intel: DataFrame) -> DataFrame:
    """p with `_listed`: the feed that lists the peer, 'blocklist' where it has no name, null where none does."""
    found = lookups.longest_prefix(p, intel.select("family", "prefix_len", "prefix_bits", F.coalesce("source", F.lit("blocklist")).alias("_listed")), "peer_ip", ["_listed"], how="left")
    return found.drop("prefix_len")


def intel_detail() -> Column:
    return F.concat(F.lit("peer "), "peer_ip", F.lit(" matches threat feed '"), "_listed", F.lit("'"))


def _intel_hits(p: DataFrame, cfg) -> DataFrame:
    return _hits(p.where("_listed is not null"), "threat-intel-hit", cfg, ["peer_ip"], intel_detail(), 1, 0)


def signature_column(s: SignatureCfg) -> Column:
    """A signature's conditions, cheapest first."""
    from ..plans.snort import decode_content

    parts = []
    if s.protocol in ("tcp", "udp", "icmp"):
        parts.append(F.col("proto") == s.protocol)
    if s.direction in ("in", "out"):
        parts.append(F.col("direction") == s.direction + "bound")
    if s.ports:
        parts.append(F.coalesce(F.col("src_port").isin(s.ports), F.lit(False)) | F.coalesce(F.col("dst_port").isin(s.ports), F.lit(False)))
    if s.peer_cidr:
        hit = F.coalesce(net.in_v4(net.v4_number(F.col("peer_ip")), s.peer_cidr), F.lit(False))
        if any(":" in c for c in s.peer_cidr):
            hit = hit | (F.col("peer_ip").contains(":") & net.in_v6(F.coalesce(lookups.address_bits(F.col("peer_ip")), F.lit("")), s.peer_cidr))
        parts.append(hit)
    if s.content is not None:
        parts.append(S.content_match(F.col("payload"), decode_content(s.content), s.nocase, s.offset, s.depth))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def with_signatures(p: DataFrame, cfg, signatures: list[SignatureCfg]) -> DataFrame:
    """p with `_sigs`: (ord, name, label, severity) of each signature that a packet matches."""
    live = [s for s in signatures if s.enabled and s.name.strip()]
    if len(live) > signature_index.FEW:
        return signature_index.matched(p, cfg, live)
    row = lambda i, s: F.when(signature_column(s), F.struct(F.lit(i).alias("ord"), F.lit(s.name).alias("name"), F.lit(s.label).alias("label"), F.lit(s.severity or cfg.severity).alias("severity")))
    matched = F.filter(F.array(*(row(i, s) for i, s in enumerate(live))), lambda x: x.isNotNull()) if live else F.array().cast(signature_index.SIGS)
    return p.withColumn("_sigs", matched)


def exploded_signatures(p: DataFrame) -> DataFrame:
    return p.withColumn("sig", F.explode("_sigs")).drop("_sigs").withColumn("sig_name", F.col("sig.name"))


def signature_detail() -> Column:
    return F.concat(F.lit("signature '"), "sig.name", F.lit("' ["), "sig.label", F.lit("] matched "), "proto", F.lit(" "), "direction", F.lit(" from "), "peer_ip")


def _signature_hits(p: DataFrame, cfg) -> DataFrame:
    return _hits(exploded_signatures(p), "custom-signature", cfg, ["peer_ip", "sig_name"], signature_detail(), 1, 0, F.col("sig.severity"), F.col("sig.ord"))


# ---- rules that reset: state machines ----


@dataclass(frozen=True)
class Fold:
    """A state machine of a rule over the keys that `keys` tell apart."""

    rule: str
    section: object
    keys: tuple[str, ...]
    machine: kernels.Machine


def resetting(cfg: RulesCfg, listening: list[int] | None) -> list[Fold]:
    """The rules that are machines in any case."""
    out = [
        Fold("port-scan", cfg.port_scan, ("peer_ip",), kernels.PortScan(cfg.port_scan)),
        Fold("brute-force", cfg.brute_force, ("peer_ip",), kernels.BruteForce(cfg.brute_force)),
        Fold("dns-tunnel", cfg.dns_tunnel, ("peer_ip",), kernels.DnsTunnel(cfg.dns_tunnel)),
        Fold("beaconing", cfg.beaconing, ("peer_ip",), kernels.Beaconing(cfg.beaconing)),
    ]
    if listening:
        out.append(Fold("new-listener-probe", cfg.new_listener, ("dst_port",), kernels.NewListener(cfg.new_listener)))
    return [f for f in out if f.section.enabled]


def counting(cfg: RulesCfg) -> list[Fold]:
    """The rules that count, as machines; they read what `folding` adds."""
    count = lambda section, text: kernels.Count(section, text=text)
    tunnel = f"possible ICMP tunnel: {{count}} oversized echo payloads >= {cfg.icmp_tunnel.max_payload}B in {{window}}s"
    out = [
        Fold("invalid-tcp-flags", cfg.invalid_tcp_flags, ("peer_ip",), count(cfg.invalid_tcp_flags, "invalid TCP flags ({label}): {count} packets in {window}s")),
        Fold("syn-flood", cfg.syn_flood, ("end_ip", "end_port"), kernels.SynFlood(cfg.syn_flood)),
        Fold("udp-flood", cfg.udp_flood, ("dst_ip", "flood_port"), count(cfg.udp_flood, "UDP flood on {dst}: {count} pkts in {window}s")),
        Fold("icmp-flood", cfg.icmp_flood, ("dst_ip", "flood_port"), count(cfg.icmp_flood, "ICMP flood on {dst}: {count} pkts in {window}s")),
        Fold("reflection-amplification", cfg.reflection_amplification, ("peer_ip",), kernels.Reflection(cfg.reflection_amplification)),
        Fold("icmp-tunnel", cfg.icmp_tunnel, ("peer_ip",), count(cfg.icmp_tunnel, tunnel)),
    ]
    return [f for f in out if f.section.enabled]


def folding(df: DataFrame) -> DataFrame:
    """df with the keys and texts that machines read beside the packet."""
    out = _with_ends(df).withColumn("flood_port", F.when(F.col("proto") == "udp", F.coalesce("dst_port", F.lit(0))).otherwise(F.lit(-1)))
    return out if "label" in df.columns else out.withColumn("label", F.when(F.col("proto") == "tcp", S.combo_name(F.col("tcp_flags"))))


def fields_of(df: DataFrame) -> list[Column]:
    return [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in kernels.FIELDS]


def drafted(e: Event, fold: Fold, found: tuple) -> tuple:
    """A draft's values; a row's own severity and number go before the rule's."""
    return (*(getattr(e, c) for c in _CARRIED), fold.rule, e.severity or fold.section.severity, *found, getattr(fold.section, "window_s", 0), e.sig_ord or 0)


def fold(df: DataFrame, folds: list[Fold]) -> DataFrame:
    """Drafts of state machines over each of their keys, in arrival order.

    df has `_rules`, the mask of the rules that look at a packet, and all key
    columns.  Folds with the same keys share them: a packet is shuffled once
    for each such kind, all kinds in one shuffle, and each partition is read as
    a stream with the machines of one key, so memory is bounded by those, not
    by a key.
    """
    kinds: dict[tuple[str, ...], list[Fold]] = {}
    for f in folds:
        kinds.setdefault(f.keys, []).append(f)
    plans = [[(1 << R.ORDER[f.rule], f, pickle.dumps(f.machine)) for f in same] for same in kinds.values()]
    wanted = lambda plan: F.col("_rules").bitwiseAND(F.lit(sum(bit for bit, _, _ in plan))) != 0
    ways = [F.when(wanted(plan), F.struct(F.lit(i).alias("kind"), F.to_json(F.struct(*keys)).alias("key"))) for i, (keys, plan) in enumerate(zip(kinds, plans))]
    dealt = df.select(F.explode(F.filter(F.array(*ways), lambda w: w.isNotNull())).alias("_way"), "_rules", *fields_of(df)).select("_way.kind", "_way.key", "_rules", *kernels.FIELDS)
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]]) for c in DRAFT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machines = None, {}
        for batch in batches:
            out = []
            kind, key, rules, *values = (c.to_pylist() for c in batch.columns)
            for i, e in enumerate(map(Event._make, zip(*values))):
                if (kind[i], key[i]) != now:
                    now, machines = (kind[i], key[i]), {}
                for bit, f, fresh in plans[kind[i]]:
                    if rules[i] & bit:
                        machine = machines.get(bit)
                        if machine is None:
                            machine = machines[bit] = pickle.loads(fresh)
                        if found := machine.on(e):
                            out.append(drafted(e, f, found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return dealt.repartition("kind", "key").sortWithinPartitions("kind", "key", "seq").mapInArrow(run, DRAFT)


def _folded(p: DataFrame, f: Fold, listening: list[int] | None = None) -> DataFrame:
    """One rule by itself."""
    df = folding(p.where(guard(f.rule, f.section, listening)).withColumn("_rules", F.lit(1 << R.ORDER[f.rule])))
    return fold(df, [f])


# ---- one rule at a time ----


def _alone(p: DataFrame, rule: str, section: str, cfg, listening: list[int] | None = None) -> DataFrame:
    whole = RulesCfg(**{section: cfg})
    (f,) = [f for f in [*resetting(whole, listening), *counting(whole)] if f.rule == rule]
    return _folded(p, f, listening)


def port_scan(p: DataFrame, cfg, ordered: bool = True) -> DataFrame:
    return _alone(p, "port-scan", "port_scan", cfg)


def invalid_tcp_flags(p: DataFrame, cfg, ordered: bool = True) -> DataFrame:
    return cooled(_invalid_flags_hits(p, cfg)) if ordered else _alone(p, "invalid-tcp-flags", "invalid_tcp_flags", cfg)


def brute_force(p: DataFrame, cfg, ordered: bool = True) -> DataFrame:
    return _alone(p, "brute-force", "brute_force", cfg)


def syn_flood(p: DataFrame, cfg, ordered: bool = True) -> DataFrame:
    return cooled(_syn_flood_hits(p, cfg)) if ordered else _alone(p, "syn-flood", "syn_flood", cfg)


def udp_flood(p: DataFrame, cfg, ordered: bool = True) -> DataFrame:
    return cooled(_flood_hits(p, cfg, "udp")) if ordered else _alone(p, "udp-flood", "udp_flood", cfg)


def icmp_flood(p: DataFrame, cfg, ordered: bool = True) -> DataFrame:
    return cooled(_flood_hits(p, cfg, "icmp")) if ordered else _alone(p, "icmp-flood", "icmp_flood", cfg)


def reflection(p: DataFrame, cfg, ordered: bool = True) -> DataFrame:
    return cooled(_reflection_hits(p, cfg)) if ordered else _alone(p, "reflection-amplification", "reflection_amplification", cfg)


def dns_tunnel(p: DataFrame, cfg, ordered: bool = True) -> DataFrame:
    return _alone(p, "dns-tunnel", "dns_tunnel", cfg)


def icmp_tunnel(p: DataFrame, cfg, ordered: bool = True) -> DataFrame:
    return cooled(_icmp_tunnel_hits(p, cfg)) if ordered else _alone(p, "icmp-tunnel", "icmp_tunnel", cfg)


def beaconing(p: DataFrame, cfg, ordered: bool = True) -> DataFrame:
    return _alone(p, "beaconing", "beaconing", cfg)


def threat_intel(p: DataFrame, cfg, intel: DataFrame) -> DataFrame:
    return cooled(_intel_hits(with_intel(p, intel), cfg))


def suspicious_port(p: DataFrame, cfg, ordered: bool = True) -> DataFrame:
    return cooled(_suspicious_port_hits(p, cfg))


def new_listener(p: DataFrame, cfg, listening: list[int]) -> DataFrame:
    if not listening:
        return p.sparkSession.createDataFrame([], DRAFT)
    return _alone(p, "new-listener-probe", "new_listener", cfg, listening)


def custom_signature(p: DataFrame, cfg, signatures: list[SignatureCfg]) -> DataFrame:
    return cooled(_signature_hits(with_signatures(p, cfg, signatures), cfg), cfg.suppress_after)


# ---- all rules in one pass ----


def sections(cfg: RulesCfg, listening: list[int] | None) -> dict[str, object]:
    """The enabled rules that look at packets by themselves, with their sections."""
    out = {
        "port-scan": cfg.port_scan, "invalid-tcp-flags": cfg.invalid_tcp_flags, "brute-force": cfg.brute_force, "syn-flood": cfg.syn_flood, "udp-flood": cfg.udp_flood,
        "icmp-flood": cfg.icmp_flood, "reflection-amplification": cfg.reflection_amplification, "dns-tunnel": cfg.dns_tunnel, "icmp-tunnel": cfg.icmp_tunnel,
        "beaconing": cfg.beaconing, "suspicious-port": cfg.suspicious_port,
    }
    if listening:
        out["new-listener-probe"] = cfg.new_listener
    return {rule: section for rule, section in out.items() if section.enabled}


def guarded(p: DataFrame, cfg: RulesCfg, intel: DataFrame | None, listening: list[int] | None) -> DataFrame:
    """The packets that some rule looks at, with the mask of those rules, the feed that lists the peer and matched signatures instead of the payload."""
    mask = [F.when(guard(rule, section, listening), F.lit(1 << R.ORDER[rule])).otherwise(F.lit(0)) for rule, section in sections(cfg, listening).items()]
    extra = []
    if cfg.threat_intel.enabled and intel is not None:
        p = with_intel(p, intel)
        mask.append(F.when(F.col("_listed").isNotNull(), F.lit(1 << R.ORDER["threat-intel-hit"])).otherwise(F.lit(0)))
        extra.append("_listed")
    if cfg.custom_signature.enabled and cfg.signature:
        p = with_signatures(p, cfg.custom_signature, cfg.signature)
        mask.append(F.when(F.size("_sigs") > 0, F.lit(1 << R.ORDER["custom-signature"])).otherwise(F.lit(0)))
        extra.append("_sigs")
    rules = reduce(lambda a, b: a + b, mask, F.lit(0))
    return p.select(*_CARRIED, *_READ, *extra, rules.alias("_rules")).where("_rules <> 0")


def drafts(p: DataFrame, cfg: RulesCfg, intel: DataFrame | None = None, listening: list[int] | None = None, ordered: bool = True) -> DataFrame | None:
    """Drafts of every enabled rule, from one reading of the packets; None if no rule is enabled."""
    seen = kept(guarded(p, cfg, intel, listening))
    folds = resetting(cfg, listening) + ([] if ordered else counting(cfg))
    counts = {
        "invalid-tcp-flags": lambda: _invalid_flags_hits(seen, cfg.invalid_tcp_flags), "syn-flood": lambda: _syn_flood_hits(seen, cfg.syn_flood),
        "udp-flood": lambda: _flood_hits(seen, cfg.udp_flood, "udp"), "icmp-flood": lambda: _flood_hits(seen, cfg.icmp_flood, "icmp"),
        "reflection-amplification": lambda: _reflection_hits(seen, cfg.reflection_amplification), "icmp-tunnel": lambda: _icmp_tunnel_hits(seen, cfg.icmp_tunnel),
    }
    wanted = sections(cfg, listening)
    hits = [make() for rule, make in counts.items() if ordered and rule in wanted]
    if "suspicious-port" in wanted:
        hits.append(_suspicious_port_hits(seen, cfg.suspicious_port))
    if "_listed" in seen.columns:
        hits.append(_intel_hits(seen, cfg.threat_intel))
    if "_sigs" in seen.columns:
        hits.append(_signature_hits(seen, cfg.custom_signature))
    out = [fold(folding(seen), folds)] if folds else []
    if hits:
        out.append(cooled(reduce(DataFrame.unionByName, hits), cfg.custom_signature.suppress_after if "_sigs" in seen.columns else None))
    return reduce(DataFrame.unionByName, out) if out else None
