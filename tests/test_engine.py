"""Many signatures by one automaton, and all rules from one reading."""

import random


from netloom.operators import detectors, kernels, lookups, signature_index
from netloom.plans import catalog
from netloom.plans import config as C
from netloom.plans import snort
from netloom.plans import synthetic as P
from netloom.plans.engine import Engine
from netloom.sources import geo

PACKET = "seq long, proto string, direction string, src_port int, dst_port int, peer_ip string, payload binary"


def lower(b):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


def matches(s, proto, direction, src, dst, peer, payload):
    """A signature's conditions, one after another."""
    import ipaddress

    if s.protocol and s.protocol != proto or s.direction in ("in", "out") and s.direction + "bound" != direction:
        return False
    if s.ports and src not in s.ports and dst not in s.ports:
        return False
    if s.peer_cidr and not any(ipaddress.ip_address(peer) in ipaddress.ip_network(c) for c in s.peer_cidr):
        return False
    if s.content is not None:
        needle, hay = snort.decode_content(s.content), (payload or b"")[s.offset or 0 :]
        hay = hay if s.depth is None else hay[: s.depth]
        return bool(needle) and (lower(needle) in lower(hay) if s.nocase else needle in hay)
    return True


def random_signature(rnd, i):
    content = rnd.choice([None, "".join(rnd.choice("abAB ") for _ in range(rnd.randint(1, 5))), "a|00 FF|b", "|C3|é", ""]) if i % 7 else None
    return C.SignatureCfg(
        name=f"s{i}", protocol=rnd.choice([None, "tcp", "udp"]), direction=rnd.choice([None, "in", "out", "both"]), ports=rnd.sample(range(1, 60), rnd.choice([0, 1, 3])),
        peer_cidr=rnd.choice([[], [], ["200.0.0.0/30"], ["200.0.0.4/32", "2001:db8::/32"]]), content=content, nocase=rnd.random() < 0.4,
        offset=rnd.choice([None, None, 2]), depth=rnd.choice([None, None, 5]), severity=rnd.choice([None, "low"]), enabled=i % 50 != 0,
    )


def test_five_thousand_signatures_against_brute_force(spark):
    rnd = random.Random(6)
    signatures = [random_signature(rnd, i) for i in range(5000)]
    peers = [f"200.0.0.{i}" for i in range(8)] + ["2001:db8::5", "2001:db9::5"]
    rows = [(i, rnd.choice(["tcp", "udp", "icmp"]), rnd.choice(["inbound", "outbound"]), rnd.choice([None, 7, 33]), rnd.choice([None, rnd.randint(1, 60)]), rnd.choice(peers), rnd.choice([None, b"", bytes(rnd.choice(b"abAB \x00\xff\xc3\xa9") for _ in range(rnd.randint(1, 12)))])) for i in range(60)]
    found = detectors.with_signatures(spark.createDataFrame(rows, PACKET).repartition(2), C.SimpleCfg(severity="high"), signatures)
    live = [s for s in signatures if s.enabled]
    want = {r[0]: [(i, s.name, s.severity or "high") for i, s in enumerate(live) if matches(s, *r[1:])] for r in rows}
    assert {r.seq: [(x.ord, x.name, x.severity) for x in r._sigs] for r in found.collect()} == want and sum(map(len, want.values())) > 5000
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 5000  # no expression for each signature


def test_index_and_expressions_agree(spark, monkeypatch):
    rnd = random.Random(7)
    signatures = [random_signature(rnd, i) for i in range(40)]
    rows = [(i, "tcp", "inbound", 7, rnd.randint(1, 60), f"200.0.0.{i % 9}", bytes(rnd.choice(b"abAB ") for _ in range(9))) for i in range(40)]
    df = spark.createDataFrame(rows, PACKET)
    told = lambda: {r.seq: [x.ord for x in r._sigs] for r in detectors.with_signatures(df, C.SimpleCfg(), signatures).collect()}
    by_expression = told()
    monkeypatch.setattr(signature_index, "FEW", 0)
    assert told() == by_expression and any(by_expression.values())


def test_all_rules_read_the_packets_once(spark, tmp_path):
    """The packets are counted as they are read: each passes once, whatever the number of rules."""
    packets = P.packets(spark, "/root/testdata/sf0.001")
    n, read = packets.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    engine = Engine(catalog.CFG, [], lookups.prefixes(spark, catalog.INTEL), None, catalog.LISTENING)
    alerts = engine.detect(packets.mapInArrow(counted, packets.schema))
    assert len({r.rule for r in alerts.select("rule").collect()}) >= 10 and alerts.count() > 0
    assert read.value == n
    plan = alerts._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower()  # what is left reads the kept rows
    assert plan.count("MapInArrow") == 1  # all machines in one fold


def test_no_rule_no_alert(spark):
    off = C.RulesCfg()
    for section in vars(off).values():
        if isinstance(section, C.Section):
            section.enabled = False
    assert Engine(off).detect(P.packets(spark, "/root/testdata/sf0.001")).count() == 0


def test_recent_things_are_forgotten_in_any_order_of_time():
    rnd = random.Random(2)
    cfg = C.PortScanCfg(window_s=10, min_targets=99)
    for steps in ([0, 1, 3], [-4, 0, 1, 5]):
        machine, held, now = kernels.PortScan(cfg), {}, 10**9
        for _ in range(400):
            now += rnd.choice(steps)
            key = rnd.randint(0, 12)
            held[key] = now * 10**6
            held = {k: t for k, t in held.items() if t > (now - 10) * 10**6}
            assert machine.renew(key, now * 10**6) == len(held) and machine.seen == held


def test_ranges_become_their_fewest_prefixes(spark):
    import ipaddress

    rnd = random.Random(3)
    base = int(ipaddress.ip_address("200.0.0.0"))
    lines, ranges = ["# places", "", "nonsense,1.2.3.4,1,XX", "9.9.9.9,1.1.1.1,1,XX", "200.0.0.1,2001:db8::1,1,XX"], []
    for i in range(12):
        lo = base + 64 * i + rnd.randint(0, 20)
        hi = lo + rnd.randint(0, 40)
        inner = rnd.randint(lo, hi)
        for n, (a, b) in enumerate([(lo, hi), (inner, rnd.randint(inner, hi))]):
            if (a, b) not in [r[:2] for r in ranges]:
                ranges.append((a, b, 100 * i + n))
                lines.append(f"{ipaddress.ip_address(a)}, {ipaddress.ip_address(b)} ,{100 * i + n},C{n}")
    lines += ["2001:db8::1,2001:db8::9,6,SIX", "2001:db8::4,2001:db8::5,7,", "210.0.0.0/16,,8,NET"]
    table = geo.parse(spark.createDataFrame([(x,) for x in lines], "value string").repartition(2))
    asks = [str(ipaddress.ip_address(base + i)) for i in range(0, 800, 3)] + ["2001:db8::4", "2001:db8::9", "2001:db8::a", "210.0.7.7"]
    found = lookups.longest_prefix(spark.createDataFrame(list(enumerate(asks)), "seq long, ip string"), table, "ip", ["asn", "country"], how="left")
    want = {i: min(((b - a, n) for a, b, n in ranges if a <= base + 3 * i <= b), default=(0, None))[1] for i in range(len(asks) - 4)}
    assert {r.seq: r.asn for r in found.collect()} == want | dict(enumerate([7, 6, None, 8], len(asks) - 4))
    assert geo.split_range("0.0.0.1", "0.0.0.6") == [(4, 32, "0" * 31 + "1"), (4, 31, "0" * 30 + "1"), (4, 31, "0" * 29 + "10"), (4, 32, "0" * 29 + "110")]
    assert geo.parse(table.select("country").where("false")).count() == 0
