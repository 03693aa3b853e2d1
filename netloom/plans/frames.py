"""Ethernet frames of the packets that synthetic.py makes of `events`, and in SQL what a decoder has to find in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import synthetic as P

NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1}
_V6 = [0x2600, 1, 2, 3, 4, 5]


def _be(n, width: int) -> Column:
    """A number as `width` bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(F.col(n) if isinstance(n, str) else n), 2 * width, "0"))


def _bytes(*values: int) -> Column:
    return F.lit(bytes(values))


def _label(text: Column) -> Column:
    return F.concat(_be(F.length(text), 1), text.cast("binary"))


def dns_message(name: Column, qtype: Column, response: Column, pointed: Column) -> Column:
    """A message that asks for a name of four labels; with `pointed` the last three lie behind the question, and a pointer leads there."""
    labels = [F.element_at(F.split(name, r"\."), i) for i in range(1, 5)]
    rest = F.concat(*(_label(x) for x in labels[1:]), _bytes(0))
    asked = F.concat(_be(qtype, 2), _be(F.lit(1), 2))
    pointer = F.concat(_bytes(0xC0), _be(19 + F.length(labels[0]), 1), asked, rest)
    head = F.concat(_bytes(0, 1), F.when(response, _bytes(0x81, 0x80)).otherwise(_bytes(1, 0)), _bytes(0, 1, 0, 0, 0, 0, 0, 0))
    return F.concat(head, _label(labels[0]), F.when(pointed, pointer).otherwise(F.concat(rest, asked)))


PLAIN = {"tags": 0, "v6": False, "hop": False, "options": False, "more": False, "later": False, "tcp_options": False, "padded": False, "kind": 8, "code": 0, "fault": "none"}


def frame(shape: dict[str, Column], body: Column) -> Column:
    """The frame of a packet, in the shape that PLAIN's columns tell, around `body`."""
    s = {k: F.lit(v) for k, v in PLAIN.items()} | shape
    nothing = F.lit(b"")
    ports = F.concat(_be("src_port", 2), _be("dst_port", 2))
    tcp = F.concat(ports, F.lit(bytes(8)), F.when(s["tcp_options"], _bytes(0x80)).otherwise(_bytes(0x50)), _be("tcp_flags", 1), F.lit(bytes(6)), F.when(s["tcp_options"], F.lit(b"\1" * 12)).otherwise(nothing), body)
    udp = F.concat(ports, _be(8 + F.length(body), 2), F.lit(bytes(2)), body, F.when(s["padded"], F.lit(bytes(4))).otherwise(nothing))
    icmp = F.concat(_be(s["kind"], 1), _be(s["code"], 1), F.lit(bytes(6)), body)
    carried = F.when(F.col("proto") == "tcp", tcp).when(F.col("proto") == "udp", udp).otherwise(icmp)
    number = F.when(F.col("proto") == "tcp", 6).when(F.col("proto") == "udp", 17).otherwise(F.when(s["v6"], 58).otherwise(1))
    wrong = s["fault"] == "version"
    inbound = F.col("direction") == "inbound"
    both = lambda peer, local: F.when(inbound, F.concat(peer, local)).otherwise(F.concat(local, peer))

    head = F.when(s["options"], 24).otherwise(20)
    first = F.when(wrong, 0x90).otherwise(0x40) + F.shiftright(head, 2)
    fragment4 = F.when(s["more"], _bytes(0x20, 0)).when(s["later"], _bytes(0, 100)).otherwise(_bytes(0, 0))
    v4 = F.concat(
        _be(first, 1), _bytes(0), _be(head + F.length(carried), 2), _bytes(0, 0), fragment4, _bytes(64), _be(number, 1), _bytes(0, 0),
        both(_be("peer4", 4), _be("local4", 4)), F.when(s["options"], F.lit(b"\1" * 4)).otherwise(nothing), carried,
    )

    cut = s["more"] | s["later"]
    fragment6 = F.when(cut, F.concat(_be(number, 1), _bytes(0), F.when(s["more"], _be(F.lit(1), 2)).otherwise(_be(F.lit(800), 2)), F.lit(bytes(4)))).otherwise(nothing)
    after = F.when(cut, 44).otherwise(number)
    hop = F.when(s["hop"], F.concat(_be(after, 1), F.lit(bytes(7)))).otherwise(nothing)
    net = F.lit(b"".join(n.to_bytes(2, "big") for n in _V6))
    peer6, local6 = F.concat(net, _be(1 + F.col("k"), 2), _be(F.col("user_id") % 65535 + 1, 2)), F.concat(net, _bytes(0, 6), _be(F.col("local4") % 256, 2))
    v6 = F.concat(
        F.when(wrong, _bytes(0x90)).otherwise(_bytes(0x60)), F.lit(bytes(3)), _be(F.length(hop) + F.length(fragment6) + F.length(carried), 2),
        _be(F.when(s["hop"], 0).otherwise(after), 1), _bytes(64), both(peer6, local6), hop, fragment6, carried,
    )

    tags = F.when(s["tags"] == 2, _bytes(0x88, 0xA8, 0, 7, 0x81, 0, 0, 9)).when(s["tags"] == 1, _bytes(0x81, 0, 0, 9)).otherwise(nothing)
    kind = F.when(s["fault"] == "kind", _bytes(0x08, 0x06)).when(s["v6"], _bytes(0x86, 0xDD)).otherwise(_bytes(0x08, 0x00))
    whole = F.concat(_bytes(2, 0, 0, 0, 0, 1, 2, 0, 0, 0, 0, 2), tags, kind, F.when(s["v6"], v6).otherwise(v4))
    return F.when(s["fault"] == "cut", F.substring(whole, F.lit(1), 24 + 4 * s["tags"])).otherwise(whole)


def _asks() -> Column:
    return (F.col("proto") == "udp") & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))


def _name() -> Column:
    return F.concat(F.lit("h"), F.col("k").cast("string"), F.lit("x"), (F.col("seq") % 7).cast("string"), F.lit("."), "event_type", F.lit(".example.org"))


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.packets(spark, sf_dir, "user_id", "event_type", "k")


def _qtype() -> Column:
    return F.element_at(F.lit(P.QTYPES), (F.col("seq") % 4 + 1).cast("int"))


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames(seq, ts_ns, frame) of every event in all shapes: tags, both families, options, extension headers, fragments, pointers, and broken ones."""
    n, k = F.col("seq"), F.col("k")
    fault = F.when(n % 13 == 10, "version").when(n % 13 == 11, "kind").when(n % 13 == 12, "cut").otherwise("none")
    v6 = n % 7 == 3
    kind = F.when(v6, F.element_at(F.lit([128, 129, 1]), (n % 3 + 1).cast("int"))).otherwise(F.element_at(F.lit([8, 0, 3]), (n % 3 + 1).cast("int")))
    shape = {"tags": n % 3, "v6": v6, "hop": k % 2 == 1, "options": n % 5 == 1, "more": n % 11 == 4, "later": n % 11 == 5, "tcp_options": k % 3 == 0, "padded": n % 2 == 0, "kind": kind, "code": k % 4, "fault": fault}
    body = F.when(_asks(), dns_message(_name(), _qtype(), n % 2 == 1, n % 4 == 2)).otherwise(F.col("payload"))
    return _packets(spark, sf_dir).select("seq", (F.col("ts_us") * 1000).alias("ts_ns"), frame(shape, body).alias("frame"))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames(seq, ts_ns, frame) of the packets as they are, with payloads of their size."""
    size = F.col("payload_len")
    padded = F.rpad(F.substring(F.col("payload"), F.lit(1), size), size, F.lit(b"\0"))
    body = F.when(_asks(), dns_message(_name(), _qtype(), F.lit(False), F.lit(False))).otherwise(padded)
    return _packets(spark, sf_dir).select("seq", (F.col("ts_us") * 1000).alias("ts_ns"), frame({}, body).alias("frame"))


_HEX6 = "concat('2600:1:2:3:4:5:', {})"
_ASKS = "proto = 'udp' AND (src_port = 53 OR dst_port = 53)"
_NAME = "concat('h', k, 'x', seq % 7, '.', event_type, '.example.org')"
_QTYPE = f"CAST(list_extract({P.QTYPES}, CAST(seq % 4 + 1 AS INT)) AS INT)"

#: CTEs that end in `fields`: a row of decode.RAW, without ts_ns, for each of shaped()'s frames.
FIELDS_SQL = f"""{P.SQL.strip()},
known AS (
  SELECT p.*, e.user_id, e.event_type, e.k, p.seq % 13 AS fault, p.seq % 7 = 3 AS v6, p.seq % 11 = 4 AS more, p.seq % 11 = 5 AS later, {_ASKS} AS asks
  FROM packets p JOIN (SELECT seq, user_id, event_type, k FROM events_) e ON e.seq = p.seq),
sized AS (
  SELECT *, CASE WHEN asks THEN 12 + length({_NAME}) + 2 + 4 + CASE WHEN seq % 4 = 2 THEN 2 ELSE 0 END ELSE length(payload) END AS body_len FROM known),
carried AS (
  SELECT *, CASE proto WHEN 'tcp' THEN CASE WHEN k % 3 = 0 THEN 32 ELSE 20 END + body_len
                       WHEN 'udp' THEN 8 + body_len + CASE WHEN seq % 2 = 0 THEN 4 ELSE 0 END ELSE 8 + body_len END AS transport,
         CASE WHEN v6 THEN {_HEX6.format("printf('%x:%x', 1 + k, user_id % 65535 + 1)")} ELSE peer_ip END AS peer,
         CASE WHEN v6 THEN {_HEX6.format("printf('6:%x', local4 % 256)")} ELSE local_ip END AS local
  FROM sized),
lengths AS (
  SELECT *, CASE WHEN v6 THEN 40 + CASE WHEN k % 2 = 1 THEN 8 ELSE 0 END + CASE WHEN more OR later THEN 8 ELSE 0 END ELSE CASE WHEN seq % 5 = 1 THEN 24 ELSE 20 END END + transport AS total FROM carried),
fields AS (
  SELECT seq, ts_us, CASE WHEN v6 THEN 6 ELSE 4 END AS family, CASE WHEN direction = 'inbound' THEN peer ELSE local END AS src_ip, CASE WHEN direction = 'inbound' THEN local ELSE peer END AS dst_ip,
         CASE proto WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 ELSE CASE WHEN v6 THEN 58 ELSE 1 END END AS ip_proto, CAST(total AS INT) AS ip_total_len, more OR later AS fragmented, NOT later AS first_fragment,
         CASE WHEN NOT later THEN src_port END AS src_port, CASE WHEN NOT later THEN dst_port END AS dst_port, CASE WHEN NOT later THEN tcp_flags END AS tcp_flags,
         CASE WHEN proto = 'icmp' AND NOT later THEN CAST(list_extract(CASE WHEN v6 THEN [128, 129, 1] ELSE [8, 0, 3] END, CAST(seq % 3 + 1 AS INT)) AS INT) END AS icmp_kind,
         CASE WHEN proto = 'icmp' AND NOT later THEN k % 4 END AS icmp_code, CASE WHEN proto = 'icmp' AND NOT later THEN seq % 3 < 2 END AS icmp_echo,
         CASE WHEN asks AND NOT later THEN {_NAME} END AS qname, CASE WHEN asks AND NOT later THEN {_QTYPE} END AS qtype, CASE WHEN asks AND NOT later THEN 1 END AS qclass, CASE WHEN asks AND NOT later THEN seq % 2 = 1 END AS dns_response,
         CAST(CASE WHEN later THEN 0 ELSE body_len END AS INT) AS payload_len, CASE WHEN later THEN '' WHEN NOT asks THEN payload END AS payload,
         CAST(14 + 4 * (seq % 3) + total AS INT) AS frame_len, direction, v6, fault,
         CASE fault WHEN 10 THEN CASE WHEN v6 THEN 'ipv6 version' ELSE 'ipv4 header' END WHEN 11 THEN 'unsupported' WHEN 12 THEN 'too short' END AS error
  FROM lengths)"""

#: The names of FIELDS_SQL that a frame loses that can't be decoded.
FIELDS = ["family", "src_ip", "dst_ip", "ip_proto", "ip_total_len", "fragmented", "first_fragment", "src_port", "dst_port", "tcp_flags", "icmp_kind", "icmp_code", "icmp_echo", "qname", "qtype", "qclass", "dns_response", "payload_len", "payload"]


def replayed(sql: str) -> str:
    """SQL over the packets of synthetic.SQL made over those that plain()'s frames tell: names on every port 53, and payloads of their size."""
    of_name = "CASE WHEN proto = 'udp' AND NOT inbound THEN concat('h'"
    asks = "CASE WHEN proto = 'udp' AND ((inbound AND (reflector = 53 OR service = 53)) OR (NOT inbound AND reflector = 53)) THEN"
    old_type = "CASE WHEN proto = 'udp' AND NOT inbound THEN CAST(list_extract("
    old_load = "size AS payload_len, props AS payload"
    for old in (of_name, old_type, old_load):
        assert old in sql, old
    load = f"CAST({asks} 12 + length({_NAME}) + 6 ELSE size END AS INT) AS payload_len, {asks} '' ELSE substr(props, 1, size) END AS payload"
    return sql.replace(of_name, f"{asks} concat('h'").replace(old_type, f"{asks} CAST(list_extract(").replace(old_load, load)
