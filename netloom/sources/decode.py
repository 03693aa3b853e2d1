"""Ethernet frames to packet rows, batch by batch.

A frame that can't be decoded gives no packet and counts as an error of its
kind; nothing in a frame can make the decoder raise anything but Undecodable.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions import scalars as S
from ..operators.lookups import address_bits, is_host

SNAPSHOT = 512
NAME_CHARS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_*=")
# IPv6 extension headers that are stepped over.
EXTENSIONS = {0, 43, 60, 135, 139, 140, 253, 254}

RAW = (
    "seq long, ts_ns long, ts_us long, family int, src_ip string, dst_ip string, ip_proto int, ip_total_len int, fragmented boolean, first_fragment boolean, "
    "src_port int, dst_port int, tcp_flags int, icmp_kind int, icmp_code int, icmp_echo boolean, qname string, qtype int, qclass int, dns_response boolean, "
    "payload_len int, payload binary, frame_len int, error string"
)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in RAW.split(", "))])


class Undecodable(Exception):
    pass


def _need(data: bytes, n: int) -> None:
    if len(data) < n:
        raise Undecodable("too short")


def parse_dns(msg: bytes) -> dict:
    """First question of a DNS message."""
    _need(msg, 12)
    flags, questions = struct.unpack_from(">HH", msg, 2)
    if not questions:
        raise Undecodable("no question")
    at, after, hops, labels, length = 12, None, 0, [], 0
    while True:
        if at >= len(msg):
            raise Undecodable("name out of bounds")
        n = msg[at]
        if n == 0:
            at += 1
            break
        if n & 0xC0 == 0xC0:
            if at + 2 > len(msg):
                raise Undecodable("pointer out of bounds")
            target = (n & 0x3F) << 8 | msg[at + 1]
            if target >= len(msg) or target == at + 1:
                raise Undecodable("bad pointer")
            after = after if after is not None else at + 2
            at, hops = target, hops + 1
            if hops > 32:
                raise Undecodable("pointer loop")
            continue
        if n & 0xC0:
            raise Undecodable("reserved label")
        label = msg[at + 1 : at + 1 + n]
        if len(label) < n:
            raise Undecodable("label out of bounds")
        labels.append("".join(chr(b) if b in NAME_CHARS else "." for b in label))
        length += n + (1 if len(labels) > 1 else 0)
        if length > 512:
            raise Undecodable("name too long")
        at += 1 + n
    end = after if after is not None else at
    _need(msg, end + 4)
    qtype, qclass = struct.unpack_from(">HH", msg, end)
    return {"qname": ".".join(labels), "qtype": qtype, "qclass": qclass, "dns_response": bool(flags & 0x8000)}


def _transport(proto: int, data: bytes, row: dict) -> None:
    if proto == 6:
        _need(data, 20)
        offset = (data[12] >> 4) * 4
        if not 20 <= offset <= len(data):
            raise Undecodable("tcp offset")
        row.update(zip(("src_port", "dst_port"), struct.unpack_from(">HH", data)))
        row |= {"tcp_flags": data[13], "payload_len": len(data) - offset, "payload": data[offset : offset + SNAPSHOT]}
    elif proto == 17:
        _need(data, 8)
        src, dst, declared, _ = struct.unpack_from(">HHHH", data)
        body = data[8 : 8 + max(0, declared - 8)]
        row |= {"src_port": src, "dst_port": dst, "payload_len": len(body), "payload": body[:SNAPSHOT]}
        if {src, dst} & {53, 5353}:
            try:
                row |= parse_dns(body)
            except Undecodable:
                pass  # not DNS after all
    elif proto in (1, 58):
        _need(data, 4)
        echo = data[0] in ((8, 0) if proto == 1 else (128, 129))
        size = max(0, len(data) - 8)
        row |= {"icmp_kind": data[0], "icmp_code": data[1], "icmp_echo": echo, "payload_len": size, "payload": data[8 : 8 + SNAPSHOT]}


def decode_frame(frame: bytes) -> dict:
    """The fields of one frame; raises Undecodable."""
    _need(frame, 14)
    kind, data = frame[12:14], frame[14:]
    for _ in range(2):
        if kind in (b"\x81\x00", b"\x88\xa8"):
            _need(data, 4)
            kind, data = data[2:4], data[4:]
    row = {"payload_len": 0, "payload": b"", "fragmented": False, "first_fragment": True, "frame_len": len(frame)}
    if kind == b"\x08\x00":
        _need(data, 20)
        header = (data[0] & 15) * 4
        if data[0] >> 4 != 4 or header < 20:
            raise Undecodable("ipv4 header")
        _need(data, header)
        total, _, fragment, _, proto = struct.unpack_from(">HHHBB", data, 2)
        row |= {"family": 4, "src_ip": str(ipaddress.IPv4Address(data[12:16])), "dst_ip": str(ipaddress.IPv4Address(data[16:20])), "ip_total_len": total}
        row |= {"fragmented": bool(fragment & 0x3FFF), "first_fragment": not fragment & 0x1FFF}
        data = data[header:]
    elif kind == b"\x86\xdd":
        _need(data, 40)
        if data[0] >> 4 != 6:
            raise Undecodable("ipv6 version")
        length, proto = struct.unpack_from(">HB", data, 4)
        row |= {"family": 6, "src_ip": str(ipaddress.IPv6Address(data[8:24])), "dst_ip": str(ipaddress.IPv6Address(data[24:40])), "ip_total_len": min(65535, 40 + length)}
        data = data[40:]
        for _ in range(8):
            if proto in EXTENSIONS:
                _need(data, 2)
                size = (data[1] + 1) * 8
                _need(data, size)
                proto, data = data[0], data[size:]
            elif proto == 44:
                _need(data, 8)
                word = struct.unpack_from(">H", data, 2)[0]
                row |= {"fragmented": bool(word & 1 or word >> 3), "first_fragment": not word >> 3}
                proto, data = data[0], data[8:]
                if not row["first_fragment"]:
                    break
            else:
                break
    else:
        raise Undecodable("unsupported")
    row["ip_proto"] = proto
    if row["first_fragment"]:
        _transport(proto, data, row)
    return row


def peek(frame: bytes) -> tuple[int, int | None, int | None] | None:
    """(protocol, source port, destination port) that decode_frame finds, if it finds any, from fixed places; None where only decoding tells."""
    at = 12
    for _ in range(2):
        if frame[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
            at += 4
    kind, at = frame[at : at + 2], at + 2
    if kind == b"\x08\x00" and len(frame) >= at + 20:
        proto, after, first = frame[at + 9], at + (frame[at] & 15) * 4, not (frame[at + 6] & 0x1F or frame[at + 7])
    elif kind == b"\x86\xdd" and len(frame) >= at + 40 and frame[at + 6] not in EXTENSIONS and frame[at + 6] != 44:
        proto, after, first = frame[at + 6], at + 40, True
    else:
        return None
    if proto not in (6, 17) or not first:
        return proto, None, None
    return (proto, *struct.unpack_from(">HH", frame, after)) if len(frame) >= after + 4 else None


def decoded(frames: list[tuple]) -> pa.RecordBatch:
    """RAW rows of (seq, ts_ns, frame, ...); what can't be decoded keeps its error and no fields. A null frame is an empty one."""
    rows = []
    for seq, ts_ns, frame, *_ in frames:
        try:
            row = decode_frame(frame or b"")
        except Undecodable as e:
            row = {"error": str(e), "frame_len": len(frame or b"")}
        rows.append(row | {"seq": seq, "ts_ns": ts_ns, "ts_us": ts_ns // 1000})
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


def decode(frames: DataFrame) -> DataFrame:
    """frames(seq, ts_ns, frame) to RAW rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decoded(list(zip(*(c.to_pylist() for c in batch.columns))))

    return frames.select("seq", "ts_ns", "frame").mapInArrow(run, RAW)


def packets(raw: DataFrame, hosts: list[str]) -> DataFrame:
    """Decoded frames of or to a host, with a public peer, as packets."""
    way = net.direction(is_host(F.col("src_ip"), hosts), is_host(F.col("dst_ip"), hosts))
    df = raw.where("error is null").withColumn("direction", way).where("direction is not null")
    inbound = F.col("direction") == "inbound"
    df = df.withColumns({"local_ip": F.when(inbound, F.col("dst_ip")).otherwise(F.col("src_ip")), "peer_ip": F.when(inbound, F.col("src_ip")).otherwise(F.col("dst_ip"))})
    return only_public(df).withColumn("proto", S.proto_name(F.col("ip_proto"))).withColumn("ts", F.timestamp_micros("ts_us"))


def only_public(df: DataFrame, ip: str = "peer_ip") -> DataFrame:
    v6 = F.col(ip).contains(":")
    return df.where(F.when(v6, net.is_public_v6(address_bits(F.when(v6, F.col(ip))))).otherwise(net.is_public_v4(net.v4_number(F.col(ip)))))


def counters(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: frames, bytes, parse_errors and skipped (not of a host, or without a public peer)."""
    seen = raw.agg(F.count("*").alias("frames"), F.coalesce(F.sum("frame_len"), F.lit(0)).alias("bytes"), F.count("error").alias("parse_errors"))
    return seen.join(kept.agg(F.count("*").alias("packets"))).withColumn("skipped", F.col("frames") - F.col("parse_errors") - F.col("packets"))
