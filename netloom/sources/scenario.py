"""Frame builders, and the attack scenario in which every rule but the custom one fires."""

from __future__ import annotations

import ipaddress
import struct

from pyspark.sql import DataFrame, SparkSession

HOST, BENIGN = "5.7.9.11", "150.151.152.153"
BASE_NS = 1_700_000_000 * 1_000_000_000
# The scenario's DNS names.
NAMES = [
    "a1b2c3d4e5.tunnel9f.example.org",
    "ff00aa55bb.tunnel1x.example.org",
    "9z8y7x6w.tunnel2q.example.org",
    "deadbeefcafe.tunnel3w.example.org",
    "0123abcdxy.tunnel4e.example.org",
    "q7w8e9r0t1.tunnel5r.example.org",
]


def attacker(n: int) -> str:
    return f"200.201.202.{n}"


def ethernet(payload: bytes, kind: int = 0x0800) -> bytes:
    return b"\x02\0\0\0\0\x01\x02\0\0\0\0\x02" + struct.pack(">H", kind) + payload


def ip(src: str, dst: str, proto: int, body: bytes) -> bytes:
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    if a.version == 6:
        return ethernet(struct.pack(">IHBB", 6 << 28, len(body), proto, 64) + a.packed + b.packed + body, 0x86DD)
    return ethernet(struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0) + a.packed + b.packed + body)


def tcp(src: str, dst: str, sport: int, dport: int, flags: int, payload: bytes = b"") -> bytes:
    return ip(src, dst, 6, struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 1024, 0, 0) + payload)


def udp(src: str, dst: str, sport: int, dport: int, payload: bytes) -> bytes:
    return ip(src, dst, 17, struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload)


def icmp(src: str, dst: str, kind: int, size: int) -> bytes:
    return ip(src, dst, 1, struct.pack(">BBHHH", kind, 0, 0, 1, 1) + bytes(size))


def dns_message(name: str, qtype: int = 1) -> bytes:
    labels = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".") if x)
    return struct.pack(">HHHHHH", 1, 0x0100, 1, 0, 0, 0) + labels + b"\0" + struct.pack(">HH", qtype, 1)


def dns(src: str, dst: str, sport: int, name: str, qtype: int = 1) -> bytes:
    return udp(src, dst, sport, 53, dns_message(name, qtype))


def frames() -> list[tuple[int, bytes]]:
    """(time in nanoseconds, frame) in arrival order, which is not time's."""
    out: list[tuple[int, bytes]] = []

    def at(seconds: int, *more: bytes) -> None:
        out.extend((BASE_NS + seconds * 1_000_000_000, f) for f in more)

    at(0, *(tcp(BENIGN, HOST, 50000 + i, 443, 0x10, bytes(200)) for i in range(2)))
    at(1, *(tcp(attacker(1), HOST, 40000, 1000 + p, 2) for p in range(6)))
    at(2, *(tcp(attacker(2), HOST, 41000, 22, 2) for _ in range(5)))
    at(3, *(tcp(attacker(3), HOST, 42000 + i, 443, (0, 0x29)[i % 2]) for i in range(4)))
    at(4, *(udp(attacker(4), HOST, 33000, 30000, b"hi") for _ in range(12)))
    at(5, *(icmp(attacker(5), HOST, 8, 20) for _ in range(12)))
    at(6, *(icmp(attacker(6), HOST, 8, 600) for _ in range(4)))
    at(7, *(udp(attacker(7), HOST, 53, 45000, bytes(600)) for _ in range(4)))
    for i, name in enumerate(NAMES):
        at(8 + i, dns(HOST, attacker(8), 51000 + i, name))
    for i in range(4):
        at(100 + 60 * i, tcp(HOST, attacker(9), 52000, 9999, 2))
    at(200, tcp(attacker(10), HOST, 43000, 80, 0x10, bytes(10)))
    at(201, tcp(attacker(11), HOST, 44000, 4444, 0x10, bytes(10)))
    at(202, *(tcp(attacker(n), HOST, 46000, 65000, 2) for n in (12, 13, 14)))
    for i in range(25):
        at(300 + i // 10, tcp(attacker(20 + i % 10), HOST, 47000 + i, 80, 2))
    at(302, *(tcp(HOST, attacker(20 + i), 80, 47000 + i, 0x12) for i in range(2)))
    return out


def frame_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, ts, f, 1) for i, (ts, f) in enumerate(frames())], "seq long, ts_ns long, frame binary, linktype int")
