"""Addresses and prefixes: IPv4 as BIGINT, IPv6 as 128 characters of 0 and 1."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Ranges that are not public.
NOT_PUBLIC_V4 = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 198.51.100.0/24 "
    "203.0.113.0/24 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 224.0.0.0/4 240.0.0.0/4"
).split()
NOT_PUBLIC_V6 = "::/128 ::1/128 fc00::/7 fe80::/10 ff00::/8 100::/16 2001:db8::/32 2001::/23 3ffe::/16 5f00::/16".split()
METADATA = ("169.254.169.254/32", "fd00:ec2::/32")


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def stripped(line: Column | str) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def v4_number(ip: Column) -> Column:
    """A dotted address as BIGINT; null if it is none, as with leading zeros.  One match, then cuts that compile."""
    octet = lambda i: F.substring_index(F.substring_index(ip, ".", i), ".", -1).cast("bigint")
    number = reduce(lambda a, b: a * 256 + b, map(octet, (1, 2, 3, 4)))
    return F.when(ip.rlike(rf"^{_OCTET}([.]{_OCTET}){{3}}\z"), number)


def v4_text(number: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


@F.pandas_udf(StringType())
def v6_bits(ip: pd.Series) -> pd.Series:
    """The bits of an IPv6 address (or of an IPv4 one, 32 of them); null if it is none."""

    def bits(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        return f"{int(a):0{a.max_prefixlen}b}"

    return ip.map(bits, na_action="ignore")


def _v4_range(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def in_v4(number: Column, cidrs) -> Column:
    ranges = [_v4_range(c) for c in cidrs if ":" not in c]
    return let(number, lambda n: reduce(lambda a, b: a | b, [n.between(*r) for r in ranges])) if ranges else F.lit(False)


def in_v6(bits: Column, cidrs) -> Column:
    nets = [ipaddress.ip_network(c, strict=False) for c in cidrs if ":" in c]
    heads = [f"{int(n.network_address):0128b}"[: n.prefixlen] for n in nets]
    return let(bits, lambda x: reduce(lambda a, b: a | b, [x.startswith(h) for h in heads])) if heads else F.lit(False)


def is_public_v4(number: Column) -> Column:
    return ~in_v4(number, NOT_PUBLIC_V4)


def is_public_v6(bits: Column) -> Column:
    return ~in_v6(bits, NOT_PUBLIC_V6)


def is_public(family: Column, number: Column, bits: Column) -> Column:
    return F.when(family == 4, is_public_v4(number)).otherwise(is_public_v6(bits))


def mask_v4(ip: Column) -> Column:
    return F.regexp_replace(ip, r"[0-9]+$", "0")


@F.pandas_udf(StringType())
def mask_v6(ip: pd.Series) -> pd.Series:
    return ip.map(lambda x: str(ipaddress.ip_address(int(ipaddress.ip_address(x)) >> 64 << 64)), na_action="ignore")


def mask_ip(ip: Column) -> Column:
    """An address with its last part blanked: /24 of IPv4, /64 of IPv6."""
    return F.when(ip.contains(":"), mask_v6(F.when(ip.contains(":"), ip))).otherwise(mask_v4(ip))


def parse_prefix(token: str) -> tuple[int, int, str] | None:
    """(family, prefix length, prefix bits) of a CIDR or a bare address, host bits dropped."""
    try:
        net = ipaddress.ip_network(token, strict=False)
    except ValueError:
        return None
    return net.version, net.prefixlen, f"{int(net.network_address):0{net.max_prefixlen}b}"[: net.prefixlen]


def direction(src_is_host: Column, dst_is_host: Column) -> Column:
    """outbound wins when both ends are hosts; null when neither is."""
    return F.when(src_is_host, "outbound").when(dst_is_host, "inbound")


def flow_direction(src_is_host: Column, dst_is_host: Column, src_public: Column, dst_public: Column) -> Column:
    """As direction(), else by which ends are public: both, or the source alone, is inbound."""
    fallback = F.when(src_public, "inbound").when(dst_public, "outbound")
    return F.coalesce(direction(src_is_host, dst_is_host), fallback)
