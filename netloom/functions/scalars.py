"""Scalar functions over packet fields, as JVM expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32


def has(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == mask


def lacks(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == 0


def is_null_scan(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(255)) == 0


def is_xmas(flags: Column) -> Column:
    return has(flags, FIN | PSH | URG) & lacks(flags, SYN | ACK | RST)


def is_syn_only(flags: Column) -> Column:
    return has(flags, SYN) & lacks(flags, ACK | RST | FIN)


def is_fin_only(flags: Column) -> Column:
    return has(flags, FIN) & lacks(flags, SYN | ACK | RST)


def is_invalid(flags: Column) -> Column:
    return is_null_scan(flags) | is_xmas(flags) | is_fin_only(flags) | has(flags, SYN | FIN) | has(flags, SYN | RST)


def combo_name(flags: Column) -> Column:
    return (
        F.when(is_null_scan(flags), "NULL")
        .when(is_xmas(flags), "XMAS")
        .when(has(flags, SYN | FIN), "SYN+FIN")
        .when(has(flags, SYN | RST), "SYN+RST")
        .when(is_fin_only(flags), "FIN-only")
        .otherwise("invalid")
    )


def flag_bits(flags: Column) -> Column:
    names = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")
    return F.struct(*(has(flags, 1 << i).alias(n) for i, n in enumerate(names)))


def is_new_connection(proto: Column, flags: Column) -> Column:
    return (proto == "tcp") & F.coalesce(is_syn_only(flags), F.lit(False))


def proto_name(ip_proto: Column) -> Column:
    return F.when(ip_proto == 6, "tcp").when(ip_proto == 17, "udp").when(ip_proto.isin(1, 58), "icmp").otherwise(F.concat(F.lit("ip/"), ip_proto.cast("string")))


def shannon_entropy(text: Column) -> Column:
    """Bits per character; an empty text has none."""
    n = F.length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    shares = F.transform(chars, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda h, p: h - p * F.log2(p))


def longest_label(name: Column) -> Column:
    return F.array_max(F.transform(F.split(name, "[.]"), lambda x: F.length(x)))


def base_domain(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


def join_ports(ports: Column, most: int = 10) -> Column:
    """The lowest ports, and how many more there are."""
    ordered = F.array_sort(F.array_distinct(ports))
    more = F.size(ordered) - most
    return F.concat(F.array_join(F.slice(ordered, 1, most).cast("array<string>"), ","), F.when(more > 0, F.concat(F.lit(",+"), more.cast("string"))).otherwise(""))


def content_match(payload: Column, needle: bytes, nocase: bool = False, offset: int | None = None, depth: int | None = None) -> Column:
    """Whether the bytes occur in the window of the payload; no bytes never do."""
    if not needle:
        return F.lit(False)
    hay = F.substring(payload, (offset or 0) + 1, depth if depth is not None else 1 << 30)
    hay, text = F.decode(hay, "ISO-8859-1"), needle.decode("latin-1")
    if nocase:  # ASCII letters only
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        hay, text = F.translate(hay, upper, lower), text.translate(str.maketrans(upper, lower))
    return F.coalesce(F.instr(hay, text) > 0, F.lit(False))


def two_digits(x: Column) -> Column:
    """A double of 0 to 2^40 with two digits behind the point, rounded by its exact value, ties to even, as Rust, C and Python do.

    format_string rounds the shortest digits that name the double, so 0.175,
    which is a little less, would become 0.18.
    """
    one = F.lit(Decimal(2**60))  # a fraction of 1/256 and more is a whole number of 2^-60; a smaller one is rounded to none
    hundredths = ((x - F.floor(x)) * float(2**60)).cast("long").cast("decimal(19,0)") * F.lit(Decimal(100))
    over = hundredths % one
    whole = ((hundredths - over) / one).cast("long")
    up = (over * 2 > one) | ((over * 2 == one) & (whole % 2 == 1))
    total = F.floor(x) * 100 + whole + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))


def seconds_between(earlier_us: Column, later_us: Column) -> Column:
    return F.greatest(later_us - earlier_us, F.lit(0)) / 1e6


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def alert_id(*parts: Column) -> Column:
    """A stable id: what made the alert, hashed."""
    return F.substring(F.sha2(F.concat_ws("#", *parts), 256), 1, 16)
