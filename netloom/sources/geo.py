"""Tables of address ranges, as geography files have them, to prefix tables for the longest-prefix join."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACES = "family int, prefix_len int, prefix_bits string, asn long, country string"
_SPLIT = "family int, prefix_len int, prefix_bits string, asn long, country string, _width decimal(38,0), _line string"


def split_range(first: str, last: str) -> list[tuple[int, int, str]]:
    """The fewest prefixes (family, length, bits) that make up a range of addresses, or a network written as `first` alone; none where it is not one."""
    try:
        if not last:
            nets = [ipaddress.ip_network(first, strict=False)]
        else:
            a, b = ipaddress.ip_address(first), ipaddress.ip_address(last)
            nets = list(ipaddress.summarize_address_range(a, b))
    except (ValueError, TypeError):
        return []
    bits = {4: 32, 6: 128}
    return [(n.version, n.prefixlen, f"{int(n.network_address):0{bits[n.version]}b}"[: n.prefixlen]) for n in nets]


def parse(lines: DataFrame) -> DataFrame:
    """A prefix table (PLACES) of lines `first,last,asn,country` or `network,,asn,country`.

    Ranges of either family need not be aligned; each becomes its fewest
    prefixes.  Of a range inside another the inner one is told: its prefixes
    are as long or longer, and of equal prefixes the one of the narrower range
    stays (then the greater line).  Of ranges that overlap in part, neither
    inside the other, the one with the longer prefix at an address is told.
    Blank lines, comments, and lines without a range are left out; a missing
    number or country is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line in batch.column(0).to_pylist():
                parts = [p.strip().strip('"') for p in (line or "").split("#")[0].split(",")]
                first, last, asn, country = (parts + [""] * 4)[:4]
                found = split_range(first, last)
                width = sum(1 << ((32 if family == 4 else 128) - n) for family, n, _ in found)
                # wider than 38 digits is wider than anything else
                rows += [(*p, int(asn) if asn.isdecimal() else None, country or None, min(width, 10**38 - 1), line) for p in found]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.decimal128(38, 0), pa.string())
            names = [c.split()[0] for c in _SPLIT.split(", ")]
            columns = list(zip(*rows)) or [()] * len(names)
            columns[5] = [Decimal(w) for w in columns[5]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    split = lines.select(lines.columns[0]).mapInArrow(run, _SPLIT)
    best = F.row_number().over(Window.partitionBy("family", "prefix_len", "prefix_bits").orderBy("_width", F.col("_line").desc()))
    return split.withColumn("_nth", best).where("_nth = 1").drop("_nth", "_width", "_line")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The prefix table of a file or folder of such lines."""
    return parse(spark.read.text(path))
