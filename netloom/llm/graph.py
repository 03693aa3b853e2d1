"""Connected components of a link table, as DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, component): the least id reachable from each id that has a link.

    Alternates the large-star and small-star contractions until only stars are
    left, which takes a number of rounds logarithmic in the longest path.  A
    hub's edges are summed by partial aggregation, and only its least neighbour
    is joined back; that table is checkpointed first, so both sides of the join
    are plain shuffles which adaptive execution may split at a hub.  Each round
    is cut by a reliable checkpoint.  Self-links and nulls are ignored; an empty
    table gives an empty table.
    """
    edges = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct().checkpoint()
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).checkpoint()
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
            .checkpoint()
        )
    hang = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return hang.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one centre, and no centre on another."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()
