"""Running sums in a total order over tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

#: Rows of one piece of the order, about.
PIECE_ROWS = 100_000
#: Rows of a side that may be broadcast, at most.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has few rows; df should be a checkpoint, as it is counted here."""
    return F.broadcast(df) if df.count() <= FEW else df


def prefix_sums(rows: DataFrame, groups: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """rows with a column `name`: the sum of `value` over their group, in the given order, up to and including the row.

    The rows are dealt out by ranges of (group, order), so a group with most of
    the rows lies over many tasks.  Sums run inside each piece; what the pieces
    before hold is added from a table of a row for each piece and group.  The
    dealt rows are checkpointed: both readers see the same pieces, also after
    an executor is lost.  Group columns are not null; `order` should end in a
    column without ties, and rows should come from a table that is read again
    in the same way (a checkpoint or files).
    """
    spark = rows.sparkSession
    wanted = 4 * T.pieces_of(spark, rows.count(), PIECE_ROWS)
    dealt = rows.repartitionByRange(wanted, *groups, *order).withColumn("_piece", F.spark_partition_id()).checkpoint()
    held = dealt.groupBy("_piece", *groups).agg(F.sum(value).alias("_held"))
    before = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_piece", *groups, F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before")).checkpoint()
    inside = Window.partitionBy("_piece", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn(name, F.sum(value).over(inside)).join(few(held), ["_piece", *groups])
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_piece", "_before")
