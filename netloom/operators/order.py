"""Tables in a total order, dealt out by ranges so that no key is one task's work."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share.

    Where it is unset, which only a session on this machine may leave so, a
    folder of this machine is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file:///tmp/netloom-checkpoints"
    return folder


def _checkpoints(spark: SparkSession) -> str:
    """The session's folder of reliable checkpoints."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet beside the checkpoints, for loops of joins.

    A checkpoint's plan keeps the estimated size of what it was made of, and a
    join multiplies those: in a loop the number's digits double with each
    round, and so does the driver's time.  Files have the size they have.
    """
    folder = f"{_checkpoints(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def pieces(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """df dealt out by ranges of (key, order), with the number of its range as `_piece`; stored, so every reader sees the same ranges."""
    return stored(df.repartitionByRange(key, *order).withColumn("_piece", F.spark_partition_id()))


def ranked(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with `pos`, from 1 within each key; a key that spans many pieces is counted in all of them at once."""
    dealt = pieces(df, key, F.col(order))
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy("_piece", key).count().select("_piece", key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_piece", key).orderBy(order))
    return stored(dealt.withColumn("pos", inside).join(held, ["_piece", key]).withColumn("pos", F.col("pos") + F.col("_before")).drop("_piece", "_before"))


def first_at_or_after(points: DataFrame, key: str, at: str, probe: Column, value: str, name: str) -> DataFrame:
    """An as-of join: points with `name`, the `value` of the key's first point (by `at`, then `value`) whose `at` is not below `probe`.

    Points and their probes are put into one order and dealt out by ranges.
    Inside a range the answer is a running value, read backwards; where the
    range has none, it is the first one of a later range, of which there is a
    row a range and key.
    """
    hits = points.select(key, F.col(at).alias("_t"), F.lit(0).alias("_asks"), F.col(value).alias("_of"))
    asks = points.select(key, probe.alias("_t"), F.lit(1).alias("_asks"), F.col(value).alias("_of"))
    # by time, a hit before a probe of the same time when read backwards
    dealt = pieces(hits.unionByName(asks), key, F.col("_t"), F.col("_asks").desc(), F.col("_of"))
    hit = F.when(F.col("_asks") == 0, F.col("_of"))
    later = Window.partitionBy(key).orderBy("_piece").rowsBetween(1, Window.unboundedFollowing)
    heads = dealt.groupBy("_piece", key).agg(F.min(F.when(F.col("_asks") == 0, F.struct("_t", "_of"))).alias("_head"))
    heads = heads.select("_piece", key, F.first("_head._of", ignorenulls=True).over(later).alias("_later"))
    back = Window.partitionBy("_piece", key).orderBy(F.col("_t").desc(), "_asks", F.col("_of").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_here", F.last(hit, ignorenulls=True).over(back)).where("_asks = 1").join(heads, ["_piece", key])
    return found.select(key, F.col("_of").alias(value), F.coalesce("_here", "_later").alias(name))
