"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source shall give a target number of words.  All its documents have the
same expected number of copies, target / words of the source.  Their prefix sum
over the source, from short documents to long ones, plus one random offset of
the source crosses integers; a document is taken once for each that it crosses.
Copies of a run of documents thus differ from what is expected by less than
one, and because neighbours are of like size, the words taken differ from the
target by less than the longest document.

Expected copies are kept in units of 2^-24, so all sums are exact and do not
depend on how rows lie in partitions; the offset is a hash of seed and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import few, prefix_sums
from .text import prepare

#: Parts of a copy in which expected copies are counted.
UNIT = 1 << 24


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """sources with `weight`: the given weights over and over, by code point of the source, a null one last.  sources has a row for each source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, percent: int, most: int) -> DataFrame:
    """sources (source, source_size, weight) with `target`.

    The targets share `percent` of all words by weight; none is above `most`
    times its source's size, and what that cuts off goes to the others by
    weight until none is above.  That cuts the sources with the least size for
    their weight, each of which is tested against the share that is left once
    those before it are cut.  A table of a row for each source; where even
    `most` of everything is too little, all targets are at it.
    """
    exact = lambda c, digits: c.cast(f"decimal({digits},0)")
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    size, weight = exact(F.col("source_size"), 20), exact(F.col("weight"), 9)
    cut = F.coalesce(exact(F.sum("source_size").over(before), 20), F.lit(0).cast("decimal(20,0)"))
    left = exact(F.sum("source_size").over(everything) * F.lit(percent), 24) - exact(cut * F.lit(100 * most), 24)  # in hundredths of words
    heavy = exact(F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)), 12)
    over = left * weight > size * heavy * F.lit(100 * most)
    known = sources.select("*", over.alias("_over"))
    rest = F.sum(F.when(~F.col("_over"), F.col("weight"))).over(everything)
    free = F.sum("source_size").over(everything) * percent - F.coalesce(F.sum(F.when(F.col("_over"), F.col("source_size"))).over(everything), F.lit(0)) * (100 * most)
    target = F.when(F.col("_over"), (F.col("source_size") * most).cast("double")).otherwise((free * F.col("weight")).cast("double") / (rest * 100).cast("double"))
    return known.withColumn("target", target).drop("_over")


def copies(documents: DataFrame, weights: tuple[int, ...] | DataFrame = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 11) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies) of every row of documents.

    `weights` are a cycle over the sources, or a table (source, weight) with a
    whole weight above 0 for every source; a source that it lacks weighs 1.
    Rows go by themselves: null and repeated ids are rows like others.  Null,
    empty and blank texts have size 0 and are taken like others of their
    source.  A source without words has target 0 and gives nothing.  Ties in
    size go by doc_id, then by place in the table.  An empty table gives an
    empty table, and columns beyond doc_id, text and source are not looked at.
    """
    prepare(documents.sparkSession)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
        F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("_row"),
    ).checkpoint()
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_given"), F.col("weight").cast("long").alias("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("_given")), "left").withColumn("weight", F.coalesce("weight", F.lit(1))).drop("_given")
    else:
        sources = cycled_weights(sources, weights)
    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary"), 256), 1, 6), 16, 10).cast("long")
    plan = targets(sources, percent, most).select(F.col("source").alias("_of"), "source_size", "target", each.alias("_each"), offset.alias("_offset"), F.xxhash64(F.coalesce("source", F.lit("")), F.isnull("source")).alias("_group"))
    dealt = rows.join(few(plan.checkpoint()), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    summed = prefix_sums(dealt.checkpoint(), ["_group"], [F.col("size"), F.col("doc_id"), F.col("_row")], "_each", "_sum")
    crossed = F.expr(f"(_sum + _offset) div {UNIT} - (_sum - _each + _offset) div {UNIT}")
    return summed.select("doc_id", "source", "text_hash", "size", "source_size", "target", crossed.alias("copies"))


def mix(documents: DataFrame, weights: tuple[int, ...] | DataFrame = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 11) -> DataFrame:
    """The mixed table: rows of documents, each as often as it is taken.

    Rows equal in doc_id, source and text stand for each other: as many come
    out as are taken of all of them, with the other columns of one of them.
    """
    taken = copies(documents, weights, percent, most, seed).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    taken = taken.select(F.struct("doc_id", "source", "text_hash").alias("_key"), "_copies")
    keyed = documents.withColumn("_key", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash")))
    once = keyed.dropDuplicates(["_key"])
    return once.join(taken, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(documents.columns)
