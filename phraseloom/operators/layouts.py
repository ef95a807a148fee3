"""Relative-position encodings and block layouts of the position lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relative(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Adds gap: the distance from the previous occurrence in the document, from the document's start for the first."""
    if "prev" in positions.columns:  # tables of a collection hold the occurrence before
        return positions.withColumn("gap", F.col("pos") - F.coalesce("prev", F.lit(0)))
    before = F.lag("pos", 1).over(Window.partitionBy(*keys, "doc_id").orderBy("pos"))
    return positions.withColumn("gap", F.col("pos") - F.coalesce(before, F.lit(0)))


def absolute(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Adds decoded: the positions that the gaps stand for.  ``ord`` numbers the gaps of a list."""
    return gaps.withColumn("decoded", F.sum("gap").over(Window.partitionBy(*keys, "doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))


def _numbered(lists: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """Adds block, the number of the ``size`` values of its list to which a value belongs.

    A list's ranks come from a count for each (list, slice of values) and the place inside the slice, so a long list is never sorted in one task.
    """
    slice_of = F.floor(F.col(value) / 65_536).cast("long")
    sliced = lists.withColumn("_s", slice_of)
    counted = sliced.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.withColumn("_before", before).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(value)) - 1
    return sliced.withColumn("_r", rank).join(counted, [*keys, "_s"]).withColumn("block", F.floor((F.col("_before") + F.col("_r")) / size).cast("long"))


def blocks(lists: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """keys, block, m, top: blocks of ``size`` values of each list, with their largest value."""
    return _numbered(lists, keys, value, size).groupBy(*keys, "block").agg(F.count("*").alias("m"), F.max(value).alias("top"))


def packed_blocks(lists: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """keys, block, low, top and docs, the ``size`` values of a block in order."""
    values = F.array_sort(F.collect_list(value))
    return _numbered(lists, keys, value, size).groupBy(*keys, "block").agg(F.min(value).alias("low"), F.max(value).alias("top"), values.alias("docs"))


def strided(postings: DataFrame, step: int, width: int = 65_536) -> DataFrame:
    """term, place, doc_id: every ``step``-th document of each list, from the first.  Lists are numbered by slices of documents, so a long one is no single task."""
    rows = postings.select("term", "doc_id").withColumn("s", F.floor(F.col("doc_id") / width))
    before = F.sum("n").over(Window.partitionBy("term").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    slices = rows.groupBy("term", "s").agg(F.count("*").alias("n")).select("term", "s", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("term", "s").orderBy("doc_id")) - 1
    return rows.withColumn("inside", inside).join(slices, ["term", "s"]).select("term", (F.col("before") + F.col("inside")).alias("place"), "doc_id").where(F.col("place") % step == 0)
