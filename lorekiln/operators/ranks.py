"""Row numbers inside groups of which one may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.session import settled


def rank_in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based row number of each row within its group, cutting hot groups into ranges of the order itself.

    Ties and repeated values are cut as well as any other rows, as long as `order` is total. The ranges are written down, so
    the numbers are exact whatever was sampled for them. Other columns pass through; an empty input gives an empty output.
    """
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in group]
    ranges = settled(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    return rank_in_buckets(ranges, group, F.col("__range"), order, name).drop("__range")


def rank_in_buckets(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based row number of each row within its group, sorting only (group, bucket) cells.

    `bucket` is any deterministic expression that never decreases along `order`; it is what splits a hot group over tasks.
    The counts of the cells are pre-aggregated on the map side, their running sum is the offset of each cell.
    Nulls in group columns form a group of their own; `order` has to be total for a reproducible number.
    An empty input gives an empty output; other columns pass through.
    """
    cell, pos, off = "__cell", "__pos", "__off"
    rows = df.withColumn(cell, bucket)
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\x00")).alias(f"__g{i}") for i, g in enumerate(group)]
    names = [f"__g{i}" for i in range(len(group))]
    rows = rows.select("*", *keys)
    counts = rows.groupBy(*names, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*names).orderBy(F.col(cell).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*names, F.col(cell).alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(off))
    numbered = rows.withColumn(pos, F.row_number().over(Window.partitionBy(*names, cell).orderBy(*order)))
    same = [numbered[n] == offsets[n] for n in names]
    joined = numbered.join(offsets, [*same, numbered[cell].eqNullSafe(offsets["__c"])], "inner")
    return joined.select(*[numbered[c] for c in df.columns], (F.col(pos) + F.col(off)).cast("long").alias(name))


def sum_before(df: DataFrame, group: Sequence[str], order: str, value: str, name: str, block: int = 1024) -> DataFrame:
    """Add the sum of `value` over the rows of the group with a smaller `order`, a non-negative integer unique in its group.

    The sum has two levels, blocks of `block` numbers and rows inside a block, so no task sorts more than a block or the
    list of blocks of a group. Group columns must not be null. Null values count as 0.
    """
    rows = df.withColumn("__b", F.floor(F.col(order) / block))
    v = F.coalesce(F.col(value), F.lit(0))
    blocks = rows.groupBy(*group, "__b").agg(F.sum(v).alias("__s"))
    earlier = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*group, "__b", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*group, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("__i", F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return summed.join(offsets, [*group, "__b"], "inner").select(*df.columns, (F.col("__i") + F.col("__o")).alias(name))
