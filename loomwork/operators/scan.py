"""Running values over groups of any size, in two levels: within blocks of the order, then over the blocks.

A plain window puts a whole group into one task; here a task holds a block of it, and the upper level a row a block. The block
must rise with the order (its first column divided by a constant, say); groups must not be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of an integer order that a block spans.
BLOCK = 4096


def block_of(order: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(order) / size)


def _sorted(order: list[str], descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in order]


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: Column,
    name: str,
    how: str = "sum",
    block: Column | None = None,
    descending: bool = False
) -> DataFrame:
    """df with name: the sum, or the last value that isn't null, of all rows of the group up to each row in order."""
    held = df.withColumn("_block", block if block is not None else block_of(order[0])).withColumn("_value", value)
    inside = Window.partitionBy(*group, "_block").orderBy(*_sorted(order, descending)).rowsBetween(Window.unboundedPreceding, 0)
    upper = Window.partitionBy(*group).orderBy(F.desc("_block") if descending else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    if how == "sum":
        whole = held.groupBy(*group, "_block").agg(F.sum("_value").alias("_whole"))
        before = whole.select(*group, "_block", F.coalesce(F.sum("_whole").over(upper), F.lit(0)).alias("_carried"))
        result = F.col("_carried") + F.sum("_value").over(inside)
    else:
        at = F.when(F.col("_value").isNotNull(), F.struct(*order))
        pick = F.min_by("_value", at) if descending else F.max_by("_value", at)
        whole = held.groupBy(*group, "_block").agg(pick.alias("_whole"))
        before = whole.select(*group, "_block", F.last("_whole", ignorenulls=True).over(upper).alias("_carried"))
        result = F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carried"))
    return held.join(before, [*group, "_block"]).withColumn(name, result).drop("_block", "_value", "_carried")


def previous(df: DataFrame, group: list[str], order: list[str], columns: list[str], name: str, block: Column | None = None) -> DataFrame:
    """df with name: a struct of the columns' values in the row before, null in a group's first row."""
    held = df.withColumn("_block", block if block is not None else block_of(order[0])).withColumn("_value", F.struct(*columns))
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    ends = held.groupBy(*group, "_block").agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    before = ends.select(*group, "_block", F.lag("_end").over(Window.partitionBy(*group).orderBy("_block")).alias("_carried"))
    return held.join(before, [*group, "_block"]).withColumn(name, F.coalesce(F.lag("_value").over(inside), F.col("_carried"))).drop("_block", "_value", "_carried")
