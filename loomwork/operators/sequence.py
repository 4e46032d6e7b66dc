"""Ordered operators: run-length collapse, byte-budget packing, elision, headers. Sizes are UTF-8 bytes.

A session may hold a third of all rows: running values, packing's included, go through scan, whose tasks hold blocks of a
session. prefix_pack is for groups that are small already, as a limited history is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import scan

#: The caps of the ladder: each three quarters of the one before, down to the floor.
CAP, FLOOR, SHARE = 2000, 240, 0.75


def ladder(cap: int = CAP, floor: int = FLOOR) -> list[int]:
    rungs = [cap]
    while (nxt := rungs[-1] * 3 // 4) > floor:
        rungs.append(nxt)
    return [*rungs, floor]


def collapse_repeats(df: DataFrame, group: str, order: str, *same: str) -> DataFrame:
    """Runs of consecutive rows that agree in the given columns: group, first (lowest order), repeats, and the columns."""
    seen = scan.previous(df.where(F.col(group).isNotNull()).select(group, order, *same), [group], [order], list(same), "_before")
    starts = F.col("_before").isNull()
    for c in same:
        starts = starts | ~F.col(c).eqNullSafe(F.col("_before")[c])
    runs = scan.running(seen, [group], [order], F.when(starts, F.col(order)), "_run", how="last")
    return runs.groupBy(group, "_run").agg(F.min(order).alias("first"), F.count("*").alias("repeats"), *[F.min_by(c, order).alias(c) for c in same]).drop("_run")


def repeat_mark(text: Column, repeats: Column) -> Column:
    return F.when(repeats > 1, F.concat(text, F.lit(" ×"), repeats.cast("string"))).otherwise(text)


def tail_pack(df: DataFrame, group: str, order: str, size: Column, budget: int | Column) -> DataFrame:
    """The newest rows whose sizes (and a line end each) fit the budget; nothing behind the first that doesn't."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return scan.running(df.where(F.col(group).isNotNull()), [group], [order], size + 1, "used", descending=True).where(F.col("used") <= limit)


def two_class_pack(df: DataFrame, group: str, order: str, size: Column, filler: Column, budget: int | Column) -> DataFrame:
    """tail_pack of the rows that aren't filler; what they leave of the budget (constant in a group) goes to the newest filler. Keeps used of the class."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    marked = df.where(F.col(group).isNotNull()).withColumn("filler", filler).withColumn("_limit", limit)
    sized = scan.running(marked, [group, "filler"], [order], size + 1, "used", descending=True).where(F.col("used") <= F.col("_limit"))
    taken = sized.where(~F.col("filler")).groupBy(group).agg(F.max("used").alias("_taken"))
    left = F.col("_limit") - F.when(F.col("filler"), F.coalesce("_taken", F.lit(0))).otherwise(F.lit(0))
    return sized.join(taken, group, "left").where(F.col("used") <= left).drop("_taken", "_limit")


def roll_forward(needs: Column, budget: int) -> Column:
    """What each of an array of needs gets: (budget - used) / remaining, oldest first, the last whatever is left; unused shares roll on."""
    n = F.size(needs)
    step = lambda acc, need: F.struct(
        F.array_append(acc["got"], F.least(need, F.floor((F.lit(budget) - acc["used"]) / (n - F.size(acc["got"]))).cast("long"))).alias("got"),
        (acc["used"] + F.least(need, F.floor((F.lit(budget) - acc["used"]) / (n - F.size(acc["got"]))).cast("long"))).alias("used"),
    )
    start = F.struct(F.array().cast("array<bigint>").alias("got"), F.lit(0).cast("long").alias("used"))
    return F.aggregate(needs, start, step)["got"]


def prefix_pack(df: DataFrame, group: list[str], order: str, size: Column, budget: int, reserve: Column) -> DataFrame:
    """The first rows whose sizes fit the budget less the reserve; adds total (rows of the group) and kept."""
    along = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    counted = df.withColumn("total", F.count("*").over(whole))
    fit = counted.withColumn("_used", F.sum(size).over(along)).where(F.col("_used") <= F.lit(budget) - reserve).drop("_used")
    return fit.withColumn("kept", F.count("*").over(whole))


def continuation_groups(lines: DataFrame, group: str, order: str, text: str, starts: Column) -> DataFrame:
    """Entries of a log: a starting line with the continuation lines behind it. Lines before the first start form an entry of their own (number 0)."""
    numbered = scan.running(lines, [group], [order], F.when(starts, 1).otherwise(0), "entry")
    return numbered.groupBy(group, "entry").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_l")).select(
        group,
        F.col("entry").cast("long").alias("entry"),
        F.array_join(F.transform("_l", lambda x: x[text]), "\n").alias("text"),
        F.size("_l").cast("long").alias("lines")
    )


def last_entries(entries: DataFrame, group: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("entry")))
    return entries.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def elisions(df: DataFrame, group: str, order: str, kept: Column) -> DataFrame:
    """group, before, elided: how many rows are left out directly before a kept row (before = its order) or at the end (null)."""
    marked = df.select(group, order, kept.alias("_kept"))
    upto = scan.running(marked, [group], [order], F.when(F.col("_kept"), F.col(order)), "before", how="last", descending=True).where(~F.col("_kept"))
    return upto.groupBy(group, "before").agg(F.count("*").alias("elided"))


def section_starts(df: DataFrame, group: str, order: list[str], section: str, block: Column) -> DataFrame:
    """df with header: whether a row's section differs from the one before it. block rises with the order; see scan."""
    seen = scan.previous(df, [group], order, [section], "_before", block)
    return seen.withColumn("header", F.col("_before").isNull() | ~F.col(section).eqNullSafe(F.col("_before")[section])).drop("_before")


def _prefix_bytes(text: Column, size: int) -> Column:
    """Bytes of the longest prefix of whole characters within size bytes: a byte 10xxxxxx behind the cut continues a character."""
    raw = F.encode(text, "UTF-8")
    inside = lambda k: F.substring(F.hex(F.substring(raw, k + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    out = F.lit(size)
    for k in range(max(size - 3, 0), size + 1):
        out = F.when(~inside(k), k).otherwise(out)
    return out


def best_cap(df: DataFrame, group: str, text: str, budget: int, rungs: list[int] | None = None, overhead: int = 3, allow: int | None = None) -> DataFrame:
    """group, cap, bytes, cut: the largest cap of the ladder at which the group's texts fit allow bytes (SHARE of the budget if not given), else the floor."""
    rungs = rungs or ladder()
    # how long a text is when cut: the longest prefix of whole characters and the ellipsis of 3 bytes
    size = lambda c: F.when(F.octet_length(text) <= c, F.octet_length(text)).otherwise(_prefix_bytes(F.col(text), c) + 3)
    sums = [F.sum(size(c) + overhead).alias(f"_b{c}") for c in rungs]
    cuts = [F.count_if(F.octet_length(text) > c).alias(f"_c{c}") for c in rungs]
    per = df.groupBy(group).agg(*sums, *cuts)
    allow = int(budget * SHARE) if allow is None else allow
    pick = F.lit(rungs[-1])
    for c in reversed(rungs[:-1]):
        pick = F.when(F.col(f"_b{c}") <= allow, c).otherwise(pick)
    chosen = per.withColumn("cap", pick)
    at = lambda p: F.coalesce(*[F.when(F.col("cap") == c, F.col(f"_{p}{c}")) for c in rungs])
    return chosen.select(group, F.col("cap").cast("long").alias("cap"), at("b").cast("long").alias("bytes"), at("c").cast("long").alias("cut"))
