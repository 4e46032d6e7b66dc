"""Mixing sources to target weights.

Method, Efraimidis-Spirakis sampling: each document has an exponential key, scaled by its quality weight (a keyed hash gives
the uniform number, so a run can be repeated). A source's token budget is spent in complete epochs first; what is left is
filled with documents in order of their keys, by a prefix sum of tokens, up to the document that crosses the budget, which is
taken if that brings the sum nearer. Documents are range-partitioned by source and key; prefix sums run over the ranges and
then within them, so no source is one task and no range is larger for what qualities its documents have.

The size of the mix is the largest at which every source that has documents can give its share within max_repeats (or the
given total_tokens; sources that cannot then fall short). Shares of sources without documents are spread over the others in
proportion, and both the asked and the reached share are reported.

Defined results: documents with null, unlisted or zero-share sources, and without tokens, are not in the mix; copies under other
ids are documents of their own; ties of keys go by doc_id; no documents or no targets give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.stage import staged

#: Documents of a range of keys.
BUCKET = 50_000
#: mix_targets is a fixed list; a larger table is an error, as its plan is made on the driver.
TARGETS = 100_000


def plan(found: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """Per target source: share asked and possible, tokens there, budget, complete epochs and what is left for the fraction."""
    there = {
        r.source: r for r in found.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).join(
            F.broadcast(targets.select("source").distinct().limit(TARGETS)), "source", "left_semi"
        ).collect()
    }
    rows = targets.where("source is not null").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    ).limit(TARGETS + 1).collect()
    if len(rows) > TARGETS:
        raise ValueError(f"more than {TARGETS} sources")
    usable = [r for r in rows if (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0 and r.source in there]
    whole = sum(r.target_share for r in usable)
    size = total_tokens if total_tokens is not None else int(min((there[r.source].tokens * r.max_repeats * whole / r.target_share for r in usable), default=0))
    out = []
    for r in sorted(rows, key=lambda r: r.source):
        use = r in usable
        here = there[r.source].tokens if use else 0
        budget = min(round(size * r.target_share / whole), here * r.max_repeats) if use else 0
        epochs = budget // here if here else 0
        out.append(
            {
                "source": r.source,
                "target_share": r.target_share,
                "max_repeats": r.max_repeats,
                "share": r.target_share / whole if use else 0.0,
                "available": here,
                "documents": there[r.source].n if use else 0,
                "budget": budget,
                "epochs": epochs,
                "left": budget - epochs * here
            }
        )
    return out


_PLAN = "source string, target_share double, max_repeats int, share double, available long, documents long, budget long, epochs long, left long"


def _fraction(rows: DataFrame) -> DataFrame:
    """rows with taken: the documents of each source, in order of key, whose tokens sum up to left; the one that crosses is taken if that is nearer.

    rows: source, doc_id, tokens, key, bucket, left. Ranges are summed first, so the windows span a range each."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(along), F.lit(0)).alias("before"))
    ordered = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.join(before, ["source", "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(ordered))
    start = F.col("upto") - F.col("tokens")
    taken = (F.col("upto") <= F.col("left")) | ((start < F.col("left")) & (F.col("upto") - F.col("left") <= F.col("left") - start))
    return upto.withColumn("taken", taken).drop("upto", "before")


def ranged(keyed: DataFrame, documents: int) -> DataFrame:
    """keyed with bucket: its rows in about documents / BUCKET ranges of (source, key, doc_id), balanced by sampling."""
    parts = max(1, -(-documents // BUCKET), min(16, -(-documents // 5000)))
    return staged(keyed.repartitionByRange(parts, "source", "key", "doc_id").withColumn("bucket", F.spark_partition_id()))


def mixed(found: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """source, doc_id, tokens, copies: each document of the mix and how often it is in it. found: doc_id, source, tokens, quality.

    Where the crossing document was too large to take, a second prefix sum over the smaller ones behind it fills what is left."""
    spark = found.sparkSession
    found = staged(found.where("tokens > 0 and source is not null").select("doc_id", "source", "tokens", "quality"))
    plans = plan(found, targets, total_tokens)
    planned = spark.createDataFrame([tuple(p.values()) for p in plans], _PLAN)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
    # one row a source: at most TARGETS
    joined = found.join(
        F.broadcast(planned.where("budget > 0").select("source", "epochs", "left")), "source"
    ).withColumn("key", -F.log(uniform) / F.greatest("quality", F.lit(1e-9)))
    first = staged(_fraction(ranged(joined, sum(p["documents"] for p in plans if p["budget"] > 0))))
    gaps = first.groupBy("source", "left").agg(
        F.sum(F.when(F.col("taken"), F.col("tokens")).otherwise(0)).alias("got")
    ).select("source", (F.col("left") - F.col("got")).alias("gap"))
    rest = first.where("not taken").drop("taken", "left").join(F.broadcast(gaps.where("gap > 0")), "source").where("tokens <= gap").withColumnRenamed("gap", "left")
    more = _fraction(rest).where("taken").select("source", "doc_id", F.lit(1).alias("more"))
    both = first.join(more, ["source", "doc_id"], "left")
    return both.select(
        "source", "doc_id", "tokens", (F.col("epochs") + F.when(F.col("taken") | F.col("more").isNotNull(), 1).otherwise(0)).alias("copies")
    ).where("copies > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, actual_share of the mix's tokens, tokens, documents and the most copies of one."""
    per = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    named = targets.where("source is not null").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    ).join(per, "source", "left")
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row a source
    return named.select(
        "source",
        "target_share",
        "max_repeats",
        F.round(F.coalesce(F.col("tokens") / whole, F.lit(0.0)), 6).alias("actual_share"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "documents", "most_copies")]
    )
