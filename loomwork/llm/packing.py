"""Filling fixed-capacity containers with documents.

Method, vector best-fit: a container has residual capacities of tokens, documents and attention cost (the sum of squared
lengths). Items come in falling size; each goes into the open container that holds it under every constraint and whose
weighted residual norm after it is smallest (rule "norm") or whose weighted dot product with it is largest ("dot").
Items are spread by hash over shards of about SHARD_ITEMS, so a task is bounded and every shard has the same mixture of
sizes; at most about one container a shard stays open.

The attention capacity is a share of the squared token capacity, so it refuses what tokens alone would admit: next to a long text
only little fits. A text whose own cost is above it has a container to itself, and fill_report counts these.

Defined results: a text is whole unless larger than the capacity; then it is cut into pieces of the capacity, the last of
which is packed like a text. Texts without tokens take no space and have a null container. Repeated texts are packed each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.sources.stage import staged

SHARD_ITEMS = 4096
#: pack_limits is a fixed list; a larger table is an error, as every document meets every limit.
LIMITS = 1000
MAX_DOCUMENTS, ATTENTION_SHARE = 512, 0.85
WEIGHTS = (1.0, 0.05, 0.25)


def best_fit(
    sizes: np.ndarray, capacity: int, max_documents: int = MAX_DOCUMENTS, attention: float | None = None, weights: tuple = WEIGHTS, rule: str = "norm"
) -> np.ndarray:
    """Container number of each item; every size must be in 1..capacity. An item whose cost is above attention is alone."""
    attention = float(ATTENTION_SHARE * capacity * capacity) if attention is None else attention
    n = len(sizes)
    wt, wd, wa = weights
    placed = np.zeros(n, np.int64)
    tokens, docs, cost = np.empty(n), np.empty(n), np.empty(n)  # residual shares of the containers
    opened = 0
    live = np.empty(0, np.int64)
    order = np.argsort(-sizes, kind="stable")
    smallest = sizes.min() / capacity if n else 0
    for step, i in enumerate(order):
        t, d, a = sizes[i] / capacity, 1 / max_documents, float(sizes[i]) ** 2 / attention
        if a > 1 + 1e-12:
            placed[i] = opened
            opened += 1
            continue
        rt, rd, ra = tokens[live] - t, docs[live] - d, cost[live] - a
        ok = (rt >= -1e-12) & (rd >= -1e-12) & (ra >= -1e-12)
        if ok.any():
            score = wt * rt * rt + wd * rd * rd + wa * ra * ra if rule == "norm" else -(wt * tokens[live] * t + wd * docs[live] * d + wa * cost[live] * a)
            k = live[int(np.argmin(np.where(ok, score, np.inf)))]
        else:
            k = opened
            opened += 1
            tokens[k] = docs[k] = cost[k] = 1.0
            live = np.append(live, k)
        tokens[k] -= t
        docs[k] -= d
        cost[k] -= a
        placed[i] = k
        if step % 64 == 63:  # containers that hold no further item are closed
            live = live[(tokens[live] >= smallest - 1e-12) & (docs[live] >= d - 1e-12)]
    return placed


def pieces(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """limit_id, capacity_tokens, doc_id, piece_no, token_start, tokens: texts larger than the capacity are cut, others whole."""
    known = limits.where("capacity_tokens > 0").select("limit_id", "capacity_tokens").distinct().limit(LIMITS + 1).collect()
    if len(known) > LIMITS:
        raise ValueError(f"more than {LIMITS} limits")
    if not known:
        each = sizes.select(F.lit(0).alias("limit_id"), F.lit(0).alias("capacity_tokens"), "*").where("false")
    else:
        each = sizes.select(
            F.explode(
                F.array(*[F.struct(F.lit(r.limit_id).alias("limit_id"), F.lit(r.capacity_tokens).alias("capacity_tokens")) for r in known])
            ).alias("l"),
            "doc_id",
            "tokens"
        ).select("l.*", "doc_id", "tokens")
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity_tokens")) - 1).cast("int")
    cut = each.select("limit_id", "capacity_tokens", "doc_id", F.col("tokens").alias("whole"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    start = F.col("piece_no").cast("long") * F.col("capacity_tokens")
    return cut.select(
        "limit_id",
        "capacity_tokens",
        "doc_id",
        "piece_no",
        start.alias("token_start"),
        F.least(F.col("whole") - start, F.col("capacity_tokens").cast("long")).alias("tokens")
    )


def packed(sizes: DataFrame, limits: DataFrame, max_documents: int = MAX_DOCUMENTS, rule: str = "norm", attention_share: float = ATTENTION_SHARE) -> DataFrame:
    """limit_id, capacity_tokens, container, doc_id, piece_no, token_start, tokens; sizes: doc_id, tokens.

    attention_share: the attention capacity as a share of the squared token capacity; from 1 on it never binds."""
    items = pieces(sizes, limits)
    counts = sizes.agg(F.count("*")).first()[0]
    shards = max(1, round(counts / SHARD_ITEMS))
    part = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int")

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True])
        tokens, capacity = rows.tokens.to_numpy(np.int64), int(rows.capacity_tokens.iloc[0])
        bins = best_fit(tokens, capacity, max_documents, attention_share * capacity * capacity, rule=rule)
        rows["container"] = rows.limit_id.astype(str) + "-" + rows["shard"].astype(str) + "-" + pd.Series(bins, index=rows.index).astype(str)
        return rows[["limit_id", "capacity_tokens", "container", "doc_id", "piece_no", "token_start", "tokens"]]

    ddl = "limit_id int, capacity_tokens int, container string, doc_id long, piece_no int, token_start long, tokens long"
    full = F.col("tokens") >= F.col("capacity_tokens")
    fitted = items.where(~full & (F.col("tokens") > 0)).withColumn("shard", part).groupBy("limit_id", "shard").applyInPandas(fill, ddl)
    alone = items.where(full | (F.col("tokens") <= 0)).select(
        F.col("limit_id").cast("int").alias("limit_id"), F.col("capacity_tokens").cast("int").alias("capacity_tokens"), F.when(
            full, F.concat_ws("-", "limit_id", F.lit("full"), "doc_id", "piece_no")
        ).alias("container"), F.col("doc_id").cast("long").alias("doc_id"), F.col("piece_no").cast("int").alias("piece_no"), "token_start", "tokens"
    )
    return fitted.unionByName(alone)


def fill_report(packing: DataFrame, attention_share: float = ATTENTION_SHARE) -> DataFrame:
    """Per limit: containers, documents, tokens, used share of the space, containers at least 95 % full, the largest number of documents
    in one, containers whose one text is above the attention capacity, and the largest attention cost of the others as a share of it."""
    held = packing.where("container is not null").groupBy("limit_id", "capacity_tokens", "container")
    square = F.col("tokens").cast("double") * F.col("tokens")
    limit = attention_share * F.col("capacity_tokens") * F.col("capacity_tokens")
    per = held.agg(F.sum("tokens").alias("used"), F.count("*").alias("n"), F.sum(square).alias("cost")).withColumn("share", F.col("cost") / limit)
    return per.groupBy("limit_id", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("used").alias("tokens"), F.round(
            F.sum("used") / (F.count("*") * F.first("capacity_tokens")), 4
        ).alias("used_share"), F.count_if(
            F.col("used") >= 0.95 * F.col("capacity_tokens")
        ).alias("nearly_full"), F.max("n").alias("most_pieces"), F.max("used").alias("most_used"),
        F.count_if((F.col("share") > 1) & (F.col("n") == 1)).alias("alone"), F.round(
            F.max(F.when((F.col("share") <= 1) | (F.col("n") > 1), F.col("share"))), 4
        ).alias("most_attention"),
    )


def sizes_of(documents: DataFrame, **tokenizer) -> DataFrame:
    """doc_id, tokens, computed once."""
    from loomwork.llm.tokens import sized

    return staged(sized(documents, **tokenizer).select("doc_id", "tokens"))
