"""Once-per-file delivery over touch events, in batch. The streaming form is loomwork.streaming.delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import scan


def once(
    touches: DataFrame,
    session: str,
    order: list[str],
    path: str = "path",
    reset: str = "reset",
    forced: str | None = None,
    block: Column | None = None
) -> DataFrame:
    """The first touch of each file per session since the session's last reset, whether or not rules bind it; forced touches always.

    Resets are a running count per session, in blocks of it (block rises with the order; see scan); the first touch then is a minimum per (session, path, epoch), combined before its shuffle."""
    known = touches.where(F.col(session).isNotNull())
    epochs = scan.running(known, [session], order, F.when(F.col(reset), 1).otherwise(0), "epoch", block=block).where(~F.col(reset) & F.col(path).isNotNull())
    rest = [c for c in touches.columns if c not in (session, path)]
    first = epochs.groupBy(session, path, "epoch").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    kept = first.select(*[F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in touches.columns])
    if forced is None:
        return kept
    return kept.where(~F.coalesce(F.col(forced), F.lit(False))).unionByName(known.where(F.coalesce(F.col(forced), F.lit(False)) & ~F.col(reset)))
