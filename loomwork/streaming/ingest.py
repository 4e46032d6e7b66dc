"""Incremental ingestion: session logs to a messages table, with offsets that are kept only after the rows are."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, root: str, layout: str = "a") -> DataFrame:
    """New whole lines of the logs below root."""
    from loomwork.sources import register

    register(spark)
    return spark.readStream.format("session_log").option("root", root).option("layout", layout).load()


def append_once(target: str):
    """A foreachBatch writer whose batches are idempotent: a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(target, f"batch={number}"))

    return write


def load_offsets(path: str) -> dict[str, int]:
    """Stored offsets; absent or unreadable means none."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return {str(k): int(v) for k, v in found["offsets"].items()}
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return {}


def save_offsets(path: str, offsets: dict[str, int]) -> None:
    """Write offsets so that a crash leaves the old or the new file whole."""
    _write_whole(path, {"version": 1, "offsets": offsets})


def _write_whole(path: str, value: dict) -> None:
    """Write beside the file and put it in its place at once."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def advanced(lines: DataFrame) -> dict[str, int]:
    """Offsets behind the lines that were read: a row a log file."""
    return {r.path: r.end for r in lines.groupBy("path").agg(F.max(F.col("start") + F.col("size")).alias("end")).collect()}


class Pending:
    """Two-phase hand-over: what a commit will mean is saved before it lands, and applied only if the commit that landed is the one meant."""

    def __init__(self, folder: str):
        self.path = os.path.join(folder, "pending.json")
        self.offsets = os.path.join(folder, "offsets.json")

    def save(self, digest: str, offsets: dict[str, int], note: str | None = None, settles: bool = True) -> None:
        """Keep what the commit will mean. settles: whether something will call settle; if not, the offsets count at once."""
        if settles:
            _write_whole(self.path, {"digest": digest, "offsets": offsets, "note": note})
        else:
            save_offsets(self.offsets, load_offsets(self.offsets) | offsets)

    def settle(self, digest: str) -> dict | None:
        """Apply the pending offsets if the landed message's digest is theirs; drop them in any case. What was applied, else None."""
        try:
            with open(self.path, encoding="utf-8") as f:
                held = json.load(f)
        except (OSError, ValueError):
            return None
        os.remove(self.path)
        if held.get("digest") != digest:
            return None
        save_offsets(self.offsets, load_offsets(self.offsets) | held["offsets"])
        return held
