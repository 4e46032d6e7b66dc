"""The run log: a timestamped headline and indented notes an entry, bounded in size."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.sequence import continuation_groups, last_entries

#: Bytes at which the older half goes.
LIMIT = 256 << 10


def append(path: str, headline: str, notes: list[str] = (), now: datetime | None = None) -> None:
    """Add an entry; line ends within a headline or note become spaces, so an entry stays one."""
    when = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = [f"{when}  {' '.join(headline.split())}", *(f"    {' '.join(n.split())}" for n in notes)]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    if os.path.getsize(path) >= LIMIT:
        with open(path, "rb") as f:
            whole = f.read()
        cut = whole.find(b"\n", len(whole) // 2) + 1
        with open(path + ".new", "wb") as f:
            f.write(whole[cut:])
        os.replace(path + ".new", path)


def entries(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """entry, text, lines of the log at path, optionally the last few. Its size is bounded, so one task orders its lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).where("line <> ''").withColumn("log", F.lit(1))
    found = continuation_groups(lines, "log", "n", "line", ~F.col("line").startswith(" ")).where("entry > 0")
    return (last_entries(found, "log", last) if last else found).drop("log")
