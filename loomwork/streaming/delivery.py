"""Once-per-file delivery as a stream: keyed state of the files a session was served, cleared by its resets.

    served = once_stream(touches)          # session, seq, path, reset [, forced]

Within a micro-batch a session's touches are handled in order of seq. Negative results are kept too: a file without rules is
looked up once. A session's state goes when it is reset, or when it was silent for ttl. Keyed state needs Spark's RocksDB provider
(spark.sql.streaming.stateStore.providerClass)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

OUT = StructType([StructField("session", StringType()), StructField("seq", LongType()), StructField("path", StringType())])


class Once(StatefulProcessor):
    """State: path -> seq of its delivery since the session's last reset."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.served = handle.getMapState(
            "served", StructType([StructField("path", StringType())]), StructType([StructField("seq", LongType())]), ttlDurationMs=self.ttl_ms
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(rows).sort_values("seq", kind="stable").itertuples(index=False):
            if row.reset:
                self.served.clear()
            elif row.path is not None and row.path == row.path:
                known = self.served.containsKey((row.path,))
                if row.forced or not known:
                    out.append((key[0], row.seq, row.path))
                if not known and not row.forced:
                    self.served.updateValue((row.path,), (row.seq,))
        yield pd.DataFrame(out, columns=["session", "seq", "path"])

    def close(self) -> None:
        pass


def once_stream(touches: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """session, seq, path of the touches to serve. touches(session string, seq long, path string, reset boolean [, forced boolean])."""
    forced = F.coalesce("forced", F.lit(False)) if "forced" in touches.columns else F.lit(False)
    rows = touches.where("session is not null").select(
        "session",
        F.col("seq").cast("long").alias("seq"),
        "path",
        F.coalesce("reset", F.lit(False)).alias("reset"),
        forced.cast(BooleanType()).alias("forced")
    )
    return rows.groupBy("session").transformWithStateInPandas(
        statefulProcessor=Once(ttl_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )


#: An event is read up to so many bytes; a longer one is none. A fixed value.
EVENT_BYTES = 1 << 20


def _readable(column: str) -> Column:
    """The variant of an event's text; null if it can't be read or is too long to be one."""
    return F.when(F.octet_length(column) <= EVENT_BYTES, F.try_parse_json(column))


def touch_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """session, path, reset, forced, dir of raw hook events (JSON text); unreadable and overlong events, and those without session, drop out.

    A compaction or the end of a session resets it."""
    from loomwork.functions import payload

    v = _readable(column)
    read = raw.select("*", v.alias("_v")).where("_v is not null")
    name = payload.text_at(F.col("_v"), "$.hook_event_name")
    reset = F.coalesce(F.lower(F.regexp_replace(name, "[^A-Za-z]", "")).isin("precompact", "sessionend"), F.lit(False))
    keep = [c for c in raw.columns if c != column]
    found = read.select(
        *keep,
        payload.event_session(F.col("_v")).alias("session"),
        payload.event_path(F.col("_v")).alias("path"),
        reset.alias("reset"),
        payload.event_dir(F.col("_v"), F.lit(".")).alias("dir")
    )
    return found.where("session is not null and (path is not null or reset)")


def touch_trace(raw: DataFrame, contexts: DataFrame, column: str = "value") -> DataFrame:
    """event, tool, session, path_key, path, bytes, why: a row per raw event for who wants to know why something was (not) served.

    path_key is the key that named the path, bytes the size of the path's text in contexts(path, text), why the reason for no bytes."""
    from loomwork.functions import payload

    v = F.col("_v")
    keys = [("tool_input." + k, f"$.tool_input.{k}") for k in payload.EVENT_PATH_KEYS] + [(k, f"$.{k}") for k in payload.EVENT_TOP_KEYS]
    used = F.coalesce(*[F.when(payload.nonempty(payload.text_at(v, at)).isNotNull(), F.lit(name)) for name, at in keys])
    read = raw.select(_readable(column).alias("_v")).select(
        "_v", payload.text_at(v, "$.hook_event_name").alias("event"), payload.text_at(v, "$.tool_name").alias("tool"), payload.event_session(v).alias("session"),
        used.alias("path_key"), payload.event_path(v).alias("path"),
    )
    sized = read.join(contexts.select("path", F.octet_length("text").cast("long").alias("bytes")), "path", "left")
    why = (
        F.when(F.col("_v").isNull(), "unreadable event")
        .when(F.col("session").isNull(), "no session")
        .when(F.col("path").isNull(), "no path")
        .when(F.col("bytes").isNull(), "no rules for the path")
    )
    return sized.select("event", "tool", "session", "path_key", "path", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), why.alias("why"))


def serve_batches(served: DataFrame, contexts: DataFrame) -> DataFrame:
    """Stream-static join: the served touches with the text of their path; paths without rules have none and drop out."""
    return served.join(contexts.select("path", "text"), "path")
