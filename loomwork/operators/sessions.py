"""Sessions and their messages: cleaning, selection and roll-ups.

messages(session_key, seq, ts, role, text, thinking, meta, tools); sessions(session_key, ..., updated_ts). Rows without a
session_key or seq belong to no session and are left out by first_received.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import is_artifact, nonempty, strip_wrappers
from loomwork.operators import scan

#: Parts of a tool's name that mark it as reading only; fixed values.
READING_VERBS = ("read", "view", "grep", "search", "glob", "find", "list", "ls", "fetch", "lookup", "todo", "think", "plan", "diagnostic")


def first_received(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the lowest order. Combined before the shuffle, so repeated rows cost little."""
    rest = [c for c in df.columns if c not in keys]
    held = df.dropna(subset=keys).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return held.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def latest_snapshot(sessions: DataFrame) -> DataFrame:
    """One row per session_key: the newest snapshot, of equal ones the one with the most bytes read."""
    rest = [c for c in sessions.columns if c != "session_key"]
    held = sessions.where("session_key is not null").groupBy("session_key").agg(
        F.max_by(F.struct(*rest), F.struct("updated_ts", "cursor_bytes", "complete", "title", "model", "branch", "cwd")).alias("_row")
    )
    return held.select("session_key", *[F.col("_row")[c].alias(c) for c in rest])


def is_human() -> Column:
    """A genuine human turn: a user's text that no harness injected."""
    return F.coalesce((F.col("role") == "user") & ~F.coalesce(F.col("meta"), F.lit(False)) & nonempty(F.col("text")).isNotNull(), F.lit(False))


def has_signal() -> Column:
    """A row that makes its session worth keeping."""
    said = nonempty(F.col("text")).isNotNull() | nonempty(F.col("thinking")).isNotNull() | (F.coalesce(F.size("tools"), F.lit(0)) > 0)
    return is_human() | F.coalesce((F.col("role") == "assistant") & said, F.lit(False))


def reading_only(name: Column) -> Column:
    """Whether a tool only reads, by a part of its name; an empty or null name does not."""
    return F.coalesce(F.lower(name).rlike("|".join(READING_VERBS)), F.lit(False))


def human_requests(messages: DataFrame) -> DataFrame:
    """session_key, seq, text of each request as typed; of equal requests in a session the first, harness texts left out."""
    typed = messages.where(is_human()).select("session_key", "seq", strip_wrappers(F.col("text")).alias("text"))
    return typed.where(
        (F.col("text") != "") & ~is_artifact(F.col("text"))
    ).groupBy("session_key", "text").agg(F.min("seq").alias("seq")).select("session_key", "seq", "text")


def sessions_with_signal(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_key").agg(F.count("*").alias("messages"), F.bool_or(has_signal()).alias("signal")).where("signal").select("session_key", "messages")


def touched(messages: DataFrame) -> DataFrame:
    """session_key, seq, tool_pos, file_pos, tool, file, error: a row per file that a tool call names."""
    calls = messages.select("session_key", "seq", F.posexplode("tools").alias("tool_pos", "t"))
    return calls.select(
        "session_key",
        "seq",
        "tool_pos",
        F.posexplode("t.files").alias("file_pos", "file"),
        F.col("t.name").alias("tool"),
        F.col("t.error").alias("error")
    ).where("file <> ''")


def touched_files(messages: DataFrame) -> DataFrame:
    """session_key, place, file: distinct files, most recent message first, in the message in order."""
    last = touched(messages).groupBy("session_key", "file").agg(
        F.max(F.struct(F.col("seq"), (-F.col("tool_pos")).alias("tool"), (-F.col("file_pos")).alias("pos"))).alias("at")
    )
    flat = last.select("session_key", "file", "at.seq", "at.tool", "at.pos")
    return scan.running(
        flat, ["session_key"], ["seq", "tool", "pos"], F.lit(1), "n", descending=True
    ).select("session_key", (F.col("n") - 1).cast("long").alias("place"), "file")


def written_files(messages: DataFrame) -> DataFrame:
    """session_key, file of every call that may have written."""
    return touched(messages).where(~reading_only(F.col("tool"))).select("session_key", "file").distinct()


def suffixes(path: Column) -> Column:
    """path and everything after each of its slashes, without a leading ./ or /."""
    steps = F.split(F.regexp_replace(path, r"^(\./|/)+", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"))


def wrote_any(written: DataFrame, staged_files: DataFrame) -> DataFrame:
    """sha, session_key: the sessions that wrote a file of a commit. A written path matches if the staged path is all of it or its end
    behind a slash; the suffixes of each path are exploded, so it is an equi-join."""
    ends = written.select("session_key", F.explode(suffixes(F.col("file"))).alias("path")).distinct()
    return ends.join(staged_files.select("sha", F.regexp_replace("path", r"^(\./)+", "").alias("path")).distinct(), "path").select("sha", "session_key").distinct()


def relevant(candidates: DataFrame, written: DataFrame, staged_files: DataFrame) -> DataFrame:
    """candidates(sha, session_key) that wrote a file of their commit, with hit; all of a commit's candidates where none did or nothing is staged.
    skipped: how many of the commit's candidates are left out."""
    hits = wrote_any(written, staged_files.join(candidates.select("sha").distinct(), "sha", "left_semi")).withColumn("hit", F.lit(True))
    marked = candidates.select("sha", "session_key").distinct().join(hits, ["sha", "session_key"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    of = marked.groupBy("sha").agg(F.count_if("hit").alias("matched"), F.count("*").alias("candidates"))
    kept = marked.join(of, "sha").where("hit or matched = 0")
    return kept.select("sha", "session_key", "hit", F.when(F.col("matched") == 0, 0).otherwise(F.col("candidates") - F.col("matched")).cast("long").alias("skipped"))


def last_human_prompt(messages: DataFrame) -> DataFrame:
    return messages.where(is_human()).groupBy("session_key").agg(F.max("seq").alias("seq"), F.max_by("text", "seq").alias("text"))


def session_span(messages: DataFrame) -> DataFrame:
    """First and last time of each session, and its messages with and without one."""
    return messages.groupBy("session_key").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("ts").alias("dated"), F.count_if(F.col("ts").isNull()).alias("undated")
    )


def last_nonempty(df: DataFrame, key: str, order: str, *columns: str, ignore: dict[str, str] | None = None) -> DataFrame:
    """Per key the last non-empty value of each column; values that start with the column's ignored prefix don't count."""
    picks = []
    for c in columns:
        ok = nonempty(F.col(c)).isNotNull()
        if ignore and c in ignore:
            ok = ok & ~F.col(c).startswith(ignore[c])
        picks.append(F.max_by(F.when(ok, F.col(c)), F.when(ok, F.struct(F.col(order), F.col(c)))).alias(c))
    return df.groupBy(key).agg(*picks)


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """Whether start < ts <= end; a null bound is open, a null ts never inside."""
    return F.coalesce(ts.isNotNull() & (start.isNull() | (ts > start)) & (end.isNull() | (ts <= end)), F.lit(False))


def time_slice(messages: DataFrame, sessions: DataFrame, start: Column, end: Column) -> DataFrame:
    """messages inside (start, end]; undated ones where their session was updated inside. approximate: whether the session's slice holds an undated one."""
    inside = messages.join(sessions.select("session_key", "updated_ts"), "session_key", "left").where(
        F.when(F.col("ts").isNotNull(), in_window(F.col("ts"), start, end)).otherwise(in_window(F.col("updated_ts"), start, end))
    )
    flags = inside.groupBy("session_key").agg(F.bool_or(F.col("ts").isNull()).alias("approximate"))
    return inside.drop("updated_ts").join(flags, "session_key")


def resume(found: DataFrame, offsets: DataFrame) -> DataFrame:
    """Lines at or behind their session's stored offset. found: session_key, start (byte), size (of the whole log so far); a log
    shorter than its offset is read from its beginning; unknown sessions too."""
    known = found.join(offsets.select("session_key", F.col("bytes").alias("offset")), "session_key", "left").withColumn("offset", F.coalesce("offset", F.lit(0)))
    return known.where(F.col("start") >= F.when(F.col("size") < F.col("offset"), 0).otherwise(F.col("offset"))).drop("offset")


def listing(sessions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Each session with how far it was read: unread, part or whole; oldest first by (updated_ts, session_key) for whoever shows it."""
    o = offsets.select("session_key", "bytes")
    read = F.coalesce("bytes", F.lit(0))
    return sessions.join(o, "session_key", "left").select(
        "session_key",
        "agent",
        "updated_ts",
        "title",
        read.cast("long").alias("read_bytes"),
        F.when(read == 0, "unread").when(read < F.col("cursor_bytes"), "part").otherwise("whole").alias("state")
    )


def agent_label(agents: Column, models: Column, distilled_by: Column | None = None) -> Column:
    """agents/models, each distinct, sorted and joined by +; with the distilling model where one is given."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(c, lambda x: nonempty(x).isNotNull()))), "+")
    label = F.concat_ws("/", nonempty(joined(agents)), nonempty(joined(models)))
    return label if distilled_by is None else F.when(
        nonempty(distilled_by).isNotNull(), F.concat(label, F.lit(" (distilled by "), distilled_by, F.lit(")"))
    ).otherwise(label)


def sorted_distinct(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: nonempty(x).isNotNull())))


def union_capped(a: Column, b: Column, cap: int = 3) -> Column:
    """The first cap distinct non-empty items of a and then b."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.filter(both, lambda x: nonempty(x).isNotNull())), 1, cap)


def commit_metadata(linked: DataFrame) -> DataFrame:
    """Per sha: sessions, label and transcript digests of linked(sha, session_key, session_id, agent, model)."""
    per = linked.groupBy("sha").agg(
        F.collect_set("session_id").alias("ids"),
        F.collect_set("agent").alias("agents"),
        F.collect_set("model").alias("models"),
        F.collect_set(F.sha2("session_key", 256)).alias("digests")
    )
    return per.select(
        "sha",
        F.array_join(sorted_distinct(F.col("ids")), ",").alias("session_ids"),
        agent_label(F.col("agents"), F.col("models")).alias("label"),
        F.array_join(F.array_sort("digests"), ",").alias("transcripts")
    )


def oldest_first(sessions: DataFrame) -> DataFrame:
    """Sessions in order of their last update, undated ones first, equal times by session_key."""
    return sessions.orderBy(F.asc_nulls_first("updated_ts"), "session_key")
