"""Rebuilding conversations from message rows.

Method: the turns of a session form a reply graph - each turn answers the nearest turn of the other role before it, and a line
without a time of its own follows the nearest earlier line that has one - that Kahn's algorithm sorts with timestamp (then line
number) tie-breaking; nodes that are left over lie on or behind cycles and break their session. Alternation and completeness are
read off the graph: in a whole conversation every user turn has a reply and every assistant turn answers one, so the first turn
is the user's, the last the assistant's and no two prompts follow each other. Broken, empty and unanswered conversations are dropped.

A session may hold a third of all rows, so no session is gathered: times are carried forward within blocks of line
numbers and then between blocks, turns are range-partitioned by (session, time, line), each range is sorted by Kahn's
algorithm by itself (an edge from an earlier range is already satisfied, as ranges are ordered like their nodes), and the
ranges' summaries - a row per session and range - give turn numbers and join replies to prompts across their borders.

Defined results: rows without session or line number belong to no conversation; of rows with the same session (without
letter case) and line number the lowest entry_id counts; a null sidechain flag means that the line is not on a sidechain; a null message is unreadable.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.times import instant
from loomwork.sources.stage import staged

#: Lines of a block within which times are carried forward.
BLOCK_LINES = 4096
#: Nodes of a group that reply_order sorts in one task; a larger group is an error.
GROUP_NODES = 1_000_000
#: Turns of a range of the sort.
RANGE_TURNS = 200_000


def kahn(nodes: Iterable[tuple], edges: Iterable[tuple]) -> tuple[list, list]:
    """(order, leftover) of a reply graph. nodes: (priority, id); edges: (parent id, child id). Among the nodes that are free the
    lowest priority comes first; edges from unknown parents count as satisfied, repeated edges once; leftover nodes lie on or behind a cycle."""
    rank = {node: priority for priority, node in nodes}
    children: dict = {}
    waits = dict.fromkeys(rank, 0)
    for parent, child in set(edges):
        if parent in rank and child in rank:
            children.setdefault(parent, []).append(child)
            waits[child] += 1
    free = [(rank[n], n) for n, w in waits.items() if not w]
    heapq.heapify(free)
    order = []
    while free:
        _, node = heapq.heappop(free)
        order.append(node)
        for child in children.get(node, ()):
            waits[child] -= 1
            if not waits[child]:
                heapq.heappush(free, (rank[child], child))
    done = set(order)
    return order, [n for n in rank if n not in done]


def _opened(text: Column) -> Column:
    """The JSON text of an object, or of the object that a JSON string holds."""
    return F.when(F.ltrim(text).startswith('"'), F.try_variant_get(F.try_parse_json(text), "$", "string")).otherwise(text)


def lines(log_entries: DataFrame) -> DataFrame:
    """session_id, line_no, entry_id, at, main, readable, user: what the conversation needs of each line, messages read in the JVM.

    main: a non-sidechain line of type user or assistant; user: true or false for a turn, null for none."""
    v = F.try_parse_json(_opened(F.col("message")))
    part = "array<struct<type:string,text:string>>"
    read = log_entries.where("session_id is not null and line_no is not null").select(
        F.lower("session_id").alias("session_id"), "line_no", "entry_id", instant(F.col("ts")).alias("at"), "entry_type", "is_sidechain", "prompt_id", v.alias("v")
    )
    kind = F.schema_of_variant("v")
    typed = read.select(
        "*",
        (F.coalesce(kind, F.lit("")).startswith("OBJECT")).alias("readable"),
        F.lower(F.try_variant_get("v", "$.role", "string")).alias("role"),
        F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.content", "variant")), F.lit("")).alias("shape"),
        F.try_variant_get("v", "$.content", "string").alias("plain"),
        F.try_variant_get("v", "$.content", "array<variant>").alias("parts"),
    )
    array = F.col("shape").startswith("ARRAY")
    part_type = lambda p: F.try_variant_get(p, "$.type", "string")
    filled = lambda c: c.rlike(r"(?U)\S")
    has_text = F.when(F.col("shape") == "STRING", filled(F.col("plain"))).when(
        array,
        F.exists(
            "parts",
            lambda p: F.coalesce(
                (part_type(p) == "text") & (
                    F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING"
                ) & filled(F.try_variant_get(p, "$.text", "string")),
                F.lit(False)
            )
        )
    )
    has_result = F.coalesce(array & F.exists("parts", lambda p: F.coalesce(part_type(p) == "tool_result", F.lit(False))), F.lit(False))
    main = F.coalesce(F.col("entry_type").isin("user", "assistant") & ~F.coalesce(F.col("is_sidechain"), F.lit(False)), F.lit(False))
    injected = (F.col("entry_type") == "user") & array & (F.col("prompt_id").isNull() | has_result)
    turn = main & F.coalesce(F.col("readable") & F.col("role").isin("user", "assistant") & has_text & ~injected, F.lit(False))
    return typed.select("session_id", "line_no", "entry_id", "at", main.alias("main"), "readable", F.when(turn, F.col("role") == "user").alias("user"))


def timed(found: DataFrame) -> DataFrame:
    """found, one row per (session_id, line_no), with time: at, else that of the nearest earlier line that has one, and parent: its line_no."""
    block = F.floor(F.col("line_no") / BLOCK_LINES)
    cols = ["entry_id", "at", "main", "readable", "user"]
    first = found.groupBy("session_id", "line_no").agg(F.min(F.struct(*cols)).alias("x")).select("session_id", "line_no", "x.*").withColumn("block", block)
    first = staged(first)
    own = F.when(F.col("at").isNotNull(), F.struct("at", "line_no"))
    inside = first.withColumn("near", F.last(own, ignorenulls=True).over(Window.partitionBy("session_id", "block").orderBy("line_no")))
    ends = first.where("at is not null").groupBy("session_id", "block").agg(F.max_by(F.struct("at", "line_no"), "line_no").alias("end"))
    # a row per block: blocks without a time are added, so that every block knows the one before
    all_blocks = first.select("session_id", "block").distinct().join(ends, ["session_id", "block"], "left")
    carried = all_blocks.withColumn(
        "before", F.last("end", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ).select("session_id", "block", "before").where("before is not null")
    whole = inside.join(carried, ["session_id", "block"], "left").withColumn("near", F.coalesce("near", "before"))
    return whole.select("session_id", "line_no", *cols, F.col("near.at").alias("time"), F.when(F.col("at").isNull(), F.col("near.line_no")).alias("parent"))


_RANKED = "session_id string, range int, entry_id long, rank long, user boolean, answers long, replies long"
_RANKED_ARROW = pa.schema(
    [
        ("session_id", pa.string()),
        ("range", pa.int32()),
        ("entry_id", pa.int64()),
        ("rank", pa.int64()),
        ("user", pa.bool_()),
        ("answers", pa.int64()),
        ("replies", pa.int64())
    ]
)


def reply_edges(turns: list[tuple]) -> list[tuple]:
    """(answered, answering) of turns (priority, id, user): each answers the nearest one of the other role before it."""
    last: dict[bool, object] = {}
    edges = []
    for _, node, user in sorted(turns):
        if (not user) in last:
            edges.append((last[not user], node))
        last[user] = node
    return edges


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reply graph of each session's turns within a range, sorted by Kahn's algorithm. A range is one task, its rows arrive by
    session. rank: the place within the range, null for what is left over; answers: the rank of the turn that is answered, null where
    that is not in the range; replies: how many turns of the range answer this one."""

    def emit(session: str, at: int, rows: list[tuple]) -> pa.RecordBatch:
        nodes = [((t, line), line) for line, t, _, _, _ in rows]
        info = {line: (entry, user) for line, _, _, entry, user in rows}
        replies = reply_edges([((t, line), line, user) for line, t, _, _, user in rows])
        order, left = kahn(nodes, replies + [(parent, line) for line, _, parent, _, _ in rows if parent is not None])
        place = {n: i for i, n in enumerate(order)}
        answered = {child: parent for parent, child in replies}
        count = Counter(parent for parent, child in replies)
        every = order + left
        ranks = [place.get(n) for n in every]
        cols = [
            [session] * len(every),
            [at] * len(every),
            [info[n][0] for n in every],
            ranks,
            [info[n][1] for n in every],
            [place.get(answered.get(n)) for n in every],
            [count[n] for n in every]
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _RANKED_ARROW.types)], schema=_RANKED_ARROW)

    session, at, rows = None, 0, []
    for batch in batches:
        for s, r, line, t, parent, entry, user in zip(*(c.to_pylist() for c in batch.columns)):
            if s != session or r != at:
                if rows:
                    yield emit(session, at, rows)
                session, at, rows = s, r, []
            rows.append((line, t, parent, entry, user))
    if rows:
        yield emit(session, at, rows)


def _graphs(log_entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole, ranked, placed): per session its lines and turns; the sorted turns of sessions without gaps and unreadable lines;
    per session and range what the graph says, with before, the turns of earlier ranges."""
    line = staged(timed(lines(log_entries)))
    whole = line.groupBy("session_id").agg(
        F.count("*").alias("n"), (
            F.max("line_no") - F.min("line_no") + 1
        ).alias("span"), F.count_if(F.col("main") & ~F.col("readable")).alias("unread"), F.count("user").alias("turns")
    )
    sound = whole.where("n = span and unread = 0 and turns > 1").select("session_id", "turns")
    turns = line.where("user is not null").join(sound, "session_id").select(
        "session_id", "line_no", F.coalesce(F.unix_micros("time"), F.lit(-(2**63))).alias("t"), "parent", "entry_id", "user"
    )
    # ranges are ordered by session, time and line, and balanced by sampling; the number of ranges follows the number of turns
    total = sound.agg(F.coalesce(F.sum("turns"), F.lit(0))).first()[0]
    parts = max(1, -(-total // RANGE_TURNS), min(64, -(-total // 20_000)))
    ranged = staged(turns.repartitionByRange(parts, "session_id", "t", "line_no").withColumn("range", F.spark_partition_id()))
    ordered = ranged.repartition(parts, "range").sortWithinPartitions("range", "session_id").select("session_id", "range", "line_no", "t", "parent", "entry_id", "user")
    ranked = staged(ordered.mapInArrow(_ranked, _RANKED))
    open_prompt = F.col("user") & (F.col("replies") == 0)
    summary = ranked.groupBy("session_id", "range").agg(
        F.count("*").alias("n"), F.count_if("user").alias("users"), F.count_if(F.col("rank").isNull()).alias("left_over"),
        F.count_if(open_prompt).alias("open"), F.count_if(
            ~F.col("user") & F.col("answers").isNull()
        ).alias("opening_replies"), F.max_by(open_prompt, "rank").alias("ends_open"),
    )
    along = Window.partitionBy("session_id").orderBy("range")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    # a prompt that ends a range is answered by the replies that open the next one; replies that open a range need a prompt before it
    answered = F.col("ends_open") & (F.coalesce(F.lead("opening_replies").over(along), F.lit(0)) > 0)
    asked = F.coalesce(F.sum("users").over(earlier), F.lit(0)) > 0
    placed = summary.select(
        "session_id", "range", "left_over", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        (F.col("open") - F.when(answered, 1).otherwise(0)).alias("unanswered"), F.when(asked, 0).otherwise(F.col("opening_replies")).alias("unasked"),
    )
    return whole, ranked, placed


def conversations(log_entries: DataFrame) -> DataFrame:
    """session_id, turn_no, entry_id of the turns of every whole conversation, in order."""
    _, ranked, placed = _graphs(log_entries)
    kept = placed.groupBy("session_id").agg(F.sum(F.col("left_over") + F.col("unanswered") + F.col("unasked")).alias("faults")).where("faults = 0").select("session_id")
    offsets = placed.select("session_id", "range", "before").join(kept, "session_id", "left_semi")
    return ranked.join(offsets, ["session_id", "range"]).select("session_id", (F.col("before") + F.col("rank")).alias("turn_no"), "entry_id")


def session_report(log_entries: DataFrame) -> DataFrame:
    """One row per session: lines, turns, missing (line numbers), unread (lines), unanswered (prompts), unasked (replies), left_over
    (turns on or behind cycles) and kept. The last three are null where gaps or unreadable lines broke the session before its graph was made."""
    whole, _, placed = _graphs(log_entries)
    faults = placed.groupBy("session_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("unanswered", "unasked", "left_over")])
    kept = F.coalesce(F.col("unanswered") + F.col("unasked") + F.col("left_over") == 0, F.lit(False))
    return whole.join(faults, "session_id", "left").select(
        "session_id", F.col("n").alias("lines"), "turns", (
            F.col("span") - F.col("n")
        ).alias("missing"), "unread", "unanswered", "unasked", "left_over", kept.alias("kept")
    )


def reply_order(df: DataFrame, group: str, node: str, parent: str, priority: str) -> DataFrame:
    """group, node, place, cyclic of explicit reply links, by Kahn's algorithm per group (a group of more than
    GROUP_NODES is an error, as a task holds it; conversations() is the way for any size). place counts from 0 and is null, and cyclic true, for nodes on or behind a cycle. Null parents are roots."""

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(node).drop_duplicates(node)
        nodes = [((p is None or pd.isna(p), None if pd.isna(p) else p, n), n) for p, n in zip(rows[priority], rows[node])]
        nodes = [((k[0], 0 if k[1] is None else k[1], k[2]), n) for k, n in nodes]
        done, left = kahn(nodes, [(p, n) for p, n in zip(rows[parent], rows[node]) if not pd.isna(p)])
        return pd.DataFrame(
            {
                group: rows[group].iloc[0],
                node: done + left,
                "place": pd.array([*range(len(done)), *[None] * len(left)], "Int64"),
                "cyclic": [False] * len(done) + [True] * len(left)
            }
        )

    kinds = dict(df.dtypes)
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest > GROUP_NODES:
        raise ValueError(f"a group of {largest} nodes; more than {GROUP_NODES} don't go into one task")
    return df.where(F.col(node).isNotNull() & F.col(group).isNotNull()).select(group, node, parent, priority).groupBy(group).applyInPandas(
        order, f"`{group}` {kinds[group]}, `{node}` {kinds[node]}, place long, cyclic boolean"
    )
