"""Compaction of sessions into payloads of a byte budget: every request, then as much of the rest as fits, reasoning first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import collapse, let, nonempty, short, strip_wrappers, truncate
from loomwork.operators import sequence
from loomwork.operators.sessions import human_requests
from loomwork.sources.stage import staged

#: Byte limits of a rendered message and its lines; fixed values.
BUDGET, TEXT, THINKING, HUMAN, FAILURE, SUMMARY, TOOL_LINES, RESERVE = 24_000, 2500, 1200, 2000, 300, 200, 12, 48
#: Marks of rendered lines; fixed values.
SAID_HUMAN, SAID_THINKING, SAID_AGENT, TOOL, FAILED, TIMES = "[human] ", "[agent thinking] ", "[agent] ", "  · ", " FAILED: ", " ×"


def tool_line(t: Column) -> Column:
    """One line of a tool call: its failure, its files, its summary, or its name alone."""
    name = F.concat(F.lit(TOOL), F.coalesce(t["name"], F.lit("")))
    return (
        F.when(nonempty(t["error"]).isNotNull(), F.concat(name, F.lit(FAILED), let(collapse(t["error"]), lambda x: truncate(x, FAILURE))))
        .when(F.size(t["files"]) > 0, F.concat(name, F.lit(" "), F.array_join(t["files"], ", ")))
        .when(nonempty(t["summary"]).isNotNull(), F.concat(name, F.lit(": "), let(collapse(t["summary"]), lambda x: truncate(x, SUMMARY))))
        .otherwise(name)
    )


def rendered(messages: DataFrame) -> DataFrame:
    """session_key, seq, said, did of each message: what was said (failed calls too), and the routine calls. '' where nothing was."""
    tools = F.coalesce("tools", F.array().cast(messages.schema["tools"].dataType))
    failed = lambda t: nonempty(t["error"]).isNotNull()
    meta = F.coalesce("meta", F.lit(False))
    agent = F.col("role") == "assistant"
    # stripped once, in columns of their own: truncation refers to its text several times
    plain = messages.select(
        "session_key", "seq", tools.alias("tools"),
        F.when((F.col("role") == "user") & ~meta, strip_wrappers(F.col("text"))).alias("human"),
        F.when(agent & nonempty(F.col("thinking")).isNotNull(), strip_wrappers(F.col("thinking"))).alias("thought"),
        F.when(agent & nonempty(F.col("text")).isNotNull(), strip_wrappers(F.col("text"))).alias("spoken"),
    )
    tools, few = F.col("tools"), F.slice("tools", 1, TOOL_LINES)
    shown = lambda mark, c, size: F.concat(F.lit(mark), truncate(F.col(c), size))
    more = F.when(F.size(tools) > TOOL_LINES, F.concat(F.lit(TOOL + "… "), (F.size(tools) - TOOL_LINES).cast("string"), F.lit(" more tool calls")))
    said = F.concat_ws(
        "\n",
        F.when(F.col("human") != "", shown(SAID_HUMAN, "human", HUMAN)),
        shown(SAID_THINKING, "thought", THINKING),
        shown(SAID_AGENT, "spoken", TEXT),
        nonempty(F.array_join(F.transform(F.filter(few, failed), tool_line), "\n"))
    )
    did = F.concat_ws("\n", nonempty(F.array_join(F.transform(F.filter(few, lambda t: ~failed(t)), tool_line), "\n")), more)
    return plain.select("session_key", "seq", said.alias("said"), did.alias("did"))


def blocks(messages: DataFrame) -> DataFrame:
    """session_key, ord, text, filler: the pieces of a session's body in order, equal neighbours run together. Rendered once and kept."""
    both = rendered(messages).select(
        "session_key", "seq", F.posexplode(
            F.array(
                F.struct(F.col("said").alias("text"), F.lit(False).alias("filler")), F.struct(F.col("did").alias("text"), F.lit(True).alias("filler"))
            )
        ).alias("half", "b")
    )
    pieces = staged(both.select("session_key", (F.col("seq") * 2 + F.col("half")).alias("ord"), "b.text", "b.filler").where("text <> ''"))
    # runs are found over digests, so texts are shuffled once, to join their run
    keys = pieces.select("session_key", "ord", F.md5(F.concat("text", F.col("filler").cast("string"))).alias("same"))
    runs = sequence.collapse_repeats(keys, "session_key", "ord", "same").select("session_key", F.col("first").alias("ord"), "repeats")
    shown = F.when(F.col("repeats") > 1, F.concat("text", F.lit(TIMES), F.col("repeats").cast("string"))).otherwise(F.col("text"))
    return pieces.join(runs, ["session_key", "ord"]).select("session_key", "ord", shown.alias("text"), "filler")


def _named(sessions: DataFrame, members: DataFrame | None) -> DataFrame:
    """set_id, place, session_key and the two headers of each session of each set; without members every session is a set of its own."""
    who = F.concat(short(F.col("session_id")), F.lit(" ("), F.col("agent"), F.lit(")"))
    model = F.coalesce(F.concat(F.lit(" model="), nonempty(F.col("model"))), F.lit(""))
    heads = sessions.select(
        "session_key",
        F.concat(F.lit("--- session "), who, F.lit(" ---")).alias("asked_head"),
        F.concat(F.lit("=== session "), who, model, F.lit(" ===")).alias("body_head")
    )
    if members is None:
        return heads.select(F.col("session_key").alias("set_id"), F.lit(0).alias("place"), "*")
    return members.select("set_id", "place", "session_key").join(heads, "session_key")


def requests(messages: DataFrame, sessions: DataFrame, budget: int = BUDGET, members: DataFrame | None = None) -> DataFrame:
    """set_id, requests, n, cap, cut: every request of a set of sessions once, oldest session first, under its session's header;
    shortened together until they and the headers fit their share of the budget. None is ever left out."""
    typed = human_requests(messages).join(_named(sessions, members), "session_key").select(
        "set_id", F.struct("place", "session_key", "seq").alias("at"), "text", F.col("asked_head").alias("head")
    )
    if members is not None:  # within a session they are distinct already
        typed = typed.groupBy("set_id", "text").agg(F.min(F.struct("at", "head")).alias("x")).select("set_id", "x.at", "text", "x.head")
    typed = staged(typed)
    heads = typed.select("set_id", F.struct("at.place", "at.session_key", F.lit(-1).cast("long").alias("seq")).alias("at"), F.col("head").alias("text")).distinct()
    lines = typed.select("set_id", "at", "text").unionByName(heads)
    room = budget - 1  # a line end joins the two sections
    caps = sequence.best_cap(lines, "set_id", "text", budget, overhead=1, allow=room - int(room * (1 - sequence.SHARE)) + 1)
    cut = lines.join(caps.select("set_id", "cap", "cut"), "set_id").withColumn("text", truncate(F.col("text"), F.col("cap").cast("int")))
    whole = cut.groupBy("set_id", "cap", "cut").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("l"), F.count_if(F.col("at.seq") >= 0).alias("n"))
    return whole.select("set_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("requests"), "n", "cap", "cut")


def _shares(held: Column, budget: Column) -> Column:
    """What each session of a set spends on reasoning and on routine calls, by an array of struct(session_key, said, did), oldest
    first; said and did are the sizes that the newest pieces of the session add up to.

    Reasoning: each session gets its share of what is left, and what it doesn't use rolls on to the next. Routine calls: the
    newest session first takes what fits of the rest."""
    n = F.size(held)
    fits = lambda sums, room: F.coalesce(F.array_max(F.filter(sums, lambda x: x <= room)), F.lit(0).cast("long"))
    start = F.struct(F.array().cast("array<struct<session_key:string,said:bigint,did:bigint>>").alias("got"), F.lit(0).cast("long").alias("used"))

    def reason(acc: Column, x: Column) -> Column:
        share = F.floor((budget - acc["used"]) / (n - F.size(acc["got"])))
        spent = lambda m: F.struct(
            F.array_append(
                acc["got"], F.struct(x["session_key"].alias("session_key"), m.alias("said"), F.lit(0).cast("long").alias("did"))
            ).alias("got"),
            (acc["used"] + m).alias("used")
        )
        return let(fits(x["said"], share), spent)

    def routine(acc: Column, x: Column) -> Column:
        said = F.element_at(F.filter(acc["got"], lambda g: g["session_key"] == x["session_key"]), 1)["said"]
        row = lambda m: F.struct(x["session_key"].alias("session_key"), said.alias("said"), m.alias("did"))
        spent = lambda m: F.struct(
            F.transform(acc["got"], lambda g: F.when(g["session_key"] == x["session_key"], row(m)).otherwise(g)).alias("got"),
            (acc["used"] + m).alias("used")
        )
        return let(fits(x["did"], budget - acc["used"]), spent)

    return F.aggregate(F.reverse(held), F.aggregate(held, start, reason), routine)["got"]


def bodies(messages: DataFrame, sessions: DataFrame, budget: int = BUDGET, members: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """set_id, body, elided, dropped: per session that keeps something its header, the kept pieces and marks where reasoning was left
    out, and one mark for the routine calls of the set; sets that keep nothing have none.

    taken(set_id, used): what is already spent of each set's budget. The newest sizes of a session that could fit are an array of
    at most budget / 2 numbers, and a set's are one of its sessions'."""
    found = staged(blocks(messages))
    named = _named(sessions, members)
    size = (F.octet_length("text") + 1).cast("long")
    sums = sequence.scan.running(
        found.select("session_key", "ord", "filler", size.alias("n")), ["session_key", "filler"], ["ord"], F.col("n"), "used", descending=True
    ).select("session_key", "ord", "filler", "used")
    sums = staged(sums)
    near = sums.where(F.col("used") <= budget).groupBy("session_key").agg(
        F.collect_list(F.when(~F.col("filler"), F.col("used"))).alias("said"), F.collect_list(F.when(F.col("filler"), F.col("used"))).alias("did")
    )
    none = F.array().cast("array<bigint>")
    there = named.join(found.select("session_key").distinct(), "session_key").join(near, "session_key", "left")
    held = there.groupBy("set_id").agg(
        F.array_sort(
            F.collect_list(F.struct("place", "session_key", F.coalesce("said", none).alias("said"), F.coalesce("did", none).alias("did")))
        ).alias("held")
    )
    if taken is not None:
        held = held.join(taken.select("set_id", F.col(taken.columns[1]).cast("long").alias("_spent")), "set_id", "left")
    room = F.greatest(F.lit(0), F.lit(budget - RESERVE) - (F.coalesce("_spent", F.lit(0)) if taken is not None else F.lit(0))).cast("long")
    given = held.select("set_id", F.explode(_shares(F.col("held"), room)).alias("g")).select("set_id", "g.session_key", "g.said", "g.did")
    one = F.concat_ws("\u001f", "set_id", "session_key").alias("one")
    kept = F.col("used") <= F.when(F.col("filler"), F.col("did")).otherwise(F.col("said"))
    marked = staged(sums.join(given, "session_key").select(one, "set_id", "session_key", "ord", "filler", kept.alias("kept")))
    gaps = sequence.elisions(marked.where("kept or not filler"), "one", "ord", F.col("kept")).select(
        "one", F.coalesce("before", F.lit(2**62)).alias("ord"), F.lit(0).alias("half"), F.concat(
            F.lit("[… "), F.col("elided").cast("string"), F.lit(" earlier messages elided …]")
        ).alias("text")
    )
    lines = marked.where("kept").join(
        found.select("session_key", "ord", "text"), ["session_key", "ord"]
    ).select("one", "ord", F.lit(1).alias("half"), "text").unionByName(gaps)
    whole = lines.groupBy("one").agg(F.array_sort(F.collect_list(F.struct("ord", "half", "text"))).alias("l"), F.bool_or(F.col("half") == 1).alias("any")).where("any")
    parts = whole.join(named.select(one, "set_id", "place", "session_key", "body_head"), "one")
    piece = F.struct("place", "session_key", F.concat_ws("\n", "body_head", F.array_join(F.transform("l", lambda x: x["text"]), "\n")).alias("text"))
    sets = parts.groupBy("set_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    left = marked.groupBy("set_id").agg(F.count_if(~F.col("kept") & ~F.col("filler")).alias("elided"), F.count_if(~F.col("kept") & F.col("filler")).alias("dropped"))
    tail = F.when(F.col("dropped") > 0, F.concat(F.lit("[… "), F.col("dropped").cast("string"), F.lit(" routine tool calls not shown; see the staged diff …]")))
    return sets.join(left, "set_id").select(
        "set_id", F.concat_ws("\n", F.array_join(F.transform("p", lambda x: x["text"]), "\n"), tail).alias("body"), "elided", "dropped"
    )


def payload_sets(messages: DataFrame, sessions: DataFrame, members: DataFrame | None = None, budget: int = BUDGET) -> DataFrame:
    """set_id, requests, body, notes of every set of sessions with a payload; what requests take goes off the body's budget.

    members(set_id, session_key, place): the sessions of each set, the oldest with the lowest place; a set has one budget."""
    asked = staged(requests(messages, sessions, budget, members))
    spent = asked.select("set_id", (F.octet_length("requests") + 1).alias("used"))
    found = bodies(messages, sessions, budget, members, spent)
    both = asked.join(found, "set_id", "full")
    text = lambda c: c.cast("string")
    cut = F.when(
        F.col("cut") > 0,
        F.concat(
            F.lit("all "),
            text(F.col("n")),
            F.lit(" requests were sent; "),
            text(F.col("cut")),
            F.lit(" of them were cut to "),
            text(F.col("cap")),
            F.lit(" bytes")
        )
    )
    large = F.octet_length("requests") > budget - 1
    alone = F.when(
        large,
        F.concat(
            F.lit("the requests alone are "),
            text(F.octet_length("requests")),
            F.lit(f" bytes of a budget of {budget}; the session's body was dropped")
        )
    )
    without = F.when(F.col("requests").isNotNull() & F.col("body").isNull(), F.lit("the session's body did not fit the budget; only the requests were sent"))
    return both.select(
        "set_id",
        F.coalesce("requests", F.lit("")).alias("requests"),
        F.coalesce("body", F.lit("")).alias("body"),
        F.array_compact(F.array(cut, alone, without)).alias("notes")
    )


def payloads(messages: DataFrame, sessions: DataFrame, budget: int = BUDGET) -> DataFrame:
    """session_key, requests, body, notes of every session with a payload, each with a budget of its own."""
    return payload_sets(messages, sessions, None, budget).withColumnRenamed("set_id", "session_key")
