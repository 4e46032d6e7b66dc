"""Records in commit messages: a delimited block of entries, then key-value trailers. Writer, parser and what serves them.

The block stands between lines <name> and </name>; name, keys and indents are parameters. By default any lower-case block name
and any trailer prefix is read, and SESSION_RECORD and 'Loom-' are written."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import base_name, nonempty, split_list, trimmed
from loomwork.operators.sequence import prefix_pack

SESSION_RECORD, ANY_NAME, PREFIX = "session-record", "[a-z][a-z0-9-]*", "Loom"
WIDTH, LOOK_BACK, INJECTION_BYTES = 76, 100, 10_000
KINDS = ("reject", "invariant")


# --- writing ---------------------------------------------------------------------------------


def wrap(text: str, first: str = "", rest: str = "", width: int = WIDTH) -> str:
    """Words filled greedily into lines of at most width bytes (a longer word has its own), with the given indents."""
    lines, line, used = [], first, len(first.encode())
    empty = True
    for word in text.split():
        size = len(word.encode())
        if not empty and used + 1 + size > width:
            lines.append(line)
            line, used, empty = rest, len(rest.encode()), True
        line, used = (line + word, used + size) if empty else (line + " " + word, used + 1 + size)
        empty = False
    return "\n".join([*lines, line])


def _block(entries: list[dict], name: str) -> str:
    shown = []
    for e in entries:
        lines = [wrap(e["rule"], f"{e['kind']}: ", "  ")]
        if e["why"]:
            lines.append(wrap(e["why"], "  why: ", "    "))
        if e["files"]:
            lines.append("  file: " + ", ".join(e["files"]))
        shown.append("\n".join(lines))
    return f"<{name}>\n" + "\n\n".join(shown) + f"\n</{name}>" if shown else ""


def rendered(rules: DataFrame, name: str = SESSION_RECORD) -> DataFrame:
    """sha, block: a commit's entries as text, rejections first; wrapping needs loops, so it runs on Arrow batches."""
    entry = F.struct(
        F.when(F.col("kind") == "reject", 0).otherwise(1).alias("k"),
        F.col("pos").alias("pos"),
        "kind",
        F.coalesce("rule", F.lit("")).alias("rule"),
        F.coalesce("why", F.lit("")).alias("why"),
        F.coalesce("files", F.array().cast("array<string>")).alias("files")
    )
    per = rules.groupBy("sha").agg(F.array_sort(F.collect_list(entry)).alias("e"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_block(e, name) for e in batch.column(1).to_pylist()], pa.string())], names=["sha", "block"])

    return per.mapInArrow(batches, "sha string, block string")


def _shown(head: str, entries: list[dict], disputed: list[str], foot: str | None) -> str:
    lines = [head]
    for e in entries:
        lines.append(wrap(f"{e['kind']}: {e['rule']}", "  ", "  "))
        if e["why"]:
            lines.append(wrap(f"why: {e['why']}", "      ", "      "))
        if e["files"]:
            lines.append("      file: " + ", ".join(e["files"]))
    lines += [wrap(f"⚠ the diff contradicts: {d}", "  ", "  ") for d in disputed]
    return "\n".join([*lines, f"  [{foot}]"] if foot else lines)


def printed(commits: DataFrame, records_: DataFrame, entries: DataFrame) -> DataFrame:
    """sha, text of each commit as a person reads it: its short id and subject, its entries with reasons and files, rejections first,
    what the diff contradicts, and who made it with which confidence. A commit without a record says so.

    commits(sha, short, subject), records_(sha, agent, confidence, disputed), entries(sha, kind, pos, rule, why, files)."""
    entry = F.struct(
        F.when(
            F.col("kind") == "reject", 0
        ).otherwise(1).alias("k"), F.col("pos").alias("pos"), "kind", F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("why", F.lit("")).alias("why"),
        F.coalesce("files", F.array().cast("array<string>")).alias("files"),
    )
    per = entries.groupBy("sha").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    foot = F.concat_ws(", ", nonempty(F.col("agent")), nonempty(F.col("confidence"))).alias("foot")
    head = F.concat_ws("  ", "short", "subject").alias("head")
    one = commits.select("sha", "short", "subject").groupBy("sha").agg(F.min(F.struct("short", "subject")).alias("c")).select("sha", "c.*")
    whole = one.join(per, "sha", "left").join(
        records_.select("sha", foot, "disputed", F.lit(True).alias("has")), "sha", "left"
    ).select("sha", head, "e", "disputed", "foot", "has")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]))
            texts = [_shown(h, e or [], d or [], f) if has else f"{h}\n\nNo record on this commit." for h, e, d, f, has in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["sha", "text"])

    return whole.mapInArrow(batches, "sha string, text string")


def trailers_of(pairs: list[tuple[str, Column]], prefix: str = PREFIX) -> Column:
    """Trailer lines in order, one for each non-empty item of each (key, array of values)."""

    def lines(key: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: nonempty(x).isNotNull()), lambda x: F.concat(F.lit(f"{prefix}-{key}: "), x))

    return F.array_join(F.flatten(F.array(*[lines(k, v) for k, v in pairs])), "\n")


def composed(existing: Column, block: Column, trailers: Column) -> Column:
    """The author's message, untouched, then the block and the trailers, each behind a blank line; trailing line ends of the message go."""
    return F.concat_ws("\n\n", nonempty(F.regexp_replace(existing, r"\n+\z", "")), nonempty(block), nonempty(trailers))


def needs_record(source: Column, message: Column, staged: Column, enabled: Column | None = None, name: str = ANY_NAME) -> Column:
    """Whether a commit that is being made gets a record: not a merge or squash, none there yet, something staged, and not switched off."""
    fresh = ~F.coalesce(source, F.lit("")).isin("merge", "squash") & block_in(F.coalesce(message, F.lit("")), name).isNull() & (F.coalesce(staged, F.lit(0)) > 0)
    return fresh if enabled is None else fresh & F.coalesce(enabled, F.lit(True))


def headline(rejected: Column, invariants: Column, confidence: Column) -> Column:
    """One line on what a record holds."""
    from loomwork.functions.text import plural

    parts = F.concat_ws(
        ", ",
        F.when(rejected > 0, F.concat(rejected.cast("string"), F.lit(" rejected"))),
        F.when(invariants > 0, plural(invariants, "invariant", "invariants"))
    )
    return F.concat(F.when(parts == "", "no rules").otherwise(parts), F.lit(" ("), confidence, F.lit(")"))


# --- parsing ---------------------------------------------------------------------------------


def block_in(body: Column, name: str = ANY_NAME) -> Column:
    """The inside of the first block whose opening tag starts a line; to the end of the body if it is never closed; null without one."""
    inside = F.regexp_extract(body, rf"(?ms)^<({name})>[ \t]*$\n?(.*?)(?:^</\1>|\z)", 2)
    return F.when(body.rlike(rf"(?m)^<{name}>[ \t]*$"), inside)


def parsed(commits: DataFrame, name: str = ANY_NAME) -> DataFrame:
    """sha, kind, pos, rule, why, files of commits(sha, body, note), as lines with running entry and field numbers - no UDF.

    body and note are read as one text, so the first block counts. 'kind:' at a line's start opens an entry; why and file keys count at any
    indent, a later why replaces, files add up; other lines continue the field before; a blank line ends the entry."""
    lines = (
        commits.select("sha", F.split(block_in(F.concat_ws("\n\n", "body", "note"), name), "\n").alias("l"))
        .select("sha", F.posexplode("l").alias("n", "line"))
        .withColumn("head", F.lower(F.regexp_extract("line", r"(?i)^(reject|invariant):", 1)))
        .withColumn("field", F.when(F.col("head") != "", "rule").otherwise(F.lower(F.regexp_extract("line", r"(?i)^\s*(why|file):", 1))))
        .withColumn("blank", F.col("line").rlike(r"^\s*$"))
    )
    along = Window.partitionBy("sha").orderBy("n")
    numbered = lines.withColumn(
        "piece", F.sum(F.when((F.col("field") != "") | F.col("blank"), 1).otherwise(0)).over(along)
    ).withColumn("entry", F.sum(F.when(F.col("head") != "", 1).otherwise(0)).over(along))
    # an entry ends with the first blank line behind it
    ends = numbered.withColumn("dead", F.max(F.col("blank")).over(Window.partitionBy("sha", "entry").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    live = ends.where("entry > 0 and not dead")
    text = trimmed(
        F.when(
            F.col("head") != "", F.regexp_replace("line", r"(?i)^(reject|invariant):", "")
        ).when(F.col("field") != "", F.regexp_replace("line", r"(?i)^\s*(why|file):", "")).otherwise(F.col("line"))
    )
    fields = live.withColumn("text", text).groupBy("sha", "entry", "piece").agg(
        F.max("head").alias("head"),
        F.max("field").alias("field"),
        F.array_join(
            F.filter(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), lambda x: x != ""), " "
        ).alias("text")
    )
    files = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == "file", F.struct("piece", "text")))), lambda x: split_list(x["text"])))
    entries = fields.groupBy("sha", "entry").agg(
        F.max("head").alias("kind"), F.max(F.when(F.col("field") == "rule", F.col("text"))).alias("rule"), F.max_by(
            F.when(F.col("field") == "why", F.col("text")), F.when(F.col("field") == "why", F.col("piece"))
        ).alias("why"), files.alias("files")
    )
    return entries.where("rule <> ''").select(
        "sha",
        "kind",
        (F.row_number().over(Window.partitionBy("sha").orderBy("entry")) - 1).cast("long").alias("pos"),
        "rule",
        "why",
        F.coalesce("files", F.array().cast("array<string>")).alias("files")
    )


def trailers(commits: DataFrame, prefix: str = "[A-Z][A-Za-z]*") -> DataFrame:
    """sha, pos, key, value of the trailer lines at the end of a body, behind the last blank line; keys as written, repeated keys kept.
    Reading through git itself (sources.gitlog) is exact for folded values; this is for bodies held in tables."""
    last = F.regexp_extract(F.regexp_replace("body", r"\s+\z", ""), r"(?s)(?:\A|\n[ \t]*\n)((?:[A-Za-z][\w-]*:[^\n]*(?:\n|\z)(?:[ \t]+\S[^\n]*(?:\n|\z))*)+)\z", 1)
    lines = commits.select("sha", F.posexplode(F.split(F.regexp_replace(last, r"\n[ \t]+", " "), "\n")).alias("pos", "line")).where("line <> ''")
    return lines.where(F.col("line").rlike(rf"^{prefix}(?:-[A-Z]\w*)*:")).select(
        "sha",
        F.col("pos").cast("long").alias("pos"),
        F.regexp_extract("line", "^([^:]+):", 1).alias("key"),
        trimmed(F.regexp_replace("line", "^[^:]+:", "")).alias("value")
    )


def trailer(pairs: Column, key: str) -> Column:
    """The first value of a key, in any letter case, in an array of struct(key, value); '' without one."""
    return F.coalesce(F.try_element_at(F.filter(pairs, lambda p: F.lower(p["key"]) == key.lower()), F.lit(1))["value"], F.lit(""))


def records(commits: DataFrame, rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """Commits that carry a record (entries or a trailer ending in -Agent or -Confidence): sha, agent, confidence, disputed, rejected, invariants."""
    t = pairs.groupBy("sha").agg(
        F.max(F.when(F.lower("key").endswith("-agent"), F.col("value"))).alias("agent"), F.max(F.when(F.lower("key").endswith("-confidence"), F.col("value"))).alias("confidence"), F.array_sort(
            F.collect_set(F.when(F.lower("key").endswith("-disputed"), F.col("value")))
        ).alias("disputed")
    )
    n = rules.groupBy("sha").agg(F.count_if(F.col("kind") == "reject").alias("rejected"), F.count_if(F.col("kind") == "invariant").alias("invariants"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = commits.select("sha").join(t, "sha", "left").join(n, "sha", "left")
    return joined.where("agent <> '' or confidence <> '' or rejected + invariants > 0").select(
        "sha", "agent", "confidence", F.coalesce("disputed", F.array().cast("array<string>")).alias("disputed"), zero("rejected"), zero("invariants")
    )


# --- serving ---------------------------------------------------------------------------------


def binds(files: Column, path: Column) -> Column:
    """Whether a rule with these files binds a path: the same path, or the same base name. Only for rules of commits that touched the path."""
    plain = F.regexp_replace(path, r"^(\./)+", "")
    return F.exists(files, lambda f: (f == plain) | (base_name(f) == base_name(plain)))


def rule_lines(kind: Column, rule: Column) -> Column:
    return F.concat(F.lit("  "), kind, F.lit(": "), rule)


def served(touches: DataFrame, rules: DataFrame, commits: DataFrame, budget: int = INJECTION_BYTES, look_back: int = LOOK_BACK) -> DataFrame:
    """path, ord, sha, text, total, kept: for each path its newest commits' rules that bind it, whole commits only, within the budget.

    touches(path, sha): the history of paths; commits(sha, short, ts). The newest look_back commits of a path are looked at, newest
    first; header and overflow text for all of them are reserved before packing."""
    newest = Window.partitionBy("path").orderBy(F.desc("ts"), "sha")
    history = touches.join(commits.select("sha", "short", "ts"), "sha").withColumn("ord", F.row_number().over(newest)).where(F.col("ord") <= look_back)
    bound = history.join(rules.select("sha", "kind", "pos", "rule", "files"), "sha").where(binds(F.col("files"), F.col("path")))
    line = F.struct(F.when(F.col("kind") == "reject", 0).otherwise(1).alias("k"), "pos", rule_lines(F.col("kind"), F.col("rule")).alias("t"))
    texts = bound.groupBy("path", "ord", "sha", "short").agg(F.array_sort(F.collect_list(line)).alias("l")).select(
        "path", "ord", "sha", F.concat(F.col("short"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.lit("\n")).alias("text")
    )
    packed = prefix_pack(
        texts,
        ["path"],
        "ord",
        F.octet_length("text"),
        budget,
        F.octet_length(header(F.col("path"), F.col("total"))) + F.octet_length(overflow(F.col("path"), F.col("total")))
    )
    return packed.select("path", F.col("ord").cast("long").alias("ord"), "sha", "text", "total", "kept")


def header(path: Column, n: Column) -> Column:
    return F.concat(F.lit("Rules from "), n.cast("string"), F.when(n == 1, " commit").otherwise(" commits"), F.lit(" that bind "), path, F.lit(":\n"))


def overflow(path: Column, n: Column) -> Column:
    return F.concat(F.lit("… and "), n.cast("string"), F.lit(" more for "), path, F.lit("\n"))


def served_text(packed: DataFrame) -> DataFrame:
    """path, commits, dropped, text: the block that is shown for a path."""
    per = packed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"), F.max("total").alias("total"), F.max("kept").alias("kept"))
    left = F.col("total") - F.col("kept")
    return per.select(
        "path",
        F.col("kept").alias("commits"),
        left.alias("dropped"),
        F.concat(
            header(F.col("path"), F.col("kept")),
            F.array_join(F.transform("t", lambda x: x["text"]), ""),
            F.when(left > 0, overflow(F.col("path"), left)).otherwise("")
        ).alias("text")
    )


def served_json(packed: DataFrame) -> DataFrame:
    """path, json: the same as one object a path."""
    per = packed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "sha", "text"))).alias("commits"))
    return per.select(
        "path",
        F.to_json(
            F.struct(
                F.col("path").alias("file"),
                F.transform("commits", lambda c: F.struct(c["sha"].alias("commit"), c["text"].alias("text"))).alias("commits")
            )
        ).alias("json")
    )


def response(text: Column, event: str | None = None) -> Column:
    """The envelope that a hook answers with: nested with the event's name, or flat."""
    if event is None:
        return F.to_json(F.struct(text.alias("additional_context")))
    return F.to_json(F.struct(F.struct(F.lit(event).alias("hookEventName"), text.alias("additionalContext")).alias("hookSpecificOutput")))
