"""Session logs as a data source: append-only JSON lines, read in batch or as a stream by byte offsets.

    spark.dataSource.register(SessionLogSource)
    spark.read.format("session_log").option("root", folder).option("layout", "a").load()
    spark.readStream.format("session_log").option("root", folder).load()

Layouts: a is <root>/<slug of cwd>/<session>.jsonl, b is <root>/<project>/agent-transcripts/<id>/<id>.jsonl. Options: since
(seconds; files that changed earlier are passed over), offsets (JSON of path to byte, batch only), head (lines of each file that are
read at most, from its start; batch only).

Rules: a line counts once its line end is there, so the unfinished tail waits for the next batch; a file shorter than its
offset was replaced and is read from its start; unreadable lines come with readable = false and the offset moves on. Lines
have start and size in bytes, so a reader's offset is the largest start + size; upto is the offset behind the file's last whole
line. A file that can't be read is one row with line_no -1 and the error as its line; the others are read all the same."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomwork.functions import payload
from loomwork.functions.text import nonempty, truncate, unwrap_query
from loomwork.operators.sessions import sessions_with_signal
from loomwork.sources.stage import staged

LAYOUTS = {"a": "*/*.jsonl", "b": "*/agent-transcripts/*/*.jsonl"}
#: Lines that a file's head is judged by, and the longest line that counts there.
HEAD_LINES, HEAD_BYTES = 200, 8 << 20
SCHEMA = "path string, session_id string, project string, mtime double, line_no long, start long, size long, readable boolean, line string, upto long"
#: Bytes of one read; a line may be longer.
CHUNK = 1 << 20


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int, layout: str, numbered: bool, head: int | None = None):
        self.path, self.start, self.end, self.layout, self.numbered, self.head = path, start, end, layout, numbered, head


def discovered(root: str, layout: str = "a", since: float = 0.0) -> list[str]:
    """Log files of a root, in order; empty and older ones are passed over, and so are files that vanish meanwhile."""
    found = []
    for path in sorted(glob.glob(os.path.join(root, LAYOUTS[layout]))):
        try:
            s = os.stat(path)
        except OSError:
            continue
        if s.st_size and s.st_mtime >= since and (layout != "b" or os.path.basename(os.path.dirname(path)) + ".jsonl" == os.path.basename(path)):
            found.append(path)
    return found


def finished(path: str, start: int = 0) -> int:
    """The offset behind the last line end at or after start."""
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        end = f.tell()
        while end > start:
            size = min(CHUNK, end - start)
            f.seek(end - size)
            at = f.read(size).rfind(b"\n")
            if at >= 0:
                return end - size + at + 1
            end -= size
    return start


def _lines(piece: Piece | None) -> Iterator[tuple]:
    if piece is None:  # Spark's stand-in where there are no partitions
        return
    name = os.path.basename(piece.path).removesuffix(".jsonl")
    steps = piece.path.split(os.sep)
    project = steps[-2] if piece.layout == "a" else steps[-4]
    try:
        yield from _read(piece, name, project)
    except OSError as e:
        yield piece.path, name, project, None, -1, piece.start, 0, False, f"{type(e).__name__}: {e.strerror or e}", None


def _read(piece: Piece, name: str, project: str) -> Iterator[tuple]:
    mtime = os.path.getmtime(piece.path)
    with open(piece.path, "rb") as f:
        number = 0
        if piece.numbered and piece.start:
            left = piece.start
            while left > 0:
                block = f.read(min(CHUNK, left))
                number += block.count(b"\n")
                left -= len(block)
        f.seek(piece.start)
        at = piece.start
        while at < piece.end and (piece.head is None or number < piece.head):
            raw = f.readline()
            if not raw.endswith(b"\n"):
                return
            try:
                line = raw.decode()
                readable = isinstance(json.loads(line), dict)
            except (ValueError, RecursionError):
                line, readable = raw.decode(errors="replace"), False
            if line.strip():
                yield piece.path, name, project, mtime, number, at, len(raw), readable, line.rstrip("\r\n"), piece.end
            at += len(raw)
            number += 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.layout, self.since = options["root"], options.get("layout", "a"), float(options.get("since", 0))
        self.offsets = json.loads(options.get("offsets", "{}"))
        self.head = int(options["head"]) if "head" in options else None

    def partitions(self) -> list[Piece]:
        out = []
        for path in discovered(self.root, self.layout, self.since):
            start = self.offsets.get(path, 0)
            try:
                start = 0 if start > os.path.getsize(path) else start
                end = finished(path, start)
            except OSError:
                end = start + 1  # the task says what is wrong with it
            if end > start:
                out.append(Piece(path, start, end, self.layout, True, self.head))
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _lines(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are {path: byte behind the last whole line}; restarts resume from the checkpoint and read nothing twice."""

    def __init__(self, options: dict):
        self.root, self.layout, self.since = options["root"], options.get("layout", "a"), float(options.get("since", 0))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: finished(p) for p in discovered(self.root, self.layout, self.since)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if begin > stop else begin
            if stop > begin:
                out.append(Piece(path, begin, stop, self.layout, True))
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _lines(partition)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint keeps the offsets."""


class SessionLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def messages_a(lines: DataFrame) -> DataFrame:
    """session_key, seq, ts, role, text, thinking, meta, tools, model, branch, cwd of agent A's lines: user and assistant lines off sidechains.

    A user's array content without a prompt id, or with a tool result, is meta; failed results become calls named result."""
    v = F.try_parse_json("line")
    at = lambda p: payload.text_at(F.col("v"), p)
    read = lines.where("readable").select("path", "line_no", v.alias("v"))
    main = read.where(at("$.type").isin("user", "assistant") & ~F.coalesce(F.try_variant_get("v", "$.isSidechain", "boolean"), F.lit(False)))
    parts = F.try_variant_get("v", "$.message.content", "array<variant>")
    kind = lambda p: payload.text_at(p, "$.type")
    joined = lambda t, k: F.array_join(
        F.filter(F.transform(F.filter("parts", lambda p: kind(p) == t), lambda p: payload.text_at(p, k)), lambda x: nonempty(F.trim(x)).isNotNull()),
        "\n"
    )
    opened = lambda p: F.coalesce(F.try_parse_json(payload.text_at(p, "$.input")), F.try_variant_get(p, "$.input", "variant"))
    call = lambda name, files, summary, error: F.struct(name.alias("name"), files.alias("files"), summary.alias("summary"), error.alias("error"))
    none = F.lit(None).cast("string")
    calls = F.transform(
        F.filter("parts", lambda p: kind(p) == "tool_use"),
        lambda p: call(payload.text_at(p, "$.name"), payload.files_of(opened(p)), payload.summary_of(opened(p)), none)
    )
    failed = F.transform(
        F.filter("parts", lambda p: (kind(p) == "tool_result") & F.coalesce(F.try_variant_get(p, "$.is_error", "boolean"), F.lit(False))),
        lambda p: call(F.lit("result"), F.array().cast("array<string>"), F.lit(""), truncate(F.coalesce(payload.content_text(p), F.lit("")), 400)),
    )
    held = main.select("path", "line_no", "v", parts.alias("parts"), at("$.message.content").alias("whole"))
    result = F.exists(F.coalesce("parts", F.array().cast("array<variant>")), lambda p: kind(p) == "tool_result")
    text = F.coalesce("whole", joined("text", "$.text"), F.lit(""))
    rows = held.select(
        F.col("path").alias("session_key"), F.col("line_no").alias("seq"), F.try_to_timestamp(at("$.timestamp")).alias("ts"), at("$.type").alias("role"), text.alias("text"), joined(
            "thinking", "$.thinking"
        ).alias("thinking"),
        ((at("$.type") == "user") & F.col("parts").isNotNull() & (result | nonempty(at("$.promptId")).isNull())).alias("meta"), F.coalesce(
            F.concat(calls, failed), F.array().cast("array<struct<name:string,files:array<string>,summary:string,error:string>>")
        ).alias("tools"),
        F.when(
            ~F.coalesce(at("$.message.model").startswith("<"), F.lit(False)), nonempty(at("$.message.model"))
        ).alias("model"), nonempty(at("$.gitBranch")).alias("branch"), nonempty(at("$.cwd")).alias("cwd"),
    )
    return rows.where("text <> '' or thinking <> '' or size(tools) > 0")


def messages_b(lines: DataFrame) -> DataFrame:
    """The same of agent B's lines, which have no time or model: ts is the file's, typed prompts are unwrapped and dropped without an envelope."""
    read = lines.where("readable").select("path", "line_no", "mtime", F.try_parse_json("line").alias("v"))
    at = lambda p: payload.text_at(F.col("v"), p)
    held = read.select(
        "path", "line_no", "mtime", at("$.role").alias("role"), F.try_variant_get("v", "$.message.content", "array<variant>").alias("parts")
    ).where("role in ('user', 'assistant') and parts is not null")
    kind = lambda p: payload.text_at(p, "$.type")
    text = F.array_join(F.transform(F.filter("parts", lambda p: kind(p) == "text"), lambda p: payload.text_at(p, "$.text")), "\n")
    inputs = lambda p: F.try_variant_get(p, "$.input", "variant")
    tools = F.transform(
        F.filter("parts", lambda p: kind(p) == "tool_use"),
        lambda p: F.struct(
            payload.text_at(p, "$.name").alias("name"),
            payload.files_of(inputs(p), payload.PATH_KEYS_B, distinct=True).alias("files"),
            payload.summary_of(inputs(p), payload.SUMMARY_KEYS_B).alias("summary"),
            F.lit(None).cast("string").alias("error")
        ),
    )
    rows = held.select(
        F.col("path").alias("session_key"),
        F.col("line_no").alias("seq"),
        F.timestamp_seconds("mtime").alias("ts"),
        "role",
        F.when(F.col("role") == "user", unwrap_query(text)).otherwise(text).alias("text"),
        F.lit("").alias("thinking"),
        F.lit(False).alias("meta"),
        tools.alias("tools")
    )
    return rows.where("text <> '' or (role = 'assistant' and size(tools) > 0)")


def sessions_of(lines: DataFrame, repo: str, agent: str) -> DataFrame:
    """session_key, agent, session_id, cwd, title, updated, cursor_bytes of the logs that belong to a repository: by the first directory in
    the file's head, or by the project's name where the head has none."""
    v = F.try_parse_json(F.when(F.col("size") <= HEAD_BYTES, F.col("line")))
    found = lines.where("line_no >= 0")
    head = found.select("path", "session_id", "project", "mtime", "line_no", F.col("upto").alias("end"), F.when(F.col("line_no") < HEAD_LINES, v).alias("v"))
    cwd, title = nonempty(payload.text_at(F.col("v"), "$.cwd")), nonempty(payload.text_at(F.col("v"), "$.aiTitle"))
    per = head.groupBy("path", "session_id", "project").agg(
        F.max("mtime").alias("updated"),
        F.max("end").alias("cursor_bytes"),
        F.min_by(cwd, F.when(cwd.isNotNull(), F.col("line_no"))).alias("cwd"),
        F.min_by(title, F.when(title.isNotNull(), F.col("line_no"))).alias("title")
    )
    slug = "".join(c if c.isascii() and c.isalnum() else "-" for c in repo)
    known = F.coalesce("cwd", F.when(F.col("project").isin(slug, slug.removeprefix("-")), F.lit(repo)))
    root = repo.rstrip("/")
    return per.withColumn("cwd", known).where((F.col("cwd") == root) | F.col("cwd").startswith(root + "/")).select(
        F.col("path").alias("session_key"),
        F.lit(agent).alias("agent"),
        "session_id",
        "cwd",
        "title",
        F.timestamp_seconds("updated").alias("updated_ts"),
        "cursor_bytes"
    )


def all_sessions(spark: SparkSession, repo: str, readers: list[tuple[str, str, str]]) -> tuple[DataFrame, list[str]]:
    """(sessions of a repository over all readers, what went wrong). readers: (agent, layout, root); a reader that fails is left out and named."""
    found, failed = None, []
    for agent, layout, root in readers:
        try:
            discovered(root, layout)
            heads = spark.read.format("session_log").option("root", root).option("layout", layout).option("head", HEAD_LINES).load()
            part = sessions_of(heads, repo, agent)
            found = part if found is None else found.unionByName(part)
        except (KeyError, OSError) as e:
            failed.append(f"{agent}: {type(e).__name__} {e}")
    if found is None:
        found = spark.createDataFrame([], "session_key string, agent string, session_id string, cwd string, title string, updated_ts timestamp, cursor_bytes long")
    return found, failed


_ERRORS = "agent string, path string, error string"


def load_new(spark: SparkSession, repo: str, readers: list[tuple[str, str, str]], offsets: dict[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, messages, errors): what is new in a repository's logs behind the stored offsets. readers: (agent, layout, root).

    Sessions whose new lines hold nothing that a distiller could use are left out; a session or reader that can't be read is a row
    of errors and stops no other. Sessions have updated_ts, by which their readers go oldest first, and cursor_bytes, the next offset."""
    known, names = all_sessions(spark, repo, readers)
    failed = [(agent, None, error) for agent, _, error in (n.partition(": ") for n in names)]
    agents = {f[0] for f in failed}
    messages, errors = None, spark.createDataFrame(failed, _ERRORS)
    shape = {"a": messages_a, "b": messages_b}
    for agent, layout, root in readers:
        if agent in agents:
            continue
        lines = spark.read.format("session_log").option("root", root).option("layout", layout).option("offsets", json.dumps(offsets)).load()
        new = shape[layout](lines).select("session_key", "seq", "ts", "role", "text", "thinking", "meta", "tools")
        messages = new if messages is None else messages.unionByName(new)
        errors = errors.unionByName(lines.where("line_no < 0").select(F.lit(agent).alias("agent"), "path", F.col("line").alias("error")))
    if messages is None:
        messages = spark.createDataFrame(
            [],
            "session_key string, seq long, ts timestamp, role string, text string, thinking string, meta boolean, tools"
            " array<struct<name:string,files:array<string>,summary:string,error:string>>"
        )
    messages = staged(messages)
    useful = known.join(sessions_with_signal(messages).select("session_key"), "session_key", "left_semi")
    return useful, messages.join(useful.select("session_key"), "session_key", "left_semi"), errors
