"""Git history as a data source: one row per commit, newest first (ord 0), with its trailers and note as git itself parses them.

    spark.read.format("gitlog").option("repo", folder).option("path", "src/a.py").option("limit", 100).load()

Options: repo, path (the history of one path, following renames; without renames where git can't), limit, notes (ref, default
commits), files (true adds the paths of each commit), partitions (ranges of commits that are read in parallel, 1). Equality filters on path are pushed down into the git call."""

from __future__ import annotations

import codecs
import os
import subprocess
import tempfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "sha string, short string, author string, ts timestamp, subject string, body string, note string, trailers array<struct<key:string,value:string>>, files array<string>, ord long, path string"
_FIELD, _RECORD = "\x1f", "\x1e"
_FORMAT = _RECORD + _FIELD.join(("%H", "%h", "%an", "%ct", "%s", "%b", "%N", "%(trailers:only,unfold)")) + _FIELD


def git(repo: str, *args: str) -> str:
    """Output of a git command; the caller's git variables are left out, so that it can run inside a hook."""
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"LC_ALL": "C.UTF-8"}
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, env=env, timeout=600, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()[:500]}")
    return done.stdout.decode(errors="replace")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.path = options["repo"], options.get("path")
        self.limit, self.parts = int(options["limit"]) if options.get("limit") else None, int(options.get("partitions", 1))
        self.notes, self.files = options.get("notes", "commits"), options.get("files", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",) and self.path in (None, f.value):
                self.path = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Ranges of commits; one for the history of a path, whose renames git follows from its newest commit on."""
        if self.path or self.parts == 1:
            return [InputPartition((0, self.limit))]
        try:
            known = int(git(self.repo, "rev-list", "--count", "HEAD"))
        except RuntimeError:
            return [InputPartition((0, self.limit))]
        total = min(known, self.limit) if self.limit is not None else known
        size = max(1, -(-total // self.parts))
        return [InputPartition((skip, min(size, total - skip))) for skip in range(0, total, size)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        skip, most = partition.value
        base = ["log", f"--format={_FORMAT}", f"--notes={self.notes}", f"--skip={skip}"]
        base += ([f"-n{most}"] if most is not None else []) + (["--name-only"] if self.files else [])
        if not self.path:
            found = _records(self.repo, base)
        else:
            found = _records(self.repo, [*base, "--follow", "--", self.path], [*base, "--", self.path])
        for at, record in enumerate(found, skip):
            sha, short, author, when, subject, body, note, trailers, names = record.split(_FIELD, 8)
            pairs = [tuple(x.strip() for x in line.split(":", 1)) for line in trailers.splitlines() if ":" in line]
            files = [n for n in names.splitlines() if n] if self.files else None
            ts = datetime.fromtimestamp(int(when), timezone.utc)
            yield sha, short, author, ts, subject, body.rstrip("\n"), note.rstrip("\n") or None, pairs, files, at, self.path


def _records(repo: str, args: list[str], otherwise: list[str] | None = None) -> Iterator[str]:
    """The records of a git log as they come, so that no history is held whole; otherwise: what to call if the first call gives nothing but an error."""
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"LC_ALL": "C.UTF-8"}
    with tempfile.TemporaryFile() as said:
        call = subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE, stderr=said, env=env)
        given, rest = 0, ""
        decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        while block := call.stdout.read(1 << 16):
            *whole, rest = (rest + decode(block)).split(_RECORD)
            for record in whole:
                if record:
                    given += 1
                    yield record
        call.stdout.close()
        if call.wait() == 0:
            if rest:
                yield rest
            return
        said.seek(0)
        error = said.read().decode(errors="replace").strip()[:500]
    if "does not have any commits" in error:
        return
    if otherwise is None or given:
        raise RuntimeError(f"git log: {error}")
    yield from _records(repo, otherwise)


class GitLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def staged_paths(repo: str) -> list[str]:
    return [x for x in git(repo, "diff", "--cached", "--name-only", "-z").split("\0") if x]


def staged_diff(repo: str, size: int = 120_000) -> tuple[str, bool]:
    """(diff of what is staged, whether it was cut): cut at a line end within size bytes, with the summary of all changes after it."""
    return _cut(git(repo, "diff", "--cached"), lambda: git(repo, "diff", "--cached", "--stat"), size)


def diff_of(repo: str, sha: str, size: int = 120_000) -> tuple[str, bool]:
    return _cut(git(repo, "show", "--format=", sha), lambda: git(repo, "show", "--format=", "--stat", sha), size)


def _cut(diff: str, summary, size: int) -> tuple[str, bool]:
    raw = diff.encode()
    if len(raw) <= size:
        return diff, False
    head = raw[:size]
    at = head.rfind(b"\n")
    return (head[:at] if at > 0 else head).decode(errors="ignore") + "\n\n" + summary(), True


def head(repo: str) -> dict:
    """sha, ts and branch of HEAD; empty before the first commit."""
    try:
        sha, when = git(repo, "log", "-1", "--format=%H %ct").split()
    except (RuntimeError, ValueError):
        return {}
    branch = git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip()
    return {"sha": sha, "ts": datetime.fromtimestamp(int(when), timezone.utc), "branch": branch}


def with_trailers(repo: str, message: str, trailers: list[tuple[str, str]]) -> str:
    """message with trailers added by git itself; empty values leave none."""
    args = [x for k, v in trailers if v for x in ("--trailer", f"{k}: {v}")]
    if not args:
        return message
    done = subprocess.run(["git", "-C", repo, "interpret-trailers", *args], input=message.encode(), capture_output=True, timeout=60, check=True)
    return done.stdout.decode()


def add_note(repo: str, sha: str, body: str) -> None:
    git(repo, "notes", "add", "-f", "-m", body, sha)
