"""Log and git sources, in batch and as streams."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loomwork.operators import delivery as batch
from loomwork.sources import gitlog, register, runlog, session_log
from loomwork.streaming import delivery, ingest


def line(kind="user", text="hi", **more):
    return json.dumps({"type": kind, "cwd": "/srv/r", "timestamp": "2025-01-01T00:00:00Z", "message": {"role": kind, "content": text}} | more) + "\n"


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "logs" / "-srv-r"
    folder.mkdir(parents=True)
    (folder / "s1.jsonl").write_text(line() + "not json\n" + line("assistant", [{"type": "text", "text": "x"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "a.py"}}, {"type": "tool_result", "is_error": True, "content": "bad"}]) + line("user", "unfinished").rstrip("\n"))
    (folder / "s2.jsonl").write_text(line(isSidechain=True) + line("user", [{"type": "text", "text": "injected"}]) + line("user", [{"type": "text", "text": "typed"}], promptId="p", aiTitle="T"))
    (folder / "empty.jsonl").write_text("")
    return str(tmp_path / "logs")


def read(spark, root, **options):
    register(spark)
    return spark.read.format("session_log").option("root", root).options(**options).load()


def test_batch_withholds_the_tail_and_resumes(spark, root):
    rows = read(spark, root).orderBy("path", "line_no").collect()
    assert [(r.session_id, r.line_no, r.readable) for r in rows] == [("s1", 0, True), ("s1", 1, False), ("s1", 2, True), ("s2", 0, True), ("s2", 1, True), ("s2", 2, True)]
    offsets = ingest.advanced(read(spark, root))
    path = rows[0].path
    with open(path, "a") as f:
        f.write("\n" + line("assistant", "late"))
    again = read(spark, root, offsets=json.dumps(offsets)).collect()
    assert [(r.session_id, r.line_no) for r in again] == [("s1", 3), ("s1", 4)]
    with open(path, "w") as f:
        f.write(line())
    assert read(spark, root, offsets=json.dumps(offsets)).count() == 1  # shorter than its offset: from the start
    assert read(spark, root, since=str(os.path.getmtime(path) + 100)).count() == 0


def test_messages_of_agent_a(spark, root):
    got = {(os.path.basename(r.session_key), r.seq): r for r in session_log.messages_a(read(spark, root)).collect()}
    assert set(got) == {("s1.jsonl", 0), ("s1.jsonl", 2), ("s2.jsonl", 1), ("s2.jsonl", 2)}
    call = got[("s1.jsonl", 2)].tools
    assert [(t.name, t.files, t.error) for t in call] == [("Edit", ["a.py"], None), ("result", [], "bad")]
    assert got[("s2.jsonl", 1)].meta and not got[("s2.jsonl", 2)].meta and not got[("s1.jsonl", 0)].meta and got[("s1.jsonl", 0)].ts is not None
    found = {r.session_id: (r.cwd, r.title) for r in session_log.sessions_of(read(spark, root), "/srv/r", "agent-a").collect()}
    assert found == {"s1": ("/srv/r", None), "s2": ("/srv/r", "T")} and session_log.sessions_of(read(spark, root), "/srv/r2", "a").count() == 0


def test_messages_of_agent_b(spark, tmp_path):
    folder = tmp_path / "p" / "agent-transcripts" / "i1"
    folder.mkdir(parents=True)
    rows = [{"role": "user", "message": {"content": [{"type": "text", "text": "<timestamp>t</timestamp>\n<user_query>do</user_query>"}]}}, {"role": "user", "message": {"content": [{"type": "text", "text": "no envelope"}]}}, {"turn": 1}, {"role": "assistant", "message": {"content": [{"type": "tool_use", "name": "write", "input": {"path": "a", "filePath": "a"}}]}}]
    (folder / "i1.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = session_log.messages_b(read(spark, str(tmp_path), layout="b")).orderBy("seq").collect()
    assert [(r.seq, r.role, r.text) for r in got] == [(0, "user", "do"), (3, "assistant", "")] and got[1].tools[0].files == ["a"]


def test_stream_reads_each_line_once(spark, root, tmp_path):
    target, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        q = ingest.log_stream(spark, root).writeStream.foreachBatch(ingest.append_once(target)).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    path = os.path.join(root, "-srv-r", "s1.jsonl")
    with open(path, "a") as f:
        f.write("\n" + line("assistant", "late"))
    run()
    rows = spark.read.parquet(target).groupBy("path", "start").count().collect()
    assert len(rows) == 8 and all(r["count"] == 1 for r in rows)


TOUCHES = [("s", 1, "a", False), ("s", 2, "b", False), ("s", 3, "a", False), ("t", 4, "a", False), ("s", 5, None, True), ("s", 6, "a", False), ("s", 7, "a", False), (None, 8, "a", False), ("t", 9, "a", False)]


def test_delivery_stream_is_the_batch(spark, tmp_path):
    schema = "session string, seq long, path string, reset boolean"
    source = tmp_path / "in"
    for i, part in enumerate((TOUCHES[:4], TOUCHES[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"b={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = delivery.once_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.session, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.session, r.seq) for r in batch.once(spark.createDataFrame(TOUCHES, schema).where("session is not null"), "session", ["seq"]).collect()}
    assert got == want == {("s", 1), ("s", 2), ("t", 4), ("s", 6)}


def test_touch_events_survive_garbage(spark):
    raw = ["", "x", "[]", '{"session_id": "s"}', '{"session_id": "s", "tool_input": {"path": "a"}}', '{"conversation_id": "s", "hook_event_name": "preCompact"}', '{"path": "a"}', None]
    got = delivery.touch_events(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "seq long, value string")).orderBy("seq").collect()
    assert [(r.seq, r.session, r.path, r.reset) for r in got] == [(4, "s", "a", False), (5, "s", None, True)]
    ctx = spark.createDataFrame([("a", "rules")], "path string, text string")
    assert delivery.serve_batches(spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "session string, seq long, path string"), ctx).count() == 1


def test_offsets_and_pending(tmp_path):
    folder = str(tmp_path)
    p = ingest.Pending(folder)
    assert p.settle("x") is None and ingest.load_offsets(p.offsets) == {}
    p.save("digest", {"a": 5}, "note")
    assert p.settle("other") is None and p.settle("digest") is None  # a stale token is gone
    p.save("digest", {"a": 5})
    assert p.settle("digest")["offsets"] == {"a": 5} and ingest.load_offsets(p.offsets) == {"a": 5}
    with open(p.offsets, "w") as f:
        f.write("{broken")
    assert ingest.load_offsets(p.offsets) == {}


def test_run_log(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "run.log")
    for i in range(5):
        runlog.append(path, f"run\n{i}", ["note a", "note\nb"] if i % 2 else [])
    got = runlog.entries(spark, path, 2).orderBy("entry").collect()
    assert [r.lines for r in got] == [3, 1] and got[0].text.split("\n")[0].endswith("run 3") and got[0].text.endswith("    note b")
    monkeypatch.setattr(runlog, "LIMIT", 300)
    for i in range(20):
        runlog.append(path, f"more {i}")
    assert os.path.getsize(path) < 300 and runlog.entries(spark, path).orderBy(F.desc("entry")).first().text.endswith("more 19")


@pytest.fixture
def repo(tmp_path):
    path = str(tmp_path / "repo")
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x.test", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x.test"}

    def git(*args, date=None, **kw):
        subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, env=env | ({"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date} if date else {}), **kw)

    os.makedirs(path)
    git("init", "-q", "-b", "main")
    for i, (name, message) in enumerate([("old.py", "first\n\nbody\n\nLoom-Agent: a\nLoom-Disputed: x\n  y\nLoom-Disputed: z"), ("b.py", "second"), (None, "move")]):
        if name:
            with open(os.path.join(path, name), "w") as f:
                f.write("x = 1\n" * 20 + name)
        else:
            git("mv", "old.py", "new.py")
        git("add", "-A")
        git("commit", "-q", "-m", message, date=f"2025-01-0{i + 1}T00:00:00+00:00")
    return path, git


def test_git_history(spark, repo):
    path, git = repo
    register(spark)
    load = lambda **o: spark.read.format("gitlog").option("repo", path).options(**o).load()
    rows = load(files="true").orderBy("ord").collect()
    assert [r.subject for r in rows] == ["move", "second", "first"] and rows[1].files == ["b.py"] and rows[2].body.startswith("body")
    assert [(t.key, t.value) for t in rows[2].trailers] == [("Loom-Agent", "a"), ("Loom-Disputed", "x y"), ("Loom-Disputed", "z")]
    assert [r.subject for r in load(path="new.py").orderBy("ord").collect()] == ["move", "first"]  # renames are followed
    assert load(limit="1").count() == 1
    gitlog.add_note(path, rows[1].sha, "noted") if _identity(git) else None
    assert gitlog.head(path)["branch"] == "main" and gitlog.head(path)["sha"] == rows[0].sha
    with open(os.path.join(path, "b.py"), "w") as f:
        f.write("y = 2\n" * 500)
    git("add", "-A")
    assert gitlog.staged_paths(path) == ["b.py"]
    diff, was_cut = gitlog.staged_diff(path, 300)
    assert was_cut and "1 file changed" in diff and len(diff.encode()) < 500 and not gitlog.staged_diff(path)[1]
    assert gitlog.diff_of(path, rows[1].sha)[0].startswith("diff --git")
    assert gitlog.with_trailers(path, "s\n\nb\n", [("Loom-Agent", "a"), ("Loom-Files", "")]).endswith("\n\nLoom-Agent: a\n")


def _identity(git):
    git("config", "user.name", "A")
    git("config", "user.email", "a@x.test")
    return True


@pytest.mark.parametrize("limit", [None, 3])
def test_history_in_ranges(spark, repo, limit):
    register(spark)
    r = spark.read.format("gitlog").option("repo", repo[0])
    r = r.option("limit", limit) if limit else r
    row = lambda x: (x.ord, x.sha, x.subject, x.body, x.note)
    whole = sorted(row(x) for x in r.load().collect())
    parts = r.option("partitions", 3).load()
    assert sorted(row(x) for x in parts.collect()) == whole and parts.rdd.getNumPartitions() > 1 and [x[0] for x in whole] == list(range(len(whole)))


def test_no_history(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    register(spark)
    assert spark.read.format("gitlog").option("repo", str(tmp_path)).load().count() == 0 and gitlog.head(str(tmp_path)) == {}


def test_new_slices_of_every_session(spark, root, tmp_path):
    """Old lines are not read again, slices without signal are dropped, a log that can't be read stops no other."""
    register(spark)
    folder = tmp_path / "logs" / "-srv-r"
    (folder / "more.jsonl").write_text(line(cwd="/srv/r", message={"role": "user", "content": "first"}) + line(message={"role": "user", "content": "second"}))
    (folder / "quiet.jsonl").write_text(line(cwd="/srv/r", message={"role": "user", "content": [{"type": "tool_result", "content": "x"}]}))
    (folder / "gone.jsonl").symlink_to(tmp_path / "gone")
    (tmp_path / "gone").mkdir()
    size = len(line(cwd="/srv/r", message={"role": "user", "content": "first"}))
    found, messages, errors = session_log.load_new(spark, "/srv/r", [("agent-a", "a", str(root)), ("agent-x", "unknown", str(root))], {str(folder / "more.jsonl"): size})
    more = str(folder / "more.jsonl")
    assert [(r.seq, r.text) for r in messages.where(F.col("session_key") == more).collect()] == [(1, "second")]
    keys = {r.session_key: r.cursor_bytes for r in found.collect()}
    assert keys[more] == (folder / "more.jsonl").stat().st_size and str(folder / "quiet.jsonl") not in keys
    assert {(r.agent, r.error.split(":")[0]) for r in errors.collect()} >= {("agent-a", "IsADirectoryError")} and {r.agent for r in errors.collect()} == {"agent-a", "agent-x"}


def test_a_checkpoint_can_be_discarded(spark):
    from loomwork.sources.stage import discard, staged

    df = staged(spark.range(10))
    assert df.count() == 10 and discard(df) and not discard(spark.range(3))


def test_pending_counts_at_once_without_a_hook(tmp_path):
    pending = ingest.Pending(str(tmp_path))
    pending.save("d", {"a": 5}, settles=False)
    assert ingest.load_offsets(pending.offsets) == {"a": 5} and pending.settle("d") is None
    pending.save("d", {"a": 9})
    assert ingest.load_offsets(pending.offsets) == {"a": 5} and pending.settle("d")["offsets"] == {"a": 9} and ingest.load_offsets(pending.offsets) == {"a": 9}


def test_trace_of_touches_and_overlong_events(spark):
    event = {"hook_event_name": "PreTool", "tool_name": "Edit", "session_id": "s"}
    raw = [json.dumps(event | {"tool_input": {"path": "a.py"}}), json.dumps(event | {"file_path": "b.py"}), "{", json.dumps({"path": "a.py"}), json.dumps(event), json.dumps(event | {"path": "x" * (1 << 20)})]
    df = spark.createDataFrame([(r,) for r in raw], "value string")
    contexts = spark.createDataFrame([("a.py", "é")], "path string, text string")
    got = sorted(((r.event, r.tool, r.session, r.path_key, r.path, r.bytes, r.why) for r in delivery.touch_trace(df, contexts).collect()), key=str)
    assert got == sorted(
        [
            ("PreTool", "Edit", "s", "tool_input.path", "a.py", 2, None), ("PreTool", "Edit", "s", "file_path", "b.py", 0, "no rules for the path"), (None,) * 5 + (0, "unreadable event"), (None,) * 5 + (0, "unreadable event"),
            (None, None, None, "path", "a.py", 2, "no session"), ("PreTool", "Edit", "s", None, None, 0, "no path"),
        ],
        key=str,
    )
    assert delivery.touch_events(df).count() == 2


def test_oldest_sessions_first(spark):
    from loomwork.operators import sessions

    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", None), ("d", 1)], "session_key string, t long").selectExpr("session_key", "timestamp_seconds(t) as updated_ts")
    assert [r.session_key for r in sessions.oldest_first(df).collect()] == ["c", "d", "a", "b"]
