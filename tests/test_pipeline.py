"""The whole run with scripted engines, and what happens when they fail."""

import json

import pytest
from pyspark.sql import functions as F

from loomwork import model
from loomwork.operators import record
from loomwork.plans import pipeline
from loomwork.sources import register, session_log

MESSAGES = "session_key string, seq long, role string, text string, thinking string, meta boolean, tools array<struct<name string, files array<string>, summary string, error string>>"
EXTRACTION = {"rejected": [{"rule": "no global cache", "why": "it leaked between tests", "files": ["a.py"]}, {"rule": "unsaid", "why": "n/a", "files": ["a.py"]}], "invariants": [], "claims": ["the cache is local now", "ok"]}


def answer(value):
    def say(prompt):  # a closure, as workers can't import this module
        if isinstance(value, Exception):
            raise value
        return "Sure:\n```json\n" + json.dumps(value) + "\n```"

    return say


@pytest.fixture
def tables(spark):
    m = spark.createDataFrame([("s1", 0, "user", "make the cache local", None, False, None), ("s1", 1, "assistant", "done", None, False, [("Edit", ["/r/src/a.py"], "", None)]), ("s2", 0, "user", "look", None, False, None), ("s2", 1, "assistant", "x", None, False, [("Read", ["/r/src/a.py"], "", None)])], MESSAGES)
    known = spark.createDataFrame([("s1", "id1", "agent-a", "m"), ("s2", "id2", "agent-b", None)], "session_key string, session_id string, agent string, model string")
    cand = spark.createDataFrame([("c1", "s1"), ("c1", "s2")], "sha string, session_key string")
    files = spark.createDataFrame([("c1", "src/a.py"), ("c1", "src/b.py")], "sha string, path string")
    return cand, m, known, files, spark.createDataFrame([("c1", "+x = 1")], "sha string, diff string")


def run(tables, extract, verify):
    return pipeline.run(*tables, model.Scripted(answer(extract)), model.Scripted(answer(verify))).first()


def test_verified(spark, tables):
    got = run(tables, EXTRACTION, {"claims": [{"index": 0, "status": "supported", "note": ""}, {"index": 7, "status": "contradicted", "note": ""}]})
    assert (got.confidence, got.disputed, got.sessions, got.skipped) == ("verified", [], 1, 1)
    back = record.parsed(spark.createDataFrame([("c1", got.block, None)], "sha string, body string, note string"), record.SESSION_RECORD).collect()
    assert [(r.kind, r.rule, r.why, r.files) for r in back] == [("reject", "no global cache", "it leaked between tests", ["src/a.py"])]


def test_verdicts_by_the_numbers_that_the_prompt_shows(tables):
    import re

    def verify(prompt):
        named = re.findall(r"^(\d+)\. (.*)$", prompt, re.M)
        return json.dumps({"claims": [{"index": int(n), "status": "contradicted" if c == "ok" else "supported", "note": ""} for n, c in named]})

    got = pipeline.run(*tables, model.Scripted(answer(EXTRACTION)), model.Scripted(verify)).first()
    assert (got.confidence, got.disputed) == ("disputed", ["ok"])  # the short claim stays and keeps its own verdict


def test_the_oldest_session_comes_first(spark):
    value = lambda rule: (([], [(rule, "it leaked between tests", ["a.py"])], []),)
    found = spark.createDataFrame([("s1", *value("keep the cache of pages local")), ("s2", *value("keep the local cache of pages"))], f"session_key string, value {model.EXTRACTION}")
    linked = spark.createDataFrame([("c", "s1", 9), ("c", "s2", 3)], "sha string, session_key string, t long").selectExpr("sha", "session_key", "timestamp_seconds(t) as updated_ts")
    kept, _, folded = pipeline.distilled(linked, found, spark.createDataFrame([("c", ["a.py"])], "sha string, staged array<string>"))
    assert [r.rule for r in kept.collect()] == ["keep the local cache of pages"]
    assert [tuple(r) for r in folded.collect()] == [("c", 0, 1)]


def test_json_object():
    assert [model.json_object(t) for t in ('so {"a": "}{", "b": {"c": "\\"}"}} end', "none", "{", "}{}", None)] == ['{"a": "}{", "b": {"c": "\\"}"}}', None, None, "{}", None]


def test_degraded(tables):
    late = run(tables, EXTRACTION, TimeoutError("late"))
    assert late.confidence == "unverified" and "no global cache" in late.block
    none = run(tables, RuntimeError("down"), {"claims": []})
    assert (none.confidence, none.block) == ("metadata-only", "")
    skipped = "1 of 2 sessions wrote none of the staged files and were left out"
    assert late.notes == [skipped, "verification failed: TimeoutError: late"] and none.notes == [skipped, "id1 (agent-a) not distilled: RuntimeError: down"]


def test_notes_of_a_run(spark, tables):
    """Nothing to distill, degraded sessions, a cut diff, unusable answers, no time for the second pass."""
    cand, m, known, files, diffs = tables
    worn = known.withColumn("degraded_reason", F.when(F.col("session_key") == "s1", "half a log").otherwise(""))
    cut = diffs.withColumn("truncated", F.lit(True))
    got = pipeline.run(cand, m, worn, files, cut, model.Scripted(lambda p: "no object here"), model.Scripted(answer({"claims": []}))).first()
    assert got.confidence == "metadata-only" and got.notes[1:] == [
        "agent-a session read degraded: half a log", "the diff was cut, so claims on the rest cannot be verified", "id1 (agent-a) not distilled: unusable JSON"
    ]
    silent = m.where("role = 'user'").withColumn("meta", F.lit(True))
    none = pipeline.run(cand, silent, known, files, diffs, model.Scripted(answer(EXTRACTION)), model.Scripted(answer({"claims": []}))).first()
    assert none.confidence == "metadata-only" and none.notes == ["nothing to distill from 2 session(s)"]

    def slow(prompt):
        import time

        time.sleep(0.5)
        return json.dumps(EXTRACTION)

    late = pipeline.run(cand, m, known, files, diffs, model.Scripted(slow), model.Scripted(answer({"claims": []})), seconds=model.RESERVE_S + 0.2).first()
    assert late.confidence == "unverified" and late.notes[-1].startswith("verification skipped: 3.") and "no global cache" in late.block


def test_the_first_pass_leaves_the_reserve(spark, tables):
    seen = []

    class Watch(model.Scripted):
        def complete(self, prompt, seconds, name=None):
            return json.dumps(EXTRACTION | {"claims": [f"{seconds:.0f} s"]}), "watch"

    found = pipeline.extracted(tables[1], tables[2], Watch({}), seconds=30)
    seen = {r.session_key: r.value.claims for r in found.collect()}
    assert seen == {"s1": ["26 s"], "s2": ["26 s"]}


def test_guard_and_headline(spark):
    df = spark.createDataFrame([(None, "m", 1), ("merge", "m", 1), (None, "m\n\n<rec>\nreject: a\n</rec>", 1), (None, "m", 0), ("message", None, 2)], "s string, m string, n int")
    assert [r.x for r in df.select(record.needs_record(F.col("s"), F.col("m"), F.col("n"), name="rec").alias("x")).collect()] == [True, False, False, False, True]
    shown = spark.createDataFrame([(1, 2, "verified"), (0, 0, "metadata-only")], "r int, i int, c string").select(record.headline(F.col("r"), F.col("i"), F.col("c")).alias("h"))
    assert [r.h for r in shown.collect()] == ["1 rejected, 2 invariants (verified)", "no rules (metadata-only)"]


def test_readers_fail_by_themselves(spark, tmp_path):
    register(spark)
    (tmp_path / "-srv-r").mkdir()
    (tmp_path / "-srv-r" / "s.jsonl").write_text('{"type": "user"}\n')
    found, failed = session_log.all_sessions(spark, "/srv/r", [("agent-a", "a", str(tmp_path)), ("agent-x", "unknown", str(tmp_path))])
    assert [r.session_id for r in found.collect()] == ["s"] and len(failed) == 1 and failed[0].startswith("agent-x")
