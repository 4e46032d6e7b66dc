"""Operators that SQL can't check, on small fixtures against plain Python."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork import model
from loomwork.functions import payload, text
from loomwork.operators import compact, delivery, nested, record, rules, sequence, sessions
from loomwork.plans import catalog
from loomwork.settings import Settings, seconds
from loomwork.sources.rawjson import _deep, parse


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


# --- text --------------------------------------------------------------------------------------


def cut(s, n):
    raw = s.encode()
    if len(raw) <= n:
        return s
    return raw[:n].decode(errors="ignore") + "…"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
def test_truncate_keeps_characters(spark, n):
    samples = ["", "abc", "ééé", "a€b€", "😀x😀", "日本語テキスト"]
    df = spark.createDataFrame([(s,) for s in samples], "x string").select("x", text.truncate(F.col("x"), n).alias("y"), sequence._prefix_bytes(F.col("x"), n).alias("b"))
    for r in df.collect():
        assert r.y == cut(r.x, n)
        assert len(r.x.encode()) <= n or r.b == len(cut(r.x, n).encode()) - 3


@pytest.mark.parametrize("word,want", [("files", "fil"), ("file", "file"), ("caches", "cach"), ("uses", "use"), ("sessions", "session"), ("queries", "query"), ("classes", "classe"), ("ss", "ss"), ("is", "is")])
def test_singular(spark, word, want):
    assert one(spark, word, text.singular(F.col("x"))) == want


def test_wrappers_and_ids(spark):
    assert one(spark, "<system-reminder>a</system-reminder> b <timestamp>c", text.strip_wrappers(F.col("x"))) == "b"
    assert one(spark, "<user_query>\n do it </user_query> rest", text.unwrap_query(F.col("x"))) == "do it"
    assert one(spark, "no envelope", text.unwrap_query(F.col("x"))) == ""
    assert one(spark, "", text.sanitize_id(F.col("x"))) == "unnamed"
    assert one(spark, "/a/b.c", text.slug(F.col("x"), True)) == "a-b-c"
    assert one(spark, "a 　 b", text.collapse(F.col("x"))) == "a b"
    assert one(spark, "subject\n\nbody\n# note\n#\n", text.split_comment(F.col("x"))["body"]).rstrip("\n") == "subject\n\nbody"
    same = [one(spark, m, text.message_digest(F.col("x"))) for m in ("a\n\nb\n", "a  \n\n\nb\n# comment\n\n", "a\n\nb")]
    assert len(set(same)) == 1


@pytest.mark.parametrize("path,staged,hit", [("/r/pkg/gauge.go", "pkg/gauge.go", True), ("pkg/gauge.go", "pkg/gauge.go", True), ("./pkg/gauge.go", "pkg/gauge.go", True), ("/r/pkg/gauge.go.bak", "pkg/gauge.go", False), ("/r/other/gauge.go", "pkg/gauge.go", False), ("gauge.go", "pkg/gauge.go", False)])
def test_staged_path_is_a_suffix(spark, path, staged, hit):
    w = spark.createDataFrame([("s", path)], "session_key string, file string")
    assert (sessions.wrote_any(w, spark.createDataFrame([("c", staged)], "sha string, path string")).count() == 1) == hit


# --- rules -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "a,b,rule,plain",
    [
        ("keep the snapshot copy of the store file", "keep the snapshot copy of our store file", True, True),
        ("move the deadline to 30s", "move the deadline to 60s", True, False),  # a shared heavy word folds rules, not claims
        ("use approach 1 for the parser cache", "use approach 2 for the parser cache", False, False),
        ("north must stay open", "south must stay open", False, False),
        ("ok", "OK", True, True), ("", "x", False, False),
    ],
)
def test_same_rule(spark, a, b, rule, plain):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(*[x for x in (F.col("a"), F.col("b"))], text.tokens(F.col("a")).alias("ta"), text.tokens(F.col("b")).alias("tb"))
    got = df.select(text.same_rule(F.col("a"), F.col("b"), F.col("ta"), F.col("tb")).alias("r"), text.same_words(F.col("a"), F.col("b"), F.col("ta"), F.col("tb"), 0.55).alias("p")).first()
    assert (got.r, got.p) == (rule, plain)


def test_fold_keeps_the_longer_reason_in_the_earlier_place(spark):
    r = [("keep the snapshot copy of the store file", "short", ["a"]), ("other words entirely different here", "w", ["z"]), ("keep the snapshot copy of our store file", "a longer reason", ["b", "c", "d"])]
    df = spark.createDataFrame([(r,)], "r array<struct<rule string, why string, files array<string>>>").select(rules.fold_rules(F.col("r")).alias("f"))
    got = df.first().f
    assert [(x.rule, x.why, x.files) for x in got] == [(r[2][0], "a longer reason", ["a", "b", "c"]), (r[1][0], "w", ["z"])]


def test_fold_strings(spark):
    items = ["  the cache is cleared on exit ", "", None, "the cache is cleared on exits", "a b"]
    got = spark.createDataFrame([(items,)], "x array<string>").select(rules.fold_strings(F.col("x")).alias("y")).first().y
    assert got == ["the cache is cleared on exit", "a b"]


@pytest.mark.parametrize(
    "named,staged,want",
    [("a/x.go", ["a/x.go", "b/x.go"], "a/x.go"), ("x.go", ["a/x.go"], "a/x.go"), ("x.go", ["a/x.go", "b/x.go"], "a/x.go"), ("q/x.go", ["a/x.go", "b/x.go"], ""), ("q/x.go", ["a/x.go", "b/y.go"], "a/x.go"), ("q/x.go", ["a/x.go", "b/x.go", "q/x.go"], ""), ("/r/a/x.go", ["a/x.go"], "a/x.go"), ("n.go", ["a/x.go"], "")],
)
def test_matched_path(spark, named, staged, want):
    df = spark.createDataFrame([(named, staged)], "n string, s array<string>")
    assert df.select(rules.matched_path(F.col("n"), F.col("s")).alias("y")).first().y == want


def test_clean_rules(spark):
    staged = spark.createDataFrame([("c", ["src/a.py", "src/b.py"]), ("d", ["only.py"])], "sha string, staged array<string>")
    rows = [
        ("c", "reject", 0, "keep it", "it broke", ["a.py"]), ("c", "reject", 1, "no reason here", "Declined. ", ["a.py"]), ("c", "reject", 2, "this commit added it", "since", ["a.py"]), ("c", "reject", 3, "unbound", "since", ["z.py"]),
        ("c", "reject", 4, "none", "since", ["a.py"]), ("c", "reject", 5, None, "since", ["a.py"]), ("d", "invariant", 0, "bound by default", "since", None), ("c", "invariant", 0, "same words as the reason", "same words as the reason", ["a.py"]),
    ]
    got = rules.cleaned(spark.createDataFrame(rows, "sha string, kind string, pos long, rule string, why string, files array<string>"), staged).collect()
    assert sorted((r.sha, r.kind, r.pos, r.rule, r.files) for r in got) == [("c", "reject", 0, "keep it", ["src/a.py"]), ("d", "invariant", 0, "bound by default", ["only.py"])]


def test_confidence_ladder(spark):
    v = spark.createDataFrame([("a", 0, "supported"), ("a", 1, "Supported"), ("b", 0, "supported"), ("b", 1, "contradicted"), ("c", 0, "supported"), ("c", 1, "maybe"), ("a", 9, "contradicted")], "sha string, idx int, status string")
    claims = spark.createDataFrame([(s, i, f"{s}{i}") for s in "abc" for i in (0, 1)], "sha string, idx int, claim string")
    commits = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sha string")
    got = {r.sha: (r.confidence, r.disputed) for r in rules.confidence(commits, rules.attached(v, claims)).collect()}
    assert got == {"a": ("verified", []), "b": ("disputed", ["b1"]), "c": ("partial", []), "d": ("unverified", [])}


def test_fold_candidates_against_all_pairs(spark):
    rng = random.Random(2)
    words = ["parser", "cache", "timeout", "socket", "reader", "b12", "log", "index", "queue", "mirror"]
    rows = [(i, "g", " ".join(rng.sample(words, rng.randrange(1, 6)))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, grp string, rule string")
    got = {(r.a, r.b) for r in rules.fold_candidates(df, ["grp"], "id").collect()}
    a = df.select(F.col("id").alias("a"), F.col("rule").alias("ra"), text.tokens(F.col("rule")).alias("ta"))
    b = df.select(F.col("id").alias("b"), F.col("rule").alias("rb"), text.tokens(F.col("rule")).alias("tb"))
    want = {(r.a, r.b) for r in a.join(b, F.expr("a < b")).where(text.same_rule(F.col("ra"), F.col("rb"), F.col("ta"), F.col("tb"))).collect()}
    assert got == want and want


# --- sequences and compaction ------------------------------------------------------------------


def test_ladder():
    assert sequence.ladder() == [2000, 1500, 1125, 843, 632, 474, 355, 266, 240]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=8))
def test_roll_forward(spark, needs):
    got = spark.createDataFrame([([*needs],)], "n array<bigint>").select(sequence.roll_forward(F.col("n"), 100).alias("g")).first().g
    used, want = 0, []
    for i, need in enumerate(needs):
        want.append(min(need, (100 - used) // (len(needs) - i)))
        used += want[-1]
    assert got == want


MESSAGES = "session_key string, seq long, role string, text string, thinking string, meta boolean, tools array<struct<name string, files array<string>, summary string, error string>>, ts timestamp"


def test_compaction_keeps_every_request_and_the_tail(spark):
    rows = [("k", 0, "user", "<system-reminder>x</system-reminder>do it", None, False, None, None), ("k", 1, "user", "do it", None, False, None, None), ("k", 2, "user", "injected", None, True, None, None)]
    rows += [("k", 10 + i, "assistant", f"step {i} " + "y" * 60, None, False, [("Read", ["a.py"], "", None), ("Run", [], "make test", None if i % 9 else "exit 1")], None) for i in range(60)]
    m = spark.createDataFrame(rows, MESSAGES)
    s = spark.createDataFrame([("k", "0123456789", "agent-a", "big")], "session_key string, session_id string, agent string, model string")
    got = compact.payloads(m, s, 2000).first()
    assert got.requests == "--- session 01234567 (agent-a) ---\ndo it"
    lines = got.body.split("\n")
    assert lines[0] == "=== session 01234567 (agent-a) model=big ===" and "step 59" in got.body and "step 0 " not in got.body
    assert any("earlier messages elided" in x for x in lines) and lines[-1].startswith("[… ") and "routine" in lines[-1] and "injected" not in got.body
    assert len("\n".join(x for x in lines[1:-1] if not x.startswith("[…")).encode()) <= 2000


def test_repeats_collapse_in_bodies(spark):
    rows = [("k", i, "assistant", "", None, False, [("Read", ["a.py"], "", None)], None) for i in range(4)]
    s = spark.createDataFrame([("k", "id", "agent-b", None)], "session_key string, session_id string, agent string, model string")
    assert compact.bodies(spark.createDataFrame(rows, MESSAGES), s).first().body == "=== session id (agent-b) ===\n  · Read a.py ×4"


def compacted(spark, rows, members, budget):
    s = spark.createDataFrame([(k, f"{k}-id", "agent-a", None) for k in sorted({r[0] for r in rows})], "session_key string, session_id string, agent string, model string")
    m = spark.createDataFrame([(*r, None) for r in rows], MESSAGES)
    return compact.payload_sets(m, s, spark.createDataFrame([("c", k, i) for i, k in enumerate(members)], "set_id string, session_key string, place int"), budget).first()


def said(key, seq, text):
    return (key, seq, "assistant", text, None, False, None)


def test_a_set_of_sessions_shares_a_budget(spark):
    """Reasoning: every session keeps its share, oldest first, and what it leaves rolls on; requests are said once."""
    rows = [("s1", 0, "user", "do it", None, False, None), ("s2", 0, "user", "do it", None, False, None), ("s2", 1, "user", "and that", None, False, None)]
    rows += [said("s1", 10, "short")] + [said("s2", 10 + i, f"s2 step {i} " + "y" * 80) for i in range(30)] + [said("s3", 10 + i, f"s3 step {i} " + "z" * 80) for i in range(30)]
    got = compacted(spark, rows, ["s1", "s2", "s3"], 1500)
    assert got.requests == "--- session s1-id (agent-a) ---\ndo it\n--- session s2-id (agent-a) ---\nand that"
    kept = {k: got.body.count(f"{k} step") for k in ("s2", "s3")}
    room = 1500 - len(got.requests) - 1 - compact.RESERVE
    line = len("[agent] s2 step 29 " + "y" * 80) + 1
    first = len("[agent] short") + 1
    second = (room - first) // 2 // line
    assert kept == {"s2": second, "s3": (room - first - second * line) // line} and "[agent] short" in got.body
    assert [x.split()[2] for x in got.body.split("\n") if x.startswith("===")] == ["s1-id", "s2-id", "s3-id"]


def test_routine_calls_fill_from_the_newest_session(spark):
    call = lambda i: [("Run", [], f"make {i:03d}", None)]
    rows = [(k, i, "assistant", "", None, False, call(i)) for k in ("s1", "s2") for i in range(20)]
    body = compacted(spark, rows, ["s1", "s2"], 48 + 25 * 18).body
    lines = [x for x in body.split("\n") if x.startswith("  · ")]
    assert len(lines) == (25 * 18) // (len(lines[0].encode()) + 1) and body.split("\n")[-1] == f"[… {40 - len(lines)} routine tool calls not shown; see the staged diff …]"
    assert body.index("s1-id") < body.index("s2-id") and sum("make 0" in x for x in lines) == len(lines) and body.count("  · Run: make 019") == 2


def test_requests_alone_can_exceed_the_budget(spark):
    rows = [("s1", i, "user", f"{i} " + "w" * 900, None, False, None) for i in range(12)] + [said("s1", 50, "x")]
    got = compacted(spark, rows, ["s1"], 1000)
    assert got.body == "" and len(got.requests.split("\n")) == 13 and all(len(x.encode()) <= 243 for x in got.requests.split("\n"))
    assert [n.split(" ")[0] for n in got.notes] == ["all", "the", "the"] and "12 requests were sent; 12 of them were cut to 240 bytes" in got.notes[0]


def test_headers_count_when_requests_are_cut(spark):
    head = len("--- session s1-id (agent-a) ---") + 1
    rows = [("s1", i, "user", f"{i}" * 400, None, False, None) for i in range(3)]
    at = lambda allow: compacted(spark, rows, ["s1"], allow).requests.split("\n")[1]
    need = head + 3 * 401 - 1
    budget = next(b for b in range(need, 3 * need) if (b - 1) - int((b - 1) * 0.25) >= need)
    assert at(budget) == "0" * 400 and at(budget - 2).endswith("…")


def test_relevant_falls_back(spark):
    cand = spark.createDataFrame([("c1", "s1"), ("c1", "s2"), ("c2", "s1"), ("c2", "s2"), ("c3", "s1")], "sha string, session_key string")
    written = spark.createDataFrame([("s1", "/r/a.py")], "session_key string, file string")
    staged = spark.createDataFrame([("c1", "a.py"), ("c2", "z.py")], "sha string, path string")
    got = {(r.sha, r.session_key, r.skipped) for r in sessions.relevant(cand, written, staged).collect()}
    assert got == {("c1", "s1", 1), ("c2", "s1", 0), ("c2", "s2", 0), ("c3", "s1", 0)}


# --- records -----------------------------------------------------------------------------------


def test_wrap():
    shown = record.wrap("word " * 60, "reject: ", "  ")
    assert all(len(x.encode()) <= 76 for x in shown.split("\n")) and shown.startswith("reject: word") and shown.split("\n")[1].startswith("  word")
    assert record.wrap("x" * 100, "a: ", "  ").split("\n")[0] == "a: " + "x" * 100


def parsed(spark, body, note=None):
    rows = record.parsed(spark.createDataFrame([("s", body, note)], "sha string, body string, note string"), "rec").orderBy("pos").collect()
    return [(r.kind, r.rule, r.why, r.files) for r in rows]


def test_parser_traps(spark):
    assert parsed(spark, "text\n\n<rec>\nReject: a\n  b\nc\n  why: x\n  why: y\n    z\n  file: p, q\nfile: r\n\n  stray\ninvariant: d\n</rec>\n") == [("reject", "a b c", "y z", ["p", "q", "r"]), ("invariant", "d", None, [])]
    assert parsed(spark, "<rec>\nreject: open\n  reject: not a key") == [("reject", "open reject: not a key", None, [])]
    assert parsed(spark, " <rec>\nreject: a\n</rec>") == []
    assert parsed(spark, "<rec>\nreject: first\n</rec>", "<rec>\nreject: second\n</rec>") == [("reject", "first", None, [])]
    assert parsed(spark, None, "<rec>\nreject: n\n</rec>") == [("reject", "n", None, [])] and parsed(spark, None) == [] and parsed(spark, "") == []


def test_record_round_trip(spark):
    rows = [("s", "reject", 0, "rule " * 30, "because " * 20, ["a.py", "b/c.py"]), ("s", "invariant", 0, "short", None, None), ("t", "reject", 0, "other", "", [])]
    df = spark.createDataFrame(rows, "sha string, kind string, pos long, rule string, why string, files array<string>")
    back = record.parsed(record.rendered(df).select("sha", F.col("block").alias("body"), F.lit(None).cast("string").alias("note")), record.SESSION_RECORD)
    got = {(r.sha, r.kind, r.rule, r.why, tuple(r.files)) for r in back.collect()}
    assert got == {("s", "reject", ("rule " * 30).strip(), ("because " * 20).strip(), ("a.py", "b/c.py")), ("s", "invariant", "short", None, ()), ("t", "reject", "other", None, ())}


def test_serving_drops_whole_commits_and_says_so(spark):
    n = 120
    touches = spark.createDataFrame([("src/a.py", f"c{i:03}") for i in range(n)], "path string, sha string")
    commits = spark.createDataFrame([(f"c{i:03}", f"c{i:03}", i) for i in range(n)], "sha string, short string, t long").withColumn("ts", F.timestamp_seconds("t"))
    rs = spark.createDataFrame([(f"c{i:03}", "reject", 0, "x" * 200, ["src/a.py"]) for i in range(n)] + [("c119", "reject", 1, "not bound", ["b.py"]), ("c119", "invariant", 0, "base name", ["other/a.py"])], "sha string, kind string, pos long, rule string, files array<string>")
    packed = record.served(touches, rs, commits)
    block = record.served_text(packed).first()
    assert len(block.text.encode()) <= record.INJECTION_BYTES and block.dropped == 100 - block.commits > 0
    assert "c119\n  reject: " + "x" * 200 + "\n  invariant: base name\n" in block.text and "not bound" not in block.text and "c019" not in block.text
    assert json.loads(record.served_json(packed).first().json)["commits"][0]["commit"] == "c119"
    assert json.loads(one(spark, "hi", record.response(F.col("x"), "PreToolUse")))["hookSpecificOutput"]["additionalContext"] == "hi"


def test_trailers(spark):
    body = "text\n\nLoom-Agent: a\nLoom-Disputed: one\nLoom-Disputed: two\n  folded\n"
    df = spark.createDataFrame([("s", body), ("t", "text: not last\n\nmore"), ("u", None)], "sha string, body string")
    assert [(r.key, r.value) for r in record.trailers(df).orderBy("pos").collect()] == [("Loom-Agent", "a"), ("Loom-Disputed", "one"), ("Loom-Disputed", "two folded")]


# --- nested records ----------------------------------------------------------------------------

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("ab.", max_size=2), x, max_size=3), max_leaves=20)


def walk(x, path="", holder="", inside=False):
    if isinstance(x, dict):
        if inside:
            yield path, holder
            holder = path
        for k, v in x.items():
            yield from walk(v, (path + "." if path else "") + k, holder)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from walk(v, f"{path}[{i}]", holder, True)


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_containment_links(value):
    for scalars in (True, False):
        nodes = nested.label(value, scalars=scalars)
        assert [n[0] for n in nodes] == list(range(len(nodes)))
        for n in nodes:
            for m in nodes[n[0] + 1 :]:
                assert m[1] <= n[1] or m[0] > n[1]  # intervals nest or are apart
        assert sorted((n[3], p[3] if p else "") for n, p in nested.elements(nodes)) == sorted(walk(value))


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_parser_without_recursion(value):
    assert _deep(json.dumps(value)) == value == parse(json.dumps(value))


def test_nested_tables(spark):
    deep = "[" * 20_000 + '{"a": 1}' + "]" * 20_000
    use = {"content": [None, {"type": "tool_use", "input": json.dumps({"edits": [{"x": [{"y": 1}]}]})}, {"type": "text", "input": '[{"no": 1}]'}]}
    rows = [(1, json.dumps(use), None, "k"), (2, json.dumps(json.dumps(use)), '[{"a": []}]', "k"), (3, "{", "plain text [", "k"), (4, None, json.dumps('{"r": [{}]}'), "k"), (5, None, deep, None)]
    df = spark.createDataFrame(rows, "entry_id long, message string, tool_use_result string, root string")
    got = {(r.entry_id, r.root, r.node_path, r.parent_path) for r in nested.array_objects(df).where("entry_id < 5").collect()}
    of = lambda e: {(e, "message", "content[1]", ""), (e, "message", "content[2]", ""), (e, "message", "content[1].input.edits[0]", "content[1]"), (e, "message", "content[1].input.edits[0].x[0]", "content[1].input.edits[0]")}
    assert got == of(1) | of(2) | {(2, "tool_use_result", "[0]", ""), (4, "tool_use_result", "r[0]", "")}
    assert nested.array_objects(df).where("entry_id = 5").count() == 1
    every = nested.nodes(df.where("entry_id < 5"))
    tables = nested.node_tables(every)
    assert sum(t.count() for t in tables.values()) == every.count()
    inside = nested.below(tables["scalar"], tables["array"].where("node_path = 'content'"))
    assert inside.where("entry_id = 1 and node_path = 'content[1].type'").count() == 1 and inside.where("entry_id = 4").count() == 0
    assert nested.array_objects(df.limit(0)).count() == 0


# --- delivery, JSON, model, settings -----------------------------------------------------------


def test_once_with_resets_and_force(spark):
    rows = [("s", 1, "a", False, False), ("s", 2, "a", False, False), ("s", 3, None, True, False), ("s", 4, "a", False, False), ("t", 5, "a", False, False), ("s", 6, "a", False, True)]
    df = spark.createDataFrame(rows, "user string, at long, path string, reset boolean, forced boolean")
    assert {r.at for r in delivery.once(df, "user", ["at"]).collect()} == {1, 4, 5}
    assert {r.at for r in delivery.once(df, "user", ["at"], forced="forced").collect()} == {1, 4, 5, 6}


@pytest.mark.parametrize(
    "answer,want",
    [('{"a": 1}', '{"a": 1}'), ('x\n```json\n{"a": "}"}\n```\ny {"b": 2}', '{"a": "}"}'), ('so {"a": {"b": "\\"}"}} end}', '{"a": {"b": "\\"}"}}'), ("", None), ("none", None), ('{"a": 1', None), (None, None)],
)
def test_json_object(answer, want):
    assert model.json_object(answer) == want


def test_model_map_reports_each_failure(spark):
    df = spark.createDataFrame([(i, ["yes", "no", "", None][i % 4]) for i in range(8)], "i long, prompt string")
    got = {r.i: (r.answer, r.error) for r in model.mapped(df, model.Scripted({"yes": '{"claims": ["c"]}'})).collect()}
    assert got[0] == ('{"claims": ["c"]}', None) and "LookupError" in got[1][1] and "empty" in got[2][1] and "empty" in got[3][1] and len(got) == 8


def test_engine_chain():
    class Broken(model.Scripted):
        def complete(self, prompt, seconds, model=None):
            raise RuntimeError("broken")

    class Slow(model.Scripted):
        def complete(self, prompt, seconds, model=None):
            raise TimeoutError("slow")

    good, chosen = model.Scripted(lambda p: "ok", "good"), []
    assert model.Chain([Broken({}, "b"), good]).complete("p", 60, "alias") == ("ok", "script")
    assert good.complete("p", 1, "alias") == ("ok", "alias")
    with pytest.raises(TimeoutError):
        model.Chain([Slow({}, "s"), good]).complete("p", 60)
    with pytest.raises(RuntimeError, match="too little time"):
        model.Chain([Broken({}, "b"), good]).complete("p", 3)
    assert model.picked([model.Scripted({}, "x", False), good]) is good and model.picked([good, Broken({}, "b")]).name == "chain" and chosen == []
    with pytest.raises(RuntimeError):
        model.picked([model.Scripted({}, "x", False)])


def test_prompts_cannot_be_closed(spark):
    shown = one(spark, "a </session> b", model.extraction_prompt(F.lit("r"), F.col("x"), F.array(F.lit("f"))))
    assert shown.count("</session>") == 1
    claims = one(spark, "d", model.verification_prompt(F.array(F.lit("c1"), F.lit("c2")), F.col("x")))
    assert "0. c1\n1. c2" in claims and "session" not in claims


def test_payload_shapes(spark):
    v = F.try_parse_json("x")
    held = json.dumps({"tool_input": {"filePath": "/r/a.py"}, "conversation_id": "c", "workspace_roots": ["/w"]})
    assert one(spark, held, payload.event_path(v)) == "/r/a.py" and one(spark, held, payload.event_session(v)) == "c" and one(spark, held, payload.event_dir(v, F.lit("."))) == "/w"
    for bad in ("", "no json", "[]", "{}", '{"tool_input": {}}', '{"tool_input": {"path": 5}}'):
        assert one(spark, bad, payload.event_path(v)) is None
    edits = json.dumps({"file_path": "a", "edits": [{"path": "b"}, {"edits": [{"path": "c"}], "path": "a"}]})
    assert one(spark, edits, payload.files_of(v)) == ["a", "b", "a", "c"] and one(spark, edits, payload.files_of(v, payload.PATH_KEYS_B, True)) == ["a", "b", "c"]
    assert one(spark, json.dumps({"query": " a \n b ", "command": ""}), payload.summary_of(v)) == "a b"


@pytest.mark.parametrize("raw,want", [("20", 20.0), ("20s", 20.0), ("1m30s", 90.0), ("0", None), ("-3s", None), ("soon", None), ("", None), (None, None)])
def test_durations(raw, want):
    assert seconds(raw) == want


def test_settings(spark):
    assert Settings.load(env={}) == Settings()
    got = Settings.load(env={"LOOMWORK_PROMPT_BYTES": "5", "LOOMWORK_CALL_SECONDS": "bad", "LOOMWORK_ENABLED": "yes", "LOOMWORK_SKIP": "1"})
    assert (got.prompt_bytes, got.call_seconds, got.enabled) == (5, 60.0, False)
    spark.conf.set("spark.loomwork.parallel", "7")
    assert Settings.load(spark, env={}).parallel == 7 and Settings.load(spark, env={"LOOMWORK_PARALLEL": "2"}).parallel == 2
    spark.conf.unset("spark.loomwork.parallel")


# --- queries over all rows, against plain Python -------------------------------------------------


def first_messages(spark, sf, *columns):
    """Messages without repeated rows, by session and number."""
    rows = spark.read.parquet(f"{sf}/messages.parquet").where("session_key is not null and seq is not null").select("session_key", "seq", "message_id", *columns).collect()
    return {(r.session_key, r.seq): r for r in sorted(rows, key=lambda r: r.message_id, reverse=True)}


def test_cap_ladder_over_all_texts(spark, sf):
    texts = {}
    for (key, _), r in first_messages(spark, sf, "text").items():
        if r.text is not None:
            texts.setdefault(key, []).append(r.text)
    assert any(not t.isascii() for ts in texts.values() for t in ts)
    want = set()
    for key, ts in texts.items():
        sizes = {c: sum(len(cut(t, c).encode()) + 3 for t in ts) for c in sequence.ladder()}
        cap = max((c for c in sizes if sizes[c] <= 1500), default=240)
        want.add((key, cap, sizes[cap], sum(len(t.encode()) > cap for t in ts)))
    assert {tuple(r) for r in catalog.queries()["cap_ladder"](spark, sf).collect()} == want


def tool_lines_in_python(tools):
    flat = lambda x: " ".join((x or "").split())
    lines = []
    for t in tools[:12]:
        if not t["error"]:
            files, summary = t["files"] or [], t["summary"]
            lines.append("  · " + (t["name"] or "") + (" " + ", ".join(f for f in files if f is not None) if files else ": " + cut(flat(summary), 200) if summary else ""))
    if len(tools) > 12:
        lines.append(f"  · … {len(tools) - 12} more tool calls")
    return sum(bool(t["error"]) for t in tools[:12]), "\n".join(lines)


def test_tool_lines_of_all_messages(spark, sf, tmp_path):
    def same(folder):
        want = {(k, n, *tool_lines_in_python(r.tools)) for (k, n), r in first_messages(spark, folder, "tools").items() if r.tools is not None}
        assert {tuple(r) for r in catalog.queries()["tool_lines"](spark, folder).collect()} == want
        return want

    same(sf)
    calls = [("Bash", None, "é" * 150, None), ("Read", ["a.py"], None, None), ("Bash", [], "x " * 150, "boom")]
    rows = [("k", 0, 1, "assistant", False, None, None, calls), ("k", 1, 2, "assistant", False, None, None, [("Bash", None, "s" * 200, None)] * 14), ("k", 2, 3, "user", False, None, None, None)]
    ddl = "session_key string, seq long, message_id long, role string, meta boolean, text string, thinking string, tools array<struct<name string, files array<string>, summary string, error string>>"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "messages.parquet"))
    assert ("k", 0, 1, "  · Bash: " + "é" * 100 + "…\n  · Read a.py") in same(str(tmp_path))


def test_registered_payloads_have_the_whole_budget(spark, tmp_path):
    calls = "array<struct<name string, files array<string>, summary string, error string>>"
    rows = [("k", i, i, "assistant", False, f"step {i} " + "x" * 500, None, None) for i in range(100)]
    spark.createDataFrame(rows, f"session_key string, seq long, message_id long, role string, meta boolean, text string, thinking string, tools {calls}").write.parquet(str(tmp_path / "messages.parquet"))
    session = "session_key string, session_id string, agent string, model string, updated_ts timestamp, cursor_bytes long, complete boolean, title string, branch string, cwd string"
    spark.createDataFrame([("k", "id", "a", *[None] * 7)], session).write.parquet(str(tmp_path / "sessions.parquet"))
    body = catalog.queries()["session_payloads"](spark, str(tmp_path)).first().body
    assert compact.BUDGET - 600 < len(body.encode()) <= compact.BUDGET + 200 and "step 99 " in body and "step 0 " not in body
    prompts = []
    real, model.mapped = model.mapped, lambda numbered, engine: prompts.append(numbered) or real(numbered, engine)
    try:
        catalog.queries()["model_map"](spark, str(tmp_path))
    finally:
        model.mapped = real
    assert body in prompts[0].first().prompt


def test_claims_keep_short_ones(spark):
    got = spark.createDataFrame([(["ok", "  ", "none", "a"],)], "c array<string>").select(rules.cleaned_claims(F.col("c")).alias("x")).first().x
    assert got == ["ok", "a"]


def test_named_paths_are_cleaned(spark):
    named = ["./src//a.py", "/w/./src/a.py/", "lib/../src/a.py", "..", "", " a.py "]
    got = spark.createDataFrame([(n, ["src/a.py", "b.py"]) for n in named], "n string, s array<string>").select(rules.matched_path(F.col("n"), F.col("s")).alias("x")).collect()
    assert [r.x for r in got] == ["src/a.py", "src/a.py", "src/a.py", "", "", "src/a.py"]


def test_files_of_edits_at_any_depth(spark):
    deep = {"path": "a", "edits": [{"path": "b", "edits": [{"path": "c", "edits": [{"path": "d"}]}, {"edits": [{"path": "e"}]}]}, None, {"file_path": "f", "path": "g"}]}
    rows = [(json.dumps(deep),), ('{"path": "x"}',), ('{"edits": []}',), ('{"edits": "no"}',), (None,)]
    got = spark.createDataFrame(rows, "j string").select(payload.files_of(F.try_parse_json("j")).alias("x")).collect()
    assert [r.x for r in got] == [["a", "b", "c", "d", "e", "f", "g"], ["x"], [], [], []]


def test_a_record_as_a_person_reads_it(spark):
    commits = spark.createDataFrame([("c1", "c1s", "Keep the log"), ("c2", "c2s", "Nothing")], "sha string, short string, subject string")
    held = spark.createDataFrame([("c1", "agent-a", "disputed", ["it is " + "long " * 20])], "sha string, agent string, confidence string, disputed array<string>")
    entries = spark.createDataFrame([("c1", "invariant", 0, "never cut a line", None, []), ("c1", "reject", 1, "no cache " * 12, "it leaked", ["a.py", "b.py"])], "sha string, kind string, pos int, rule string, why string, files array<string>")
    got = {r.sha: r.text.split("\n") for r in record.printed(commits, held, entries).collect()}
    assert got["c2"] == ["c2s  Nothing", "", "No record on this commit."]
    shown = got["c1"]
    assert shown[0] == "c1s  Keep the log" and shown[1].startswith("  reject: no cache") and shown[2].startswith("  ") and "      why: it leaked" in shown and "      file: a.py, b.py" in shown
    assert shown.index("  invariant: never cut a line") > 2 and shown[-1] == "  [agent-a, disputed]" and any(x.startswith("  ⚠ the diff contradicts: it is") for x in shown)


@pytest.mark.parametrize("block", [1000, 5])
def test_a_group_of_many_alike_rules(spark, monkeypatch, block):
    monkeypatch.setattr(rules, "BLOCK", block)
    rows = [("c", i, f"keep the cache of page {'abcdefgh'[i % 4]} local") for i in range(40)] + [("d", 100 + i, "no lock here ever again") for i in range(3)]
    df = spark.createDataFrame(rows, "sha string, id int, rule string")
    got = {(r.a, r.b) for r in rules.fold_candidates(df, ["sha"], "id").collect()}
    assert got == {(a, b) for x, a, _ in rows for y, b, _ in rows if a < b and x == y}
