import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import conversations as C

COLUMNS = "entry_id long, session_id string, line_no long, entry_type string, ts string, prompt_id string, is_sidechain boolean, message string, range int, user boolean, time string, parent long"


def line(n, no, role, text="hi", ts="2025-01-01T00:00:00Z", session="S", kind=None, side=False, prompt=None, content=None, message=""):
    held = json.dumps({"role": role, "content": text if content is None else content}) if message == "" else message
    return (n, session, no, kind or role.lower(), ts, prompt, side, held, 1, True, "x", 0)


def found(spark, rows):
    return sorted(tuple(r) for r in C.conversations(spark.createDataFrame(rows, COLUMNS)).collect())


def test_order_by_time_then_line_and_lower_case(spark):
    rows = [
        line(1, 0, "user", ts="2025-01-01T00:00:05+00:00", session="Ab"),
        line(2, 1, "Assistant", ts="2025-01-01T00:00:09Z", session="aB"),
        line(3, 2, "USER", ts="2025-01-01T00:00:01Z", kind="user", session="AB"),
        line(4, 3, "assistant", ts=None, session="ab"),
    ]
    assert found(spark, rows) == [("ab", 0, 3), ("ab", 1, 4), ("ab", 2, 1), ("ab", 3, 2)]


def test_broken_ones_are_dropped(spark):
    good = [line(1, 0, "user", session="ok"), line(2, 1, "assistant", session="ok")]
    bad = {
        "gap": [line(3, 0, "user"), line(4, 2, "assistant")],
        "unanswered": [line(3, 0, "user"), line(4, 1, "assistant"), line(5, 2, "user")],
        "answer first": [line(3, 0, "assistant"), line(4, 1, "user")],
        "two prompts": [line(3, 0, "user"), line(4, 1, "user"), line(5, 2, "assistant")],
        "unreadable": [line(3, 0, "user"), line(4, 1, "assistant"), line(5, 2, "assistant", message='{"role": "assi')],
        "null message": [line(3, 0, "user"), line(4, 1, "assistant"), line(5, 2, "assistant", message=None)],
        "empty": [line(3, 0, "user", text=" \n"), line(4, 1, "assistant", text="")],
    }
    for why, rows in bad.items():
        assert found(spark, good + rows) == [("ok", 0, 1), ("ok", 1, 2)], why


def test_turns_and_flags(spark):
    text, result = {"type": "text", "text": "x"}, {"type": "tool_result", "content": "y"}
    rows = [
        line(10, 0, "user", content=[text], prompt="p"),
        line(11, 1, "assistant", content=[{"type": "text", "text": None}, None, text], side=None),
        line(12, 2, "user", content=[text]),  # no prompt id
        line(13, 3, "user", content=[text, result], prompt="p"),
        line(14, 4, "user", side=True),
        line(15, 5, "system"),
        line(16, 6, "assistant", message=json.dumps(json.dumps({"role": "assistant", "content": "in a string"}))),
        line(17, 6, "user"),  # sent again: the lowest entry counts
        (18, None, 7, "user", None, None, False, "{}", 1, True, "x", 0),
        (19, "S", None, "user", None, None, False, "{", 1, True, "x", 0),
    ]
    assert found(spark, rows) == [("s", 0, 10), ("s", 1, 11), ("s", 2, 16)]


def test_missing_times_come_first_or_follow(spark):
    rows = [line(1, 0, "user", ts="yesterday"), line(2, 1, "assistant", ts=None), line(3, 2, "user", ts="2025-01-01T00:00:00"), line(4, 3, "assistant", ts="2025-01-01T00:00:00Z"), line(5, 4, "assistant", ts="2025-02-30T00:00:00Z")]
    assert [r[2] for r in found(spark, rows)] == [1, 2, 3, 4, 5]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_same_result_in_many_ranges_and_blocks(spark, monkeypatch):
    rng = random.Random(7)
    rows, n = [], 0
    for s in range(3):
        for no in range(400):
            n += 1
            ts = rng.choice([None, "2025-01-01T00:00:%02dZ" % rng.randrange(60), "2025-01-01T00:00:00Z"])
            rows.append(line(n, no, "user" if no == 0 else "assistant", ts=ts if no else "2024-01-01T00:00:00Z", session=f"s{s}"))
    whole = found(spark, rows)
    monkeypatch.setattr(C, "BLOCK_LINES", 16)
    monkeypatch.setattr(C, "RANGE_TURNS", 50)
    assert found(spark, rows) == whole and len(whole) == 1200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=12), st.integers(1, 10))
def test_kahn_against_its_definition(edges, n):
    nodes = [(i % 4, i) for i in range(n)]
    order, left = C.kahn(nodes, edges)
    assert sorted(order + left) == list(range(n))
    place = {x: i for i, x in enumerate(order)}
    for p, c in edges:
        if p < n and c < n and c in place:
            assert p in place and place[p] < place[c]
    known = [(p, c) for p, c in set(edges) if p < n and c < n]
    for x in left:
        assert any(c == x and p in left for p, c in known)


def test_replies_and_faults_are_read_off_the_graph(spark):
    assert C.reply_edges([((2, 0), "c", True), ((0, 0), "a", True), ((1, 0), "b", False), ((1, 1), "d", False)]) == [("a", "b"), ("a", "d"), ("d", "c")]
    rows = [line(1, 0, "user", session="ok"), line(2, 1, "assistant", session="ok"), line(3, 0, "user", session="open"), line(4, 1, "user", session="open"), line(5, 2, "assistant", session="open"), line(6, 3, "user", session="open")]
    rows += [line(7, 0, "assistant", session="first"), line(8, 1, "user", session="first"), line(9, 2, "assistant", session="first"), line(10, 0, "user", session="gap"), line(11, 2, "assistant", session="gap")]
    got = {r.session_id: (r.lines, r.turns, r.missing, r.unread, r.unanswered, r.unasked, r.left_over, r.kept) for r in C.session_report(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {"ok": (2, 2, 0, 0, 0, 0, 0, True), "open": (4, 4, 0, 0, 2, 0, 0, False), "first": (3, 3, 0, 0, 0, 1, 0, False), "gap": (2, 2, 1, 0, None, None, None, False)}


def test_faults_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE_TURNS", 2)
    rng = random.Random(3)
    rows, want, n = [], {}, 0
    for s in range(40):
        roles = [rng.choice(["user", "assistant"]) for _ in range(rng.randrange(2, 12))]
        if s % 2:
            roles = ["user", "assistant"] * rng.randrange(1, 6)
        for no, role in enumerate(roles):
            n += 1
            rows.append(line(n, no, role, ts="2025-01-01T00:00:%02dZ" % no, session=f"s{s}"))
        want[f"s{s}"] = roles[0] == "user" and roles[-1] == "assistant" and not any(a == b == "user" for a, b in zip(roles, roles[1:]))
    got = {r.session_id: r.kept for r in C.session_report(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == want
    assert {r[0] for r in found(spark, rows)} == {s for s, k in want.items() if k}


def test_reply_order_shows_cycles(spark):
    df = spark.createDataFrame([("g", 1, None, 5), ("g", 2, 1, 9), ("g", 3, 1, 1), ("g", 4, 5, 0), ("g", 5, 4, 0), ("h", 6, 99, None)], "grp string, id long, parent long, at long")
    got = {r.id: (r.place, r.cyclic) for r in C.reply_order(df, "grp", "id", "parent", "at").collect()}
    assert got == {1: (0, False), 3: (1, False), 2: (2, False), 4: (None, True), 5: (None, True), 6: (0, False)}


def test_reply_order_refuses_groups_beyond_a_task(spark, monkeypatch):
    monkeypatch.setattr(C, "GROUP_NODES", 2)
    df = spark.createDataFrame([("g", i, None, i) for i in range(3)], "grp string, id long, parent long, at long")
    with pytest.raises(ValueError):
        C.reply_order(df, "grp", "id", "parent", "at")


@pytest.mark.parametrize("ts,ok", [("2025-01-01T00:00:00.123456789Z", True), ("2025-01-01 00:00:00Z", False), ("2025-01-01T00:00:00", False), ("2025-13-01T00:00:00Z", False), ("2025-01-01T23:59:60Z", True), ("2025-01-01T00:00:00+05:30", True), ("", False)])
def test_stamps(spark, ts, ok):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(ts,)], "ts string").select(C.instant(F.col("ts")).alias("t")).first().t
    assert (got is not None) == ok
