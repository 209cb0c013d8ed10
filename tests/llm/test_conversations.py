"""p5_found: the verdict on a session does not depend on the size of a block."""

import json

import pytest

from loomlog.llm import conversations


def text(x):
    return {"type": "text", "text": x}


def use(x):
    return {"type": "tool_use", "id": x}


def result(x):
    return {"type": "tool_result", "tool_use_id": x}


SESSIONS = {
    "second_result": (None, [("user", text("hi")), ("assistant", use("t")), ("user", result("t")), ("assistant", text("a")), ("user", result("t")), ("assistant", text("b"))]),
    "second_use": (None, [("user", text("hi")), ("assistant", use("t")), ("user", result("t")), ("assistant", text("a")), ("assistant", use("t")), ("assistant", text("b"))]),
    "use_after_answer": (None, [("user", text("hi")), ("assistant", use("t")), ("user", result("t")), ("assistant", text("a")), ("user", result("t")), ("assistant", use("t"))]),
    "early": ("broken", [("user", text("hi")), ("user", result("t")), ("assistant", use("t")), ("user", result("t")), ("assistant", text("a"))]),
    "unknown": ("broken", [("user", text("hi")), ("user", result("t")), ("assistant", text("a"))]),
    "lost": ("missing_reply", [("user", text("hi")), ("assistant", use("t")), ("assistant", text("a"))]),
}


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_verdict_at_any_block_size(spark, block):
    rows = [(s, k, who, json.dumps({"content": [x]}), str(k)) for s, (_, messages) in SESSIONS.items() for k, (who, x) in enumerate(messages)]
    df = spark.createDataFrame(rows, "session_id string, seq long, type string, data string, time_created string")
    got = {r.session_id: r.reason for r in conversations.defects(df, df.select("session_id").limit(0), block).collect()}
    assert got == {s: reason for s, (reason, _) in SESSIONS.items()}


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_turns_in_order_at_any_block_size(spark, block):
    said = [("system", text("s")), ("user", text("hi")), ("assistant", use("t")), ("user", result("t")), ("assistant", text("bye"))]
    rows = [("A ", 7 + k, who, json.dumps({"content": [x]}), str(9 - k)) for k, (who, x) in enumerate(said)] * 2
    rows += [("b", k, "user", d, None) for k, d in enumerate([None, "{", "[]"])] + [("c", None, None, None, None), (None, 1, "user", "{}", "x")]
    df = spark.createDataFrame(rows[::-1], "session_id string, seq long, type string, data string, time_created string")
    more = spark.createDataFrame([("none",)], "session_id string")
    verdicts = conversations.defects(df, more, block)
    assert {r.session_id: r.reason for r in verdicts.collect()} == {"a": None, "b": "broken", "c": "broken", "none": "empty"}
    got = sorted((r.turn, r.speaker, r.text) for r in conversations.turns(df, verdicts, block).collect())
    assert got == [(0, "system", "s"), (1, "user", "hi"), (2, "assistant", ""), (3, "user", ""), (4, "assistant", "bye")]


def test_kahn_finds_cycles_and_breaks_ties_by_time():
    row = lambda seq, time, uses=(), results=(): {"seq": seq, "time": time, "uses": list(uses), "results": list(results)}
    order, left = conversations.topological([row(1, "5"), row(1, "3"), row(2, "1", results=["a"]), row(3, "9", uses=["a"])])
    assert left == 2 and [r["time"] for r in order] == ["3", "5"]
    assert conversations.topological([]) == ([], 0)


def test_no_rows(spark):
    df = spark.createDataFrame([], "session_id string, seq long, type string, data string, time_created string")
    verdicts = conversations.defects(df, df.select("session_id"))
    assert verdicts.count() == 0 and conversations.turns(df, verdicts).count() == 0
