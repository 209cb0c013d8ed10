"""Files, stores and adapters on small fixtures."""

import gzip
import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomlog import sinks
from loomlog.operators import reconcile
from loomlog.sources import files
from loomlog.sources import transcripts as T


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, n in (("x.jsonl", 5000), ("a/y.jsonl", 3), ("a/empty.jsonl", 0)):
        (tmp_path / name).write_text("".join(f"{name} {k} é\n" for k in range(1, n + 1)))
    (tmp_path / "z.jsonl").write_bytes(b"one\r\n\ntwo")
    with gzip.open(tmp_path / "g.jsonl.gz", "wt") as f:
        f.write("p\nq\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    try:
        rows = files.lines(spark, str(tmp_path)).withColumn("session", files.session_name(F.col("file_name"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r["file_name"], r["line"]): r["value"] for r in rows}
    assert len(got) == len(rows) == 5000 + 3 + 3 + 2
    assert all(v == f"{'x.jsonl' if n == 'x.jsonl' else 'a/y.jsonl'} {k} é" for (n, k), v in got.items() if n in ("x.jsonl", "y.jsonl"))
    assert [got["z.jsonl", k] for k in (1, 2, 3)] == ["one", "", "two"] and got["g.jsonl.gz", 2] == "q"
    assert {r["session"] for r in rows} == {"x", "y", "z", "g"}


def test_inventory_changes_snapshot_and_hash(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, text in (("a", "1"), ("b", "1"), ("c", "22")):
        (tmp_path / "in" / n).write_text(text)
    roots = {"k": [str(tmp_path / "in")], "j": [str(tmp_path / "in"), str(tmp_path / "none")]}
    now = files.inventory(spark, roots)
    assert sorted((r["kind"], r["size"]) for r in now.collect()) == [("j", 1), ("j", 1), ("j", 2)]
    assert [(r["kind"], r["issue"]) for r in files.issues(spark, roots).collect()] == [("j", "missing_source_root")]
    seen = now.where("size = 1").union(now.where("size = 2").withColumn("size", F.lit(9).cast("long")))
    assert [r["size"] for r in files.changed(now, seen).collect()] == [2]
    out = str(tmp_path / "out")
    assert files.snapshot(spark, [str(tmp_path / "in")], out).select("sha256").distinct().count() == 2 == spark.read.parquet(out).count()
    with pytest.raises(Exception, match="exists"):
        files.snapshot(spark, [str(tmp_path / "in")], out)
    with gzip.open(tmp_path / "z.gz", "wb") as f:
        f.write(b"abc" * 1000)
    assert files.verified(spark, str(tmp_path / "z.gz"), hashlib.sha256(b"abc" * 1000).hexdigest())
    with pytest.raises(ValueError):
        files.verified(spark, str(tmp_path / "z.gz"), "0" * 64)
    assert files.older_than(["d/rollout-2026-09-06T1.jsonl", "rollout-2026-09-07T1.jsonl", "x"], "2026-09-07") == ["d/rollout-2026-09-06T1.jsonl", "x"]


def test_sqlite_export_is_ordered_and_selective(spark, tmp_path):
    path = str(tmp_path / "s.db")
    con = sqlite3.connect(path)
    con.executescript("CREATE TABLE message(id, time_created, data); CREATE TABLE part(id, time_created, data); CREATE TABLE account(token); CREATE TABLE session(id, directory);")
    con.execute("INSERT INTO account VALUES ('secret')")
    con.execute("INSERT INTO session VALUES ('s', '/d')")
    con.executemany("INSERT INTO message VALUES (?, ?, ?)", [("m2", 5, "{}"), ("m1", 2, b"{}")])
    con.executemany("INSERT INTO part VALUES (?, ?, ?)", [("p1", 2, "{}"), ("p0", 1, "{}")])
    con.commit()
    con.close()
    rows = files.sqlite_rows(spark, [path, path]).orderBy("place").collect()
    assert [(r["tbl"], r["id"]) for r in rows] == [("session", "s"), ("part", "p0"), ("message", "m1"), ("part", "p1"), ("message", "m2")]
    assert "secret" not in str(rows)
    with pytest.raises(ValueError):
        files.sqlite_rows(spark, [path], ("account",))


def lines_of(spark, events, file="f"):
    return spark.createDataFrame([(file, k, e if isinstance(e, str) else json.dumps(e)) for k, e in enumerate(events, 1)], "file string, line long, value string")


def test_codex_events(spark):
    call = lambda cid, turn=None, **p: {"type": "response_item", "timestamp": "t", "payload": {"type": "function_call", "name": "shell_command", "call_id": cid, "arguments": json.dumps({"command": "ls", **p}), "internal_chat_message_metadata_passthrough": {"turn_id": turn}}}
    out = lambda cid, text: {"type": "response_item", "payload": {"type": "function_call_output", "call_id": cid, "output": text}}
    events = [
        {"type": "session_meta", "payload": {"id": "S", "cwd": "/a"}}, {"type": "turn_context", "payload": {"turn_id": "1", "model": "m1"}}, call("c1", "1"), {"type": "turn_context", "payload": {"turn_id": "2", "model": "m2", "cwd": "/b"}},
        call("c2", "1"), call("c3", "9"), out("c1", 'x "exit_code": 3 Wall time: 1.5'), out("c2", [{"text": "Script failed"}, {"text": "b"}]), out("c9", "lost"), "{bad", "[1]",
        {"type": "event_msg", "payload": {"type": "item_completed", "item": {"type": "CommandExecution", "id": "n1", "command": ["bash", "-lc", "ls"], "exit_code": True, "aggregated_output": "o" * 12}}},
        {"type": "event_msg", "payload": {"type": "item_completed", "item": {"type": "CommandExecution", "id": "n1", "command": ["x"]}}},
    ]
    e = T.codex_events(lines_of(spark, events))
    calls, results = T.codex_calls(e), T.codex_results(e)
    got = {r["call_id"]: r for r in reconcile.pair(calls, results.select("file", "line", "call_id", "output", "exit_code", "failed", "wall"), ["file", "call_id"], ["line"]).collect()}
    assert [(got[c]["model"], got[c]["cwd"], got[c]["exit_code"], got[c]["result_present"]) for c in ("c1", "c2", "c3")] == [("m1", "/a", 3, True), ("m1", "/b", None, True), ("m2", "/b", None, False)]
    assert got["c2"]["output"] == "Script failed\nb" and got["c2"]["failed"] and got["c1"]["wall"] == "1.5"
    assert [r["call_id"] for r in reconcile.unmatched(results, calls, calls.limit(0), ["call_id"]).collect()] == ["c9"]
    native = T.native_events(e, most=10).collect()
    assert [(r["call_id"], r["exit_code"], r["output"], r["capped"], r["output_chars"]) for r in native] == [("n1", None, "o" * 10, True, 12)]


def test_cursor_blobs_in_any_order(spark):
    blobs = [{"role": "tool", "content": [{"type": "tool-result", "toolCallId": "a", "result": "Exit code: 2"}]}, "\x00bin", {"role": "assistant", "content": [{"type": "tool-call", "toolCallId": "a", "toolName": "Shell", "args": {"command": "ls"}}]}, {"role": "system", "content": "You are powered by grok 4. Be kind."}]
    b = T.cursor_blobs(lines_of(spark, blobs).withColumnRenamed("value", "data"))
    r = reconcile.pair(T.cursor_calls(b).drop("line", "part"), T.cursor_results(b).drop("part"), ["file", "call_id"], ["line"], which="last", must_follow=False).first()
    assert (r["command"], r["model"], r["exit_code"], r["failed"]) == ("ls", "grok 4", 2, True)


def test_census_and_added_files(spark):
    df = spark.createDataFrame([("m", p) for p in ("/tmp/a.py", "src/b.PY", "c.txt", "x\\scripts\\d.ps1", None)], "model string, path string")
    assert {(r["ext"], r["place"], r["n"]) for r in T.script_census(df, ["model"]).collect()} == {("py", "temp/scratch", 1), ("py", "in repo", 1), ("ps1", "temp/scratch", 1)}
    patch = spark.createDataFrame([("*** Add File: a b.py \n+x\n*** Add File: c.js\n",)], "t string")
    assert patch.select(T.added_files(F.col("t"))).first()[0] == ["a b.py", "c.js"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "reserve"), (3, "c", "train")], "id int, v string, partition string")
    sinks.write_partitions(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    key = lambda d: {(r["partition"], r["rows"], r["digest"]) for r in sinks.partition_digests(d).collect()}
    assert key(df) == key(back.select("id", "v", "partition")) == key(df.orderBy(F.desc("id")))
    sinks.write_lines(df, str(tmp_path / "l"), "partition")
    assert spark.read.json(str(tmp_path / "l")).count() == 3
    with pytest.raises(Exception, match="exists"):
        sinks.write_lines(df, str(tmp_path / "l"))
    assert sinks.write_document(str(tmp_path / "d.json"), {"a": 1}) == hashlib.sha256((tmp_path / "d.json").read_bytes()).hexdigest()
    with pytest.raises(FileExistsError):
        sinks.write_document(str(tmp_path / "d.json"), {})
    with sinks.single_writer(str(tmp_path)), pytest.raises(FileExistsError), sinks.single_writer(str(tmp_path)):
        pass
    with sinks.single_writer(str(tmp_path)):
        pass
    assert sinks.fill_page("<script>__DATA__</script>", {"gallery": ["</script>"]}) == '<script>{"gallery": ["<\\/script>"]}</script>'
    assert sinks.fill_page("__DATA__", {"gallery": [1], "n": 2}, gallery=False) == '{"gallery": [], "n": 2}'
    assert sinks.document({"t": df.where("id = 1")}) == {"t": [{"id": 1, "v": "a", "partition": "train"}]}


def test_codex_records(spark):
    turn = {"type": "turn_context", "payload": {"turn_id": "1", "model": "m"}}
    cell = lambda cid, js: {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "exec", "call_id": cid, "input": js}}
    out = lambda cid, text: {"type": "response_item", "payload": {"type": "custom_tool_call_output", "call_id": cid, "output": text}}
    two = "tools.exec_command({cmd: 'a'}); tools.exec_command({cmd: x})"
    fn = {"type": "response_item", "payload": {"type": "function_call", "name": "shell_command", "call_id": "f", "arguments": '{"command": "ls", "workdir": "/w"}'}}
    events = [turn, cell("c1", two), out("c1", '{"exit_code": 0} {"exit_code": 2}'), cell("c2", two), out("c2", '{"exit_code": 1}'), cell("c3", "1 + 1"), out("c3", "Script failed"), cell("c4", "tools.exec_command({cmd: 'z'})"), fn, out("f", 'running {"session_id": 4}'), cell("c1", "tools.exec_command({cmd: 'again'})")]
    got = sorted(((r["cmd"], r["tool"], r["ok"], r["exit"], r["exit_visible"], r["unmatched"], r["backgrounded"], r["idx_in_cell"]) for r in T.codex_records(lines_of(spark, events)).collect()), key=str)
    assert got == sorted([
        ("a", "exec>exec_command", True, 0, True, False, False, 0), (None, "exec>exec_command", False, 2, True, False, False, 1), ("a", "exec>exec_command", True, None, False, False, False, 0), (None, "exec>exec_command", True, None, False, False, False, 1),
        (None, "exec(js-only)", False, None, None, False, False, None), ("z", "exec>exec_command", None, None, False, True, False, 0), ("ls", "shell_command", True, None, False, False, True, 0),
    ], key=str)


def test_one_failing_source_leaves_the_others(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(2,)], "id int")
    rows, failed = files.gather({"a": lambda: a, "gone": lambda: spark.read.parquet(str(tmp_path / "none")), "b": lambda: b})
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x"), (2, None)] and list(failed) == ["gone"]
    assert files.gather({}) == (None, {})
