"""Operators on small tables: ties, nulls, repeated rows, empty tables."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomlog.functions import classify, values
from loomlog.operators import freeze, graph, instants, metrics, reconcile, sessions

RECORD = "source string, model string, session string, ts string, tool string, shell_param string, cmd string, ok boolean, out string, err string, ordinal long"


def records(spark, rows):
    """rows: dicts with some of the columns"""
    names = [c.split()[0] for c in RECORD.split(", ")]
    return spark.createDataFrame([tuple({"source": "codex", "session": "s", "tool": "Bash", "ordinal": k, **r}.get(n) for n in names) for k, r in enumerate(rows)], RECORD)


@pytest.mark.parametrize("model, family, vendor", [
    ("gpt-6-astra", "GPT-6 Astra", "OpenAI"), ("GPT-5.3-codex", "GPT other", "OpenAI"), ("claude-fable-5-1", "Claude Fable 5.1", "Anthropic"), ("claude-fable-5", "Claude Fable 5", "Anthropic"), ("claude-opus-5", "Claude Opus 5", "Anthropic"), ("claude-code/opus", "Claude Opus 5", "Anthropic"),
    ("opus-4-1", "Claude Opus 4.x", "Anthropic"), ("grok-4", "Grok 4.x", "xAI"), ("kimi-k3", "Kimi K3", "Moonshot"), ("gemini-3", "Gemini 3.x", "Google"), ("", "other", "other"), (None, "other", "other"),
])
def test_families(spark, model, family, vendor):
    r = classify.annotate(records(spark, [{"model": model}]), "vendor").first()
    assert (r["family"], r["vendor"]) == (family, vendor)


@pytest.mark.parametrize("source, tool, shell, host", [
    ("claude-code", "Bash", None, "git-bash"), ("claude-code", "PowerShell", None, "pwsh7"), ("codex", "x", "C:\\cmd.exe", "cmd.exe"), ("codex", "x", "/bin/bash", "bash"), ("codex", "x", "SH", "bash"), ("codex", "x", None, "powershell"),
    ("opencode", "shell", None, "cmd.exe"), ("opencode", "bash", None, "powershell5"), ("cursor", "Shell", None, "powershell"), ("new", "x", None, "unknown"),
])
def test_hosts(spark, source, tool, shell, host):
    assert classify.annotate(records(spark, [{"source": source, "tool": tool, "shell_param": shell}]), "host").first()["host"] == host


@pytest.mark.parametrize("cmd, dialect, interp, cat, bucket", [
    (None, "js-only", [], "js-only", "js-only"), ("", "js-only", [], "js-only", "js-only"), ("ls -la", "posix", [], "list/navigate", "single command"), ("Get-ChildItem -Recurse", "powershell", [], "search", "single command"), ("dir & type a.txt", "cmd", [], "read-file", "single command"),
    ("Get-Content a | head -3", "mixed", [], "read-file", "single command"), ("git status && npm test", "neutral", [], "build/test/check", "chain (2-4 commands)"), ("python -c 'print(1)'", "neutral", ["python -c"], "other", "single command"),
    ("cat > a.md <<'EOF'\nx\nEOF\ny", "posix", ["heredoc"], "write-file", "script (4+ lines or >600 chars)"), (" ; ; ", "neutral", [], "other", "single command"), ("a;b;c;d;e", "neutral", [], "other", "batch (5+ commands)"),
])
def test_commands(spark, cmd, dialect, interp, cat, bucket):
    r = classify.annotate(records(spark, [{"cmd": cmd}]), "dialect", "interp", "cat", "cx").first()
    assert (r["dialect"], r["interp"], r["cat"], r["cx"]["bucket"]) == (dialect, interp, cat, bucket)


@pytest.mark.parametrize("ok, out, cause, detail, hidden", [
    (False, "The term 'grep' is not recognized", "not-found", "unix tool in Windows shell: grep", False), (False, "bash: Get-Item: command not found", "not-found", "PowerShell cmdlet in non-PS shell: Get-Item", False), (False, "foo: command not found", "not-found", "missing program: foo", False),
    (False, "SyntaxError: invalid syntax", "js-error", None, False), (False, "SyntaxError: bad in python", "nonzero/other", None, False), (False, "Traceback (most recent call last)", "python-error", None, False), (False, "", "nonzero/other", None, False), (False, None, "nonzero/other", None, False),
    (True, "x: command not found", None, None, True), (True, "fine", None, None, False), (None, "command not found", None, None, False),
])
def test_outcomes(spark, ok, out, cause, detail, hidden):
    r = classify.annotate(records(spark, [{"ok": ok, "out": out}]), "cause", "cause_detail", "hidden").first()
    assert (r["cause"], r["cause_detail"], r["hidden"]) == (cause, detail, hidden)


def test_instants_do_not_depend_on_the_session_zone(spark):
    rows = records(spark, [{"ts": t} for t in ("1767592643911", "2026-01-05T05:57:23.911Z", "2026-01-05 07:57:23,911+02:00", "20260105T055723Z", "x", None)])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [(r["epoch_ms"], r["iso"], r["day"], r["sort_ms"]) for r in classify.annotate(rows, "epoch_ms", "iso", "day", "sort_ms").orderBy("ordinal").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ms = 1767592643911
    assert got[:3] == [(ms, "2026-01-05T05:57:23.911Z", "2026-01-05", ms)] * 3
    assert got[3][0] == ms - 911 and got[4:] == [(None, None, None, 0)] * 2


def test_recovery_kinds(spark):
    cmds = [("ls", False), (" ls\n", True), ("ls", False), ("Get-Item x", None), ("Get-Item x", False), ("Get-Item y", True), ("cat a", False), ("", True), ("cat a", False)]
    rows = records(spark, [{"cmd": c, "ok": ok, "ts": str(1767592643000 + k)} for k, (c, ok) in enumerate(cmds)])
    got = {r["ordinal"]: (r["kind"], r["outcome"]) for r in sessions.recovery(classify.annotate(rows, "family", "sort_ms", "dialect", "interp0", "cause")).collect()}
    assert got == {0: ("identical retry", "then ok"), 2: ("switched dialect posix->powershell", "still failing"), 4: ("rewrote same dialect", "then ok"), 6: ("abandon/other-tool", None), 8: ("abandon/other-tool", None)}


def test_rates_and_rankings_of_an_empty_table(spark):
    empty = classify.annotate(records(spark, []), "dialect", "host", "hidden", "family", "interp", "cx", "mismatch")
    assert metrics.rate_by(empty, "dialect").count() == 0 and metrics.most_common(empty, "dialect", 3).count() == 0
    r = metrics.rate_by(empty).first()
    assert (r["n"], r["fail_rate"]) == (0, None)


def test_most_common_ties_by_first_occurrence(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("a", 4), ("c", 0), (None, 9)], "x string, ordinal int")
    assert [r["x"] for r in metrics.most_common(df, "x", 3).collect()] == ["b", "a", "c"]


def test_percentile_is_nearest_rank(spark):
    df = spark.createDataFrame([("a", True, float(k), 10, 1.0, None, 0.5, 10, 5) for k in range(1, 11)], "kind string, passed boolean, wall_ms double, eval_count int, eval_seconds double, recall double, precision double, raw_chars int, compact_chars int")
    got = {r["kind"]: r for r in metrics.summarize(df).collect()}
    assert got["a"]["p95_wall_ms"] == 10 and got["all"]["median_wall_ms"] == 5.5 and got["all"]["mean_recall"] == 0 and got["all"]["character_reduction"] == 0.5 and got["all"]["tokens_per_second"] == 10


def test_draws_do_not_depend_on_the_order_of_rows(spark):
    df = spark.range(200).selectExpr("id AS ordinal", "id % 3 AS g")
    a = {tuple(r) for r in metrics.draw(df, ["g"], 4, 7, "ordinal").collect()}
    assert a == {tuple(r) for r in metrics.draw(df.orderBy(F.desc("ordinal")).repartition(5), ["g"], 4, 7, "ordinal").collect()} and len(a) == 12
    assert a != {tuple(r) for r in metrics.draw(df, ["g"], 4, 8, "ordinal").collect()}


# ---- reconciliation


def test_pairing_rules(spark):
    calls = spark.createDataFrame([("f", 1, "a"), ("f", 5, "b"), ("f", 6, None)], "file string, line int, call_id string")
    results = spark.createDataFrame([("f", 0, "a", "before"), ("f", 3, "a", "first"), ("f", 4, "a", "second"), ("g", 9, "b", "other file"), ("f", 9, None, "null")], "file string, line int, call_id string, output string")
    got = {r["line"]: (r["output"], r["result_present"]) for r in reconcile.pair(calls, results, ["file", "call_id"], ["line"]).collect()}
    assert got == {1: ("first", True), 5: (None, False), 6: (None, False)}
    last = reconcile.pair(calls, results.withColumnRenamed("line", "at"), ["file", "call_id"], ["at"], which="last", must_follow=False)
    assert {r["line"]: r["output"] for r in last.collect()} == {1: "second", 5: None, 6: None}


def test_chunks_conflicts_and_three_way_reconciliation(spark):
    chunks = spark.createDataFrame([("s", "a", 1, "x", None), ("s", "a", 2, "x", None), ("s", "a", 3, "y", 1), ("s", "b", 1, None, 0)], "session string, call_id string, line int, output string, exit_code int")
    got = {r["call_id"]: (r["output"], r["exit_code"], r["n_chunks"]) for r in reconcile.chunks(chunks, ["session", "call_id"], ["line"]).collect()}
    assert got == {"a": ("x\ny", 1, 2), "b": (None, 0, 1)}
    calls = spark.createDataFrame([("s", "a", "ls", 1), ("s", "a", "ls", 2), ("s", "a", "pwd", 3)], "session string, call_id string, command string, line int")
    got = reconcile.resolve_conflicts(calls, ["session", "call_id"], "command", ["line"], F.col("line").cast("string")).orderBy("line").collect()
    assert [(r["call_id"], r["call_id_conflict"]) for r in got] == [("a", False), ("a:conflict:" + hashlib.sha256(b"3").hexdigest()[:12], True)]
    context = "request_context string, context_truncated boolean, context_association string"
    c = spark.createDataFrame([("s", k, f"cmd {k}", "bash", "/c", f"ctx {k}", False, "p") for k in ("call", "res", "both")], f"session string, call_id string, command string, tool string, cwd string, {context}")
    r = spark.createDataFrame([("s", "res", "out", 3), ("s", "lost", "z", 1)], "session string, call_id string, output string, exit_code int")
    n = spark.createDataFrame([("s", "both", "native both", "/n", "own", False, "missing", "o1", 0), ("s", "nat", "native only", "/n", "own", False, "missing", "o2", 5)], f"session string, call_id string, command string, cwd string, {context}, output string, exit_code int")
    got = {x["call_id"]: x for x in reconcile.reconcile(c, r, n).collect()}
    assert {k: v["origin"] for k, v in got.items()} == {"call": "call", "res": "call+result", "both": "call+native", "nat": "native"}
    assert got["both"]["command"] == "native both" and got["both"]["request_context"] == "ctx both" and got["nat"]["request_context"] == "own" and got["call"]["output"] == "" and not got["call"]["result_present"] and got["res"]["exit_code"] == 3
    assert [x["call_id"] for x in reconcile.unmatched(r, c, n, ["session", "call_id"]).collect()] == ["lost"]
    assert reconcile.reconcile(c.limit(0), r.limit(0), n.limit(0)).count() == 0


def test_digest_equals_json(spark):
    texts = ['a"b\\c/\n\t\x01\x0b\x1f\x7fé漢😀', "", "\x1b[0m \\u001B", " "]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = [r[0] for r in df.select(values.digest(F.col("t"))).collect()]
    assert got == [hashlib.sha256(json.dumps(t, ensure_ascii=False).encode()).hexdigest() for t in texts] + [None]
    one = df.limit(1).select(values.digest(F.col("t"), F.lit("x")), values.digest_list(F.array("t", F.lit("x")))).first()
    assert one[0] == one[1] == hashlib.sha256(json.dumps([texts[0], "x"], ensure_ascii=False).encode()).hexdigest()


def test_json_that_lost_its_beginning_is_no_json(spark):
    df = spark.createDataFrame([(t,) for t in ('"role":1}', '{"a":1} x', '{"a":1}', "", None, "null", "[1]")], "t string")
    assert [r[0] for r in df.select(values.parse_strict(F.col("t")).isNotNull()).collect()] == [False, False, True, False, False, True, True]
    v = spark.sql("SELECT parse_json('{\"exit_code\": true, \"exitCode\": 4, \"stdout\": \"o\", \"stderr\": \"e\"}') v")
    assert v.select(values.result_exit(F.col("v")), values.result_output(F.col("v"))).first()[:] == (4, "o\ne")


# ---- groups and partitions


def test_components_against_union_find(spark, monkeypatch):
    monkeypatch.setattr(graph, "SLOT", 3)  # ends with more than three links are split
    rng = random.Random(5)
    links = [(f"n{rng.randrange(300):03}", f"e{rng.randrange(280)}") for _ in range(420)] + [(f"n{k:03}", "hot") for k in range(40)] + [(f"p{k:03}", f"c{k + d}") for k in range(60) for d in (0, 1)] + [("x", None), (None, "y"), ("n000", "e0"), ("n000", "e0")]
    parent: dict = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for n, e in links:
        if n and e:
            a, b = find(("n", n)), find(("e", e))
            parent[a] = b
    groups = defaultdict(list)
    for n, e in links:
        if n and e:
            groups[find(("n", n))].append(n)
    want = {n: min(g) for g in groups.values() for n in g}
    got = {r["node"]: r["root"] for r in graph.propagate_labels(spark.createDataFrame(links, "node string, entity string")).collect()}
    assert got == want
    assert graph.propagate_labels(spark.createDataFrame([], "node string, entity string")).count() == 0


COMMAND = "session string, call_id string, command_text string, command_argv array<string>, request_context string, context_truncated boolean, context_association string, call_id_conflict boolean, result_present boolean, source_kind string, parent_sessions array<string>, record_id string, command_sha256 string, output_sha256 string, labels struct<execution:string,output_error_keyword:boolean>, exit_code_origin string, call_pointer struct<snapshot:string,line:long,part:int>"


def commands(spark, n=600):
    rng = random.Random(6)
    rows = []
    for k in range(n):
        s = f"s{min(rng.randrange(120), rng.randrange(120))}"
        context = f"please fix request number {rng.randrange(400)} in the very long file now" if rng.random() < 0.9 else "too short"
        rows.append((s, f"c{k}", f"git show {k % 50}", None, context, k % 40 == 0, "missing" if k % 9 == 0 else "p", False, k % 7 > 0, "codex", [f"s{rng.randrange(120)}"] if k % 50 == 0 else [], f"r{k}", f"h{k % 50}", f"o{k}", ("exit_zero", False), "native", ("snap", k, 0)))
    return spark.createDataFrame(rows + rows[:20], COMMAND)


def test_frozen_partitions(spark):
    out = freeze.freeze(commands(spark)).collect()
    assert len({r["id"] for r in out}) == len(out) == 600
    by_group, by_session, by_task = defaultdict(set), defaultdict(set), defaultdict(set)
    for r in out:
        by_group[r["partition_group"]].add(r["partition"])
        by_session[r["session_group"]].add(r["partition"])
        if r["task_key"]:
            by_task[r["task_key"]].add(r["partition"])
    assert all(len(x) == 1 for d in (by_group, by_session, by_task) for x in d.values())
    again = {r["id"]: r["partition"] for r in freeze.freeze(commands(spark).orderBy(F.desc("record_id"))).collect()}
    assert again == {r["id"]: r["partition"] for r in out}
    assert not {"request_context", "command_text", "session"} & set(out[0].asDict())


def test_balance_of_small_groups(spark):
    rng = random.Random(7)
    sizes = spark.createDataFrame([(f"g{k}", rng.randrange(1, 9)) for k in range(4000)] + [("big", 3000)], "partition_group string, n long")
    n = Counter()
    for r in freeze.balanced(sizes, freeze.SHARES, "x").join(sizes, "partition_group").collect():
        n[r["partition"]] += r["n"]
    assert all(abs(n[p] / n.total() - s) < 0.01 for p, s in freeze.SHARES.items())
    assert freeze.balanced(sizes.limit(0), freeze.SHARES, "x").count() == 0


def test_review_and_guards(spark):
    rows = spark.createDataFrame([("a", ["legacy_extraction_unverified", "missing_result"]), ("b", ["missing_result"]), ("c", ["conflicting_call_id"]), ("d", [])], "id string, review_reasons array<string>")
    got = {r["id"]: r["a"] for r in rows.select("id", freeze.review_action(F.col("review_reasons")).alias("a")).collect()}
    assert got == {"a": "reconcile_with_native_source", "b": "recover_context_or_result", "c": "inspect_conflicting_identity", "d": "develop_task_verifier"}
    assert [r["id"] for r in freeze.safe_for_training(rows).orderBy("id").collect()] == ["a", "b", "d"]
    parts = spark.createDataFrame([("train",), ("reserve",), (None,)], "partition string")
    assert freeze.only_partition(parts.where("partition = 'train'"), "train").count() == 1
    for bad in ("partition = 'reserve'", "partition IS NULL"):
        with pytest.raises(Exception, match="row outside train"):
            freeze.only_partition(parts.where(bad), "train").collect()
    meta = spark.createDataFrame([('{"a":{"parent_thread_id":"p1","x":[{"forked_from_id": "f"}]},"parent_session_id":"p1"}',), (None,)], "m string")
    assert [sorted(r[0]) for r in meta.select(freeze.parents(F.col("m"))).collect()] == [["f", "p1"], []]


@pytest.mark.parametrize("text, op, limit", [
    ("Get-Content a.txt -Head 5", "read_head", 5), ("  get-content -Path 'it''s.txt' -TAIL 100 ", "read_tail", 100), ("Get-Content -LiteralPath 'a*.txt' -TotalCount 1", "read_head", 1), ("Get-Content a*.txt -Head 5", None, None), ("Get-Content -Path @x -Head 5", None, None),
    ("Get-Content a -Head 0", None, None), ("Get-Content a -Head 101", None, None), ("Get-Content a -Head 5; ls", None, None), ("Get-Content \"$a\" -Head 5", None, None), (None, None, None), ("", None, None),
])
def test_read_contracts(spark, text, op, limit):
    r = spark.createDataFrame([(text,)], "t string").select(values.read_contract(F.col("t")).alias("k")).first()["k"]
    assert (r and r["op"], r and r["limit"], r and r["path"]) == (op, limit, op and "fixture.txt")


# ---- timestamps

TIMES = [
    ("2026-01-02T03:04:05.678Z", "America/New_York", 1767323045678), ("2026-01-02 03:04:05", "America/New_York", 1767341045000), ("2026-01-02 03:04:05", None, 1767323045000), ("03/29/2026 01:30 AM", "Europe/London", None), ("10/25/2026 01:30 AM", "Europe/London", 1792888200000),
    ("29.02.2025 10:00:00", None, None), ("29.02.2024 10:00:00", None, 1709200800000), ("1767323045", None, 1767323045000), ("1767323045678901", None, 1767323045678), ("1767323045678901234", None, 1767323045678), ("1767323045.5", None, 1767323045500), ("Fri, 02 Jan 2026 03:04:05 +0100", None, 1767319445000),
    ("2026-01-02T03:04:05.999999-08:00", None, 1767351845999), ("20260102T030405+0000", None, 1767323045000), ("2026-01-02 03:04:05 EST", None, 1767341045000), ("yesterday", None, None), ("", None, None), (None, None, None), ("2026-01-02T25:00:00Z", None, None),
]


def test_instants(spark):
    rows = spark.createDataFrame([(k, v, f"s{k}") for k, (v, _, _) in enumerate(TIMES)], "id int, value string, session string")
    zones = spark.createDataFrame([(f"s{k}", z) for k, (_, z, _) in enumerate(TIMES)], "zone_key string, tz string")
    got = {r["id"]: r["epoch_ms"] for r in instants.normalise(rows, "value", F.col("session"), zones).collect()}
    assert got == {k: ms for k, (_, _, ms) in enumerate(TIMES)}


def test_chunks_of_a_session_change_nothing(spark):
    rng = random.Random(11)
    rows = [(f"s{rng.randrange(3)}" if rng.random() < 0.95 else None, rng.randrange(50), k, rng.choice([None, f"v{k}"])) for k in range(400)]
    df = spark.createDataFrame(rows, "s string, t int, k int, v string")
    want_next, want_last = {}, {}
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[r[0]].append(r)
    for g in groups.values():
        last = None
        for a, b in zip(g, [*g[1:], None]):
            want_next[a[2]], want_last[a[2]] = b and b[2], last
            last = a[3] or last
    for width in (1, 7, 1000):
        chunk = [F.floor(F.col("t") / width)]
        assert {r["k"]: r["n"] and r["n"]["k"] for r in sessions.following(df, ["s"], ["t", "k"], chunk, F.struct("k"), "n").collect()} == want_next
        assert {r["k"]: r["was"] for r in sessions.carry_forward(df, ["s"], ["t", "k"], chunk, {"was": "v"}).collect()} == want_last
