"""Recovery from code: literals, dynamics, comments, contexts; read commands and what speaks against them."""

import pytest

from loomlog.operators import cells, static


@pytest.mark.parametrize("code, commands", [
    ('tools.exec_command({cmd: "ls"})', ["ls"]), ("await tools.bash({command: 'a' + \"b\" + `c`})", ["abc"]), ('tools["mcp__x__shell"]({"command_line": ["a", "b"]})', ['["a", "b"]']),
    ("// tools.bash({cmd: 'x'})\n/* tools.bash({cmd: 'y'}) */ 'tools.bash({cmd: 1})'", []), ("tools.bash({cmd: 'it\\'s \\n \\u0041'})", ["it's \n A"]),
    ('tools.read_file({path: "x"})', []), ("tools.bash({cmd: 'a', cmd: 'b'})", ["b"]), ("functions.shell({cmd: `a\nb`, workdir: w})", ["a\nb"]),
])
def test_literal_calls(code, commands):
    status, calls = static.recover(code)
    assert status == "parsed" and [c["command"] for c in calls if c["status"] == "candidate"] == commands


@pytest.mark.parametrize("code, reason", [
    ("tools.bash(args)", "non_literal_argument_object"), ("tools.bash({cmd: 'x'}, 2)", "non_literal_argument_object"), ("tools.bash({...a})", "spread_computed_or_accessor_property"), ("tools.bash({['cmd']: 'x'})", "spread_computed_or_accessor_property"),
    ("tools.bash({cmd: x})", "missing_or_dynamic_command"), ("tools.bash({cmd: `a${b}`})", "missing_or_dynamic_command"), ("tools.bash({cmd: 'a' + b})", "missing_or_dynamic_command"), ("tools.bash({cmd})", "missing_or_dynamic_command"), ("tools.bash({path: 'x'})", "missing_or_dynamic_command"),
])
def test_reasons(code, reason):
    assert [c["status"] for c in static.recover(code)[1]] == [reason]


def test_contexts_statuses_and_dynamic_members():
    calls = static.recover("if (x) { tools.bash({cmd: 'a', timeout_ms: t}) } for (const y of z) { list.map((k) => { tools.bash({cmd: 'b'}) }) } tools.bash({cmd: 'c'})")[1]
    assert [(c["command"], c["context"], c["dynamic"]) for c in calls] == [("a", ["if"], ["timeout_ms"]), ("b", ["for", "arrow"], []), ("c", [], [])]
    assert static.recover(None)[0] == "invalid_input" and static.recover("x" * (static.MOST_CHARS + 1))[0] == "oversized_input"
    assert static.recover("tools.bash({cmd: 'a'")[0] == "parse_error" and static.recover("f(]")[0] == "parse_error" and static.recover("")[0] == "parsed"


@pytest.mark.parametrize("text, status", [
    ("Get-Content a.txt -TotalCount 5", "read_candidate"), ("Get-Content -LiteralPath 'a[1].txt' -Tail 3", "read_candidate"), ("gci; get-content -Path \"b\" -Head 100 -Encoding utf8", "read_candidate"), ("Get-Content a -Wait", "unsupported_parameter"),
    ("Get-Content a -Tail 1 -Tail 2", "duplicate_parameter"), ("Get-Content a -Tail", "missing_parameter_value"), ("Get-Content a -Tail $n", "dynamic_parameter"), ("Get-Content $p -Tail 1", "dynamic_positional"), ("Get-Content -Path a -LiteralPath b -Tail 1", "conflicting_path_parameters"),
    ("Get-Content -Path a b -Tail 1", "extra_positional"), ("Get-Content a b -Tail 1", "missing_or_multiple_paths"), ("Get-Content -Path '' -Tail 1", "invalid_path"), ("Get-Content *.txt -Tail 1", "wildcard_path"), ("Get-Content a", "missing_or_conflicting_count"),
    ("Get-Content a -Tail 1 -Head 1", "missing_or_conflicting_count"), ("Get-Content a -Tail 0", "unsupported_count"), ("Get-Content a -Tail 101", "unsupported_count"), ("Get-Content a -Tail 5 -Encoding ascii", "unsupported_encoding"),
])
def test_read_statuses(text, status):
    assert [r["status"] for r in static.reads(text)] == [status]


def test_reads_in_blocks_and_pipes():
    got = static.reads("if ($x) { Get-Content a -Tail 2 } ; Get-Content b -Head 3 | Select-String x\nGet-Content c -Tail 1")
    assert [(r["op"], r["limit"], r["in_block"]) for r in got] == [("read_tail", 2, True), ("read_head", 3, False), ("read_tail", 1, False)]
    assert static.reads(None) == [] and static.reads("") == []


def test_cell_scanner():
    js = "const a = tools.exec_command({cmd: \"echo )\", workdir: 'w'}); tools.read_file(x(1, [2])); tools.shell({command: `ls ${d}`"
    assert [n for n, _ in cells.scan(js)] == ["exec_command", "read_file", "shell"]
    got = cells.commands(js)
    assert [(c["cmd"], c["workdir"], c["dynamic"]) for c in got] == [("echo )", "w", False), ("ls ${d}", None, True)]
    assert cells.commands('tools.bash({"command": "x", "shell": "pwsh"})') == [{"cmd": "x", "shell_param": "pwsh", "workdir": None, "dynamic": False}]
    assert cells.scan(None) == [] and cells.commands("tools.bash({cmd})")[0]["dynamic"]
