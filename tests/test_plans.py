"""Inspection plans: five operations, bounds, evidence and bindings."""

import pytest
from pyspark.sql import functions as F

from loomlog.plans import inspect

PLAN = {"op": "read_head", "path": "a/b.txt", "value": "", "limit": 2}


@pytest.mark.parametrize("change", [{"op": "rm"}, {"limit": 0}, {"limit": 101}, {"limit": True}, {"path": "../x"}, {"path": "/x"}, {"path": "C:\\x"}, {"path": ""}, {"value": None}, {"op": "list_files", "value": "a b"}, {"more": 1}])
def test_invalid_plans(change):
    with pytest.raises(ValueError):
        inspect.validate(PLAN | change)


def test_five_operations(spark):
    files = spark.createDataFrame([("a", "one\ntwo\r\nthree\n"), ("b", ""), ("c", None), ("d", "x\u2028Y x\x0bz"), ("e", '{"k.l": {"b": 1, "a": null}, "it\'s": 2}')], "path string, text string")
    run = lambda **p: {r["path"]: r["answer"] for r in inspect.run(PLAN | p, files).collect()}
    assert run() == {"a": "one\ntwo", "b": "", "c": None, "d": "x\nY x", "e": '{"k.l": {"b": 1, "a": null}, "it\'s": 2}'}
    assert run(op="read_tail")["a"] == "two\nthree" and run(op="read_tail")["d"] == "Y x\nz" and run(op="read_tail")["b"] == ""
    assert run(op="find_literal", value="X")["d"] == "x\nY x" and run(op="find_literal", value="X", limit=1)["d"] == "x"
    assert run(op="json_field", value="k.l")["e"] == '{"a":null,"b":1}' and run(op="json_field", value="no")["e"] == "null" and run(op="json_field", value="it's")["e"] == "2" and run(op="json_field", value="k")["a"] is None
    assert sorted(run(op="list_files", value="?", limit=3)) == ["a", "b", "c"]


def test_evidence(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], [1, 3]), (2, ["a"], [2]), (3, ["a", "b"], [2, 1]), (4, ["a"], []), (5, ["a", "b"], [1, 1])], "id int, lines array<string>, chosen array<int>")
    got = {r[0]: r[1] for r in df.select("id", inspect.select_lines(F.col("lines"), F.col("chosen"))).collect()}
    assert got == {1: ["a", "c"], 2: None, 3: None, 4: [], 5: None}
    s = spark.createDataFrame([(1, [1, 2], [2, 3]), (2, [], []), (3, [], [1]), (4, [1], [])], "id int, e array<int>, s array<int>")
    got = {r[0]: (r[1], r[2]) for r in s.select("id", inspect.recall(F.col("e"), F.col("s")), inspect.precision(F.col("e"), F.col("s"))).collect()}
    assert got == {1: (0.5, 0.5), 2: (1.0, 1.0), 3: (1.0, 0.0), 4: (0.0, 0.0)}


def test_bindings():
    model, people, paths = inspect.bind("read {{log}} and {{log}}, not {{{log}}}", {"log": "a/{{x}} é.txt"})
    assert model == 'read "file_1" and "file_1", not {"file_1"}' and people.startswith('read "a/{{x}} é.txt"') and paths == {"file_1": "a/{{x}} é.txt"}
    for request, targets in [("x", {"a": "b"}), ("{{b}}", {"a": "b"}), ("{{a}}", {"a": "../b"}), ("{{a}}", {}), (" ", {"a": "b"})]:
        with pytest.raises(ValueError):
            inspect.bind(request, targets)


def test_canonical_and_powershell(spark):
    df = spark.createDataFrame([(1, '{"b": 1, "a": [true, 1.0]}'), (2, "{"), (3, None)], "id int, j string")
    assert {r["id"]: r["canonical"] for r in inspect.with_canonical(df, "j").collect()} == {1: '{"a":[true,1.0],"b":1}', 2: None, 3: None}
    assert inspect.canonical("true") != inspect.canonical("1")
    assert inspect.powershell(PLAN | {"path": "it's.txt"}) == "Get-Content -LiteralPath 'it''s.txt' -Encoding UTF8 -TotalCount 2"


def test_schema_of_request_local_references():
    assert inspect.schema(["file_1"])["properties"]["path"] == {"type": "string", "enum": ["file_1"]} and "enum" not in inspect.schema()["properties"]["path"]
    with pytest.raises(ValueError):
        inspect.schema([])
