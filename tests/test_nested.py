"""p7: every node once, with a parent that exists."""

import json

from pyspark.sql import functions as F

from loomlog.operators import nested

RECORD = {"a.b": {}, "a": {"b": {}}, "content": [{"type": "tool", "content": "x"}, None, "t", {"content": {"type": "g", "content": [{"text": "u"}]}}], "n": 1, "l": [[1, None], {"k": [2]}], "s": {"content": "[{\"type\":\"q\"}]"}}


def nodes(value):
    return list(nested.visit(value))


def test_keys_are_unique_and_parents_exist():
    rows = nodes(RECORD)
    keys = [r[1] for r in rows]
    assert len(set(keys)) == len(keys)
    assert all(r[2] in keys for r in rows if r[0] != "record")
    assert {"a\\.b", "a.b"} <= set(keys)


def test_blocks():
    blocks = {(r[3], r[4], r[5]) for r in nodes(RECORD) if r[0] == "block"}
    assert blocks == {("content", 0, "tool"), ("content", 2, "text"), ("content", 3, "text"), ("content[0].content", 0, "text"), ("content[3].content", 0, "g"), ("content[3].content[0].content", 0, "text"), ("s.content", 0, "q")}


def test_null_empty_unreadable_deep_and_scalar_fields(spark):
    deep = "[" * 20_000 + "]" * 20_000
    rows = [("t", str(i), "f", v) for i, v in enumerate([None, "", " ", "{", '"role":1}', deep, "5", "null", "{}", json.dumps({"content": None})])]
    out = nested.flatten(spark.createDataFrame(rows, "tbl string, row_key string, field string, value string"))
    assert sorted(r["row_key"] for r in out.collect()) == ["6", "7", "8", "9"]
    assert nested.flatten(spark.createDataFrame([], "tbl string, row_key string, field string, value string")).count() == 0


def test_typed_table_gives_null_for_unfit_values(spark):
    rows = spark.createDataFrame([("t", "1", "f", '{"content":[{"type":"a","id":"x","is_error":"no"}]}')], "tbl string, row_key string, field string, value string")
    r = nested.typed_table(nested.flatten(rows), "block", "type string, id string, is_error boolean").first()
    assert (r["type"], r["id"], r["is_error"], r["parent"]) == ("a", "x", None, "")


def test_unreadable_counts(spark):
    rows = spark.createDataFrame([("t", "f", v) for v in (None, "{", '"a":1}', "{}")], "tbl string, field string, value string")
    r = nested.unreadable(rows).first()
    assert (r["n_null"], r["n_unreadable"]) == (1, 2)
    assert rows.where(F.lit(True)).count() == 4
