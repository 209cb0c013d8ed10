"""p1_table: no value is lost to a renaming that another store reports."""

import json

from loomlog.operators import drift


def table(spark, files):
    """files: {(store, file_no): [object]}"""
    rows = [(s, f, f"{s}-{f}", k, json.dumps(x)) for (s, f), lines in files.items() for k, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "store string, file_no int, file_name string, line_no long, raw string")
    return {(r.store, r.file_no, r.line_no): r.asDict() for r in drift.consistent(df).collect()}


FILES = {
    ("a", 1): [{"n": k, "tags": "alpha beta gamma"} for k in range(5)],
    ("a", 2): [{"n": k, "desc": "alpha beta gamma"} for k in range(5)],
    ("b", 1): [{"n": k, "tags": f"red {k}", "desc": f"long text {k}"} for k in range(5)],
}


def test_both_values_of_a_line_are_kept(spark):
    got = table(spark, FILES)
    assert [(got["b", 1, k]["tags"], got["b", 1, k]["desc"]) for k in range(5)] == [(f"red {k}", f"long text {k}") for k in range(5)]


def test_renaming_holds_in_its_store_from_its_file_on(spark):
    got = table(spark, FILES)
    assert {got["a", f, k]["tags"] for f in (1, 2) for k in range(5)} == {"alpha beta gamma"}
    assert all(r["failed_casts"] == [] for r in got.values())


def test_names_that_meet_in_a_later_file_of_the_store_stay_apart(spark):
    got = table(spark, FILES | {("a", 3): [{"n": 1, "tags": "alpha", "desc": "beta"}]})
    assert (got["a", 3, 0]["tags"], got["a", 3, 0]["desc"]) == ("alpha", "beta")


def test_related_names_that_never_meet_are_one_column_in_all_stores(spark):
    files = {("a", 1): [{"exit_code": 3}, {"exit_code": 0}], ("a", 2): [{"exitCode": 3}, {"exitCode": 0}], ("b", 1): [{"exitCode": 7}]}
    got = table(spark, files)
    assert "exit_code" not in got["b", 1, 0] and got["b", 1, 0]["exitCode"] == 7 and got["a", 1, 0]["exitCode"] == 3


def test_any_field_name_is_a_column_of_its_own(spark):
    got = table(spark, {("s", 1): [{"a.b": 1, "a": {"b": 2}, "Cmd": "x", "cmd": "y", "store": "z", "it's": 3, "more": 4, "back\\slash": 5}]})
    row = got["s", 1, 0]
    assert row["a.b"] == 1 and row["Cmd"] == "x" and row["cmd_2"] == "y" and row["store_2"] == "z" and row["it's"] == 3 and row["more_2"] == 4 and row["back\\slash"] == 5


def test_names_beyond_the_columns_are_kept(spark):
    rows = [("s", 1, "f", k, json.dumps({"a": k, f"x{k}": {"y": k}})) for k in range(5)]
    df = spark.createDataFrame(rows, "store string, file_no int, file_name string, line_no long, raw string")
    got = drift.consistent(df, most=2).collect()
    assert all(r["a"] == r["line_no"] for r in got)
    assert sum(len(r["more"]) for r in got) == 4


def report(spark, files, extra=()):
    rows = [(s, f, "n", k, x if isinstance(x, str) else json.dumps(x)) for (s, f), lines in files.items() for k, x in enumerate(lines)] + list(extra)
    df = spark.createDataFrame(rows, "store string, file_no int, file_name string, line_no long, raw string")
    return {(r.store, r.file_no, r.field, r.change) for r in drift.changes(df).collect()}


def test_added_removed_renamed_retyped_and_gaps(spark):
    files = {
        ("a", 1): [{"exit_code": 1, "cmd": "git status", "gone": "x y z"}] * 3,
        ("a", 3): [{"exitCode": "1", "cmd": "git status"}] * 3,
        ("a", 4): [{"exitCode": None, "cmd": "git log", "flag": True}, "", "{", "[1]"],
        ("a", 5): [{"exitCode": 4, "cmd": "git log", "flag": True}],
        ("b", 1): ["", "not json"], ("b", 2): [{"k": 1}],
    }
    assert report(spark, files) == {("a", 3, "exitCode", "renamed"), ("a", 3, "exitCode", "retyped"), ("a", 3, "gone", "removed"), ("a", 4, "flag", "added"), ("a", 5, "exitCode", "retyped")}


def test_large_files_are_split_without_change(spark, monkeypatch):
    files = {("a", 1): [{"n": k, "command": f"git show {k}"} for k in range(50)], ("a", 2): [{"n": str(k), "cmd": f"git show {k}"} for k in range(50)]}
    whole = report(spark, files)
    monkeypatch.setattr(drift, "CHUNK", 3)
    assert report(spark, files) == whole == {("a", 2, "n", "retyped"), ("a", 2, "cmd", "renamed")}


def test_empty_table_and_null_lines(spark):
    assert report(spark, {}) == set()
    assert report(spark, {}, [(None, None, None, None, None), ("a", 1, "f", 1, None)]) == set()


def test_path_types(spark):
    df = spark.createDataFrame([("s", 1, "f", 1, '{"a":{"b":[1,"x",null]},"c":1.5}')], "store string, file_no int, file_name string, line_no long, raw string")
    got = {(r.path, r.type, r.n) for r in drift.paths(df).collect()}
    assert got == {("a", "object", 1), ("a.b", "array", 1), ("a.b[]", "integer", 1), ("a.b[]", "string", 1), ("a.b[]", "null", 1), ("c", "decimal", 1)}
