"""Queries of the inspection plans over whole tables of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions import values
from loomlog.operators import static
from loomlog.plans import inspect
from loomlog.queries.registry import query
from loomlog.util import table

_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')"
#: the lines of a text, without an empty one at its end
_L = f"CASE WHEN {_LINES}[-1] = '' THEN list_slice({_LINES}, 1, len({_LINES}) - 1) ELSE {_LINES} END"
_DOCS = f"WITH l AS (SELECT doc_id, {_L} AS lines FROM documents WHERE text IS NOT NULL) "


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), "text")


def _plan(op: str, value: str = "", limit: int = 3) -> dict:
    return {"op": op, "path": "fixture.txt", "value": value, "limit": limit}


@query(_DOCS + "SELECT doc_id, coalesce(list_aggregate(list_slice(lines, 1, 3), 'string_agg', chr(10)), '') AS answer FROM l")
def pln_01_read_head(spark, d):
    """The first three lines of every document."""
    return inspect.run(_plan("read_head"), _docs(spark, d)).withColumnRenamed("path", "doc_id")


@query(_DOCS + "SELECT doc_id, coalesce(list_aggregate(list_slice(lines, greatest(len(lines) - 2, 1), len(lines)), 'string_agg', chr(10)), '') AS answer FROM l")
def pln_02_read_tail(spark, d):
    return inspect.run(_plan("read_tail"), _docs(spark, d)).withColumnRenamed("path", "doc_id")


@query(_DOCS + "SELECT doc_id, coalesce(list_aggregate(list_slice(list_filter(lines, lambda x: contains(lower(x), 'error')), 1, 5), 'string_agg', chr(10)), '') AS answer FROM l")
def pln_03_find_literal(spark, d):
    """The first five lines of every document that hold a word."""
    return inspect.run(_plan("find_literal", "Error", 5), _docs(spark, d)).withColumnRenamed("path", "doc_id")


@query("SELECT DISTINCT file_name AS answer FROM raw_logs WHERE file_name ILIKE '2025%.jsonl' ORDER BY lower(file_name), file_name LIMIT 20")
def pln_04_list_files(spark, d):
    """The first twenty file names of a pattern."""
    return inspect.run(_plan("list_files", "2025*.jsonl", 20), table(spark, d, "raw_logs").select(F.col("file_name").alias("path"))).select("answer")


@query("SELECT id, CASE WHEN json_valid(data) AND json_type(data) = 'OBJECT' THEN coalesce(CAST(json_extract(data, '$.type') AS VARCHAR), 'null') END AS answer FROM oc_part")
def pln_05_json_field(spark, d):
    """One top-level member of every part as JSON."""
    parts = table(spark, d, "oc_part").select(F.col("id").alias("path"), F.col("data").alias("text"))
    return inspect.run(_plan("json_field", "type"), parts).withColumnRenamed("path", "id")


_OUT = _LINES.replace("text", "out")
_EVIDENCE = f"""WITH l AS (SELECT ordinal, CASE WHEN {_OUT}[-1] = '' THEN list_slice({_OUT}, 1, len({_OUT}) - 1) ELSE {_OUT} END AS lines FROM records WHERE out IS NOT NULL),
e AS (SELECT ordinal, lines, list_filter(range(1, len(lines) + 1), lambda i: starts_with(lines[i], 'WARN') OR starts_with(lines[i], 'Build') OR starts_with(lines[i], 'error')) AS expected, list_filter(range(1, len(lines) + 1), lambda i: starts_with(lines[i], 'WARN') OR starts_with(lines[i], 'commit')) AS selected FROM l) """


def _evidence(spark, d):
    lines = inspect.split_lines(F.col("out"))
    rows = table(spark, d, "records").where("out is not null").select("ordinal", lines.alias("lines"))
    return rows.withColumns({"expected": inspect.lines_starting(F.col("lines"), "WARN", "Build", "error"), "selected": inspect.lines_starting(F.col("lines"), "WARN", "commit")})


@query(_EVIDENCE + "SELECT ordinal, list_aggregate(list_transform(expected, lambda i: lines[i]), 'string_agg', chr(10)) AS evidence, list_aggregate(list_transform(expected, lambda i: CAST(i AS VARCHAR)), 'string_agg', ',') AS numbers FROM e WHERE len(expected) > 0")
def pln_06_evidence(spark, d):
    """The lines of every output that begin like a message, as they stand (PLN-6, FN-25, FN-26)."""
    rows = _evidence(spark, d).where(F.size("expected") > 0)
    return rows.select("ordinal", F.array_join(inspect.select_lines(F.col("lines"), F.col("expected")), "\n").alias("evidence"), F.array_join(F.col("expected").cast("array<string>"), ",").alias("numbers"))


@query(_EVIDENCE + "SELECT ordinal, CASE WHEN len(expected) = 0 THEN 1.0 ELSE CAST(len(list_intersect(expected, selected)) AS DOUBLE) / len(expected) END AS recall, CASE WHEN len(selected) = 0 THEN CASE WHEN len(expected) = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(len(list_intersect(expected, selected)) AS DOUBLE) / len(selected) END AS \"precision\" FROM e")
def fn_24_evidence_scores(spark, d):
    """Recall and precision of one selection of lines against another (FN-24, SET-5)."""
    return _evidence(spark, d).select("ordinal", inspect.recall(F.col("expected"), F.col("selected")).alias("recall"), inspect.precision(F.col("expected"), F.col("selected")).alias("precision"))


@query()
def fn_23_canonical_json(spark, d):
    """Every part's JSON in canonical form; equal forms are equal values."""
    return inspect.with_canonical(table(spark, d, "oc_part").select("id", "data"), "data").select("id", F.sha2("canonical", 256).alias("canonical_sha256"))


@query(_DOCS + "SELECT doc_id, coalesce(list_aggregate(list_transform(range(1, len(lines) + 1), lambda i: i || ': ' || lines[i]), 'string_agg', chr(10)), '') AS numbered FROM l")
def prj_22_numbered_lines(spark, d):
    """Every document with its lines numbered, as a request shows them."""
    from loomlog.operators.freeze import numbered

    return _docs(spark, d).select(F.col("path").alias("doc_id"), numbered(inspect.split_lines(F.col("text"))).alias("numbered"))


@query("SELECT CAST(ordinal AS VARCHAR) AS id, 'parsed' AS unit_status, 'exec_command' AS tool, 'candidate' AS status, regexp_extract(js, 'cmd: \"([^\"]*)\"', 1) AS command FROM records WHERE js IS NOT NULL AND contains(js, 'tools.exec_command({cmd: \"')")
def fn_29_recovered_calls(spark, d):
    """Shell commands that the JS cells spell out, recovered without running them."""
    cells = table(spark, d, "records").where("js is not null").select(F.col("ordinal").alias("id"), F.col("js").alias("code"))
    return static.recovered_calls(cells).where("tool is not null").select("id", "unit_status", "tool", "status", "command")


def _reads(spark, d):
    commands = table(spark, d, "commands_normalized").select(F.col("record_id").alias("id"), values.shell_text(F.col("command_text"), F.col("command_argv")).alias("code"))
    return static.recovered_reads(commands.where(F.lower("code").contains("get-content")))


@query()
def fn_30_recovered_reads(spark, d):
    """The Get-Content commands of all command texts with their status; texts are tested for the word before they are parsed."""
    return _reads(spark, d)


@query()
def agg_40_recovery_counters(spark, d):
    """How many recovered commands have which status."""
    cells = table(spark, d, "records").where("js is not null").select(F.col("ordinal").alias("id"), F.col("js").alias("code"))
    calls = static.recovered_calls(cells).select(F.lit("js").alias("kind"), F.coalesce("status", "unit_status").alias("status"))
    return calls.unionByName(_reads(spark, d).select(F.lit("powershell").alias("kind"), "status")).groupBy("kind", "status").agg(F.count("*").alias("n"))

