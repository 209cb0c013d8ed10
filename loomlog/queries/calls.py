"""Queries over the transcript tables: adapters, joins of calls and results, as-of context and dispositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import values
from loomlog.functions.values import member
from loomlog.operators import reconcile, sessions
from loomlog.queries.registry import query
from loomlog.sources import transcripts as T
from loomlog.util import clean_key, table


def json_string_sql(c: str) -> str:
    """A text as a JSON string, for the oracle."""
    out = f"replace(replace({c}, '\\', '\\\\'), '\"', '\\\"')"
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for k in range(1, 32):
        out = f"replace({out}, chr({k}), '{short.get(k, f'\\u{k:04x}')}')"
    return f"('\"' || {out} || '\"')"


def texts_sql(array: str) -> str:
    """The texts of an array of JSON objects joined by line ends."""
    return f"coalesce(list_aggregate(list_filter(list_transform(json_extract({array}, '$[*]'), lambda x: CASE WHEN json_type(x, '$.text') = 'VARCHAR' THEN x ->> '$.text' END), lambda t: t IS NOT NULL), 'string_agg', chr(10)), '')"


def content_sql(b: str, path: str) -> str:
    return f"CASE json_type({b}, '{path}') WHEN 'VARCHAR' THEN {b} ->> '{path}' WHEN 'ARRAY' THEN {texts_sql(f'json_extract({b}, {chr(39)}{path}{chr(39)})')} END"


CLEAN = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"
NO_CONTENT = "json_valid({0}) AND json_type({0}, '$.content') = 'ARRAY'"
CLAUDE = f"""WITH tb AS (SELECT file_name AS file, line_no AS line, type AS kind, i AS part, json_extract(message, '$.content[' || i || ']') AS b, message ->> '$.model' AS model, toolUseResult AS result FROM (SELECT *, unnest(range(CAST(json_array_length(message, '$.content') AS BIGINT))) AS i FROM transcript_lines WHERE {NO_CONTENT.format('message')})),
c AS (SELECT file, line, part, call_id, tool, command FROM (SELECT file, line, part, b ->> '$.id' AS call_id, b ->> '$.name' AS tool, b ->> '$.input.command' AS command, row_number() OVER (PARTITION BY b ->> '$.id' ORDER BY file, line, part) AS rn FROM tb WHERE kind = 'assistant' AND b ->> '$.type' = 'tool_use') WHERE rn = 1),
r AS (SELECT *, CASE WHEN regexp_matches(output, '^Exit code (\\d+)') THEN CAST(regexp_extract(output, '^Exit code (\\d+)', 1) AS INT) WHEN NOT failed THEN 0 END AS exit_code FROM (SELECT file, line, part, b ->> '$.tool_use_id' AS call_id, coalesce({content_sql('b', '$.content')}, '') AS output, coalesce(CAST(b ->> '$.is_error' AS BOOLEAN), false) AS failed FROM tb WHERE kind = 'user' AND b ->> '$.type' = 'tool_result')) """


def claude(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Calls and results of the transcript lines."""
    lines = table(spark, d, "transcript_lines").select(F.col("file_name").alias("file"), F.col("line_no").alias("line"), F.col("type").alias("kind"), F.col("received_at").alias("ts"), "message", F.col("toolUseResult").alias("result"))
    blocks = T.claude_blocks(lines)
    return T.claude_calls(blocks), T.claude_results(blocks)


@query(CLAUDE + "SELECT * FROM c")
def rel_01_first_seen_calls(spark, d):
    """The tool calls of the transcripts, each id once over all files (REL-1)."""
    calls, _ = claude(spark, d)
    return reconcile.first_seen(calls, ["call_id"], ["file", "line", "part"]).select("file", "line", "part", "call_id", "tool", "command")


@query(CLAUDE + """SELECT file, line, part, call_id, tool, command, output, exit_code, failed, call_at IS NOT NULL AS result_present FROM (SELECT c.*, r.output, r.exit_code, r.failed, r.line AS call_at, row_number() OVER (PARTITION BY c.call_id ORDER BY r.line, r.part) AS rr
FROM c LEFT JOIN r ON c.call_id = r.call_id AND c.file = r.file AND (r.line, r.part) > (c.line, c.part)) WHERE rr = 1""")
def join_02_calls_results(spark, d):
    """Each call with the first result after it in its file; calls without one stay (JOIN-1, JOIN-2, PRJ-8, PRJ-11)."""
    calls, results = claude(spark, d)
    calls = reconcile.first_seen(calls, ["call_id"], ["file", "line", "part"]).select("file", "line", "part", "call_id", "tool", "command")
    out = reconcile.pair(calls, results.drop("interrupted"), ["file", "call_id"], ["line", "part"])
    return out.select("file", "line", "part", "call_id", "tool", "command", "output", "exit_code", "failed", "result_present")


@query(CLAUDE + "SELECT DISTINCT file, call_id FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file = r.file AND c.call_id = r.call_id)")
def set_03_unmatched_results(spark, d):
    """Results whose call is in no line of their file."""
    calls, results = claude(spark, d)
    return reconcile.unmatched(results.where("call_id is not null"), calls, calls.limit(0), ["file", "call_id"])


_TUR = "json_valid(toolUseResult) AND json_type(toolUseResult) = 'OBJECT'"


@query(f"""SELECT DISTINCT line_id, CASE WHEN json_type(toolUseResult, '$.output') = 'VARCHAR' THEN toolUseResult ->> '$.output' WHEN json_type(toolUseResult, '$.stdout') = 'VARCHAR' THEN (toolUseResult ->> '$.stdout') || CASE WHEN json_type(toolUseResult, '$.stderr') = 'VARCHAR' THEN chr(10) || (toolUseResult ->> '$.stderr') ELSE '' END
ELSE nullif({content_sql('toolUseResult', '$.content')}, '') END AS output, CASE WHEN json_type(toolUseResult, '$.exit_code') IN ('UBIGINT', 'BIGINT') THEN CAST(toolUseResult ->> '$.exit_code' AS INT) END AS exit_code FROM transcript_lines WHERE {_TUR}""")
def fn_15_result_values(spark, d):
    """Output and exit code of every structured result; booleans and texts are no exit codes (FN-15, PRJ-4, PRJ-5)."""
    rows = T.parsed(table(spark, d, "transcript_lines").select("line_id", "toolUseResult"), "toolUseResult")
    return rows.select("line_id", F.nullif(values.result_output(F.col("v")), F.lit("")).alias("output"), values.result_exit(F.col("v")).alias("exit_code")).distinct()


@query("SELECT tool, lower(split_part(split_part(tool, '.', -1), '__', -1)) IN ('exec_command', 'shell_command', 'shell', 'bash', 'powershell', 'run_terminal_cmd', 'run_terminal_command', 'run_shell_command', 'oc_bash') AS is_shell, count(*) AS n FROM records GROUP BY ALL")
def prj_06_shell_tools(spark, d):
    """Which tools run shell commands, by the last part of their names."""
    return table(spark, d, "records").groupBy("tool").agg(F.count("*").alias("n")).select("tool", values.is_shell_tool(F.col("tool")).alias("is_shell"), "n")


@query(f"SELECT record_id, CASE WHEN command_text IS NOT NULL THEN sha256({json_string_sql('command_text')}) ELSE sha256('[' || list_aggregate(list_transform(command_argv, lambda x: {json_string_sql('x')}), 'string_agg', ', ') || ']') END AS command_digest FROM commands_normalized")
def fn_16_command_digest(spark, d):
    """The digest of each command in its JSON form, a text or a list."""
    rows = table(spark, d, "commands_normalized").select("record_id", "command_text", "command_argv")
    return rows.select("record_id", F.when(F.col("command_text").isNotNull(), values.digest(F.col("command_text"))).otherwise(values.digest_list(F.col("command_argv"))).alias("command_digest"))


# ---- the two versions of the second store

MESSAGES = f"""WITH mb AS (SELECT {CLEAN.format('session_id')} AS session, id, seq, i AS part, json_extract(data, '$.content[' || i || ']') AS b FROM (SELECT *, unnest(range(CAST(json_array_length(data, '$.content') AS BIGINT))) AS i FROM session_message WHERE {NO_CONTENT.format('data')})),
v2 AS (SELECT DISTINCT session, id, seq, part, b ->> '$.id' AS call_id, b ->> '$.name' AS tool, b ->> '$.input.command' AS command FROM mb WHERE b ->> '$.type' = 'tool_use'),
vr AS (SELECT DISTINCT session, id, seq, part, b ->> '$.tool_use_id' AS call_id, coalesce({content_sql('b', '$.content')}, '') AS output FROM mb WHERE b ->> '$.type' = 'tool_result'),
pt AS (SELECT DISTINCT id, session_id AS session, coalesce(data ->> '$.callID', id) AS call_id, data ->> '$.tool' AS tool, data ->> '$.state.input.command' AS command, data ->> '$.state.status' AS status, CASE WHEN json_type(data, '$.state.content') = 'ARRAY' THEN {texts_sql("json_extract(data, '$.state.content')")} WHEN json_type(data, '$.state.output') = 'VARCHAR' THEN data ->> '$.state.output' ELSE '' END AS output,
coalesce(CASE WHEN json_type(data, '$.state.metadata.exit') IN ('UBIGINT', 'BIGINT') THEN CAST(data ->> '$.state.metadata.exit' AS INT) END) AS exit_code, CAST(data ->> '$.state.time.end' AS BIGINT) - CAST(data ->> '$.state.time.start' AS BIGINT) AS dur_ms, coalesce(data ->> '$.state.input.workdir', directory) AS cwd FROM oc_part LEFT JOIN (SELECT id AS sid, directory FROM sessions) ON sid = session_id WHERE json_valid(data) AND data ->> '$.type' = 'tool') """


def _v2_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "session_message").select(clean_key(F.col("session_id")).alias("session"), "id", "seq", "data")
    return T.opencode_messages(rows)


def v2_calls(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    rows = _v2_blocks(spark, d).where(member(b, "$.type").isin("tool", "tool_use"))
    return rows.select("session", "id", "seq", "part", member(b, "$.id").alias("call_id"), member(b, "$.name").alias("tool"), values.command_member(F.try_variant_get(b, "$.input", "variant")).alias("command")).distinct()


def v2_results(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    rows = _v2_blocks(spark, d).where(member(b, "$.type") == "tool_result")
    return rows.select("session", "id", "seq", "part", member(b, "$.tool_use_id").alias("call_id"), F.coalesce(values.text_content(F.try_variant_get(b, "$.content", "variant")), F.lit("")).alias("output")).distinct()


def v1_parts(spark: SparkSession, d: str) -> DataFrame:
    """The tool parts of the first version with the directory of their session."""
    dirs = table(spark, d, "sessions").select(F.col("id").alias("sid"), "directory")
    models = table(spark, d, "session_message").select(F.col("id").alias("mid"), T.message_model(F.try_parse_json("data")).alias("model")).groupBy("mid").agg(F.min("model").alias("model"))
    rows = table(spark, d, "oc_part").select(F.col("id").alias("part_id"), "message_id", F.col("session_id").alias("session"), "data").distinct()
    rows = rows.join(dirs, rows.session == dirs.sid, "left").join(models, rows.message_id == models.mid, "left")
    return T.opencode_parts(rows.withColumns({"file": F.col("session"), "line": F.col("part_id"), "part": F.lit(0)}))


@query(MESSAGES + "SELECT DISTINCT session, call_id, tool, command, status, output, exit_code, status = 'completed' AND coalesce(exit_code, 0) = 0 AS ok, dur_ms, cwd, 'unknown' AS model FROM pt")
def src_03_store_parts(spark, d):
    """Commands of the store's first version with session directory and message model (SRC-3, JOIN-4, JOIN-5, PRJ-10)."""
    return v1_parts(spark, d).select(F.col("file").alias("session"), "call_id", "tool", "command", "status", "output", "exit_code", "ok", "dur_ms", "cwd", "model").distinct()


@query(MESSAGES + "SELECT session, call_id, tool, command, version FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY version, session, place) AS rn FROM (SELECT session, call_id, tool, command, 1 AS version, id AS place FROM v2 UNION ALL SELECT session, call_id, tool, command, 2, id FROM pt)) WHERE rn = 1 OR call_id IS NULL")
def rel_02_merged_versions(spark, d):
    """Calls of both versions of the store; of the same id that of the second version stays."""
    new = v2_calls(spark, d).select("session", "call_id", "tool", "command", F.lit(1).alias("version"), F.col("id").alias("place"))
    old = v1_parts(spark, d).select(F.col("file").alias("session"), "call_id", "tool", "command", F.lit(2).alias("version"), F.col("line").alias("place"))
    return reconcile.prefer(new.unionByName(old), ["call_id"], "version", ["session", "place"]).select("session", "call_id", "tool", "command", "version")


@query(MESSAGES + """SELECT c.session, c.seq, c.part, c.call_id, c.command, r.output, r.output IS NOT NULL AS result_present FROM v2 c LEFT JOIN (SELECT session, call_id, output FROM (SELECT *, row_number() OVER (PARTITION BY session, call_id ORDER BY seq DESC NULLS LAST, id DESC, part DESC) AS rn FROM vr) WHERE rn = 1) r ON c.session = r.session AND c.call_id = r.call_id""")
def join_03_order_free(spark, d):
    """Each call with the last result of its id, wherever that stands (JOIN-3)."""
    calls = v2_calls(spark, d).select("session", "seq", "part", "call_id", "command")
    results = v2_results(spark, d).withColumnRenamed("seq", "r_seq").withColumnRenamed("part", "r_part").withColumnRenamed("id", "r_id")
    return reconcile.pair(calls, results, ["session", "call_id"], ["r_seq", "r_id", "r_part"], which="last", must_follow=False)


@query(MESSAGES + "SELECT session, call_id, list_reduce(list_transform(list_sort(list(struct_pack(seq := seq, id := id, part := part, output := output))), lambda s: s.output), lambda a, x: CASE WHEN a = x THEN a ELSE a || chr(10) || x END) AS output FROM vr GROUP BY session, call_id")
def join_10_chunks(spark, d):
    """The chunks of each result joined in order; a chunk that repeats what is there adds nothing."""
    results = v2_results(spark, d).withColumn("exit_code", F.lit(None).cast("int"))
    return reconcile.chunks(results, ["session", "call_id"], ["seq", "id", "part"]).select("session", "call_id", "output")


_TURNS = f"""WITH m AS (SELECT DISTINCT {CLEAN.format('session_id')} AS session, seq, id, lower(trim(coalesce(type, data ->> '$.role'))) IN ('user', 'human') AS is_user, {content_sql('data', '$.content')} AS text, CASE WHEN data ->> '$.model' IS NOT NULL THEN coalesce(data ->> '$.model.providerID', '') || '/' || coalesce(data ->> '$.model.id', '') END AS model FROM session_message WHERE json_valid(data) AND json_type(data) = 'OBJECT') """
_ASOF = _TURNS + """, w AS (SELECT session, seq, id, is_user, last_value(CASE WHEN is_user AND text <> '' THEN text END IGNORE NULLS) OVER o AS context, last_value(model IGNORE NULLS) OVER o AS model_as_of FROM m WINDOW o AS (PARTITION BY session ORDER BY seq NULLS FIRST, id, text NULLS FIRST, model NULLS FIRST, is_user NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) """


def _turns(spark: SparkSession, d: str) -> DataFrame:
    rows = T.parsed(table(spark, d, "session_message").select(clean_key(F.col("session_id")).alias("session"), "seq", "id", "type", "data"), "data")
    v = F.col("v")
    model = F.when(F.schema_of_variant(F.try_variant_get(v, "$.model", "variant")).startswith("OBJECT"), T.message_model(v))
    user = F.lower(F.trim(F.coalesce(F.col("type"), member(v, "$.role")))).isin("user", "human")
    return rows.select("session", "seq", "id", user.alias("is_user"), values.text_content(F.try_variant_get(v, "$.content", "variant")).alias("text"), model.alias("model")).distinct()


def as_of(turns: DataFrame) -> DataFrame:
    """Turns with the last user text and the last model before each."""
    said = turns.withColumn("_said", F.when(F.col("is_user") & (F.col("text") != ""), F.col("text")))
    return sessions.carry_forward(said, ["session"], ["seq", "id", "text", "model", "is_user"], [F.floor(F.col("seq") / 4096)], {"context": "_said", "model_as_of": "model"})


@query(_ASOF + "SELECT session, seq, id, left(coalesce(context, ''), 8000) AS request_context, coalesce(length(context) > 8000, false) AS context_truncated, CASE WHEN context IS NULL THEN 'missing' ELSE 'preceding_user_message_unverified' END AS context_association, model_as_of FROM w WHERE NOT coalesce(is_user, false)")
def join_07_asof_context(spark, d):
    """The request before each message that is not the user's, and the model as of then (JOIN-6, JOIN-7, PRJ-3)."""
    rows = as_of(_turns(spark, d)).where(~F.coalesce("is_user", F.lit(False)))
    return rows.select(
        "session", "seq", "id", F.left(F.coalesce("context", F.lit("")), F.lit(8000)).alias("request_context"), F.coalesce(F.length("context") > 8000, F.lit(False)).alias("context_truncated"),
        F.when(F.col("context").isNull(), "missing").otherwise("preceding_user_message_unverified").alias("context_association"), "model_as_of",
    )


@query(MESSAGES + """, c AS (SELECT session, call_id, command, tool FROM (SELECT *, row_number() OVER (PARTITION BY session, call_id ORDER BY seq, id, part) AS rn FROM v2) WHERE rn = 1 AND call_id IS NOT NULL), n AS (SELECT session, call_id, command, output, exit_code FROM (SELECT *, row_number() OVER (PARTITION BY session, call_id ORDER BY id) AS rn FROM pt) WHERE rn = 1),
k AS (SELECT session, call_id, list_reduce(list_transform(list_sort(list(struct_pack(seq := seq, id := id, part := part, output := output))), lambda s: s.output), lambda a, x: CASE WHEN a = x THEN a ELSE a || chr(10) || x END) AS output FROM vr GROUP BY session, call_id)
SELECT coalesce(c.session, n.session) AS session, coalesce(c.call_id, n.call_id) AS call_id, coalesce(n.command, c.command) AS command, coalesce(n.output, k.output, '') AS output, n.exit_code, n.call_id IS NOT NULL OR k.call_id IS NOT NULL AS result_present,
CASE WHEN n.call_id IS NOT NULL AND c.call_id IS NOT NULL THEN 'call+native' WHEN n.call_id IS NOT NULL THEN 'native' WHEN k.call_id IS NOT NULL THEN 'call+result' ELSE 'call' END AS origin FROM c FULL JOIN n ON c.session = n.session AND c.call_id = n.call_id LEFT JOIN k ON k.session = coalesce(c.session, n.session) AND k.call_id = coalesce(c.call_id, n.call_id)""")
def join_09_reconcile(spark, d):
    """Calls of messages, their results, and the parts of the store as native events, in one table."""
    key = ["session", "call_id"]
    context = {"request_context": F.lit(""), "context_truncated": F.lit(False), "context_association": F.lit("missing")}
    calls = reconcile.first_seen(v2_calls(spark, d).where("call_id is not null"), key, ["seq", "id", "part"]).withColumns({"cwd": F.lit(None).cast("string"), **context})
    results = reconcile.chunks(v2_results(spark, d).withColumn("exit_code", F.lit(None).cast("int")), key, ["seq", "id", "part"])
    natives = sessions.first_per_key(v1_parts(spark, d).withColumnRenamed("file", "session"), key, "line").withColumns(context)
    return reconcile.reconcile(calls, results, natives).select("session", "call_id", "command", "output", "exit_code", "result_present", "origin")


_POINTER = """'{"line": ' || call_pointer.line || ', "part": ' || call_pointer.part || ', "snapshot": "' || call_pointer.snapshot || '"}'"""
_COMMAND = "coalesce(command_text, command_argv[-1])"


@query(f"""SELECT session, CASE WHEN rn > 1 THEN call_id || ':conflict:' || left(sha256(p), 12) ELSE call_id END AS call_id, command, rn > 1 AS call_id_conflict FROM (SELECT *, row_number() OVER (PARTITION BY session, call_id ORDER BY line, part, command) AS rn FROM (SELECT session, call_id, command, arg_min(p, (line, part)) AS p, min((line, part))[1] AS line, min((line, part))[2] AS part FROM
(SELECT session, call_id, {_COMMAND} AS command, {_POINTER} AS p, call_pointer.line AS line, call_pointer.part AS part FROM commands_normalized) GROUP BY session, call_id, command))""")
def join_11_conflicts(spark, d):
    """Commands once per id; another command under the same id gets an id of its own."""
    p = F.col("call_pointer")
    rows = table(spark, d, "commands_normalized").select("session", "call_id", F.coalesce("command_text", F.try_element_at("command_argv", F.lit(-1))).alias("command"), p["line"].alias("line"), p["part"].alias("part"), p["snapshot"].alias("snapshot"))
    pointer = F.format_string('{"line": %d, "part": %d, "snapshot": "%s"}', "line", "part", "snapshot")
    out = reconcile.resolve_conflicts(rows, ["session", "call_id"], "command", ["line", "part", "command"], pointer)
    return out.select("session", "call_id", "command", "call_id_conflict")


@query(MESSAGES + f", k AS (SELECT DISTINCT lower(session) AS session, record_id, {_COMMAND} AS command FROM commands_normalized) SELECT v2.session, v2.call_id, count(*) AS n_known, min(k.record_id) AS first_known FROM v2 JOIN k ON v2.session = k.session AND v2.command = k.command GROUP BY v2.session, v2.call_id, v2.command")
def join_13_known_commands(spark, d):
    """Commands of messages that the normalised table holds for the same session: how many, and the smallest record."""
    known = table(spark, d, "commands_normalized").select(F.lower("session").alias("session"), "record_id", F.coalesce("command_text", F.try_element_at("command_argv", F.lit(-1))).alias("command")).distinct()
    # both sides are keyed by the digest, so long texts are not shuffled
    key = lambda df: df.withColumn("_d", F.xxhash64("command"))
    calls = key(v2_calls(spark, d)).alias("c")
    known = key(known).groupBy("session", "_d").agg(F.count("*").alias("n_known"), F.min("record_id").alias("first_known")).alias("k")
    out = calls.join(known, (F.col("c.session") == F.col("k.session")) & (F.col("c._d") == F.col("k._d")))
    return out.groupBy("c.session", "c.call_id", "c._d").agg(F.sum("n_known").alias("n_known"), F.min("first_known").alias("first_known")).drop("_d")


@query("SELECT CASE WHEN c.record_id IS NULL THEN 'frozen only' WHEN f.record_id IS NULL THEN 'normalised only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT record_id FROM commands_normalized) c FULL JOIN (SELECT DISTINCT record_id FROM frozen_rows) f ON c.record_id = f.record_id GROUP BY ALL")
def join_14_identity_sets(spark, d):
    """Whether two tables hold the same ids (JOIN-14, JOIN-15)."""
    ids = lambda name: table(spark, d, name).select("record_id").distinct()
    c, f = ids("commands_normalized").alias("c"), ids("frozen_rows").alias("f")
    side = F.when(F.col("c.record_id").isNull(), "frozen only").when(F.col("f.record_id").isNull(), "normalised only").otherwise("both")
    return c.join(f, F.col("c.record_id") == F.col("f.record_id"), "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


_FIELDS = [("transcript_lines", "message"), ("transcript_lines", "toolUseResult"), ("oc_part", "data"), ("session_message", "data"), ("raw_logs", "raw")]
_DISPOSED = " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS field, CASE WHEN NOT coalesce(regexp_matches({c}, '\\S'), false) THEN 'blank' WHEN NOT json_valid({c}) THEN 'malformed' WHEN json_type({c}) = 'OBJECT' THEN 'object' ELSE 'non_object' END AS disposition FROM {t}" for t, c in _FIELDS)


def _disposed(spark: SparkSession, d: str) -> DataFrame:
    rows = [table(spark, d, t).select(F.lit(t).alias("tbl"), F.lit(c).alias("field"), F.col(c).alias("value")) for t, c in _FIELDS]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return T.dispositions(out, "value", ("tbl", "field"))


@query(f"SELECT tbl, field, disposition, count(*) AS n FROM ({_DISPOSED}) GROUP BY ALL")
def agg_31_dispositions(spark, d):
    """What became of every JSON text; the counts of a field add up to its rows."""
    return _disposed(spark, d)


@query(f"SELECT disposition, count(*) AS n FROM ({_DISPOSED}) GROUP BY ALL")
def agg_32_totals(spark, d):
    return _disposed(spark, d).groupBy("disposition").agg(F.sum("n").alias("n"))


@query("SELECT name, count(*) AS n FROM (SELECT DISTINCT file_name, line_no, i, json_extract_string(message, '$.content[' || i || '].name') AS name, json_extract_string(message, '$.content[' || i || '].type') AS t FROM (SELECT *, unnest(range(CAST(json_array_length(message, '$.content') AS BIGINT))) AS i FROM transcript_lines WHERE contains(message, '\"name\":\"Bash\"') AND json_valid(message) AND json_type(message, '$.content') = 'ARRAY')) WHERE t = 'tool_use' GROUP BY ALL")
def src_13_prefiltered(spark, d):
    """Tools used in lines that mention one of them: the text is tested before any JSON is read (SRC-13)."""
    rows = table(spark, d, "transcript_lines").where(F.col("message").contains('"name":"Bash"')).select(F.col("file_name").alias("file"), F.col("line_no").alias("line"), "message")
    blocks = T.claude_blocks(rows).where(member(F.col("b"), "$.type") == "tool_use")
    return blocks.select("file", "line", "part", member(F.col("b"), "$.name").alias("name")).distinct().groupBy("name").agg(F.count("*").alias("n"))


@query(r"""SELECT ext, place, count(*) AS n FROM (SELECT lower(regexp_extract(name, '(?i)\.(py|mjs|cjs|js|ts|tsx|ps1|sh|bat|cmd)$', 1)) AS ext, CASE WHEN regexp_matches(name, '(?i)(Temp|tmp|scratch|\.tmp-|[\\/]scripts?[\\/]|\.codex[\\/]visualizations)') THEN 'temp/scratch' ELSE 'in repo' END AS place FROM
(SELECT unnest(json_extract_string(data, '$.state.metadata.files[*].name')) AS name FROM oc_part WHERE json_valid(data))) WHERE ext <> '' GROUP BY ALL""")
def agg_22_script_census(spark, d):
    """Script files that the parts of a store name, by extension and place (AGG-22, FN-20)."""
    rows = T.parsed(table(spark, d, "oc_part").select("data"), "data")
    names = rows.select(F.explode(F.try_variant_get("v", "$.state.metadata.files", "array<variant>")).alias("f")).select(member(F.col("f"), "$.name").alias("path"))
    return T.script_census(names, [])


@query("SELECT CAST(ordinal AS VARCHAR) AS call_id, session, cmd AS command, coalesce(out, '') AS output, \"exit\" AS exit_code, coalesce(out, '') <> '' AS result_present, length(coalesce(out, '')) = 700 AS source_cap_suspected FROM records WHERE regexp_matches(cmd, '\\S')")
def src_10_legacy(spark, d):
    """The records read as an earlier corpus: one command per row, cut outputs flagged."""
    return T.legacy(table(spark, d, "records")).select("call_id", "session", "command", "output", "exit_code", "result_present", "source_cap_suspected")


@query("SELECT 'part' AS tbl, id, strftime(time_created, '%Y-%m-%d %H:%M:%S') AS time_created FROM oc_part UNION ALL SELECT 'message', id, time_created FROM session_message")
def set_02_union_all(spark, d):
    """Messages and parts in one table, as rows; sort by time_created, tbl and id where an order is needed (SET-1, SET-2)."""
    parts = table(spark, d, "oc_part").select(F.lit("part").alias("tbl"), "id", F.date_format("time_created", "yyyy-MM-dd HH:mm:ss").alias("time_created"))
    messages = table(spark, d, "session_message").select(F.lit("message").alias("tbl"), "id", F.col("time_created").cast("string").alias("time_created"))
    return messages.unionByName(parts)
