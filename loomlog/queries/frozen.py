"""Queries over normalised commands and frozen rows: identities, contracts, groups, partitions and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions import values
from loomlog.operators import freeze
from loomlog.operators.metrics import ratio
from loomlog.queries.calls import json_string_sql
from loomlog.queries.oracle import q
from loomlog.queries.registry import query
from loomlog.util import cut, table

_TEXT = """CASE WHEN command_text IS NOT NULL THEN command_text WHEN len(command_argv) > 2 AND lower(split_part(replace(command_argv[1], '\\', '/'), '/', -1)) IN ('powershell', 'powershell.exe', 'pwsh', 'pwsh.exe') AND lower(command_argv[-2]) IN ('-command', '-c') THEN command_argv[-1] END"""


@query(f"SELECT record_id, {_TEXT} AS shell_text FROM commands_normalized")
def prj_14_shell_text(spark, d):
    """Each command as shell text; argument lists of other programs have none."""
    return table(spark, d, "commands_normalized").select("record_id", values.shell_text(F.col("command_text"), F.col("command_argv")).alias("shell_text"))


def _g(k: int) -> str:
    return f"regexp_extract(t, {q(values.READ)}, {k})"


_PATH = f"CASE WHEN {_g(2)}[1] = chr(39) THEN replace(substr({_g(2)}, 2, length({_g(2)}) - 2), chr(39) || chr(39), chr(39)) WHEN {_g(2)}[1] = '\"' THEN substr({_g(2)}, 2, length({_g(2)}) - 2) ELSE {_g(2)} END"
CONTRACTS = f"""WITH x AS (SELECT *, {_TEXT} AS t FROM commands_normalized), k AS (SELECT record_id, CASE WHEN lower({_g(3)}) = 'tail' THEN 'read_tail' ELSE 'read_head' END AS op, try_cast({_g(4)} AS INT) AS "limit" FROM x WHERE regexp_matches(t, {q(values.READ)}) AND try_cast({_g(4)} AS INT) BETWEEN 1 AND 100
AND (regexp_matches({_g(2)}, '^[''"]') OR NOT regexp_matches({_g(2)}, '^[@#-]')) AND {_PATH} <> '' AND (lower({_g(1)}) = '-literalpath' OR NOT regexp_matches({_PATH}, '[*?\\[\\]]'))) """


def _contracts(spark, d):
    c = table(spark, d, "commands_normalized").select("record_id", "command_text", "command_argv").withColumn("t", values.shell_text(F.col("command_text"), F.col("command_argv")))
    return c.select("record_id", values.read_contract(F.col("t")).alias("k")).where("k is not null").select("record_id", "k.*")


@query(CONTRACTS + "SELECT record_id, op, \"limit\" FROM k")
def fn_17_read_contract(spark, d):
    """The plain read commands with their limit."""
    return _contracts(spark, d).select("record_id", "op", "limit")


@query(CONTRACTS + "SELECT op, \"limit\", count(DISTINCT record_id) AS n, string_agg(DISTINCT record_id, ',' ORDER BY record_id) AS ids FROM k GROUP BY ALL")
def agg_39_candidates(spark, d):
    """Read candidates per operation and limit with their records in order."""
    one = _contracts(spark, d).select("op", "limit", "record_id").distinct()
    return one.groupBy("op", "limit").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("record_id")), ",").alias("ids"))


_WORDS = "(VALUES " + ", ".join(f"({q(op)}, {i}, {q(t)})" for op, ts in freeze.WORDINGS.items() for i, t in enumerate(ts)) + ") w(op, wording, template)"


@query(CONTRACTS + f"SELECT op, \"limit\", wording, replace(replace(template, '%d', CAST(\"limit\" AS VARCHAR)), '%s', 'fixture.txt') AS request FROM (SELECT DISTINCT op, \"limit\" FROM k) JOIN {_WORDS} USING (op)")
def prj_21_wordings(spark, d):
    """Three wordings of each distinct read request."""
    return freeze.wordings(_contracts(spark, d))


@query(CONTRACTS + "SELECT op, \"limit\", record_id, 'system|user|assistant' AS roles, CASE WHEN op = 'read_tail' THEN 'Read the last ' ELSE 'Read the first ' END || \"limit\" || ' lines of fixture.txt.' AS request, '{\"op\":\"' || op || '\",\"limit\":' || \"limit\" || '}' AS answer FROM k")
def prj_22_chat(spark, d):
    """Each read candidate as a conversation of system text, request and answer."""
    c = _contracts(spark, d)
    request = F.format_string("Read the %s %d lines of fixture.txt.", F.when(F.col("op") == "read_tail", "last").otherwise("first"), F.col("limit"))
    out = freeze.chat(c.withColumn("request", request).withColumn("answer", F.format_string('{"op":"%s","limit":%d}', "op", "limit")), "Choose one operation.")
    return out.select("op", "limit", "record_id", F.array_join("messages.role", "|").alias("roles"), F.col("messages")[1]["content"].alias("request"), F.col("messages")[2]["content"].alias("answer"))


_SESSION = f"CASE WHEN regexp_extract(session, '(?i){values.UUID}') <> '' THEN sha256('\"' || lower(regexp_extract(session, '(?i){values.UUID}')) || '\"') ELSE sha256('[' || {json_string_sql('source_kind')} || ', ' || {json_string_sql('session')} || ']') END"


@query(f"SELECT session, source_kind, {_SESSION} AS session_group, count(*) AS n FROM commands_normalized GROUP BY ALL")
def fn_18_session_key(spark, d):
    return table(spark, d, "commands_normalized").groupBy("session", "source_kind").agg(F.count("*").alias("n")).select("session", "source_kind", values.session_key(F.col("session"), F.col("source_kind")).alias("session_group"), "n")


_BARE = r"lower(regexp_replace(regexp_replace(request_context, '\s+', ' ', 'g'), '^ | $', '', 'g'))"
_NORMAL = f"""regexp_replace(regexp_replace({_BARE}, '{values.UUID}', '<id>', 'g'), '[a-z]:[\\\\/][^\\s"''<>]+', '<path>', 'g')"""
_TASK = f"CASE WHEN len(string_split({_BARE}, ' ')) >= 8 THEN sha256({json_string_sql(_NORMAL)}) END"


@query(f"SELECT record_id, {_TASK} AS task_key FROM commands_normalized")
def fn_19_task_key(spark, d):
    """A key of each request that ignores case, blanks, ids and absolute paths; short requests have none."""
    return table(spark, d, "commands_normalized").select("record_id", values.task_key(F.col("request_context")).alias("task_key"))


@query("SELECT record_id, CASE WHEN exit_code IS NULL THEN 'unknown' WHEN exit_code = 0 THEN 'exit_zero' ELSE 'exit_nonzero' END AS execution, regexp_matches(coalesce(output, ''), '(?i)tokens truncated|bytes omitted|<truncated') AS truncation_marker, regexp_matches(coalesce(output, ''), '(?i)\\b(error|failed|exception)\\b') AS error_keyword FROM commands_normalized")
def prj_19_labels(spark, d):
    """Labels of the outcome: execution, truncation mark and error word."""
    out = F.coalesce("output", F.lit(""))
    return table(spark, d, "commands_normalized").select("record_id", values.execution(F.col("exit_code")).alias("execution"), out.rlike(r"(?i)tokens truncated|bytes omitted|<truncated").alias("truncation_marker"), out.rlike(r"(?i)\b(error|failed|exception)\b").alias("error_keyword"))


_REASONS = """list_filter([CASE WHEN context_association = 'missing' THEN 'missing_user_context' END, CASE WHEN context_truncated THEN 'context_truncated' END, CASE WHEN call_id_conflict THEN 'conflicting_call_id' END, CASE WHEN NOT coalesce(result_present, false) THEN 'missing_result' END, CASE WHEN source_kind = 'legacy' THEN 'legacy_extraction_unverified' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT record_id, list_aggregate({_REASONS}, 'string_agg', '|') AS reasons FROM commands_normalized WHERE len({_REASONS}) > 0")
def prj_17_review_reasons(spark, d):
    rows = table(spark, d, "commands_normalized")
    tags = freeze.review_reasons(F.col("context_association"), F.col("context_truncated"), F.lit(False), F.col("call_id_conflict"), F.col("result_present"), F.col("source_kind"))
    return rows.select("record_id", tags.alias("r")).where(F.size("r") > 0).select("record_id", F.array_join("r", "|").alias("reasons"))


_ACTION = """CASE WHEN list_contains(review_reasons, 'legacy_extraction_unverified') THEN 'reconcile_with_native_source' WHEN list_has_any(review_reasons, ['missing_user_context', 'context_truncated', 'missing_result']) THEN 'recover_context_or_result' WHEN list_contains(review_reasons, 'conflicting_call_id') THEN 'inspect_conflicting_identity' ELSE 'develop_task_verifier' END"""


@query(f"SELECT {_ACTION} AS action, count(*) AS n FROM frozen_rows GROUP BY ALL")
def prj_20_review_action(spark, d):
    return table(spark, d, "frozen_rows").groupBy(freeze.review_action(F.col("review_reasons")).alias("action")).agg(F.count("*").alias("n"))


@query("SELECT record_id FROM frozen_rows WHERE NOT list_has_any(review_reasons, ['conflicting_call_id', 'changing_source'])")
def prj_16_safe_rows(spark, d):
    return freeze.safe_for_training(table(spark, d, "frozen_rows")).select("record_id")


@query(f"SELECT DISTINCT id, record_id, source_kind, command_sha256 FROM (SELECT sha256('[\"' || record_id || '\", \"' || command_sha256 || '\", \"' || output_sha256 || '\"]') AS id, record_id, source_kind, command_sha256 FROM commands_normalized)")
def rel_03_observations(spark, d):
    """Each observation once, by the digest of record, command and output, and without texts of the source (REL-3, PRJ-18)."""
    return freeze.observations(table(spark, d, "commands_normalized")).select("id", "record_id", "source_kind", "command_sha256")


_OBSERVED = f"o AS (SELECT DISTINCT {_SESSION} AS session_group, CASE WHEN NOT coalesce(context_truncated, false) THEN {_TASK} END AS task_key FROM commands_normalized)"


@query(f"WITH RECURSIVE {_OBSERVED}, e AS (SELECT DISTINCT a.session_group AS a, b.session_group AS b FROM o a JOIN o b ON a.task_key = b.task_key), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT o.session_group, coalesce(least(min(r.b), o.session_group), o.session_group) AS partition_group FROM (SELECT DISTINCT session_group FROM o) o LEFT JOIN r ON r.a = o.session_group GROUP BY o.session_group")
def grf_01_components(spark, d):
    """Sessions tied by parents or by the same request, with the smallest of their component."""
    return freeze.groups(cut(freeze.observations(table(spark, d, "commands_normalized")).select("session_group", "task_key", "_parents", "source_kind")))


@query()
def grf_02_partitions(spark, d):
    """Observations in frozen partitions: whole groups, shares close to the targets; checked by tests of its invariants."""
    out = freeze.freeze(table(spark, d, "commands_normalized"))
    return out.select("id", "record_id", "session_group", "partition_group", "partition")


@query()
def agg_33_freeze_counts(spark, d):
    """Counts of the frozen partitions: rows, groups and largest group per partition."""
    out = freeze.freeze(table(spark, d, "commands_normalized"))
    sizes = out.groupBy("partition", "partition_group").agg(F.count("*").alias("n"))
    return sizes.groupBy("partition").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.max("n").alias("largest_group"))


@query("SELECT kind, value, count(*) AS n FROM (SELECT 'source' AS kind, source_kind AS value FROM frozen_rows UNION ALL SELECT 'review', unnest(review_reasons) FROM frozen_rows UNION ALL SELECT 'execution', labels.execution FROM frozen_rows UNION ALL SELECT 'read_contract', read_contract_candidate.op FROM frozen_rows WHERE read_contract_candidate IS NOT NULL) GROUP BY ALL")
def agg_33_counters(spark, d):
    """Sources, tags, outcomes and contracts of the frozen rows, counted in one pass over tagged values."""
    tag = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    rows = table(spark, d, "frozen_rows")
    fixed = F.array(tag("source", F.col("source_kind")), tag("execution", F.col("labels.execution")))
    reasons = F.transform(F.coalesce("review_reasons", F.array().cast("array<string>")), lambda r: tag("review", r))
    contract = F.when(F.col("read_contract_candidate").isNotNull(), F.array(tag("read_contract", F.col("read_contract_candidate.op")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    return rows.select(F.explode(F.concat(fixed, reasons, contract)).alias("t")).groupBy("t.kind", "t.value").agg(F.count("*").alias("n"))


_REVIEW = f"SELECT {_ACTION} AS action, source_kind, labels.execution AS execution, labels.output_error_keyword AS error_keyword, read_contract_candidate IS NOT NULL AS read_candidate, command_sha256, id, record_id FROM frozen_rows"


@query(f"SELECT action, source_kind, execution, error_keyword, read_candidate, count(*) AS record_count, count(DISTINCT command_sha256) AS unique_commands FROM ({_REVIEW}) GROUP BY ALL")
def agg_34_review_queue(spark, d):
    return freeze.queue(table(spark, d, "frozen_rows"))


@query(f"SELECT action, source_kind, execution, error_keyword, read_candidate, id, record_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY action, source_kind, execution, error_keyword, read_candidate ORDER BY id, record_id) AS rank FROM (SELECT action, source_kind, execution, error_keyword, read_candidate, command_sha256, min((id, record_id))[1] AS id, min((id, record_id))[2] AS record_id FROM ({_REVIEW}) GROUP BY ALL)) WHERE rank <= 3")
def win_05_review_samples(spark, d):
    """The first three observations with distinct commands of each review group."""
    return freeze.queue_samples(table(spark, d, "frozen_rows"))


@query("SELECT id, record_id FROM frozen_rows WHERE lower(trim(partition)) = 'train'")
def chk_02_train_only(spark, d):
    """The training rows behind a check that raises on a row of another partition."""
    rows = table(spark, d, "frozen_rows").select("id", "record_id", F.lower(F.trim("partition")).alias("partition")).where("partition = 'train'")
    return freeze.only_partition(rows, "train").select("id", "record_id")


@query(f"SELECT id, count(*) AS copies, count(DISTINCT record_id) AS records FROM (SELECT id, record_id FROM frozen_rows UNION ALL SELECT id, record_id FROM (SELECT sha256('[\"' || record_id || '\", \"' || command_sha256 || '\", \"' || output_sha256 || '\"]') AS id, record_id FROM commands_normalized)) GROUP BY id HAVING count(*) > 1")
def set_06_repeated_ids(spark, d):
    """Ids that occur more than once when two corpora are put together."""
    a = table(spark, d, "frozen_rows").select("id", "record_id")
    c = table(spark, d, "commands_normalized").select(values.digest(F.col("record_id"), F.col("command_sha256"), F.col("output_sha256")).alias("id"), "record_id")
    return a.unionByName(c).groupBy("id").agg(F.count("*").alias("copies"), F.countDistinct("record_id").alias("records")).where("copies > 1")


@query(f"SELECT command, min(origin) AS origin, count(DISTINCT session) AS sessions, count(*) AS n FROM (SELECT coalesce(command_text, command_argv[-1]) AS command, 'normalised' AS origin, session FROM commands_normalized UNION ALL SELECT cmd, 'recorded', session FROM records WHERE cmd IS NOT NULL) GROUP BY command")
def set_07_merged_candidates(spark, d):
    """Commands of two tables merged by their text."""
    a = table(spark, d, "commands_normalized").select(F.coalesce("command_text", F.try_element_at("command_argv", F.lit(-1))).alias("command"), F.lit("normalised").alias("origin"), "session")
    b = table(spark, d, "records").where("cmd is not null").select(F.col("cmd").alias("command"), F.lit("recorded").alias("origin"), "session")
    return a.unionByName(b).groupBy("command").agg(F.min("origin").alias("origin"), F.countDistinct("session").alias("sessions"), F.count("*").alias("n"))


@query("SELECT labels.execution AS execution, count(*) AS n, count(*) FILTER (WHERE labels.output_error_keyword) AS with_error_word, count(*) FILTER (WHERE labels.output_error_keyword) / CAST(count(*) AS DOUBLE) AS share, round(count(*) FILTER (WHERE labels.output_error_keyword) / CAST(count(*) AS DOUBLE), 4) AS rounded FROM frozen_rows GROUP BY ALL")
def fn_32_rounded_shares(spark, d):
    """Shares unrounded and rounded to four digits."""
    out = table(spark, d, "frozen_rows").groupBy(F.col("labels.execution").alias("execution")).agg(F.count("*").alias("n"), F.count_if("labels.output_error_keyword").alias("with_error_word"))
    return out.withColumn("share", ratio(F.col("with_error_word"), F.col("n"))).withColumn("rounded", F.round("share", 4))
