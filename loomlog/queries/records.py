"""Queries over the command records: classifiers, rates, rankings, samples and recovery.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import classify, rules
from loomlog.operators import cells, metrics, sessions
from loomlog.queries.oracle import annotated, q
from loomlog.queries.registry import query
from loomlog.util import spread, table

COUNTS = "count(*) AS n, count(*) FILTER (WHERE ok = false) AS fail, count(*) FILTER (WHERE hidden) AS hidden"
RATES = "CAST(fail AS DOUBLE) / CAST(nullif(n, 0) AS DOUBLE) AS fail_rate, CAST(hidden AS DOUBLE) / CAST(nullif(n, 0) AS DOUBLE) AS hidden_rate"
#: columns that the classifiers read, so that a scan reads no others
NEEDED = ["source", "model", "session", "ts", "tool", "shell_param", "cmd", "ok", "out", "err", "ordinal"]


def notes(spark: SparkSession, d: str, *names: str, more: tuple = ()) -> DataFrame:
    """The records with the named annotations."""
    rows = table(spark, d, "records").select(*NEEDED, *more)
    # regular expressions are the work here, so a small scan is dealt to all cores; a large one stays as it is
    return classify.annotate(spread(rows, 1) if names else rows, *names)


def rate_sql(*keys: str, needs: tuple = (), where: str = "true", having: int = 0) -> str:
    by = ", ".join(keys)
    return annotated(*keys_needed(keys), "hidden", *needs) + f"SELECT *, {RATES} FROM (SELECT {by}, {COUNTS} FROM a WHERE {where} GROUP BY {by} HAVING count(*) >= {having})"


def keys_needed(keys: tuple) -> list[str]:
    return [k for k in keys if k not in ("source", "model")]


def top_sql(value: str, k: int, group: str = "", where: str = "true", first: str = "ordinal") -> str:
    """The k most frequent values (per group), equals by first occurrence."""
    by = f"{group}, " if group else ""
    over = f"PARTITION BY {group} " if group else ""
    return f"SELECT {by}{value}, n{', rank' if group else ''} FROM (SELECT *, row_number() OVER ({over}ORDER BY n DESC, f, {value}) AS rank FROM (SELECT {by}{value}, count(*) AS n, min({first}) AS f FROM a WHERE {where} GROUP BY {by}{value})) WHERE rank <= {k}"


# ---- FN: classifiers, one row per record or per distinct input


@query(annotated("family") + "SELECT source, model, family, count(*) AS n FROM a GROUP BY ALL")
def fn_01_family(spark, d):
    """Family of every model id."""
    return notes(spark, d, "family").groupBy("source", "model", "family").agg(F.count("*").alias("n"))


# The families that the census and the report tell apart.
CENSUS = ["GPT-6 Astra", "GPT-5.6 Sol", "GPT-5.6 Luna", "GPT-5.6 Terra", "Claude Fable 5.1", "Claude Fable 5", "Claude Opus 5", "Claude Sonnet 5", "Claude Opus 4.x", "Claude Haiku 4.5", "Grok 4.x", "Muse Spark", "DeepSeek V4", "GLM 5.3", "Kimi K3", "HY3", "x-preview-f"]
_CENSUS_SQL = "CASE " + " ".join(f"WHEN contains(lower(coalesce(model, '')), {q(parts[0])}) THEN {q(name)}" for parts, _, name in rules.FAMILIES if name in CENSUS)


@query(f"SELECT model, {_CENSUS_SQL} ELSE 'other' END AS census_family, {_CENSUS_SQL} ELSE 'Other models' END AS report_family, count(*) AS n FROM records GROUP BY ALL")
def fn_01b_family_profiles(spark, d):
    """Family of every model id by the reduced rules of the census and of the report."""
    m = F.col("model")
    return table(spark, d, "records").groupBy("model").agg(F.count("*").alias("n")).select("model", "n", classify.census_family(m, CENSUS, "other").alias("census_family"), classify.census_family(m, CENSUS, "Other models").alias("report_family"))


@query(annotated("vendor") + "SELECT family, vendor, count(*) AS n FROM a GROUP BY ALL")
def fn_02_vendor(spark, d):
    return notes(spark, d, "vendor").groupBy("family", "vendor").agg(F.count("*").alias("n"))


@query(annotated("host") + "SELECT source, tool, shell_param, host, count(*) AS n FROM a GROUP BY ALL")
def fn_03_host_shell(spark, d):
    return notes(spark, d, "host").groupBy("source", "tool", "shell_param", "host").agg(F.count("*").alias("n"))


@query(annotated("dialect") + "SELECT ordinal, dialect FROM a")
def fn_04_dialect(spark, d):
    return notes(spark, d, "dialect").select("ordinal", "dialect")


@query(annotated("interp") + "SELECT ordinal, list_aggregate(interp, 'string_agg', '|') AS interp FROM a WHERE len(interp) > 0")
def fn_05_interpreters(spark, d):
    """All embedded interpreters of a command in the order of the rules."""
    return notes(spark, d, "interp").where(F.size("interp") > 0).select("ordinal", F.array_join("interp", "|").alias("interp"))


@query(annotated("cats", "cat") + "SELECT ordinal, coalesce(list_aggregate(cats, 'string_agg', '|'), '') AS cats, cat FROM a")
def fn_06_categories(spark, d):
    """The distinct categories of a command's segments and its main one; without any segment none and that of the whole command."""
    return notes(spark, d, "cats", "cat").select("ordinal", F.array_join("cats", "|").alias("cats"), "cat")


@query(annotated("bucket", "cx_pipes") + "SELECT ordinal, CAST(cx_segs AS INT) AS segs, CAST(cx_pipes AS INT) AS pipes, CAST(cx_len AS INT) AS len, CAST(cx_lines AS INT) AS lines, bucket FROM a")
def fn_07_complexity(spark, d):
    return notes(spark, d, "cx").select("ordinal", "cx.*")


@query(annotated("cause", "cause_detail") + "SELECT ordinal, cause, cause_detail FROM a WHERE cause IS NOT NULL")
def fn_08_failure_cause(spark, d):
    return notes(spark, d, "cause", "cause_detail").where("cause is not null").select("ordinal", "cause", "cause_detail")


@query(annotated("hidden") + "SELECT ordinal FROM a WHERE hidden")
def fn_09_hidden_failure(spark, d):
    return notes(spark, d, "hidden").where("hidden").select("ordinal")


@query(annotated("mismatch") + "SELECT ordinal, dialect, host FROM a WHERE mismatch")
def fn_10_mismatch(spark, d):
    return notes(spark, d, "mismatch").where("mismatch").select("ordinal", "dialect", "host")


@query(annotated("purpose") + "SELECT ordinal, list_aggregate(purpose, 'string_agg', '|') AS purpose FROM a WHERE len(purpose) > 0")
def fn_11_purpose(spark, d):
    return notes(spark, d, "purpose").where(F.size("purpose") > 0).select("ordinal", F.array_join("purpose", "|").alias("purpose"))


@query(annotated("sort_ms", "day") + "SELECT ordinal, sort_ms, iso, day FROM a")
def fn_22_instants(spark, d):
    """Sort key, ISO text and day of epoch milliseconds and ISO timestamps; other formats have none and sort first (WIN-2)."""
    return notes(spark, d, "sort_ms", "day").select("ordinal", "sort_ms", "iso", "day")


@query("SELECT ordinal, list_aggregate(regexp_extract_all(js, 'tools\\.([A-Za-z_]\\w*)\\s*\\(', 1), 'string_agg', '|') AS tools, len(regexp_extract_all(js, 'tools\\.([A-Za-z_]\\w*)\\s*\\(', 1)) AS n FROM records WHERE js IS NOT NULL")
def fn_12_cell_tools(spark, d):
    """The tools that each JS cell calls, in order."""
    return cells.calls(table(spark, d, "records").where("js is not null").select("ordinal", "js"), "js").select("ordinal", F.array_join("calls.name", "|").alias("tools"), F.size("calls").cast("long").alias("n"))


@query("SELECT ordinal, CAST(0 AS INT) AS idx_in_cell, CAST(1 AS INT) AS n_in_cell, regexp_extract(js, 'cmd: \"([^\"]*)\"', 1) AS cmd, false AS dynamic FROM records WHERE js IS NOT NULL AND contains(js, 'exec_command')")
def fn_14_cell_commands(spark, d):
    """One row per shell command inside a JS cell, with its place and number in the cell (FN-13, FN-14, WIN-4)."""
    return cells.shell_commands(table(spark, d, "records").where("js is not null").select("ordinal", "js"), "js").select("ordinal", "idx_in_cell", "n_in_cell", "cmd", "dynamic")


# ---- PRJ


@query("SELECT ordinal, left(coalesce(out, ''), 700) AS out, left(coalesce(js, ''), 1200) AS js, left(coalesce(nullif(cmd, ''), js, ''), 380) AS example_cmd, left(coalesce(nullif(out, ''), err, ''), 260) AS example_out FROM records")
def prj_01_heads(spark, d):
    """Capped texts: output, JS snippet, and the command and output of an example (PRJ-1, PRJ-2, PRJ-24)."""
    cut = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n))
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return table(spark, d, "records").select("ordinal", cut(F.col("out"), 700).alias("out"), cut(F.col("js"), 1200).alias("js"), cut(F.coalesce(full("cmd"), "js"), 380).alias("example_cmd"), cut(F.coalesce(full("out"), "err"), 260).alias("example_out"))


@query(r"""SELECT ordinal, CASE WHEN unmatched THEN NULL WHEN source = 'codex' THEN coalesce("exit" = 0, true) WHEN source = 'claude-code' THEN coalesce("exit", 0) = 0 AND NOT coalesce(interrupted, false)
WHEN source = 'opencode' THEN coalesce("exit", 0) = 0 AND err IS NULL WHEN "exit" IS NOT NULL THEN "exit" = 0 END AS derived_ok FROM records""")
def prj_10_ok_by_source(spark, d):
    """The outcome as each source derives it from exit code, error and interruption."""
    code, ok = F.col("exit"), lambda c: F.coalesce(c, F.lit(0)) == 0
    derived = (
        F.when(F.col("unmatched"), F.lit(None).cast("boolean")).when(F.col("source") == "codex", F.coalesce(code == 0, F.lit(True))).when(F.col("source") == "claude-code", ok(code) & ~F.coalesce("interrupted", F.lit(False)))
        .when(F.col("source") == "opencode", ok(code) & F.col("err").isNull()).when(code.isNotNull(), code == 0)
    )
    return table(spark, d, "records").select("ordinal", derived.alias("derived_ok"))


@query(annotated("hidden") + """SELECT ordinal FROM a WHERE "exit" = 0 AND NOT hidden AND NOT coalesce(dynamic, false) AND NOT coalesce(unmatched, false)""")
def prj_15_minable(spark, d):
    """Commands that succeeded by all signs and whose text is literal."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return notes(spark, d, "hidden", more=("exit", "dynamic", "unmatched")).where((F.col("exit") == 0) & ~F.col("hidden") & no("dynamic") & no("unmatched")).select("ordinal")


# Label and tool of each source in the report.
SOURCES = {"codex": ("Codex (desktop + CLI)", "~/.codex/sessions/**/*.jsonl"), "claude-code": ("Claude Code", "~/.claude/projects/**/*.jsonl"), "opencode": ("OpenCode (v1 + v2 DB)", "~/.local/share/opencode/opencode.db"), "cursor": ("Cursor CLI", "~/.cursor/chats/*/*/store.db")}
_SOURCES_SQL = "(VALUES " + ", ".join(f"({q(k)}, {q(a)}, {q(b)})" for k, (a, b) in SOURCES.items()) + ") s(source, label, path)"


@query(f"SELECT source, label, path, count(*) AS n FROM records LEFT JOIN {_SOURCES_SQL} USING (source) GROUP BY ALL")
def prj_25_source_labels(spark, d):
    dim = spark.createDataFrame([(k, *v) for k, v in SOURCES.items()], "source string, label string, path string")
    return table(spark, d, "records").groupBy("source").agg(F.count("*").alias("n")).join(F.broadcast(dim), "source", "left")  # a literal of four rows


# ---- AGG


@query(annotated("iso") + """SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE 'source' END AS scope, source, count(*) AS n, count(DISTINCT source || chr(1) || session) AS sessions, min(iso) AS first_iso, max(iso) AS last_iso
FROM a GROUP BY GROUPING SETS ((), (source))""")
def agg_01_totals(spark, d):
    """Records, sessions and first and last instant over all and per source."""
    who = F.concat("source", F.lit("\x01"), "session")
    return notes(spark, d, "iso").groupingSets([[], ["source"]], "source").agg(
        F.when(F.grouping("source") == 1, "all").otherwise("source").alias("scope"), F.count("*").alias("n"), F.countDistinct(who).alias("sessions"), F.min("iso").alias("first_iso"), F.max("iso").alias("last_iso")
    )


def _counts_sql() -> str:
    return """counts AS (SELECT source, model, tool, count(*) AS n FROM (SELECT source, model, unnest(CASE WHEN coalesce(via_js_cell, false) THEN list_concat([CASE WHEN source = 'codex' THEN 'exec' ELSE 'execute' END], list_transform(coalesce(js_tools, []), lambda t: 'jscell:' || t))
WHEN source = 'codex' THEN ['fn:' || tool] ELSE [tool] END) AS tool FROM records WHERE NOT coalesce(via_js_cell, false) OR coalesce(idx_in_cell, 0) = 0) GROUP BY ALL)"""


@query(f"WITH {_counts_sql()} SELECT * FROM counts")
def agg_41_tool_counts(spark, d):
    return metrics.tool_counts(table(spark, d, "records"))


def _share_sql() -> str:
    some = lambda names: "tool IN (" + ", ".join(map(q, names)) + ")"
    part = lambda c, name: f"CAST(sum(CASE WHEN {c} THEN n ELSE 0 END) AS BIGINT) AS {name}"
    parts = [part(some([*metrics.SHELL_TOOLS, "execute"]), "shell"), part("starts_with(tool, 'jscell:') OR tool = 'execute'", "js_cell_calls"), part(some(metrics.READ_TOOLS), "dedicated_read_search"), part(some(metrics.EDIT_TOOLS), "dedicated_edit")]
    head = annotated("family", table="counts").replace("WITH ", f"WITH {_counts_sql()}, ", 1)
    return head + f"SELECT *, CAST(shell AS DOUBLE) / total AS shell_share FROM (SELECT source, family, CAST(sum(n) AS BIGINT) AS total, {', '.join(parts)} FROM a WHERE NOT (source = 'codex' AND tool = 'exec') GROUP BY ALL)"


@query(_share_sql())
def agg_02_tool_share(spark, d):
    counts = metrics.tool_counts(table(spark, d, "records"))
    return metrics.tool_share(classify.annotate(counts, "family"))


@query(annotated("family", table="counts").replace("WITH ", f"WITH {_counts_sql()}, ", 1) + """SELECT source, family, tool, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, family ORDER BY n DESC, tool) AS rank FROM
(SELECT source, family, tool, CAST(sum(n) AS BIGINT) AS n FROM a WHERE NOT (source = 'codex' AND tool = 'exec') GROUP BY ALL)) WHERE rank <= 12""")
def agg_02_top_tools(spark, d):
    """The twelve most used tools per source and family."""
    counts = classify.annotate(metrics.tool_counts(table(spark, d, "records")), "family").where(~((F.col("source") == "codex") & (F.col("tool") == "exec")))
    return metrics.top_per_group(counts.groupBy("source", "family", "tool").agg(F.sum("n").alias("n")), ["source", "family"], 12, F.desc("n"), F.asc("tool"))


@query(annotated("family", "interp", "cx_len", "cx_segs", "mismatch", "hidden") + f"""SELECT source, family, {COUNTS}, count(*) FILTER (WHERE len(interp) > 0) / CAST(count(*) AS DOUBLE) AS interp_share, count(*) FILTER (WHERE via_js_cell) / CAST(count(*) AS DOUBLE) AS js_cell_share,
coalesce(CAST(median(CASE WHEN cx_len > 0 THEN cx_len END) AS DOUBLE), 0) AS median_len, coalesce(avg(CASE WHEN cx_segs > 0 THEN cx_segs END), 0) AS mean_segs, count(*) FILTER (WHERE mismatch) / CAST(count(*) AS DOUBLE) AS mismatch_rate,
count(*) FILTER (WHERE exit_visible) / CAST(nullif(count(exit_visible), 0) AS DOUBLE) AS exit_visible_rate, count(DISTINCT session) AS sessions FROM a GROUP BY source, family""")
def agg_03_family_stats(spark, d):
    return metrics.family_stats(notes(spark, d, "family", "interp", "cx", "mismatch", "hidden", more=("via_js_cell", "exit_visible")))


NESTED = ("dialect", "bucket", "cat")


@query(annotated("family", *NESTED, "hidden") + f"SELECT *, {RATES} FROM (SELECT source, family, CASE WHEN grouping(dialect) = 0 THEN 'dialect' WHEN grouping(bucket) = 0 THEN 'bucket' ELSE 'cat' END AS kind, coalesce(dialect, bucket, cat) AS value, {COUNTS} FROM a GROUP BY GROUPING SETS ((source, family, dialect), (source, family, bucket), (source, family, cat)))")
def agg_03_family_nested(spark, d):
    """Rates per family within each dialect, size bucket and category, by one pass of GROUPING SETS."""
    rows = notes(spark, d, "family", "dialect", "cx", "cat", "hidden").withColumn("bucket", F.col("cx.bucket"))
    sets = metrics.rate_sets(rows, *[("source", "family", k) for k in NESTED])
    return sets.select("source", "family", F.element_at(F.split("key_set", r"\+"), -1).alias("kind"), F.coalesce(*NESTED).alias("value"), "n", "fail", "hidden", "fail_rate", "hidden_rate")


@query(annotated("family", "cause") + top_sql("cause", 8, "source, family", "cause IS NOT NULL"))
def agg_03_top_causes(spark, d):
    return metrics.most_common(notes(spark, d, "family", "cause").where("cause is not null"), "cause", 8, ["source", "family"])


_SETS = [("dialect",), ("host",), ("dialect", "host"), ("cat",), ("bucket",), ("family",), ("family", "cat"), ("day", "source")]


@query(annotated("dialect", "host", "cat", "bucket", "family", "day", "hidden") + f"SELECT *, {RATES} FROM (SELECT dialect, host, cat, bucket, family, day, source, CASE grouping(dialect, host, cat, bucket, family, day, source) "
       + " ".join(f"WHEN {sum(1 << (6 - i) for i, k in enumerate(('dialect', 'host', 'cat', 'bucket', 'family', 'day', 'source')) if k not in s)} THEN {q('+'.join(s))}" for s in _SETS) + f" END AS key_set, {COUNTS} FROM a GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in _SETS)}))")
def agg_04_rate_sets(spark, d):
    """The rates by dialect, host, category, bucket, family and day in one pass (AGG-4, 5, 9, 12, 14, 15)."""
    rows = notes(spark, d, "dialect", "host", "cat", "cx", "family", "day", "hidden").withColumn("bucket", F.col("cx.bucket"))
    return metrics.rate_sets(rows, *_SETS)


@query(rate_sql("dialect", "host", having=30))
def agg_05_dialect_host(spark, d):
    """The failure rates of each dialect on each host with at least 30 commands."""
    return metrics.rate_by(notes(spark, d, "dialect", "host", "hidden"), "dialect", "host", having=30)


@query(rate_sql("interp0", where="interp0 IS NOT NULL"))
def agg_06_interpreter(spark, d):
    return metrics.rate_by(notes(spark, d, "interp0", "hidden").where("interp0 is not null"), "interp0")


@query(rate_sql("family", "interp0", where="interp0 IS NOT NULL", having=10))
def agg_07_interpreter_family(spark, d):
    return metrics.rate_by(notes(spark, d, "family", "interp0", "hidden").where("interp0 is not null"), "family", "interp0", having=10)


@query(annotated("interp", "hidden") + f"SELECT *, {RATES} FROM (SELECT {COUNTS} FROM a WHERE len(interp) = 0 AND cmd <> '')")
def agg_08_no_interpreter(spark, d):
    return metrics.rate_by(notes(spark, d, "interp", "hidden").where((F.size("interp") == 0) & (F.col("cmd") != "")))


@query(rate_sql("cat"))
def agg_09_category(spark, d):
    return metrics.rate_by(notes(spark, d, "cat", "hidden"), "cat")


@query(rate_sql("bucket"))
def agg_09_bucket(spark, d):
    return metrics.rate_by(notes(spark, d, "cx", "hidden").withColumn("bucket", F.col("cx.bucket")), "bucket")


@query(annotated("cause") + "SELECT cause, count(*) AS n FROM a WHERE cause IS NOT NULL GROUP BY cause")
def agg_10_causes(spark, d):
    return notes(spark, d, "cause").where("cause is not null").groupBy("cause").agg(F.count("*").alias("n"))


@query(annotated("cause_detail") + top_sql("cause_detail", 40, where="cause_detail IS NOT NULL"))
def agg_10_cause_details(spark, d):
    """The forty most frequent missing programs (TOP-1)."""
    return metrics.most_common(notes(spark, d, "cause_detail").where("cause_detail is not null"), "cause_detail", 40)


@query(annotated("family", "cause") + "SELECT family, cause, count(*) AS n FROM a WHERE cause IS NOT NULL GROUP BY ALL")
def agg_11_cause_family(spark, d):
    return notes(spark, d, "family", "cause").where("cause is not null").groupBy("family", "cause").agg(F.count("*").alias("n"))


@query(rate_sql("family"))
def agg_12_hidden_by_family(spark, d):
    return metrics.rate_by(notes(spark, d, "family", "hidden"), "family")


@query(rate_sql("mismatch", where="mismatch OR cmd <> ''"))
def agg_13_mismatch(spark, d):
    """Rates of commands written for another shell, and of the others that have a command."""
    return metrics.rate_by(notes(spark, d, "mismatch", "hidden").where(F.col("mismatch") | (F.col("cmd") != "")), "mismatch")


@query(rate_sql("family", "cat"))
def agg_14_category_family(spark, d):
    return metrics.rate_by(notes(spark, d, "family", "cat", "hidden"), "family", "cat")


@query(rate_sql("day", "source", where="day IS NOT NULL"))
def agg_15_daily(spark, d):
    return metrics.rate_by(notes(spark, d, "day", "hidden").where("day is not null"), "day", "source")


@query(annotated("day") + "SELECT day, " + ", ".join(f"count(*) FILTER (WHERE source = {q(s)}) AS {q(s)[1:-1].replace('-', '_')}" for s in SOURCES) + " FROM a WHERE day IS NOT NULL GROUP BY day")
def agg_15_daily_pivot(spark, d):
    """Commands per day with a column per source."""
    days = notes(spark, d, "day").where("day is not null").groupBy("day").pivot("source", list(SOURCES)).count().na.fill(0)
    return days.select("day", *[F.col(f"`{s}`").alias(s.replace("-", "_")) for s in SOURCES])


@query("SELECT count(*) FILTER (WHERE out_len > 10000) AS n_over_10k, count(*) FILTER (WHERE out_len > 30000) AS n_over_30k, count(*) FILTER (WHERE out_len > 0) AS measured FROM records")
def agg_16_output_blowups(spark, d):
    size = F.col("out_len")
    return table(spark, d, "records").agg(F.count_if(size > 10_000).alias("n_over_10k"), F.count_if(size > 30_000).alias("n_over_30k"), F.count_if(size > 0).alias("measured"))


@query(annotated("host") + r"""SELECT count(*) FILTER (WHERE host IN ('git-bash', 'bash') AND regexp_matches(cmd, '2>\s*nul\b')) AS nul_redirect_in_bash, count(*) FILTER (WHERE host IN ('powershell', 'powershell5', 'pwsh7', 'cmd.exe') AND contains(cmd, '/dev/null')) AS dev_null_in_powershell,
count(*) FILTER (WHERE host = 'powershell5' AND contains(cmd, '&&')) AS and_and_on_ps5, count(*) FILTER (WHERE host IN ('powershell', 'powershell5', 'pwsh7') AND regexp_matches(cmd, '\|\s*head\b')) AS head_in_ps,
count(*) FILTER (WHERE host IN ('powershell', 'powershell5', 'pwsh7', 'cmd.exe') AND regexp_matches(cmd, '(^|[;&|]\s*)cat\s')) AS cat_in_ps, count(*) FILTER (WHERE dynamic) AS dynamic_cmd_in_js,
count(*) FILTER (WHERE source = 'codex' AND NOT ends_with(tool, '(js-only)') AND NOT coalesce(exit_visible, false)) AS r_output_only_hides_exit, count(*) FILTER (WHERE backgrounded) AS backgrounded_yield, count(*) FILTER (WHERE n_in_cell >= 2 AND idx_in_cell = 0) AS multi_cmd_cells FROM a""")
def agg_17_oddities(spark, d):
    return metrics.oddities(notes(spark, d, "host", more=("dynamic", "exit_visible", "backgrounded", "n_in_cell", "idx_in_cell")))


@query(annotated("family", "interp0", "cx_len") + "SELECT family, interp0, count(*) AS n, count(*) FILTER (WHERE ok = false) / CAST(count(*) AS DOUBLE) AS fail_rate, CAST(median(cx_len) AS DOUBLE) AS median_len FROM a WHERE interp0 IS NOT NULL GROUP BY ALL HAVING count(*) >= 8")
def agg_18_interpreter_stats(spark, d):
    rows = notes(spark, d, "family", "interp0", "cx").where("interp0 is not null")
    stats = rows.groupBy("family", "interp0").agg(F.count("*").alias("n"), metrics.ratio(F.count_if(F.col("ok") == F.lit(False)), F.count("*")).alias("fail_rate"), F.median("cx.len").alias("median_len"))
    return stats.where("n >= 8")


@query(annotated("family", "interp0", "purpose") + "SELECT family, interp0, purpose, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY family, interp0 ORDER BY n DESC, f, purpose) AS rank FROM (SELECT family, interp0, purpose, count(*) AS n, min(ordinal) AS f FROM (SELECT family, interp0, unnest(purpose) AS purpose, ordinal, count(*) OVER (PARTITION BY family, interp0) AS m FROM a WHERE interp0 IS NOT NULL) WHERE m >= 8 GROUP BY ALL)) WHERE rank <= 8")
def agg_18_interpreter_purposes(spark, d):
    """The eight most frequent purposes per family and interpreter with at least eight commands."""
    rows = notes(spark, d, "family", "interp0", "purpose").where("interp0 is not null")
    enough = rows.groupBy("family", "interp0").agg(F.count("*").alias("m")).where("m >= 8")
    counts = rows.select("family", "interp0", F.explode("purpose").alias("purpose"), "ordinal").groupBy("family", "interp0", "purpose").agg(F.count("*").alias("n"), F.min("ordinal").alias("f"))
    return metrics.top_per_group(counts.join(enough, ["family", "interp0"], "left_semi"), ["family", "interp0"], 8, F.desc("n"), F.asc("f"), F.asc("purpose")).drop("f")


@query(annotated("purpose") + "SELECT purpose, count(*) AS n FROM (SELECT unnest(purpose) AS purpose FROM a) GROUP BY ALL")
def agg_19_purposes(spark, d):
    return notes(spark, d, "purpose").select(F.explode("purpose").alias("purpose")).groupBy("purpose").agg(F.count("*").alias("n"))


@query(annotated("family", "interp") + """SELECT family, count(*) AS n, count(*) FILTER (WHERE len(interp) > 0) AS with_interp, count(*) FILTER (WHERE len(interp) > 0) / CAST(count(*) AS DOUBLE) AS share,
count(*) FILTER (WHERE len(interp) > 0 AND ok = false) / CAST(nullif(count(*) FILTER (WHERE len(interp) > 0), 0) AS DOUBLE) AS fail_with, count(*) FILTER (WHERE len(interp) = 0 AND cmd <> '' AND ok = false) / CAST(nullif(count(*) FILTER (WHERE len(interp) = 0 AND cmd <> ''), 0) AS DOUBLE) AS fail_without FROM a GROUP BY family""")
def agg_20_interpreter_by_family(spark, d):
    rows = notes(spark, d, "family", "interp")
    on, bad = F.size("interp") > 0, F.col("ok") == F.lit(False)
    off = ~on & (F.col("cmd") != "")
    n = F.count("*")
    return rows.groupBy("family").agg(
        n.alias("n"), F.count_if(on).alias("with_interp"), metrics.ratio(F.count_if(on), n).alias("share"), metrics.ratio(F.count_if(on & bad), F.count_if(on)).alias("fail_with"), metrics.ratio(F.count_if(off & bad), F.count_if(off)).alias("fail_without")
    )


# ---- WIN: recovery

_RECOVERY = annotated("family", "sort_ms", "dialect", "interp0", "cause") + r""", l AS (SELECT *, lead(ordinal) OVER w AS n_ordinal, lead(cmd) OVER w AS n_cmd, lead(dialect) OVER w AS n_dialect, lead(tool) OVER w AS n_tool, lead(interp0) OVER w AS n_interp, lead(ok) OVER w AS n_ok FROM a WINDOW w AS (PARTITION BY source, session ORDER BY sort_ms, ordinal)),
r AS (SELECT source, session, ordinal, sort_ms, family, cause, CASE WHEN coalesce(n_cmd, '') = '' THEN 'abandon/other-tool' WHEN regexp_replace(n_cmd, '^\s+|\s+$', '', 'g') = regexp_replace(cmd, '^\s+|\s+$', '', 'g') THEN 'identical retry' WHEN n_dialect <> dialect THEN 'switched dialect ' || dialect || '->' || n_dialect
WHEN n_tool IS DISTINCT FROM tool THEN 'switched tool ' || coalesce(tool, 'none') || '->' || coalesce(n_tool, 'none') WHEN coalesce(n_interp, 'none') <> coalesce(interp0, 'none') THEN 'switched interpreter ' || coalesce(interp0, 'none') || '->' || coalesce(n_interp, 'none') ELSE 'rewrote same dialect' END AS kind,
CASE WHEN coalesce(n_cmd, '') = '' THEN NULL WHEN n_ok THEN 'then ok' ELSE 'still failing' END AS outcome, cmd, n_cmd FROM l WHERE ok = false AND cmd <> '') """


def _recovery(spark: SparkSession, d: str) -> DataFrame:
    return sessions.recovery(notes(spark, d, "family", "sort_ms", "dialect", "interp0", "cause"))


@query(_RECOVERY + "SELECT ordinal, cause, kind, outcome FROM r")
def win_01_recovery(spark, d):
    """What follows each failed command of a session (WIN-1, 1a, 1b, 2, JOIN-16)."""
    return _recovery(spark, d).select("ordinal", "cause", "kind", "outcome")


@query(_RECOVERY + "SELECT kind, outcome, count(*) AS n FROM r GROUP BY ALL")
def agg_21_recovery(spark, d):
    return _recovery(spark, d).groupBy("kind", "outcome").agg(F.count("*").alias("n"))


@query(_RECOVERY + "SELECT cause, kind, outcome, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY n DESC, kind, outcome NULLS FIRST) AS rank FROM (SELECT cause, kind, outcome, count(*) AS n FROM r GROUP BY ALL)) WHERE rank <= 6")
def agg_21_recovery_by_cause(spark, d):
    """The six most frequent continuations per cause."""
    counts = _recovery(spark, d).groupBy("cause", "kind", "outcome").agg(F.count("*").alias("n"))
    return metrics.top_per_group(counts, ["cause"], 6, F.desc("n"), F.asc("kind"), F.asc_nulls_first("outcome"))


@query(_RECOVERY + "SELECT ordinal, kind, left(cmd, 300) AS first_cmd, left(n_cmd, 300) AS second_cmd, outcome FROM r WHERE kind NOT IN ('identical retry', 'abandon/other-tool') ORDER BY source, session, sort_ms, ordinal LIMIT 60")
def top_06_retry_examples(spark, d):
    """The first sixty changed retries in the order of sources, sessions and time."""
    rows = _recovery(spark, d).where(~F.col("kind").isin("identical retry", "abandon/other-tool")).orderBy("source", "session", "sort_ms", "ordinal").limit(60)
    return rows.select("ordinal", "kind", F.left("cmd", F.lit(300)).alias("first_cmd"), F.left("next_cmd", F.lit(300)).alias("second_cmd"), "outcome")


@query(annotated("sort_ms") + "SELECT ordinal, last_value(model IGNORE NULLS) OVER w AS model_as_of, last_value(cwd IGNORE NULLS) OVER w AS cwd_as_of FROM a WINDOW w AS (PARTITION BY source, session ORDER BY sort_ms, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def win_03_carry_forward(spark, d):
    """Model and working directory as of each command: the last known ones of its session (JOIN-8, WIN-3)."""
    rows = notes(spark, d, "sort_ms", more=("cwd",)).select("source", "session", "sort_ms", "ordinal", "model", "cwd")
    return sessions.carry_forward(rows, ["source", "session"], ["sort_ms", "ordinal"], sessions.time_chunk(F.col("sort_ms"), F.col("ordinal")), {"model_as_of": "model", "cwd_as_of": "cwd"}, strictly_before=False).select("ordinal", "model_as_of", "cwd_as_of")


_TAIL = annotated("family", "vendor", "cat", "cause", "interp0", "purpose", "dialect", "host", "cx_len", "cx_segs", "mismatch", "hidden", "day") + ", k AS (SELECT family AS kf, count(*) AS kn FROM a GROUP BY 1), b AS (SELECT a.*, CASE WHEN kn >= 200 THEN family ELSE 'Other models' END AS fam FROM a JOIN k ON family = kf) "


def _tailed(spark: SparkSession, d: str, *names: str, more: tuple = ()) -> DataFrame:
    return metrics.tail_bucket(notes(spark, d, "family", *names, more=more), "family", 200, "Other models", "fam")


@query(_TAIL + "SELECT fam, count(DISTINCT family) AS families, count(*) AS n FROM b GROUP BY fam")
def win_06_tail_bucket(spark, d):
    """Families with at least 200 commands; the rest is one."""
    return _tailed(spark, d).groupBy("fam").agg(F.countDistinct("family").alias("families"), F.count("*").alias("n"))


@query(_TAIL + "SELECT fam, arg_min(CASE WHEN fam = 'Other models' THEN 'other' ELSE vendor END, ordinal) AS vendor FROM b GROUP BY fam")
def win_07_first_vendor(spark, d):
    """The vendor of the first command of each family."""
    rows = _tailed(spark, d, "vendor").withColumn("vendor", F.when(F.col("fam") == "Other models", "other").otherwise(F.col("vendor")))
    return rows.groupBy("fam").agg(F.min_by("vendor", "ordinal").alias("vendor"))


@query(_TAIL + f"SELECT source, sessions, first_day, last_day, n, fail, hidden, {RATES} FROM (SELECT source, count(DISTINCT session) AS sessions, min(day) AS first_day, max(day) AS last_day, {COUNTS} FROM b GROUP BY source)")
def agg_23_report_sources(spark, d):
    rows = notes(spark, d, "day", "hidden")
    return metrics.with_rates(rows.groupBy("source").agg(F.countDistinct("session").alias("sessions"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), *metrics._counts()))


@query(_TAIL + top_sql("fam", 6, "source").replace("FROM a ", "FROM b "))
def agg_23_top_families(spark, d):
    """The six most frequent families per source."""
    return metrics.most_common(_tailed(spark, d), "fam", 6, ["source"])


@query(_TAIL + """SELECT fam, count(*) AS n, count(DISTINCT session) AS sessions, count(*) FILTER (WHERE ok = false) AS fail, count(*) FILTER (WHERE hidden) AS hidden, count(*) FILTER (WHERE via_js_cell) / CAST(count(*) AS DOUBLE) AS js_cell, count(*) FILTER (WHERE interp0 IS NOT NULL) / CAST(count(*) AS DOUBLE) AS interp_share,
coalesce(CAST(median(CASE WHEN cx_len > 0 THEN cx_len END) AS DOUBLE), 0) AS median_len, coalesce(avg(CASE WHEN cx_segs > 0 THEN cx_segs END), 0) AS mean_segs, count(*) FILTER (WHERE mismatch) / CAST(count(*) AS DOUBLE) AS mismatch, count(*) FILTER (WHERE exit_visible) / CAST(nullif(count(exit_visible), 0) AS DOUBLE) AS exit_visible,
coalesce(count(*) FILTER (WHERE source = 'claude-code' AND instructed) / CAST(nullif(count(*) FILTER (WHERE source = 'claude-code'), 0) AS DOUBLE) >= 0.8, false) AS instructed, count(*) FILTER (WHERE cause IS NOT NULL) AS with_cause FROM b GROUP BY fam""")
def agg_24_report_families(spark, d):
    """The figures of the report per family; instructed if at least four fifths of the commands of the one source were."""
    rows = _tailed(spark, d, "cause", "interp0", "cx", "mismatch", "hidden", more=("via_js_cell", "exit_visible", "instructed"))
    n, claude = F.count("*"), F.col("source") == "claude-code"
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return rows.groupBy("fam").agg(
        n.alias("n"), F.countDistinct("session").alias("sessions"), F.count_if(F.col("ok") == F.lit(False)).alias("fail"), F.count_if("hidden").alias("hidden"), metrics.ratio(F.count_if("via_js_cell"), n).alias("js_cell"),
        metrics.ratio(F.count_if(F.col("interp0").isNotNull()), n).alias("interp_share"), F.coalesce(F.median(positive("cx.len")), F.lit(0.0)).alias("median_len"), F.coalesce(F.avg(positive("cx.segs")), F.lit(0.0)).alias("mean_segs"),
        metrics.ratio(F.count_if("mismatch"), n).alias("mismatch"), metrics.ratio(F.count_if("exit_visible"), F.count("exit_visible")).alias("exit_visible"),
        F.coalesce(metrics.ratio(F.count_if(claude & F.col("instructed")), F.count_if(claude)) >= 0.8, F.lit(False)).alias("instructed"), F.count("cause").alias("with_cause"),
    )


_BUCKET_SQL = "CASE " + " ".join(f"WHEN tool IN ({', '.join(map(q, tools))}) THEN {q(name)}" for name, tools in metrics.TOOL_BUCKETS.items()) + " ELSE 'other' END"
_COLUMNS = {name: name.replace("/", "_").replace(" ", "_") for name in [*metrics.TOOL_BUCKETS, "other"]}


@query(f"WITH {_counts_sql()} SELECT source, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE b = {q(k)}), 0) AS BIGINT) AS {v}" for k, v in _COLUMNS.items()) + f", CAST(sum(n) AS BIGINT) AS total FROM (SELECT *, {_BUCKET_SQL} AS b FROM counts WHERE NOT (source = 'codex' AND tool = 'exec')) GROUP BY source")
def agg_25_tool_share_exclusive(spark, d):
    """Tool calls per source in six buckets of which the first that holds a tool counts."""
    counts = metrics.tool_counts(table(spark, d, "records")).where(~((F.col("source") == "codex") & (F.col("tool") == "exec"))).withColumn("b", metrics.tool_bucket(F.col("tool")))
    wide = counts.groupBy("source").pivot("b", list(_COLUMNS)).sum("n").na.fill(0)
    named = wide.select("source", *[F.col(f"`{k}`").alias(v) for k, v in _COLUMNS.items()])
    return named.withColumn("total", sum((F.col(v) for v in _COLUMNS.values()), F.lit(0)))


@query(_TAIL + f", cs AS (SELECT cat FROM b GROUP BY cat HAVING count(*) >= 100), g AS (SELECT * FROM (SELECT DISTINCT fam FROM b) CROSS JOIN cs) SELECT fam, cat, n, fail, hidden, {RATES} FROM (SELECT g.fam, g.cat, count(b.ordinal) AS n, count(*) FILTER (WHERE ok = false) AS fail, count(*) FILTER (WHERE b.hidden) AS hidden FROM g LEFT JOIN b ON g.fam = b.fam AND g.cat = b.cat GROUP BY ALL)")
def agg_26_category_matrix(spark, d):
    """Families by categories with at least 100 commands."""
    rows = _tailed(spark, d, "cat", "hidden")
    cats = rows.groupBy("cat").agg(F.count("*").alias("n")).where("n >= 100").select("cat")
    return metrics.matrix(rows, "fam", "cat", rows.select("fam").distinct(), cats)


DIALECTS = ["posix", "powershell", "cmd", "neutral", "mixed", "js-only"]


@query(_TAIL + f", hs AS (SELECT host FROM b GROUP BY host HAVING count(*) >= 100), g AS (SELECT * FROM (VALUES {', '.join(f'({q(x)})' for x in DIALECTS)}) v(dialect) CROSS JOIN hs) SELECT dialect, host, n, fail, hidden, {RATES} FROM (SELECT g.dialect, g.host, count(b.ordinal) AS n, count(*) FILTER (WHERE ok = false) AS fail, count(*) FILTER (WHERE b.hidden) AS hidden FROM g LEFT JOIN b ON g.dialect = b.dialect AND g.host = b.host GROUP BY ALL)")
def agg_27_dialect_host_matrix(spark, d):
    """Six dialects by hosts with at least 100 commands, empty cells included."""
    rows = notes(spark, d, "dialect", "host", "hidden")
    hosts = rows.groupBy("host").agg(F.count("*").alias("n")).where("n >= 100").select("host")
    return metrics.matrix(rows, "dialect", "host", spark.createDataFrame([(x,) for x in DIALECTS], "dialect string"), hosts)


@query(_TAIL + f"SELECT interp0, n, fail, hidden, median_len, {RATES} FROM (SELECT interp0, {COUNTS}, CAST(median(cx_len) AS DOUBLE) AS median_len FROM b WHERE interp0 IS NOT NULL GROUP BY interp0) WHERE n >= 40")
def agg_28_interpreter_kinds(spark, d):
    rows = notes(spark, d, "interp0", "cx", "hidden").where("interp0 is not null")
    return metrics.with_rates(rows.groupBy("interp0").agg(*metrics._counts(), F.median("cx.len").alias("median_len")).where("n >= 40"))


@query(_TAIL + top_sql("fam", 4, "interp0", "interp0 IS NOT NULL").replace("FROM a ", "FROM b "))
def agg_28_top_families(spark, d):
    return metrics.most_common(_tailed(spark, d, "interp0").where("interp0 is not null"), "fam", 4, ["interp0"])


@query(_TAIL + top_sql("fam", 5, "cause", "cause IS NOT NULL").replace("FROM a ", "FROM b "))
def agg_29_cause_families(spark, d):
    return metrics.most_common(_tailed(spark, d, "cause").where("cause is not null"), "fam", 5, ["cause"])


@query(_TAIL + top_sql("cause", 6, "fam", "cause IS NOT NULL").replace("FROM a ", "FROM b "))
def agg_29_family_causes(spark, d):
    return metrics.most_common(_tailed(spark, d, "cause").where("cause is not null"), "cause", 6, ["fam"])


@query(_TAIL + "SELECT fam, count(*) FILTER (WHERE exit_visible) AS visible, count(*) FILTER (WHERE NOT exit_visible) AS hidden FROM b GROUP BY fam HAVING count(exit_visible) > 0")
def agg_29_exit_visibility(spark, d):
    rows = _tailed(spark, d, more=("exit_visible",)).groupBy("fam").agg(F.count_if("exit_visible").alias("visible"), F.count_if(~F.col("exit_visible")).alias("hidden"), F.count("exit_visible").alias("_n"))
    return rows.where("_n > 0").drop("_n")


@query(_TAIL + "SELECT fam, count(*) FILTER (WHERE out_len > 0) AS measured, count(*) FILTER (WHERE out_len > 10000) AS over10k FROM b GROUP BY fam")
def agg_30_output_by_family(spark, d):
    return _tailed(spark, d, more=("out_len",)).groupBy("fam").agg(F.count_if(F.col("out_len") > 0).alias("measured"), F.count_if(F.col("out_len") > 10_000).alias("over10k"))


# ---- benchmark scores: runs are derived from the records, a cell being a plan and any other command evidence

_RUNS_SQL = """runs AS (SELECT CASE WHEN coalesce(via_js_cell, false) THEN 'plan' ELSE 'evidence' END AS kind, coalesce(ok, false) AS passed, try_cast(wall AS DOUBLE) * 1000 AS wall_ms, length(cmd) AS eval_count, try_cast(wall AS DOUBLE) AS eval_seconds,
CASE WHEN out_len > 0 THEN length(out) / CAST(out_len AS DOUBLE) END AS recall, CASE WHEN ok THEN 1.0 WHEN NOT ok THEN 0.0 END AS "precision", coalesce(out_len, 0) AS raw_chars, length(coalesce(out, '')) AS compact_chars FROM records)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    wall = F.col("wall").try_cast("double")
    size = F.col("out_len")
    return table(spark, d, "records").select(
        F.when(F.coalesce("via_js_cell", F.lit(False)), "plan").otherwise("evidence").alias("kind"), F.coalesce("ok", F.lit(False)).alias("passed"), (wall * 1000).alias("wall_ms"), F.length("cmd").alias("eval_count"), wall.alias("eval_seconds"),
        metrics.ratio(F.length("out"), F.when(size > 0, size)).alias("recall"), F.when(F.col("ok"), 1.0).when(~F.col("ok"), 0.0).alias("precision"), F.coalesce(size, F.lit(0)).alias("raw_chars"), F.length(F.coalesce("out", F.lit(""))).alias("compact_chars"),
        F.when(F.col("ordinal") % 2 == 0, "bound").otherwise("literal").alias("arm"), "tool",
    )


@query(f"WITH {_RUNS_SQL} SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS cases, count(*) FILTER (WHERE passed) AS passed, CAST(median(wall_ms) AS DOUBLE) AS median_wall_ms, CAST(quantile_disc(wall_ms, 0.95) AS DOUBLE) AS p95_wall_ms, CAST(sum(eval_count) AS DOUBLE) / nullif(sum(eval_seconds), 0) AS tokens_per_second, avg(coalesce(recall, 0)) AS mean_recall, avg(coalesce(\"precision\", 0)) AS mean_precision, 1 - CAST(sum(compact_chars) AS DOUBLE) / nullif(sum(raw_chars), 0) AS character_reduction, count(*) FILTER (WHERE passed) / CAST(count(*) AS DOUBLE) AS pass_rate FROM runs GROUP BY ROLLUP (kind)")
def agg_36_benchmark_summary(spark, d):
    """Pass rate, median, nearest-rank 95th percentile and savings per kind and over all."""
    return metrics.summarize(_runs(spark, d).drop("arm", "tool"))


@query(f"""SELECT CASE WHEN grouping(tool) = 1 THEN 'all' ELSE tool END AS op, arm, count(*) AS cases, count(*) FILTER (WHERE passed) AS passed, CAST(median(wall_ms) AS DOUBLE) AS median_ms, CAST(quantile_disc(wall_ms, 0.95) AS DOUBLE) AS p95_ms, CAST(median(CASE WHEN passed THEN wall_ms END) AS DOUBLE) AS median_successful_ms
FROM (SELECT *, coalesce(ok, false) AS passed, try_cast(wall AS DOUBLE) * 1000 AS wall_ms, CASE WHEN ordinal % 2 = 0 THEN 'bound' ELSE 'literal' END AS arm FROM records) GROUP BY GROUPING SETS ((arm), (arm, tool))""")
def agg_37_paired_arms(spark, d):
    """The same over paired arms, in total and per operation."""
    out = _runs(spark, d).groupingSets([["arm"], ["arm", "tool"]], "arm", "tool").agg(
        F.grouping("tool").alias("_all"), F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.median("wall_ms").alias("median_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY wall_ms)").alias("p95_ms"), F.median(F.when(F.col("passed"), F.col("wall_ms"))).alias("median_successful_ms")
    )
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("tool")).alias("op"), "arm", "cases", "passed", "median_ms", "p95_ms", "median_successful_ms")


@query("SELECT count(*) AS cases, CAST(sum(out_len) AS BIGINT) AS raw, CAST(sum(length(coalesce(out, ''))) AS BIGINT) AS compact, 1 - CAST(sum(length(coalesce(out, ''))) AS DOUBLE) / nullif(sum(out_len), 0) AS reduction FROM records WHERE ok")
def agg_38_reduction(spark, d):
    """How much shorter the kept output is than the recorded one, over successful commands."""
    rows = table(spark, d, "records").where("ok").agg(F.count("*").alias("cases"), F.sum("out_len").alias("raw"), F.sum(F.length(F.coalesce("out", F.lit("")))).alias("compact"))
    return rows.withColumn("reduction", 1 - metrics.ratio(F.col("compact"), F.col("raw")))


# ---- TOP


@query(annotated("family") + "SELECT ordinal, length(cmd) AS len FROM a WHERE cmd <> '' ORDER BY length(cmd) DESC, ordinal LIMIT 8")
def top_03_longest(spark, d):
    """The eight longest commands."""
    return table(spark, d, "records").where("cmd <> ''").select("ordinal", F.length("cmd").cast("long").alias("len")).orderBy(F.desc("len"), "ordinal").limit(8)


@query("SELECT source, tool, n FROM (SELECT source, tool, count(*) AS n FROM records GROUP BY ALL) ORDER BY n DESC, source, tool")
def top_02_tools_sorted(spark, d):
    return table(spark, d, "records").groupBy("source", "tool").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "tool")


def _draw_sql(group: str, k: int, seed: int, where: str, needs: tuple) -> str:
    return annotated(*needs) + f"SELECT {group}, ordinal, rank FROM (SELECT {group}, ordinal, row_number() OVER (PARTITION BY {group} ORDER BY sha256('{seed}:' || ordinal), ordinal) AS rank FROM a WHERE {where}) WHERE rank <= {k}"


@query(_draw_sql("cat", 5, 7, "true", ("cat",)))
def top_04_category_examples(spark, d):
    """Five commands drawn from each category."""
    return metrics.draw(notes(spark, d, "cat").select("cat", "ordinal"), ["cat"], 5, 7, "ordinal")


@query(_draw_sql("cause", 8, 7, "cause IS NOT NULL", ("cause",)))
def top_04_cause_examples(spark, d):
    return metrics.draw(notes(spark, d, "cause").where("cause is not null").select("cause", "ordinal"), ["cause"], 8, 7, "ordinal")


_STRATA = {"fail": 40, "hidden": 8, "interp ok": 20, "ok": 45}


@query(_TAIL + """, s AS (SELECT fam, ordinal, sha256('11:' || ordinal) AS x, cause, ok, hidden, interp0 FROM b WHERE coalesce(cmd, js, '') <> ''),
f AS (SELECT fam, ordinal, x, 'fail' AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY fam, cause ORDER BY x, ordinal) AS c FROM s WHERE ok = false) WHERE c <= 6),
u AS (SELECT * FROM f UNION ALL SELECT fam, ordinal, x, 'hidden' FROM s WHERE hidden UNION ALL SELECT fam, ordinal, x, 'interp ok' FROM s WHERE ok AND NOT hidden AND interp0 IS NOT NULL UNION ALL SELECT fam, ordinal, x, 'ok' FROM s WHERE ok AND NOT hidden)
SELECT fam, ordinal, min(place) AS place FROM (SELECT *, row_number() OVER (PARTITION BY fam, stratum ORDER BY x, ordinal) AS r, CASE stratum WHEN 'fail' THEN 1 WHEN 'hidden' THEN 2 WHEN 'interp ok' THEN 3 ELSE 4 END AS place FROM u) WHERE r <= CASE stratum WHEN 'fail' THEN 40 WHEN 'hidden' THEN 8 WHEN 'interp ok' THEN 20 ELSE 45 END GROUP BY fam, ordinal""")
def top_05_gallery(spark, d):
    """A gallery per family: failures spread over causes, hidden failures, embedded programs and plain successes, each command once."""
    rows = _tailed(spark, d, "cause", "hidden", "interp0", more=("js",)).where(F.coalesce("cmd", "js", F.lit("")) != "").select("fam", "ordinal", "cause", "ok", "hidden", "interp0")
    fine = F.coalesce(F.col("ok"), F.lit(False)) & ~F.col("hidden")
    fails = metrics.draw(rows.where("ok = false"), ["fam", "cause"], 6, 11, "ordinal").drop("rank")
    strata = [("fail", fails), ("hidden", rows.where("hidden")), ("interp ok", rows.where(fine & F.col("interp0").isNotNull())), ("ok", rows.where(fine))]
    drawn = [metrics.draw(part.select("fam", "ordinal"), ["fam"], _STRATA[name], 11, "ordinal").select("fam", "ordinal", F.lit(i).alias("place")) for i, (name, part) in enumerate(strata, 1)]
    out = drawn[0]
    for more in drawn[1:]:
        out = out.unionByName(more)
    return out.groupBy("fam", "ordinal").agg(F.min("place").alias("place"))


@query("SELECT ordinal FROM records WHERE ok = false ORDER BY sha256('58:' || ordinal), ordinal LIMIT 16")
def top_07_verifier_sample(spark, d):
    """Sixteen failures drawn for a slow check."""
    return table(spark, d, "records").where("ok = false").select("ordinal").orderBy(metrics.seeded(58, F.col("ordinal")), "ordinal").limit(16)


@query("SELECT session, CASE WHEN CAST('0x' || left(sha256(session), 8) AS BIGINT) % 10 < 8 THEN 'train' ELSE 'historical_holdout' END AS split, count(*) AS n FROM records GROUP BY ALL")
def top_08_session_split(spark, d):
    """Four fifths of the sessions by the digest of their names."""
    return table(spark, d, "records").groupBy("session").agg(F.count("*").alias("n")).select("session", "n", F.when(F.conv(F.left(F.sha2("session", 256), F.lit(8)), 16, 10).cast("long") % 10 < 8, "train").otherwise("historical_holdout").alias("split"))


# ---- REL


@query("SELECT cmd, min(ordinal) AS ordinal, count(*) AS n FROM records WHERE cmd IS NOT NULL GROUP BY cmd")
def rel_04_first_commands(spark, d):
    """The first record of every distinct command."""
    return table(spark, d, "records").where("cmd is not null").groupBy("cmd").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n"))


@query("SELECT source, count(DISTINCT session) AS sessions, count(DISTINCT model) AS models, count(DISTINCT cmd) AS commands FROM records GROUP BY source")
def rel_06_distinct_counts(spark, d):
    """Sessions, models and commands per source (REL-6, REL-7)."""
    return table(spark, d, "records").groupBy("source").agg(F.countDistinct("session").alias("sessions"), F.countDistinct("model").alias("models"), F.countDistinct("cmd").alias("commands"))


@query(annotated("cat", "hidden") + """SELECT count(*) AS records, count(*) FILTER (WHERE cmd <> '') AS recoverable_commands, count(DISTINCT cmd) FILTER (WHERE cmd <> '') AS unique_commands, count(DISTINCT session) FILTER (WHERE cmd <> '') AS sessions_with_commands, count(*) FILTER (WHERE cmd <> '' AND "exit" = 0) AS explicit_exit_zero,
count(*) FILTER (WHERE cmd <> '' AND "exit" IS NULL) AS unknown_exit, count(*) FILTER (WHERE cmd <> '' AND hidden) AS heuristic_hidden_failure, count(*) FILTER (WHERE cmd <> '' AND length(out) = 700) AS output_at_700_char_cap FROM a""")
def agg_35_corpus_audit(spark, d):
    """Conditional and distinct counts over the whole corpus."""
    rows = notes(spark, d, "hidden", more=("exit",))
    cmd = F.coalesce(F.col("cmd"), F.lit("")) != ""
    return rows.agg(
        F.count("*").alias("records"), F.count_if(cmd).alias("recoverable_commands"), F.countDistinct(F.when(cmd, F.col("cmd"))).alias("unique_commands"), F.countDistinct(F.when(cmd, F.col("session"))).alias("sessions_with_commands"),
        F.count_if(cmd & (F.col("exit") == 0)).alias("explicit_exit_zero"), F.count_if(cmd & F.col("exit").isNull()).alias("unknown_exit"), F.count_if(cmd & F.col("hidden")).alias("heuristic_hidden_failure"), F.count_if(cmd & (F.length("out") == 700)).alias("output_at_700_char_cap"),
    )


@query(annotated("cat") + "SELECT CASE WHEN grouping(source) = 0 THEN 'source' ELSE 'category' END AS kind, coalesce(source, cat) AS value, count(*) AS n FROM a WHERE cmd <> '' GROUP BY GROUPING SETS ((source), (cat))")
def agg_35_by_source_and_category(spark, d):
    rows = notes(spark, d, "cat").where("cmd <> ''")
    return rows.groupingSets([["source"], ["cat"]], "source", "cat").agg(F.when(F.grouping("source") == 0, "source").otherwise("category").alias("kind"), F.coalesce("source", "cat").alias("value"), F.count("*").alias("n")).select("kind", "value", "n")


# ---- SET


@query("SELECT session FROM records WHERE session IS NOT NULL EXCEPT SELECT id FROM sessions")
def set_03_unknown_sessions(spark, d):
    """Sessions of records that the session table does not hold, as spelled."""
    known = table(spark, d, "sessions").select(F.col("id").alias("session"))
    return table(spark, d, "records").where("session is not null").select("session").distinct().join(known, "session", "left_anti")


@query("""SELECT source, string_agg(c, '|' ORDER BY c) FILTER (WHERE w AND h) AS selected, string_agg(c, '|' ORDER BY c) FILTER (WHERE w AND NOT h) AS missing, string_agg(c, '|' ORDER BY c) FILTER (WHERE h AND NOT w) AS excluded
FROM (SELECT source, c, bool_or(w) AS w, bool_or(h) AS h FROM (SELECT DISTINCT source, unnest(['Bash', 'bash', 'shell_command']) AS c, true AS w, false AS h FROM records UNION ALL SELECT DISTINCT source, tool, false, true FROM records) GROUP BY source, c) GROUP BY source""")
def set_04_tool_sets(spark, d):
    """Of the tools that are wanted those a source has, those it lacks and those left out."""
    wanted = F.array(*[F.lit(x) for x in ("Bash", "bash", "shell_command")])
    has = table(spark, d, "records").groupBy("source").agg(F.collect_set("tool").alias("has"))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), "|"))
    return has.select("source", text(F.array_intersect(wanted, "has")).alias("selected"), text(F.array_except(wanted, "has")).alias("missing"), text(F.array_except("has", wanted)).alias("excluded"))


def session_dimension(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").select(F.col("id").alias("session"), "directory", "tz", "store")


@query("SELECT ordinal, coalesce(workdir, directory, cwd) AS cwd, store FROM records LEFT JOIN (SELECT id, directory, store FROM sessions) s ON session = s.id")
def join_04_session_directory(spark, d):
    """Each record with the directory of its session: the stated one first, then that of the session, then its own."""
    rows = table(spark, d, "records").select("ordinal", "session", "workdir", "cwd")
    return rows.join(session_dimension(spark, d), "session", "left").select("ordinal", F.coalesce("workdir", "directory", "cwd").alias("cwd"), "store")


@query("WITH s AS (SELECT DISTINCT lower(trim(session)) AS s FROM records WHERE via_js_cell) SELECT ordinal FROM records WHERE lower(trim(session)) IN (SELECT s FROM s)")
def join_12_semi_join(spark, d):
    """The records of all sessions that have a JS cell."""
    rows = table(spark, d, "records").select("ordinal", "via_js_cell", F.lower(F.trim("session")).alias("s"))
    return rows.join(rows.where("via_js_cell").select("s").distinct(), "s", "left_semi").select("ordinal")

