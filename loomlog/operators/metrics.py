"""Aggregates over annotated command records.

Each function is one grouped aggregation with partial aggregation before its
shuffle; ratios are unrounded doubles. A null key is a group of its own, and an
empty input gives no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def _counts(where: Column | None = None) -> list[Column]:
    ok, hidden = F.col("ok"), F.col("hidden")
    yes = F.lit(True) if where is None else where
    return [F.count_if(yes).alias("n"), F.count_if(yes & (ok == F.lit(False))).alias("fail"), F.count_if(yes & hidden).alias("hidden")]


def with_rates(df: DataFrame) -> DataFrame:
    return df.withColumn("fail_rate", ratio(F.col("fail"), F.col("n"))).withColumn("hidden_rate", ratio(F.col("hidden"), F.col("n")))


def rate_by(df: DataFrame, *keys: str, having: int = 0) -> DataFrame:
    """Records, failures and hidden failures per key; ok null is no failure."""
    out = with_rates(df.groupBy(*keys).agg(*_counts()))
    return out.where(F.col("n") >= having) if having else out


def rate_sets(df: DataFrame, *sets: tuple[str, ...]) -> DataFrame:
    """The rates of several key sets in one pass by GROUPING SETS; `key_set` names the set, unused keys are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    label = F.lit(None).cast("string")
    for s in sets:
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        label = F.when(F.grouping_id() == bits, "+".join(s)).otherwise(label)
    return with_rates(df.groupingSets([list(s) for s in sets], *keys).agg(label.alias("key_set"), *_counts()))


def top_per_group(counts: DataFrame, groups: list[str], k: int, *order: Column) -> DataFrame:
    """The k rows of each group in a total order, with their rank; counts are pre-aggregated."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def most_common(df: DataFrame, key: str, k: int, groups: list[str] | None = None, order: str = "ordinal") -> DataFrame:
    """The k most frequent values per group; equals come in the order in which they first occur."""
    groups = groups or []
    counts = df.groupBy(*groups, key).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    if groups:
        return top_per_group(counts, groups, k, F.desc("n"), F.asc("first_seen"), F.asc(key)).drop("first_seen")
    return counts.orderBy(F.desc("n"), F.asc("first_seen"), F.asc(key)).limit(k).drop("first_seen")


def family_stats(df: DataFrame) -> DataFrame:
    """The main figures per source and family."""
    n, seen = F.count("*"), F.col("exit_visible")
    return df.groupBy("source", "family").agg(
        *_counts(), ratio(F.count_if(F.size("interp") > 0), n).alias("interp_share"), ratio(F.count_if(F.col("via_js_cell")), n).alias("js_cell_share"),
        F.coalesce(F.median(F.when(F.col("cx.len") > 0, F.col("cx.len"))), F.lit(0.0)).alias("median_len"), F.coalesce(F.avg(F.when(F.col("cx.segs") > 0, F.col("cx.segs"))), F.lit(0.0)).alias("mean_segs"),
        ratio(F.count_if("mismatch"), n).alias("mismatch_rate"), ratio(F.count_if(seen), F.count(seen)).alias("exit_visible_rate"), F.countDistinct("session").alias("sessions"),
    )


def oddities(df: DataFrame) -> DataFrame:
    """How often each oddity occurs, all counted in one pass."""
    cmd, host = F.coalesce(F.col("cmd"), F.lit("")), F.col("host")
    ps = host.isin("powershell", "powershell5", "pwsh7")
    # Names of the oddities and what makes them.
    tests = {
        "nul_redirect_in_bash": host.isin("git-bash", "bash") & cmd.rlike(r"2>\s*nul\b"), "dev_null_in_powershell": (ps | (host == "cmd.exe")) & cmd.contains("/dev/null"),
        "and_and_on_ps5": (host == "powershell5") & cmd.contains("&&"), "head_in_ps": ps & cmd.rlike(r"\|\s*head\b"), "cat_in_ps": (ps | (host == "cmd.exe")) & cmd.rlike(r"(^|[;&|]\s*)cat\s"),
        "dynamic_cmd_in_js": F.col("dynamic"), "r_output_only_hides_exit": (F.col("source") == "codex") & ~F.col("tool").endswith("(js-only)") & ~F.coalesce(F.col("exit_visible"), F.lit(False)), "backgrounded_yield": F.col("backgrounded"),
        "multi_cmd_cells": (F.col("n_in_cell") >= 2) & (F.col("idx_in_cell") == 0),
    }
    return df.agg(*[F.count_if(c).alias(k) for k, c in tests.items()])


# Tools by what they do, for the share of the shell among all tool calls.
SHELL_TOOLS = ["Bash", "PowerShell", "bash", "shell", "oc_bash", "Shell", "AwaitShell", "fn:shell_command", "fn:exec_command", "jscell:exec_command", "jscell:shell_command"]
READ_TOOLS = ["Read", "read", "oc_read", "jscell:read_file", "Glob", "glob", "Grep", "grep", "ls", "oc_ls", "oc_glob"]
EDIT_TOOLS = ["Edit", "Write", "edit", "write", "apply_patch", "patch", "jscell:apply_patch", "StrReplace", "oc_edit", "oc_write", "fn:apply_patch"]
#: the report's buckets, of which the first that holds a tool counts
TOOL_BUCKETS = {
    "shell": SHELL_TOOLS,
    "read/search": ["Read", "read", "oc_read", "Glob", "glob", "Grep", "grep", "ls", "oc_ls", "oc_glob", "stat", "jscell:read_file", "jscell:grep", "jscell:list_dir"],
    "edit/write": [*EDIT_TOOLS, "Delete", "rm", "oc_rm", "mkdir"],
    "js/node repl": ["jscell:mcp__node_repl__js", "execute"],
    "agents/quest": ["Agent", "task", "subagent", "fn:spawn_agent", "fn:wait_agent", "jscell:spawn_agent", "jscell:wait_agent", "fn:wait", "jscell:quest", "mcp__mcp__quest", "jscell:mcp__quest__quest", "jscell:mcp__quest__quest_workspace"],
}


def tool_counts(records: DataFrame) -> DataFrame:
    """(source, model, tool, n): how often each tool was called.

    A JS cell counts as `exec` once (at its first command) and each call inside
    it as `jscell:NAME`; a plain function call of the codex source counts as
    `fn:NAME`. Null models are one group.
    """
    cell = F.coalesce(F.col("via_js_cell"), F.lit(False))
    first = F.coalesce(F.col("idx_in_cell"), F.lit(0)) == 0
    outer = F.when(cell & (F.col("source") == "codex"), "exec").when(cell, "execute").when(F.col("source") == "codex", F.concat(F.lit("fn:"), F.col("tool"))).otherwise(F.col("tool"))
    inner = F.transform(F.coalesce(F.col("js_tools"), F.array().cast("array<string>")), lambda t: F.concat(F.lit("jscell:"), t))
    tools = F.when(cell, F.concat(F.array(outer), inner)).otherwise(F.array(outer))
    return records.where(~cell | first).select("source", "model", F.explode(tools).alias("tool")).groupBy("source", "model", "tool").agg(F.count("*").alias("n"))


def tool_share(counts: DataFrame) -> DataFrame:
    """Calls per source and family by overlapping kinds of tools; the codex cell itself is left out, its inner calls count."""
    n = F.col("n")
    calls = lambda c: F.sum(F.when(c, n).otherwise(0))
    tool = F.col("tool")
    out = counts.where(~((F.col("source") == "codex") & (tool == "exec"))).groupBy("source", "family").agg(
        F.sum("n").alias("total"), calls(tool.isin(*SHELL_TOOLS, "execute")).alias("shell"), calls(tool.startswith("jscell:") | (tool == "execute")).alias("js_cell_calls"),
        calls(tool.isin(*READ_TOOLS)).alias("dedicated_read_search"), calls(tool.isin(*EDIT_TOOLS)).alias("dedicated_edit"),
    )
    return out.withColumn("shell_share", ratio(F.col("shell"), F.col("total")))


def tool_bucket(tool: Column) -> Column:
    out = F
    for name, tools in TOOL_BUCKETS.items():
        out = out.when(tool.isin(*tools), name)
    return out.otherwise("other")


def tail_bucket(df: DataFrame, key: str, least: int, other: str, out: str) -> DataFrame:
    """df with `out`: the key where at least `least` rows have it, else `other`. One counted row per key is joined back, never a window over its rows."""
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    kept = n.select(F.col(key).alias("_k"), F.when(F.col("_n") >= least, F.col(key)).otherwise(other).alias(out))
    return df.join(kept, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def matrix(df: DataFrame, row: str, column: str, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The rates of every combination of the given rows and columns, both small dimension tables; absent cells have n = 0 and null rates."""
    cells = df.groupBy(row, column).agg(*_counts())
    grid = rows.select(row).crossJoin(F.broadcast(columns.select(column)))  # distinct names of two dimensions
    return with_rates(grid.join(cells, [row, column], "left").na.fill(0, ["n", "fail", "hidden"]))


def seeded(seed: int, key: Column) -> Column:
    """A digest by which rows are drawn in an order that depends on the seed only."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def draw(df: DataFrame, groups: list[str], k: int, seed: int, key: str) -> DataFrame:
    """k rows of each group, or all of a smaller one: those whose seeded digests are the smallest; `rank` tells their order."""
    return top_per_group(df.withColumn("_d", seeded(seed, F.col(key))), groups, k, F.asc("_d"), F.asc(key)).drop("_d")


def summarize(runs: DataFrame) -> DataFrame:
    """Scores of benchmark runs per kind and over all (`kind` = all): pass rate, median and nearest-rank 95th percentile of the wall time, decoded tokens a second, mean recall and precision, share of characters saved.

    runs: kind, passed, wall_ms, eval_count, eval_seconds, recall, precision, raw_chars, compact_chars. Nulls of
    recall and precision count as 0; a sum of zero gives a null ratio.
    """
    out = runs.rollup("kind").agg(
        F.grouping("kind").alias("_all"), F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.median("wall_ms").alias("median_wall_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY wall_ms)").alias("p95_wall_ms"),
        ratio(F.sum("eval_count"), F.sum("eval_seconds")).alias("tokens_per_second"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("mean_recall"), F.avg(F.coalesce("precision", F.lit(0.0))).alias("mean_precision"),
        (1 - ratio(F.sum("compact_chars"), F.sum("raw_chars"))).alias("character_reduction"),
    )
    kind = F.when(F.col("_all") == 1, "all").otherwise(F.col("kind"))
    return out.withColumn("kind", kind).drop("_all").withColumn("pass_rate", ratio(F.col("passed"), F.col("cases")))
