"""Transcript adapters: JSON lines and rows of four stores as tool calls and results.

Each adapter reads variants, so nothing is inferred, and gives two tables with
the same columns whatever the store:

- calls: source, file, line, part, call_id, tool, model, ts, cwd, command, input
- results: file, line, part, call_id, output, exit_code, failed, interrupted

Cases and their results:
- lines that are no JSON objects, and blocks of other shapes, give no rows;
- repeated ids are kept here; `operators.reconcile` decides between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.values import command_member, member, parse_strict, text_content

CALLS = ("source", "file", "line", "part", "call_id", "tool", "model", "ts", "cwd", "command", "input")
RESULTS = ("file", "line", "part", "call_id", "output", "exit_code", "failed", "interrupted")


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with `v`, the JSON object of each; other lines are dropped (count them with `dispositions`)."""
    return lines.withColumn("v", parse_strict(F.col(value))).where(F.schema_of_variant("v").startswith("OBJECT"))


def dispositions(lines: DataFrame, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, disposition, n): each line is exactly one of blank, malformed, non_object and object."""
    v = parse_strict(F.col(value))
    kind = F.when(F.coalesce(F.col(value), F.lit("")).rlike(r"\S"), F.when(v.isNull(), "malformed").when(F.schema_of_variant(v).startswith("OBJECT"), "object").otherwise("non_object")).otherwise("blank")
    return lines.groupBy(*keys, kind.alias("disposition")).agg(F.count("*").alias("n"))


def exploded(rows: DataFrame, array: Column) -> DataFrame:
    """One row per object of an array of variants, with its place `part` and value `b`."""
    return rows.select("*", F.posexplode(array).alias("part", "b")).where(F.schema_of_variant("b").startswith("OBJECT"))


def claude_blocks(lines: DataFrame) -> DataFrame:
    """(file, line, kind, message, part, b) of lines (file, line, kind, message): the blocks of readable messages."""
    rows = lines.withColumn("m", F.try_parse_json("message"))
    return exploded(rows, F.try_variant_get("m", "$.content", "array<variant>"))


def claude_calls(blocks: DataFrame) -> DataFrame:
    b = F.col("b")
    rows = blocks.where((F.col("kind") == "assistant") & (member(b, "$.type") == "tool_use"))
    data = F.try_variant_get(b, "$.input", "variant")
    return rows.select(
        F.lit("claude-code").alias("source"), "file", "line", "part", member(b, "$.id").alias("call_id"), member(b, "$.name").alias("tool"), member(F.col("m"), "$.model").alias("model"),
        F.col("ts").cast("string").alias("ts"), F.lit(None).cast("string").alias("cwd"), command_member(data).alias("command"), F.to_json(data).alias("input"),
    )


def claude_results(blocks: DataFrame) -> DataFrame:
    """A result fails if it says so; without a stated code one that did not fail counts as 0."""
    b = F.col("b")
    rows = blocks.where((F.col("kind") == "user") & (member(b, "$.type") == "tool_result"))
    content = F.try_variant_get(b, "$.content", "variant")
    text = F.coalesce(text_content(content), F.lit(""))
    failed = F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False))
    stated = F.regexp_extract(text, r"^Exit code (\d+)", 1).try_cast("int")
    stopped = F.coalesce(F.try_variant_get(F.try_parse_json("result"), "$.interrupted", "boolean"), F.lit(False))
    return rows.select("file", "line", "part", member(b, "$.tool_use_id").alias("call_id"), text.alias("output"), F.coalesce(stated, F.when(~failed, 0)).alias("exit_code"), failed.alias("failed"), stopped.alias("interrupted"))


def opencode_parts(parts: DataFrame) -> DataFrame:
    """Both sides of the tool parts (file, line, part, model, directory, data) of the first store version, one row per part."""
    v = F.col("v")
    rows = parsed(parts, "data").where(member(v, "$.type") == "tool")
    state = F.try_variant_get(v, "$.state", "variant")
    text = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.state.content", "variant")).startswith("ARRAY"), text_content(F.try_variant_get(v, "$.state.content", "variant"))), member(state, "$.output"), F.lit(""))
    code = F.coalesce(member(state, "$.metadata.exit", "int"), F.regexp_extract(text, r"\[?Exit code: (-?\d+)", 1).try_cast("int"))
    status = member(state, "$.status")
    err = F.coalesce(member(state, "$.error"), member(state, "$.error.message"))
    return rows.select(
        F.lit("opencode").alias("source"), "file", "line", "part", F.coalesce(member(v, "$.callID"), F.col("part_id")).alias("call_id"), member(v, "$.tool").alias("tool"), F.coalesce("model", F.lit("unknown")).alias("model"),
        F.try_variant_get(state, "$.time.start", "string").alias("ts"), F.coalesce(member(state, "$.input.workdir"), F.col("directory")).alias("cwd"), member(state, "$.input.command").alias("command"), F.to_json(F.try_variant_get(state, "$.input", "variant")).alias("input"),
        text.alias("output"), code.alias("exit_code"), ((status == "completed") & (F.coalesce(code, F.lit(0)) == 0)).alias("ok"), status.alias("status"), err.alias("err"),
        (F.try_variant_get(state, "$.time.end", "bigint") - F.try_variant_get(state, "$.time.start", "bigint")).alias("dur_ms"),
    )


def opencode_messages(messages: DataFrame) -> DataFrame:
    """The tool blocks of messages (file, line, kind, data) of the second store version, as blocks of claude_blocks."""
    rows = parsed(messages, "data").withColumn("m", F.col("v"))
    return exploded(rows, F.try_variant_get("v", "$.content", "array<variant>"))


def message_model(v: Column) -> Column:
    """provider/model of a message of the second store version."""
    name = lambda k: F.coalesce(member(v, k), F.lit(""))
    return F.concat(name("$.model.providerID"), F.lit("/"), F.coalesce(member(v, "$.model.id"), name("$.model.modelID")))


# ---- codex: one line per event, state carried forward within a file


def codex_events(lines: DataFrame) -> DataFrame:
    """lines (file, line, value) with type, payload and, carried forward within the file, session, cwd and model."""
    v = F.col("v")
    rows = parsed(lines).select("file", "line", member(v, "$.type").alias("kind"), F.try_variant_get(v, "$.timestamp", "string").alias("ts"), F.try_variant_get(v, "$.payload", "variant").alias("p"))
    rows = rows.where(F.schema_of_variant("p").startswith("OBJECT"))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    meta, turn = F.col("kind") == "session_meta", F.col("kind") == "turn_context"
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    return rows.withColumns({
        "session": F.coalesce(last(F.when(meta, F.coalesce(member(F.col("p"), "$.id"), member(F.col("p"), "$.session_id")))), F.col("file")),
        "cwd": last(F.when(meta | turn, member(F.col("p"), "$.cwd"))), "model_before": last(F.when(turn, member(F.col("p"), "$.model"))),
    })


def codex_calls(events: DataFrame) -> DataFrame:
    """Calls with the model of the turn that they name, else the last one before them (an as-of lookup)."""
    p = F.col("p")
    turns = events.where("kind = 'turn_context'").groupBy("file", member(p, "$.turn_id").alias("turn")).agg(F.max_by(member(p, "$.model"), "line").alias("turn_model"))
    rows = events.where((F.col("kind") == "response_item") & member(p, "$.type").isin("custom_tool_call", "function_call"))
    rows = rows.withColumn("turn", member(p, "$.internal_chat_message_metadata_passthrough.turn_id")).join(turns, ["file", "turn"], "left")
    args = F.coalesce(F.try_parse_json(member(p, "$.arguments")), F.try_variant_get(p, "$.arguments", "variant"))
    return rows.select(
        F.lit("codex").alias("source"), "file", "line", F.lit(0).alias("part"), member(p, "$.call_id").alias("call_id"), member(p, "$.name").alias("tool"), F.coalesce("turn_model", "model_before").alias("model"), "ts", "cwd",
        command_member(args).alias("command"), F.coalesce(member(p, "$.input"), F.to_json(args)).alias("input"),
    )


def codex_results(events: DataFrame) -> DataFrame:
    """Outputs with all exit codes that they state; `failed` if the script itself did."""
    p = F.col("p")
    rows = events.where((F.col("kind") == "response_item") & member(p, "$.type").isin("custom_tool_call_output", "function_call_output"))
    text = F.coalesce(text_content(F.try_variant_get(p, "$.output", "variant")), F.lit(""))
    codes = F.transform(F.regexp_extract_all(text, F.lit(r'"exit_code"\s*:\s*(-?\d+)'), 1), lambda x: x.try_cast("int"))
    return rows.select(
        "file", "line", F.lit(0).alias("part"), member(p, "$.call_id").alias("call_id"), text.alias("output"), codes.alias("codes"), F.when(F.size(codes) == 1, codes[0]).alias("exit_code"),
        text.rlike(r"^Script (?:failed|error)").alias("failed"), F.lit(False).alias("interrupted"), F.nullif(F.regexp_extract(text, r"Wall time:? ([\d.]+)", 1), F.lit("")).alias("wall"),
    )


def native_events(events: DataFrame, before: str | None = None, most: int = 200_000) -> DataFrame:
    """Completed native commands: one row per (file, item id, or digest of the payload), the first line first; outputs are kept up to `most` characters and flagged.

    before: events from this day on are left out.
    """
    p = F.col("p")
    item = F.try_variant_get(p, "$.item", "variant")
    rows = events.where((F.col("kind") == "event_msg") & (member(p, "$.type") == "item_completed") & (member(item, "$.type") == "CommandExecution"))
    if before:
        rows = rows.where(F.coalesce(F.left("ts", F.lit(10)), F.lit("")) < before)
    output = F.coalesce(text_content(F.try_variant_get(item, "$.aggregated_output", "variant")), text_content(F.try_variant_get(item, "$.formatted_output", "variant")), F.lit(""))
    rows = rows.select(
        "file", "line", "session", F.coalesce(member(item, "$.id"), F.sha2(F.to_json("p"), 256)).alias("call_id"), F.try_variant_get(item, "$.command", "array<string>").alias("argv"), F.coalesce(member(item, "$.cwd"), F.col("cwd")).alias("cwd"), "ts",
        member(item, "$.exit_code", "int").alias("exit_code"), F.left(output, F.lit(most)).alias("output"), F.length(output).alias("output_chars"), (F.length(output) > most).alias("capped"), member(item, "$.status").alias("status"),
    )
    return rows.where(F.size("argv") > 0).withColumn("_r", F.row_number().over(Window.partitionBy("file", "call_id").orderBy("line"))).where("_r = 1").drop("_r")


# ---- cursor: blobs without order


def cursor_blobs(blobs: DataFrame) -> DataFrame:
    """The blocks of blobs (file, line, data): kind is the role; `model` is the one that the last system text of the file names."""
    v = F.col("v")
    rows = parsed(blobs, "data").withColumn("kind", member(v, "$.role"))
    named = F.when(F.col("kind") == "system", F.nullif(F.regexp_extract(member(v, "$.content"), r"powered by (.+?)\. ", 1), F.lit("")))
    models = rows.where(named.isNotNull()).groupBy("file").agg(F.max_by(named, "line").alias("model"))
    return exploded(rows.join(models, "file", "left"), F.try_variant_get("v", "$.content", "array<variant>"))


def cursor_calls(blocks: DataFrame) -> DataFrame:
    b = F.col("b")
    rows = blocks.where((F.col("kind") == "assistant") & (member(b, "$.type") == "tool-call"))
    return rows.select(
        F.lit("cursor").alias("source"), "file", "line", "part", member(b, "$.toolCallId").alias("call_id"), member(b, "$.toolName").alias("tool"), "model", F.lit(None).cast("string").alias("ts"), F.lit(None).cast("string").alias("cwd"),
        F.when(member(b, "$.toolName") == "Shell", member(b, "$.args.command")).alias("command"), F.to_json(F.try_variant_get(b, "$.args", "variant")).alias("input"),
    )


def cursor_results(blocks: DataFrame) -> DataFrame:
    b = F.col("b")
    rows = blocks.where((F.col("kind") == "tool") & (member(b, "$.type") == "tool-result"))
    value = F.try_variant_get(b, "$.result", "variant")
    text = F.coalesce(member(b, "$.result"), F.to_json(value), F.lit(""))
    code = F.regexp_extract(text, r"Exit code: (-?\d+)", 1).try_cast("int")
    return rows.select("file", "line", "part", member(b, "$.toolCallId").alias("call_id"), text.alias("output"), code.alias("exit_code"), (code != 0).alias("failed"), F.lit(False).alias("interrupted"))


# ---- legacy corpus


def legacy(rows: DataFrame, cap: int = 700) -> DataFrame:
    """Records of an earlier extraction: one command per row; an output of exactly `cap` characters was probably cut."""
    kept = rows.where(F.col("cmd").rlike(r"\S"))
    out = F.coalesce("out", F.lit(""))
    return kept.select(
        "session", F.col("ordinal").cast("string").alias("call_id"), F.col("cmd").alias("command"), F.lit("legacy_extracted").alias("tool"), out.alias("output"), F.col("exit").alias("exit_code"), F.lit("legacy_extractor_unverified").alias("exit_code_origin"),
        (out != "").alias("result_present"), (F.length(out) == cap).alias("source_cap_suspected"),
    )


# ---- census of written scripts

# Extensions of script files, and paths of temporary places.
SCRIPT = r"(?i)\.(py|mjs|cjs|js|ts|tsx|ps1|sh|bat|cmd)$"
TEMPORARY = r"(?i)(Temp|tmp|scratch|\.tmp-|[\\/]scripts?[\\/]|\.codex[\\/]visualizations)"


def script_census(paths: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """(keys, ext, place, n): how many script files were written, in temporary places or in the repository; other files do not count."""
    ext = F.lower(F.regexp_extract(path, SCRIPT, 1))
    rows = paths.where(F.col(path).rlike(SCRIPT)).withColumn("ext", ext).withColumn("place", F.when(F.col(path).rlike(TEMPORARY), "temp/scratch").otherwise("in repo"))
    return rows.groupBy(*keys, "ext", "place").agg(F.count("*").alias("n"))


def added_files(text: Column) -> Column:
    """The files that a patch text adds, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\*\*\* Add File: ([^\n]+)"), 1), lambda x: F.trim(x))


# ---- records


def exit_of(codes: Column, n: Column, at: Column) -> Column:
    """The exit code of the command at place `at` of n: only if there are as many codes as commands."""
    return F.when(F.size(codes) == n, F.try_element_at(codes, at + 1))


def codex_ok(unmatched: Column, failed: Column, code: Column) -> Column:
    """Null without a result, false if the script failed, else by the exit code; a code that is not visible counts as success."""
    return F.when(~unmatched, F.when(failed, F.lit(False)).otherwise(F.coalesce(code == 0, F.lit(True))))


def codex_records(lines: DataFrame) -> DataFrame:
    """Records of the lines (file, line, value): one per shell command of a call, one `exec(js-only)` for a cell without any; other tools give none."""
    from loomlog.operators.cells import shell_commands
    from loomlog.operators.reconcile import first_seen, pair

    events = codex_events(lines)
    calls = first_seen(codex_calls(events), ["call_id"], ["file", "line"])
    results = codex_results(events).select("file", "line", "call_id", "output", "codes", "failed", "wall")
    rows = pair(calls, results, ["file", "call_id"], ["line"])
    base = ["source", "model", "file", "line", "call_id", "ts", "cwd", "tool", "output", "codes", "failed", "wall", "result_present"]
    cell = rows.where("tool = 'exec'")
    inner = shell_commands(cell.select(*base, F.col("input").alias("js")), "js")
    seen = inner.select("file", "line").distinct()
    only = cell.join(seen, ["file", "line"], "left_anti").select(*base, F.col("input").alias("js")).withColumns({"n_in_cell": F.lit(None).cast("int"), "idx_in_cell": F.lit(None).cast("int"), "cmd": F.lit(None).cast("string"), "shell_param": F.lit(None).cast("string"), "workdir": F.lit(None).cast("string"), "dynamic": F.lit(False)})
    plain = rows.where(F.col("tool").isin("shell_command", "exec_command"))
    v = F.try_parse_json("input")
    plain = plain.select(*base, F.lit(None).cast("string").alias("js")).withColumns({"n_in_cell": F.lit(1), "idx_in_cell": F.lit(0)}).join(
        plain.select("file", "line", F.col("command").alias("cmd"), member(v, "$.shell").alias("shell_param"), member(v, "$.workdir").alias("workdir"), F.lit(False).alias("dynamic")), ["file", "line"]
    )
    every = inner.withColumn("tool", F.lit("exec>exec_command")).unionByName(only.withColumn("tool", F.lit("exec(js-only)"))).unionByName(plain)
    js_only = F.col("n_in_cell").isNull()
    code = F.when(~js_only, exit_of(F.col("codes"), F.col("n_in_cell"), F.col("idx_in_cell")))
    unmatched = ~F.col("result_present")
    text = F.coalesce("output", F.lit(""))
    return every.select(
        "source", "model", F.col("file").alias("session"), "ts", "cwd", "tool", F.col("js").isNotNull().alias("via_js_cell"), "cmd", F.left("js", F.lit(1200)).alias("js"), "shell_param", "workdir", "dynamic",
        codex_ok(unmatched, F.col("failed"), code).alias("ok"), code.alias("exit"), F.when(~js_only, code.isNotNull()).alias("exit_visible"), F.left(text, F.lit(700)).alias("out"), "wall", unmatched.alias("unmatched"),
        "n_in_cell", "idx_in_cell", (text.contains('"session_id"') & code.isNull()).alias("backgrounded"),
    )
