"""Calls, results and native events of the same commands brought together.

Cases and their results:
- null keys match nothing: such calls stay without result, such results are
  counted as unmatched;
- repeated calls: the first in the given order stays;
- a call without result has null outcome columns and result_present false;
- empty tables: no rows.

Keys are spread by (session, call_id), so one session with a third of all rows
does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.values import digest
from loomlog.operators.sessions import first_per_key


def pair(calls: DataFrame, results: DataFrame, key: list[str], order: list[str], which: str = "first", must_follow: bool = True) -> DataFrame:
    """Every call with its result; of several results the first or the last counts, and, if must_follow, only results after their call.

    results: key, the columns of order, and outcome columns. The outcome columns get the prefix `r_` if a call has one of that name.
    """
    values = [c for c in results.columns if c not in key and c not in order]
    where = F.struct(*[F.col(f"`{o}`") for o in order])
    right = results.select(*[F.col(f"`{k}`").alias(f"_r_{k}") for k in key], where.alias("_at"), F.struct(*[F.col(f"`{v}`") for v in values]).alias("_value"))
    on = [F.col(f"`{k}`") == F.col(f"_r_{k}") for k in key]
    if must_follow:
        calls = calls.withColumn("_call_at", where)
        on.append(F.col("_at") > F.col("_call_at"))
    best = F.min_by("_value", "_at") if which == "first" else F.max_by("_value", "_at")
    # a key has one call and its few results, so results are reduced before the calls' own columns are joined back
    matched = calls.select(*key, *(["_call_at"] if must_follow else [])).where(" and ".join(f"`{k}` is not null" for k in key)).distinct().join(right, on, "inner")
    picked = matched.groupBy(*[F.col(f"`{k}`").alias(f"_k_{k}") for k in key]).agg(best.alias("_value"))
    joined = calls.drop("_call_at").join(picked, [F.col(f"`{k}`") == F.col(f"_k_{k}") for k in key], "left")
    names = {v: f"r_{v}" if v in calls.columns else v for v in values}
    return joined.select(*[F.col(f"`{c}`") for c in calls.columns if c != "_call_at"], *[F.col(f"_value.`{v}`").alias(n) for v, n in names.items()], F.col("_value").isNotNull().alias("result_present"))


def first_seen(calls: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first call of every id over all files; calls without an id all stay."""
    known = " and ".join(f"`{k}` is not null" for k in key)
    return first_per_key(calls.where(known), key, *order).unionByName(calls.where(f"not ({known})"))


def prefer(rows: DataFrame, key: list[str], rank: str, order: list[str]) -> DataFrame:
    """Of the rows of a key those of the best rank, then the first: how two versions of a store are merged."""
    return first_per_key(rows, key, rank, *order)


def chunks(results: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, output, exit_code, n_chunks): the chunks of a result joined in order.

    A chunk that equals what was joined so far, output and exit code, is a repetition and adds nothing; the exit code is that of
    the last chunk. Chunks of one id are few, so they are folded in one array.
    """
    parts = F.array_sort(F.collect_list(F.struct(*order, "output", "exit_code")))
    start = F.struct(F.lit(None).cast("string").alias("output"), F.lit(None).cast("int").alias("exit_code"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        same = (acc["n"] > 0) & acc["output"].eqNullSafe(x["output"]) & acc["exit_code"].eqNullSafe(x["exit_code"])
        text = F.when(acc["n"] == 0, x["output"]).otherwise(F.concat(F.coalesce(acc["output"], F.lit("")), F.lit("\n"), F.coalesce(x["output"], F.lit(""))))
        return F.when(same, acc).otherwise(F.struct(text.alias("output"), x["exit_code"].cast("int").alias("exit_code"), (acc["n"] + 1).alias("n")))

    folded = results.groupBy(*key).agg(parts.alias("_parts")).withColumn("_f", F.aggregate("_parts", start, step))
    return folded.select(*key, F.col("_f.output").alias("output"), F.col("_f.exit_code").alias("exit_code"), F.col("_f.n").alias("n_chunks"))


def resolve_conflicts(calls: DataFrame, key: list[str], command: str, order: list[str], pointer: Column) -> DataFrame:
    """Calls once per id and command; a further command under the same id gets the id `ID:conflict:DIGITS` and call_id_conflict.

    key: the columns of the id, `call_id` last. pointer: the text of the place of a call, whose digest gives the digits.
    """
    once = first_per_key(calls.withColumn("_pointer", pointer), [*key, command], *order)
    first = Window.partitionBy(*key).orderBy(*order)
    ranked = once.withColumn("_n", F.row_number().over(first))
    again = F.col("_n") > 1
    new_id = F.when(again, F.concat("call_id", F.lit(":conflict:"), F.left(F.sha2("_pointer", 256), F.lit(12)))).otherwise(F.col("call_id"))
    return ranked.withColumn("call_id", new_id).withColumn("call_id_conflict", again).drop("_n", "_pointer")


CONTEXT = ("request_context", "context_truncated", "context_association")


def reconcile(calls: DataFrame, results: DataFrame, natives: DataFrame) -> DataFrame:
    """Calls, each with its result, and native events; keys are (session, call_id), unique in each table.

    calls: session, call_id, command, tool, cwd and the columns of CONTEXT; results: session, call_id, output, exit_code; natives: all
    but tool. A native event stands for the call of its key and takes over its context; a call without either has no
    result. `origin` tells which of the three a row is.
    """
    key = ["session", "call_id"]
    c, n = calls.alias("c"), natives.alias("n")
    both = c.join(n, [F.col(f"c.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    native = F.col("n.call_id").isNotNull()
    paired = native & F.col("c.call_id").isNotNull()
    pick = lambda x: F.when(native, F.col(f"n.{x}")).otherwise(F.col(f"c.{x}"))
    of_call = lambda x: F.when(paired, F.col(f"c.{x}")).otherwise(pick(x))
    rows = both.select(
        *[F.coalesce(f"c.{k}", f"n.{k}").alias(k) for k in key], pick("command").alias("command"), F.when(native, "native_command_execution").otherwise(F.col("c.tool")).alias("tool"), pick("cwd").alias("cwd"),
        *[of_call(x).alias(x) for x in CONTEXT], F.col("n.output").alias("_out"), F.col("n.exit_code").alias("_code"), native.alias("_native"), paired.alias("_paired"),
    )
    r = results.select(*[F.col(k).alias(f"_r_{k}") for k in key], F.col("output").alias("_r_out"), F.col("exit_code").alias("_r_code"))
    out = rows.join(r, [F.col(k) == F.col(f"_r_{k}") for k in key], "left")
    has = F.col("_native") | F.col("_r_call_id").isNotNull()
    origin = F.when(F.col("_paired"), "call+native").when(F.col("_native"), "native").when(has, "call+result").otherwise("call")
    return out.select(
        *key, "command", "tool", "cwd", *CONTEXT, F.coalesce(F.when(F.col("_native"), F.col("_out")).otherwise(F.col("_r_out")), F.lit("")).alias("output"),
        F.when(F.col("_native"), F.col("_code")).otherwise(F.col("_r_code")).alias("exit_code"), has.alias("result_present"), origin.alias("origin"),
    )


def unmatched(results: DataFrame, calls: DataFrame, natives: DataFrame, key: list[str]) -> DataFrame:
    """The keys of results that neither a call nor a native event has."""
    known = calls.select(*key).unionByName(natives.select(*key)).distinct()
    return results.select(*key).distinct().join(known, key, "left_anti")


def identified(rows: DataFrame, kind: Column) -> DataFrame:
    """rows with record_id, command_sha256, output_sha256 and the label struct."""
    keyword = F.coalesce(F.col("output"), F.lit("")).rlike(r"(?i)\b(error|failed|exception)\b")
    cut = F.coalesce(F.col("output"), F.lit("")).rlike(r"(?i)tokens truncated|bytes omitted|<truncated")
    execution = F.when(F.col("exit_code").isNull(), "unknown").when(F.col("exit_code") == 0, "exit_zero").otherwise("exit_nonzero")
    return rows.withColumns({
        "record_id": digest(kind, F.col("session"), F.col("call_id"), F.col("command")), "command_sha256": digest(F.col("command")), "output_sha256": digest(F.coalesce(F.col("output"), F.lit(""))),
        "labels": F.struct(execution.alias("execution"), F.lit("abstain").alias("task_correctness"), cut.alias("source_truncation_marker"), keyword.alias("output_error_keyword"), F.lit("recorded_fields_and_heuristics_v1").alias("label_basis")),
    })
