"""Frozen partitions: identities, groups that stay together, balanced assignment and review.

Cases and their results:
- a null or short request ties nothing; repeated observations count once;
- groups are never split; without rows there is no assignment;
- rows never carry texts or paths of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.values import digest, read_contract, request_text, session_key, shell_text
from loomlog.operators.graph import propagate_labels
from loomlog.operators.sessions import first_per_key
from loomlog.util import cut

# The tags of a review, in order, and what each tests.
REASONS = ("missing_user_context", "context_truncated", "changing_source", "conflicting_call_id", "missing_result", "legacy_extraction_unverified")


def review_reasons(association: Column, truncated: Column, changed: Column, conflict: Column, present: Column, kind: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    tests = (association == "missing", truncated, changed, conflict, ~yes(present), kind == "legacy")
    return F.array_compact(F.array(*[F.when(yes(t), name) for name, t in zip(REASONS, tests)]))


def review_action(reasons: Column) -> Column:
    """What to do with an observation: the first that its tags call for."""
    has = lambda *names: F.arrays_overlap(reasons, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(has("legacy_extraction_unverified"), "reconcile_with_native_source").when(has("missing_user_context", "context_truncated", "missing_result"), "recover_context_or_result")
        .when(has("conflicting_call_id"), "inspect_conflicting_identity").otherwise("develop_task_verifier")
    )


def observations(commands: DataFrame) -> DataFrame:
    """One row per observation (record, command and output) with its keys, tags and read contract, and without any text of the source."""
    text = shell_text(F.col("command_text"), F.col("command_argv"))
    rows = commands.withColumns({"id": digest(F.col("record_id"), F.col("command_sha256"), F.col("output_sha256")), "_text": text, "_request": request_text(F.when(~F.coalesce("context_truncated", F.lit(False)), F.col("request_context")))})
    rows = rows.select(
        "id", "record_id", "source_kind", session_key(F.col("session"), F.col("source_kind")).alias("session_group"), digest(F.col("_request")).alias("task_key"),
        F.coalesce("parent_sessions", F.array().cast("array<string>")).alias("_parents"), F.col("call_pointer.snapshot").alias("artifact"), "command_sha256", "output_sha256", "labels", "exit_code_origin",
        review_reasons(F.col("context_association"), F.col("context_truncated"), F.lit(False), F.col("call_id_conflict"), F.col("result_present"), F.col("source_kind")).alias("review_reasons"),
        read_contract(F.col("_text")).alias("read_contract_candidate"), F.lit(False).alias("training_eligible"), F.lit("abstain").alias("correctness"), F.col("call_pointer.line").alias("_line"),
    )
    return first_per_key(rows, ["id"], "_line", "artifact").drop("_line")


def groups(rows: DataFrame) -> DataFrame:
    """(session_group, partition_group): sessions tied by parents or by a shared task; the smallest of a component names it."""
    parent = rows.select("session_group", F.explode("_parents").alias("p"), "source_kind").select("session_group", session_key(F.col("p"), F.col("source_kind")).alias("b"))
    name = lambda kind, c: F.concat(F.lit(kind), c).alias("entity")
    links = rows.select(F.col("session_group").alias("node"), name("task:", F.col("task_key")))
    links = links.unionByName(parent.select(F.col("session_group").alias("node"), name("parent:", F.col("b")))).unionByName(parent.select(F.col("b").alias("node"), name("parent:", F.col("b"))))
    roots = propagate_labels(links)
    return rows.select("session_group").distinct().join(roots, F.col("session_group") == F.col("node"), "left").select("session_group", F.coalesce("root", "session_group").alias("partition_group"))


# Shares of the partitions.
SHARES = {"train": 0.30, "development": 0.10, "reserve": 0.50, "final_test": 0.10}
#: groups up to which a bin of small groups is filled; groups above their share of one bin are placed one by one
BINS = 2048


def balanced(sizes: DataFrame, shares: dict[str, float], seed: str) -> DataFrame:
    """(partition_group, partition) of groups (partition_group, n): whole groups, row counts close to the shares.

    The largest group goes first to the partition that lacks most. Only groups above 1/BINS of all rows are placed one by
    one; the others are dealt by digest into bins that are placed as wholes, so the driver sees at most 2 * BINS numbers
    however many groups there are. The result depends on the seed and the groups only, never on the order of rows.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    drawn = F.sha2(F.concat_ws("\x01", F.lit(seed), F.col("partition_group")), 256)
    bin_of = F.concat(F.lit("bin:"), (F.conv(F.left(drawn, F.lit(8)), 16, 10).cast("long") % BINS).cast("string"))
    keyed = cut(sizes.withColumn("unit", F.when(F.col("n") * BINS >= total, F.concat(F.lit("one:"), "partition_group")).otherwise(bin_of)))
    units = keyed.groupBy("unit").agg(F.sum("n").alias("n")).withColumn("draw", F.sha2(F.concat_ws("\x01", F.lit(seed), "unit"), 256)).collect()  # at most 2 * BINS rows
    lacking = {name: share * total for name, share in shares.items()}
    placed = []
    for unit in sorted(units, key=lambda u: (-u["n"], u["draw"])):
        name = max(lacking.items(), key=lambda x: (x[1], x[0]))[0]
        lacking[name] -= unit["n"]
        placed.append((unit["unit"], name))
    of = sizes.sparkSession.createDataFrame(placed, "unit string, partition string")
    return keyed.join(F.broadcast(of), "unit").select("partition_group", "partition")  # at most 2 * BINS rows


def freeze(commands: DataFrame, shares: dict[str, float] | None = None, seed: str = "v1") -> DataFrame:
    """Observations with partition_group and partition."""
    rows = cut(observations(commands))
    tied = cut(groups(rows))
    rows = rows.drop("_parents").join(tied, "session_group")
    return rows.join(balanced(rows.groupBy("partition_group").agg(F.count("*").alias("n")), shares or SHARES, seed), "partition_group")


def queue(rows: DataFrame) -> DataFrame:
    """Counts of observations to review: per action, source, outcome, error word and read candidate the records and distinct commands."""
    labelled = review_key(rows)
    return labelled.groupBy(*REVIEW_KEY).agg(F.count("*").alias("record_count"), F.countDistinct("command_sha256").alias("unique_commands"))


REVIEW_KEY = ("action", "source_kind", "execution", "error_keyword", "read_candidate")


def review_key(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"action": review_action(F.col("review_reasons")), "execution": F.col("labels.execution"), "error_keyword": F.col("labels.output_error_keyword"), "read_candidate": F.col("read_contract_candidate").isNotNull()})


def queue_samples(rows: DataFrame, k: int = 3) -> DataFrame:
    """(key, id, record_id, rank): of each review group the first k rows by id among the first rows of distinct commands."""
    one = first_per_key(review_key(rows).select(*REVIEW_KEY, "command_sha256", "id", "record_id"), [*REVIEW_KEY, "command_sha256"], "id", "record_id")
    w = Window.partitionBy(*REVIEW_KEY).orderBy("id", "record_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("command_sha256")


def only_partition(rows: DataFrame, name: str) -> DataFrame:
    """rows, which must all be of one partition: a row of another raises an error when it is read."""
    wrong = F.raise_error(F.concat(F.lit(f"row outside {name}: "), F.coalesce(F.col("partition"), F.lit("null")))).cast("boolean")
    return rows.where(F.when(F.coalesce(F.col("partition") == name, F.lit(False)), F.lit(True)).otherwise(wrong))


def safe_for_training(rows: DataFrame) -> DataFrame:
    """rows without doubtful identity or changing source."""
    return rows.where(~F.arrays_overlap("review_reasons", F.array(F.lit("conflicting_call_id"), F.lit("changing_source"))))


# Wordings of a read request.
WORDINGS = {
    "read_head": ["Read the first %d lines of %s.", "Show only the opening %d lines from %s.", "Display the first %d lines in %s."],
    "read_tail": ["Read the last %d lines of %s.", "Show only the closing %d lines from %s.", "Display the last %d lines in %s."],
}


def wordings(contracts: DataFrame) -> DataFrame:
    """Three requests (op, limit, wording, request) for each distinct (op, limit, path)."""
    one = contracts.select("op", "limit", "path").distinct()
    texts = F.when(F.col("op") == "read_tail", F.array(*[F.lit(w) for w in WORDINGS["read_tail"]])).otherwise(F.array(*[F.lit(w) for w in WORDINGS["read_head"]]))
    out = one.select("*", F.posexplode(texts).alias("wording", "template"))
    return out.select("op", "limit", "wording", F.replace(F.replace("template", F.lit("%d"), F.col("limit").cast("string")), F.lit("%s"), F.col("path")).alias("request"))


def chat(requests: DataFrame, system: str) -> DataFrame:
    """requests with `messages`, the conversation of a system text, the request and its answer (`answer`)."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return requests.withColumn("messages", F.array(turn("system", F.lit(system)), turn("user", F.col("request")), turn("assistant", F.col("answer"))))


def numbered(lines: Column) -> Column:
    """The lines of an array, each with its number, as one text."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def parents(metadata: Column, keys: tuple[str, ...] = ("parent_thread_id", "parent_session_id", "forked_from_id")) -> Column:
    """The texts under the given keys of a JSON text, at any depth, each once; null gives none."""
    found = [F.regexp_extract_all(metadata, F.lit(f'"{k}"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"'), 1) for k in keys]
    return F.array_distinct(F.concat(*[F.coalesce(f, F.array().cast("array<string>")) for f in found]))
