"""Session analytics: what follows a failure, and values carried forward within a session.

A session may hold a third of all rows, so none is ordered in one task: windows
run over chunks of a session (an hour of it, or a range of its numbers), and one
row per chunk tells what the next chunk begins with or the last one ended with.

Cases and their results:
- ok null is neither failure nor success: it is not followed up, and as a next
  row it counts as still failing;
- a failure whose next row has no command, or that is the last, is abandoned;
- equal times are ordered by `ordinal`; rows of unknown time come first;
- no rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Text without any white space around it, line ends included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def time_chunk(ms: Column, ordinal: Column) -> list[Column]:
    """Chunks of rows ordered by milliseconds and ordinal: an hour each; rows of unknown time, which have 0, by their ordinals."""
    return [F.floor(ms / 3_600_000), F.when(ms == 0, F.floor(ordinal / 100_000)).otherwise(F.lit(0))]


def _with_chunks(rows: DataFrame, chunk: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_chunk{i}" for i in range(len(chunk))]
    return rows.withColumns(dict(zip(names, chunk))), names


def _beside(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of facts, one row per chunk, whose key columns are named `on` behind a `k`."""
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.k{c}")) for c in on]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return rows.alias("r").join(facts.alias("f"), condition, "left").drop(*[F.col(f"f.k{c}") for c in on])


def following(rows: DataFrame, key: list[str], order: list[str], chunk: list[Column], value: Column, out: str) -> DataFrame:
    """rows with the value (a struct, never null) of the row that follows in its partition; order is total and ascending along the chunks."""
    rows, chunks = _with_chunks(rows.withColumn("_value", value), chunk)
    by = [*key, *chunks]
    inside = rows.withColumn("_inside", F.lead("_value").over(Window.partitionBy(*by).orderBy(*order)))
    firsts = rows.groupBy(*[F.col(c).alias(f"k{c}") for c in by]).agg(F.min_by("_value", F.struct(*order)).alias("_first"))
    facts = firsts.withColumn("_next", F.lead("_first").over(Window.partitionBy(*[f"k{c}" for c in key]).orderBy(*[f"k{c}" for c in chunks]))).drop("_first")  # one row per chunk
    return _beside(inside, facts, by).withColumn(out, F.coalesce("_inside", "_next")).drop("_inside", "_next", "_value", *chunks)


def recovery(records: DataFrame) -> DataFrame:
    """(source, session, ordinal, family, cause, cmd, next_cmd, kind, outcome) of every failed command.

    records: with source, session, sort_ms, ordinal, family, cause, cmd, tool, dialect, interp0 and ok. The next row
    is looked up before the failures are picked.
    """
    rows = records.select("source", "session", "sort_ms", "ordinal", "family", "cause", "cmd", "tool", "dialect", "interp0", "ok")
    rows = following(rows, ["source", "session"], ["sort_ms", "ordinal"], time_chunk(F.col("sort_ms"), F.col("ordinal")), F.struct("cmd", "dialect", "tool", "interp0", "ok"), "n")
    rows = rows.where((F.col("ok") == F.lit(False)) & (F.coalesce(F.col("cmd"), F.lit("")) != ""))
    none = F.lit("none")
    switched = lambda what, a, b: F.concat(F.lit(f"switched {what} "), a, F.lit("->"), b)
    here, there = F.coalesce("interp0", none), F.coalesce("n.interp0", none)
    gone = F.coalesce(F.col("n.cmd"), F.lit("")) == ""
    kind = (
        F.when(gone, "abandon/other-tool").when(strip(F.col("n.cmd")) == strip(F.col("cmd")), "identical retry")
        .when(F.col("n.dialect") != F.col("dialect"), switched("dialect", F.col("dialect"), F.col("n.dialect")))
        .when(~F.col("n.tool").eqNullSafe(F.col("tool")), switched("tool", F.coalesce("tool", none), F.coalesce("n.tool", none)))
        .when(here != there, switched("interpreter", here, there)).otherwise("rewrote same dialect")
    )
    outcome = F.when(gone, F.lit(None)).when(F.col("n.ok"), "then ok").otherwise("still failing")
    return rows.select("source", "session", "sort_ms", "ordinal", "family", "cause", "cmd", F.col("n.cmd").alias("next_cmd"), kind.alias("kind"), outcome.alias("outcome"))


def carry_forward(rows: DataFrame, key: list[str], order: list[str], chunk: list[Column], values: dict[str, str], strictly_before: bool = True) -> DataFrame:
    """rows with, for each {new column: column}, the last value that is not null before (or up to) the row in its partition."""
    kept = rows.columns
    rows, chunks = _with_chunks(rows, chunk)
    by = [*key, *chunks]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strictly_before else 0)
    inside = rows.withColumns({f"_in_{new}": F.last(F.col(old), ignorenulls=True).over(w) for new, old in values.items()})
    last = {new: F.max_by(F.col(old), F.when(F.col(old).isNotNull(), F.struct(*order))).alias(f"_last_{new}") for new, old in values.items()}
    ends = rows.groupBy(*[F.col(c).alias(f"k{c}") for c in by]).agg(*last.values())
    before = Window.partitionBy(*[f"k{c}" for c in key]).orderBy(*[f"k{c}" for c in chunks]).rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    facts = ends.select(*[f"k{c}" for c in by], *[F.last(f"_last_{new}", ignorenulls=True).over(before).alias(f"_was_{new}") for new in values])
    out = _beside(inside, facts, by)
    return out.select(*[F.col(f"r.{c}") for c in kept], *[F.coalesce(f"_in_{new}", f"_was_{new}").alias(new) for new in values])


def first_per_key(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of every key in a total order; each task keeps one row per key before the shuffle.

    A null key is a key like any other.
    """
    sort = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(whole, sort).alias("_row")).select("_row.*")
