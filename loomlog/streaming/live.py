"""The same questions on streams: first-seen calls, calls joined with results, daily rates, recovery.

State is bounded by watermarks: what comes later than the delay is dropped, as
in any stream. Projections are those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(calls: DataFrame, key: list[str], time: str = "at", delay: str = "1 hour") -> DataFrame:
    """Each id once within the delay."""
    return calls.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def paired(calls: DataFrame, results: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Calls (session, call_id, at, command) with their results (session, call_id, at, output); a call without one comes out once its time is past."""
    c = calls.withWatermark("at", delay).alias("c")
    r = results.withWatermark("at", delay).alias("r")
    on = (F.col("c.session") == F.col("r.session")) & (F.col("c.call_id") == F.col("r.call_id")) & (F.col("r.at") >= F.col("c.at")) & (F.col("r.at") <= F.col("c.at") + F.expr(f"INTERVAL {delay}"))
    return c.join(r, on, "left_outer").select("c.session", "c.call_id", "c.at", "c.command", F.col("r.output").alias("output"), F.col("r.call_id").isNotNull().alias("result_present"))


def daily_rates(records: DataFrame, time: str = "at", delay: str = "1 day") -> DataFrame:
    """Commands and failures per day and source."""
    days = records.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w"), "source")
    return days.agg(F.count("*").alias("n"), F.count_if(F.col("ok") == F.lit(False)).alias("fail")).select(F.col("w.start").alias("day"), "source", "n", "fail")


FOLLOWED = "session string, cmd string, next_cmd string, outcome string"
_STATE = "cmd string, failed boolean, at double"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else (None, False, float("-inf"))
    out = []
    for row in pd.concat(list(frames)).sort_values("at").itertuples():
        if held[1]:
            out.append((key[0], held[0], row.cmd, "then ok" if row.ok is True or row.ok == True else "still failing"))  # noqa: E712
        held = (row.cmd, bool(row.ok is not None and row.ok == False and row.cmd), row.at.timestamp())  # noqa: E712
    state.update(held)
    yield pd.DataFrame(out, columns=[x.split()[0] for x in FOLLOWED.split(", ")])


def recovery(records: DataFrame) -> DataFrame:
    """What follows each failed command of a session: only the last command of a session is kept as state."""
    return records.select("session", "at", "cmd", "ok").groupBy("session").applyInPandasWithState(_follow, FOLLOWED, _STATE, "append", GroupStateTimeout.NoTimeout)
