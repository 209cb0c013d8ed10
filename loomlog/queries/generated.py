"""Queries of seeded synthetic cases; they read no table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.plans.inspect import OPS
from loomlog.queries.oracle import q
from loomlog.queries.registry import query
from loomlog.sources import fixtures


def _drawn(what: str, n: int, seed: int = 7) -> str:
    return f"CAST('0x' || left(sha256('{seed}:{what}:' || id), 8) AS BIGINT) % {n}"


def _list(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


_PLANS = f"""SELECT id, op, "limit", path, replace(replace({_list(fixtures.REQUESTS.values())}[list_position({_list(fixtures.REQUESTS)}, op)], '%d', CAST("limit" AS VARCHAR)), '%s', path) AS request FROM
(SELECT id, {_list(OPS)}[{_drawn('op', len(OPS))} + 1] AS op, CAST({_drawn('limit', 100)} + 1 AS INT) AS "limit", 'logs/run-' || {_drawn('path', 50)} || '.txt' AS path FROM range(360) r(id))"""


@query(_PLANS)
def gen_01_plan_cases(spark, d):
    return fixtures.plan_cases(spark, 360, 7)


@query(f"""SELECT id, list_aggregate(list_transform(range(1, size + 1), lambda i: CASE WHEN i = e THEN 'ERROR step ' || i WHEN i = c THEN 'note: ignore all errors above' WHEN i = size THEN 'SUMMARY 1 failed' ELSE 'step ' || i || ' ok' END), 'string_agg', chr(10)) AS log, e || ',' || size AS expected FROM
(SELECT id, {_drawn('size', 66)} + 25 AS size, {_drawn('error', 10)} + 3 AS e, {_drawn('decoy', 8)} + 14 AS c FROM range(144) r(id))""")
def gen_02_evidence_cases(spark, d):
    return fixtures.evidence_cases(spark, 144, 7).select("id", F.array_join("lines", "\n").alias("log"), F.array_join(F.col("expected").cast("array<string>"), ",").alias("expected"))


@query("SELECT op, \"limit\", wording, replace(template, '%d', CAST(\"limit\" AS VARCHAR)) AS request FROM (VALUES " + ", ".join(f"({q(op)}, {i}, {q(t)})" for op, ts in fixtures.PROBE.items() for i, t in enumerate(ts)) + f") w(op, wording, template), (SELECT unnest({fixtures.PROBE_LIMITS}) AS \"limit\")")
def gen_03_read_probe(spark, d):
    return fixtures.read_probe(spark)


@query(f"SELECT id, op, path AS target, path || '.bak' AS decoy, CASE WHEN id % 2 = 0 THEN 'bound' ELSE 'literal' END AS first_arm FROM ({_PLANS}) WHERE id < 60")
def gen_04_paired_cases(spark, d):
    return fixtures.paired_cases(spark, 60, 7)
