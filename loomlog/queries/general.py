"""Queries of the general training-data problems 1, 2 and 7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators import drift, instants, nested
from loomlog.queries import instants_sql
from loomlog.queries.registry import query
from loomlog.util import clean_key, spread, table


def _instants(spark: SparkSession, d: str, where: Column) -> DataFrame:
    rows = [
        table(spark, d, "records").select(F.lit("records").alias("tbl"), F.col("ordinal").cast("string").alias("row_key"), "session", F.col("ts").cast("string").alias("value")),
        table(spark, d, "session_message")
        .select(F.lit("session_message").alias("tbl"), F.col("id").alias("row_key"), F.col("session_id").alias("session"), F.col("time_created").cast("string").alias("value")),
        table(spark, d, "commands_normalized")
        .select(F.lit("commands_normalized").alias("tbl"), F.col("record_id").alias("row_key"), "session", F.col("timestamp").cast("string").alias("value")),
    ]
    zones = table(spark, d, "sessions").groupBy(clean_key(F.col("id")).alias("zone_key")).agg(F.min("tz").alias("tz")).where("zone_key is not null")
    return instants.normalise(rows[0].unionByName(rows[1]).unionByName(rows[2]).where(where), "value", clean_key(F.col("session")), zones)


@query(instants_sql.ALL)
def p2_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every timestamp of the three tables with its instant, null where it denotes none."""
    return _instants(spark, d, F.lit(True)).select("tbl", "row_key", "value", "epoch_ms").distinct()  # repeated rows go where only the results are left


@query(instants_sql.FOUND)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The instants of all values that are not yet in the one canonical form."""
    canonical = F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$") & ~F.col("value").contains("\n")
    return _instants(spark, d, ~canonical).where(F.col("epoch_ms").isNotNull()).select("tbl", "row_key", "epoch_ms").distinct()


def _json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every JSON field of the two nested tables as a row; repeated rows are dropped after they are read, as the results are far smaller than the texts."""
    lines, parts = table(spark, d, "transcript_lines"), table(spark, d, "oc_part")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("message", "toolUseResult")])
    of_lines = spread(lines.select("line_id", "message", "toolUseResult")).select(F.lit("transcript_lines").alias("tbl"), F.col("line_id").cast("string").alias("row_key"), F.inline(fields))
    of_parts = spread(parts.select("id", "data")).select(F.lit("oc_part").alias("tbl"), F.col("id").alias("row_key"), F.lit("data").alias("field"), F.col("data").alias("value"))
    return of_lines.unionByName(of_parts).where("value is not null")


#: every JSON node below every field, level by level; `block` marks the elements of a content
_NODES = r"""WITH RECURSIVE f AS (SELECT DISTINCT tbl, row_key, field, CAST(value AS JSON) AS v FROM (SELECT 'transcript_lines' AS tbl, CAST(line_id AS VARCHAR) AS row_key, 'message' AS field, message AS value FROM transcript_lines UNION ALL SELECT 'transcript_lines', CAST(line_id AS VARCHAR), 'toolUseResult', toolUseResult FROM transcript_lines UNION ALL SELECT 'oc_part', id, 'data', data FROM oc_part) WHERE json_valid(value)),
n AS (SELECT tbl, row_key, field, '' AS path, v, false AS block, '' AS parent_path, 0 AS pos FROM f UNION ALL
SELECT tbl, row_key, field, name || CASE WHEN single THEN '' ELSE '[' || i || ']' END, json_extract(arr, '$[' || i || ']'), block, name, CAST(i AS INT) FROM (SELECT *, unnest(range(CAST(json_array_length(arr) AS BIGINT))) AS i FROM
(SELECT tbl, row_key, field, name, k = 'content' AND json_type(c) IN ('VARCHAR', 'OBJECT', 'ARRAY') AS block, NOT (k = 'content') AND json_type(c) = 'OBJECT' AS single, CASE WHEN json_type(c) = 'ARRAY' THEN c WHEN k = 'content' AND json_type(c) = 'VARCHAR' AND left(ltrim(c ->> '$'), 1) = '[' AND json_valid(c ->> '$') THEN CAST(c ->> '$' AS JSON) WHEN k = 'content' AND json_type(c) IN ('VARCHAR', 'OBJECT') OR json_type(c) = 'OBJECT' THEN json_array(c) END AS arr FROM
(SELECT tbl, row_key, field, k, CASE WHEN k IS NULL THEN path WHEN path = '' THEN k ELSE path || '.' || k END AS name, CASE WHEN k IS NULL THEN v ELSE json_extract(v, '$."' || k || '"') END AS c FROM (SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v) WHEN 'ARRAY' THEN [NULL] ELSE [] END) AS k FROM n))) WHERE arr IS NOT NULL) WHERE json_type(arr, '$[' || i || ']') <> 'NULL') """


@query(_NODES + "SELECT DISTINCT tbl, row_key, field, parent_path, pos, coalesce(v ->> '$.type', 'text') AS block_type FROM n WHERE block")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every element stored under a key `content`, with its parent path and position."""
    blocks = nested.flatten(_json_fields(spark, d), only="block")
    return blocks.select("tbl", "row_key", "field", "parent_path", "pos", "block_type").distinct()


@query()
def p7_tables(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of the nested fields as tagged rows; `parent` is the path of a row of the same field, null for the root."""
    return nested.flatten(_json_fields(spark, d)).distinct()


# The scalar members of the nodes of each tag.
COLUMNS = {
    "record": "type string, role string, model string, tool string, callID string, text string, stdout string, stderr string, interrupted boolean, status string, agentId string",
    "block": "type string, text string, id string, tool_use_id string, name string, title string, is_error boolean, value string",
    "object": "status string, command string, description string, output string, start bigint, end bigint, exit int, kind string, media string, data string, read bigint",
    "item": "name string, lines int, value string, oldStart int",
}


def _typed(spark: SparkSession, d: str, tag: str) -> DataFrame:
    """The flat table of one tag with typed columns and the keys of node and parent."""
    return nested.typed_table(nested.flatten(_json_fields(spark, d), only=tag).distinct(), tag, COLUMNS[tag])


@query()
def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """The roots of all readable fields as a flat table."""
    return _typed(spark, d, "record")


@query()
def p7_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The content blocks as a flat table."""
    return _typed(spark, d, "block")


@query()
def p7_objects(spark: SparkSession, d: str) -> DataFrame:
    """The nested objects as a flat table."""
    return _typed(spark, d, "object")


@query()
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The elements of all other arrays as a flat table."""
    return _typed(spark, d, "item")


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of the fields from one file of a store to the next."""
    return drift.changes(table(spark, d, "raw_logs")).select("store", "file_no", "field", "change")


@query()
def p1_table(spark: SparkSession, d: str) -> DataFrame:
    """All lines of raw_logs in one consistent table, with the values that did not fit."""
    return drift.consistent(table(spark, d, "raw_logs"))


@query()
def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """How many values each path of raw_logs, nested ones included, has of each type in each file."""
    return drift.paths(table(spark, d, "raw_logs"))
