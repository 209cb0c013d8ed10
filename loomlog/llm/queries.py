"""Queries of the problems tagged llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import components, conversations, overlap, packing, pii, sentences, tokens
from loomlog.util import clean_digest, clean_key, spread, table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- problem 4

#: fixed value: the SHA-256 of the empty text, which stands for no request
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def request_key(c: Column) -> Column:
    """A task_key in its one spelling; null where it stands for no request."""
    key = clean_digest(c)
    return F.when(key != EMPTY_SHA256, key)


def _digest_sql(c: str) -> str:
    bare = f"regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '^sha-?256[:=]\\s*', '')"
    return f"CASE WHEN regexp_matches({bare}, '^[0-9a-f]{{64}}$') THEN {bare} END"


ORACLES["p4_found"] = f"""WITH RECURSIVE f AS (SELECT DISTINCT g, k FROM (SELECT {_digest_sql('session_group')} AS g, nullif({_digest_sql('task_key')}, '{EMPTY_SHA256}') AS k FROM frozen_rows) WHERE g IS NOT NULL AND k IS NOT NULL),
e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM f x JOIN f y ON x.k = y.k), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT min(b) AS group_a, a AS group_b FROM r GROUP BY a HAVING min(b) < a"""


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every session group that is tied to a smaller one, with the smallest of its component."""
    tied = components.tie(table(spark, d, "frozen_rows"), clean_digest(F.col("session_group")), request_key(F.col("task_key")))
    return tied.where("root < grp").select(F.col("root").alias("group_a"), F.col("grp").alias("group_b"))


@query
def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """The new partition of every row; rows tied by a session group or a request are in one partition."""
    targets = table(spark, d, "split_targets").where("partition is not null").collect()  # a fixed table of four rows
    rows = components.rooted(table(spark, d, "frozen_rows"), F.col("id"), clean_digest(F.col("session_group")), request_key(F.col("task_key")), F.col("labels.execution"))
    return components.splits(rows, {r["partition"]: r["share"] for r in targets}).withColumnRenamed("split", "partition")


# ---- problem 5


def _v2_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The sessions that records name and that are kept in a store of version 2."""
    named = table(spark, d, "records").select(clean_key(F.col("session")).alias("session_id")).distinct()
    return named.join(table(spark, d, "sessions").where(clean_key(F.col("store")) == "v2").select(clean_key(F.col("id")).alias("session_id")), "session_id", "left_semi")


def _clean_sql(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


_SPEAKERS_SQL = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in conversations.SPEAKERS.items()) + " END"
ORACLES["p5_found"] = f"""WITH m AS (SELECT {_clean_sql('session_id')} AS s, seq, type, CASE WHEN json_valid(data) AND json_type(data) = 'OBJECT' THEN CAST(data AS JSON) END AS d FROM session_message WHERE session_id IS NOT NULL),
k AS (SELECT s, seq, d, CASE WHEN d IS NULL OR seq IS NULL THEN NULL ELSE {_SPEAKERS_SQL.format("coalesce(nullif(" + _clean_sql('type') + ", ''), " + _clean_sql("d ->> '$.role'") + ")")} END AS who FROM m),
c AS (SELECT *, CASE json_type(d, '$.content') WHEN 'ARRAY' THEN json_extract(d, '$.content') WHEN 'NULL' THEN CAST('[]' AS JSON) ELSE CASE WHEN json_extract(d, '$.content') IS NULL THEN CAST('[]' AS JSON) ELSE json_array(json_extract(d, '$.content')) END END AS x FROM k),
g AS (SELECT DISTINCT s, seq, who, x FROM c WHERE who IS NOT NULL),
b AS (SELECT s, seq, who, json_extract(x, '$[' || i || ']') AS e FROM (SELECT *, unnest(range(CAST(json_array_length(x) AS BIGINT))) AS i FROM g)),
t AS (SELECT s, seq, who, CASE WHEN json_type(e) = 'VARCHAR' THEN 'text' ELSE coalesce(e ->> '$.type', 'text') END AS kind, CASE WHEN json_type(e) = 'VARCHAR' THEN e ->> '$' WHEN json_type(e, '$.text') = 'VARCHAR' THEN e ->> '$.text' END AS txt, e ->> '$.id' AS id, e ->> '$.tool_use_id' AS rid FROM b WHERE json_type(e) IN ('VARCHAR', 'OBJECT')),
q AS (SELECT s, seq, any_value(who) AS who, coalesce(bool_or(kind IN ('tool_use', 'tool_result')), false) AS tool, coalesce(bool_or(kind NOT IN ('tool_use', 'tool_result') AND regexp_matches(txt, '\\S')), false) AS said FROM (SELECT g.s, g.seq, g.who, t.kind, t.txt FROM g LEFT JOIN t ON g.s = t.s AND g.seq = t.seq AND g.who = t.who) GROUP BY s, seq),
v AS (SELECT s, seq, who, lead(CASE WHEN who = 'assistant' THEN 'a' ELSE 'u' END) OVER (PARTITION BY s ORDER BY seq) AS nxt FROM q WHERE who = 'assistant' OR who = 'user' AND said),
ids AS (SELECT s, id, min(u) AS u, min(r) AS r FROM (SELECT s, id, seq AS u, NULL AS r FROM t WHERE kind = 'tool_use' AND id IS NOT NULL UNION ALL SELECT s, rid, NULL, seq FROM t WHERE kind = 'tool_result' AND rid IS NOT NULL) GROUP BY s, id),
f AS (SELECT s, bool_or(who IS NULL) AS unreadable, max(seq) - min(seq) + 1 > count(DISTINCT seq) AS gap FROM k GROUP BY s),
a AS (SELECT s FROM m UNION SELECT s FROM (SELECT {_clean_sql('session')} AS s FROM records) WHERE s IN (SELECT {_clean_sql('id')} FROM sessions WHERE {_clean_sql('store')} = 'v2')),
z AS (SELECT a.s, f.s IS NULL OR NOT f.unreadable AND NOT coalesce((SELECT bool_or(who <> 'system' AND (said OR tool)) FROM q WHERE q.s = a.s), false) AS nothing,
f.unreadable OR coalesce(f.gap, false) OR EXISTS (SELECT 1 FROM g WHERE g.s = a.s GROUP BY seq HAVING count(*) > 1) OR coalesce((SELECT arg_min(who, seq) FROM q WHERE q.s = a.s AND who <> 'system') <> 'user', false) OR EXISTS (SELECT 1 FROM ids WHERE ids.s = a.s AND r IS NOT NULL AND (u IS NULL OR r <= u)) AS bad,
EXISTS (SELECT 1 FROM v WHERE v.s = a.s AND who = 'user' AND coalesce(nxt, 'u') = 'u') OR EXISTS (SELECT 1 FROM ids WHERE ids.s = a.s AND u IS NOT NULL AND r IS NULL) AS lost FROM a LEFT JOIN f ON a.s = f.s)
SELECT s AS session_id, CASE WHEN nothing THEN 'empty' WHEN bad THEN 'broken' ELSE 'missing_reply' END AS reason FROM z WHERE nothing OR bad OR lost"""


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The sessions that are dropped, with the reason."""
    return conversations.defects(table(spark, d, "session_message"), _v2_sessions(spark, d)).where("reason is not null")


@query
def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the sound conversations in order."""
    messages = table(spark, d, "session_message")
    return conversations.turns(messages, conversations.defects(messages, _v2_sessions(spark, d)))


# ---- problem 8


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode(spread(table(spark, d, "documents").select("doc_id", "text")))


# ---- problem 3

# Other names of the partitions.
PARTITION_NAMES = {"training": "train", "dev": "development", "test": "final_test"}


def partition_name(c: Column) -> Column:
    """A partition in its one spelling."""
    bare = F.regexp_replace(clean_key(c), r"[\s_-]+", "_")
    return F.coalesce(*[F.when(bare == a, b) for a, b in PARTITION_NAMES.items()], bare)


def _split_rows(spark: SparkSession, d: str) -> DataFrame:
    """frozen_rows with request, command and whether the partition is an evaluation split; null for other partitions."""
    targets = table(spark, d, "split_targets").select(partition_name(F.col("partition")).alias("split"), "is_evaluation")
    # the table repeats rows: each text of a record once, by its digest
    commands = table(spark, d, "commands_normalized").select("record_id", F.col("request_context").alias("request"), F.coalesce("command_text", F.try_element_at("command_argv", F.lit(-1))).alias("command"))
    commands = commands.withColumn("_d", F.xxhash64("request", F.lit("\x01"), "command")).dropDuplicates(["record_id", "_d"]).drop("_d")
    rows = table(spark, d, "frozen_rows").select("id", "record_id", "source_kind", partition_name(F.col("partition")).alias("split")).distinct()
    # of the splits without evaluation only train is compared
    rows = rows.join(F.broadcast(targets), "split").where("is_evaluation or split = 'train'")  # a fixed table of four rows
    return rows.join(commands, "record_id")


_NAME_SQL = "regexp_replace(" + _clean_sql("partition") + ", '[\\s_-]+', '_', 'g')"
_SPLIT_SQL = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PARTITION_NAMES.items()) + " ELSE {0} END"
_TEXT_SQL = "trim(lower(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')))"
_NEAR_SQL = "abs(length(t.{0}) - length(e.{0})) <= greatest(length(t.{0}), length(e.{0})) // 5 AND levenshtein(t.{0}, e.{0}) <= greatest(length(t.{0}), length(e.{0})) // 5"
#: every train row against every evaluation row, which only small tables allow
_OVERLAPS_SQL = f"""WITH g AS (SELECT {_SPLIT_SQL.format(_NAME_SQL)} AS split, is_evaluation FROM split_targets),
f AS (SELECT DISTINCT id, record_id, source_kind, {_SPLIT_SQL.format(_NAME_SQL)} AS split FROM frozen_rows),
x AS (SELECT DISTINCT f.id, f.split, f.source_kind, g.is_evaluation AS held, {_TEXT_SQL.format('c.request_context')} AS request, {_TEXT_SQL.format('coalesce(c.command_text, c.command_argv[-1])')} AS command FROM f JOIN g USING (split) JOIN commands_normalized c ON f.record_id = c.record_id WHERE g.is_evaluation OR f.split = 'train'),
n AS (SELECT * FROM x WHERE len(string_split(request, ' ')) >= 8),
p AS (SELECT DISTINCT t.id AS a, e.id AS b FROM n t JOIN n e ON NOT t.held AND e.held AND t.id <> e.id AND {_NEAR_SQL.format('command')} AND {_NEAR_SQL.format('request')}) """
ORACLES["p3_found"] = _OVERLAPS_SQL + "SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM p"
ORACLES["p3_report"] = _OVERLAPS_SQL + ", i AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id) SELECT split, source_kind, count(*) AS n_rows, count(n) AS n_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs FROM (SELECT DISTINCT id, split, source_kind FROM x) LEFT JOIN i USING (id) GROUP BY split, source_kind"


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a train and an evaluation row whose requests and commands are equal or almost equal."""
    return overlap.cross_pairs(_split_rows(spark, d))


@query
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source kind: how many rows have an overlap across the splits, and with how many rows in all."""
    rows = _split_rows(spark, d)
    ids = overlap.partners(rows)
    kinds = rows.select("id", "split", "source_kind").distinct()
    return kinds.join(ids, "id", "left").groupBy("split", "source_kind").agg(F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))


# ---- problem 6


def _scan(spark: SparkSession, d: str, redacted: bool) -> DataFrame:
    given = [r[0] for r in table(spark, d, "given_names").select("given_name").where("given_name is not null").collect()]  # a fixed table of sixty rows
    records = pii.scan(spread(table(spark, d, "records").select("ordinal", "cmd", "out", "cwd")), "records", "ordinal", ["cmd", "out", "cwd"], given, redacted)
    requests = table(spark, d, "commands_normalized").select("record_id", "request_context").distinct()
    return records.unionByName(pii.scan(requests, "commands_normalized", "record_id", ["request_context"], given, redacted))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of personal information each field holds."""
    return _scan(spark, d, False)


@query
def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders in the place of personal information."""
    return _scan(spark, d, True)


# ---- problem 10


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of every document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    profiles = sentences.learn_profiles(docs)
    return sentences.split(docs, sentences.learn(docs, profiles), profiles)


# ---- problem 9

#: fixed value: the capacity of a container in tokens
CAPACITY = 2048


@query
def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every part of a document that is longer than a container."""
    return packing.pack(tokens.count(spread(table(spark, d, "documents").select("doc_id", "text"))), CAPACITY)
