"""Conversations rebuilt from message rows (problem 5).

Rows are read once in Arrow batches. The reply graph of a session ties each
message to the one before it and each tool result to the use that it names.
It is sorted topologically with Kahn's algorithm, ties broken by time, in
blocks of BLOCK consecutive sequence numbers, so a session with a third of all
rows is dealt to many tasks. Whether a result comes before its use, or a use has
no result, is decided by one aggregate over the first use and the first result
of each tool id in all blocks.

Cases and their results:
- a session id counts without blanks and case; the speaker is the type, or the
  role inside data where the type is missing, in any spelling;
- data that is null or no object, a row without speaker or without seq cannot
  be read;
- repeated rows count once; two rows of one seq that differ in speaker or
  content break the session;
- system messages take no turn; content null is a message without visible text;
- a session without rows is empty.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators.nested import read_json
from loomlog.util import clean_key, cut

#: sequence numbers that one task sorts at a time
BLOCK = 4096

# The spellings of each speaker.
SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "ai": "assistant", "bot": "assistant", "system": "system", "developer": "system"}

ROW = "session_id string, seq long, speaker string, text string, time string, visible boolean, user_text boolean, uses array<string>, results array<string>, digest string"
SUMMARY = (
    "session_id string, block long, n_seq long, min_seq long, max_seq long, unreadable boolean, differs boolean, visible boolean, "
    "opener string, first_event string, last_event string, unanswered boolean, ids array<string>, first_uses array<long>, first_results array<long>"
)


def _speaker(kind, data: dict) -> str | None:
    for name in (kind, data.get("role")):
        if isinstance(name, str) and name.strip():
            return SPEAKERS.get(name.strip().lower())
    return None


def read_row(kind: str | None, seq: int | None, raw: str | None) -> tuple:
    """(speaker, text, visible, user_text, uses, results, digest) of one row; speaker is null if it cannot be read."""
    ok, data = read_json(raw)
    speaker = _speaker(kind, data) if ok and isinstance(data, dict) else None
    if speaker is None or seq is None:
        return None, None, False, False, [], [], None
    content = data.get("content")
    blocks = content if isinstance(content, list) else [] if content is None else [content]
    texts, uses, results, tools, plain = [], [], [], False, []
    for x in blocks:
        if isinstance(x, str):
            x = {"type": "text", "text": x}
        plain.append(x)
        if not isinstance(x, dict):
            continue
        kind_of = x.get("type", "text")
        if kind_of == "tool_use":
            tools = True
            uses += [x["id"]] if isinstance(x.get("id"), str) else []
        elif kind_of == "tool_result":
            tools = True
            results += [x["tool_use_id"]] if isinstance(x.get("tool_use_id"), str) else []
        elif isinstance(x.get("text"), str) and x["text"].strip():
            texts.append(x["text"])
    digest = hashlib.sha1(json.dumps([speaker, plain], sort_keys=True).encode()).hexdigest()
    visible = speaker != "system" and bool(texts or tools)
    return speaker, "\n".join(texts), visible, speaker == "user" and bool(texts), uses, results, digest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        session, seq, kind, raw, time = (batch.column(i).to_pylist() for i in range(5))
        rows = [read_row(k, s, r) for k, s, r in zip(kind, seq, raw)]
        part = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7)]
        speaker, text, visible, user_text, uses, results, digest = part
        columns = [(session, pa.string()), (seq, pa.int64()), (speaker, pa.string()), (text, pa.string()), (time, pa.string()), (visible, pa.bool_()), (user_text, pa.bool_()), (uses, pa.list_(pa.string())), (results, pa.list_(pa.string())), (digest, pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=[x.split()[0] for x in ROW.split(", ")])


def read(messages: DataFrame) -> DataFrame:
    """Rows of messages (session_id, seq, type, data, time_created) with speaker, text and tool ids."""
    rows = messages.select(clean_key(F.col("session_id")).alias("session_id"), F.col("seq").cast("long").alias("seq"), "type", "data", F.col("time_created").cast("string").alias("time"))
    return rows.where("session_id is not null").mapInArrow(_read, ROW)


def _when(time: str | None) -> float:
    """A rough instant that only breaks ties; unknown forms come first."""
    try:
        return float(time) if time and time.strip().isdigit() else datetime.fromisoformat(time.strip()).replace(tzinfo=UTC).timestamp() * 1000 if time else 0.0
    except ValueError:
        return 0.0


def topological(rows: list[dict]) -> tuple[list[dict], int]:
    """Kahn's algorithm over the messages of one block: the sorted messages and how many a cycle keeps back."""
    by_seq = {s: [i for i, _ in g] for s, g in itertools.groupby(sorted(enumerate(rows), key=lambda x: x[1]["seq"]), key=lambda x: x[1]["seq"])}
    used = {u: i for i in range(len(rows) - 1, -1, -1) for u in rows[i]["uses"]}
    after, waits = [[] for _ in rows], [0] * len(rows)

    def tie(a: int, b: int) -> None:
        after[a].append(b)
        waits[b] += 1

    for (_, earlier), (_, later) in itertools.pairwise(by_seq.items()):
        for b in later:
            tie(earlier[0], b)
    for j, row in enumerate(rows):
        for r in row["results"]:
            if r in used:
                tie(used[r], j)
    ready = [(_when(rows[i]["time"]), i) for i, n in enumerate(waits) if not n]
    heapq.heapify(ready)
    done = []
    while ready:
        i = heapq.heappop(ready)[1]
        done.append(rows[i])
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, (_when(rows[j]["time"]), j))
    return done, len(rows) - len(done)


def summarise(session: str, block: int | None, rows: list[dict]) -> tuple:
    """One row of SUMMARY: what a block of a session shows, and where it first names each tool id."""
    unreadable = any(r["speaker"] is None for r in rows)
    good = {(r["seq"], r["digest"]): r for r in reversed(rows) if r["speaker"] is not None}  # repeated rows count once
    kept = sorted(good.values(), key=lambda r: r["seq"])
    seqs = {r["seq"] for r in rows if r["seq"] is not None}
    differs = len(kept) > len({r["seq"] for r in kept})
    order, left = topological(kept)
    spoken = [r for r in (order if not left else kept) if r["speaker"] != "system"]
    events = ["assistant" if r["speaker"] == "assistant" else "user" for r in spoken if r["speaker"] == "assistant" or r["user_text"]]
    unanswered = any(a == b == "user" for a, b in itertools.pairwise(events))
    # kept is in order, so the first of an id stays
    uses, results = {}, {}
    for r in kept:
        for of, named in ((uses, r["uses"]), (results, r["results"])):
            for x in named:
                of.setdefault(x, r["seq"])
    ids = sorted(uses.keys() | results.keys())
    return (
        session, block, len(seqs), min(seqs, default=None), max(seqs, default=None), unreadable, differs, any(r["visible"] for r in kept),
        spoken[0]["speaker"] if spoken else None, events[0] if events else None, events[-1] if events else None, unanswered, ids, [uses.get(x) for x in ids], [results.get(x) for x in ids],
    )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive whole and one after the other; at most one is held."""
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.split()[1]] for x in SUMMARY.split(", ")]
    rows = (r for batch in batches for r in batch.to_pylist())
    blocks = (summarise(*key, list(g)) for key, g in itertools.groupby(rows, key=lambda r: (r["session_id"], r["block"])))
    for some in itertools.batched(blocks, 5000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)


def defects(messages: DataFrame, sessions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(session_id, reason) of every session; reason is null for a sound conversation. sessions: further session_id to look at."""
    rows = read(messages).drop("text").withColumn("block", F.floor(F.col("seq") / block))
    # copies of one message are few as a rule, but may be many: they go before the blocks are gathered
    rows = rows.dropDuplicates(["session_id", "seq", "speaker", "digest"])
    blocks = rows.repartition("session_id", "block").sortWithinPartitions("session_id", "block", "seq").mapInArrow(_summaries, SUMMARY)
    blocks = cut(blocks)  # one row per block, looked at from three sides
    nxt = Window.partitionBy("session_id").orderBy("block")  # one row per block, not per message
    whole = blocks.withColumn("_next", F.first(F.col("first_event"), True).over(nxt.rowsBetween(1, Window.unboundedFollowing)))
    per = whole.groupBy("session_id").agg(
        F.sum("n_seq").alias("n_seq"), (F.max("max_seq") - F.min("min_seq") + 1).alias("span"), F.bool_or("unreadable").alias("unreadable"), F.bool_or("differs").alias("differs"),
        F.bool_or("visible").alias("visible"), F.min_by("opener", F.when(F.col("opener").isNotNull(), F.col("block"))).alias("opener"),
        F.bool_or(F.col("unanswered") | F.coalesce((F.col("last_event") == "user") & (F.col("_next").isNull() | (F.col("_next") == "user")), F.lit(False))).alias("unanswered"),
    )
    # the first use and the first result of a tool id in the whole session, so block borders decide nothing
    tool = blocks.select("session_id", F.explode(F.arrays_zip("ids", "first_uses", "first_results")).alias("x")).select("session_id", "x.*")
    ids = tool.groupBy("session_id", F.col("ids").alias("id")).agg(F.min("first_uses").alias("use"), F.min("first_results").alias("result"))
    ids = ids.select("session_id", (F.col("result").isNotNull() & (F.col("use").isNull() | (F.col("result") <= F.col("use")))).alias("early"), (F.col("use").isNotNull() & F.col("result").isNull()).alias("lost"))
    open_ids = ids.groupBy("session_id").agg(F.bool_or("early").alias("early"), F.bool_or("lost").alias("lost"))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    broken = yes("unreadable") | (F.col("n_seq") < F.col("span")) | yes("differs") | yes("early") | (F.coalesce("opener", F.lit("user")) != "user")
    reason = (
        F.when(F.col("n_seq").isNull() | (~yes("unreadable") & ~yes("visible")), "empty").when(broken, "broken").when(yes("unanswered") | yes("lost"), "missing_reply")
    )
    return sessions.select("session_id").unionByName(per.select("session_id")).distinct().join(per, "session_id", "left").join(open_ids, "session_id", "left").select("session_id", reason.alias("reason"))


ORDERED = "session_id string, block long, place int, speaker string, text string, uses array<string>, results array<string>"


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The messages of each block in topological order; what a cycle keeps back follows in the order of seq."""
    names = [x.split()[0] for x in ORDERED.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def placed() -> Iterator[tuple]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for (session, block), group in itertools.groupby(rows, key=lambda r: (r["session_id"], r["block"])):
            held = list(group)
            order, left = topological(held)
            if left:
                done = {id(r) for r in order}
                order += [r for r in held if id(r) not in done]
            for place, r in enumerate(order):
                yield session, block, place, r["speaker"], r["text"], r["uses"], r["results"]

    for some in itertools.batched(placed(), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)


def turns(messages: DataFrame, verdicts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(session_id, turn, speaker, text, uses, results) of the sound conversations; turns are numbered from 0 in the order of the reply graph."""
    sound = verdicts.where("reason is null").select("session_id")
    rows = read(messages).where("speaker is not null").join(sound, "session_id", "left_semi").dropDuplicates(["session_id", "seq"]).withColumn("block", F.floor(F.col("seq") / block))
    rows = rows.select("session_id", "block", "seq", "time", "speaker", "text", "uses", "results")
    order = rows.repartition("session_id", "block").sortWithinPartitions("session_id", "block", "seq").mapInArrow(_ordered, ORDERED)
    # a block begins where the blocks before it end: one row per block
    sizes = rows.groupBy("session_id", "block").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("session_id").alias("_s"), F.col("block").alias("_b"), start.alias("start"))
    placed = order.join(starts, (F.col("session_id") == F.col("_s")) & (F.col("block") == F.col("_b")))
    return placed.select("session_id", (F.col("start") + F.col("place")).alias("turn"), "speaker", "text", "uses", "results")
