"""Deeply nested records as related flat tables (problem 7).

One depth-first visit of each JSON field emits tagged rows: the tag names the
table a row belongs to, path is its key within the field, parent the key of the
node above it, which is always a row of its own, and payload holds its own
scalar members. In a key, dots, brackets and backslashes of member names are
escaped by a backslash, so no two nodes have one key. parent_path is the plain
path of the member that holds the node, as people write it. Arrow batches go
through the visitor; no row waits for another, so nothing is shuffled.

Tags:
- record: the root of a readable field;
- block: one element stored under a key `content`;
- item: an element of any other array;
- object: any other nested object.

Cases and their results:
- a null, empty or unreadable field emits nothing (count them with `unreadable`);
- `content` that is a JSON text of an array counts as that array; any other
  string and any object is one block at position 0; numbers and booleans are
  scalars of the node above;
- null elements of an array emit nothing but keep their position;
- a single value of `content` stands at position 0, and what lies below it at
  `content[0]`;
- of repeated keys in one object the last counts;
- nesting too deep for the JSON reader counts as unreadable.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.values import parse_strict

SCHEMA = "tbl string, row_key string, field string, tag string, path string, parent string, parent_path string, pos int, block_type string, payload string"


def _no_constant(name: str):
    raise ValueError(name)


def read_json(text: str | None):
    """(True, value) of a readable JSON text, else (False, None)."""
    if not text or text.isspace():
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False, None


def _as_array(value):
    """The array that a value of `content` stands for, if it stands for one."""
    if isinstance(value, list):
        return value
    if isinstance(value, str) and value.lstrip()[:1] == "[":
        ok, inner = read_json(value)
        if ok and isinstance(inner, list):
            return inner
    return None


def _block_type(value) -> str:
    kind = value.get("type") if isinstance(value, dict) else None
    return "text" if kind is None else kind if isinstance(kind, str) else json.dumps(kind, ensure_ascii=False)


_ESCAPED = re.compile(r"[.\[\]\\]")


def visit(root) -> Iterator[tuple]:
    """(tag, path, parent, parent_path, pos, block_type, payload) of each node, depth first, without recursion."""
    stack = [("record", "", None, "", None, 0, None, root)]
    while stack:
        tag, path, parent, plain, holder, pos, kind, value = stack.pop()
        below, scalars = [], {}

        def put(what: str, key: str, name: str, i: int | None, block: str | None, v, path=path, below=below) -> None:
            at = "" if i is None else f"[{i}]"
            below.append((what, key + at, path, name + at, name, i or 0, block, v))

        if isinstance(value, dict):
            for key, v in value.items():
                safe = _ESCAPED.sub(r"\\\g<0>", key)
                at, name = (f"{path}.{safe}" if path else safe), (f"{plain}.{key}" if plain else key)
                if key == "content" and (array := _as_array(v)) is not None:
                    for i, x in enumerate(array):
                        if x is not None:
                            put("block", at, name, i, _block_type(x), x)
                elif key == "content" and isinstance(v, (dict, str)):
                    put("block", at, name, 0, _block_type(v), v)
                elif isinstance(v, dict):
                    put("object", at, name, None, None, v)
                elif isinstance(v, list):
                    for i, x in enumerate(v):
                        if x is not None:
                            put("item", at, name, i, None, x)
                else:
                    scalars[key] = v
        elif isinstance(value, list):
            for i, x in enumerate(value):
                if x is not None:
                    put("item", path, plain, i, None, x)
        else:
            scalars["value"] = value
        yield tag, path, parent, holder, pos, kind, json.dumps(scalars, ensure_ascii=False)
        stack += reversed(below)


def _emit(batches: Iterator[pa.RecordBatch], only: str | None) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int32() if n == "pos" else pa.string() for n in names]

    def pack(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    for batch in batches:
        rows = []
        for tbl, key, field, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
            ok, root = read_json(value)
            if ok:
                rows += [(tbl, key, field, *node) for node in visit(root) if only is None or node[0] == only]
            if len(rows) > 20_000:
                yield pack(rows)
                rows = []
        yield pack(rows)


def flatten(fields: DataFrame, only: str | None = None) -> DataFrame:
    """Tagged rows of all JSON texts in fields (tbl, row_key, field, value); only: a single tag."""
    return fields.select("tbl", "row_key", "field", "value").mapInArrow(lambda batches: _emit(batches, only), SCHEMA)


def unreadable(fields: DataFrame) -> DataFrame:
    """Per table and field how many values are null or cannot be read."""
    return fields.groupBy("tbl", "field").agg(F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"), F.count(F.when(F.col("value").isNotNull() & parse_strict(F.col("value")).isNull(), 1)).alias("n_unreadable"))


def write_tables(tagged: DataFrame, path: str) -> None:
    """Write one flat table per tag under path."""
    tagged.write.partitionBy("tag").parquet(path)


def typed_table(tagged: DataFrame, tag: str, columns: str) -> DataFrame:
    """The flat table of a tag with the scalar members that the DDL in columns names; a value that does not fit is null."""
    rows = tagged.where(F.col("tag") == tag)
    return rows.withColumn("_p", F.from_json("payload", columns)).select(*[c for c in rows.columns if c not in ("payload", "tag")], "_p.*")
