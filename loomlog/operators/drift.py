"""Schemas that drift between the files of a store (problem 1).

Lines are read as maps from path to value with their raw types; nested members
have paths of their own. Per file and path the types are aggregated, and for the
top-level names also a sketch of the content. Neighbouring files are compared,
which gives the report of changes, and the names that the report ties together
give the columns of one consistent table, with every value that does not fit its
column reported.

Lines go to the shuffle in chunks of CHUNK of one file, so a file with a third of
all lines is many tasks and every task sends one partial profile per chunk. A
store with a third of all files is split by file: what a field takes over from
earlier files comes from windows over (store, field), and each pair of
neighbouring files is compared on its own.

Cases and their results:
- blank, cut and non-object lines carry no fields; a file of only such lines
  is present in no comparison;
- a null has no type; a field that is null in all of a file keeps the type it
  had, so nothing is retyped there;
- repeated lines change no report; of repeated keys in one line the last counts;
- a field is renamed if one name ends and another begins in the same step and
  the content sketches agree; flags agree in content by chance, so for them the
  names must agree up to case and separators;
- a renamed and retyped field gives both changes.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.values import parse_strict, path_of
from loomlog.operators.nested import read_json
from loomlog.util import cut

#: counters of a content sketch; with the number of fields this bounds the profile of a file
SKETCH = 512
#: lines of one file that go to one place
CHUNK = 2_000
#: cosine of two sketches from which the content is held to be the same, for related and for unrelated names
ALIKE_RELATED, ALIKE = 0.3, 0.75
CHANGES = "store string, file_no int, field string, old_field string, change string, old_types string, new_types string"
PROFILE = "store string, file_no int, profile string"
PATHS = "store string, file_no int, path string, types array<string>, flag boolean, sketch string, counts map<string,long>"


def type_of(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    return {int: "integer", float: "decimal", list: "array"}.get(type(v), "object")


def _leaf(v):
    """The plain value inside wrapper objects; the elements of a list one after the other."""
    while isinstance(v, dict):
        v = next((x for x in v.values() if x is not None), "")
    return " ".join(str(_leaf(x)) for x in v) if isinstance(v, list) else v


_NUMERIC = re.compile(r"\s*(-?\d+(?:\.\d+)?)\s*(?:m?s)?\s*")
_INSTANT = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:")
_SHAPE = [(re.compile("[a-z]+"), "a"), (re.compile("[A-Z]+"), "A"), (re.compile("[0-9]+"), "9")]
_WORD = re.compile("[A-Za-z]+")


def content(v) -> list[str]:
    """What a value looks like whatever type it has: magnitude, instant, or the shapes of a text and the words it begins with.

    The shape runs over the whole text; the first three words stand for what a text is about, which later words blur.
    """
    v = _leaf(v)
    if isinstance(v, bool):
        return [f"b:{v}"]
    s = str(v)
    if m := _NUMERIC.fullmatch(s):
        x = abs(float(m[1]))
        size = math.log10(x) if x >= 1 else 0
        return [f"n:{int(2 * size)}", f"m:{int(size)}"] + [f"v:{float(m[1]):g}"] * (x < 1000)
    if _INSTANT.match(s):
        return ["n:24", "m:12"]
    shape = s
    for rx, to in _SHAPE:
        shape = rx.sub(to, shape)
    shape = f"^{shape}$"
    words = itertools.islice(_WORD.finditer(s), 3)
    return [f"s:{shape[i : i + 3]}" for i in range(max(1, len(shape) - 2))] + [f"w:{m[0]}" for m in words]


@functools.lru_cache(maxsize=1 << 16)
def _place(feature: str) -> str:
    return str(zlib.crc32(feature.encode()) % SKETCH)


def _features(v) -> tuple[list[str], float, bool]:
    found = content(v)
    return [_place(f) for f in found], 1 / math.sqrt(len(found)), found[0][:2] == "b:"


@functools.lru_cache(maxsize=1 << 14)
def _features_of_text(v: str) -> tuple[list[str], float, bool]:
    return _features(v)


_ESCAPED = re.compile(r"[.\[\]\\]")


def _nested(v, path: str, into: dict) -> None:
    """Types of the members below a value, by path; the elements of an array share one path."""
    stack = [(v, path)]
    while stack:
        v, path = stack.pop()
        below = ((f"{path}.{_ESCAPED.sub(r'\\\g<0>', k)}", x) for k, x in v.items()) if isinstance(v, dict) else ((f"{path}[]", x) for x in v)
        for at, x in below:
            types = into.setdefault(at, (Counter(), Counter()))[0]
            types[type_of(x) or "~null"] += 1
            if isinstance(x, (dict, list)):
                stack.append((x, at))


def _add(line: dict, into: dict) -> None:
    """Add the path-value map of one line to a profile {path: (types, sketch)}."""
    for k, v in line.items():
        at = _ESCAPED.sub(r"\\\g<0>", k)
        types, sketch = into.setdefault(at, (Counter(), Counter()))
        if v is None:
            types["~null"] += 1
            continue
        types[type_of(v)] += 1
        places, weight, flag = _features_of_text(v) if isinstance(v, str) and len(v) < 64 else _features(v)
        for p in places:
            sketch[p] += weight
        if flag:
            types["~flag"] += 1
        if isinstance(v, (dict, list)):
            _nested(v, at, into)


def _text(sketch: dict) -> str:
    """A sketch as text; most are never read again."""
    return ",".join(f"{k}:{v!r}" for k, v in sketch.items())


@functools.lru_cache(maxsize=1024)
def _read(sketch: str) -> dict:
    """Only sketches of fields that come or go, or of files in several parts, are read."""
    return {k: float(v) for k, _, v in (x.partition(":") for x in sketch.split(","))} if sketch else {}


def _merge(parts: Iterator[dict]) -> dict:
    """The sum of partial profiles {path: (types, text of the sketch)}, one of which is held at a time; a single one is passed on as it is."""
    first = next(parts)
    out: dict | None = None
    for part in parts:
        if out is None:
            out = {k: (Counter(types), Counter(_read(sketch))) for k, (types, sketch) in first.items()}
        for k, (types, sketch) in part.items():
            into = out.setdefault(k, (Counter(), Counter()))
            into[0].update(types)
            into[1].update(_read(sketch))
    return first if out is None else {k: (types, _text(sketch)) for k, (types, sketch) in out.items()}


def _held(profile: dict) -> str:
    return json.dumps({k: (types, _text(sketch)) for k, (types, sketch) in profile.items()})


def _pack(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ", 1) for x in schema.split(", ")))
    of = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,long>": pa.map_(pa.string(), pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=list(names))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines arrive file by file; each run of lines of one file gives a partial profile."""
    at, held = None, {}
    for batch in batches:
        done = []
        for store, file_no, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (store, file_no) != at:
                if held:
                    done.append((*at, _held(held)))
                at, held = (store, file_no), {}
            ok, line = read_json(raw)
            if ok and isinstance(line, dict):
                _add(line, held)
        yield _pack(done, PROFILE)
    if held:
        yield _pack([(*at, _held(held))], PROFILE)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial profiles arrive file by file; only the sum for one file is held. One row per path comes out."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
    for key, group in itertools.groupby(rows, key=lambda r: r[:2]):
        total = _merge(json.loads(part) for _, _, part in group)
        yield _pack([(*key, path, sorted(t for t in types if t[0] != "~"), "~flag" in types, sketch, sorted((t, n) for t, n in types.items() if t != "~flag")) for path, (types, sketch) in total.items()], PATHS)


def path_statistics(lines: DataFrame) -> DataFrame:
    """One row per file and path of lines (store, file_no, line_no, raw): types with counts, and the content sketch of top-level names."""
    rows = lines.select("store", F.col("file_no").cast("int").alias("file_no"), "raw", F.floor(F.col("line_no") / CHUNK).alias("_chunk"))
    partial = rows.repartition("store", "file_no", "_chunk").sortWithinPartitions("store", "file_no").select("store", "file_no", "raw").mapInArrow(_profiles, PROFILE)
    return partial.repartition("store", "file_no").sortWithinPartitions("store", "file_no").mapInArrow(_merged, PATHS)


def paths(lines: DataFrame) -> DataFrame:
    """(store, file_no, path, type, n): how many values each path has of each type in each file; nulls have the type `null`."""
    return path_statistics(lines).select("store", "file_no", "path", F.explode("counts").alias("type", "n")).withColumn("type", F.regexp_replace("type", "^~", ""))


def _cosine(a: dict, b: dict) -> float:
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b.get(k, 0) for k, v in a.items()) / norm if norm else 0.0


def _bare(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def related(a: str, b: str) -> bool:
    """One name shortens the other, or both share three letters in a row."""
    a, b = sorted((_bare(a), _bare(b)), key=len)
    rest = iter(b)
    return bool(a) and (all(c in rest for c in a) or any(a[i : i + 3] in b for i in range(len(a) - 2)))


def compare(before: dict, after: dict) -> list[tuple]:
    """(field, old_field, change, old_types, new_types) from the fields {name: (types, flag, sketch)} of one file to those of the next."""
    gone, new = sorted(before.keys() - after.keys()), sorted(after.keys() - before.keys())
    scored = []
    for a in gone:
        for b in new:
            # flags agree in content by chance
            flags = all(x[1] and set(x[0]) <= {"boolean"} for x in (before[a], after[b]))
            same = _cosine(_read(before[a][2]), _read(after[b][2]))
            if _bare(a) == _bare(b) or not flags and same >= (ALIKE_RELATED if related(a, b) else ALIKE):
                scored.append((-same - 0.2 * related(a, b) - (_bare(a) == _bare(b)), a, b))
    renamed: dict[str, str] = {}
    for _, a, b in sorted(scored):
        if a not in renamed and b not in renamed.values():
            renamed[a] = b
    pairs = [(a, a) for a in sorted(before.keys() & after.keys())] + sorted(renamed.items())
    out = [(b, a, "renamed") for a, b in renamed.items()]
    out += [(b, None, "added") for b in new if b not in renamed.values()] + [(a, a, "removed") for a in gone if a not in renamed]
    out += [(b, a, "retyped") for a, b in pairs if before[a][0] and after[b][0] and set(before[a][0]) != set(after[b][0])]
    text = lambda p, k: "|".join(sorted(p[k][0])) if k in p else None
    return [(f, old, change, text(before, old), text(after, f)) for f, old, change in out]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of two neighbouring files arrive together, those of the earlier one first; only they are held."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(8))))
    for (store, _), group in itertools.groupby(rows, key=lambda r: r[:2]):
        sides: tuple[dict, dict] = ({}, {})
        file_no = None
        for _, _, later, n, path, types, flag, sketch in group:
            # paths of top-level names: without the escapes
            sides[later][_PLAIN.sub(r"\1", path)] = (types or [], flag, sketch or "")
            file_no = n if later else file_no
        if sides[0] and sides[1]:
            yield _pack([(store, file_no, *c) for c in compare(*sides)], CHANGES)


_PLAIN = re.compile(r"\\(.)")


def changes(lines: DataFrame) -> DataFrame:
    """The report: one row per change from a file to the next one present in its store."""
    # a path without an escape-free dot or bracket is a top-level name
    fields = cut(path_statistics(lines).where(~F.col("path").rlike(r"(?<!\\)(?:\\\\)*[.\[]")).drop("counts"))
    files = fields.select("store", "file_no").distinct()
    # one row per file, not per line
    order = files.withColumn("at", F.row_number().over(Window.partitionBy("store").orderBy(F.asc_nulls_first("file_no"))))
    placed = fields.alias("f").join(order.alias("o"), F.col("f.store").eqNullSafe(F.col("o.store")) & F.col("f.file_no").eqNullSafe(F.col("o.file_no"))).select("f.*", "o.at")
    # a field without any type takes over what it had in the file before, as long as it was there
    of_field = Window.partitionBy("store", "path").orderBy("at")
    run = placed.withColumn("_run", F.col("at") - F.row_number().over(of_field))
    known = F.last(F.when(F.size("types") > 0, F.struct("types", "flag", "sketch")), ignorenulls=True).over(Window.partitionBy("store", "path", "_run").orderBy("at"))
    full = run.withColumn("_k", F.coalesce(known, F.struct("types", "flag", "sketch"))).select("store", "file_no", "at", "path", "_k.types", "_k.flag", "_k.sketch")
    # every file takes part in two steps: as the later one of the first, as the earlier one of the second
    step = full.withColumn("later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("step", F.col("at") + 1 - F.col("later"))
    rows = step.repartition("store", "step").sortWithinPartitions("store", "step", "later").select("store", "step", "later", "file_no", "path", "types", "flag", "sketch")
    return rows.mapInArrow(_steps, CHANGES)


def _together(files: DataFrame, names: list[str]) -> set[tuple[str, str]]:
    """The pairs of names, smaller first, that occur in one file of (store, file_no, fields); bounded by the vocabulary."""
    of = F.array_sort(F.array_intersect("fields", F.array(*[F.lit(n) for n in names]))) if names else F.array().cast("array<string>")
    one = files.select(of.alias("f")).distinct().select("f", F.explode("f").alias("a"))
    pairs = one.select("a", F.explode("f").alias("b")).where("a < b").distinct()
    return {(r["a"], r["b"]) for r in pairs.collect()}


def canonical_names(renames: DataFrame, files: DataFrame, names: list[str]) -> dict[str, str]:
    """For each of the names that is another spelling of a field in all stores the name of its column: the smallest of those tied to it.

    Only renamings between related names count beyond their store, those of most stores first, and two groups are
    never united if a name of one occurs in one file with a name of the other. Pairs of the given names reach the driver.
    """
    known = F.broadcast(files.sparkSession.createDataFrame([(n,) for n in names], "field string"))  # at most `most` names
    kept = renames.join(known, "field", "left_semi").join(known.withColumnRenamed("field", "old_field"), "old_field", "left_semi")
    pairs = kept.groupBy("old_field", "field").agg(F.count_distinct("store").alias("n")).collect()
    pairs = sorted((-r["n"], r["old_field"], r["field"]) for r in pairs if related(r["old_field"], r["field"]))
    group = {x: {x} for p in pairs for x in p[1:]}
    met = _together(files, sorted(group))
    for _, a, b in pairs:
        x, y = group[a], group[b]
        if x is not y and not any((min(m, n), max(m, n)) in met for m in x for n in y):
            x |= y
            for m in y:
                group[m] = x
    return {x: min(g) for x, g in group.items()}


def _store_columns(canonical: dict[str, str]):
    """A function from the files of one store (store, file_no, fields, renames) to the columns of names that differ in a file from the canonical ones."""

    def run(t: pa.Table) -> pa.Table:
        files = sorted(t.to_pylist(), key=lambda r: (r["file_no"] is None, r["file_no"]))
        touched = {x for r in files for a, b in r["renames"] or [] for x in (a, b)}
        out = []
        if touched:
            column = {n: canonical.get(n, n) for r in files for n in r["fields"] or []}
            sets = {frozenset(r["fields"] or []) for r in files}
            own = dict(column)
            for r in files:
                for old, new in sorted(r["renames"] or []):
                    to = column.get(old, canonical.get(old, old))
                    # names of one column never occur in one file of the store
                    if not any(new in f and any(column[n] == to for n in f if n != new) for f in sets):
                        column[new] = to
                differ = {n: column[n] for n in r["fields"] or [] if column[n] != own[n]}
                if differ:
                    out.append((r["store"], r["file_no"], list(differ.items())))
        columns = list(zip(*out)) if out else [[]] * 3
        types = [pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("store", "file_no", "local"), columns, types)})

    return run


def local_columns(renames: DataFrame, files: DataFrame, canonical: dict[str, str]) -> DataFrame:
    """(store, file_no, local): the columns of names that a renaming of this store ties to another name from this file or an earlier one on."""
    events = renames.groupBy("store", "file_no").agg(F.collect_set(F.array("old_field", "field")).alias("renames"))
    of = files.alias("f").join(events.alias("e"), F.col("f.store").eqNullSafe(F.col("e.store")) & (F.col("f.file_no") == F.col("e.file_no")), "left").select("f.store", "f.file_no", "f.fields", "e.renames")
    return of.groupBy("store").applyInArrow(_store_columns(canonical), "store string, file_no int, local map<string,string>")


def _value(v: Column, kind: str) -> Column:
    text = F.coalesce(F.try_variant_get(v, "$.id", "string"), F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$[0].text", "string"), F.try_variant_get(v, "$", "string"))
    return {"string": text}.get(kind, F.coalesce(F.try_variant_get(v, "$", kind), text.try_cast(kind)))


#: columns of the consistent table beside those of the fields
OWN = ("store", "file_no", "file_name", "line_no", "readable", "failed_casts", "more")


def column_names(fields: list[str]) -> dict[str, str]:
    """A column name per field: its own, with a number behind it where another column has that name but for case."""
    taken, out = {n.lower() for n in OWN}, {}
    for f in sorted(fields):
        name, k = f, 1
        while name.lower() in taken:
            k += 1
            name = f"{f}_{k}"
        taken.add(name.lower())
        out[f] = name
    return out


def consistent(lines: DataFrame, most: int = 1_000) -> DataFrame:
    """All lines in one table: store, file_no, file_name, line_no, readable, a typed column per field, failed_casts, more.

    A column takes the type that most of its values have; values that do not
    fit are null and named in failed_casts, and so is a name whose value gives
    way to another name of its column in the same line. A renaming holds in its
    store from its file on; between related names that never meet in a file it
    holds in all stores. The `most` names of most files have columns; the values
    of all further names are kept as JSON in the map `more`. A field whose name
    an own column or, but for case, another field has gets a number behind it.
    """
    renames = cut(changes(lines).where("change = 'renamed'").select("store", "file_no", "old_field", "field"))
    fields = lines.select("store", F.col("file_no").cast("int").alias("file_no"), F.explode(F.map_keys(F.from_json("raw", "map<string,string>"))).alias("field")).distinct()
    fields = cut(fields)
    ranked = fields.groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(most).collect()
    names = [r["field"] for r in ranked if path_of(r["field"])]
    files = cut(fields.groupBy("store", "file_no").agg(F.collect_list("field").alias("fields")))  # the names of a file, at most its vocabulary
    canonical = canonical_names(renames, files, names)
    local = cut(local_columns(renames, files, canonical))
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    moved = [(r["key"], r["value"]) for r in local.select(F.explode("local")).distinct().where(F.array_contains(listed, F.col("key")) & F.array_contains(listed, F.col("value"))).collect()]  # pairs of those names
    on = F.col("l.store").eqNullSafe(F.col("m.store")) & (F.col("l.file_no").cast("int") == F.col("m.file_no"))
    values = lines.alias("l").join(local.alias("m"), on, "left").select("l.*", "m.local").withColumn("_v", parse_strict(F.col("raw"))).withColumn("_v", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v")))
    groups: dict[str, list[str]] = {}
    for name in sorted(names):
        groups.setdefault(canonical.get(name, name), []).append(name)
    for name, c in sorted(moved):
        if name not in groups.setdefault(c, []):
            groups[c].append(name)
    at = lambda name: F.try_variant_get("_v", path_of(name), "variant")
    moving = {n for n, _ in moved}

    def value(n: str, c: str) -> Column:
        """The value under name n where n belongs to column c."""
        if n not in moving:
            return at(n)
        return F.when(F.coalesce(F.try_element_at("local", F.lit(n)), F.lit(canonical.get(n, n))) == c, at(n))

    order = sorted(groups)
    raws = {c: F.coalesce(*[value(n, c) for n in groups[c]]) for c in order}
    # a name whose value is not the first of its column in a line
    present = lambda n, c: value(n, c).isNotNull()
    displaced = [F.when(present(n, c) & functools.reduce(Column.__or__, [present(m, c) for m in groups[c][:k]]), F.lit(n)) for c in order for k, n in enumerate(groups[c]) if k]
    displaced = F.array_compact(F.array(*displaced)) if displaced else F.array().cast("array<string>")
    rest = F.map_filter(F.from_json(F.when(F.col("_v").isNotNull(), F.col("raw")), "map<string,string>"), lambda k, v: ~F.array_contains(listed, k)) if names else F.lit(None).cast("map<string,string>")
    place = {c: f"f_{i}" for i, c in enumerate(order)}
    readable = values.select("store", "file_no", "file_name", "line_no", F.col("_v").isNotNull().alias("readable"), displaced.alias("_displaced"), rest.alias("more"), *[raws[c].alias(place[c]) for c in order])
    # one pass counts how many values of each column have which JSON type
    json_types = {"boolean": "BOOLEAN", "bigint": "BIGINT", "double": "D[EO]", "string": "STRING|OBJECT|ARRAY"}
    seen = {c: F.schema_of_variant(place[c]) for c in order}
    counts = readable.agg(*[F.count_if(seen[c].rlike(f"^(?:{rx})")).alias(f"{t}_{place[c]}") for c in order for t, rx in json_types.items()]).first() if order else {}
    named = column_names(order)
    out, failed = [], []
    for c in order:
        kind = max(json_types, key=lambda t: (counts[f"{t}_{place[c]}"], t == "string"))
        typed = _value(F.col(place[c]), kind)
        out.append(typed.alias(named[c]))
        failed.append(F.when(F.col(place[c]).isNotNull() & (seen[c] != "VOID") & typed.isNull(), F.lit(c)))
    failed_casts = F.array_union(F.array_compact(F.array(*failed)), "_displaced") if failed else F.array().cast("array<string>")
    return readable.select("store", "file_no", "file_name", "line_no", "readable", *out, failed_casts.alias("failed_casts"), "more")
