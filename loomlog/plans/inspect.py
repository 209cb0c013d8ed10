"""The bounded inspection plans: five operations on texts, and the selection of evidence lines.

A plan is {op, path, value, limit}. `validate` checks it, `run` applies one plan
to a whole table of texts at once: each row of (path, text) is a file, and the
answer is one row per file. Nothing is executed outside Spark.

Cases and their results:
- a null text has no lines and no answer; an empty text has none either;
- limits are 1 to 100; a pattern of names may hold letters, digits and `_.*?-`;
- a member that is absent is JSON null; one that is no object text is null.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.values import parse_strict, path_of

OPS = ("read_head", "read_tail", "find_literal", "list_files", "json_field")
# What ends a line of a text.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
_NAME_PATTERN = re.compile(r"[A-Za-z0-9_.*?-]+")


def validate(plan: dict) -> dict:
    """The plan, if it is one; ValueError says what is wrong."""
    if not isinstance(plan, dict) or set(plan) != {"op", "path", "value", "limit"}:
        raise ValueError("a plan has the members op, path, value and limit")
    if plan["op"] not in OPS:
        raise ValueError(f"no operation {plan['op']!r}")
    if not isinstance(plan["value"], str) or not isinstance(plan["path"], str):
        raise ValueError("path and value are texts")
    if isinstance(plan["limit"], bool) or not isinstance(plan["limit"], int) or not 1 <= plan["limit"] <= 100:
        raise ValueError("the limit is an integer from 1 to 100")
    if plan["op"] == "list_files" and not _NAME_PATTERN.fullmatch(plan["value"]):
        raise ValueError("unfit pattern of names")
    confined(plan["path"])
    return plan


def confined(path: str) -> str:
    """The path in its normal form, if it stays below its root."""
    plain = path.replace("\\", "/")
    if not plain or plain.startswith("/") or re.match("[A-Za-z]:", plain) or ".." in plain.split("/"):
        raise ValueError("the path must be relative and stay below its root")
    return posixpath.normpath(plain)


def split_lines(text: Column) -> Column:
    """The lines of a text; a line end at its end begins no further line."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def head(text: Column, n: int) -> Column:
    return F.slice(split_lines(text), 1, n)


def tail(text: Column, n: int) -> Column:
    lines = split_lines(text)
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n))


def find(text: Column, value: str, n: int) -> Column:
    """The first n lines that hold a text, case set aside."""
    return F.slice(F.filter(split_lines(text), lambda x: F.contains(F.lower(x), F.lit(value.lower()))), 1, n)


def json_field(text: Column, key: str) -> Column:
    """A top-level member as compact JSON; its name is taken literally, dots included."""
    v = parse_strict(text)
    path = path_of(key)
    if path is None:
        raise ValueError("a key with both sorts of quotes has no path")
    got = F.to_json(F.try_variant_get(v, path, "variant"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(got, F.lit("null")))


def glob_regex(pattern: str) -> str:
    return "(?i)^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in pattern) + "$"


def list_files(names: DataFrame, pattern: str, n: int) -> DataFrame:
    """The first n of the names (name) that match, in the order of their lower-case forms."""
    return names.where(F.col("name").rlike(glob_regex(pattern))).select("name").distinct().orderBy(F.lower("name"), "name").limit(n)


def run(plan: dict, files: DataFrame) -> DataFrame:
    """(path, answer) of a plan for every file (path, text); list_files answers for the table as a whole."""
    plan = validate(plan)
    text, n = F.col("text"), plan["limit"]
    if plan["op"] == "list_files":
        return list_files(files.select(F.col("path").alias("name")), plan["value"], n).select(F.col("name").alias("path"), F.col("name").alias("answer"))
    answer = {"read_head": lambda: head(text, n), "read_tail": lambda: tail(text, n), "find_literal": lambda: find(text, plan["value"], n)}
    out = json_field(text, plan["value"]) if plan["op"] == "json_field" else F.array_join(answer[plan["op"]](), "\n")
    return files.select("path", out.alias("answer"))


def powershell(plan: dict) -> str:
    """The plan as a PowerShell command text, for reports; it is never run."""
    plan = validate(plan)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    path, value, n = quote(plan["path"]), quote(plan["value"]), plan["limit"]
    read = f"Get-Content -LiteralPath {path} -Encoding UTF8"
    return {
        "read_head": f"{read} -TotalCount {n}", "read_tail": f"{read} -Tail {n}", "find_literal": f"Select-String -LiteralPath {path} -Encoding UTF8 -SimpleMatch -Pattern {value} | Select-Object -First {n} -ExpandProperty Line",
        "list_files": f"Get-ChildItem -LiteralPath {path} -File | Where-Object Name -like {value} | Sort-Object Name | Select-Object -First {n} -ExpandProperty Name",
        "json_field": f"({read} -Raw | ConvertFrom-Json).PSObject.Properties[{value}].Value | ConvertTo-Json -Compress -Depth 20",
    }[plan["op"]]


# ---- evidence


def select_lines(lines: Column, chosen: Column) -> Column:
    """The chosen lines (numbers from 1) as they stand; null if the numbers are not in order, repeated or out of range."""
    good = (F.array_sort(F.array_distinct(chosen)) == chosen) & F.coalesce(F.array_min(chosen) >= 1, F.lit(True)) & F.coalesce(F.array_max(chosen) <= F.size(lines), F.lit(True))
    return F.when(good, F.transform(chosen, lambda i: F.element_at(lines, i.cast("int"))))


def lines_starting(lines: Column, *starts: str) -> Column:
    """The numbers of the lines that begin with one of the given texts."""
    hit = lambda x: F.array_contains(F.array(*[F.startswith(x, F.lit(s)) for s in starts]), F.lit(True))
    return F.filter(F.transform(lines, lambda x, i: F.when(hit(x), i + 1)), lambda i: i.isNotNull())


def recall(expected: Column, selected: Column) -> Column:
    """Share of the expected that is selected; 1 where nothing is expected."""
    common = F.size(F.array_intersect(expected, selected)).cast("double")
    return F.when(F.size(expected) == 0, 1.0).otherwise(common / F.greatest(F.size(expected), F.lit(1)))


def precision(expected: Column, selected: Column) -> Column:
    """Share of the selected that is expected; where nothing is selected 1 if nothing is expected, else 0."""
    common = F.size(F.array_intersect(expected, selected)).cast("double")
    return F.when(F.size(F.array_distinct(selected)) == 0, F.when(F.size(expected) == 0, 1.0).otherwise(0.0)).otherwise(common / F.size(F.array_distinct(selected)))


# ---- bindings


def bind(request: str, targets: dict[str, str]) -> tuple[str, str, dict[str, str]]:
    """(request for the model, request for people, path of each reference): each {{name}} is replaced in one pass.

    Unknown names, no names at all, and paths outside their root raise ValueError.
    """
    if not request.strip() or not 1 <= len(targets) <= 16:
        raise ValueError("a request and 1 to 16 targets are needed")
    refs = {name: f"file_{i}" for i, name in enumerate(targets, 1)}
    for path in targets.values():
        confined(path)
    slot = re.compile(r"\{\{([A-Za-z]\w*)\}\}", re.ASCII)
    used = slot.findall(request)
    if not used or any(u not in refs for u in used):
        raise ValueError("the request must use the names of its targets")
    fill = lambda values: slot.sub(lambda m: json.dumps(values[m[1]], ensure_ascii=False), request)
    return fill(refs), fill(targets), {refs[name]: path for name, path in targets.items()}


# ---- equality of JSON texts


def canonical(text: str | None) -> str | None:
    """A JSON text with sorted members and no blanks; true and 1 stay apart; null for what is no JSON."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def with_canonical(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """df with the canonical form of a column of JSON texts, read in Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string"
    at = df.columns.index(column)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([canonical(t) for t in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(go, schema)


def schema(refs: list[str] | None = None) -> dict:
    """The JSON schema of a plan; with refs its path is one of these references only."""
    if refs is not None and (not refs or any(not isinstance(r, str) for r in refs)):
        raise ValueError("references are texts, at least one")
    path = {"type": "string"} | ({"enum": list(refs)} if refs else {})
    members = {"op": {"type": "string", "enum": list(OPS)}, "path": path, "value": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}
    return {"type": "object", "properties": members, "required": list(members), "additionalProperties": False}
