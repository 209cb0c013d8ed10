"""Tool calls inside JS cells: a scanner that knows strings, escapes and brackets.

Balanced brackets are no regular language, so the scanner runs in Python over
Arrow batches; the rows that come out are exploded by Spark.

Cases and their results:
- a null or empty cell has no calls;
- brackets and names inside string literals do not count, escapes are skipped;
- a call that is never closed takes the rest of the cell;
- a command that is an identifier or holds `${` is dynamic: its text is null or
  the template as it stands.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_CALL = re.compile(r"tools\.([A-Za-z_]\w*)\s*\(")
_OPEN, _CLOSE = "([{", ")]}"
# Inner tools that run a shell command, and the members that are read of their arguments.
INNER_SHELLS = {"exec_command", "shell_command", "shell", "bash", "oc_bash"}
MEMBERS = ("cmd", "command", "shell", "workdir", "yield_time_ms", "timeout_ms", "code")
CALLS = "array<struct<name:string,args:string>>"
COMMANDS = "array<struct<cmd:string,shell_param:string,workdir:string,dynamic:boolean>>"


def closing(js: str, at: int) -> int:
    """Where the bracket that opened just before `at` closes, or the end of the text."""
    depth = 1
    quote = ""
    while at < len(js):
        c = js[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
            if not depth:
                return at
        at += 1
    return len(js)


def scan(js: str | None) -> list[tuple[str, str]]:
    """(tool, argument text) of each call in a cell."""
    return [(m[1], js[m.end() : closing(js, m.end())].strip()) for m in _CALL.finditer(js or "")]


def _literal(text: str, at: int) -> str | None:
    """The value of the string literal that begins at a quote, or null if it is not closed."""
    quote, end = text[at], at + 1
    while end < len(text) and text[end] != quote:
        end += 2 if text[end] == "\\" else 1
    if end >= len(text):
        return None
    inside = text[at + 1 : end]
    if quote == '"':
        try:
            return json.loads(f'"{inside}"')
        except ValueError:
            return inside
    return inside.replace("\\'", "'") if quote == "'" else inside


def members(args: str) -> dict:
    """The members of an argument object as far as they are literal; `NAME_dynamic` and `_dynamic` tell the others."""
    try:
        whole = json.loads(args)
        if isinstance(whole, dict):
            return whole
    except ValueError:
        pass
    found: dict = {}
    for name in MEMBERS:
        if m := re.search(rf"(?:^|[{{,\s])[\"']?{name}[\"']?\s*:\s*(?=[\"'`])", args):
            value = _literal(args, m.end())
            if value is not None:
                found[name] = value
                continue
        if re.search(rf"(?:^|[{{,\s]){name}\s*[,}}]", args):
            found[name], found[f"{name}_dynamic"] = None, True
    if "${" in args or re.search(r"(?:^|[{,\s])[\"']?(?:cmd|command)[\"']?\s*:\s*[A-Za-z_$]", args):
        found["_dynamic"] = True
    return found


def commands(js: str | None) -> list[dict]:
    """The shell commands of a cell in order."""
    out = []
    for name, args in scan(js):
        if name in INNER_SHELLS:
            m = members(args)
            text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
            cmd = m["cmd"] if m.get("cmd") is not None else m.get("command")
            out.append({"cmd": text(cmd), "shell_param": text(m.get("shell")), "workdir": text(m.get("workdir")), "dynamic": any(m.get(k) for k in ("_dynamic", "cmd_dynamic", "command_dynamic"))})
    return out


def _calls_of(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in cells:
        yield s.map(lambda js: [{"name": n, "args": a} for n, a in scan(js)])


def _commands_of(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in cells:
        yield s.map(commands)


def calls(cells: DataFrame, column: str) -> DataFrame:
    """cells with `calls`, the tool calls of each."""
    return cells.withColumn("calls", pandas_udf(_calls_of, CALLS)(F.col(column)))


def shell_commands(cells: DataFrame, column: str) -> DataFrame:
    """One row per shell command of a cell, with idx_in_cell and n_in_cell; cells without any give no row."""
    found = cells.withColumn("_c", pandas_udf(_commands_of, COMMANDS)(F.col(column))).withColumn("n_in_cell", F.size("_c"))
    return found.select(*cells.columns, "n_in_cell", F.posexplode("_c").alias("idx_in_cell", "_x")).select(*cells.columns, "n_in_cell", "idx_in_cell", "_x.*")
