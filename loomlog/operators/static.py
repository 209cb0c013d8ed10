"""Commands recovered from code without running it: calls in JS cells, and plain read commands in PowerShell text.

Both readers are small parsers over Arrow batches. What is not written out in
the text is dynamic: it is reported, never guessed.

Cases and their results:
- null code has the status `invalid_input`, code above MOST_CHARS `oversized_input`, code with a string or bracket that never closes `parse_error`;
- comments hold no calls;
- later members of an argument object replace earlier ones of the same name;
- text in another shell's language gives no read candidate.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.values import SHELL_NAMES

#: code above this is not read, but counted as oversized
MOST_CHARS = 2_000_000
DYNAMIC = object()
_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.S)
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_HEAD = re.compile(r"\b(if|else|for|while|switch|try|catch|function)\b[^;{}]*$|(=>)\s*$")


class Unclosed(ValueError):
    """A string, comment or bracket that never closes."""


class Code:
    """Positions in a JS text: where strings and brackets end, and what literals say."""

    def __init__(self, text: str):
        self.text = text

    def skip(self, at: int) -> int:
        return _SPACE.match(self.text, at).end()

    def string(self, at: int) -> tuple[object, int]:
        """The value of the string or template that begins at `at`, and its end; a template with a substitution is dynamic."""
        quote, out, dynamic = self.text[at], [], False
        at += 1
        while at < len(self.text):
            c = self.text[at]
            if c == quote:
                return (DYNAMIC if dynamic else "".join(out)), at + 1
            if c == "\\":
                n = self.text[at + 1 : at + 2]
                if n == "u" and (m := re.match(r"u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})", self.text[at + 1 : at + 12])):
                    out.append(chr(int(m[1] or m[2], 16)))
                    at += 1 + m.end()
                elif n == "x" and (m := re.match(r"x([0-9a-fA-F]{2})", self.text[at + 1 : at + 4])):
                    out.append(chr(int(m[1], 16)))
                    at += 4
                else:
                    out.append("" if n == "\n" else _ESCAPES.get(n, n))
                    at += 2
            elif quote == "`" and self.text.startswith("${", at):
                dynamic = True
                at = self.close(at + 1)
            elif c == "\n" and quote != "`":
                raise Unclosed
            else:
                out.append(c)
                at += 1
        raise Unclosed

    def close(self, at: int) -> int:
        """The end of the bracket that opens at `at`."""
        depth = 0
        while at < len(self.text):
            c = self.text[at]
            if c in "\"'`":
                at = self.string(at)[1]
                continue
            if self.text.startswith(("//", "/*"), at):
                at = self.skip(at) if self.skip(at) > at else len(self.text)
                continue
            depth += (c in "([{") - (c in ")]}")
            at += 1
            if not depth:
                return at
        raise Unclosed

    def dynamic(self, at: int) -> tuple[object, int]:
        """Past an expression that is not literal: up to the comma or bracket that ends it."""
        while at < len(self.text) and self.text[at] not in ",)]}":
            c = self.text[at]
            at = self.string(at)[1] if c in "\"'`" else self.close(at) if c in "([{" else max(at + 1, self.skip(at))
        return DYNAMIC, at

    def value(self, at: int) -> tuple[object, int]:
        """The literal value of the expression at `at`, or DYNAMIC, and its end."""
        start = at = self.skip(at)
        c = self.text[at : at + 1]
        if not c:
            raise Unclosed
        if c in "\"'`":
            got, at = self.string(at)
        elif c == "[":
            got, at = self.items(at)
        elif c == "{":
            got, at = self.members(at)
            got = DYNAMIC if got is None or any(v is DYNAMIC for v in got.values()) else got
        elif m := _NUMBER.match(self.text, at):
            got, at = json.loads(m[0]), m.end()
        elif (m := _NAME.match(self.text, at)) and m[0] in ("true", "false", "null"):
            got, at = {"true": True, "false": False, "null": None}[m[0]], m.end()
        else:
            return self.dynamic(start)
        at = self.skip(at)
        while self.text[at : at + 1] == "+" and isinstance(got, str):
            more, at = self.value(at + 1)
            got = got + more if isinstance(more, str) else DYNAMIC
            at = self.skip(at)
        return (got, at) if self.text[at : at + 1] in (",", ")", "]", "}", "", ";") else self.dynamic(start)

    def items(self, at: int) -> tuple[object, int]:
        out, at = [], self.skip(at + 1)
        while self.text[at : at + 1] != "]":
            got, at = self.value(at)
            out.append(got)
            at = self.skip(at)
            if self.text[at : at + 1] == ",":
                at = self.skip(at + 1)
            elif self.text[at : at + 1] != "]":
                raise Unclosed
        return (DYNAMIC if any(x is DYNAMIC for x in out) else out), at + 1

    def members(self, at: int) -> tuple[dict | None, int]:
        """Members of the object at `at`; null if one is spread, computed or no plain member."""
        end, out = self.close(at), {}
        at = self.skip(at + 1)
        while at < end - 1:
            c = self.text[at]
            if c in "\"'":
                key, at = self.string(at)
            elif m := _NAME.match(self.text, at):
                key, at = m[0], m.end()
            else:
                return None, end
            at = self.skip(at)
            if self.text[at : at + 1] == ":":
                out[key], at = self.value(at + 1)
            elif self.text[at : at + 1] in (",", "}"):
                out[key] = DYNAMIC
            else:
                return None, end
            at = self.skip(at)
            if self.text[at : at + 1] == ",":
                at = self.skip(at + 1)
        return out, end


_TOOL = re.compile(r"\b(?:tools|functions)\s*(?:\.\s*([A-Za-z_$][\w$]*)|\[\s*[\"']([^\"']+)[\"']\s*\])\s*\(")


def recover(text: str | None) -> tuple[str, list[dict]]:
    """(status, calls) of a JS text; a call has tool, start, status (candidate or the reason against it), command, dynamic members and context."""
    if text is None:
        return "invalid_input", []
    if len(text) > MOST_CHARS:
        return "oversized_input", []
    code, out = Code(text), []
    opened: list[tuple[str, str]] = []
    at = before = 0
    try:
        while at < len(text):
            c = text[at]
            if c in "\"'`":
                at = code.string(at)[1]
                continue
            if text.startswith(("//", "/*"), at):
                past = code.skip(at)
                if past == at:
                    raise Unclosed
                at = past
                continue
            if (m := _TOOL.match(text, at)) and (not at or not (text[at - 1].isalnum() or text[at - 1] in "_$.")):
                tool = m[1] or m[2]
                if tool.rsplit("__", 1)[-1] in SHELL_NAMES:
                    out.append(_call(code, tool, at, m.end() - 1, [h for _, h in opened if h]))
            if c in "([{":
                head = _HEAD.search(text[before:at])
                opened.append((c, (head[1] or "arrow") if head else ""))
                before = at + 1 if c == "{" else before
            elif c in ")]}":
                if not opened or "([{".index(opened.pop()[0]) != ")]}".index(c):
                    raise Unclosed
                before = at + 1 if c == "}" else before
            elif c == ";":
                before = at + 1
            at += 1
    except Unclosed:
        return "parse_error", []
    return ("parse_error", []) if opened else ("parsed", out)


def _call(code: Code, tool: str, start: int, bracket: int, context: list[str]) -> dict:
    end = code.close(bracket)
    call = {"tool": tool, "start": start, "status": "candidate", "command": None, "dynamic": [], "context": list(dict.fromkeys(context))}
    at = code.skip(bracket + 1)
    values = None
    if code.text[at] == "{":
        values, past = code.members(at)
        past = code.skip(past)
        if code.text[past] == ",":
            past = code.skip(past + 1)
        if past != end - 1:
            return call | {"status": "non_literal_argument_object"}
        if values is None:
            return call | {"status": "spread_computed_or_accessor_property"}
    else:
        return call | {"status": "non_literal_argument_object"}
    found = next((values[k] for k in ("cmd", "command", "command_line") if k in values), None)
    if isinstance(found, list) and found and all(isinstance(x, str) for x in found):
        found = json.dumps(found, ensure_ascii=False)
    if not isinstance(found, str):
        return call | {"status": "missing_or_dynamic_command"}
    return call | {"command": found, "dynamic": [k for k, v in values.items() if v is DYNAMIC]}


# ---- PowerShell

_PS_WORD = re.compile(r"""'(?:[^']|'')*'|"(?:[^"`$]|`.|"")*"|"(?:[^"`]|`.|"")*"|[|;{}()]|&&|\|\||[^\s'";|{}()]+""")


def _ps_value(word: str) -> tuple[bool, object]:
    """(known, value) of a word: quoted texts without a variable, and bare words and numbers."""
    if word[0] == "'":
        return True, word[1:-1].replace("''", "'")
    if word[0] == '"':
        return ("$" not in word, re.sub("`(.)", r"\1", word[1:-1]))
    if re.fullmatch(r"-?\d+", word):
        return True, int(word)
    return ("$" not in word and word[0] not in "@(", word)


def read_status(words: list[str]) -> dict:
    """What one Get-Content command is: a read candidate with its plan, or the first thing that speaks against it."""
    given: dict[str, object] = {}
    plain: list[object] = []
    words = iter(words)
    for w in words:
        if w[0] == "-" and re.match("-[A-Za-z]", w):
            key = w[1:].rstrip(":").lower()
            if key not in ("literalpath", "path", "head", "totalcount", "tail", "encoding"):
                return {"status": "unsupported_parameter"}
            key = "totalcount" if key == "head" else key
            if key in given:
                return {"status": "duplicate_parameter"}
            value = next(words, None)
            if value is None:
                return {"status": "missing_parameter_value"}
            known, given[key] = _ps_value(value)
            if not known:
                return {"status": "dynamic_parameter"}
        else:
            known, value = _ps_value(w)
            if not known:
                return {"status": "dynamic_positional"}
            plain.append(value)
    if "literalpath" in given and "path" in given:
        return {"status": "conflicting_path_parameters"}
    literal = "literalpath" in given
    path = given.get("literalpath", given.get("path"))
    if path is not None and plain:
        return {"status": "extra_positional"}
    if path is None:
        if len(plain) != 1:
            return {"status": "missing_or_multiple_paths"}
        path = plain[0]
    if not isinstance(path, str) or not path:
        return {"status": "invalid_path"}
    if not literal and any(c in path for c in "*?[]"):
        return {"status": "wildcard_path"}
    if ("tail" in given) == ("totalcount" in given):
        return {"status": "missing_or_conflicting_count"}
    n = given.get("tail", given.get("totalcount"))
    if not isinstance(n, int) or not 1 <= n <= 100:
        return {"status": "unsupported_count"}
    if str(given.get("encoding", "utf8")).lower() not in ("utf8", "utf8bom", "utf8nobom"):
        return {"status": "unsupported_encoding"}
    return {"status": "read_candidate", "op": "read_tail" if "tail" in given else "read_head", "limit": n}


def reads(text: str | None) -> list[dict]:
    """The Get-Content commands of a PowerShell text in order, each with its status and whether it stands in a block."""
    out: list[dict] = []
    words: list[str] = []
    depth = 0

    def done() -> None:
        if words and words[0].lower() == "get-content":
            out.append(read_status(words[1:]) | {"in_block": depth > 0})
        words.clear()

    for m in _PS_WORD.finditer(text or ""):
        w = m[0]
        if w in ("|", ";", "&&", "||", "{", "}", "(", ")"):
            done()
            depth = max(0, depth + (w in "{(") - (w in "})"))
        elif "\n" in (text or "")[m.start() - 1 : m.start()]:
            done()
            words.append(w)
        else:
            words.append(w)
    done()
    return out


CALL_ROWS = "id string, unit_status string, tool string, status string, command string, dynamic string, context string"
READ_ROWS = "id string, status string, op string, limit int, in_block boolean"


def _rows(batches: Iterator[pa.RecordBatch], find, names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [r for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in find(key, text)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


def recovered_calls(cells: DataFrame) -> DataFrame:
    """One row per shell call of the cells (id, code), or one row with null tool for a cell without any; nothing is executed."""

    def find(key, text):
        status, calls = recover(text)
        if not calls:
            yield key, status, None, None, None, None, None
        for c in calls:
            yield key, status, c["tool"], c["status"], c["command"], "|".join(c["dynamic"]), "|".join(c["context"])

    names = [x.split()[0] for x in CALL_ROWS.split(", ")]
    return cells.select(F.col("id").cast("string"), "code").mapInArrow(lambda it: _rows(it, find, names, [pa.string()] * 7), CALL_ROWS)


def recovered_reads(commands: DataFrame) -> DataFrame:
    """One row per Get-Content command of the texts (id, code)."""

    def find(key, text):
        for r in reads(text):
            yield key, r["status"], r.get("op"), r.get("limit"), r["in_block"]

    names = [x.split()[0] for x in READ_ROWS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
    return commands.select(F.col("id").cast("string"), "code").mapInArrow(lambda it: _rows(it, find, names, types), READ_ROWS)
