"""Scalar functions over JSON values, digests and texts as Column expressions.

Variants keep the raw JSON type, so a boolean never becomes an exit code.
Nulls give nulls unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_strict(c: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; null otherwise.

    The engine's own parser stops after the first value, so a text whose beginning was cut would pass; inside brackets
    whatever follows is an error or a second element.
    """
    whole = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.try_variant_get(whole, "$[1]", "variant").isNull(), F.try_variant_get(whole, "$[0]", "variant"))


def json_string(c: Column) -> Column:
    """A text as a JSON string, quotes included; only quotes, backslashes and control characters are escaped, these with small hexadecimal digits."""
    plain = F.regexp_replace(F.to_json(F.array(c)), r"\A\[|\]\z", "")
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}
    escapes = F.create_map(*[F.lit(x) for k in [*range(32), 34, 92] for x in (chr(k), short.get(k, f"\\u{k:04x}"))])
    # the engine writes capital digits, so texts with such characters, which are rare, are escaped one by one
    single = F.array_join(F.transform(F.split(c, "", -1), lambda x: F.coalesce(F.try_element_at(escapes, x), x)), "")
    return F.when(c.rlike(r"[\x0b\x0e\x0f\x1a-\x1f]"), F.concat(F.lit('"'), single, F.lit('"'))).when(c.isNotNull(), plain)


def digest(*parts: Column) -> Column:
    """SHA-256 of the JSON of one text, or of the list of several."""
    texts = [json_string(p) for p in parts]
    return F.sha2(texts[0] if len(texts) == 1 else F.concat(F.lit("["), F.concat_ws(", ", *texts), F.lit("]")), 256)


def digest_list(c: Column) -> Column:
    """SHA-256 of the JSON of an array of texts."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(c, json_string), ", "), F.lit("]")), 256)


def path_of(name: str) -> str | None:
    """The variant path of a top-level member, its name taken literally; null for a name with both sorts of quotes, which no path can hold."""
    for quote in "'\"":
        if quote not in name:
            return f"$[{quote}{name}{quote}]"
    return None


def member(v: Column, path: str, kind: str = "string") -> Column:
    """The value at a path of a variant if it is of that JSON type; null otherwise, as for an absent path."""
    got = F.try_variant_get(v, path, kind)
    if kind == "string":
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", got)
    if kind in ("int", "bigint"):
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT", got)
    return got


def text_content(v: Column) -> Column:
    """Text of a variant: the string itself, or the `text` members of an array of objects joined by line ends; else null."""
    items = F.try_variant_get(v, "$", "array<variant>")
    texts = F.array_compact(F.transform(items, lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), member(x, "$.text"))))
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.array_join(texts, "\n"))


#: members that hold a result's output, in order
OUTPUTS = ("output", "stdout", "aggregated_output", "content", "error")


def result_output(v: Column) -> Column:
    """The output of a result object: the first of its output members with text, standard error after standard output."""
    found = []
    for name in OUTPUTS:
        text = base = text_content(F.try_variant_get(v, f"$.{name}", "variant"))
        if name == "stdout":
            err = member(v, "$.stderr")
            text = F.when(err.isNotNull(), F.concat(text, F.lit("\n"), err)).otherwise(text)
        found.append(F.when((base != "") | (member(v, f"$.{name}") == ""), text))
    return F.coalesce(*found, text_content(v))


def result_exit(v: Column) -> Column:
    """The exit code of a result object; booleans and texts are none."""
    return F.coalesce(member(v, "$.exit_code", "int"), member(v, "$.exitCode", "int"))


# Names of tools that run a shell command, by the last part of the name.
SHELL_NAMES = ["exec_command", "shell_command", "shell", "bash", "powershell", "run_terminal_cmd", "run_terminal_command", "run_shell_command", "oc_bash"]


def is_shell_tool(tool: Column) -> Column:
    """Whether a tool runs shell commands, by the last part of its name after dots and double underscores."""
    last = F.element_at(F.split(F.element_at(F.split(tool, r"\.", -1), -1), "__", -1), -1)
    return F.coalesce(F.lower(last).isin(*SHELL_NAMES), F.lit(False))


def command_member(v: Column) -> Column:
    """The command text in a tool's input: the first of its command members that is a text with more than blanks."""
    tests = [F.when(member(v, f"$.{k}").rlike(r"\S"), member(v, f"$.{k}")) for k in ("cmd", "command", "command_line")]
    return F.coalesce(*tests)


def shell_text(text: Column, argv: Column) -> Column:
    """The command as shell text: the text itself, or the last argument of a PowerShell call by -Command or -c; else null."""
    name = F.lower(F.element_at(F.split(F.replace(F.try_element_at(argv, F.lit(1)), F.lit("\\"), F.lit("/")), "/", -1), -1))
    flag = F.lower(F.try_element_at(argv, F.lit(-2)))
    from_argv = F.when(name.isin("powershell", "powershell.exe", "pwsh", "pwsh.exe") & flag.isin("-command", "-c") & (F.size(argv) > 2), F.try_element_at(argv, F.lit(-1)))
    return F.coalesce(text, from_argv)


# The one form of a read command that is a contract.
READ = r"""(?i)^\s*Get-Content\s+(?:(-LiteralPath|-Path)\s+)?('(?:[^']|'')*'|"[^"$`]*"|[^\s'";|&<>$`(){}]+)\s+-(Head|TotalCount|Tail)\s+(\d+)\s*$"""


def read_contract(text: Column) -> Column:
    """struct(op, limit, value, path) of a plain read command; null for any other.

    The path of the source never comes out. Patterns, stdin marks and limits outside 1 to 100 are none.
    """
    g = lambda k: F.regexp_extract(text, READ, k)
    raw, n = g(2), g(4).try_cast("int")
    quoted = raw.rlike("^['\"]")
    path = F.when(raw.startswith("'"), F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))).when(raw.startswith('"'), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    good = text.rlike(READ) & n.between(1, 100) & (quoted | ~raw.rlike("^[@#-]")) & (path != "") & ((F.lower(g(1)) == "-literalpath") | ~path.rlike(r"[*?\[\]]"))
    op = F.when(F.lower(g(3)) == "tail", "read_tail").otherwise("read_head")
    return F.when(good, F.struct(op.alias("op"), n.alias("limit"), F.lit("").alias("value"), F.lit("fixture.txt").alias("path")))


UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def session_key(session: Column, kind: Column) -> Column:
    """Digest of the first UUID in a session's name, or of its source kind and whole name."""
    uuid = F.lower(F.regexp_extract(session, f"(?i){UUID}", 0))
    return F.when(uuid != "", digest(uuid)).otherwise(digest(kind, session))


def request_text(context: Column) -> Column:
    """A request without case, with single blanks, and with ids and absolute paths replaced; null below eight words."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(context, r"(?U)\s+", " "), "^ | $", ""))
    out = F.regexp_replace(F.regexp_replace(bare, UUID, "<id>"), r"""[a-z]:[\\/][^\s"'<>]+""", "<path>")
    return F.when(F.size(F.split(bare, " ")) >= 8, out)


def task_key(context: Column) -> Column:
    return digest(request_text(context))


def execution(exit_code: Column) -> Column:
    return F.when(exit_code.isNull(), "unknown").when(exit_code == 0, "exit_zero").otherwise("exit_nonzero")
