"""SQL text of the annotations for the DuckDB oracle, written from the same rule tables."""

from __future__ import annotations

from loomlog.functions import rules
from loomlog.functions.classify import ISO


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hit(column: str, pattern: str) -> str:
    """The oracle's engine has no lookahead, so the one rule that uses it is split in two."""
    part = r"SyntaxError: (?!.*python)|"
    if part in pattern:
        rest = pattern.replace(part, "")
        return f"(coalesce(regexp_matches({column}, {q(rest)}), false) OR coalesce(regexp_matches(regexp_replace({column}, 'SyntaxError: .*python', '', 'g'), 'SyntaxError: '), false))"
    return f"coalesce(regexp_matches({column}, {q(pattern)}), false)"


def case(column: str, table: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {hit(column, rx)} THEN {q(name)}" for name, rx in table) + f" ELSE {otherwise} END"


def every(column: str, table: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {hit(column, rx)} THEN {q(name)} END" for name, rx in table) + "], lambda x: x IS NOT NULL)"


def _family() -> str:
    m = "lower(coalesce(nullif(model, ''), 'unknown'))"
    tests = [" OR ".join([f"contains({m}, {q(p)})" for p in parts] + [f"{m} = {q(w)}" for w in whole]) for parts, whole, _ in rules.FAMILIES]
    return "CASE " + " ".join(f"WHEN {t} THEN {q(name)}" for t, (_, _, name) in zip(tests, rules.FAMILIES)) + " ELSE 'other' END"


_NO_CMD = "(cmd IS NULL OR cmd = '')"
_TEXT = "(coalesce(out, '') || chr(10) || coalesce(err, ''))"
_COUNT = "((length(coalesce(cmd, '')) - length(replace(coalesce(cmd, ''), {0}, ''))) // length({0}))"
_LINES = f"(CASE WHEN coalesce(cmd, '') = '' THEN 0 ELSE {_COUNT.format('chr(10)')} + 1 END)"
_SEGS = r"len(list_filter(regexp_split_to_array(coalesce(cmd, ''), '&&|\|\||;|\n'), lambda s: regexp_matches(s, '\S')))"
EXPRESSIONS = {
    "family": _family(),
    "vendor": "CASE WHEN family LIKE 'GPT%' THEN 'OpenAI' WHEN family LIKE 'Claude%' THEN 'Anthropic' WHEN family LIKE 'Grok%' THEN 'xAI' " + " ".join(f"WHEN family = {q(a)} THEN {q(b)}" for a, b in rules.VENDORS[3:]) + " ELSE 'other' END",
    "host": "CASE WHEN source = 'claude-code' THEN CASE WHEN tool = 'Bash' THEN 'git-bash' ELSE 'pwsh7' END WHEN source = 'codex' THEN CASE WHEN contains(lower(coalesce(shell_param, '')), 'cmd') THEN 'cmd.exe' "
    "WHEN contains(lower(coalesce(shell_param, '')), 'bash') OR lower(shell_param) = 'sh' THEN 'bash' ELSE 'powershell' END WHEN source = 'opencode' THEN CASE WHEN tool = 'shell' THEN 'cmd.exe' ELSE 'powershell5' END WHEN source = 'cursor' THEN 'powershell' ELSE 'unknown' END",
    "dialect": f"CASE WHEN {_NO_CMD} THEN 'js-only' WHEN {hit('cmd', rules.POWERSHELL)} AND ({hit('cmd', rules.POSIX)} OR {hit('cmd', rules.CMD)}) OR {hit('cmd', rules.CMD)} AND {hit('cmd', rules.POSIX)} THEN 'mixed' "
    f"WHEN {hit('cmd', rules.POWERSHELL)} THEN 'powershell' WHEN {hit('cmd', rules.CMD)} THEN 'cmd' WHEN {hit('cmd', rules.POSIX)} THEN 'posix' ELSE 'neutral' END",
    "interp": f"CASE WHEN {_NO_CMD} THEN [] ELSE {every('cmd', rules.INTERPRETERS)} END",
    "interp0": "interp[1]",
    "segments": f"CASE WHEN {_NO_CMD} THEN ['js-only'] ELSE list_transform(list_filter(regexp_split_to_array(cmd, {q(rules.SEGMENT)}), lambda s: regexp_matches(s, '\\S')), lambda s: {case('s', rules.CATEGORIES, q('other'))}) END",
    "cats": "list_sort(list_distinct(segments))",
    "cat": f"CASE WHEN {_NO_CMD} THEN 'js-only' " + " ".join(f"WHEN list_contains(segments, {q(s)}) THEN {q(s)}" for s in rules.STRONG)
    + " ELSE (SELECT CASE WHEN coalesce(m.s, 'other') = 'other' THEN " + case("cmd", rules.CATEGORIES, q("other")) + " ELSE m.s END FROM (SELECT list_sort(list_transform(list_distinct(segments), lambda x: {'n': -len(list_filter(segments, lambda y: y = x)), 'at': list_position(segments, x), 'name': x}))[1].name AS s) m) END",
    "cx_len": "length(coalesce(cmd, ''))", "cx_segs": _SEGS, "cx_lines": _LINES, "cx_pipes": f"greatest({_COUNT.format(q('|'))} - 2 * {_COUNT.format(q('||'))}, 0)",
    "bucket": "CASE WHEN cx_len = 0 THEN 'js-only' WHEN cx_lines >= 4 OR cx_len > 600 THEN 'script (4+ lines or >600 chars)' WHEN cx_segs >= 5 THEN 'batch (5+ commands)' WHEN cx_segs >= 2 THEN 'chain (2-4 commands)' ELSE 'single command' END",
    "cause": f"CASE WHEN ok = false THEN {case(_TEXT, rules.CAUSES[:-1], q('nonzero/other'))} END",
    "term": "coalesce(" + ", ".join(f"nullif(regexp_extract({_TEXT}, {q(rules.NOT_FOUND_NAME)}, {k}), '')" for k in range(1, 5)) + ")",
    "term_name": r"regexp_replace(term, '^.*[/\\]', '')",
    "cause_detail": "CASE WHEN cause = 'not-found' AND term IS NOT NULL THEN CASE WHEN list_contains([" + ", ".join(map(q, rules.UNIX_TOOLS)) + "], term_name) THEN 'unix tool in Windows shell: ' || term_name "
    f"WHEN regexp_matches(term_name, {q(rules.CMDLET)}) THEN 'PowerShell cmdlet in non-PS shell: ' || term_name ELSE 'missing program: ' || term_name END END",
    "hidden": f"coalesce(ok AND {hit('out', rules.HIDDEN)}, false)",
    "mismatch": "(dialect = 'posix' AND host IN ('powershell', 'powershell5', 'cmd.exe', 'pwsh7')) OR (dialect IN ('powershell', 'cmd') AND host IN ('git-bash', 'bash', 'zsh', 'sh'))",
    "purpose": f"CASE WHEN len(interp) > 0 THEN {every('cmd', rules.PURPOSES)} ELSE [] END",
    "epoch_ms": r"CASE WHEN regexp_matches(ts, '^\s*\d{13}\s*$') THEN CAST(regexp_extract(ts, '\d{13}') AS BIGINT) WHEN regexp_matches(ts, '" + ISO + r"') THEN epoch_ms(TRY_CAST(regexp_extract(ts, '" + ISO + r"', 1) || '-' || regexp_extract(ts, '" + ISO + r"', 2) || '-' || regexp_extract(ts, '" + ISO + r"', 3) || ' ' "
    r"|| regexp_extract(ts, '" + ISO + r"', 4) || ':' || regexp_extract(ts, '" + ISO + r"', 5) || ':' || coalesce(nullif(regexp_extract(ts, '" + ISO + r"', 6), ''), '00') || '.' || rpad(left(regexp_extract(ts, '" + ISO + r"', 7), 3), 3, '0') AS TIMESTAMP)) "
    r"- 60000 * (CASE WHEN regexp_extract(ts, '" + ISO + r"', 8) IN ('', 'Z') THEN 0 ELSE CAST(left(regexp_extract(ts, '" + ISO + r"', 8), 1) || '1' AS INT) * (60 * CAST(substr(regexp_extract(ts, '" + ISO + r"', 8), 2, 2) AS INT) + CAST(right(regexp_extract(ts, '" + ISO + r"', 8), 2) AS INT)) END) END",
    "sort_ms": "coalesce(epoch_ms, 0)",
    "iso": "strftime(epoch_ms(epoch_ms), '%Y-%m-%dT%H:%M:%S.%gZ')",
    "day": "left(iso, 10)",
}
_NEEDS = {
    "vendor": ["family"], "interp0": ["interp"], "cats": ["segments"], "cat": ["segments"], "bucket": ["cx_len", "cx_segs", "cx_lines"], "term_name": ["term"],
    "cause_detail": ["cause", "term_name"], "mismatch": ["dialect", "host"], "purpose": ["interp"], "sort_ms": ["epoch_ms"], "iso": ["epoch_ms"], "day": ["iso"],
}


def annotated(*names: str, table: str = "records") -> str:
    """A WITH clause whose last table `a` holds the rows of a table with the named annotations."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    steps, last = [], table
    for i, n in enumerate(order):
        steps.append(f"t{i} AS (SELECT *, {EXPRESSIONS[n]} AS {n} FROM {last})")
        last = f"t{i}"
    return "WITH " + ", ".join([*steps, f"a AS (SELECT * FROM {last})"]) + " "
