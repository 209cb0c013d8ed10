"""Classifiers of command records as native Column expressions, generated from the rule tables.

Every function takes Columns and returns a Column; no Python runs per row.
Null or empty commands have the dialect, category and bucket `js-only`; a null
`ok` is neither success nor failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import rules


def matches(c: Column, pattern: str) -> Column:
    """True where the pattern is found, with Unicode word characters and newline as the only line end."""
    return F.coalesce(c.rlike("(?dU)" + pattern), F.lit(False))


def first_match(c: Column, table: list[tuple[str, str]], otherwise: str | None) -> Column:
    """The name of the first rule that matches."""
    out = None
    for name, rx in table:
        out = F.when(matches(c, rx), name) if out is None else out.when(matches(c, rx), name)
    return out.otherwise(F.lit(otherwise))


def all_matches(c: Column, table: list[tuple[str, str]]) -> Column:
    """The names of all rules that match, in the order of the table."""
    return F.array_compact(F.array(*[F.when(matches(c, rx), name) for name, rx in table]))


def empty(cmd: Column) -> Column:
    return cmd.isNull() | (cmd == "")


def family(model: Column) -> Column:
    m = F.lower(F.coalesce(F.when(model != "", model), F.lit("unknown")))
    out = F
    for parts, whole, name in rules.FAMILIES:
        test = F.lit(False)
        for p in parts:
            test = test | m.contains(p)
        for w in whole:
            test = test | (m == w)
        out = out.when(test, name)
    return out.otherwise("other")


def census_family(model: Column, names: list[str], otherwise: str) -> Column:
    """The family by the rules of the given names only, each by its first substring."""
    m = F.lower(F.coalesce(model, F.lit("")))
    out = F
    for parts, _, name in rules.FAMILIES:
        if name in names:
            out = out.when(m.contains(parts[0]), name)
    return out.otherwise(otherwise)


def vendor(fam: Column) -> Column:
    out = F
    for start, name in rules.VENDORS:
        out = out.when(fam.startswith(start) if start in ("GPT", "Claude", "Grok") else fam == start, name)
    return out.otherwise("other")


def host_shell(source: Column, tool: Column, shell_param: Column, platform: str = "windows", user_shell: str = "bash") -> Column:
    """The shell that runs a tool's commands; platform and user_shell are parameters, never the worker's environment."""
    if platform != "windows":
        return F.when((source == "claude-code") & (tool == "PowerShell"), "pwsh7").otherwise(user_shell.rsplit("/", 1)[-1] or "bash")
    p = F.lower(F.coalesce(shell_param, F.lit("")))
    codex = F.when(p.contains("cmd"), "cmd.exe").when(p.contains("bash") | (p == "sh"), "bash").otherwise("powershell")
    return (
        F.when(source == "claude-code", F.when(tool == "Bash", "git-bash").otherwise("pwsh7")).when(source == "codex", codex)
        .when(source == "opencode", F.when(tool == "shell", "cmd.exe").otherwise("powershell5")).when(source == "cursor", "powershell").otherwise("unknown")
    )


def dialect(cmd: Column) -> Column:
    ps, cm, px = (matches(cmd, rx) for rx in (rules.POWERSHELL, rules.CMD, rules.POSIX))
    return F.when(empty(cmd), "js-only").when(ps & (px | cm) | cm & px, "mixed").when(ps, "powershell").when(cm, "cmd").when(px, "posix").otherwise("neutral")


def interpreters(cmd: Column) -> Column:
    return F.when(empty(cmd), F.array().cast("array<string>")).otherwise(all_matches(cmd, rules.INTERPRETERS))


def segment_categories(cmd: Column) -> Column:
    """The category of each segment that is not blank, in order."""
    segments = F.filter(F.split(cmd, rules.SEGMENT, -1), lambda s: s.rlike(r"\S"))
    return F.when(empty(cmd), F.array(F.lit("js-only"))).otherwise(F.transform(segments, lambda s: first_match(s, rules.CATEGORIES, "other")))


def primary_category(cmd: Column, found: Column) -> Column:
    """The strongest category, else the most frequent (the earliest of equals), else that of the whole command."""
    out = F.when(empty(cmd), "js-only")
    for name in rules.STRONG:
        out = out.when(F.array_contains(found, name), name)
    ranked = F.array_sort(F.transform(F.array_distinct(found), lambda x: F.struct((-F.size(F.filter(found, lambda y: y == x))).alias("n"), F.array_position(found, x).alias("at"), x.alias("name"))))
    most = F.coalesce(F.try_element_at(ranked, F.lit(1))["name"], F.lit("other"))
    return out.otherwise(F.when(most == "other", first_match(cmd, rules.CATEGORIES, "other")).otherwise(most))


def complexity(cmd: Column) -> Column:
    """struct(segs, pipes, len, lines, bucket)."""
    c = F.coalesce(cmd, F.lit(""))
    segs = F.size(F.filter(F.split(c, r"&&|\|\||;|\n", -1), lambda s: s.rlike(r"\S")))
    count = lambda s: (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s)
    pipes = F.greatest(count("|") - count("||") * 2, F.lit(0))
    lines = F.when(c == "", 0).otherwise(count("\n") + 1)
    bucket = (
        F.when(c == "", "js-only").when((lines >= 4) | (F.length(c) > 600), "script (4+ lines or >600 chars)")
        .when(segs >= 5, "batch (5+ commands)").when(segs >= 2, "chain (2-4 commands)").otherwise("single command")
    )
    return F.struct(segs.alias("segs"), pipes.cast("int").alias("pipes"), F.length(c).alias("len"), lines.cast("int").alias("lines"), bucket.alias("bucket"))


def output_text(out: Column, err: Column) -> Column:
    return F.concat(F.coalesce(out, F.lit("")), F.lit("\n"), F.coalesce(err, F.lit("")))


def failure_cause(ok: Column, text: Column) -> Column:
    return F.when(~ok, first_match(text, rules.CAUSES[:-1], "nonzero/other"))


def cause_detail(cause: Column, text: Column) -> Column:
    """What was not found, for failures of that cause."""
    groups = [F.regexp_extract(text, "(?dU)" + rules.NOT_FOUND_NAME, k) for k in range(1, 5)]
    term = F.coalesce(*[F.when(g != "", g) for g in groups])
    name = F.regexp_replace(term, r"^.*[/\\]", "")
    return F.when((cause == "not-found") & (term != ""),
        F.when(name.isin(rules.UNIX_TOOLS), F.concat(F.lit("unix tool in Windows shell: "), name))
        .when(name.rlike(rules.CMDLET), F.concat(F.lit("PowerShell cmdlet in non-PS shell: "), name)).otherwise(F.concat(F.lit("missing program: "), name)))


def hidden_failure(ok: Column, out: Column) -> Column:
    return F.coalesce(ok & matches(out, rules.HIDDEN), F.lit(False))


def mismatch(dialect_: Column, host: Column) -> Column:
    posix_on_windows = (dialect_ == "posix") & host.isin("powershell", "powershell5", "cmd.exe", "pwsh7")
    return posix_on_windows | dialect_.isin("powershell", "cmd") & host.isin("git-bash", "bash", "zsh", "sh")


def purposes(cmd: Column, interp: Column) -> Column:
    return F.when(F.size(interp) > 0, all_matches(cmd, rules.PURPOSES)).otherwise(F.array().cast("array<string>"))


#: an ISO date and clock time in its long and its compact form
ISO = r"^\s*(\d{4})-?(\d{2})-?(\d{2})[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?(Z|[+-]\d{2}:?\d{2})?\s*$"


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 UTC of epoch milliseconds or ISO text, which counts as UTC where it has no offset; else null.

    Nothing depends on the session's zone. For all other formats use operators.instants.
    """
    part = lambda k: F.regexp_extract(ts, ISO, k)
    second = F.when(part(6) == "", "00").otherwise(part(6))
    stamp = F.concat_ws("", part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), second, F.lit("."), F.rpad(F.left(part(7), F.lit(3)), 3, "0"), F.lit("+00:00"))
    digits = F.regexp_replace(part(8), "[:Z]", "")
    minutes = F.when(digits == "", 0).otherwise(F.when(digits.startswith("-"), -1).otherwise(1) * (F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")))
    return F.when(ts.rlike(r"^\s*\d{13}\s*$"), F.regexp_extract(ts, r"\d{13}", 0).try_cast("long")).when(ts.rlike(ISO), F.unix_millis(stamp.try_cast("timestamp")) - minutes * 60000).cast("long")


def iso(ms: Column) -> Column:
    """Milliseconds since 1970 as ISO text in UTC, by integers only."""
    day, rest = F.floor(ms / 86_400_000), F.pmod(ms, F.lit(86_400_000))
    two = lambda c, n=2: F.lpad(c.cast("int").cast("string"), n, "0")
    clock = F.concat(two(F.floor(rest / 3_600_000)), F.lit(":"), two(F.floor(rest / 60_000) % 60), F.lit(":"), two(F.floor(rest / 1000) % 60), F.lit("."), two(rest % 1000, 3), F.lit("Z"))
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), clock)


#: name of each annotation, what it needs, how it is made
_STEPS = {
    "family": lambda p: family(F.col("model")), "vendor": lambda p: vendor(F.col("family")),
    "host": lambda p: host_shell(F.col("source"), F.col("tool"), F.col("shell_param"), **p), "dialect": lambda p: dialect(F.col("cmd")),
    "interp": lambda p: interpreters(F.col("cmd")), "interp0": lambda p: F.try_element_at("interp", F.lit(1)), "segments": lambda p: segment_categories(F.col("cmd")),
    "cats": lambda p: F.array_sort(F.array_distinct("segments")), "cat": lambda p: primary_category(F.col("cmd"), F.col("segments")), "cx": lambda p: complexity(F.col("cmd")),
    "cause": lambda p: failure_cause(F.col("ok"), output_text(F.col("out"), F.col("err"))), "cause_detail": lambda p: cause_detail(F.col("cause"), output_text(F.col("out"), F.col("err"))),
    "hidden": lambda p: hidden_failure(F.col("ok"), F.col("out")), "mismatch": lambda p: mismatch(F.col("dialect"), F.col("host")),
    "purpose": lambda p: purposes(F.col("cmd"), F.col("interp")), "epoch_ms": lambda p: epoch_ms(F.col("ts")), "sort_ms": lambda p: F.coalesce(F.col("epoch_ms"), F.lit(0)),
    "iso": lambda p: iso(F.col("epoch_ms")), "day": lambda p: F.left(F.col("iso"), F.lit(10)),
}
_NEEDS = {"vendor": ["family"], "interp0": ["interp"], "cats": ["segments"], "cat": ["segments"], "cause_detail": ["cause"], "mismatch": ["dialect", "host"], "purpose": ["interp"], "day": ["iso"], "iso": ["epoch_ms"], "sort_ms": ["epoch_ms"]}


def annotate(records: DataFrame, *names: str, platform: str = "windows", user_shell: str = "bash") -> DataFrame:
    """records with the named annotations, or with all; only what is asked for is computed."""
    params = {"platform": platform, "user_shell": user_shell}
    wanted: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in wanted:
            wanted.append(n)

    for n in names or _STEPS:
        need(n)
    for n in wanted:
        args = params if n == "host" else {}
        records = records.withColumn(n, _STEPS[n](args))
    return records
