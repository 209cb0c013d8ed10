"""SQL of the instants of mixed timestamps for the oracle, written from the formats and not from the operator's steps."""

from __future__ import annotations

from loomlog.operators.instants import ABBREVIATIONS, MONTHS

_ZONE = r"(Z|[A-Z]{2,4}|(?:UTC|GMT)?[+-]\d{2}:?\d{2})"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_MON = "((?i:" + "|".join(MONTHS) + ")[a-z]{0,6})"
_DAY = r"(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]{0,6}"
#: names of the groups of each format in order, and its pattern
_FORMATS = [
    ("y m d h i s f z r", rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[Tt ]\s*{_CLOCK}\s*{_ZONE}?(?:\[([A-Za-z_]+(?:[/+-][A-Za-z0-9_+-]+)*)\])?"),
    ("y m d h i s f z r", rf"(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})[Tt ]\s*{_CLOCK}\s*{_ZONE}?(?:\[([A-Za-z_]+(?:[/+-][A-Za-z0-9_+-]+)*)\])?"),
    ("y m d h i s f z", rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?\s*{_ZONE}"),
    ("y m d h i s f", r"(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?"),
    ("m d y h i s f ap z", rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{_CLOCK}(?:\s*((?i:[ap]m)))?\s*{_ZONE}?"),
    ("d m y h i s f z", rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_CLOCK}\s*{_ZONE}?"),
    ("d m y h i s f z", rf"(?:{_DAY},?\s+)?(\d{{1,2}})[ -]{_MON}[ -](\d{{4}}),?\s+{_CLOCK}\s*{_ZONE}?"),
    ("m d h i s f z y", rf"{_DAY}\s+{_MON}\s+(\d{{1,2}})\s+{_CLOCK}\s+(?:{_ZONE}\s+)?(\d{{4}})"),
]


def _parts() -> str:
    out = []
    for names, rx in _FORMATS:
        of = {n: f"regexp_extract(v, '^(?:{rx})$', {k})" for k, n in enumerate(names.split(), 1)}
        out.append(f"WHEN regexp_matches(v, '^(?:{rx})$') THEN {{" + ", ".join(f"'{n}': {of.get(n, chr(39) * 2)}" for n in ("y", "m", "d", "h", "i", "s", "f", "ap", "z", "r")) + "}")
    return "CASE " + " ".join(out) + " END"


_ABBR = "CASE p.z " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ABBREVIATIONS.items()) + " END"
_CANONICAL = r"(regexp_matches(value, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$') AND NOT contains(value, chr(10)))"
_INSTANTS = rf"""WITH zones AS (SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k, min(tz) AS tz FROM sessions GROUP BY 1),
rows AS (SELECT 'records' AS tbl, CAST(ordinal AS VARCHAR) AS row_key, session, ts AS value FROM records UNION ALL SELECT DISTINCT 'session_message', id, session_id, CAST(time_created AS VARCHAR) FROM session_message UNION ALL SELECT DISTINCT 'commands_normalized', record_id, session, timestamp FROM commands_normalized),
x AS (SELECT tbl, row_key, value, coalesce(tz, 'UTC') AS tz, regexp_replace(value, '^\s+|\s+$', '', 'g') AS v FROM rows LEFT JOIN zones ON k = lower(regexp_replace(session, '^\s+|\s+$', '', 'g'))),
y AS (SELECT *, {_parts()} AS p, CASE WHEN regexp_matches(v, '^[+-]?\d{{9,19}}(\.\d{{1,9}})?$') THEN try_cast(regexp_extract(v, '^[+-]?\d+') AS BIGINT) END AS n, coalesce(try_cast(rpad(left(regexp_extract(v, '\.(\d{{1,9}})$', 1), 3), 3, '0') AS BIGINT), 0) AS nf FROM x),
c AS (SELECT *, try_cast(p.h AS INT) AS h0, coalesce(list_position({MONTHS}, lower(left(p.m, 3))), try_cast(p.m AS INT)) AS mon FROM y),
l AS (SELECT *, CASE WHEN p.ap <> '' AND h0 NOT BETWEEN 1 AND 12 THEN NULL ELSE try_cast(lpad(p.y, 4, '0') || '-' || lpad(CAST(mon AS VARCHAR), 2, '0') || '-' || lpad(p.d, 2, '0') || ' ' || lpad(CAST(CASE WHEN p.ap = '' THEN h0 ELSE h0 % 12 + CASE WHEN lower(p.ap) = 'pm' THEN 12 ELSE 0 END END AS VARCHAR), 2, '0') || ':' || p.i || ':' || CASE WHEN p.s = '' THEN '00' ELSE p.s END || '.' || rpad(left(p.f, 3), 3, '0') AS TIMESTAMP) END AS wall, regexp_replace(p.z, '^(UTC|GMT)([+-])', '\2') AS z2 FROM c),
t AS (SELECT *, CASE WHEN p.r = '' THEN tz ELSE p.r END AS zone FROM l),
w AS (SELECT *, CASE WHEN p.z = '' AND wall IS NOT NULL THEN timezone(zone, wall) END AS late FROM t),
i AS (SELECT tbl, row_key, value, CASE WHEN n IS NOT NULL THEN CASE WHEN abs(n) < 100000000000 THEN n * 1000 + nf WHEN abs(n) < 100000000000000 THEN n WHEN abs(n) < 100000000000000000 THEN CAST(trunc(n / 1000) AS BIGINT) ELSE n // 1000000 END
WHEN wall IS NULL THEN NULL WHEN p.z = '' THEN CASE WHEN timezone(zone, late) <> wall THEN NULL WHEN timezone(zone, late - INTERVAL 1 HOUR) = wall THEN epoch_ms(late - INTERVAL 1 HOUR) ELSE epoch_ms(late) END
WHEN regexp_matches(z2, '^[+-]\d') THEN epoch_ms(wall) - 60000 * CAST(left(z2, 1) || '1' AS INT) * (60 * CAST(substr(z2, 2, 2) AS INT) + CAST(right(z2, 2) AS INT)) ELSE epoch_ms(wall) - 60000 * {_ABBR} END AS epoch_ms FROM w) """

FOUND = _INSTANTS + f"SELECT DISTINCT tbl, row_key, epoch_ms FROM i WHERE epoch_ms IS NOT NULL AND NOT {_CANONICAL}"
ALL = _INSTANTS + "SELECT tbl, row_key, value, epoch_ms FROM i"
