"""Timestamps of mixed formats, precisions and zones as instants (problem 2).

All formats are compiled into one regex alternation with named groups. One
pass over a value rewrites it into a fixed row of components; calendar ranges
are validated on integers, and the instant is assembled by integer day
arithmetic. Everything runs inside the JVM.

Cases and their results:
- null, empty, blank, unknown words, dates or clock times out of range: null;
- an explicit offset, Z, a zone abbreviation or a [Region] wins over the
  default zone of the row;
- no zone: wall time in the row's zone, in UTC where that is null or unknown;
- a wall time that occurred twice: the first of the two; one that was skipped
  by a clock change: null;
- bare numbers: seconds, milli-, micro- or nanoseconds by their magnitude;
- digits finer than a millisecond are cut off.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.util import barrier

# Offsets in minutes of the abbreviations that name one offset.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_ZONE = r"(?:Z|[A-Z]{2,4}|(?:UTC|GMT)?[+-]\d{2}:?\d{2})"
_CLOCK = r"(?<h%s>\d{1,2}):(?<i%s>\d{2})(?::(?<s%s>\d{2})(?:[.,](?<f%s>\d{1,9}))?)?"
_MON = "(?:" + "|".join(MONTHS) + ")[a-z]{0,6}"
_DAY = r"(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]{0,6}"


def _clock(k: str) -> str:
    return _CLOCK % (k, k, k, k)


#: year first; compact; month first with slashes; day first with dots; day and month name; C's ctime; number
FORMATS = [
    rf"(?<yA>\d{{4}})(?<sep>[-/])(?<mA>\d{{1,2}})\k<sep>(?<dA>\d{{1,2}})[Tt ]\s*{_clock('A')}\s*(?<zA>{_ZONE})?(?:\[(?<rA>[A-Za-z_]+(?:[/+-][A-Za-z0-9_+-]+)*)\])?",
    rf"(?<yB>\d{{4}})(?<mB>\d{{2}})(?<dB>\d{{2}})[Tt ]?(?<hB>\d{{2}})(?<iB>\d{{2}})(?<sB>\d{{2}})(?:[.,](?<fB>\d{{1,9}}))?\s*(?<zB>{_ZONE})",
    rf"(?<yG>\d{{4}})(?<mG>\d{{2}})(?<dG>\d{{2}})[Tt ](?<hG>\d{{2}})(?<iG>\d{{2}})(?<sG>\d{{2}})(?:[.,](?<fG>\d{{1,9}}))?",
    rf"(?<mC>\d{{1,2}})/(?<dC>\d{{1,2}})/(?<yC>\d{{4}}),?\s+{_clock('C')}(?:\s*(?<apC>(?i:[ap]m)))?\s*(?<zC>{_ZONE})?",
    rf"(?<dD>\d{{1,2}})\.(?<mD>\d{{1,2}})\.(?<yD>\d{{4}}),?\s+{_clock('D')}\s*(?<zD>{_ZONE})?",
    rf"(?:{_DAY},?\s+)?(?<dE>\d{{1,2}})[ -](?<mE>(?i:{_MON}))[ -](?<yE>\d{{4}}),?\s+{_clock('E')}\s*(?<zE>{_ZONE})?",
    rf"{_DAY}\s+(?<mF>(?i:{_MON}))\s+(?<dF>\d{{1,2}})\s+{_clock('F')}\s+(?:(?<zF>{_ZONE})\s+)?(?<yF>\d{{4}})",
    r"(?<n>[+-]?\d{9,19})(?:\.(?<nf>\d{1,9}))?",
]
PATTERN = r"^\s*(?:" + "|".join(FORMATS) + r")\s*$"


def _pick(part: str, keys: str) -> str:
    return "".join("${%s%s}" % (part, k) for k in keys)


#: the named groups of all formats in a fixed order; of the alternatives only one is not empty
COMPONENTS = "|".join([
    _pick("y", "ABGCDEF"), _pick("m", "ABGCDEF"), _pick("d", "ABGCDEF"), _pick("h", "ABGCDEF"), _pick("i", "ABGCDEF"), _pick("s", "ABGCDEF"),
    _pick("f", "ABGCDE") + "${fF}", "${apC}", _pick("z", "ABCDEF"), "${rA}", "${n}", "${nf}",
])


#: names of the components in the order of COMPONENTS
PARTS = ["y", "m", "d", "h", "i", "s", "f", "half", "zone", "region", "n", "nf"]
_MAP = "map(" + ", ".join(f"'{name}', {k}" for k, name in enumerate(MONTHS, 1)) + ")"
_ABBR = "map(" + ", ".join(f"'{k}', {v}" for k, v in ABBREVIATIONS.items()) + ")"
_IANA = ", ".join(repr(z) for z in sorted(available_timezones()))

# The steps are written as SQL text: each is one analysed projection behind a barrier.
_NUMBERS = [
    "try_cast(_y AS INT) AS _y", "coalesce(try_cast(_m AS INT), try_element_at(" + _MAP + ", lower(left(_m, 3)))) AS _m", "try_cast(_d AS INT) AS _d",
    "CASE WHEN _half = '' THEN try_cast(_h AS INT) WHEN try_cast(_h AS INT) NOT BETWEEN 1 AND 12 THEN -1 ELSE try_cast(_h AS INT) % 12 + IF(lower(_half) = 'pm', 12, 0) END AS _h",
    "try_cast(_i AS INT) AS _i", "coalesce(try_cast(_s AS INT), 0) AS _s", "coalesce(try_cast(rpad(left(_f, 3), 3, '0') AS INT), 0) AS _ms",
    "_zone", "_region", "try_cast(_n AS BIGINT) AS _n", "coalesce(try_cast(rpad(_nf, 9, '0') AS BIGINT), 0) AS _nf",
]
_VALID = [
    "IF(_m <= 2, _y - 1, _y) AS _yy", "IF(_m > 2, _m - 3, _m + 9) AS _mm",
    "_y >= 1 AND _m BETWEEN 1 AND 12 AND _h BETWEEN 0 AND 23 AND _i BETWEEN 0 AND 59 AND _s BETWEEN 0 AND 59 AND _d BETWEEN 1 AND "
    "CASE WHEN _m = 2 THEN IF(_y % 4 = 0 AND _y % 100 <> 0 OR _y % 400 = 0, 29, 28) WHEN _m IN (4, 6, 9, 11) THEN 30 ELSE 31 END AS _good",
    "_d", "_h", "_i", "_s", "_ms", "_zone", "_region", "_n", "_nf",
]
#: days from 1970-01-01 in the Gregorian calendar, years counted from March
_LOCAL = [
    "IF(_good, (((_yy * 365L + _yy DIV 4 - _yy DIV 100 + _yy DIV 400 + (_mm * 153 + 2) DIV 5 + _d - 1 - 719468) * 24 + _h) * 60 + _i) * 60000L + _s * 1000 + _ms, NULL) AS _local",
    "_zone", "_region", "_n", "_nf", r"regexp_replace(_zone, '^(?:UTC|GMT)(?=.)|:', '') AS _digits",
]
_FIXED = (
    "CASE WHEN _n IS NOT NULL THEN CASE WHEN abs(_n) < 100000000000 THEN _n * 1000 + _nf DIV 1000000 WHEN abs(_n) < 100000000000000 THEN _n "
    "WHEN abs(_n) < 100000000000000000 THEN _n DIV 1000 ELSE _n DIV 1000000 END "
    r"WHEN _digits RLIKE '^[+-]\\d{4}$' THEN _local - 60000L * IF(left(_digits, 1) = '-', -1, 1) * (substr(_digits, 2, 2) * 60 + substr(_digits, 4, 2)) "
    "ELSE _local - 60000L * try_element_at(" + _ABBR + ", _zone) END"
)
_WALL = "CASE WHEN _tz = 'UTC' THEN _local WHEN from_utc_timestamp(to_utc_timestamp(timestamp_millis(_local), _tz), _tz) = timestamp_millis(_local) THEN unix_millis(to_utc_timestamp(timestamp_millis(_local), _tz)) END"


def _parse(df: DataFrame, column: str) -> DataFrame:
    """df with the wall time as milliseconds and with zone, region and number; one match per value."""
    keep = [f"`{c}`" for c in df.columns]
    raw = F.col(column).cast("string")
    split = F.split(F.regexp_replace(raw, PATTERN, COMPONENTS), r"\|", -1)
    df = barrier(df.withColumn("_parts", F.when(raw.rlike(r"\d{4}"), split)).withColumn("_ok", F.size("_parts") == len(PARTS)))
    df = barrier(df.selectExpr(*keep, *[f"IF(_ok, _parts[{i}], NULL) AS _{k}" for i, k in enumerate(PARTS)]))
    for step in (_NUMBERS, _VALID, _LOCAL):
        df = barrier(df.selectExpr(*keep, *step))
    return df


def known_zone(column: str) -> str:
    """SQL of the zone in a column if it is one of the IANA names, else null."""
    return f"CASE WHEN {column} IN ({_IANA}) THEN {column} END"


def normalise(df: DataFrame, column: str, key: Column, zones: DataFrame, out: str = "epoch_ms") -> DataFrame:
    """df with the instant of a column of mixed timestamps, in milliseconds since 1970 UTC.

    zones has the columns zone_key (unique, not null) and tz. Only rows that
    may lack a zone, by a look at their last characters, take part in the
    join; the others never move. A hot key is on the many side of the join,
    where AQE splits it. Names that begin with one underscore are taken.
    """
    value = F.col(column).cast("string")
    ends_in_zone = value.rlike(r"(?:[Zz\]]|[+-]\d{2}:?\d{2}|[A-Z]{3,4})\s*$") & ~value.rlike(r"(?i)[ap]m\s*$")
    zoned = F.coalesce(ends_in_zone | value.rlike(r"^\s*[+-]?\d{9,19}(?:\.\d+)?\s*$"), F.lit(True))
    keep = [f"`{c}`" for c in df.columns]

    def instants(rows: DataFrame) -> DataFrame:
        rows = rows.selectExpr(*keep, "_local", "_zone", "_n", "_nf", "_digits", f"IF(_region = '', coalesce(_tz, 'UTC'), {known_zone('_region')}) AS _tz")
        return barrier(barrier(rows).selectExpr(*keep, f"CAST(CASE WHEN _zone = '' AND _n IS NULL THEN {_WALL} ELSE {_FIXED} END AS BIGINT) AS {out}"))

    zones = zones.selectExpr("zone_key AS _zone_key", f"coalesce({known_zone('tz')}, 'UTC') AS _tz")
    fixed = instants(_parse(df.where(zoned), column).withColumn("_tz", F.lit("UTC")))
    wall = instants(_parse(df.where(~zoned).withColumn("_zone_key", key), column).join(zones, "_zone_key", "left"))
    return fixed.unionByName(wall)
