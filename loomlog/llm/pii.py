"""Personal information inside free text (problem 6).

A text is normalised by offset-preserving transducers: look-alike and full-width
letters, zero-width characters, escaped or spelled `at` and `dot`, spelled
digits. Identifiers are detected on the normalised text, each kind on what the
kinds before it left, and their spans are mapped back to the source characters,
so everything outside a placeholder stays as it was.

Cases and their results:
- null and empty texts: unchanged, nothing found;
- texts of any length are read whole; equal or repeated rows get equal results;
- logins at hosts, repository addresses and package names are no e-mail
  addresses; versions, builds and stock numbers are no phone numbers; identity
  numbers need the name of their document before them;
- a name needs a given name of the list next to a surname, or a surname with a
  common ending next to a word in the place of a given name;
- names inside e-mail addresses are part of the address.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
ZERO_WIDTH = {"​", "‌", "‍", "⁠", "﻿", "­"}
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
# Common endings of family names.
SURNAME_ENDINGS = ["berg", "sen", "son", "quist", "ham", "etti", "wyn", "ik", "ova", "eva", "ow", "ov", "ander", "ez", "ard", "mann", "stein", "sky", "ski", "ska", "wicz", "enko", "dottir", "elli", "escu", "ian"]
# Words that stand in a name's place without being one.
ROLE_WORDS = {"the", "main", "branch", "release", "candidate", "merge", "queue", "entry", "points", "build", "failed", "access", "denied", "windows", "wall", "worker", "loader", "agent", "service", "admin", "runner", "public", "shared", "default", "node", "data", "root", "user", "users", "home", "court", "street", "road", "calle"}

# Common words with the endings of family names.
NO_SURNAMES = {
    "board", "dashboard", "keyboard", "clipboard", "whiteboard", "scoreboard", "motherboard", "onboard", "standard", "wizard", "guard", "safeguard", "hazard", "card", "scorecard", "wildcard", "flashcard", "yard", "backyard", "forward", "backward",
    "inward", "outward", "upward", "downward", "reward", "award", "hard", "ward", "steward", "lizard", "blizzard", "custard", "mustard", "orchard", "billiard", "discard", "retard", "vanguard", "person", "comparison", "season", "reason", "lesson", "poison",
    "prison", "bison", "unison", "liaison", "caisson", "garrison", "treason", "chairperson", "salesperson", "spokesperson", "json", "son", "listen", "chosen", "frozen", "citizen", "dozen", "low", "flow", "workflow", "overflow", "window", "shadow", "below",
    "follow", "allow", "arrow", "narrow", "row", "show", "slow", "snow", "throw", "tomorrow", "yellow", "pillow", "median", "guardian", "custodian", "librarian", "civilian", "italian", "indian", "persian", "russian", "asian", "laplacian", "gaussian", "cartesian",
    "iceberg", "commander", "calendar", "lavender", "islander", "champion", "lander", "expander", "oleander", "sky", "risky", "whisky", "husky", "dusky", "ham", "graham", "gotham", "wham", "sham", "einstein", "protein", "epstein", "human", "dez", "ez",
}

DISGUISE = re.compile(r"(?i)\s?[\[({<]\s?(at|dot)\s?[\])}>]\s?|%40|&#64;|&commat;|(?<=\w) at (?=[\w-]+ dot \w)|(?<=\w) dot (?=\w)")
SPELLED = re.compile(r"(?i)\b(?:(?:%s)[ -]){5,}(?:%s)\b" % ("|".join(DIGIT_WORDS), "|".join(DIGIT_WORDS)))

LOCAL_PART = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+-")
DOMAIN = re.compile(r"@((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})(?![\w@-])(?!:[\w/~.])")
LOGIN = re.compile(r"\b(?:ssh|scp|rsync|sftp|mosh)\b")
_DIGITS_END = r"(?![\w])(?![.-]\d)"
#: each alternative begins inside one set of characters, so the search can skip ahead; what stands before is looked at afterwards
PHONE = re.compile(
    r"[+(0-9](?:(?<=\+)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){6,11}|(?<=0)0[1-9]\d{0,2}(?:[ .-]\d{1,4}){2,6}"
    r"|(?<=\()\d{3}\) ?\d{3}[.-]\d{4}|(?<=[2-9])\d{2}([ .-])[2-9]\d{2}\1\d{4}|(?<=0)\d{2,4}/ ?\d{3,6}(?:-\d{1,4})?|(?<=0)7\d{3} \d{6}|(?<=0)[1-9]\d{2,3} \d{6}"
    r"|(?<=0)[1-9]\d{0,3}(?: \d{3,4}){2}|(?<=\()0\d{1,4}\) ?\d{3,8}(?:[ -]\d{1,5})?)" + _DIGITS_END
)
NOT_BEFORE_PHONE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+/:-")
NO_PHONE_BEFORE = re.compile(r"(?i)\b(?:rev|revision|version|ver|v|build|release|sku|lane|commit|pid|run|id|at|port|ip)[ .:=#]*$")
ID_NUMBER = re.compile(
    r"(?i)(?<![a-z])(?:(?:ssn|social security(?: number| no\.?)?)\W{0,3}\d{3}[- ]?\d{2}[- ]?\d{4}|national id(?:entity)?(?: number| no\.?)?\W{1,3}\d{6}[-+ ]?\d{4}"
    r"|steuer-?id(?:nr\.?)?\W{1,3}\d{2} ?\d{3} ?\d{3} ?\d{3}|(?:nino|national insurance(?: number| no\.?)?)\W{1,3}[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]"
    r"|(?:dni|nie)\W{1,3}[xyz]?\d{7,8}-?[a-z]|cpf\W{1,3}\d{3}\.?\d{3}\.?\d{3}-?\d{2}|codice fiscale\W{1,3}[a-z]{6}\d{2}[a-z]\d{2}[a-z]\d{3}[a-z]|pesel\W{1,3}\d{11}|bsn\W{1,3}\d{9}|aadhaar\W{1,3}\d{4} ?\d{4} ?\d{4}|passport(?: no\.?| number| nr\.?)?\W{1,3}[a-z]{0,2}\d{6,9}|(?:driver'?s? licen[cs]e|tax id)(?: no\.?| number)?\W{1,3}[a-z0-9-]{6,14})(?![\w])"
)
_CAP = r"[A-ZÀ-Þ][\w'’-]*"
_TOWN = rf"(?:, (?:Apt\.? \d+|\d{{1,2}}º ?[A-Z]))?(?:,? \d{{4,5}} {_CAP}|, {_CAP}(?: [A-Z]{{2}} \d{{5}})?)?"
ADDRESS = re.compile(
    rf"(?<![\w.])(?:\d{{1,5}} (?:{_CAP} ){{1,3}}(?:Street|STREET|St\.?|ST\.?|Road|ROAD|Rd\.?|RD\.?|Avenue|AVENUE|Ave\.?|AVE\.?|Lane|LANE|Court|COURT|Drive|DRIVE|Boulevard|BOULEVARD|Blvd\.?|Way|WAY|Place|PLACE|Square|SQUARE|Terrace|TERRACE)(?!\w)"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:[rR]ue|RUE|[aA]venue|AVENUE|[bB]oulevard|BOULEVARD|[pP]lace|PLACE|[cC]hemin|CHEMIN|[aA]llée|[qQ]uai|[iI]mpasse) (?:(?:de la|du|des|de|DE LA|DU|DES|DE) |(?:de l|d|DE L|D)['’])?{_CAP}"
    rf"|(?:Calle|CALLE|Avenida|AVENIDA|Avda\.|Plaza|PLAZA|Paseo|PASEO|Camino|CAMINO) (?:(?:de la|de los|de las|del|de|DE LA|DEL|DE) )?{_CAP},? (?:n\.?º ?)?\d{{1,4}}\b"
    rf"|(?:Via|Viale|Piazza|Corso|Rua|Travessa|ul\.) (?:(?:della|del|dei|da|do|dos|di|de) )?{_CAP}(?: {_CAP})?,? (?:n\.?º? ?)?\d{{1,4}}\b"
    rf"|{_CAP}(?:straat|laan|gracht|plein) \d{{1,4}}\b"
    rf"|[A-ZÄÖÜ]\w*(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|STRASSE|STRAßE|GASSE|WEG|ALLEE|PLATZ) \d{{1,4}}[a-z]?\b){_TOWN}"
)
_END = "(?:" + "|".join(SURNAME_ENDINGS) + ")"
_TITLE = r"(?:Dr\. |Prof\. |Mr\.? |Mrs\.? |Ms\.? |DR\. |dr\. )?"
_SUR = r"[A-Z][a-z]{2,}(?:-[A-Z][a-z]{2,})?"
_SUR_END = rf"(?:[A-Z][a-z]+-)?[A-Z][a-z]*{_END}(?:-[A-Z][a-z]+)?"
_CONTEXT = r"(?i:author[:=] ?\"?|reviewed-by: |co-authored-by: |signed-off-by: |last edited by |\"holder\":\"|user\.name \"|deliver to |talk to |owner is |assigned to |contact |echo \"|^)"
HOME = re.compile(r"(?i:[/\\]users[/\\]|[/\\]home[/\\]|[/\\]profiles[/\\]|documents and settings[/\\])([^/\\\n\"'<>|:;,]{3,})")
_PART = re.compile(r"[._ -]+|(?<=[a-z])(?=[A-Z])")
_ENDS = re.compile(rf"(?i)^[a-z]+{_END}$")


# Substrings without which a detector cannot find anything; one automaton looks for all of them.
GIVEN, CONTEXT, PLACE, DOCUMENT, DISGUISED, DIRECTORY, DIGIT = 1, 2, 4, 8, 16, 32, 64
TRIGGERS = {
    CONTEXT: ["author", "reviewed-by", "signed-off", "last edited by", "holder", "user.name", "deliver to", "talk to", "owner is", "assigned to", "contact ", 'echo "', " asked", " before"],
    PLACE: ["street", "st.", " st", "road", "rd.", "avenue", " ave", "lane", "court", "drive", "boulevard", "blvd", " way", "place ", " place", "square", "terrace", "rue ", "chemin", "allée", "quai ", "impasse", "calle ", "avenida", "avda", "plaza", "paseo", "camino", "straße", "strasse", "str. ", "gasse ", "weg ", "allee ", "platz ", "ring ", "damm ", "ufer ", "via ", "viale ", "piazza ", "corso ", "rua ", "travessa ", "ul. ", "straat ", "laan ", "gracht ", "plein "],
    DOCUMENT: ["ssn", "social security", "national i", "steuer", "nino", "dni", "nie", "passport", "licen", "tax id", "cpf", "codice fiscale", "pesel", "bsn", "aadhaar"],
    DISGUISED: ["(at", "( at", "[at", "[ at", "{at", "{ at", "<at", "%40", "&#64;", "&commat;", " dot ", "(dot", "[dot"],
    DIRECTORY: ["users/", "users\\", "home/", "home\\", "profiles/", "profiles\\", "documents and settings"],
    DIGIT: list(DIGIT_WORDS),
}
_CAPITAL_PAIR = re.compile(r"[A-Z][a-z]+(?: [A-Z]\.)?,? (?:Dr\. )?[A-Z][a-z]{2,}")
_LIST_LINE = re.compile(r"(?m)^(?:[A-Za-z]+\. )?[A-Za-z]+ (?:[A-Za-z]\.? )?[A-Za-z-]+,[+0-9(]")


class Detector:
    """All kinds; given_names: lower-case given names that are known."""

    def __init__(self, given_names: Iterable[str]):
        import ahocorasick

        self.given = {g.lower() for g in given_names if g}
        self.triggers = ahocorasick.Automaton()
        found: dict[str, int] = dict.fromkeys(self.given, GIVEN)
        for what, words in TRIGGERS.items():
            for w in words:
                found[w] = found.get(w, 0) | what
        for w, what in found.items():
            self.triggers.add_word(w, (what, len(w)))
        self.triggers.make_automaton()
        every = sorted(self.given, key=len, reverse=True) or ["\0"]
        title, upper, lower = ("|".join(re.escape(f(g)) for g in every) for f in (str.capitalize, str.upper, str.lower))
        up, low = rf"[A-Z]{{3,}}(?:-[A-Z]{{3,}})?", rf"(?:[a-z]+-)?[a-z]+{_END}(?:-[a-z]+)?"
        up_end = rf"(?:[A-Z]+-)?[A-Z]+(?:{'|'.join(SURNAME_ENDINGS).upper()})(?:-[A-Z]+)?"
        self.names = [re.compile(p) for p in (
            rf"\b{_TITLE}(?:{title})(?: [A-Z]\.)? {_SUR}\b", rf"\b{_SUR}, {_TITLE}(?:{title})\b(?: [A-Z]\.)?", rf"\b{_TITLE}(?:{upper})(?: [A-Z]\.)? {up}\b", rf"\b{up}, {_TITLE}(?:{upper})\b(?: [A-Z]\.)?",
            rf"\b{_TITLE}(?:{lower})(?: [a-z]\.)? {low}\b", rf"\b{low}, (?:{lower})\b(?: [a-z]\.)?", rf"\b{_TITLE}(?P<given>[A-Z][a-z]{{2,}})(?: [A-Z]\.)? {_SUR_END}\b", rf"\b{_SUR_END}, {_TITLE}(?P<given>[A-Z][a-z]{{2,}})\b(?! \d)",
            rf"(?m){_CONTEXT}(?P<n>{_TITLE}(?P<given>[A-Z]{{3,}})(?: [A-Z]\.)? {up_end})\b", rf"(?m){_CONTEXT}(?P<n>(?P<given>[a-z]{{3,}})(?: [a-z]\.)? {low})\b(?=[,;<\"]| <| in | before| asked| \(|$)",
            rf"(?i:author[:=] ?\"?|reviewed-by: |co-authored-by: |signed-off-by: )(?P<n>(?P<given>[A-Z][a-z]+)(?: [A-Z]\.)? {_SUR})\b", rf"\b(?P<n>(?P<given>[A-Z][a-z]+)(?: [A-Z]\.)? {_SUR})(?= <\x00)",
            rf"\b(?P<n>(?:Dr|Prof|Mr|Mrs|Ms)\.? (?P<given>[A-Z][a-z]+)(?: [A-Z]\.)? {_SUR})\b",
            rf"(?P<n>(?P<given>[A-Z]{{3,}})(?: [A-Z]\.)? {up_end})(?= asked| before|\.? \(| <|,[+0-9(])", rf"(?P<n>\b(?P<given>[a-z]{{3,}})(?: [a-z]\.)? {low})(?= asked for| before you|\.? \(\S+@)",
        )]

    def look(self, text: str) -> int:
        """Which triggers a text holds."""
        low, found, digits = text.lower(), 0, 0
        n = len(low)
        for end, (what, size) in self.triggers.iter(low):
            if what == GIVEN:
                start = end - size + 1
                if found & GIVEN or start and low[start - 1].isalpha() or end + 1 < n and low[end + 1].isalpha():
                    continue
            elif what == DIGIT:
                digits += 1
                continue
            found |= what
        return found | DIGIT if digits >= 6 else found

    def normalise(self, text: str, triggers: int = -1) -> tuple[str, list[int] | None]:
        """The text without disguise, and per character its place in the source; None if nothing changed."""
        at = None
        if not text.isascii():
            chars, at = [], []
            for i, c in enumerate(text):
                if c in ZERO_WIDTH:
                    continue
                plain = LOOKALIKES.get(c) or (unicodedata.normalize("NFKC", c) if "＀" <= c <= "￯" else c)
                chars.append(plain)
                at += [i] * len(plain)
            at.append(len(text))
            out = "".join(chars)
            text, at = out, None if out == text else at
        for on, rx, into in ((DISGUISED, DISGUISE, lambda m: "." if "dot" in m[0].lower() else "@"), (DIGIT, SPELLED, lambda m: "".join(DIGIT_WORDS[w.lower()] for w in re.split("[ -]", m[0])))):
            if triggers & on and rx.search(text):
                parts, places, end = [], [], 0
                for m in rx.finditer(text):
                    new = into(m)
                    parts += [text[end : m.start()], new]
                    places += [*range(end, m.start()), *[m.start()] * len(new)]
                    end = m.end()
                places += range(end, len(text) + 1)
                text, at = "".join(parts) + text[end:], places if at is None else [at[p] for p in places]
        return text, at

    def _home_names(self, text: str) -> Iterator[tuple[int, int]]:
        for m in HOME.finditer(text):
            segment = m[1]
            if "@" in segment:
                continue
            parts = [p for p in _PART.split(segment.strip()) if p]
            low = [p.lower() for p in parts if len(p) > 1]
            if len(low) != 2 or not all(p.isalpha() for p in low) or ROLE_WORDS & set(low):
                continue
            if any(a in self.given and len(b) > 2 or _ENDS.match(b) and len(b) > 4 for a, b in (low, low[::-1])):
                yield m.start(1), m.end(1)

    def _login(self, text: str, start: int) -> bool:
        """Whether a login command or a URL's `://` stands before on the same command, however far."""
        begin = max(text.rfind(c, 0, start) for c in "\n;&|\"'") + 1
        return text[max(0, start - 3) : start] == "://" or bool(LOGIN.search(text, begin, start))

    def _emails(self, text: str) -> Iterator[tuple[int, int]]:
        at = text.find("@")
        while at >= 0:
            start = at
            while start and text[start - 1] in LOCAL_PART:
                start -= 1
            while start < at and not text[start].isalnum():
                start += 1
            if start < at and text[start:at].lower() != "git" and (m := DOMAIN.match(text, at)) and not self._login(text, start):
                yield start, m.end()
            at = text.find("@", at + 1)

    def _phones(self, text: str) -> Iterator[tuple[int, int]]:
        for m in PHONE.finditer(text):
            start = m.start()
            if text[max(0, start - 4) : start].lower() == "tel:":
                yield start - 4, m.end()
            elif (not start or text[start - 1] not in NOT_BEFORE_PHONE) and not NO_PHONE_BEFORE.search(text, max(0, start - 12), start):
                yield start, m.end()

    def spans(self, text: str, triggers: int = -1) -> list[tuple[int, int, str]]:
        """(start, end, kind) in a normalised text; spans do not overlap."""
        found: list[tuple[int, int, str]] = []

        def take(kind: str, spans: list[tuple[int, int]]) -> None:
            """Note the spans of a kind and blank them out, all in one new text."""
            nonlocal text
            if not spans:
                return
            parts, end = [], 0
            for a, b in spans:
                found.append((a, b, kind))
                parts += [text[end:a], "\x00" * (b - a)]
                end = b
            text = "".join(parts) + text[end:]

        if "@" in text:
            take("EMAIL", list(self._emails(text)))
        if triggers & DOCUMENT:
            take("ID_NUMBER", [m.span() for m in ID_NUMBER.finditer(text)])
        take("PHONE", list(self._phones(text)))
        if triggers & PLACE:
            take("ADDRESS", [m.span() for m in ADDRESS.finditer(text)])
        if triggers & DIRECTORY:
            take("NAME", list(self._home_names(text)))
        listed = bool(triggers & CONTEXT) or _LIST_LINE.search(text)
        pair = _CAPITAL_PAIR.search(text)
        on = (*[triggers & GIVEN] * 6, pair, pair, listed, listed, pair, pair, pair, listed, listed)
        for rx, wanted in zip(self.names, on):
            if not wanted:
                continue
            hits = []
            for m in rx.finditer(text):
                g = m.groupdict()
                whole = m["n"] if "n" in g else m[0]
                # a word that stands beside an unknown given name must not be a common one
                if g.get("given") and (g["given"].lower() in ROLE_WORDS or {w.strip(",.").lower() for w in whole.split()} & NO_SURNAMES):
                    continue
                hits.append(m.span("n") if "n" in g else m.span())
            if hits:
                take("NAME", hits)
        return sorted(found)

    def kinds(self, text: str | None) -> set[str]:
        if not text:
            return set()
        triggers = self.look(text)
        if not text.isascii():  # a look-alike letter may hide a trigger
            triggers |= self.look(self.normalise(text)[0])
        return {k for _, _, k in self.spans(self.normalise(text, triggers)[0], triggers)}

    def redact(self, text: str | None) -> str | None:
        """The text with [KIND] in the place of each item."""
        if not text:
            return text
        triggers = self.look(text)
        if not text.isascii():
            triggers |= self.look(self.normalise(text)[0])
        plain, at = self.normalise(text, triggers)
        out, end = [], 0
        for a, b, kind in self.spans(plain, triggers):
            a, b = (a, b) if at is None else (at[a], at[b])
            out += [text[end:a], f"[{kind}]"]
            end = b
        return "".join(out) + text[end:]


def _each(batches: Iterator[pa.RecordBatch], given: list[str], tbl: str, fields: list[str], redacted: bool) -> Iterator[pa.RecordBatch]:
    detector, memo = Detector(given), {}
    for batch in batches:
        keys = batch.column(0).to_pylist()
        rows = []
        for i, field in enumerate(fields, 1):
            for key, text in zip(keys, batch.column(i).to_pylist()):
                if not text:  # nothing to find; a redacted table keeps the row as it is
                    rows += [(tbl, key, field, text)] if redacted else []
                    continue
                done = memo.get(text)
                if done is None:
                    done = detector.redact(text) if redacted else sorted(detector.kinds(text))
                    if len(text) < 400 and len(memo) < 50_000:  # short texts come again and again
                        memo[text] = done
                rows += [(tbl, key, field, done)] if redacted else [(tbl, key, field, k) for k in done]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["tbl", "row_key", "field", "text" if redacted else "kind"])


def scan(df: DataFrame, tbl: str, key: str, fields: list[str], given_names: list[str], redacted: bool = False) -> DataFrame:
    """(tbl, row_key, field, kind) of all items in df, or (tbl, row_key, field, text) with placeholders."""
    rows = df.selectExpr(f"CAST({key} AS STRING) AS row_key", *fields)
    return rows.mapInArrow(lambda it: _each(it, given_names, tbl, fields, redacted), f"tbl string, row_key string, field string, {'text' if redacted else 'kind'} string")
