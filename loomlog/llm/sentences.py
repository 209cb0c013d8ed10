"""Sentence units of documents in many languages and scripts (problem 10).

Languages are told apart by profiles of words learned from the stated ones. Per
language, one pass counts word types with and without a final period, what
follows them, and what begins a unit after a certain boundary. From these
counts, by log-likelihood ratios, come abbreviations, sentence starters and
collocations of numbers with the next word; nobody lists them. A second pass
classifies each terminator with these statistics and the open quotations and
brackets around it.

Cases and their results:
- null, empty and blank texts have no unit;
- a heading, a list item with its mark and a fenced block are one unit each; a
  blank line ends a unit, a line break or a semicolon does not;
- no unit ends inside a quotation, a bracket or a code span of its paragraph;
  one left open does not count as open;
- a script without terminators (Thai) ends a unit at the space between two of
  its letters;
- units do not overlap and leave out only white space; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.util import cut

#: letters from which on a word with a period surely ends a unit in the first pass, and is held to stricter evidence; occurrences from which a word is judged
LONGEST, LEAST = 8, 3
#: log-likelihood ratio from which a word is a sentence starter or a collocation
STARTER_LLR, COLLOCATION_LLR = 30.0, 7.88
#: least share of the units or periods of a language that a learned word needs; at most 1/LEAST_SHARE words of a sort can pass
LEAST_SHARE = 1e-5
#: least share of a language's documents that a word of its profile occurs in; a document has on average w words, so at most w / PROFILE_SHARE can pass
PROFILE_SHARE = 0.05

#: scripts without spaces between words, where a profile of words says nothing
_SCRIPTS = [("th", re.compile("[฀-๿]+")), ("ja", re.compile("[぀-ヿ]+")), ("zh", re.compile("[一-鿿]+"))]
_FENCE = re.compile(r"[ \t]*(```|~~~)")
_HEADING = re.compile(r"[ \t]*#{1,6}[ \t]+\S")
_BULLET = re.compile(r"[ \t]*[-*+•‣▪◦·][ \t]+\S")
_NUMBER = re.compile(r"[ \t]*(\d{1,3})[.)、．][ \t]+\S")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_MARK = re.compile(r"""`[^`]*`|[.!?…。！？｡।॥؟۔]+|["“”„«»‹›「」『』（）()\[\]【】]""")
_CLOSERS = "\"”“»›」』）)]】’'*_"
_OPENERS = "\"“„«‹「『（([【¿¡'‘*_-–—`#"
_PAIRS = {"”": "“„", "»": "«", "›": "‹", "」": "「", "』": "『", "）": "（", ")": "(", "]": "[", "】": "【"}
_CONTINUE = ",;:，；：、)]}»”–—-=/"
#: a letter, or a mark that Python does not count among the letters
_L = "(?:[^\\W\\d_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0970-\u097f\u0e31-\u0e4e])"
_WORD_AFTER = re.compile(rf"(?:{_L}|\d)+(?:['’]{_L}+)?")
_RUN = "(?:[^\\W\\d_]+|[\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0970-\u097f\u0e31-\u0e4e]+)+"
_TOKEN = re.compile(rf"{_RUN}(?:\.{_RUN})*\.?")
_ASCII_TOKEN = re.compile(r"[A-Za-z]+(?:\.[A-Za-z]+)*\.?")
_PLAIN_WORD, _ASCII_WORD = re.compile(r"[^\W\d_]+"), re.compile("[a-z]+")
_MARKER = re.compile(r"\s*(?:#{1,6}|[-*+•‣▪◦·]|\d{1,3}[.)])?\s*")
#: word -> ((language, log odds), ..)
Profiles = dict[str, tuple[tuple[str, float], ...]]
_TH = "[฀-๿]"
_THAI_GAP = re.compile(rf"(?<={_TH})\s+(?={_TH})")
_CJK = re.compile("[぀-ヿ一-鿿]")


def _words(text: str) -> set[str]:
    return set((_ASCII_WORD if text.isascii() else _PLAIN_WORD).findall(text.lower()))


def language(lang: str | None, text: str, profiles: Profiles) -> str:
    """The language whose statistics count: that of a script without spaces, or the one whose profile the words fit best; the stated one where that is as good."""
    if not text.isascii():
        counts = [(sum(map(len, rx.findall(text))), name) for name, rx in _SCRIPTS]
        n, name = max(counts)
        if name == "zh" and counts[1][0]:
            name = "ja"
        if n > 0.1 * len(text):
            return name
    stated = (lang or "").strip().lower()[:2]
    scores: dict[str, float] = {}
    for w in _words(text):
        for k, v in profiles.get(w, ()):
            scores[k] = scores.get(k, 0.0) + v
    if not scores:
        return stated
    best = max(scores, key=lambda k: (scores[k], k))
    # a stated language holds unless the words speak clearly against it
    return stated if scores[best] < scores.get(stated, 0.0) + 3.0 and stated in scores else best


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the parts of a text between blank lines; kind: fence, heading, item or prose."""
    start = kind = mark = None
    end, at, size = 0, 0, len(text)
    number = 0
    while at < size:
        m = _LINE.match(text, at)
        line, nxt = m[0], m.end()
        if kind == "fence":
            end = nxt
            if line.strip() == mark:
                yield start, end, kind
                start = kind = None
            at = nxt
            continue
        fence, bullet, num = _FENCE.match(line), _BULLET.match(line), _NUMBER.match(line)
        # a mark begins an item only at the start of a part or after an item; a number must go on from the one before
        item = bullet and kind in (None, "item") or num and (kind is None and int(num[1]) <= 1 or kind == "item" and int(num[1]) == number + 1)
        if not line.strip():
            new = None
        elif fence:
            new = "fence"
        elif _HEADING.match(line):
            new = "heading"
        elif item:
            new = "item"
            number = int(num[1]) if num else -1
        else:
            new = kind if kind in ("item", "prose") else "prose"
            if kind == new:
                end, at = nxt, nxt
                continue
        if start is not None:
            yield start, end, kind
            start = kind = None
        if new:
            start, end, kind = at, nxt, new
            mark = fence[1] if fence else None
        at = nxt
    if start is not None:
        yield start, end, kind


@dataclass
class Model:
    """What the statistics of one language say."""

    abbreviations: set = field(default_factory=set)
    starters: set = field(default_factory=set)
    after_number: set = field(default_factory=set)


def _letter(c: str) -> bool:
    return c.isalpha() or "\u0300" <= c <= "\u036f" or "\u064b" <= c <= "\u065f" or "\u0900" <= c <= "\u0963" or "\u0970" <= c <= "\u097f" or "\u0e31" <= c <= "\u0e4e"


def word_before(text: str, a: int, end: int) -> str:
    """The word that ends at `end`, with periods inside it, or the digits that end there; whatever its length."""
    at = end
    if at > a and text[at - 1].isdecimal():
        while at > a and text[at - 1].isdecimal():
            at -= 1
        return text[at:end]
    while at > a and (_letter(text[at - 1]) or text[at - 1] == "." and at < end and text[at] != "." and at - 1 > a and _letter(text[at - 2])):
        at -= 1
    return text[at:end]


def first_word(text: str, at: int, end: int) -> str:
    """The word or, in scripts without spaces, the first two letters after opening marks."""
    while at < end and (text[at].isspace() or text[at] in _OPENERS):
        at += 1
    if at < end and _CJK.match(text[at]):
        return text[at : min(end, at + 2)]
    m = _WORD_AFTER.match(text, at, end)
    return m[0] if m else ""


def prose(text: str, a: int, b: int, model: Model, lang: str, sure=None) -> Iterator[tuple[int, int]]:
    """The units of a paragraph; with `sure` each boundary candidate is reported to it instead of the statistics being used."""
    if lang == "th":
        start = a
        for m in _THAI_GAP.finditer(text, a, b):
            yield start, m.start()
            start = m.end()
        a = start
    start, stack, opened, floor = a, [], -1, a
    for m in _MARK.finditer(text, a, b):
        s, e = m.span()
        c = text[s]
        if s < floor or c == "`":
            continue
        if c in "\"“”„«»‹›「」『』（）()[]【】":
            if c == '"':
                if stack and stack[-1][0] == '"':
                    stack.pop()
                else:
                    stack.append((c, s))
            elif c == "“" and stack and stack[-1][0] == "„":
                stack.pop()
            elif c in _PAIRS:
                if stack and stack[-1][0] in _PAIRS[c]:
                    stack.pop()
            elif not (c in "([" and _unclosed(text, s, b)):
                stack.append((c, s))
            continue
        ender = text[e - 1]
        opened = -1
        while e < b:  # closing marks belong to what they close
            c = text[e]
            gap = e
            if c.isspace() and e + 1 < b and text[e + 1] == "»":
                gap, c = e + 1, "»"
            if c not in _CLOSERS or c in "*_'’" and not (e + 1 >= b or text[e + 1].isspace()):
                break
            if c == '"' and (not stack or stack[-1][0] != '"'):
                break
            if c == "“" and not (stack and stack[-1][0] == "„"):
                break
            if c in _PAIRS or c in '"“':
                if not stack or c in _PAIRS and c != "“" and stack[-1][0] not in _PAIRS[c]:
                    break
                opened = stack.pop()[1]
            e = gap + 1
        floor = e
        if stack:
            if stack[0][1] < start or e >= b:
                stack.clear()
            else:
                continue
        nxt = e
        while nxt < b and text[nxt].isspace():
            nxt += 1
        if nxt >= b:
            break
        if boundary(text, start, s, e, nxt, b, ender, opened, model, sure):
            yield start, e
            start = nxt
    if start < b:
        yield start, b


def _unclosed(text: str, at: int, b: int) -> bool:
    close = {"(": ")", "[": "]"}[text[at]]
    return text.find(close, at, b) < 0


def boundary(text: str, start: int, s: int, e: int, nxt: int, b: int, ender: str, opened: int, model: Model, sure) -> bool:
    """Whether a unit ends at the terminator text[s:..], whose closing marks end at e and after which text goes on at nxt."""
    spaced, c = nxt > e, text[nxt]
    word = first_word(text, nxt, b)
    lower, wide = c.islower(), ender in "。！？｡।॥"
    if opened >= 0:
        if c in _CONTINUE or lower or not spaced and not wide:
            return False
        if c.isupper() or text[opened] in "([（【" and not wide:
            return True
        if sure is not None:
            return False
        # without case to tell, a speech announced by a colon may end the unit; any other quotation is a part of it
        return text[start:opened].rstrip().endswith((":", "：")) and word in model.starters
    if wide:
        return c not in _CONTINUE
    if ender == "…" or text[s:e].startswith(("...", "……")):
        return spaced and not lower and c not in _CONTINUE and (c.isupper() or word in model.starters)
    if not spaced or c in _CONTINUE:
        return False
    if ender in "!?؟":
        return True
    if ender == "۔":
        return True
    before = word_before(text, start, s)
    w = before.lower()
    if sure is not None:
        sure(w, before, word, c)
        return len(w.rpartition(".")[2]) > LONGEST and not w.isdigit() and not lower
    if w.isdigit():
        return word not in model.after_number
    single = len(w) == 1 and before.isupper()
    if w in model.abbreviations or single:
        return not lower and word in model.starters
    return bool(w) or not lower  # a word that is no abbreviation ends the unit whatever follows


def units(text: str | None, lang: str | None, models: dict[str, Model], profiles: Profiles) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text."""
    if not text or text.isspace():
        return []
    lang = language(lang, text, profiles)
    model, out = models.get(lang) or Model(), []
    for a, b, kind in blocks(text):
        for s, e in prose(text, a, b, model, lang) if kind == "prose" else ((a, b),):
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
    return out


# ---- statistics

STATS = "lang string, kind string, a string, b string, n long"


def observe(text: str, lang: str, count: Counter, tokens: Counter) -> None:
    """Add what one text shows: its tokens, followers of periods, first words of units."""
    find = (_ASCII_TOKEN if text.isascii() else _TOKEN).findall

    def sure(w: str, before: str, word: str, c: str) -> None:
        if w.isdigit():
            count[lang, "number", word, ""] += 1
        elif w:
            kind = "low" if c.islower() or c.isdigit() else "up"
            count[lang, kind, w, word if kind == "up" else ""] += 1

    for a, b, kind in blocks(text):
        if kind == "fence":
            continue
        tokens.update(find(text[a:b]))
        n = 0
        for s, e in prose(text, a, b, Model(), lang, sure) if kind == "prose" else ((a, b),):
            if s == a and kind != "prose":
                s = _MARKER.match(text, s, b).end()
            count[lang, "start", first_word(text, s, b), ""] += 1
            n += 1
        count[lang, "units", "", ""] += n
        last = b
        while last > a and (text[last - 1].isspace() or text[last - 1] in _CLOSERS):
            last -= 1
        if last > a and text[last - 1] == "." and (w := word_before(text, a, last - 1)) and not w.isdigit():
            count[lang, "end", w.lower(), ""] += 1


def _observe(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()
    tokens: dict[str, Counter] = {}

    def pack() -> pa.RecordBatch:
        for lang, seen in tokens.items():
            for token, n in seen.items():
                count[lang, "word", token.rstrip("."), "." if token[-1] == "." else ""] += n
        columns = list(zip(*((*k, n) for k, n in count.items()))) or [[]] * 5
        types = [pa.string()] * 4 + [pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in STATS.split(", ")])
        count.clear()
        tokens.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text and not text.isspace():
                known = language(lang, text, profiles)
                observe(text, known, count, tokens.setdefault(known, Counter()))
            if len(count) + sum(map(len, tokens.values())) > 400_000:  # what is counted so far goes on to the shuffle
                yield pack()
    yield pack()


def learn_profiles(docs: DataFrame) -> Profiles:
    """The words that tell languages apart, from the stated languages of docs (lang, text), some of which may be wrong.

    A word counts once per document. Its log odds compare the share of a language's documents that hold it with the mean
    share over all languages, so a few wrong labels hardly move it.
    """
    stated = F.left(F.lower(F.trim("lang")), F.lit(2))
    rows = docs.select(stated.alias("lang"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("words")).where("lang rlike '^[a-z]{2}$' and size(words) > 0")
    n_docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # at most 26 * 26 languages
    if not n_docs:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in n_docs.items() for x in (k, float(n))])
    words = rows.select("lang", F.explode("words").alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.element_at(share, F.col("lang")))
    kept = words.where((F.col("share") >= PROFILE_SHARE) & (F.col("n") >= LEAST)).select("w").distinct()
    found: dict[str, dict[str, float]] = {}
    for r in words.join(kept, "w", "left_semi").select("w", "lang", "share").collect():  # the words of the profiles, bounded by PROFILE_SHARE
        found.setdefault(r["w"], {})[r["lang"]] = r["share"]
    out = {}
    for w, shares in found.items():
        mean = sum(shares.values()) / len(n_docs)
        out[w] = tuple((k, math.log((shares.get(k, 0.0) + 0.01) / (mean + 0.01))) for k in n_docs)
    return out


def _llr(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of b after a: 2 log of how much likelier two rates are than one."""

    def log_l(k: Column, m: Column, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (m - k) * F.log(1 - p)

    p, p1, p2 = b / n, both / a, (b - both) / F.greatest(n - a, F.lit(1))
    return -2 * (log_l(both, a, p) + log_l(b - both, n - a, p) - log_l(both, a, p1) - log_l(b - both, n - a, p2))


def learn(docs: DataFrame, profiles: Profiles) -> dict[str, Model]:
    """The models of all languages from all texts of docs (lang, text).

    The counts stay in Spark; the driver takes only the words that pass the
    tests, of which LEAST_SHARE bounds the number.
    """
    stats = docs.select("lang", "text").mapInArrow(lambda it: _observe(it, profiles), STATS).groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))
    stats = cut(stats)
    of = lambda kind: stats.where(F.col("kind") == kind)
    words = of("word").groupBy("lang").agg(F.sum("n").cast("double").alias("n_all"))
    n_units = of("units").select("lang", F.col("n").cast("double").alias("n_units"))
    word = of("word").groupBy("lang", "a").agg(F.sum("n").cast("double").alias("n_word"))
    bare = of("word").where("b = ''").groupBy("lang", F.lower("a").alias("a")).agg(F.sum("n").alias("bare"))
    scale = words.join(n_units, "lang")
    start = of("start").where("a <> '' and n >= 5").select("lang", "a", F.col("n").cast("double").alias("n_start")).join(word, ["lang", "a"], "left").join(scale, "lang").where(F.col("n_start") >= LEAST_SHARE * F.col("n_units"))
    # a word of a script without spaces has no count of its own; its share of the units must do
    spaced = F.col("n_word").isNotNull() & (F.col("n_word") >= F.col("n_start"))
    tested = F.when(spaced, (_llr(F.col("n_start"), F.col("n_units"), F.col("n_word"), F.col("n_all")) >= STARTER_LLR) & (F.col("n_start") / F.col("n_units") > F.col("n_word") / F.col("n_all"))).otherwise(F.col("n_start") >= 0.002 * F.col("n_units"))
    starters = start.where(tested).select("lang", "a")
    number_all = of("number").groupBy("lang").agg(F.sum("n").cast("double").alias("n_number"))
    number = of("number").where("a <> '' and n >= 5").select("lang", "a", F.col("n").cast("double").alias("n_both")).join(word, ["lang", "a"]).join(number_all, "lang").where(F.col("n_both") >= LEAST_SHARE * F.col("n_number")).join(words, "lang")
    collocated = number.where((_llr(F.col("n_both"), F.col("n_number"), F.col("n_word"), F.col("n_all")) >= COLLOCATION_LLR) & (F.col("n_both") >= 0.3 * F.col("n_word")))
    dotted = stats.where("kind in ('up', 'low', 'end')").join(starters.select("lang", F.col("a").alias("b"), F.lit(1).alias("is_start")), ["lang", "b"], "left")
    per = dotted.groupBy("lang", "a").agg(
        F.sum(F.when(F.col("kind") != "end", F.col("n")).otherwise(0)).alias("inner"), F.sum(F.when(F.col("kind") == "low", F.col("n")).otherwise(0)).alias("low"),
        F.sum(F.when(F.col("kind") == "end", F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(F.col("is_start") == 1, F.col("n")).otherwise(0)).alias("begun"),
    ).join(bare, ["lang", "a"], "left").na.fill(0, ["bare"])
    dots = F.col("inner") + F.col("ends")
    per = per.where(dots >= LEAST).withColumn("dots", dots.cast("double")).join(words, "lang").join(stats.where("kind in ('up', 'low', 'end')").groupBy("lang").agg(F.sum("n").cast("double").alias("n_dots")), "lang").where(F.col("dots") >= LEAST_SHARE * F.col("n_dots"))
    # the period is part of the type if it is far likelier there than elsewhere, and what follows goes on with the sentence
    bound = (_llr(F.col("dots"), F.col("dots") + F.col("bare"), F.col("n_dots"), F.col("n_all")) >= COLLOCATION_LLR) & (F.col("dots") / (F.col("dots") + F.col("bare")) > F.col("n_dots") / F.col("n_all"))
    goes_on = (F.col("low") >= 0.15 * F.col("dots")) | ((F.col("ends") <= 0.01 * F.col("dots")) & (F.col("begun") <= 0.05 * F.col("dots")))
    # a long word is an abbreviation only if it goes on nearly always
    short = (F.length("a") <= LONGEST) | (F.col("low") >= 0.8 * F.col("dots"))
    abbreviations = per.where(bound & goes_on & short).select("lang", "a")
    found = starters.select("lang", F.lit("starter").alias("what"), "a").unionByName(collocated.select("lang", F.lit("number").alias("what"), "a")).unionByName(abbreviations.select("lang", F.lit("abbreviation").alias("what"), "a"))
    models: dict[str, Model] = {}
    for lang, what, a in found.collect():  # three sorts of at most 1 / LEAST_SHARE words per language
        m = models.setdefault(lang, Model())
        {"starter": m.starters, "number": m.after_number, "abbreviation": m.abbreviations}[what].add(a)
    return models


def _split(batches: Iterator[pa.RecordBatch], models: dict[str, Model], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = [(k, s, e) for k, lang, text in zip(*(part.column(i).to_pylist() for i in range(3))) for s, e in units(text, lang, models, profiles)]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "start_pos", "end_pos"])


def split(docs: DataFrame, models: dict[str, Model], profiles: Profiles) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence unit of docs (doc_id, lang, text); offsets in code points, end exclusive."""
    return docs.select("doc_id", "lang", "text").mapInArrow(lambda it: _split(it, models, profiles), "doc_id bigint, start_pos int, end_pos int")
