"""Same or almost same records across splits (problem 3).

Texts that are equal after normalisation form one class, so copies never meet
each other. Every train class is compared with every evaluation class whose
lengths are near enough, so nothing rests on where the edits are: the requests
are dealt into blocks by length, and one task takes one pair of blocks.

Within a block pair, pairs are dropped only by bounds that hold for every pair
within the limit. Requests: one edit changes at most two of a text's pairs of
neighbouring letters, so of the longer text all but two for each allowed edit
stand in the shorter one too, and no further off than the edits before and after
that place can shift them. Letter pairs are hashed to PLACES; a collision can
only keep a pair. They are counted for 64 texts at a time, as bits of words
(_counted). What is left is held against the limit by exact edit distance, bit by
bit again (_within). Commands of near requests: one edit changes at most GRAM
n-grams (counted with repetitions), hashed to BITS; then edit distance.

Cases and their results:
- a null part counts as the empty text; texts below the least number of words
  have no overlap; case and the amount of white space do not count;
- a request with many commands is dealt as units of about UNIT commands, so it
  spreads over blocks and is still compared with itself as a whole;
- a record in both or in no split, empty tables: no rows.

The work grows with the square of the distinct requests of near lengths, at some
tens of nanoseconds a pair: edits up to a fifth leave spans of under five characters in
common, which is too short to look pairs up by.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.util import barrier, cut

#: edits of a pair are at most 1/PART of the characters of the longer text
PART = 5
#: length and bits of a command's n-grams, places of a request's letter pairs
GRAM, BITS, PLACES = 3, 1024, 1024
#: units of requests in a block and their characters, commands in a unit of one request, requests indexed at once, request or command pairs gathered before they are checked
BLOCK, CHARS, UNIT, SLICE, PAIRS = 32_768, 1 << 23, 64, 16_384, 500_000
#: parts of a text by whose place letter pairs are told apart, words counted and pairs looked up at once, letters up to which edit distance is taken here, pairs at once for that, letters indexed or words of tables held at once
PARTS, WORDS, LOOKED_UP, LONG, EDITS, TABLE = 16, 1 << 18, 4096, 1024, 1 << 13, 1 << 22
#: lengths that are handled with common bounds differ by this factor at most
NARROW = 1.06


def squeeze(c: Column) -> Column:
    """A text without case and without regard to the amount of white space."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def _grams(texts: list[str], places: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every n-gram; the k-th copy of an n-gram has another place than the first."""
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), size)
    n = max(len(code) - GRAM + 1, 0)
    within = owner[:n] == owner[GRAM - 1 :][:n]
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(1 << 21) + code[k : k + n]  # a code point has 21 bits
    gram, owner = gram[within], owner[:n][within]
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(gram))
    copy = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    mixed = (gram + copy * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return owner, ((mixed >> np.uint64(33)) % np.uint64(places)).astype(np.int64)


def _bits(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BITS // 64), np.uint64)
    owner, place = _grams(texts, BITS)
    np.bitwise_or.at(out, (owner, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return out


class _Side:
    """The distinct requests of one block in order of their lengths, their units and the units' commands."""

    def __init__(self, t: pa.Table) -> None:
        requests, commands, classes = t["request"].to_pylist(), t["commands"].to_pylist(), t["classes"].to_pylist()
        order = sorted(range(len(requests)), key=lambda i: (len(requests[i]), requests[i]))
        self.texts = list(dict.fromkeys(requests[i] for i in order))
        self.size = np.array([len(x) for x in self.texts], np.int64)
        self.code = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.begin = np.cumsum(self.size) - self.size
        number = {x: k for k, x in enumerate(self.texts)}
        self.units = np.bincount([number[requests[i]] for i in order], minlength=len(self.texts))
        self.first = np.cumsum(self.units) - self.units
        self.n = np.array([len(commands[i]) for i in order], np.int64)
        self.start = np.cumsum(self.n) - self.n
        flat = [c for i in order for c in commands[i]]
        self.classes = np.array([c for i in order for c in classes[i]], np.int64)
        self.command_size = np.array([len(c) for c in flat], np.int64)
        self.bits = _bits(flat)
        self.set = np.bitwise_count(self.bits).sum(1).astype(np.int64)

    def letters(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, code) of every letter of some texts; a text is given by its position in which."""
        size = self.size[which]
        owner = np.repeat(np.arange(len(which)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        return owner, at, self.code[self.begin[which][owner] + at]

    def letter_pairs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, place) of every pair of neighbouring letters."""
        owner, at, code = self.letters(which)
        code = code.astype(np.uint64)
        mixed = (code[:-1] * np.uint64(1 << 21) + code[1:]) * np.uint64(0x9E3779B97F4A7C15)
        inner = owner[:-1] == owner[1:]
        return owner[:-1][inner], at[:-1][inner], ((mixed >> np.uint64(40)) % np.uint64(PLACES)).astype(np.int64)[inner]


def _counted(rows: np.ndarray) -> list[np.ndarray]:
    """The binary digits, lowest first, of how many of the rows (row, query, word) have each bit; rows is written over."""
    digits = [rows]
    while (n := len(digits[0])) > 1:
        if n % 2:
            digits = [np.concatenate([x, np.zeros_like(x[:1])]) for x in digits]
        half = -(-n // 2)
        carry = None
        for d in digits:
            x, y = d[:half], d[half:]
            both = x & y
            x ^= y
            if carry is not None:
                np.bitwise_and(x, carry, out=y)
                x ^= carry
                both |= y
            carry = both
        digits = [*(d[:half] for d in digits), carry]
    return [x[0] for x in digits]


def _at_least(digits: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Bits (query, word): the count that the digits give is at least that of the query."""
    carry = np.full_like(digits[0], ~np.uint64(0))
    for k, x in enumerate(digits):
        # adds the complement of least and one: the last carry tells
        lacks = np.where(least >> k & 1, np.uint64(0), ~np.uint64(0))[:, None]
        carry &= x | lacks
        carry |= x & lacks
    return carry


def _shared(long: _Side, short: _Side, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield pairs (i, j) of requests, the first as long as the second or longer (strict: longer), that share enough letter pairs."""
    lo = 0
    while lo < len(short.size):
        hi = min(lo + SLICE, lo + max(1, TABLE // int(short.size[lo])), np.searchsorted(short.size, short.size[lo] * NARROW, "right"))
        least, most = short.size[lo], short.size[hi - 1]
        indexed = short.letter_pairs(np.arange(lo, hi))
        q, end = np.searchsorted(long.size, [least + strict, most + most // (PART - 1) + 2])
        while q < end:
            to = min(end, np.searchsorted(long.size, long.size[q] * NARROW, "right"))
            yield from _shared_by_group(long, short, np.arange(q, to), lo, hi, indexed, strict)
            q = to
        lo = hi


def _shared_by_group(long: _Side, short: _Side, group: np.ndarray, lo: int, hi: int, indexed: tuple[np.ndarray, np.ndarray, np.ndarray], strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_shared for the longer texts of group and the shorter ones from lo to hi, whose letter pairs are indexed."""
    first, last = long.size[group[0]], long.size[group[-1]]
    edits = last // PART
    # a letter pair is shifted by d and the lengths differ by s: at least |d| edits before it and |s - d| after it
    down = (edits + min(edits, last - short.size[lo])) // 2
    up = (edits - max(0, first - short.size[hi - 1])) // 2
    if up < -down:
        return
    width = max(2, -(-int(last) // PARTS))
    parts = -(-int(last) // width)
    words = -(-(hi - lo) // 64)
    # bits of the shorter texts that have a letter pair where one of that part of a longer text may have gone; the last row is empty
    index = np.zeros((PLACES * parts + 1, words), np.uint64)
    owner, at, place = indexed
    bit = np.uint64(1) << (owner % 64).astype(np.uint64)
    from_part, to_part = np.maximum((at - up) // width, 0), np.minimum((at + down) // width, parts - 1)
    for k in range(int((to_part - from_part).max(initial=-1)) + 1):
        there = from_part + k <= to_part
        np.bitwise_or.at(index.reshape(-1), ((place[there] * parts + from_part[there] + k) * words + owner[there] // 64), bit[there])
    step = max(1, WORDS // max(1, int(last) * words))
    for s in range(0, len(group), step):
        which = group[s : s + step]
        owner, at, place = long.letter_pairs(which)
        # even places, filled up to a multiple of 16 for _counted, then odd places
        even = -(-int(long.size[which[-1]]) // 32) * 16
        rows = np.full((2 * even, len(which)), PLACES * parts, np.int64)
        rows[at // 2 + at % 2 * even, owner] = place * parts + at // width
        size = long.size[which]
        # letter pairs apart from each other: an edit changes one at most
        enough = _at_least(_counted(np.take(index, rows[:even], axis=0)), size // 2 - size // PART)
        i, word = np.nonzero(enough)
        if not len(i):
            continue
        k, bit_no = np.nonzero(np.unpackbits(enough[i, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, word = i[k], word[k]
        j = word * 64 + bit_no
        apart = size[i] - short.size[np.minimum(j + lo, hi - 1)]
        near = (j < hi - lo) & (apart >= strict) & (apart <= size[i] // PART)
        i, word, bit_no, j = i[near], word[near], bit_no[near].astype(np.uint64), j[near]
        # the letter pairs between those, and all together
        for k in range(0, len(i), LOOKED_UP):
            x, y = i[k : k + LOOKED_UP], j[k : k + LOOKED_UP]
            there = (index[rows[:, x], word[k : k + LOOKED_UP]] >> bit_no[k : k + LOOKED_UP] & np.uint64(1)).astype(bool)
            between, edits = there[even:].sum(0), size[x] // PART
            near = (between >= (size[x] - 1) // 2 - edits) & (there[:even].sum(0) + between >= size[x] - 1 - 2 * edits)
            yield which[x[near]], y[near] + lo


def _within(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the pairs (i, j), the first not the shorter, which are within the limit; pairs of texts above LONG letters are kept, they are checked later.

    The columns of the table of edit distances are kept as bits, one per step up or down, for all pairs at once (Myers 1999, Hyyro 2003).
    """
    kept = a.size[i] > LONG
    order = np.flatnonzero(~kept)
    order = order[np.argsort(i[order], kind="stable")]
    while len(order):
        head = order[:EDITS]
        patterns, number = np.unique(i[head], return_inverse=True)
        many = -(-int(a.size[patterns[-1]]) // 64)
        alphabet = np.unique(a.code[a.begin[patterns[0]] : a.begin[patterns[-1]] + a.size[patterns[-1]]])
        part = head[: np.searchsorted(number, max(1, TABLE // ((len(alphabet) + 1) * many)))]
        order = order[len(part) :]
        kept[part] = _edits(a, b, i[part], j[part], alphabet, many) <= a.size[i[part]] // PART
    return kept


def _edits(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, alphabet: np.ndarray, many: int) -> np.ndarray:
    """Edit distances of the pairs (i, j); alphabet has the letters of the first texts, which fit in many words of bits."""
    order = np.argsort(-b.size[j], kind="stable")
    patterns, p = np.unique(i[order], return_inverse=True)
    owner, at, code = a.letters(patterns)
    equal = np.zeros((len(patterns), len(alphabet) + 1, many), np.uint64)
    np.bitwise_or.at(equal, (owner, np.searchsorted(alphabet, code), at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    letter = np.full(0x110000, len(alphabet))
    letter[alphabet] = np.arange(len(alphabet))
    size, begin = b.size[j[order]], b.begin[j[order]]
    up, down = np.full((many, len(i)), ~np.uint64(0)), np.zeros((many, len(i)), np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    for t in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -t))  # the texts that are longer than t
        rows = equal[p[:n], letter[b.code[begin[:n] + t]]]
        plus, minus = np.ones(n, np.uint64), np.zeros(n, np.uint64)
        for w in range(many):
            pv, mv, eq = up[w, :n], down[w, :n], rows[:, w]
            xv = eq | mv
            eq = eq | minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            ph_in, mh_in = (ph << one) | plus, (mh << one) | minus
            plus, minus = ph >> top, mh >> top
            up[w, :n], down[w, :n] = mh_in | ~(xv | ph_in), ph_in & xv
    # the distance is that of the empty text plus all steps down the last column
    below = np.clip(a.size[i[order]][None, :] - 64 * np.arange(many)[:, None], 0, 64)
    mask = np.where(below == 64, ~np.uint64(0), (one << np.minimum(below, 63).astype(np.uint64)) - one)
    steps = np.bitwise_count(up & mask).sum(0, dtype=np.int64) - np.bitwise_count(down & mask).sum(0, dtype=np.int64)
    out = np.zeros(len(i), np.int64)
    out[order] = size + steps
    return out


def _near_requests(a: _Side, b: _Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield the pairs (i, j) of requests within the limit, about PAIRS at a time before they are checked."""
    for long, short, strict in ((a, b, False), (b, a, True)):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for i, j in _shared(long, short, strict):
            held.append((i, j))
            n += len(i)
            if n >= PAIRS:
                yield from _settled(long, short, held, strict)
                held, n = [], 0
        if n:
            yield from _settled(long, short, held, strict)


def _settled(long: _Side, short: _Side, held: list[tuple[np.ndarray, np.ndarray]], strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    i, j = (np.concatenate(x) for x in zip(*held))
    near = _within(long, short, i, j)
    yield (j[near], i[near]) if strict else (i[near], j[near])


def _near_commands(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the unit pairs (i, j) the pairs of classes whose commands pass the bounds."""
    pair, x, y = _crossed(a.n[i], b.n[j])
    x, y = a.start[i[pair]] + x, b.start[j[pair]] + y
    most = np.maximum(a.command_size[x], b.command_size[y]) // PART
    near = np.abs(a.command_size[x] - b.command_size[y]) <= most
    x, y, most = x[near], y[near], most[near]
    common = np.bitwise_count(a.bits[x] & b.bits[y]).sum(1)
    near = common >= np.maximum(a.set[x], b.set[y]) - GRAM * most
    return a.classes[x[near]], b.classes[y[near]]


def _crossed(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, x, y): every x below na[k] with every y below nb[k]."""
    n = na * nb
    k = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    return k, at // nb[k], at % nb[k]


def _compare(train: pa.Table, held: pa.Table) -> pa.Table:
    """(a, b): the class pairs of two blocks that may be near."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if train.num_rows and held.num_rows:
        a, b = _Side(train), _Side(held)
        for p, q in _near_requests(a, b):
            k, x, y = _crossed(a.units[p], b.units[q])
            i, j = a.first[p[k]] + x, b.first[q[k]] + y
            part = np.cumsum(a.n[i] * b.n[j]) // PAIRS
            for cut_i, cut_j in zip(*(np.split(v, np.flatnonzero(np.diff(part)) + 1) for v in (i, j))):
                x, y = _near_commands(a, b, cut_i, cut_j)
                left.append(x)
                right.append(y)
    return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})


def _units(classes: DataFrame) -> DataFrame:
    """(band, request, commands, classes): the commands of a request in units of about UNIT."""
    n = classes.groupBy("request").agg(F.count("*").alias("n"))
    dealt = classes.join(n, "request").withColumn("unit", F.expr(f"pmod(xxhash64(command, 'unit'), greatest(1, n DIV {UNIT}))"))
    unit = dealt.groupBy("request", "unit").agg(F.collect_list(F.struct("command", "cls")).alias("c"))
    return unit.select(F.length("request").alias("size"), "request", "unit", F.col("c.command").alias("commands"), F.col("c.cls").alias("classes"))


def _blocks(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(least, most, parts): the lengths of texts, given as (length, texts), in runs of about one block; a single length of more texts has several blocks."""
    # eight blocks at least, as one task takes a pair of them
    rows = min(BLOCK, -(-sum(n for _, n in sizes) // 8))
    out: list[tuple[int, int, int]] = []
    full = True
    held = 0
    for size, n in sorted(sizes):
        most = max(1, min(rows, CHARS // max(1, size)))
        if full or held + n > most:
            out.append((size, size, -(-n // most)))
            held = n
        else:
            out[-1] = (out[-1][0], size, 1)
            held += n
        full = held >= most
    return out


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of a train and an evaluation class of (cls, side, request, command) that hold every pair within the limit."""
    spark = classes.sparkSession
    sides = [cut(_units(classes.where(F.col("side").isin(s, 3)))) for s in (1, 2)]
    # a row for each length that occurs
    sizes = [[(r["size"], r["count"]) for r in s.groupBy("size").count().collect()] for s in sides]
    runs = [_blocks(x) for x in sizes]
    blocks = [[(*r, k) for r in x for k in range(r[2])] for x in runs]
    met = [(t, e) for t, x in enumerate(blocks[0]) for e, y in enumerate(blocks[1]) if max(x[0], y[0]) - min(x[1], y[1]) <= max(x[0], y[0]) // PART]
    if not met:
        return spark.createDataFrame([], "a long, b long")
    dealt = []
    for k, (s, x) in enumerate(zip(sides, blocks)):
        lengths = sorted(size for size, _ in sizes[k])
        # (size, part, parts, pairs): in which pairs of blocks a unit takes part
        pairs: dict[int, list[int]] = {}
        for number, pair in enumerate(met):
            pairs.setdefault(pair[k], []).append(number)
        of = [(size, part, parts, pairs[n]) for n, (least, most, parts, part) in enumerate(x) if n in pairs for size in lengths[bisect_left(lengths, least) : bisect_right(lengths, most)]]
        places = spark.createDataFrame(of, "size int, part int, parts int, pairs array<int>")
        own = F.expr("pmod(xxhash64(request, unit), parts)")
        d = s.join(F.broadcast(places), "size").where(own == F.col("part"))
        # both sides have their columns from one table: aliases tell them apart
        columns = [F.col(c).alias(c) for c in ("request", "commands", "classes")]
        dealt.append(d.select(F.explode("pairs").alias("pair"), *columns).repartition(len(met), "pair"))
    return dealt[0].groupBy("pair").cogroup(dealt[1].groupBy("pair")).applyInArrow(_compare, "a long, b long")


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose requests and commands are both near; texts (cls, request, command)."""
    left = texts.select(F.col("cls").alias("a"), F.col("request").alias("ra"), F.col("command").alias("ca"))
    right = texts.select(F.col("cls").alias("b"), F.col("request").alias("rb"), F.col("command").alias("cb"))
    both = pairs.join(left, "a").join(right, "b")
    for x, y in (("ca", "cb"), ("ra", "rb")):
        most = f"CAST(greatest(length({x}), length({y})) DIV {PART} AS INT)"
        both = barrier(both.withColumn("_near", F.expr(f"{x} = {y} OR levenshtein({x}, {y}, {most}) >= 0"))).where("_near").drop("_near")
    return both.select("a", "b")


def matched_classes(rows: DataFrame, least_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """(id, is_evaluation, cls) of all rows (id, is_evaluation, request, command) that take part, and the pairs (a, b) of their train and evaluation classes that overlap."""
    rows = rows.select("id", "is_evaluation", squeeze(F.col("request")).alias("request"), squeeze(F.col("command")).alias("command")).where("is_evaluation is not null")
    rows = rows.where(F.size(F.split("request", " ")) >= least_words)
    rows = rows.withColumn("cls", F.xxhash64("request", F.lit("\x01"), "command"))
    side = F.max(F.when(F.col("is_evaluation"), 2).otherwise(0)) + F.max(F.when(F.col("is_evaluation"), 0).otherwise(1))
    # the texts are kept once per class, the rows only by the number of their class
    classes, rows = cut(rows.groupBy("cls").agg(F.first("request").alias("request"), F.first("command").alias("command"), side.alias("side"))), rows.select("id", "is_evaluation", "cls")
    return rows, _checked(candidates(classes), classes.select("cls", "request", "command"))


def cross_pairs(rows: DataFrame, least_words: int = 8) -> DataFrame:
    """(id_a, id_b), smaller first, of all rows (id, is_evaluation, request, command) with an overlap across the splits."""
    rows, pairs = matched_classes(rows, least_words)
    left = rows.where("not is_evaluation").select(F.col("cls").alias("a"), F.col("id").alias("i"))
    right = rows.where("is_evaluation").select(F.col("cls").alias("b"), F.col("id").alias("j"))
    return pairs.join(left, "a").join(right, "b").where("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def partners(rows: DataFrame, least_words: int = 8) -> DataFrame:
    """(id, n): with how many rows across the splits each row overlaps; rows without any are left out.

    Counted by classes, so copies are never expanded into pairs: a row has the sizes of the classes that its own overlaps.
    """
    rows, pairs = matched_classes(rows, least_words)
    size = rows.groupBy("cls", "is_evaluation").agg(F.count_distinct("id").alias("n"))
    of_train = pairs.join(size.where("is_evaluation").select(F.col("cls").alias("b"), "n"), "b").groupBy(F.col("a").alias("_c")).agg(F.sum("n").alias("n")).withColumn("_e", F.lit(False))
    of_held = pairs.join(size.where("not is_evaluation").select(F.col("cls").alias("a"), "n"), "a").groupBy(F.col("b").alias("_c")).agg(F.sum("n").alias("n")).withColumn("_e", F.lit(True))
    counts = of_train.unionByName(of_held)
    return rows.distinct().join(counts, (F.col("cls") == F.col("_c")) & (F.col("is_evaluation") == F.col("_e"))).groupBy("id").agg(F.sum("n").alias("n"))
