"""p3_found: every pair within a fifth of edits comes out, wherever the edits are."""

import random

import pyarrow as pa

from loomlog.llm import overlap


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def near(a, b):
    return levenshtein(a, b) <= max(len(a), len(b)) // 5


def found(spark, rows):
    df = spark.createDataFrame(rows, "id string, is_evaluation boolean, request string, command string")
    return {(r.id_a, r.id_b) for r in overlap.cross_pairs(df).collect()}


def family(seed, n, alphabet="abcdefghij klmnop/-._"):
    """Commands under one request and near copies of them with a fifth of the letters changed, evenly spread."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        base = "".join(rng.choice(alphabet.replace(" ", "")) for _ in range(rng.randint(30, 60)))
        copy = list(base)
        for at in range(2, len(base), 5)[: len(base) // 5]:
            copy[at] = "#"
        out += [(f"t{k:03}", False, base), (f"v{k:03}", True, "".join(copy))]
    return out


def test_edits_every_five_characters_under_one_request(spark):
    request = "please look at the failing build and tell me what is wrong with it"
    rows = [(i, e, request, c) for i, e, c in family(1, 150)]
    want = {(a[0], b[0]) for a in rows for b in rows if not a[1] and b[1] and a[0][1:] == b[0][1:]}
    assert len(want) == 150 and all(near(a[3], b[3]) for a in rows for b in rows if (a[0], b[0]) in want)
    assert found(spark, rows) == want


def test_equal_to_exhaustive_comparison(spark):
    rng = random.Random(2)
    words = "check the log of service and restart when port file is busy now run all tests again".split()
    rows = []
    for k in range(60):
        request = " ".join(rng.choice(words) for _ in range(12))
        command = " ".join(rng.choice(words) for _ in range(5))
        rows.append((f"a{k:03}", False, request, command))
        r, c = list(request), list(command)
        for text in (r, c):
            for _ in range(rng.randint(0, len(text) // 4)):
                text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((f"b{k:03}", True, "".join(r), "".join(c)))
    want = {(a[0], b[0]) for a in rows for b in rows if not a[1] and b[1] and near(a[2], b[2]) and near(a[3], b[3])}
    assert len(want) > 20
    assert found(spark, rows) == want


def test_blocks_and_units_do_not_change_the_result(spark, monkeypatch):
    request = "please look at the failing build and tell me what is wrong with it"
    rows = [(i, e, request + " now" * (k % 7), c) for k, (i, e, c) in enumerate(family(4, 60))]
    whole = found(spark, rows)
    monkeypatch.setattr(overlap, "BLOCK", 3)
    monkeypatch.setattr(overlap, "UNIT", 4)
    assert whole and found(spark, rows) == whole


def test_slices_do_not_change_the_result(monkeypatch):
    request = "please look at the failing build and tell me what is wrong with it"
    rows = [(k, e, request + " now" * (k % 7), c) for k, (_, e, c) in enumerate(family(5, 60))]
    a, b = (pa.table({"request": [r[2] for r in rows if r[1] == e], "commands": [[r[3]] for r in rows if r[1] == e], "classes": [[r[0]] for r in rows if r[1] == e]}) for e in (False, True))
    pairs = lambda t: sorted(zip(t["a"].to_pylist(), t["b"].to_pylist()))
    whole = pairs(overlap._compare(a, b))
    monkeypatch.setattr(overlap, "SLICE", 2)
    monkeypatch.setattr(overlap, "PAIRS", 10)
    assert whole and pairs(overlap._compare(a, b)) == whole


def test_no_rows(spark):
    assert found(spark, []) == set()


def test_long_request_that_differs_in_its_last_character(spark):
    """Short commands after one long request: all first 48 characters of the suffixes in it are equal."""
    rng = random.Random(3)
    request = " ".join(rng.choice(["stage", "review", "pipeline", "every", "list", "that", "should"]) for _ in range(30))
    commands = ["".join(rng.choice("abcdefghij") for _ in range(20)) for _ in range(40)]
    rows = [(f"{s}{k:03}", s == "b", request + mark, c) for k, c in enumerate(commands) for s, mark in (("a", "."), ("b", "!"))]
    assert found(spark, rows) == {(f"a{k:03}", f"b{k:03}") for k in range(40)}


def test_span_that_occurs_more_than_a_hundred_thousand_times(spark):
    rng = random.Random(6)
    request = " ".join(["na"] * 400)
    rows = []
    for k in range(130):
        command = "".join(rng.choice("abcdefghij") for _ in range(40))
        rows += [(f"a{k:03}", False, request, command), (f"b{k:03}", True, request, command[:20] + "#" + command[21:])]
    assert found(spark, rows) == {(f"a{k:03}", f"b{k:03}") for k in range(130)}


def test_partners_count_copies_without_pairs(spark):
    request = "please look at the long report of the nightly build"
    rows = [(f"t{k}", False, request, "ls -la src") for k in range(3)] + [(f"e{k}", True, request.upper(), "ls -la  srd") for k in range(2)] + [("x", True, "something else entirely that has eight words here", "pwd"), ("n", None, request, "ls -la src")]
    df = spark.createDataFrame(rows, "id string, is_evaluation boolean, request string, command string")
    assert {r["id"]: r["n"] for r in overlap.partners(df).collect()} == {"t0": 2, "t1": 2, "t2": 2, "e0": 3, "e1": 3}
    assert overlap.cross_pairs(df).count() == 6


def _side(texts):
    return overlap._Side(pa.table({"request": texts, "commands": [["ls -la"]] * len(texts), "classes": [[k] for k in range(len(texts))]}))


def _edited(rng, text, most):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        at = rng.randrange(len(out)) if out else 0
        kind = rng.randrange(3) if out else 2
        if kind == 0:
            out[at] = rng.choice("xyzé")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("xyz漢"))
    return "".join(out)


def test_only_near_requests_leave_a_pair_of_blocks():
    """Requests of one template with other names share most n-grams: pairs of them grew with the square and were all written out."""
    rng = random.Random(7)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(11))
    a, b = ([f"restart {name()} but leave {name()} as it is and show what {name()} says" for _ in range(60)] for _ in range(2))
    b += [_edited(rng, x, len(x) // 5) for x in a[:20]]
    t, e = (pa.table({"request": x, "commands": [["ls -la"]] * len(x), "classes": [[k] for k in range(len(x))]}) for x in (a, b))
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if near(x, y)}
    got = overlap._compare(t, e)
    assert len(want) >= 15 and set(zip(got["a"].to_pylist(), got["b"].to_pylist())) == want


def test_near_requests_equal_to_exhaustive_comparison(monkeypatch):
    rng = random.Random(8)
    a = ["".join(rng.choice("ab c") for _ in range(rng.choice([1, 2, 7, 20, 64, 65, 140]))) for _ in range(40)]
    b = list({_edited(rng, x, len(x) // 4) or "q" for x in a})
    x, y = _side(a), _side(b)
    want = {(s, t) for s in x.texts for t in y.texts if near(s, t)}
    found_now = lambda: {(x.texts[i], y.texts[j]) for p, q in overlap._near_requests(x, y) for i, j in zip(p, q)}
    assert len(want) > 20 and found_now() == want
    for name, value in (("SLICE", 3), ("WORDS", 8), ("LOOKED_UP", 2), ("EDITS", 5), ("TABLE", 1), ("PARTS", 3), ("PAIRS", 7)):
        monkeypatch.setattr(overlap, name, value)
    assert found_now() == want


def test_texts_too_long_for_bits_are_kept_for_the_later_check(monkeypatch):
    monkeypatch.setattr(overlap, "LONG", 10)
    x, y = _side(["a request of more than ten letters"]), _side(["a request of more then ten letters"])
    assert [(list(p), list(q)) for p, q in overlap._near_requests(x, y)] == [([0], [0])]


def test_blocks_cover_each_length_once(monkeypatch):
    monkeypatch.setattr(overlap, "CHARS", 1 << 24)
    sizes = [(n, 1 + n % 5) for n in range(3, 90, 2)] + [(91, 100_000), (4_000_000, 9)]
    runs = overlap._blocks(sizes)
    for size, n in sizes:
        assert len([r for r in runs if r[0] <= size <= r[1]]) == 1
    assert dict((r[0], r[2]) for r in runs)[91] == 8 and dict((r[0], r[2]) for r in runs)[4_000_000] == 3
