"""p9: whole items, no overflow, a reduction that costs nothing, as few containers as an exact search needs or nearly."""

import random
from collections import Counter, defaultdict
from functools import cache

from loomlog.llm import packing


def fewest(items, capacity):
    """The least number of containers, by search over sets of remaining items."""
    items = tuple(sorted(items, reverse=True))

    @cache
    def go(rest):
        if not rest:
            return 0
        head, best = rest[0], len(rest)

        def fill(i, room, chosen):
            nonlocal best
            extended = False
            for k in range(i, len(rest)):
                if rest[k] <= room and (k == i or rest[k] != rest[k - 1] or k - 1 in chosen):
                    extended = True
                    fill(k + 1, room - rest[k], chosen | {k})
            if not extended:
                best = min(best, 1 + go(tuple(x for k, x in enumerate(rest) if k not in chosen)))

        fill(1, capacity - head, frozenset({0}))
        return best

    return go(items)


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    worse = fixed_any = 0
    for _ in range(150):
        capacity = rng.randrange(10, 40)
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        best = fewest(items, capacity)
        fixed, rest = packing.reduce_instance(Counter(items), capacity)
        assert all(sum(s) <= capacity for s, _ in fixed)
        put = Counter(x for s, n in fixed for x in s for _ in range(n)) + Counter(rest)
        assert put == Counter(items)
        assert sum(n for _, n in fixed) + fewest([s for s, n in rest.items() for _ in range(n)], capacity) == best
        fixed_any += bool(fixed)
        worse += packing.plan(Counter(items), capacity)[1] > best
    assert fixed_any > 100 and worse <= 5


def test_plan_places_every_rank_once_within_capacity():
    rng = random.Random(4)
    for _ in range(50):
        sizes = Counter(rng.randrange(1, 100) for _ in range(400))
        intervals, bins = packing.plan(sizes, 100)
        load, seen = Counter(), defaultdict(int)
        for size, rank, n, first, per in intervals:
            assert rank == seen[size]
            seen[size] += n
            for k in range(n):
                load[first + k // per] += size
        assert dict(seen) == dict(sizes) and max(load.values()) <= 100 and max(load) < bins


def test_pack_splits_only_what_is_longer_and_keeps_empty_items(spark):
    rows = [(1, 25), (2, 10), (3, 0), (4, 7), (5, 3), (6, 10), (6, 10), (7, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens int"), 10).collect()
    assert sorted((r["doc_id"], r["part"], r["n_tokens"]) for r in got) == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 10), (3, 0, 0), (4, 0, 7), (5, 0, 3), (6, 0, 10), (6, 0, 10)]
    load = Counter()
    for r in got:
        load[r["container"]] += r["n_tokens"]
    assert max(load.values()) <= 10 and len(load) == 7
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens int"), 10).count() == 0
