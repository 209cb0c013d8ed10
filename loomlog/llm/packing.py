"""Filling containers of fixed capacity with items (problem 9).

What fits where depends on sizes alone, so the plan is made on the histogram of
sizes, which has at most as many entries as the capacity. Martello and Toth's
reduction first fixes small sets that dominate every alternative, whole runs of
equal items at a time; the rest is placed by best fit, largest first, into bins
that are grouped by the space they have left. The items then find their
container by their rank among those of their size.

Cases and their results:
- an item above the capacity is cut into full containers and a remainder; no
  other item is split;
- items of size 0 (empty and null texts) lie in any of the containers, dealt by
  hash; without any container they get one;
- equal sizes are ranked by id; repeated ids are items of their own;
- no items: no rows.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.util import cut

#: parts into which the items of one size are dealt for ranking, so that a hot size is no single task
SALTS = 64


def reduce_instance(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Dominant sets as (sizes of one container, number of containers), and what is left of the histogram.

    For an item j: alone if nothing fits beside it; with the largest k that
    fits if k fills it up or no two items fit beside it, or if k is at least as
    large as the best pair of which exactly two fit. All items are tried, the
    largest first, and again as long as that fixes anything, as a set that is
    gone may let another dominate.
    """
    left, fixed = Counter({s: n for s, n in sizes.items() if n > 0}), []
    order = sorted(left)

    def usable(s: int, j: int) -> int:
        return left[s] - (s == j)

    def largest_up_to(room: int, j: int) -> int | None:
        i = bisect.bisect_right(order, room) - 1
        while i >= 0 and usable(order[i], j) <= 0:
            i -= 1
        return order[i] if i >= 0 else None

    def smallest_three(j: int) -> list[int]:
        out: list[int] = []
        for s in order:
            out += [s] * min(3 - len(out), max(usable(s, j), 0))
            if len(out) == 3:
                break
        return out + [capacity + 1] * (3 - len(out))

    def best_pair(room: int, j: int) -> int:
        """The largest sum of two items that fits."""
        lo, hi, best = 0, bisect.bisect_right(order, room) - 1, 0
        while lo <= hi:
            a, b = order[lo], order[hi]
            if usable(a, j) <= 0:
                lo += 1
            elif usable(b, j) <= 0 or a + b > room or lo == hi and usable(a, j) < 2:
                hi -= 1
            else:
                best = max(best, a + b)
                lo += 1
        return best

    moved = True
    while moved:
        moved = False
        order = [s for s in order if left[s] > 0]
        for j in reversed(order):
            while left[j] > 0:
                room = capacity - j
                k = largest_up_to(room, j)
                if k is None:
                    fixed.append(((j,), left[j]))
                    left[j] = 0
                    moved = True
                    break
                one, two, three = smallest_three(j)
                fits = j + k == capacity or one + two > room
                if not fits and one + two + three > room:  # at most two fit beside j
                    fits = k >= best_pair(room, j)
                if not fits:
                    break
                times = min(left[j], left[k]) if k != j else left[j] // 2
                fixed.append(((j, k), times))
                left[j] -= times
                left[k] -= times
                moved = True
    return fixed, {s: n for s, n in left.items() if n > 0}


def plan(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (size, first rank, items, first bin, items per bin) and the number of bins."""
    fixed, rest = reduce_instance({s: n for s, n in sizes.items() if s > 0}, capacity)
    ranks: Counter = Counter()
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(size: int, n: int, first: int, per: int) -> None:
        out.append((size, ranks[size], n, first, per))
        ranks[size] += n

    for members, times in fixed:
        for size, per in Counter(members).items():
            put(size, times * per, bins, per)
        bins += times
    space: dict[int, list[tuple[int, int]]] = {}  # space left -> runs (first bin, number of bins)
    open_spaces: list[int] = []

    def free(room: int, run: tuple[int, int]) -> None:
        if room not in space:
            bisect.insort(open_spaces, room)
            space[room] = []
        space[room].append(run)

    for size in sorted(rest, reverse=True):
        n = rest[size]
        while n:
            i = bisect.bisect_left(open_spaces, size)
            if i == len(open_spaces):  # new containers, each with as many as fit
                per = capacity // size
                full, over = divmod(n, per)
                if full:
                    put(size, full * per, bins, per)
                    free(capacity - per * size, (bins, full))
                    bins += full
                if over:
                    put(size, over, bins, over)
                    free(capacity - over * size, (bins, 1))
                    bins += 1
                break
            room = open_spaces[i]
            first, count = space[room].pop()
            if not space[room]:
                del space[room], open_spaces[i]
            per = room // size
            full = min(count, n // per)
            if full:
                put(size, full * per, first, per)
                free(room - per * size, (first, full))
                n -= full * per
            if count > full:
                over = n if n < per else 0
                if over:
                    put(size, over, first + full, over)
                    free(room - over * size, (first + full, 1))
                    n = 0
                if count - full - (over > 0):
                    free(room, (first + full + (over > 0), count - full - (over > 0)))
    return out, bins


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, from_token, n_tokens, container) of items (doc_id, n_tokens). The driver sees the histogram of sizes only."""
    whole, rest = F.floor(F.col("n_tokens") / capacity), F.col("n_tokens") % capacity
    parts = items.where("n_tokens is not null").withColumn("part", F.explode(F.sequence(F.lit(0), whole.cast("int")))).withColumn("n_tokens_part", F.when(F.col("part") < whole, capacity).otherwise(rest).cast("int"))
    parts = parts.where("n_tokens_part > 0 or n_tokens = 0").select("doc_id", "part", (F.col("part") * capacity).alias("from_token"), F.col("n_tokens_part").alias("n_tokens"))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS)).cast("int"))
    parts = cut(parts)
    counts = parts.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))  # at most SALTS rows per size
    sizes = {r["n_tokens"]: r["n"] for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    intervals, bins = plan(sizes, capacity)
    table: dict[int, tuple] = {}
    for size, rows in pd.DataFrame(intervals, columns=["size", "rank", "n", "bin", "per"]).groupby("size"):
        table[size] = (rows["rank"].to_numpy(), rows["bin"].to_numpy(), rows["per"].to_numpy())

    def place(frames):
        for f in frames:
            size, rank = f["n_tokens"].to_numpy(), f["rank"].to_numpy()
            container = np.zeros(len(f), "int64")
            for s in np.unique(size):
                at = size == s
                if s == 0:
                    container[at] = rank[at] % max(bins, 1)
                    continue
                starts, first, per = table[s]
                i = np.searchsorted(starts, rank[at], side="right") - 1
                container[at] = first[i] + (rank[at] - starts[i]) // per[i]
            yield f[["doc_id", "part", "from_token", "n_tokens"]].assign(container=container)

    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "part")) - 1)
    ranked = ranked.join(F.broadcast(offsets.select("n_tokens", "salt", "offset")), ["n_tokens", "salt"])  # at most (capacity + 1) * SALTS rows
    return ranked.select("doc_id", "part", "from_token", "n_tokens", (F.col("offset") + F.col("_r")).alias("rank")).mapInPandas(place, "doc_id bigint, part int, from_token int, n_tokens int, container bigint")
