"""Splits that keep related records together (problem 4).

Records and the entities they name form a bipartite graph, whose components
come from iterated propagation of minimum labels (operators.graph). Components
are then assigned to splits so that both the row shares and the label mix stay
close to the targets.

Cases and their results:
- an entity that is null or unreadable ties nothing; a record without any
  entity is a group of its own;
- repeated rows and repeated edges count once in the graph;
- no rows: no groups;
- shares are taken in proportion to their sum; a split without a share above
  zero gets no rows;
- one entity with a third of all rows is split into slots wherever its links are
  joined, and labels are aggregated before each shuffle, so no task sees its rows.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators.graph import propagate_labels
from loomlog.util import cut


def tie(rows: DataFrame, group: Column, entity: Column) -> DataFrame:
    """(grp, root) of every group; groups are tied by sharing an entity, directly or through others. Entities never become roots."""
    pairs = rows.select(group.alias("grp"), entity.alias("entity")).where("grp is not null").distinct()
    roots = propagate_labels(pairs.select(F.col("grp").alias("node"), "entity"))
    return pairs.select("grp").distinct().join(roots, F.col("grp") == F.col("node"), "left").select("grp", F.coalesce("root", "grp").alias("root"))


#: components from this part of all rows on are assigned one by one, the others in buckets of which each label has this many
PARTS = 1024
#: labels that are told apart; rarer ones count as one
MOST_LABELS = 32


def rooted(rows: DataFrame, row: Column, group: Column, entity: Column, label: Column) -> DataFrame:
    """(id, label, root) of every row once; rows are tied by sharing a group or an entity, directly or through others.

    Copies of a row tie what they name. A row without group and entity is a component of its own.
    """
    named = rows.select(row.alias("id"), label.alias("label"), F.array_compact(F.array(F.concat(F.lit("g:"), group), F.concat(F.lit("e:"), entity))).alias("names"))
    named = cut(named.groupBy("id").agg(F.min("label").alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names")))
    # the graph of records and names, with records that name the same taken as one node
    nodes = named.select(F.array_join("names", "\x01").alias("node"), "names").where("node <> ''").distinct()
    roots = propagate_labels(nodes.select("node", F.explode("names").alias("entity"))).withColumnRenamed("node", "_node")
    own = F.array_join("names", "\x01")
    return named.withColumn("_own", own).join(roots, F.col("_own") == F.col("_node"), "left").select("id", "label", F.coalesce("root", F.concat(F.lit("r:"), "id"), F.lit("r")).alias("root"))


def share_out(units: dict, shares: dict[str, float]) -> dict:
    """The split of each unit {key: {label: rows}}, so that the rows of each label in each split come close to its share.

    The largest unit goes first, each to the split where the squared deviations, relative to the targets, grow least;
    then units move as long as that lowers them.
    """
    total: dict = defaultdict(int)
    sized = {}
    for key, labels in units.items():
        sized[key] = labels | {None: sum(labels.values())}  # None: all rows, which weigh as much as all labels together
        for x, n in sized[key].items():
            total[x] += n
    weight = {x: (len(total) - 1 if x is None else 1) / n for x, n in total.items()}
    whole = sum(shares.values())
    over = {s: {x: -n * v / whole for x, n in total.items()} for s, v in shares.items()}

    def cost(s: str, unit: dict, sign: int = 1) -> float:
        return sum(weight[x] * n * (sign * 2 * over[s][x] + n) for x, n in unit.items()) * whole / shares[s]

    def put(s: str, unit: dict, sign: int = 1) -> None:
        for x, n in unit.items():
            over[s][x] += sign * n

    out = {}
    order = sorted(sized, key=lambda k: (-sized[k][None], k))
    for k in order:
        out[k] = min(shares, key=lambda s: (cost(s, sized[k]), s))
        put(out[k], sized[k])
    for _ in range(5):
        moved = False
        for k in order:
            put(out[k], sized[k], -1)
            best = min(shares, key=lambda s: (cost(s, sized[k]), s != out[k], s))
            moved |= best != out[k]
            out[k] = best
            put(best, sized[k])
        if not moved:
            break
    return out


def splits(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(id, split) of all rows (id, label, root): whole components, close to the shares in rows and in each label.

    Large components are assigned one by one, the others by buckets of components with the same main label, so at
    most some thousands of units reach the driver however many components there are.
    """
    shares = {s: v for s, v in shares.items() if v and v > 0}
    if not shares:
        raise ValueError("no split has a share above zero")
    common = {r["label"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LABELS).collect()}
    known = F.col("label").isin(*[x for x in common if x is not None])
    rows = rows.withColumn("label", F.when(known, F.col("label")).otherwise(F.lit("")))
    parts = rows.groupBy("root", "label").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("root").agg(F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("main"))
    total = rows.count()
    large = F.col("size") * PARTS >= total
    unit = F.when(large, F.col("root")).otherwise(F.concat_ws(":", F.lit("b"), "main", F.pmod(F.xxhash64("root"), F.lit(PARTS)).cast("string")))
    unit_of = cut(sizes.select("root", unit.alias("unit")))
    found: dict = defaultdict(dict)
    for r in parts.join(unit_of, "root").groupBy("unit", "label").agg(F.sum("n").alias("n")).collect():  # at most PARTS * (1 + MOST_LABELS) units
        found[r["unit"]][r["label"]] = r["n"]
    chosen = list(share_out(found, shares).items())
    of = rows.sparkSession.createDataFrame(chosen, "unit string, split string")
    return rows.join(unit_of, "root").join(F.broadcast(of), "unit").select("id", "split")
