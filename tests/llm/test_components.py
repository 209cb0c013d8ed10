"""p4_splits: every row once, tied rows together, shares and label mix close to the targets."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loomlog.llm import components, queries

SHARES = {"train": 0.3, "development": 0.1, "reserve": 0.5, "final_test": 0.1}


def assigned(spark, rows):
    df = spark.createDataFrame(rows, "id string, grp string, entity string, label string")
    return [tuple(r) for r in components.splits(components.rooted(df, F.col("id"), F.col("grp"), F.col("entity"), F.col("label")), SHARES).collect()]


def test_query_is_registered():
    assert "p4_splits" in queries.QUERIES


def test_tied_rows_stay_together_and_shares_hold(spark):
    rng = random.Random(1)
    rows = [(f"r{k}", f"g{rng.randrange(900)}", f"e{k}" if rng.random() < 0.9 else f"e{rng.randrange(50)}x", rng.choice(["ok", "ok", "bad", None])) for k in range(4000)]
    rows += [(f"s{k}", None, None, "ok") for k in range(50)]
    rows += [("t1", None, "only", "ok"), ("t2", None, "only", "ok"), ("c", "g0", None, "ok"), ("c", "g1", None, "ok")]
    got = assigned(spark, rows)
    split = dict(got)
    assert len(got) == len(split) == len({r[0] for r in rows})
    for of in (1, 2):
        seen = defaultdict(set)
        for r in rows:
            if r[of]:
                seen[r[of]].add(split[r[0]])
        assert all(len(x) == 1 for x in seen.values())
    assert split["t1"] == split["t2"]


def test_shares_and_labels_without_large_components(spark):
    rng = random.Random(2)
    rows = [(f"r{k}", f"g{rng.randrange(1500)}", None, rng.choice(["ok", "ok", "bad", "unknown"])) for k in range(6000)]
    split = dict(assigned(spark, rows))
    label = {r[0]: r[3] for r in rows}
    for x in (None, "ok", "bad", "unknown"):
        n = Counter(s for i, s in split.items() if x in (None, label[i]))
        assert all(abs(n[s] / n.total() - share) < 0.01 for s, share in SHARES.items())


def test_no_rows(spark):
    assert assigned(spark, []) == []
