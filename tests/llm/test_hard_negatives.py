from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm.hard_negatives import Forest, Slots, hard_negatives, op11_hard_negatives, search
from loomwright.llm.common import read_table

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, positives, negatives, low=30, high=90, anchor=lambda i: i % 100 == 0):
    """rows: (id, vector, label), usable ones."""
    out, seen = [], set()
    for i, v, g in rows:
        if not anchor(i) or (i, tuple(v), g) in seen:
            continue
        seen.add((i, tuple(v), g))
        score = [(int(np.dot(v, w)), j, h) for j, w, h in rows if j != i and len(w) == len(v)]
        ordered = sorted(score, key=lambda s: (-s[0], s[1]))
        for place, (p, j, _) in enumerate([s for s in ordered if s[2] == g][:positives], 1):
            fits = [s for s in ordered if s[2] != g and low * p <= 100 * s[0] <= high * p]
            out += [(i, j, place, rank, n, p, s) for rank, (s, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def rows_of(df):
    assert set(df.columns) == set(COLUMNS)
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_whole_table(spark, sf):
    rows = []
    for r in read_table(spark, sf, "embeddings").collect():
        if r["label"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]):
            rows.append((r["vec_id"], np.floor(np.array(r["embedding"], np.float64) * 256), (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]))
    assert rows_of(op11_hard_negatives(spark, sf)) == brute(rows, 5, 10)


@pytest.mark.parametrize("spread", [0.3, 6.0])
def test_trees_against_brute_force(spark, spread):
    """Many small tiles, clusters that trees can prune, ties, and labels both large and tiny."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 40, (6, 8))
    rows = [(i, np.round(centres[i % 6] + rng.normal(0, spread, 8)).tolist(), int(i % 6) if i % 11 else 100 + i % 3) for i in range(1500)]
    rows += [(2000 + i, rows[7][1], 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(hard_negatives(df, F.col("vec_id") % 25 == 0, positives=3, negatives=4, shard_rows=400, block_rows=30))
    assert got == brute([(i, np.array(v), g) for i, v, g in rows], 3, 4, anchor=lambda i: i % 25 == 0)


def test_groups_of_anchors_are_pruned():
    """Far clusters: most leaf pairs are never scored."""
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(c, 1, (2000, 4)) for c in ((100, 0, 0, 0), (0, 100, 0, 0), (0, 0, 100, 0), (0, 0, 0, 100))]))
    labels, ids = np.arange(8000) % 2, np.arange(8000)
    a = x[::40]
    calls, slots = [], Slots(np.full((len(a), 1), -np.inf), np.full((len(a), 1), np.inf), 5)
    offer = slots.offer
    slots.offer = lambda *p: (calls.append(p[1].size), offer(*p))
    search(x, ids, labels, a, ids[::40], labels[::40], slots, same=True)
    assert sum(calls) < 0.5 * len(a) * len(x) / 2
    s = a @ x.T
    s[(labels[::40][:, None] != labels[None]) | (ids[::40][:, None] == ids[None])] = -np.inf
    assert (slots.score[:, 0] == -np.sort(-s, axis=1)[:, :5]).all()


def test_forest_covers_each_row_once():
    x = np.arange(60.0).reshape(30, 2)
    label = np.array([0] * 20 + [1] * 3 + [2] * 7)
    f = Forest(x, label, 8)
    leaves = np.flatnonzero(f.left < 0)
    assert sorted(np.concatenate([f.rows(n) for n in leaves])) == list(range(30))
    assert all(len(f.rows(n)) <= 10 for n in leaves)
    assert all(np.sqrt(((x[f.rows(n)] - f.centre[n]) ** 2).sum(1)).max() <= f.radius[n] + 1e-9 for n in range(len(f.start)))


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [10.0, 0.0], 1), (1, [10.0, 0.0], 1), (2, [5.0, 1.0], 2), (3, [5.0, 9.0], 3), (3, [5.0, 9.0], 3), (4, [9.0, 0.0], 2), (5, [2.0, 0.0], 2),
        (6, None, 1), (7, [None, 1.0], 1), (8, [nan, 1.0], 2), (9, [inf, 1.0], 2), (10, [], 1), (11, [5.0], 2), (None, [5.0, 5.0], 2), (12, [6.0, 0.0], None),
        (100, [0.0, -1.0], 9), (200, [1.0, 1.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("mine").alias(c) for c in ("id", "v", "key", "rank", "slot", "dim", "shard", "low")])
    ok = [(i, np.array(v), g) for i, v, g in rows if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    got = rows_of(hard_negatives(df, F.col("vec_id") % 100 == 0))
    assert got == brute(ok, 5, 10)
    places = defaultdict(set)
    for r in got:
        places[r[0], r[1]].add(r[2])
    assert places[0, 1] == {1, 2}
    assert rows_of(hard_negatives(df.where("1 = 0"), F.col("vec_id") % 100 == 0)) == []
    assert rows_of(hard_negatives(df, F.lit(None).cast("boolean"))) == []
