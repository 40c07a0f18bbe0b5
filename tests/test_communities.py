import random
from collections import defaultdict

import pytest

from loomwright.operators import communities
from loomwright.operators.communities import layers, louvain, modularity

EDGES = "src string, dst string, type string"


def plain_modularity(pairs, label):
    m, degree, inside, total = len(pairs), defaultdict(int), 0, defaultdict(int)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
        inside += label[a] == label[b]
    for s, d in degree.items():
        total[label[s]] += d
    return inside / m - sum(t * t for t in total.values()) / (4 * m * m)


def plain_louvain(pairs):
    """One node at a time, in order, until no move gains; then communities become nodes."""
    weight, home, two_m = defaultdict(lambda: defaultdict(int)), {}, 2 * len(pairs)
    for a, b in pairs:
        weight[a][b] += 1
        weight[b][a] += 1
    degree = {a: sum(n.values()) for a, n in weight.items()}
    member = {a: a for a in weight}
    while True:
        home, total, moved, any_moved = {a: a for a in weight}, dict(degree), True, False
        while moved:
            moved = False
            for a in sorted(weight):
                to = defaultdict(int)
                for b, w in weight[a].items():
                    if b != a:
                        to[home[b]] += w
                total[home[a]] -= degree[a]
                value = lambda c: two_m * to[c] - degree[a] * total[c]  # noqa: E731, B023
                best = max([home[a], *sorted(to)], key=value)
                if value(best) > value(home[a]):
                    home[a], moved, any_moved = best, True, True
                total[home[a]] += degree[a]
        if not any_moved:
            return member
        member = {s: home[c] for s, c in member.items()}
        new, more = defaultdict(lambda: defaultdict(int)), defaultdict(int)
        for a, n in weight.items():
            more[home[a]] += degree[a]
            for b, w in n.items():
                new[home[a]][home[b]] += w
        weight, degree = new, dict(more)


def planted(seed, groups=5, size=8, inside=0.5, outside=0.03):
    rng, n = random.Random(seed), groups * size
    return sorted({(f"n{a:02d}", f"n{b:02d}") for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else outside)})


def rows(spark, pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], EDGES)


@pytest.mark.parametrize("seed,inside,outside", [(1, 0.6, 0.02), (2, 0.35, 0.1)])
def test_as_good_as_one_node_at_a_time(spark, seed, inside, outside):
    pairs = planted(seed, inside=inside, outside=outside)
    df = rows(spark, pairs)
    found = louvain(df)
    label = dict(map(tuple, found.collect()))
    assert set(label) == {s for p in pairs for s in p}
    q = plain_modularity(pairs, label)
    assert q >= 0.98 * plain_modularity(pairs, plain_louvain(pairs))
    told = modularity(df, found).first()
    assert told["edges"] == len(pairs) and told["communities"] == len(set(label.values())) and abs(told["modularity"] - q) < 1e-12
    assert all(c == min(s for s in label if label[s] == c) for c in label.values())


def test_clear_cases(spark):
    cliques = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(5) for j in range(i + 1, 5)]
    ring = [("a0", "b0"), ("b1", "c0"), ("c1", "a1")]
    label = dict(map(tuple, louvain(rows(spark, cliques + ring + [("b0", "a0"), ("a0", "a0"), ("z", "z"), (None, "a1")])).collect()))
    assert label == {f"{g}{i}": f"{g}0" for g in "abc" for i in range(5)}
    assert louvain(rows(spark, [])).collect() == []
    assert louvain(rows(spark, [("x", "y")])).orderBy("symbol").collect() == [("x", "x"), ("y", "x")]


def test_stars_settle_in_few_rounds(spark, monkeypatch):
    """A hub takes most of its leaves in one round, not one leaf a round."""
    turns, plain = [], communities._moves
    monkeypatch.setattr(communities, "_moves", lambda *a: (turns.append(1), plain(*a))[1])
    pairs = [(f"hub{h}", f"leaf{h}_{i:03d}") for h in range(4) for i in range(300)]
    label = dict(map(tuple, louvain(rows(spark, pairs)).collect()))
    assert label == {s: f"hub{h}" for h in range(4) for s in [f"hub{h}", *[f"leaf{h}_{i:03d}" for i in range(300)]]}
    assert len(turns) < 30


def test_layers(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("x", "y")]
    label = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("lone", "x")], "symbol string, community string")
    got = sorted(map(tuple, layers(label, rows(spark, pairs), 2).collect()))
    assert got == [("a", 3, 1, "a", 2), ("a", 3, 2, "b", 2), ("x", 3, 1, "x", 1), ("x", 3, 2, "y", 1)]
    assert modularity(rows(spark, []), label).first()["modularity"] is None
