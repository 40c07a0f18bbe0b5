import random

import pytest

from loomwright.llm import links
from loomwright.llm.near_dup import Likeness, keep_one, near_duplicates

from .conftest import texts


def shingles(text, n=3):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, percent=85, n=3):
    sets = [(d, shingles(t, n)) for d, t in rows]
    group = list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(sets):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, len(s), best[find(i)]) for i, (d, s) in enumerate(sets))


def result(df, like=Likeness()):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df, like).where("doc_id is not null").collect())


def test_awkward(awkward):
    assert result(awkward) == brute([x for x in texts(awkward) if x[0] is not None])
    assert near_duplicates(awkward).count() == awkward.count()


def corpus(seed, n):
    """Copies of copies, each with some words changed, around texts of many lengths; and a passage that all share."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 5000}"
    passage, out = [word() for _ in range(30)], []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = list(rng.choice(out))
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice([1, 2, 3, 5, 12, 30, 33, 36, 40, 80, 300]))] + passage * (rng.random() < 0.3)
        out.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize(("seed", "like"), [(1, Likeness()), (2, Likeness()), (3, Likeness(words=5, percent=80, shared=13))])
def test_against_all_pairs(spark, seed, like):
    rows = corpus(seed, 250)
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), like) == brute(rows, like.percent, like.words)


def test_large_group_of_near_copies(spark):
    """Copies that resemble the base more or less; many are just too far from it."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(w)))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_keep_one(awkward):
    out = keep_one(awkward)
    assert out.columns == awkward.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 0 in ids and 1 not in ids and 2 not in ids and None in ids and {3, 4, 5} <= set(ids)


def test_empty(nothing):
    assert near_duplicates(nothing).count() == 0 and keep_one(nothing).count() == 0


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(3)
    order = list(range(200))
    rng.shuffle(order)
    edges = {"chain": list(zip(order, order[1:])), "star": [(order[0], x) for x in order[1:]], "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]}[kind]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
