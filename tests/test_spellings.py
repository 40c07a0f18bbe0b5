import random

import pytest

from loomwright.operators import contribute, graph
from loomwright.operators.spellings import spelt, spelt_somewhere

TEXTS, WORDS = "key string, text_id long, hay string", "key string, word_id long, word string"


def random_tables(seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abé_.") for _ in range(n))
    texts = [(rng.choice(["x", "y", "z"]), i, piece(rng.randrange(0, 60))) for i in range(120)] + [(None, 500, "aaa"), ("x", 501, None), ("x", 3, "ab")]
    words = [(rng.choice(["x", "y", "w"]), i, piece(rng.randrange(1, 6))) for i in range(150)] + [("x", 900, ""), ("y", 901, "aa"), ("y", 902, "aa"), ("y", 903, None), (None, 904, "a")]
    return texts, words


@pytest.mark.parametrize("sizes", [(50_000, 20_000), (7, 9)])
def test_automata_equal_the_substring_join(spark, sizes):
    texts, words = random_tables(4)
    t, w = spark.createDataFrame(texts, TEXTS), spark.createDataFrame(words, WORDS)
    want = {(k, i, j) for k, i, h in texts for g, j, x in words if k is not None and k == g and h is not None and x is not None and x in h}
    got = spelt(t, w, shard_words=sizes[0], block_texts=sizes[1])
    assert sorted(map(tuple, got.collect())) == sorted(want) and ("x", 3, 900) in want
    first = {}
    for k, i, j in want:
        first[k, i] = min(j, first.get((k, i), j))
    got = spelt(t, w, first=True, shard_words=sizes[0], block_texts=sizes[1])
    assert sorted(map(tuple, got.collect())) == sorted((*k, j) for k, j in first.items())
    assert spelt(t.where("1 = 0"), w).count() == spelt(t, w.where("1 = 0")).count() == 0


def matches(name, text):
    """LIKE '%name%' with underscores as wildcards."""
    return any(all(c in ("_", text[i + n]) for n, c in enumerate(name)) for i in range(len(text) - len(name) + 1))


def test_trigrams_equal_like(spark):
    rng = random.Random(8)
    piece = lambda n, letters="abcé_\n.": "".join(rng.choice(letters) for _ in range(n))
    texts = [piece(rng.randrange(0, 40)) for _ in range(60)] + ["get_value\nx", None, ""]
    names = sorted({piece(rng.randrange(1, 7), "abcé_.") for _ in range(200)} | {"getXvalue", "get_value", "get", "_", "__", "_" * 41, "", "zzz", "back\\slash"})
    got = spelt_somewhere(spark.createDataFrame([(n,) for n in [*names, "get", None]], "name string"), spark.createDataFrame([(t,) for t in texts], "hay string"))
    assert sorted(r["name"] for r in got.collect()) == [n for n in names if any(matches(n, t) for t in texts if t is not None)]
    none = spark.createDataFrame([], "hay string")
    assert spelt_somewhere(spark.createDataFrame([("a",), ("_",)], "name string"), none).count() == 0


def test_metrics_of_asked_symbols(spark):
    edges = spark.createDataFrame([("m.run", "m.load_all", "calls")], "src string, dst string, type string")
    rows = [("m.run", "m.py", 1, "def run(a):\n    if a and b:\n        pass\n"), ("m.run", "m.py", 9, "x"), ("m.load_all", "m.py", 5, "not python ("), ("t", "tests/test_m.py", 1, "check(preloadXall2)")]
    chunks = spark.createDataFrame(rows, "symbol string, file_path string, start_line int, content string")
    asked = spark.createDataFrame([("m.run",), ("m.load_all",), ("gone.away",)], "symbol string")
    got = {r["symbol"]: tuple(r)[1:] for r in graph.metrics(edges, chunks, asked).collect()}
    assert got == {"m.run": (0, 1, 3, 0, False), "m.load_all": (1, 0, 0, 0, True), "gone.away": (0, 0, 0, 0, False)}


def test_triage_takes_the_first_symbol(spark):
    issues = spark.createDataFrame([("r", 1, "t", "see loadAll and run", [], ["a/save.py"]), ("r", 2, "t", None, [], ["lib/save.py"]), ("r", 3, "t", "nothing", [], []), ("q", 4, "t", "run", [], [])], "repo_id string, number long, title string, body string, labels array<string>, referenced_files array<string>")
    metrics = spark.createDataFrame([("r", 0, "save", 1, 1, True), ("r", 1, "run", 9, 9, False), ("r", 2, "All", 2, 2, False)], "repo_id string, ordinal long, symbol string, fan_in int, cyclomatic int, has_tests boolean")
    got = {(r["repo_id"], r["number"]): r["symbol"] for r in contribute.triage(issues, metrics).collect()}
    assert got == {("r", 1): "save", ("r", 2): "save", ("r", 3): None, ("q", 4): None}
