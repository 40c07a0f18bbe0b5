import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomwright.operators import keyword_tiles, retrieval


def _best(docs, queries, k):
    sums = {}
    for q, words in queries:
        asked = set(words.split())
        for i, w, held in docs:
            sums.setdefault(q, {}).setdefault(i, 0)
            sums[q][i] += w * sum(x in asked for x in held.split())
    return sorted((q, i, n) for q, of in sums.items() for i, n in sorted(of.items(), key=lambda x: (-x[1], x[0]))[:k] if n)


@pytest.mark.parametrize(("piece", "units", "words"), [(2048, 256, 8192), (3, 7, 2), (2, 5, 0)])
def test_sums_of_a_tile(monkeypatch, piece, units, words):
    """Products and single weights come to the same, whatever the pieces; ties go to the smaller id."""
    for name, value in (("PIECE", piece), ("UNITS", units), ("WORDS", words)):
        monkeypatch.setattr(keyword_tiles, name, value)
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{min(int(rng.paretovariate(0.8)), 60)}" for _ in range(n))
    docs = [(i, w, text(rng.randrange(1, 20))) for i in range(40) for w in (100, 10)]
    queries = [(q, text(rng.randrange(1, 30))) for q in range(11)] + [(77, "none")]
    rng.shuffle(docs)
    held = pa.table({"id": [d[0] for d in docs], "w": [d[1] for d in docs], "words": [d[2] for d in docs]})
    asked = pa.table({"query_id": [q[0] for q in queries], "words": [q[1] for q in queries]})
    got = keyword_tiles._best_of_tile(held, asked, 4, ["id"]).to_pylist()
    assert sorted((r["query_id"], r["id"], r["total"]) for r in got) == _best(docs, queries, 4)


def test_sums_over_shards_and_blocks(spark):
    docs = [(i % 50, 10, f"a b{i % 3} c{i % 7}") for i in range(120)]
    queries = [(q, f"a b{q % 3} c{q % 5}") for q in range(9)]
    found = keyword_tiles.best_in_shards(spark.createDataFrame(docs, "id long, w int, words string"), spark.createDataFrame(queries, "query_id long, words string"), 50, ["id"], 3, block_rows=4)
    assert sorted(map(tuple, found.collect())) == _best(docs, queries, 50)


def test_keyword_search_moves_no_pairs(spark):
    """A join of postings and asked terms has a row for each question, chunk and shared word."""
    chunks = spark.createDataFrame([(i, f"m.getThing{i}", "alpha beta " * (i % 4)) for i in range(20)] + [(90, None, None)], "chunk_id long, symbol string, content string")
    asked = spark.createDataFrame([(1, "alpha of beta"), (2, "thing getThing3"), (3, "the of"), (4, None)], "query_id long, query string")
    found = retrieval.keyword_search(chunks, asked, 6)
    normal = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"], r["distance"]) for r in df.collect())
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert normal(found) == normal(retrieval.keyword_rank(retrieval.postings(chunks), asked, 6))
    assert normal(found)[0] == (1, 1, 3, 0.6, 0.0) and {r[0] for r in normal(found)} == {1, 2}
    assert retrieval.keyword_search(chunks, asked, 0).collect() == []


def test_nearest_tile_is_bounded():
    """A full tile was some 270 MB for each array of distances; now 64 questions at a time."""
    rng = np.random.default_rng(2)
    vectors = lambda n: pa.array(list(rng.normal(size=(n, 4))))
    near, asked = pa.table({"i": range(16384), "v": vectors(16384)}), pa.table({"query_id": range(2048), "v": vectors(2048)})
    tracemalloc.start()
    got = retrieval._nearest_of_tile(near, asked, 3, "vec_id")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3 * 2048 and peak < 100e6


def test_keyword_overlap_moves_no_pairs(spark):
    """Ties follow the order asked for, nulls first; no row for each question, chunk and shared word."""
    chunks = spark.createDataFrame([(1, "b", "red blue Red"), (2, "a", "blue RED"), (3, None, "red"), (4, None, "blue red x"), (5, "a", None)], "chunk_id long, path string, content string")
    asked = spark.createDataFrame([(1, "red blue"), (2, None), (3, "x")], "query_id long, query string")
    found = retrieval.keyword_overlap(chunks, asked, 3, order=["path"])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["overlap"]) for r in found.collect()) == [(1, 1, 4, 2), (1, 2, 2, 2), (1, 3, 1, 2)]


def test_blocks_of_questions_take_turns(spark, monkeypatch):
    """With several blocks, each turn's rows are k a question, and the turns together give what one block gives."""
    docs = spark.createDataFrame([(i, 10, f"a b{i % 3} c{i % 7}") for i in range(60)], "id long, w int, words string")
    queries = spark.createDataFrame([(q, f"a b{q % 3} c{q % 5} a") for q in range(9)] + [(50, ""), (51, None)], "query_id long, words string")
    rows, cut = [], keyword_tiles.Tables.cut
    monkeypatch.setattr(keyword_tiles.Tables, "cut", lambda self, df: (out := cut(self, df), rows.append((df.columns, out.count())))[0])
    found = keyword_tiles.best_in_shards(docs, queries, 4, ["id"], 5, block_rows=4)
    turns = [n for columns, n in rows if columns == ["query_id", "id", "total"]]
    assert len(turns) == 3 and sum(turns) == 9 * 4 == found.count()
    asked = [(r["query_id"], r["words"]) for r in queries.where("words <> ''").collect()]
    assert sorted(map(tuple, found.collect())) == _best([tuple(r) for r in docs.collect()], asked, 4)
