import random

import pytest

from loomwright.operators import retrieval, stored_index
from loomwright.operators.stored_index import StoredIndex, write
from loomwright.plans.views import document_chunks, questions

CHUNKS = "chunk_id long, symbol string, content string"


def test_same_as_summing_every_posting(spark, sf, tmp_path):
    chunks, asked = document_chunks(spark, sf), questions(spark, sf)
    write(chunks, str(tmp_path / "i"), slices=3)
    index = StoredIndex(spark, str(tmp_path / "i"))
    want = retrieval.keyword_rank(retrieval.postings(chunks), asked, 20)
    got = index.top_k(asked, 20)
    normal = lambda df, ident: sorted((r["query_id"], r["rank"], r[ident], round(r["score"], 6)) for r in df.collect())
    assert normal(got, "id") == normal(want, "chunk_id")


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skips_and_still_finds_all(spark, tmp_path, k):
    """Few heavy chunks: most postings cannot win and are not looked at. Ties go to the smaller id."""
    rng = random.Random(k)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 200}"
    rows = [(i, f"pkg.mod{i % 7}.getThing{i}", " ".join(word() for _ in range(rng.randrange(0, 30)))) for i in range(1500)]
    rows += [(2000 + i, None, " ".join(["w1", "w2"] * (40 + i % 3) + ["w3"] * 20)) for i in range(30)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame([(1, "w1 w2 w3 w190"), (2, "where is w5?"), (3, "getThing77 w1"), (4, "nothing_like_it"), (5, "the of"), (6, "W3 w3 thing")], "query_id long, query string")
    write(chunks, str(tmp_path / "i"), slices=4, block=8)
    index = StoredIndex(spark, str(tmp_path / "i"))
    want = retrieval.keyword_rank(retrieval.postings(chunks), asked, k)
    normal = lambda df, ident: sorted((r["query_id"], r["rank"], r[ident], round(r["score"], 6)) for r in df.collect())
    floors = index.floors(asked, k)
    assert normal(index.top_k(asked, k, floors=floors), "id") == normal(want, "chunk_id")
    told = index.effort(asked.where("query_id = 1"), floors).first()
    assert told["looked_at"] < told["listed"] / 4


def test_nothing(spark, tmp_path):
    chunks = spark.createDataFrame([(1, None, None), (2, "", "")], CHUNKS)
    write(chunks, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "a"), (2, None)], "query_id long, query string")
    assert StoredIndex(spark, str(tmp_path / "i")).top_k(asked, 5).collect() == []


def test_long_questions_pair_nothing(spark, tmp_path, monkeypatch):
    """Whole texts as questions: chunks are summed in tiles; short questions still skip. Any border gives the same answers."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(n))
    chunks = spark.createDataFrame([(i, f"pkg.mod{i % 7}", words(rng.randrange(0, 60))) for i in range(300)], CHUNKS)
    asked = spark.createDataFrame([(i, words(80 if i % 2 else 3)) for i in range(12)], "query_id long, query string")
    write(chunks, str(tmp_path / "i"), slices=2, block=8)
    index = StoredIndex(spark, str(tmp_path / "i"))
    normal = lambda df, ident: sorted((r["query_id"], r["rank"], r[ident], round(r["score"], 6)) for r in df.collect())
    want = normal(retrieval.keyword_rank(retrieval.postings(chunks), asked, 10), "chunk_id")
    for many, live in ((16, 0.25), (0, 0.25), (1000, 1000), (1000, 0)):
        monkeypatch.setattr(stored_index, "MANY_WORDS", many)
        monkeypatch.setattr(stored_index, "MANY_LIVE", live)
        assert normal(index.top_k(asked, 10), "id") == want
    monkeypatch.setattr(stored_index, "MANY_WORDS", 16)
    plan = index.top_k(asked.where("query_id % 2 = 1"), 10)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "inline" not in plan


def test_texts_and_postings_move_once(spark, tmp_path):
    """Writing deals texts by id and postings by part and slice, and sorts no postings for a sample; the tiles take short questions along."""
    rng = random.Random(3)
    words = lambda n: " ".join(f"W{rng.randrange(90)}" for _ in range(n))
    chunks = spark.createDataFrame([(i, f"pkg.mod{i % 7}", words(40)) for i in range(200)], CHUNKS)
    spark.sparkContext.setJobGroup("index", "writing")
    write(chunks, str(tmp_path / "i"), slices=2, block=8)
    spark.sparkContext.setJobGroup("other", "reading")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("index")) <= 4
    asked = spark.createDataFrame([(i, words(80 if i % 3 else 3)) for i in range(12)], "query_id long, query string")
    got = StoredIndex(spark, str(tmp_path / "i")).top_k(asked, 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Union" not in plan.split("FlatMapGroupsInArrow")[0]
    normal = lambda df, ident: sorted((r["query_id"], r["rank"], r[ident], round(r["score"], 6)) for r in df.collect())
    assert normal(got, "id") == normal(retrieval.keyword_rank(retrieval.postings(chunks), asked, 10), "chunk_id")
