import pytest
from pyspark.sql import functions as F

from loomwright.operators import evaluation, filters, retrieval


def test_fusion_prefers_shared_hits(spark):
    rows = [("q", 0, 1, "solo"), ("q", 0, 2, "both"), ("q", 1, 1, "both")]
    lanes = spark.createDataFrame(rows, "query_id string, lane int, rank int, chunk_id string").withColumn("weight", F.lit(1.0))
    out = retrieval.fuse(lanes).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["both", "solo"]
    assert abs(out[1]["score"] - 1 / 61) < 1e-12 and abs(out[0]["distance"] - 1 / (1 + 1 / 62 + 1 / 61)) < 1e-12


def test_weights_and_ties(spark):
    rows = [("q", 0, 1, "d", 3.0), ("q", 1, 1, "s", 1.0), ("q", 1, 2, "t", 1.0)]
    lanes = spark.createDataFrame(rows, "query_id string, lane int, rank int, chunk_id string, weight double")
    assert [r["chunk_id"] for r in retrieval.fuse(lanes).orderBy("rank").collect()] == ["d", "s", "t"]
    even = lanes.withColumn("weight", F.lit(1.0)).where("rank = 1")
    assert [r["chunk_id"] for r in retrieval.fuse(even).orderBy("rank").collect()] == ["d", "s"]


def test_representative_has_a_symbol(spark):
    rows = [("q", 0, 1, "c", None), ("q", 1, 5, "c", "pkg.f")]
    lanes = spark.createDataFrame(rows, "query_id string, lane int, rank int, chunk_id string, symbol string")
    assert retrieval.representative(lanes).first()["symbol"] == "pkg.f"


def test_retry_only_where_empty(spark):
    filtered = spark.createDataFrame([("a", 1)], "query_id string, rank int")
    both = spark.createDataFrame([("a", 7), ("b", 8)], "query_id string, rank int")
    assert sorted(map(tuple, retrieval.with_retry(filtered, both).collect())) == [("a", 1), ("b", 8)]


@pytest.mark.parametrize(("tokens", "relevance", "balance", "k", "order"), [
    ([{"a"}, {"b"}, {"c"}], [0.2, 0.9, 0.5], 1.0, 3, [1, 2, 0]),
    ([{"x", "y"}, {"x", "y"}, {"z"}], [1.0, 0.9, 0.3], 0.5, 2, [0, 2]),
    ([{"x", "y"}, {"x", "y"}, {"z"}], [1.0, 0.98, 0.1], 0.9, 2, [0, 1]),
    ([{"a"}, {"b"}], [1.0, 1.0], 0.7, 2, [0, 1]),
    ([], [], 0.7, 2, []),
])
def test_mmr(tokens, relevance, balance, k, order):
    assert retrieval.mmr_order(tokens, relevance, k, balance) == order


def test_diversify_on_tables(spark):
    rows = [("q", 1, "a", "x y", 1.0), ("q", 2, "b", "x y", 0.9), ("q", 3, "c", "z", 0.3)]
    pool = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, text string, relevance double")
    assert [r["chunk_id"] for r in retrieval.diversify(pool, 2, balance=0.5).orderBy("rank").collect()] == ["a", "c"]


def test_keyword_rank_bands(spark):
    chunks = spark.createDataFrame([("sym", "pkg.handle_request", "body"), ("body", "other", "handle_request handle_request"), ("none", "x", "y")], "chunk_id string, symbol string, content string")
    qs = spark.createDataFrame([("q", "where is handle_request")], "query_id string, query string")
    out = retrieval.keyword_rank(retrieval.postings(chunks), qs).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in out] == [("sym", 1.0), ("body", 0.2)]
    assert out[0]["distance"] == 0.0


def test_prompt_budget(spark):
    df = spark.createDataFrame([("q", 1, "a" * 5), ("q", 2, "b" * 5), ("q", 3, "c" * 5)], "query_id string, rank int, content string")
    assert [(r["rank"], r["chars"]) for r in retrieval.prompt_budget(df, per_chunk=4, total=6).orderBy("rank").collect()] == [(1, 4), (2, 2)]
    assert [r["rank"] for r in retrieval.prompt_budget(df, per_chunk=4, total=6, cut_last=False).collect()] == [1]


def test_exclusions():
    assert filters.exclusions_for(["Testing docs"]) == ("examples/", "scripts/")
    assert filters.exclusions_for([]) == ("tests/", "examples/", "docs/", "docs_src/", "scripts/")


def test_corpus_filter(spark):
    df = spark.createDataFrame([("r", "function", "src/a.py"), ("r", "class", "tests/a.py"), ("s", "function", "src/b.py")], "repo_id string, kind string, file_path string")
    assert df.where(filters.corpus_filter("r", exclude=("tests/",))).count() == 1
    assert df.where(filters.corpus_filter(glob="src/_.py", kind="function")).count() == 2


def test_embed_missing(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), ("bad",), ("short",)], "text string")
    cache = spark.createDataFrame([("b", [9.0, 9.0])], "t string, vector array<double>").select(F.sha2("t", 256).alias("text_key"), "vector")

    def embed(items):
        if "bad" in items:
            raise RuntimeError("no")
        return [[1.0] if x == "short" else [1.0, 2.0] for x in items]

    out = {r["text_key"]: list(r["vector"]) for r in retrieval.embed_missing(texts, cache, embed, dimension=2).collect()}
    key = lambda s: spark.range(1).select(F.sha2(F.lit(s), 256)).first()[0]
    assert out == {key("a"): [1.0, 2.0], key("b"): [9.0, 9.0]}


def test_greedy_relevance(spark):
    hits = spark.createDataFrame([("q", 1, "a", 10, 50), ("q", 2, "a", 30, 70), ("q", 3, "b", 1, 2)], "query_id string, rank int, file_path string, start_line int, end_line int")
    wanted = spark.createDataFrame([("q", "a", 40, 60, 1)], "query_id string, file_path string, start_line int, end_line int, expected_id int")
    assert [r["rel"] for r in evaluation.relevance(hits, wanted).orderBy("rank").collect()] == [1, 0, 0]


def test_ranking_metrics(spark):
    rels = spark.createDataFrame([("x", 1, 0), ("x", 2, 0), ("x", 3, 1)], "query_id string, rank int, rel int")
    counts = spark.createDataFrame([("x", 2), ("none", 0)], "query_id string, n_expected int")
    out = {r["query_id"]: r for r in evaluation.ranking_metrics(rels, counts, (5,)).collect()}
    assert out["x"]["recall_5"] == 0.5 and abs(out["x"]["mrr"] - 1 / 3) < 1e-12 and out["none"]["recall_5"] == 1.0 and out["none"]["ndcg_5"] == 1.0


def test_bootstrap(spark):
    rows = [("same", i, 0.5, 0.5) for i in range(20)] + [("up", i, 0.2, 0.8) for i in range(30)]
    out = {r["metric"]: r for r in evaluation.bootstrap(spark.createDataFrame(rows, "metric string, case_id int, before double, after double"), resamples=200).collect()}
    assert not out["same"]["significant"] and out["up"]["significant"] and abs(out["up"]["mean_delta"] - 0.6) < 1e-12


def test_stage_shares(spark):
    rows = [(1000.0, {"verify": 400.0}), (2000.0, {"verify": 800.0, "answer": 1000.0})]
    out = evaluation.stage_shares(spark.createDataFrame(rows, "total_ms double, stages map<string,double>"), ["verify", "answer"]).first()
    assert abs(out["verify"] - 0.4) < 1e-12 and abs(out["answer"] - 0.25) < 1e-12


def test_regressions(spark):
    before = spark.createDataFrame([("r", m, 1.0) for m in ("stage_a", "stage_b", "latency_p95")], "repo string, metric string, value double")
    after = spark.createDataFrame([("r", "stage_a", 3.0), ("r", "stage_b", 0.5), ("r", "latency_p95", 1.6)], "repo string, metric string, value double")
    d = evaluation.deltas(before, after)
    assert [r["metric"] for r in evaluation.worst_regressions(d).collect()] == ["stage_a"]
    assert evaluation.over_budget(d).count() == 1
