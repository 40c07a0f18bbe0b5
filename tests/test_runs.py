import math

import pytest
from pyspark.sql import functions as F

from loomwright.functions import scalar, text
from loomwright.operators import retrieval
from loomwright.plans import evaluate

PAIRS = "query string, text string"


def test_second_batch_scores_nothing(spark, tmp_path):
    def count(queries, texts):
        return [float(len(q) + len(t)) for q, t in zip(queries, texts, strict=True)]

    def refuse(queries, texts):
        raise ValueError("scored again")

    pairs = spark.createDataFrame([("a", "bb"), ("a", "bb"), ("c", None)], PAIRS)
    empty = spark.createDataFrame([], "key string, relevance double, last_used timestamp")
    first, cache = retrieval.score_cached(pairs, empty, count, model="m", now=F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r["relevance"] for r in first.collect()) == [1.0, 3.0, 3.0]
    cache.write.parquet(str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    again, later = retrieval.score_cached(pairs.where("query = 'a'"), cache, refuse, model="m", now=F.lit("2024-02-02").cast("timestamp"))
    assert [r["relevance"] for r in again.collect()] == [3.0, 3.0]
    assert sorted((r["relevance"], r["last_used"].month) for r in later.collect()) == [(1.0, 1), (3.0, 2)]
    assert retrieval.score_cached(pairs, cache, count, model="other")[1].count() == 4


def test_refused_texts_are_told(spark):
    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [None if t == "none" else [1.0] * (3 if t == "long" else 2) for t in texts]

    texts = spark.createDataFrame([(t,) for t in ("a", "bad", "none", "long", "known", "a")], "text string")
    cache = spark.createDataFrame([("known", [9.0, 9.0])], "text string, vector array<double>").select(F.sha2("text", 256).alias("text_key"), "vector")
    told = retrieval.embed_told(texts, cache, embed, dimension=2).join(texts.distinct().select(F.sha2("text", 256).alias("text_key"), "text"), "text_key")
    assert {r["text"]: (r["vector"], r["cached"], r["problem"]) for r in told.collect()} == {
        "a": ([1.0, 1.0], False, None), "bad": (None, False, "RuntimeError: no"), "none": (None, False, "no vector"), "long": (None, False, "length 3"), "known": ([9.0, 9.0], True, None)}
    assert retrieval.embed_missing(texts, cache, embed, dimension=2).count() == 2


@pytest.mark.parametrize(("reply", "decision", "reason", "symbol"), [
    ('{"decision":"sufficient"}', "sufficient", "", None), ('x {"decision":"insufficient","reason":"r","next_symbol":"s"} y', "insufficient", "r", "s"),
    ('{"decision":"insufficient","next_symbol":7}', "sufficient", "schema_error", None), ('{"decision":"insufficient","reason":null}', "sufficient", "schema_error", None),
    ("", "sufficient", "parse_error", None), (None, "sufficient", "parse_error", None), ('{"a":1} {"b":2}', "sufficient", "parse_error", None), ('{"a":{"decision":"insufficient"}}', "sufficient", "schema_error", None)])
def test_sufficiency(spark, reply, decision, reason, symbol):
    got = spark.createDataFrame([(reply,)], "r string").select(scalar.sufficiency(F.col("r")).alias("s")).first()["s"]
    assert tuple(got) == (decision, reason, symbol)


def test_lists_and_rubrics(spark):
    rows = [('```json\n[{"a":"]}"},\n {"b":2}, 5]```', 2), ("[1]", 0), ("[broken", 0), (None, 0), ('{"a":[{"x":1}]}', 1)]
    got = spark.createDataFrame(rows, "t string, n int").select("n", F.size(scalar.json_objects(F.col("t"))).alias("got")).collect()
    assert all(r["n"] == r["got"] for r in got)
    replies = spark.createDataFrame([('{"verdict":"actionable","reason":"r"}',), ('{"verdict":"perhaps"}',), ("no",)], "t string")
    assert [r["a"] and tuple(r["a"]) for r in replies.select(scalar.actionability(F.col("t")).alias("a")).collect()] == [("actionable", "r"), None, None]


def test_goal_anchor(spark):
    df = spark.sql("""SELECT named_struct('raw_text', ' why? ', 'modality_weights', map('locate', 0.4D, 'understand', 0.8D, 'change', 0.4D), 'focus_keywords', array('pool', 'leak'), 'audience_framing', 'for a review', 'success_criterion', CAST(NULL AS STRING)) AS p,
      named_struct('active', array('teacher'), 'output_shape', 'narrative', 'cartographer_tilt', 'balanced', 'flow_tracer_targets', array('pool'), 'lane_b_framing', ' ') AS l""")
    assert df.select(text.goal_anchor(F.col("p"), F.col("l"), "LAWS").alias("t")).first()["t"] == "\n".join([
        "USER GOAL (verbatim, do not rephrase):", '  "why?"', "  modality_weights: understand=0.80, change=0.40, locate=0.40", "  focus_keywords:   pool, leak", "  audience:         for a review", "",
        "PLAN TILT (set by the deterministic planner — honor it):", "  - active capabilities: teacher", "  - output shape:        narrative", "  - cartographer hub bias: balanced", "  - flow-tracer targets: pool", "", "LAWS"])


def test_nearest_in_tiles(spark):
    """Small shards and blocks give what one matrix product gives; ties go to the smaller id."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (200, 5)), 2)
    x[50:60] = x[3]
    chunks = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("none", None), ("short", [1.0]), ("zero", [0.0] * 5)], "vec_id string, embedding array<float>")
    queries = spark.createDataFrame([(int(i), x[i].tolist()) for i in range(0, 200, 7)] + [(3, x[3].tolist()), (999, None)], "query_id long, q array<double>")
    got = retrieval.nearest_batch(chunks, queries, 6, shard_rows=60, block_rows=9).collect()
    y = x.astype(np.float32).astype(np.float64)
    for i in [3, *range(0, 200, 7)]:
        d = 1 - y @ x[i] / np.sqrt((y * y).sum(1)) / np.sqrt((x[i] ** 2).sum())
        want = sorted((round(v, 9), f"c{n:03d}") for n, v in enumerate(d))[:6]
        assert [(round(r["distance"], 9), r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == want
    assert {r["query_id"] for r in got} == {3, *range(0, 200, 7)}
    assert retrieval.nearest_batch(chunks, queries, 0).count() == 0


def test_retrieval_report(spark, tmp_path):
    ref = "struct<file_path: string, start_line: int, end_line: int, symbol: string>"
    rows = spark.createDataFrame([("f", 1, "q1", [("a.py", 5, 9, None), ("b.py", 1, 2, None)], False), ("f", 2, "q2", [("z.py", 1, 1, None)], False), ("f", 3, "q3", [("a.py", 1, 1, None)], True), ("f", 4, "q4", [], False)], f"file string, line long, question string, expected_refs array<{ref}>, not_in_repo boolean")
    spans = spark.createDataFrame([(1, "x.py", 1, 9), (2, "a.py", 1, 5)], "rank int, file_path string, start_line int, end_line int")
    cases = evaluate.retrieval_cases(rows, lambda asked: asked.select("query_id").crossJoin(spans))
    got = {r["question"]: r for r in cases.collect()}
    assert set(got) == {"q1", "q2"} and got["q1"]["recall_5"] == 0.5 and got["q1"]["mrr"] == 0.5 and got["q2"]["mrr"] == 0 and got["q1"]["diversity"] == 1.0
    assert math.isclose(got["q1"]["ndcg_5"], (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    summary = evaluate.retrieval_summary(cases)
    for stamp in ("20250101T000000Z", "20240101T000000Z"):
        evaluate.report(summary, str(tmp_path), "r", dataset="d.jsonl", headline="recall_10", gate=0.5, stamp=stamp)
    newest = evaluate.latest_record(spark, str(tmp_path), "r").first()
    assert newest["timestamp_utc"] == "20250101T000000Z" and newest["headline_metric"] == 0.25 and not newest["passed"] and newest["payload"]["total"] == 2
    page = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "20250101T000000Z-r.md")).collect())
    assert page.startswith("# r — 20250101T000000Z\n\n- **Dataset:** `d.jsonl`\n- **Gate:** ≥ 50%\n- **Result:** 25.0% — FAIL\n") and "| mrr | 0.2500 |" in page


def test_circuit_opens_once_a_task(spark):
    """After five failures in a row nothing is asked any more, over all Arrow batches of the task."""
    from loomwright import external
    from loomwright.storage import settings

    asked = spark.sparkContext.accumulator(0)

    def generate(prompts):
        asked.add(1)
        raise RuntimeError("down")

    chunks = spark.range(60).coalesce(1).selectExpr("'s' AS symbol", "'function' AS kind", "'a.py' AS file_path", "concat('c', id) AS content")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="7"):
        out = external.summarise(chunks, generate).collect()
    assert len(out) == 60 and all(r["summary"] for r in out) and asked.value == 5
