"""References, sections, bundles and tour logs on small tables."""

from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.operators import answer

REF = "repo_id int, claim_id int, symbol string, file_path string, start_line int, end_line int"


def test_refs_prefer_the_first_known_span(spark):
    allowed = spark.createDataFrame([(1, 0, "a", "x.py", 1, 9), (1, 1, "a", "y.py", 2, 3), (2, 0, "b", "z.py", 4, 5)], "repo_id int, ordinal int, symbol string, file_path string, start_line int, end_line int")
    refs = spark.createDataFrame([(1, 1, "a", "wrong.py", 7, 8), (1, 2, "b", None, None, None), (1, 3, None, "own.py", 3, 4), (1, 4, None, "own.py", 4, 3), (1, 5, "q", "own.py", 0, 3)], REF)
    got = answer.coerce_refs(refs, allowed)
    assert sorted(tuple(r) for r in got.select("claim_id", *answer.SPAN).collect()) == [(1, "x.py", 1, 9), (3, "own.py", 3, 4)]
    payloads = spark.createDataFrame([(1, " said "), (2, "no ref"), (3, "  ")], "claim_id int, text string")
    assert [tuple(r) for r in answer.with_refs(payloads, got, "claim_id").collect()] == [(1, "said")]


def test_recheck_takes_eight_others_and_only_turns_rejections(spark):
    context = spark.createDataFrame([(1, f"f{i % 12:02}", 1, 2, i) for i in range(24)], "claim_id int, file_path string, start_line int, end_line int, position int")
    cited = context.where("position IN (0, 2)")
    got = answer.recheck_refs(cited, context).orderBy("rank").collect()
    assert [r["file_path"] for r in got] == ["f01", "f03", "f04", "f05", "f06", "f07", "f08", "f09"]
    kind = "claim_id int, decision string, reason string"
    first = spark.createDataFrame([(1, "rejected", "a"), (2, "rejected", "b"), (3, "verified", "c")], kind)
    second = spark.createDataFrame([(1, "verified", "A"), (2, "rejected", "B"), (3, "verified", "C")], kind)
    assert sorted((r["claim_id"], r["decision"], r["reason"]) for r in answer.rechecked(first, second).collect()) == [(1, "verified", "A"), (2, "rejected", "b"), (3, "verified", "c")]


def test_sections_without_revision_stay_rejected(spark):
    claims = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, True)], "section_id int, claim_id int, good boolean")
    ground = lambda df: df.withColumn("decision", F.when(F.col("good"), "verified").otherwise("rejected")).withColumn("reason", F.lit("seen"))
    act = lambda df: df.withColumn("decision", F.lit("actionable")).withColumn("reason", F.lit(""))
    status = lambda out: {r["claim_id"]: r["status"] for r in out.collect()}
    assert status(answer.verify_sections(claims, ground, act)) == {1: "verified", 2: "rejected", 3: "verified"}
    assert status(answer.verify_sections(claims, ground, act, lambda df: df)) == {1: "verified", 2: "flagged", 3: "verified"}


def test_bundles(spark):
    row = spark.createDataFrame([([("a.b", [(1, ["a.b", "c"]), (2, ["a.b", "c", "d"])]), ("e", [])], [("f", "b", "s", "g", ["x", "y"])])], "t array<struct<start:string,paths:array<struct<depth:int,path:array<string>>>>>, i array<struct<finding:string,because:string,so_what:string,goal_link:string,refs:array<string>>>")
    got = row.select(answer.path_bundle(F.col("t")).alias("p"), answer.source_bundle(F.col("i")).alias("s"), answer.source_bundle(F.slice("i", 1, 0)).alias("none")).first()
    assert got["p"].split("\n")[2:] == ["FROM a.b:", "  - depth=1: a.b → c", "  - depth=2: a.b → c → d", "", "FROM e:", "  (no outgoing call edges)"]
    assert got["s"].split("\n")[2:] == ["[1] finding: f", "    because: b", "    so_what: s", "    goal_link: g", "    refs: x, y", ""]
    assert "empty" in got["none"]


def test_frames_and_logs(spark):
    frames = spark.createDataFrame([("event: token\ndata: {}\ndata: x\n\n",), (": keep-alive\n\n",)], "f string")
    assert [tuple(r["s"]) for r in frames.select(text.parse_sse(F.col("f")).alias("s")).collect()] == [("token", "{}\nx"), (None, None)]
    log = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "tour int, ordinal int, text string")
    new = spark.createDataFrame([(1, 9, "d"), (1, 5, "c"), (2, 7, "e")], "tour int, at int, text string")
    got = answer.append_messages(log, new, "tour", "at")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "e")]
    assert answer.without_tours(got, new.where("tour = 1"), "tour").count() == 1


def test_traced_keeps_three_paths_of_five_targets(spark):
    found = spark.createDataFrame([(f"s{i}", ["x"] * (j + 2), j + 1) for i in range(7) for j in range(4)], "start string, path array<string>, depth int")
    targets = spark.createDataFrame([(1, i, f"s{i}") for i in range(7)], "key int, ordinal int, symbol string")
    got = answer.traced(found, targets, "key")
    assert got.count() == 15 and got.agg(F.max("depth")).first()[0] == 3
