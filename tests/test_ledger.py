from datetime import datetime

from loomwright.operators import contribute, ledger


def test_coverage_and_latest(spark):
    repos = spark.createDataFrame([("r1",), ("r2",)], "repo_id string")
    chunks = spark.createDataFrame([("r1", i) for i in range(100)] + [("r2", 200), ("r2", 201)], "repo_id string, chunk_id int")
    embedded = spark.createDataFrame([(i,) for i in range(1, 100)] + [(200,)], "chunk_id int")
    counts = ledger.coverage(repos, chunks, embedded)
    assert [r["repo_id"] for r in ledger.complete(counts).collect()] == ["r1"]
    assert ledger.complete(counts, 1.0).count() == 0


def test_reservations(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("s", "index", "a", "reserved", t(1), 1), ("s", "index", "a", "completed", t(2), 2), ("s", "index", "b", "reserved", t(3), 3), ("u", "index", "c", "reserved", t(1), 4), ("u", "index", "c", "failed", t(2), 5), ("u", "index", "d", "reserved", t(3), 6)]
    df = spark.createDataFrame(rows, "session_id string, action string, resource_id string, status string, created_at timestamp, id int")
    out = {(r["session_id"], r["resource_id"]): (r["status"], r["granted"]) for r in ledger.reservations(df).collect()}
    assert out == {("s", "a"): ("completed", True), ("s", "b"): ("reserved", False), ("u", "c"): ("failed", False), ("u", "d"): ("reserved", True)}


def test_upsert(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    change = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, at int")
    assert sorted(map(tuple, ledger.upsert(now, change, ["id"], "at").collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_revisit(spark):
    wanted = spark.createDataFrame([("u", "h1"), ("w", "h9"), ("n", "h")], "url string, head_sha string")
    have = spark.createDataFrame([("u", "h0", 1), ("u", "h1", 2), ("w", "h8", 1)], "url string, head_sha string, indexed_at int")
    assert {r["url"]: r["status"] for r in ledger.revisit_status(wanted, have).collect()} == {"u": "already_indexed", "w": "stale", "n": "stale"}


PROFILE = "name string, raw_text string, modality_weights map<string,double>, focus_keywords array<string>, output_shape_preference string"


def test_planner(spark):
    rows = [
        ("learn", "explain the request lifecycle", {"understand": 0.6}, ["Client"], "unspecified"),
        ("issue", "find an issue for a pr", {"change": 0.5}, [], "unspecified"),
        ("audit", "audit security", {"change": 0.3}, [], "unspecified"),
        ("empty", "hello", {}, [], "unspecified"),
        ("compare", "x versus y", {"evaluate": 0.5}, [], "unspecified"),
        ("asked", "hello", {"locate": 0.3}, [], "dossier"),
    ]
    out = {r["name"]: r for r in contribute.plan(spark.createDataFrame(rows, PROFILE)).collect()}
    assert out["learn"]["active"] == ["cartographer", "flow_tracer", "teacher"] and out["learn"]["flow_tracer_targets"] == ["Client"] and out["learn"]["output_shape"] == "narrative"
    assert set(out["learn"]["dependencies"]) == {"teacher"}
    assert out["issue"]["active"] == ["lane_a_issue_triage", "lane_b_code_health", "teacher"] and out["issue"]["ranker_weights"] == {"A": 0.6, "B": 0.3, "C": 0.1} and out["issue"]["output_shape"] == "ranked_list"
    assert out["audit"]["active"] == ["lane_b_code_health", "lane_c_suspicion", "teacher"] and out["audit"]["ranker_weights"] == {}
    assert out["empty"]["active"] == ["cartographer", "lane_b_code_health", "teacher"] and out["empty"]["lane_b_framing"] == "cleanup_opportunities"
    assert out["compare"]["output_shape"] == "comparison_table" and out["compare"]["lane_b_framing"] == "tradeoffs_visible_in_code"
    assert out["asked"]["output_shape"] == "dossier"


def test_triage(spark):
    issues = spark.createDataFrame([("r", n, f"t{n}", body, [], []) for n, body in [(1, "pkg.hot fails"), (2, "pkg.cold fails"), (3, "no symbol"), (4, "none"), (5, "none")]], "repo_id string, number int, title string, body string, labels array<string>, referenced_files array<string>")
    metrics = spark.createDataFrame([("r", 0, "pkg.hot", 40, 20, False), ("r", 1, "pkg.cold", 0, 0, True)], "repo_id string, ordinal int, symbol string, fan_in int, cyclomatic int, has_tests boolean")
    out = [(r["number"], r["verdict"]) for r in contribute.triage(issues, metrics).orderBy("rank").collect()]
    assert out == [(2, "accepted"), (3, "accepted"), (4, "accepted"), (5, "rejected"), (1, "rejected")]


def test_suspicions(spark):
    refs = spark.createDataFrame([(0, "a.py", "f"), (1, "b.py", "bug"), (2, "c.py", None)], "ordinal int, file_path string, symbol string")
    out = contribute.suspicions(refs).collect()
    assert [r["file_path"] for r in out] == ["a.py", "c.py"] and all(r["confirm_before_pr"].startswith("to_confirm") for r in out)


def test_quality(spark):
    rows = [("dead_code", "f", "a.py", 25, 2, True, False, True), ("dead_code", "g", "a.py", 0, 0, False, True, True), ("missing_docstring", "h", "a.py", 9, 1, False, False, False)]
    df = spark.createDataFrame(rows, "detector string, symbol string, file_path string, fan_in int, cyclomatic int, has_tests boolean, is_entry_point boolean, is_public_api boolean")
    out = contribute.quality_candidates(df).collect()
    assert [(r["title"], r["difficulty"], r["blast_radius"], r["mergeability"]) for r in out] == [("Dead Code in f", "L", "hub", 0.8)]
