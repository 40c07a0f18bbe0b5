import pytest
from pyspark.sql import functions as F

from loomwright.functions import scalar, text


def value(spark, column, **fields):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("query", "cleaned"), [("Where is the GZipDecoder class defined?", "GZipDecoder class defined"), ("what is the", "")])
def test_clean_query(spark, query, cleaned):
    assert value(spark, text.clean_query(F.col("q")), q=query) == cleaned


@pytest.mark.parametrize(("name", "parts"), [("HTTPTransport.handle_request", "HTTP Transport handle request"), ("fooBar2Baz", "foo Bar2 Baz"), ("plain", "plain")])
def test_split_identifier(spark, name, parts):
    assert value(spark, text.split_identifier(F.col("q")), q=name) == parts


@pytest.mark.parametrize(("query", "hit"), [("HTTPTransport", True), ("what does handle_request do", True), ("httpx.Client send", True), ("how are requests sent", False)])
def test_lexical(spark, query, hit):
    assert value(spark, text.looks_lexical(F.col("q")), q=query) is hit


@pytest.mark.parametrize(("path", "language"), [("a/b.TS", "typescript"), ("README.md", "markdown"), ("pkg/pyproject.toml", "toml"), ("Dockerfile", "dockerfile"), ("requirements-dev.txt", "requirements"), ("build.gradle.kts", "kotlin"), ("notes.txt", None), (".go", None)])
def test_language(spark, path, language):
    assert value(spark, text.language_of(F.col("q")), q=path) == language


@pytest.mark.parametrize(("url", "ok"), [("https://github.com/o/n", True), ("http://github.com/o/n.git", True), ("https://github.com/o/n/", True), ("https://gitlab.com/o/n", False), ("github.com/o/n", False)])
def test_repo_urls(spark, url, ok):
    got = (value(spark, text.repo_owner(F.col("q")), q=url), value(spark, text.repo_name(F.col("q")), q=url))
    assert got == (("o", "n") if ok else (None, None))


@pytest.mark.parametrize(("question", "intent"), [("compare where A and B differ", "compare"), ("where is it defined and how", "where_is"), ("trace how it goes", "architectural"), ("how to start", "procedural"), ("what is X", "factual")])
def test_intent(spark, question, intent):
    assert value(spark, text.intent_class(F.col("q")), q=question) == intent


def test_keywords_keep_first_spelling(spark):
    assert value(spark, text.keywords(F.col("q")), q="Alpha beta ALPHA of Beta gamma") == ["Alpha", "beta", "gamma"]


def test_truncate_on_line(spark):
    assert value(spark, text.truncate_lines(F.col("q"), 7, " [cut]"), q="abc\ndef\nghi") == "abc [cut]"
    assert value(spark, text.truncate_lines(F.col("q"), 70), q="abc") == "abc"


def test_numbered_lines(spark):
    assert value(spark, text.numbered_lines(F.col("q"), F.lit(10)), q="a\nb\n") == "10:a\n11:b"


@pytest.mark.parametrize(("raw", "clean"), [("<think>x</think> yes", "yes"), ("ok <think>never closed", "ok"), ("plain", "plain")])
def test_strip_reasoning(spark, raw, clean):
    assert value(spark, text.strip_reasoning(F.col("q")), q=raw) == clean


def test_claim_lines(spark):
    got = value(spark, text.claim_lines(F.col("q")), q="## Answer\n- It sends [0] a request [2].\n\nplain")
    assert [(r["line"], r["text"], list(r["citations"])) for r in got] == [(1, "It sendsa request.", [0, 2]), (3, "plain", [])]


@pytest.mark.parametrize(("answer", "hit"), [("## Answer\nI couldn't find it.", True), ("I could not find it.\nBut here is more.", False), ("All good", False)])
def test_not_found(spark, answer, hit):
    assert value(spark, text.is_not_found(F.col("q")), q=answer) is hit


@pytest.mark.parametrize(("raw", "decision"), [('{"decision": "verified"}', "verified"), ('well {"x": 1} then {"decision": "rejected"}', "rejected"), ("garbage", None), ('{"decision": "maybe"} {"decision": "verified"}', "verified")])
def test_verdict(spark, raw, decision):
    assert value(spark, scalar.verdict(F.col("q"), ["verified", "rejected"]), q=raw) == decision


def test_merge_and_clip(spark):
    ranges = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(8, 9), (1, 3), (4, 5), (20, 30)]])
    assert [tuple(r) for r in value(spark, scalar.merge_ranges(ranges), q="")] == [(1, 5), (8, 9), (20, 30)]
    assert [tuple(r) for r in value(spark, scalar.clip_ranges(ranges, F.lit(3), F.lit(22)), q="")] == [(3, 5), (8, 9), (20, 22)]


def test_uncovered(spark):
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(3).alias("end")))
    assert value(spark, scalar.uncovered_lines(F.lit(5), spans), q="") == [1, 4, 5]


def test_nearest_rank_is_half_even(spark):
    assert value(spark, scalar.nearest_rank(F.array(*map(F.lit, [1.0, 2.0])), 50), q="") == 1.0
    assert value(spark, scalar.nearest_rank(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0])), 50), q="") == 3.0


def test_approachability(spark):
    assert value(spark, scalar.approachability(F.lit(0), F.lit(0), F.lit(True)), q="") == 1.0
    assert abs(value(spark, scalar.approachability(F.lit(10), F.lit(4), F.lit(False)), q="") - 0.5) < 1e-12


def test_keywords_read_the_text_once(spark):
    """The tokens were made anew for each keyword: some thirty passes over a text."""
    text_once = text.keywords(F.col("q"))
    tree = spark.createDataFrame([("a",)], "q string").select(text_once.alias("k"))._jdf.queryExecution().analyzed().toString()
    assert tree.count("regexp_extract_all") == 1
    assert value(spark, text_once, q=None) == [] and value(spark, text.keywords(F.col("q"), 2), q="one TWO two three") == ["one", "TWO"]
