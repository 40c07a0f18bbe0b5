import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomwright.llm import quality_model as model
from loomwright.llm import quality_rules as rules

from .conftest import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_document_rules(awkward):
    got = rules.document_rules(awkward, keep=("doc_id", "text")).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"]), r["doc_id"]


def test_hosts_shrink(spark):
    rows = [("bad", "no words")] * 40 + [("good", "w " + " ".join(f"v{i}" for i in range(30)))] * 200 + [("tiny", "no")] + [(None, "no")]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    out = {r["source"]: r for r in rules.host_verdicts(rules.document_rules(df)).collect()}
    assert out["bad"]["host_rejected"] and not out["good"]["host_rejected"] and None not in out
    assert out["tiny"]["host_rate"] < 1.0  # one document alone does not show what a host is like
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(df).collect()}
    assert kept[40] and not kept[0] and len(kept) == len(rows)


def test_apply_keeps_columns(awkward):
    out = rules.apply_rules(awkward)
    assert out.columns == awkward.columns
    want = sorted((d, t) for d, t in texts(awkward) if not brute(t)[5] and d is not None)
    assert sorted((d, t) for d, t in texts(out) if d is not None) == want


def test_empty(nothing):
    assert rules.judge(nothing).count() == 0 and rules.apply_rules(nothing).count() == 0


def test_classifier_on_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    from loomwright.llm.quality_model import op1_quality_classifier

    got = {r["doc_id"]: r for r in op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in rows if got[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95


def test_forest_is_what_it_learnt():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, len(model.FEATURES))).astype(np.float32)
    y = ((x[:, 3] > 0.2) ^ (x[:, 5] > 0)).astype(float)
    forest = model.fit(x[:1500], y[:1500])
    p = forest.score(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95
    one = np.array([forest.score(x[i : i + 1])[0] for i in range(1500, 1520)])
    assert np.allclose(one, p[:20])


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, 1)], [(0, None)], [(0, 1), (0, 0), (1, 1)]])
def test_few_labels(spark, awkward, labels):
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    stats = model.document_statistics(awkward)
    scored = model.score_documents(stats, model.learn(stats, told)).collect()
    assert len(scored) == awkward.count() and all(0 < r["score"] < 1 for r in scored)


def test_statistics_of_nothing(nothing):
    assert model.document_statistics(nothing).count() == 0
    assert model.statistics(None) == model.statistics("") == [0.0] * len(model.FEATURES)
    assert all(np.isfinite(model.statistics("\n \t"))) and all(np.isfinite(model.statistics("x" * 100_000)))
