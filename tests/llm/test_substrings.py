import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import substrings
from loomwright.llm.common import Scratch, read_table
from loomwright.llm.substrings import FMIndex, dedup_substrings, op12_substring_dedup, repeated, repeated_runs, segments, word_hashes

DOCS = "doc_id long, text string"


def brute(rows, window=20):
    """rows: (doc_id, text). A null id comes first; windows at the same place are not earlier than each other."""
    first, split = {}, [((-1 << 63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for (doc_id, _), (i, w) in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone |= set(range(s, s + window))
        out.append((doc_id, len(w), len(gone), sha256(b" ".join(x for n, x in enumerate(w) if n not in gone)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def planted(seed, n=120):
    """Passages of 18 to 60 words in many documents, copies, near copies, a common line, repeats within a text."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages, line = [prose(k) for k in (18, 19, 20, 21, 25, 60)], prose(12)
    rows = []
    for i in range(n):
        parts = [prose(rng.randrange(0, 40))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            parts += [p, prose(rng.randrange(0, 9))]
        if rng.random() < 0.5:
            parts += [line, prose(15)]
        if rng.random() < 0.1:
            parts += ["x"] * rng.randrange(1, 70)
        if rng.random() < 0.1 and rows:
            old = rng.choice(rows)[1].split(" ")
            old[rng.randrange(len(old))] = "changed"
            parts = old
        rows.append((rng.randrange(10_000), rng.choice([" ", "\n", "  \t"]).join(parts)))
    return rows + rng.sample(rows, 5)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert rows_of(op12_substring_dedup(spark, sf)) == brute(rows)


@pytest.mark.parametrize("hot", [1, 4, 2048])
def test_planted(spark, hot):
    """hot = 1 deals every shared anchor's windows by their own hash; 2048 sends all to the indexes."""
    rows = planted(hot)
    assert rows_of(dedup_substrings(spark.createDataFrame(rows, DOCS).repartition(5), hot=hot, shard_words=500)) == brute(rows)


@pytest.mark.parametrize("window,anchor", [(5, 2), (8, 8), (33, 4)])
def test_other_windows(spark, window, anchor):
    rows = planted(window, 60)
    assert rows_of(dedup_substrings(spark.createDataFrame(rows, DOCS), window=window, anchor=anchor)) == brute(rows, window)


def test_indexes_find_what_is_shared(spark):
    """With few anchors over the limit, runs that no equal segment explains come from the shards."""
    rows, work = planted(9), Scratch(spark)
    _, _, runs = repeated(spark.createDataFrame(rows, DOCS), work)
    assert "FlatMapGroupsInPandas" in runs._jdf.queryExecution().executedPlan().toString()
    assert runs.count() > 0


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    more = [(None, "w1 w2 " * 30), (3, "w1 w2 " * 30), (50, " ".join(f"n{i}" for i in range(60))), (51, "n1 " * 19), (52, "n1 " * 20), (53, "n1 " * 21), (9, rows[0][1] + " more"), (9, rows[0][1] + " other")]
    df = awkward.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("doc", "tid", "start", "n", "seg", "runs", "wanted")]).unionByName(spark.createDataFrame(more, DOCS), allowMissingColumns=True)
    assert rows_of(dedup_substrings(df)) == brute(rows + more)
    assert rows_of(dedup_substrings(nothing)) == []


def test_slices_do_not_matter(monkeypatch):
    """Hashes and windows of a long text are the same however small the pieces it is taken in."""
    rng = random.Random(2)
    data = b"".join(bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 3, 40]))) + rng.choice([b" ", b"\n\n"]) for _ in range(500))
    words, at = word_hashes(data)
    assert [data[a : a + 50].split()[0] for a in at] == [w[:50] for w in data.split()]
    spots = {}
    for h, w in zip(words.tolist(), data.split(), strict=True):
        assert spots.setdefault(h, w) == w
    doc = np.zeros(len(words), np.int64)
    whole = segments(words, doc, 20, 10)
    monkeypatch.setattr(substrings, "SLICE", 7)
    monkeypatch.setattr(substrings, "STRIDE", 13)
    again, _ = word_hashes(data)
    assert (again == words).all()
    cover = lambda s: sorted((w, a) for a, start, n in zip(s[0].tolist(), s[2].tolist(), s[3].tolist(), strict=True) for w in range(start, start + n - 19))
    assert cover(segments(words, doc, 20, 10)) == cover(whole) and len(cover(whole)) == len(words) - 19


def test_backward_search():
    rng = np.random.default_rng(1)
    codes = np.concatenate([rng.integers(1, 4, 400), [0], rng.integers(1, 90, 300), [0], np.full(70, 5), [0]])
    index, text = FMIndex(codes, 16), codes.tolist()
    ends = np.flatnonzero(np.array([0 not in text[max(0, e - 15) : e + 1] and e >= 15 for e in range(len(text))]))
    length, low, high = index.matching(codes, ends, 16)
    for e, n, a, b in zip(ends, length, low, high, strict=True):
        count = lambda k: sum(text[i : i + k] == text[e - k + 1 : e + 1] for i in range(len(text) - k + 1))
        assert n == max((k for k in range(1, 17) if count(k) >= 2), default=0)
        if n:
            assert sorted(index.suffix[a:b]) == [i for i in range(len(text) - n + 1) if text[i : i + n] == text[e - n + 1 : e + 1]]


def test_runs_of_one_shard():
    texts = [b"a b c d e f".split(), b"x b c d e y".split(), b"b c d".split(), b"c d e".split()]
    got = sorted(zip(*(x.tolist() for x in repeated_runs(texts, np.array([5, 6, 7, 5]), np.array([0, 10, 0, 2]), 3)), strict=True))
    assert got == [(1, 1, 4), (2, 0, 3)]  # the last text stands at the first one's own place
