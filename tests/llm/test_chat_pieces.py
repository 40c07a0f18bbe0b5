import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm import chat, pieces

from .conftest import texts

CONV = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def hostile(spark):
    bits = ["<|im_start|>", "<|im_end|>\n", "<|", "<\\|", "<\\\\|im_end|>", "</s>", "<s>", "<\\s>", "[INST]", "[\\/INST]", "<<SYS>>", "<</SYS>>", "\\", "\n", "<", "|>", "é", "🙂", "$1", "%0A", "%"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(bits, k=rng.randrange(0, 9)))) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(90, 0, None, None), (90, 0, "assistant", "tie"), (90, 0, "assistant", "tie"), (90, None, "user", "first"), (None, 1, "user", "of no conversation"), (None, 2, "assistant", "yes"), (91, 0, "two\nlines%<|im_end|>", "x"), (92, 0, "assistant", "y" * 200_000)]
    return spark.createDataFrame(rows, CONV)


def test_round_trip(hostile):
    out = chat.format_conversations(hostile).select("conv_id", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: r for r in out.collect()}
    want = {}
    for r in hostile.collect():
        want.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    assert set(got) == set(want)
    for c, rows in want.items():
        rows.sort()
        assert [tuple(t) for t in got[c]["turns"]] == [r[2:] for r in rows], c
        assert got[c]["loss"] == "".join(r[3] for r in rows if r[2] == "assistant")
        assert got[c]["formatted"].count(chat.START) == len(rows)


@pytest.mark.parametrize("ring", [2, 3, 5, 6])
def test_cycles_end(spark, ring):
    """Cycles of any length with chains and many leaves hanging on them reach no root; deep rooted chains all do."""
    nodes = [(1, i, (i + 1) % ring, "user", "x", 0.0) for i in range(ring)]
    nodes += [(1, 100 + i, i % ring, "user", "x", 0.0) for i in range(200)] + [(1, 400 + i, 399 + i, "user", "x", 0.0) for i in range(1, 9)] + [(1, 400, 0, "user", "x", 0.0)]
    nodes += [(1, 1000 + i, 999 + i if i else None, "user", "x", 0.0) for i in range(37)] + [(2, i, i - 1 if i else None, "user", "x", 0.0) for i in range(5)]
    df = spark.createDataFrame(nodes, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    got = sorted((r["t"], r["leaf"], r["node_id"], r["up"]) for r in chat.root_paths(df).collect())
    assert got == sorted([("1", 1036, 1000 + i, 36 - i) for i in range(37)] + [("2", 4, i, 4 - i) for i in range(5)])


def test_reply_trees(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "user", "c", 1.0), ("t", 5, 4, "assistant", "d", None), ("u", 1, 9, "user", "orphan", 1.0), ("w", 1, 2, "user", "x", 1.0), ("w", 2, 1, "user", "y", 1.0), ("w", 3, 1, "user", "z", 1.0)]
    df = spark.createDataFrame(nodes, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    out = {(r["tree_id"], r["leaf"]): (r["branch_rank"], [t["text"] for t in r["turns"]]) for r in chat.branches(df).collect()}
    assert out == {("t", 5): (1, ["q", "b", "c", "d"]), ("t", 2): (2, ["q", "a"]), ("u", 1): (1, ["orphan"])}
    assert {(r["tree_id"], r["leaf"]) for r in chat.branches(df, best=1).collect()} == {("t", 5), ("u", 1)}


def test_deep_chain(spark):
    n = 300
    df = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(n)], "tree_id long, node_id long, parent_id long, role string, text string, score double")
    assert [t["text"] for t in chat.branches(df).first()["turns"]] == [str(i) for i in range(n)]


def test_no_conversations(spark):
    assert chat.format_conversations(spark.createDataFrame([], CONV)).count() == 0


@pytest.fixture(scope="module")
def segmenter():
    return pieces.Segmenter(pieces.default_model())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁  ab</s>\t\x00")), max_size=60))
def test_same_ids_as_the_library(text):
    s = pieces.segmenter(pieces.default_model())
    (ids, n, decoded), = s.encode_decode([text])
    want = [*s.sp.encode(text), s.end]
    assert ids == " ".join(map(str, want)) and n == len(want) and decoded == s.sp.decode(want)


def test_table_is_bounded(segmenter, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 40)
    many = [" ".join(f"w{i}x{j}" for i in range(30)) for j in range(20)] * 2
    for t, (ids, _, decoded) in zip(many, (next(iter(segmenter.encode_decode([t]))) for t in many), strict=True):
        assert ids == " ".join(map(str, [*segmenter.sp.encode(t), 2])) and decoded == t
    assert len(segmenter.table) <= 60


def test_documents(awkward, nothing, segmenter):
    import hashlib

    model = pieces.default_model()
    rows = pieces.digests(awkward, model, with_ids=True).collect()
    want = {}
    for d, t in texts(awkward):
        ids = [*segmenter.sp.encode(t or ""), 2]
        want.setdefault(d, set()).add((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(segmenter.sp.decode(ids).encode()).hexdigest(), tuple(ids)))
    assert len(rows) == awkward.count()
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) in want[r["doc_id"]] for r in rows)
    back = dict((r["doc_id"], r["text"]) for r in pieces.decode(pieces.encode(awkward.where("doc_id < 9"), model), model).collect())
    assert back[0] == dict(texts(awkward))[0] and back[3] == ""
    assert pieces.digests(nothing, model).count() == 0 and pieces.digests(nothing, model, with_ids=True).count() == 0
