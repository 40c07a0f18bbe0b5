"""The pipeline against plain Python, stage by stage, on the smallest tables."""

import hashlib

import corpus_pipeline as pipeline
from loomwright.llm.pieces import default_model

from .test_lines import brute as removed_lines
from .test_lines import words
from .test_mix_shard import cyclic
from .test_near_dup import brute as groups
from .test_quality import brute as rules


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    want = {d: r["text"] for d, r in rows.items() if not rules(r["text"])[5]}
    done = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = docs.collect()
        done.append(name)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "quality_rules":
            assert {r["doc_id"]: r["text"] for r in got} == want
        elif name == "line_dedup":
            gone = set(removed_lines(sorted(want.items())))
            left = {}
            for d, t in want.items():
                kept = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]
                if len(kept) == t.count("\n") + 1 or any(words(x) for x in kept):
                    left[d] = "\n".join(kept)
            want = left
            assert {r["doc_id"]: r["text"] for r in got} == want
        elif name == "near_duplicates":
            want = {d: want[d] for d, _, c in groups(list(want.items()), pipeline.NEAR.percent, pipeline.NEAR.words) if d == c}
            assert {r["doc_id"]: r["text"] for r in got} == want
        elif name == "mixing":
            assert {r["doc_id"] for r in got} <= set(want) and all(r["text"] == want[r["doc_id"]] for r in got)
            sizes = {}
            for d, t in want.items():
                sizes[rows[d]["source"]] = sizes.get(rows[d]["source"], 0) + len(t.split())
            target, taken = cyclic(sizes), {}
            for r in got:
                taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
            assert all(abs(taken[s] - t) <= 0.06 * t for s, t in target.items())
            want = sorted(r["doc_id"] for r in got)
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
            assert sorted(r["doc_id"] for r in got) == want
            assert all(r["ids"][-1] == 2 and r["n_tokens"] == len(r["ids"]) and hashlib.sha256(sp.decode(r["ids"]).encode()).hexdigest() == r["decoded_sha256"] for r in got)
    assert done == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "sentencepiece"]


def test_run(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 0 and pipeline.ORACLE_SQL is None


def test_no_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("1 = 0")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
