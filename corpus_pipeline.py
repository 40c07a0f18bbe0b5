"""Corpus pipeline: rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Defined cases, for all stages: columns beside doc_id, text and source pass through, whatever their names.
Null and blank texts fail the quality rules, and later stages leave them as they are (no lines, in no
group, no copies, the end id alone). A null doc_id sorts first and is in no group; a null source is a source
of its own. Very long texts count whole. Repeated rows are one document to line dedup and near-dedup, which
keep or drop them together; mixing deals their copies. An empty table goes through as an empty one.
"""

from __future__ import annotations

import uuid

from loomwright.llm.common import delete, read_table, scope, shared_folder
from loomwright.llm.line_dedup import dedup_lines
from loomwright.llm.mixing import mixed_documents
from loomwright.llm.near_dup import Likeness, keep_one
from loomwright.llm.pieces import default_model, digests
from loomwright.llm.quality_rules import apply_rules

#: Five words and a resemblance of 0.8; 13 shared values lie over five standard errors below it.
NEAR = Likeness(words=5, percent=80, k=32, shared=13)


def quality_rules(spark, docs, sf_dir):
    """Documents that fail a rule, or come from a rejected host, go."""
    return apply_rules(docs)


def line_dedup(spark, docs, sf_dir):
    """Repeated lines go; documents of nothing but repeated lines go."""
    return dedup_lines(docs)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates, the smallest doc_id stays."""
    return keep_one(docs, NEAR)


def mixing(spark, docs, sf_dir):
    """Documents in as many copies as the mix takes."""
    return mixed_documents(docs)


def sentencepiece(spark, docs, sf_dir):
    """doc_id, n_tokens, digests of ids and decoded text, and the ids of every document."""
    return digests(docs, default_model(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Near-duplicate groups, tilted rates and the tokenizer have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of sf_dir.

    Stage tables go to the shared checkpoint folder. What a stage worked with goes once its table is
    written, a stage table once the next one is; the last one stays, as the result reads it.
    """
    docs, folder, last = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
