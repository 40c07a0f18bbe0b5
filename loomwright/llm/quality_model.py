"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, in Arrow batches, into a narrow table. The trees
are fitted on the driver from at most `max_rows` labelled rows (the smallest hashes of doc_id, a
documented bound), flattened into arrays of complete binary trees, and every document is scored by
walking all trees with numpy, a level at a time.

Defined cases: null and empty texts have all statistics 0 and get a score. Very long texts are counted
whole, one at a time. Labels that are null are
ignored, several labels of one document count as their mean. Without usable labels, or with labels
of one kind, the score is their smoothed mean. A null doc_id is scored and never learnt from.
Repeated rows are scored one by one; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read_table

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "stop", "bang", "pipe", "line_breaks", "high_bytes",
    "distinct_words", "top_word", "same_as_previous", "entropy", "log_lines", "line_bytes", "dup_lines", "quote", "other_punct",
)
_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "symbol": b"#*$%&<>@^~=+_\\{}[]", "stop": b".,;:?",
    "bang": b"!", "pipe": b"|", "line_breaks": b"\n", "high_bytes": bytes(range(128, 256)), "quote": b"\"'`", "other_punct": b"()/-",
}
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


def statistics(text: str | None) -> list[float]:
    """Values of FEATURES for one text."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    n, counts = len(raw), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = {k: float(counts[m].sum()) for k, m in _MASKS.items()}
    p = counts[counts > 0] / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, seen = max(1, len(words)), Counter(words)
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / w, of["upper"] / max(1.0, of["upper"] + of["lower"]),
        *(of[k] / n for k in ("digit", "symbol", "stop", "bang", "pipe", "line_breaks", "high_bytes")),
        len(seen) / w, max(seen.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, float(-(p * np.log2(p)).sum()),
        math.log1p(len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), of["quote"] / n, of["other_punct"] / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES (float) of docs(doc_id, text)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} float" for c in FEATURES)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column("text")], np.float32).reshape(-1, len(FEATURES))
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x[:, j].copy()) for j in range(x.shape[1]))], ["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Forest:
    """Complete binary trees: feature and threshold by inner node, value by leaf, in heap order."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        depth = int(math.log2(self.value.shape[1])) if self.value.size else 0
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int32)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, min_rows: int = 20) -> Forest:
    """Newton boosting of the log loss on binned features, a level of all nodes at a time."""
    n, inner = len(x), 2**depth - 1
    mean = (float(y.sum()) + 1) / (n + 2)
    empty = Forest(np.zeros((0, inner), np.int32), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), math.log(mean / (1 - mean)))
    if n < 2 * min_rows or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin > k as x > edge k
    raw, out = np.full(n, empty.bias), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold, cut_at = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32), np.full(inner, bins, np.int64)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (at - first) * bins + binned[:, j]
                sg, sh, sc = (np.bincount(cell, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h, None))
                tg, th, tc = sg[:, -1:], sh[:, -1:], sc[:, -1:]
                gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                gain[(sc < min_rows) | (tc - sc < min_rows)] = -1
                gain = gain[:, : len(e)]
                k = gain.argmax(1)
                for node in np.flatnonzero(gain[np.arange(width), k] > best):
                    best[node] = gain[node, k[node]]
                    feature[first + node], threshold[first + node], cut_at[first + node] = j, e[k[node]], k[node]
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut_at[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        raw += value[leaf]
        for o, v in zip(out, (feature, threshold, value), strict=True):
            o.append(v)
    return Forest(*(np.stack(o) for o in out), empty.bias)


def learn(stats: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, **options) -> Forest:
    """A forest from at most max_rows labelled rows, those of the smallest hash of doc_id.

    The labelled rows are counted first, so that only those under a hash that about 1.2 times max_rows
    lie below leave their tasks. Rows of equal hash (one id) are ordered by their statistics.
    """
    told = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("_y"))
    rows = stats.join(told, "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    share = 1.2 * (max_rows + 1000) / max(1, told.count())
    if share < 1:
        near = rows.where(F.col("_h") < F.lit(int(-(2.0**63) + share * 2.0**64)))
        # Labels without documents, or documents in many rows, change what lies below.
        rows = near if near.limit(max_rows).count() == max_rows else rows
    rows = rows.orderBy("_h", "doc_id", *FEATURES).limit(max_rows).select("_y", *FEATURES).toPandas()
    y = rows.pop("_y").to_numpy(np.float64)
    return fit(rows.to_numpy(np.float32), y, **options)


def score_documents(stats: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score of every row of stats."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], 1)
            yield pa.record_batch([b.column("doc_id"), pa.array(forest.score(x), pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: str = "doc_id"):
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    stats = Scratch(spark).cut(document_statistics(read_table(spark, sf_dir, "documents")))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    scored = score_documents(stats, learn(stats, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
