"""Hard negatives by dual-tree search: ball trees over anchors and over candidates, descended together.

Candidates are dealt into shards and anchors into blocks by a hash of their id; a task holds one shard and
one block and grows a forest of ball trees over each, one tree a label (small labels share one). A pair of
nodes bounds all inner products between them: with centres a, c and radii r, s they lie within
|a| s + |c| r + r s of a.c. A pair goes, with the whole group of anchors under it, if the labels of its
nodes rule each other out, if its upper bound lies under the least score that any anchor of the group still
needs, or if its lower bound lies over the largest score any of them may take. Leaf pairs that stay
are scored exactly, those of highest bound first, and what they find lifts the scores needed.

The search runs twice: once among rows of the anchor's label for its positives, and once among all other
rows, where each positive opens a window of scores [low % of its score, high % of its score].

Scores are integer inner products of floored vectors, computed in doubles (exact to 2^53). Bounds carry a
margin for rounding, and ties survive pruning, so results equal brute force.

Defined cases: rows with a null id or label, or whose vector is null, empty or holds a null or non-finite
component, take no part; an anchor meets vectors of its own length only. Rows with the anchor's id are not
candidates for it. Repeated rows are candidates each: as positives they are numbered apart and each gets
its negatives. A repeated anchor is one anchor. Anchors without positives, and positives whose window
nothing falls into, give no rows. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table
from .topk import _usable

#: Rows of a candidate shard and of an anchor block; a task holds one of each.
SHARD_ROWS, BLOCK_ROWS = 16384, 4096
CANDIDATE_LEAF, ANCHOR_LEAF = 256, 64
#: Label of a tree over several labels.
MIXED = np.iinfo(np.int64).min


class Forest:
    """Ball trees in flat arrays. `order` holds row numbers, node n covers order[start[n]:end[n]]; left[n] < 0 marks a leaf."""

    def __init__(self, x: np.ndarray, label: np.ndarray, leaf: int) -> None:
        by_label = np.argsort(label, kind="stable")
        found, count = np.unique(label, return_counts=True)
        own, ends = count >= leaf, np.cumsum(count)
        small = np.flatnonzero(np.isin(label, found[~own]))
        large = [by_label[ends[i] - count[i] : ends[i]] for i in np.flatnonzero(own)]
        groups = [*zip(large, found[own], strict=True), *([(small, found[~own][0] if (~own).sum() == 1 else MIXED)] if len(small) else [])]
        self.order = np.concatenate([g for g, _ in groups]) if groups else np.zeros(0, np.int64)
        start, end, tags, left, at = [], [], [], [], 0
        for rows, tag in groups:
            start.append(at)
            at += len(rows)
            end.append(at)
            tags.append(tag)
            left.append(-1)
        self.roots, n = np.arange(len(groups)), 0
        while n < len(start):
            a, b = start[n], end[n]
            if b - a > leaf:
                self.order[a:b] = self.order[a:b][self._along(x[self.order[a:b]])]
                mid = (a + b) // 2
                left[n] = len(start)
                start += [a, mid]
                end += [mid, b]
                tags += [tags[n]] * 2
                left += [-1, -1]
            n += 1
        self.start, self.end, self.tag, self.left = np.array(start, np.int64), np.array(end, np.int64), np.array(tags, np.int64), np.array(left, np.int64)
        parts = [x[self.order[a:b]] for a, b in zip(start, end, strict=True)]
        self.centre = np.stack([p.mean(0) for p in parts]) if parts else np.zeros((0, x.shape[1]))
        self.radius = np.array([np.sqrt(((p - c) ** 2).sum(1).max()) for p, c in zip(parts, self.centre, strict=True)])
        self.norm = np.sqrt((self.centre**2).sum(1))

    @staticmethod
    def _along(x: np.ndarray) -> np.ndarray:
        """Rows in order of their place between two far points."""
        a = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
        b = x[((x - a) ** 2).sum(1).argmax()]
        return np.argsort(x @ (b - a), kind="stable")

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.end[node]]

    def over(self, value: np.ndarray, least: bool) -> np.ndarray:
        """Least or largest value among the rows of each node."""
        op = np.minimum if least else np.maximum
        return np.array([op.reduce(value[self.rows(n)]) for n in range(len(self.start))])


class Slots:
    """k best (score, id) of every anchor in each of its score windows [low, high]."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.score, self.id = np.full((*low.shape, k), -np.inf), np.zeros((*low.shape, k), np.int64)

    def needed(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Least score by which each anchor could still gain; a tie may have the smaller id."""
        return np.maximum(self.low[rows], self.score[rows, :, -1]).min(1, initial=np.inf)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for j in range(self.low.shape[1]):
            floor = np.maximum(self.low[rows, j], self.score[rows, j, -1])
            fit = np.where((score >= floor[:, None]) & (score <= self.high[rows, j][:, None]), score, -np.inf)
            if fit.shape[1] > self.k:
                fit = np.where(fit >= np.partition(fit, -self.k, axis=1)[:, -self.k][:, None], fit, -np.inf)
            r, c = np.nonzero(fit > -np.inf)
            if len(r):
                touched = np.unique(r)
                who = np.concatenate([r, np.repeat(touched, self.k)])
                s = np.concatenate([fit[r, c], self.score[rows[touched], j].ravel()])
                i = np.concatenate([ids[c], self.id[rows[touched], j].ravel()])
                order = np.lexsort((i, -s, who))
                who, s, i = who[order], s[order], i[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                top = place < self.k
                self.score[rows[who[top]], j, place[top]], self.id[rows[who[top]], j, place[top]] = s[top], i[top]


def search(x, ids, labels, a, a_ids, a_labels, slots: Slots, same: bool) -> Slots:
    """Fills slots with the best rows of x for each row of a, among rows of the same label or of all others."""
    cand, anch = Forest(x, labels, CANDIDATE_LEAF), Forest(a, a_labels, ANCHOR_LEAF)
    most = anch.over(slots.high.max(1, initial=-np.inf), least=False)

    def meet(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether labels let anything under the two nodes meet."""
        plain = (anch.tag[n] != MIXED) & (cand.tag[m] != MIXED)
        return ~plain | ((anch.tag[n] == cand.tag[m]) == same)

    def bounds(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid = np.einsum("ij,ij->i", anch.centre[n], cand.centre[m])
        slack = anch.norm[n] * cand.radius[m] + cand.norm[m] * anch.radius[n] + anch.radius[n] * cand.radius[m]
        slack += 1e-9 * (np.abs(mid) + slack + 1) + 1e-6
        return mid - slack, mid + slack

    def score(n: int, m: int) -> None:
        r, c = anch.rows(n), cand.rows(m)
        s = a[r] @ x[c].T
        s[((a_labels[r][:, None] == labels[c][None, :]) != same) | (a_ids[r][:, None] == ids[c][None, :])] = -np.inf
        slots.offer(r, s, ids[c])

    a_leaves, c_leaves = np.flatnonzero(anch.left < 0), np.flatnonzero(cand.left < 0)
    first: dict[int, int] = {}
    for n in a_leaves:  # one promising leaf each, for scores to prune by
        m = c_leaves[meet(np.full(len(c_leaves), n), c_leaves)]
        if len(m):
            low, high = bounds(np.full(len(m), n), m)
            first[n] = m[np.where(low <= most[n], high, -np.inf).argmax()]
            score(n, first[n])
    need = anch.over(slots.needed(), least=True)
    n, m = np.repeat(anch.roots, len(cand.roots)), np.tile(cand.roots, len(anch.roots))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(n):
        low, high = bounds(n, m)
        live = meet(n, m) & (high >= need[n]) & (low <= most[n])
        n, m, high = n[live], m[live], high[live]
        ends = (anch.left[n] < 0) & (cand.left[m] < 0)
        done.append((n[ends], m[ends], high[ends]))
        n, m = n[~ends], m[~ends]
        by_anchor = (cand.left[m] < 0) | ((anch.left[n] >= 0) & (anch.radius[n] > cand.radius[m]))
        n1, m1, n2, m2 = n[by_anchor], m[by_anchor], n[~by_anchor], m[~by_anchor]
        n = np.concatenate([anch.left[n1], anch.left[n1] + 1, n2, n2])
        m = np.concatenate([m1, m1, cand.left[m2], cand.left[m2] + 1])
    if done:
        n, m, high = (np.concatenate(p) for p in zip(*done, strict=True))
        order = np.lexsort((-high, n))
        for k in order:
            if high[k] >= slots.needed(anch.rows(n[k])).min() and first.get(n[k]) != m[k]:
                score(n[k], m[k])
    return slots


def _tiles(x: DataFrame, anchors: DataFrame, shards: int, blocks: int, k: int, same: bool) -> DataFrame:
    """key, slot, id, score: what each tile of a shard and a block finds. anchors carry arrays low and high."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    left = x.select("dim", place("shard", shards).alias("shard"), every(blocks).alias("block"), "id", "label", "v").groupBy("dim", "shard", "block")
    right = anchors.select("dim", every(shards).alias("shard"), place("block", blocks).alias("block"), "key", "id", "label", "v", "low", "high").groupBy("dim", "shard", "block")

    def run(cands, anchs):
        import pandas as pd

        if not len(cands) or not len(anchs):
            return pd.DataFrame({"key": pd.Series(dtype="int64"), "slot": pd.Series(dtype="int32"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        width = max(map(len, anchs["low"]))
        pad = lambda c, v: np.array([[*y, *[v] * (width - len(y))] for y in anchs[c]], np.float64).reshape(len(anchs), width)
        slots = search(np.stack(cands["v"]), cands["id"].to_numpy(), cands["label"].to_numpy(), np.stack(anchs["v"]), anchs["id"].to_numpy(), anchs["label"].to_numpy(), Slots(pad("low", np.inf), pad("high", -np.inf), k), same)
        r, j, p = np.nonzero(slots.score > -np.inf)
        return pd.DataFrame({"key": anchs["key"].to_numpy()[r], "slot": j.astype("int32"), "id": slots.id[r, j, p], "score": slots.score[r, j, p].astype("int64")})

    found = left.cogroup(right).applyInPandas(run, "key long, slot int, id long, score long")
    order = Window.partitionBy("key", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, ident: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: float | None = None, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    is_anchor: condition on the columns of rows. scale: components become floor(scale * x) first; without it they have to be whole numbers. The
    negatives of a positive of score p are the best rows of other labels with low * p <= 100 * score <= high * p.
    """
    work = Scratch(rows.sparkSession)
    tagged = rows.withColumns({"_label": (F.col(label) if isinstance(label, str) else label).cast("long"), "_anchor": F.coalesce(is_anchor, F.lit(False))})
    x = work.cut(_usable(tagged.where("_label is not null"), ident, vector, scale, "_label", "_anchor").select("id", "v", F.col("_label").alias("label"), F.col("_anchor").alias("anchor"), F.size("v").alias("dim")))
    anchors = work.cut(x.where("anchor").select("id", "v", "label", "dim").distinct().withColumn("key", F.xxhash64("id", "label", "v")))
    shards, blocks = max(1, -(-x.count() // shard_rows)), max(1, -(-anchors.count() // block_rows))
    free = anchors.withColumns({"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))})
    best = _tiles(x, free, shards, blocks, positives, same=True).select("key", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = work.cut(best)
    per_key = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))
    down = lambda v: (v - F.pmod(v, F.lit(100))) / 100
    windows = anchors.join(per_key, "key").withColumns({"low": F.transform("p", lambda p: -down(-low * p["positive_score"])), "high": F.transform("p", lambda p: down(high * p["positive_score"]))})
    worst = _tiles(x, windows, shards, blocks, negatives, same=False)
    out = worst.withColumn("slot", F.col("slot") + 1).alias("n").join(best.withColumnRenamed("rank", "slot"), ["key", "slot"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", F.col("slot").alias("positive_rank"), "rank", F.col("n.id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label=label, scale=256.0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS a_label, c.vec_id, c.label, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT * FROM (SELECT anchor_id, a_label, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE label = a_label) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.place AS positive_rank, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.a_label AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(positive_rank AS INT) AS positive_rank, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
