"""Exact top-k by inner product: ball trees in shards, branch and bound.

Vectors are dealt into shards of bounded size by a hash of their id, queries into blocks; a task
holds one shard and one block. A shard's tree halves its vectors at the median along the axis between two
far points; the bound of a node is q.centre + |q| * radius. First every query dives into the best
leaf of every shard, and the largest of the shards' k-th scores becomes its floor. Then each shard
is searched level by level: nodes whose bound lies under the floor go, leaves are visited in order
of their bounds, and the k-th score found so far lifts the floor further.

Scores are integer inner products of floored vectors, computed in doubles (exact to 2^53). Bounds
carry a margin for rounding, and ties survive pruning, so results equal brute force.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; a
query meets candidates of its own length only. Equal ids are one vector's: none of them is a
candidate for a query of that id. Repeated rows are candidates each, so their score appears as often; a
repeated query is one query. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table

LEAF, SHARD_ROWS, BLOCK_ROWS = 32, 2048, 1024


class BallTree:
    """Complete binary tree of balls over the rows of x; leaves are slices of `order`."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x = x
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x) / leaf)))))
        parts = [np.arange(len(x))]
        self.centre, self.radius = [], []
        for level in range(self.depth + 1):
            centre = np.stack([x[p].mean(0) if len(p) else np.zeros(x.shape[1]) for p in parts])
            self.centre.append(centre)
            self.radius.append(np.array([np.sqrt(((x[p] - c) ** 2).sum(1).max()) if len(p) else -np.inf for p, c in zip(parts, centre, strict=True)]))
            if level < self.depth:
                parts = [h for p, c in zip(parts, centre, strict=True) for h in self._halves(p, c)]
        self.leaves = parts

    def _halves(self, p: np.ndarray, centre: np.ndarray) -> list[np.ndarray]:
        if len(p) < 2:
            return [p, p[:0]]
        x = self.x[p]
        a = x[((x - centre) ** 2).sum(1).argmax()]
        b = x[((x - a) ** 2).sum(1).argmax()]
        order = np.argsort(x @ (b - a), kind="stable")
        return [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]

    def bound(self, level: int, node: np.ndarray, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        r = self.radius[level][node]
        b = np.einsum("ij,ij->i", q, self.centre[level][node]) + norm * np.where(r < 0, 0, r)
        return np.where(r < 0, -np.inf, b + 1e-9 * (np.abs(b) + 1) + 1e-6)

    def dive(self, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Leaf that each query reaches by taking the child of larger bound."""
        node = np.zeros(len(q), np.int64)
        for level in range(1, self.depth + 1):
            left = self.bound(level, 2 * node, q, norm) >= self.bound(level, 2 * node + 1, q, norm)
            node = 2 * node + ~left
        return node


class _Best:
    """k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id, self.k = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), k

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.hstack([self.score[rows], score]), np.hstack([self.id[rows], np.broadcast_to(ids, score.shape)])
        pick = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)


def _offer_leaf(tree, ids, best, leaf, rows, q, qid) -> None:
    members = tree.leaves[leaf]
    if len(members):
        score = q[rows] @ tree.x[members].T
        score[qid[rows][:, None] == ids[members][None, :]] = -np.inf
        best.offer(rows, score, ids[members])


def search(x, ids, q, qid, k: int, floor=None) -> _Best:
    """k best of x for each query. Without a floor only the best leaf is seen (a lower bound)."""
    tree, norm, best = BallTree(x), np.sqrt((q**2).sum(1)), _Best(len(q), k)
    first = tree.dive(q, norm)
    for leaf in np.unique(first):
        _offer_leaf(tree, ids, best, leaf, np.flatnonzero(first == leaf), q, qid)
    if floor is None:
        return best
    limit = lambda rows: np.maximum(floor[rows], best.score[rows, -1])
    rows, node = np.arange(len(q)), np.zeros(len(q), np.int64)
    bound = tree.bound(0, node, q, norm)
    for level in range(tree.depth + 1):
        if level:
            rows, node = np.repeat(rows, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
            bound = tree.bound(level, node, q[rows], norm[rows])
        live = bound >= limit(rows)
        rows, node, bound = rows[live], node[live], bound[live]
    todo = node != first[rows]
    rows, node, bound = rows[todo], node[todo], bound[todo]
    order = np.lexsort((-bound, rows))
    rows, node, bound = rows[order], node[order], bound[order]
    turn = np.arange(len(rows)) - np.searchsorted(rows, rows)  # place of a leaf in its query's order
    for t in range(turn.max(initial=-1) + 1):
        now = turn == t
        r, n = rows[now], node[now]
        live = bound[now] >= limit(r)
        r, n = r[live], n[live]
        for leaf in np.unique(n):
            _offer_leaf(tree, ids, best, leaf, r[n == leaf], q, qid)
    return best


def _usable(df: DataFrame, ident: str, vector: str, scale: float | None, *more: str) -> DataFrame:
    v = F.col(vector)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    out = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")) if scale else F.transform(v, lambda x: x.cast("double"))
    return df.where(ok & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), out.alias("v"), *more)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, ident: str = "vec_id", vector: str = "embedding", scale: float | None = None, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query by (score desc, id).

    scale: components become floor(scale * x) first. Shards and blocks follow from the row counts.
    """
    work = Scratch(vectors.sparkSession)
    x = work.cut(_usable(vectors, ident, vector, scale).withColumn("dim", F.size("v")))
    q = work.cut(_usable(queries, ident, vector, scale).distinct().withColumn("dim", F.size("v")))
    shards, blocks = max(1, -(-x.count() // shard_rows)), max(1, -(-q.count() // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    x = x.select("dim", place("shard", shards).alias("shard"), every(blocks).alias("block"), "id", "v").groupBy("dim", "shard", "block")
    keyed = q.select("dim", "id", "v", place("block", blocks).alias("block"))

    def found(floors: bool):
        def run(left, right):
            import pandas as pd

            columns = ["query_id", "vec_id", "score"]
            if not len(left) or not len(right):
                return pd.DataFrame({c: pd.Series(dtype="int64" if c != "score" else "float64") for c in columns})
            qid = right["id"].to_numpy()
            best = search(np.stack(left["v"]), left["id"].to_numpy(), np.stack(right["v"]), qid, k, right["floor"].to_numpy(np.float64) if floors else None)
            if not floors:
                return pd.DataFrame({"query_id": qid, "vec_id": qid, "score": best.score[:, -1]})
            at = best.score > -np.inf
            return pd.DataFrame({"query_id": np.repeat(qid, at.sum(1)), "vec_id": best.id[at], "score": best.score[at]})

        return run

    def searched(queries: DataFrame, floors: bool) -> DataFrame:
        dealt = queries.withColumn("shard", every(shards)).groupBy("dim", "shard", "block")
        return x.cogroup(dealt).applyInPandas(found(floors), "query_id long, vec_id long, score double")

    low = F.lit(float("-inf"))
    floors = searched(keyed, False).groupBy("query_id").agg(F.max("score").alias("floor"))
    floored = keyed.join(floors, keyed["id"] == floors["query_id"], "left").select("dim", "id", "v", "block", F.coalesce("floor", low).alias("floor"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = searched(floored, True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op10_topk(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, scale=256.0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
