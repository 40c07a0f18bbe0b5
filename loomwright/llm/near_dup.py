"""MinHash near-duplicates: bottom-k sketches, inverted lists, union-sketch estimate, exact Jaccard.

One hash function gives each shingle a 64-bit value; a document's sketch is its k smallest values
(all, if it has fewer). Documents of equal sets collapse first. Sketch values held by several
distinct sets form the inverted lists. A set needs to enter only the lists of its rarest values:
two sketches that must share t of their values share one among the first k - t + 1 of either, in one
order for all, here by list length. So common passages make no long lists of unlike documents.
Overlapping sets pass on if the sketch of their union estimates enough resemblance, with a margin
of over five standard errors, and are then compared on their full shingle sets.

Full sets are made of documents that an estimate let pass, for each round of pairs anew, so only
those texts move. Pairs never come from whole lists (see links.py).

Defined cases: null and blank texts have an empty set and are linked with nothing; fewer words than
a shingle has make one shingle of the whole sequence. Texts of any length are hashed whole. Repeated
rows are one document, and rows of one doc_id with several texts are one node of the graph: what any
of them resembles is in its component, as it is reachable through that id. Of equal lists or weights
the smaller id is the hub. Rows of null doc_id stay alone and are kept. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, likely_in, read_table
from .links import link_groups

#: Odd multipliers of the shingle hash.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: Words whose hash a task remembers.
WORDS_KEPT = 300_000


@dataclass(frozen=True)
class Likeness:
    words: int = 3
    #: Linked if 100 * intersection >= percent * union.
    percent: int = 85
    k: int = 32
    #: Sketch values that linked sets share at least (beyond five standard errors at `percent`).
    shared: int = 16

    @property
    def whole(self) -> int:
        """Sets up to this size can only be linked with sets that fit a sketch."""
        return self.k * self.percent // 100


class _Hasher:
    def __init__(self, words: int) -> None:
        import xxhash

        self.n, self.seen, self.digest = words, {}, xxhash.xxh64_intdigest

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct int64 shingle hashes. Words end at space and \\t..\\r; A-Z are lower-cased."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.int64)
        seen = self.seen
        if len(seen) > WORDS_KEPT:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self.digest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        if len(words) < self.n:
            out = np.array([self.digest(b" ".join(words), seed=len(words))], np.uint64)
        else:
            m = len(words) - self.n + 1
            out = np.zeros(m, np.uint64)
            for i in range(self.n):
                out = (out ^ h[i : i + m]) * _MIX[i % 3]
                out ^= out >> np.uint64(29)
            out *= _MIX[1]
            out ^= out >> np.uint64(32)
        return np.unique(out.view(np.int64))


def sketches(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128 bits that stand for the set), sketch (ascending)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        hasher = _Hasher(like.words)
        for b in batches:
            n, keys, flat = [], [], []
            for t in b.column("text"):
                s = hasher.shingles(t.as_py())
                n.append(len(s))
                raw = s.tobytes()
                keys.append((xxhash.xxh64_intdigest(raw, seed=1), xxhash.xxh64_intdigest(raw, seed=2)))
                flat.append(s[: like.k])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64))
            a, c = (np.array([x[i] for x in keys], np.uint64).view(np.int64) for i in (0, 1))
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(c), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "n_shingles", "set_a", "set_b", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>")


def full_sets(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """id, shingles (all values) of docs(id, text)."""

    def run(batches):
        import pyarrow as pa

        hasher = _Hasher(like.words)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                flat = [hasher.shingles(t.as_py()) for t in part.column("text")]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))], ["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def _lists(sets: DataFrame, like: Likeness) -> DataFrame:
    """Postings key, id, weight, n of the rarest values of each set that other sets hold too."""
    values = sets.select(F.explode("sketch").alias("key"), F.col("rep").alias("id"), "set_a")
    common = values.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(common, "key").groupBy("id", "set_a").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("held"), F.sum("df").alias("weight"))
    sized = sets.select(F.col("rep").alias("id"), "set_a", F.col("n_shingles").alias("n"), F.size("sketch").alias("m"))
    joined = shared.join(sized, ["id", "set_a"])
    needed = F.when(F.col("n") <= like.whole, F.ceil(F.col("n") * (like.percent / 100.0))).otherwise(F.lit(like.shared))
    # Values no other set holds come first in the order and use up the prefix.
    room = F.greatest(F.lit(0), F.col("m") - needed + 1 - (F.col("m") - F.size("held"))).cast("int")
    return joined.select("id", "n", F.col("weight").cast("double").alias("weight"), F.explode(F.slice("held", F.lit(1), room)).alias("x")).select(F.col("x.key").alias("key"), "id", "weight", "n")


def near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    work = Scratch(docs.sparkSession)
    rows = work.cut(sketches(docs, like))
    full = rows.where("n_shingles > 0 and doc_id is not null")
    sets = work.cut(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    first = work.cut(_lists(sets, like))
    several = first.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    lists = work.cut(first.join(several, "key"))
    work.drop(first)
    known = sets.select(F.col("rep").alias("id"), "sketch")

    def sets_of(ids: DataFrame) -> DataFrame:
        """Full sets of some documents; the texts of others are left where they are."""
        texts = likely_in(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), F.col("id"), ids, F.col("id"))
        return work.cut(full_sets(texts.join(ids, "id"), like))

    def both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        a, b = (table.select(F.col("id").alias(s), F.col(column).alias(f"{column}_{s}")) for s in ("a", "b"))
        return pairs.join(b, "b").join(a, "a")

    def verify(pairs: DataFrame) -> DataFrame:
        met = both(pairs, known, "sketch")
        union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, like.k)
        matches = F.size(F.array_intersect(F.col("union"), F.array_intersect("sketch_a", "sketch_b")))
        # Where both sketches are whole sets smaller than k the estimate is exact; the margin only widens it.
        passed = met.withColumn("union", union).where(matches * like.k >= like.shared * F.size("union")).select("a", "b")
        passed = work.cut(passed)
        sure = both(passed, sets_of(passed.select(F.col("a").alias("id")).union(passed.select("b")).distinct()), "shingles")
        common = F.size(F.array_intersect("shingles_a", "shingles_b"))
        total = F.size("shingles_a") + F.size("shingles_b")
        return sure.where((100 + like.percent) * common >= like.percent * total).select("a", "b")

    def near(a: str, b: str):
        x, y = F.col(f"{a}n"), F.col(f"{b}n")
        return 100 * F.least(x, y) >= like.percent * F.greatest(x, y)

    def refine(seen: DataFrame) -> DataFrame:
        """inside: shingles of a set that its hub has too; outside: those that it lacks.

        Shingles that no other of these sets holds are in no overlap and left out, and so are sets
        that have too few others to be linked. An overlap is at most the smaller `inside` and what
        both have outside.
        """
        whole = sets_of(work.cut(seen.select("id").union(seen.select("hub")).distinct()))
        values = whole.select("id", F.explode("shingles").alias("v"))
        several = values.groupBy("v").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("v")
        held = values.join(several, "v", "left_semi").groupBy("id").agg(F.collect_list("v").alias("held"))
        sized = lists.groupBy("id").agg(F.min("n").alias("n"))
        held = held.join(sized, "id").where(100 * F.size("held") >= like.percent * F.col("n")).select("id", "held")
        met = seen.join(held, "id").join(whole.select(F.col("id").alias("hub"), "shingles"), "hub")
        return met.select("id", "hub", F.size(F.array_intersect("held", "shingles")).alias("inside"), F.array_except("held", "shingles").alias("outside"))

    def near_refined(a: str, b: str):
        enough = lambda common: (100 + like.percent) * common >= like.percent * (F.col(f"{a}n") + F.col(f"{b}n"))
        inside = F.least(F.col(f"{a}inside"), F.col(f"{b}inside"))
        most = F.least(F.size(f"{a}outside"), F.size(f"{b}outside"))
        return near(a, b) & enough(inside + most) & enough(inside + F.size(F.array_intersect(f"{a}outside", f"{b}outside")))

    groups = link_groups(work, lists, verify, near, ["n"], refine=refine, near_refined=near_refined)
    named = sets.join(groups, sets["rep"] == groups["id"], "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = full.join(named, ["set_a", "set_b"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return work.finish(out.unionByName(alone))


def keep_one(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The documents without those that have a smaller doc_id in their group; columns unchanged.

    Rows that share a doc_id are one document and stay or go together.
    """
    found = near_duplicates(docs, like)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_nd_id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["_nd_id"], "left_anti")
    return kept


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) END) AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS g FROM s),
-- For 85 %, two sets share a shingle among the first 15 % (and one) of either in one order for all; the rarest come first.
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
r AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM e JOIN f USING (g)
), p AS (SELECT doc_id, g, n FROM r WHERE k <= n - ceil(0.85 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
i AS (SELECT c.a, c.b, x.s AS xs, y.s AS ys, len(list_intersect(x.s, y.s)) AS n FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b),
l AS (SELECT a, b FROM i WHERE 100 * n >= 85 * (len(xs) + len(ys) - n)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)
"""


def oracle_sql() -> str:
    """Groups by recursion from every document; fine for the small tables the SQL is meant for."""
    return "WITH RECURSIVE " + OP2_SQL.strip()[5:] + r""",
reach(doc_id, x) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, b.b FROM reach r JOIN both_ways b ON b.a = r.x),
m AS (SELECT doc_id, min(x) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m USING (doc_id)
"""
