"""Keyword index on disk: blocks of postings by impact, with bounds, and exact top-k that skips what cannot win.

A score is a sum of whole weights (hundredths of the band weights), one for each asked term that a chunk
holds. Chunks are dealt into slices by a hash, so a common term's list is many lists, each of one slice. A list is
cut into blocks of BLOCK postings in descending weight; a block's first weight bounds the rest of it.

An answer takes three steps, for all questions at once.

1. The first postings of each asked list seed a few chunks, whose full scores give each question a floor: the
   score of its k-th best seed.
2. In each slice, a question's terms are ordered by the largest weight in their lists. Terms whose largest
   weights sum to less than the floor cannot lift a chunk over it by themselves: chunks that hold only
   such terms are never looked at. Of the other terms, a posting counts only if its weight and the
   largest weights of all other terms reach the floor; as blocks bound their postings, whole blocks drop
   out unread by the sum.
3. The chunks left are scored by the stored vector of their terms, and the k best stay.

So the answers are those of summing every posting (ties to the smaller id), and rows shuffled follow the
postings that could still win, not questions times chunks.

Questions that little can be skipped for - of many words, as whole texts are, or whose live postings are many beside
the chunks - have all chunks summed in tiles instead (`keyword_tiles`), which shuffles no pairs. If at least half of the
questions have many words, the tiles take the others too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.constants import BAND_WEIGHTS
from ..storage import Tables
from .keyword_tiles import best_in_shards, shards_of
from .retrieval import query_terms, query_words, ranked

BLOCK = 128
#: Folders of the stored blocks, by a hash of the term.
PARTS = 32
#: Words of a question, and its live postings for each chunk, above which its chunks are summed in tiles.
MANY_WORDS, MANY_LIVE = 16, 0.25


def term_weights(chunks: DataFrame, *, ident: str = "chunk_id", symbol: str = "symbol", content: str = "content") -> DataFrame:
    """(id, term, weight): symbol in band A, its parts in band B, body in band D; weights in hundredths."""
    terms = lambda c: text.identifiers(F.coalesce(c, F.lit("")))
    name = F.col(symbol)
    bands = {"A": terms(name), "B": terms(text.split_identifier(F.coalesce(name, F.lit("")))), "D": terms(F.col(content))}
    rows = F.array(*[F.struct(F.lit(round(BAND_WEIGHTS[b] * 100)).cast("long").alias("w"), t.alias("terms")) for b, t in bands.items()])
    flat = chunks.select(F.col(ident).alias("id"), F.inline(rows)).select("id", "w", F.explode("terms").alias("term"))
    return flat.groupBy("id", F.lower("term").alias("term")).agg(F.sum("w").alias("weight"))


def write(chunks: DataFrame, root: str, *, slices: int = 8, parts: int = PARTS, block: int = BLOCK, **columns: str) -> None:
    """Writes root/vectors/slice=... (id, terms) and root/blocks/part=... (slice, term, block, top, ids, weights).

    A slice of some 100,000 chunks keeps one list well inside a task. Texts move once, by id, and postings once, by
    part and slice; everything else happens where they are, and no step is made twice.
    """
    ident = columns.get("ident", "chunk_id")
    vectors = term_weights(chunks.repartition(ident), **columns).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    vectors = vectors.select("id", "terms", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"))
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("slice").parquet(f"{root}/vectors")
    back = chunks.sparkSession.read.schema(vectors.schema).parquet(f"{root}/vectors").select("slice", "id", F.explode("terms").alias("term", "weight"))
    dealt = back.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).repartition("part", "slice")
    # The term leads, as sorts compare the first column before all others.
    place = F.row_number().over(Window.partitionBy("term", "slice", "part").orderBy(F.col("weight").desc(), "id"))
    cut = dealt.withColumn("block", F.floor((place - 1) / block).cast("int")).groupBy("term", "slice", "part", "block")
    blocks = cut.agg(F.max("weight").alias("top"), F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "id"))).alias("p"))
    rows = blocks.select("slice", "term", "block", "top", F.col("p.id").alias("ids"), F.transform("p.w", lambda w: -w).alias("weights"), "part")
    rows.sortWithinPartitions("part", "term", "slice", "block").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(f"{root}/blocks")


class StoredIndex:
    """A written index, and the questions put to it. ident: type of the chunks' ids."""

    def __init__(self, spark, root: str, *, parts: int = PARTS, ident: str = "bigint") -> None:
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{root}/{name}")
        self.blocks = read("blocks", f"term string, block int, top bigint, ids array<{ident}>, weights array<bigint>, slice int, part int")
        self.vectors, self.parts = read("vectors", f"id {ident}, terms map<string, bigint>, slice int"), parts

    def _asked(self, queries: DataFrame) -> DataFrame:
        """query_id, part, term: the distinct content words of each question."""
        return query_terms(queries).select("query_id", F.pmod(F.xxhash64("term"), F.lit(self.parts)).cast("int").alias("part"), "term")

    def _scored(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """query_id, id, score of pairs(query_id, slice, id), from the stored vectors."""
        words = asked.groupBy("query_id").agg(F.collect_list("term").alias("words"))
        met = pairs.join(self.vectors, ["slice", "id"]).join(words, "query_id")
        return met.select("query_id", "id", F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.coalesce(F.try_element_at("terms", w), F.lit(0))).alias("score"))

    def floors(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, floor: a score that the k-th best chunk reaches; 0 where the seeds are fewer."""
        asked, n = self._asked(queries), max(8, k)
        first = self.blocks.where("block = 0").select("part", "term", "slice", F.slice("ids", 1, n).alias("ids"), F.slice("weights", 1, n).alias("weights"))
        seeds = asked.join(first, ["part", "term"]).select("query_id", "slice", F.inline(F.arrays_zip("ids", "weights")))
        partial = seeds.groupBy("query_id", "slice", F.col("ids").alias("id")).agg(F.sum("weights").alias("partial"))
        best = ranked(partial, [F.col("partial").desc(), F.col("id")], 2 * k).select("query_id", "slice", "id")
        kth = ranked(self._scored(best, asked), [F.col("score").desc(), F.col("id")], k).where(F.col("rank") == k)
        return kth.select("query_id", F.col("score").alias("floor"))

    def _live(self, queries: DataFrame, floors: DataFrame) -> DataFrame:
        """query_id, slice, least, ids, weights: blocks whose bound could still win."""
        tops = self.blocks.where("block = 0").select("part", "term", "slice", "top")
        met = self._asked(queries).join(tops, ["part", "term"]).join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
        terms = Window.partitionBy("query_id", "slice")
        upto = F.sum("top").over(terms.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0))
        open_ = met.withColumn("upto", upto).withColumn("others", F.sum("top").over(terms) - F.col("top")).where("upto >= floor")
        live = open_.select("query_id", "part", "term", "slice", (F.col("floor") - F.col("others")).alias("least"))
        read = self.blocks.select("part", "term", "slice", F.col("top").alias("bound"), "ids", "weights").join(live, ["part", "term", "slice"]).where("bound >= least")
        return read.select("query_id", "slice", "least", "ids", "weights")

    def candidates(self, queries: DataFrame, floors: DataFrame) -> DataFrame:
        """query_id, slice, id, with repeats: postings that could still win."""
        met = self._live(queries, floors).select("query_id", "slice", "least", F.inline(F.arrays_zip("ids", "weights")))
        return met.where("weights >= least").select("query_id", "slice", F.col("ids").alias("id"))

    def _tiled(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, id, score, with every stored vector looked at."""
        chars = self.vectors.agg(F.sum(F.size("terms")) * 12).first()[0]
        rows = self.vectors.select("id", F.map_values("terms").alias("w"), F.array_join(F.map_keys("terms"), " ").alias("words"))
        found = best_in_shards(rows, query_words(queries), k, ["id"], shards_of(chars))
        return ranked(found.withColumnRenamed("total", "score"), [F.col("score").desc(), F.col("id")], k).select("query_id", "rank", "id", "score")

    def top_k(self, queries: DataFrame, k: int = 50, *, floors: DataFrame | None = None) -> DataFrame:
        """query_id, rank, id, score of the k best chunks of queries(query_id, query); a chunk with no asked word has none."""
        tables = Tables(queries.sparkSession, "asked")
        queries = tables.cut(queries.select("query_id", "query"))
        some = lambda kept, how: queries.join(kept, "query_id", how)
        wide = self._asked(queries).groupBy("query_id").count().where(F.col("count") > MANY_WORDS).select("query_id")
        short, tops = some(wide, "left_anti"), []
        n_wide = wide.count()
        if n_wide and queries.count() <= 2 * n_wide:  # The tiles read all vectors anyway, so they take the short ones along.
            wide, short = queries.select("query_id").distinct(), queries.limit(0)
        if not short.isEmpty():
            floors = tables.cut(self.floors(short, k) if floors is None else floors)
            most = MANY_LIVE * self.vectors.count()
            live = self._live(short, floors).groupBy("query_id").agg(F.sum(F.size("ids")).alias("n"))
            heavy = tables.cut(live.where(F.col("n") > most).select("query_id"))
            wide = wide.unionByName(heavy)
            short = some(wide, "left_anti")
            pairs = self.candidates(short, floors).distinct()
            tops.append(ranked(self._scored(pairs, self._asked(short)), [F.col("score").desc(), F.col("id")], k).select("query_id", "rank", "id", "score"))
        rest = some(wide, "left_semi")
        if not tops or not rest.isEmpty():
            tops.append(self._tiled(rest, k))
        top = tops[0] if len(tops) == 1 else tops[0].unionByName(tops[1])
        return top.select("query_id", "rank", "id", (F.col("score") / 100).alias("score"))

    def effort(self, queries: DataFrame, floors: DataFrame) -> DataFrame:
        """listed: postings of all asked lists; looked_at: those that could still win. One row."""
        n = F.size("ids")
        listed = self._asked(queries).join(self.blocks.select("part", "term", n.alias("n")), ["part", "term"]).agg(F.sum("n").alias("listed"))
        return listed.crossJoin(self.candidates(queries, floors).agg(F.count(F.lit(1)).alias("looked_at")))
