"""Dense, keyword and hybrid retrieval for a table of questions at once.

Ranks are columns; ties are broken by the chunk id, so results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..functions.constants import BAND_WEIGHTS, LEXICAL_WEIGHTS, PROSE_WEIGHTS, RRF_K
from .keyword_tiles import best_in_shards, shards_of

#: Chunks of a shard and questions of a block; a task compares one with the other, so many questions at a time.
SHARD_ROWS, QUERY_BLOCK, QUERY_PIECE = 16384, 2048, 64


def ranked(df: DataFrame, by: list[Column], k: int, *, partition: str | list[str] = "query_id", rank: str = "rank") -> DataFrame:
    """The k first rows of each partition, with their rank from 1. Spark trims each task before the shuffle."""
    keys = [partition] if isinstance(partition, str) else partition
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(rank) <= k)


def nearest(chunks: DataFrame, vector: list[float], k: int = 8, *, where: Column | None = None, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """k nearest chunks to one vector by cosine distance: a scan and a top-k heap in each task."""
    if k <= 0:
        return chunks.select(ident, F.lit(0.0).alias("distance")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in vector])
    rows = chunks if where is None else chunks.where(where)
    return rows.select(*rows.columns, scalar.cosine_distance(F.col(column), q).alias("distance")).orderBy("distance", ident).limit(k)


def nearest_batch(chunks: DataFrame, queries: DataFrame, k: int = 8, *, ident: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, ident, distance for queries(query_id, q): the k nearest by cosine distance, to 12 decimals.

    One plan whatever the number of questions: chunks are dealt into shards and questions into blocks by
    hash, and a task holds one of each, so a chunk moves once for each block of questions. Each tile is
    matrix products of QUERY_PIECE questions and gives k rows a question. Null vectors take no part; vectors of other lengths don't
    meet; a vector without length is farther than all others (NaN).
    """
    kinds = chunks.schema[ident].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kinds[1]}, {ident} {kinds[0]}, distance double"
    x = chunks.where(F.col(column).isNotNull()).select(F.col(ident).alias("i"), F.col(column).cast("array<double>").alias("v"), F.size(column).alias("dim"))
    q = queries.where("q IS NOT NULL").select("query_id", F.col("q").cast("array<double>").alias("q"), F.size("q").alias("dim"))
    shards, blocks = max(1, -(-x.count() // shard_rows)), max(1, -(-q.count() // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    left = x.select("dim", place("i", shards).alias("shard"), every(blocks).alias("block"), F.lit(0).alias("side"), none(kinds[1]).alias("query_id"), "i", "v")
    right = q.select("dim", every(shards).alias("shard"), place("query_id", blocks).alias("block"), F.lit(1).alias("side"), "query_id", none(kinds[0]).alias("i"), F.col("q").alias("v"))

    def tile(rows):
        import pyarrow.compute as pc

        return _nearest_of_tile(rows.filter(pc.equal(rows["side"], 0)).sort_by("i"), rows.filter(pc.equal(rows["side"], 1)), k, ident)

    return ranked(left.unionByName(right).repartition("dim", "shard", "block").groupBy("dim", "shard", "block").applyInArrow(tile, schema), [F.col("distance"), F.col(ident)], k)


def _nearest_of_tile(near, asked, k: int, ident: str):
    """Arrow table (query_id, ident, distance) of the k nearest of near(i, v), in order of i, to each of asked(query_id, v)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if k <= 0 or not len(asked) or not len(near):
        return pa.table({"query_id": asked["query_id"][:0], ident: near["i"][:0], "distance": pa.array([], pa.float64())})
    matrix = lambda t: pc.list_flatten(t["v"].combine_chunks()).to_numpy(zero_copy_only=False).reshape(len(t), -1)
    a, b = matrix(asked), matrix(near)
    size, tops, fars = np.sqrt((b * b).sum(1)), [], []
    for q in (a[i : i + QUERY_PIECE] for i in range(0, len(a), QUERY_PIECE)):
        with np.errstate(invalid="ignore", divide="ignore"):
            far = np.round(1 - (q @ b.T) / np.outer(np.sqrt((q * q).sum(1)), size), 12)
        top = np.argsort(far, axis=1, kind="stable")[:, :k].copy()  # equal distances stay in order of ident; a copy lets the rest go
        tops.append(top)
        fars.append(np.take_along_axis(far, top, 1))
    top, far = np.concatenate(tops), np.concatenate(fars)
    who = np.arange(len(asked)).repeat(top.shape[1])
    return pa.table({"query_id": asked["query_id"].take(pa.array(who)), ident: near["i"].take(pa.array(top.ravel())), "distance": pa.array(far.ravel())})


def postings(chunks: DataFrame, *, ident: str = "chunk_id", symbol: str = "symbol", content: str = "content") -> DataFrame:
    """(ident, term, band, tf): symbol in band A, split symbol in B, body in D."""
    bands = F.array(
        F.struct(F.lit("A").alias("band"), text.lower_all(text.identifiers(F.coalesce(symbol, F.lit("")))).alias("terms")),
        F.struct(F.lit("B").alias("band"), text.lower_all(text.identifiers(text.split_identifier(F.coalesce(symbol, F.lit(""))))).alias("terms")),
        F.struct(F.lit("D").alias("band"), text.lower_all(text.identifiers(F.coalesce(content, F.lit("")))).alias("terms")),
    )
    banded = chunks.select(ident, F.inline(bands))
    return banded.select(ident, "band", F.explode("terms").alias("term")).groupBy(ident, "term", "band").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of the content words of queries(query_id, query)."""
    return queries.select("query_id", F.explode(text.token_set(text.clean_query(F.col("query")))).alias("term"))


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, words): the content words of queries(query_id, query), parted by spaces."""
    return queries.select("query_id", F.lower(text.clean_query(F.col("query"))).alias("words"))


def _keyword_ranks(docs: DataFrame, chars: int | None, queries: DataFrame, k: int, ident: str) -> DataFrame:
    """Ranks of docs(ident, w in hundredths, words) of so many characters."""
    found = best_in_shards(docs, query_words(queries), k, [ident], shards_of(chars))
    top = ranked(found.withColumn("score", F.col("total") / 100).drop("total"), [F.col("score").desc(), F.col(ident)], k)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return top.select("query_id", ident, "score", "rank").withColumn("distance", scalar.relative_distance(F.col("score"), best))


def keyword_rank(index: DataFrame, queries: DataFrame, k: int = 50, *, ident: str = "chunk_id") -> DataFrame:
    """query_id, rank, ident, score, distance over stored postings. Any matching term qualifies; score sums tf x band weight."""
    if k <= 0:
        return _no_ranks(index, queries, ident)
    weight = F.element_at(F.create_map(*[x for b, w in BAND_WEIGHTS.items() for x in (F.lit(b), F.lit(round(w * 100)))]), F.col("band"))
    chars = index.agg(F.sum(F.length("term") + 8)).first()[0]
    return _keyword_ranks(index.select(ident, (F.col("tf") * weight).alias("w"), F.col("term").alias("words")), chars, queries, k, ident)


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int = 50, *, ident: str = "chunk_id", symbol: str = "symbol", content: str = "content") -> DataFrame:
    """The same as `keyword_rank` over the postings of chunks, without making them: texts move once for each block of questions."""
    if k <= 0:
        return _no_ranks(chunks, queries, ident)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    spelt = {"A": blank(symbol), "B": text.split_identifier(blank(symbol)), "D": blank(content)}
    rows = F.array(*[F.struct(F.lit(round(BAND_WEIGHTS[b] * 100)).alias("w"), F.lower(F.array_join(text.identifiers(c), " ")).alias("words")) for b, c in spelt.items()])
    chars = chunks.agg(F.sum(F.length(blank(content)) + 64)).first()[0]
    return _keyword_ranks(chunks.select(ident, F.inline(rows)), chars, queries, k, ident)


def _no_ranks(chunks: DataFrame, queries: DataFrame, ident: str) -> DataFrame:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return chunks.sparkSession.createDataFrame([], f"query_id {kind(queries, 'query_id')}, {ident} {kind(chunks, ident)}, score double, rank int, distance double")


def fuse(lanes: DataFrame, *, ident: str = "chunk_id", k_constant: int = RRF_K, limit: int = 50) -> DataFrame:
    """query_id, rank, ident, score, distance of lanes(query_id, lane, rank, ident, weight).

    Ties follow the first lane that saw the chunk, then its rank there.
    """
    term = scalar.rrf_term(F.col("weight"), F.col("rank") - 1, k_constant)
    once = lanes.groupBy("query_id", "lane", ident).agg(F.min("rank").alias("rank"), F.first("weight").alias("weight"))
    summed = once.groupBy("query_id", ident).agg(F.sum(term).alias("score"), F.min(F.struct("lane", "rank")).alias("first"))
    out = ranked(summed, [F.col("score").desc(), F.col("first"), F.col(ident)], limit)
    return out.withColumn("distance", scalar.fused_distance(F.col("score"))).drop("first")


def representative(lanes: DataFrame, *, ident: str = "chunk_id") -> DataFrame:
    """One hit for each chunk: the first, or the first with a symbol if that lacks one."""
    return lanes.groupBy("query_id", ident).agg(F.min_by("symbol", F.struct(F.col("symbol").isNull().alias("bare"), "lane", "rank")).alias("symbol"))


def lane_weights(queries: DataFrame) -> DataFrame:
    """Adds dense_weight and sparse_weight by whether a query spells an identifier."""
    lexical = text.looks_lexical(F.col("query"))
    pick = lambda i: F.when(lexical, F.lit(LEXICAL_WEIGHTS[i])).otherwise(F.lit(PROSE_WEIGHTS[i]))
    return queries.withColumn("dense_weight", pick(0)).withColumn("sparse_weight", pick(1))


def hybrid(dense: DataFrame, sparse: DataFrame, queries: DataFrame, *, ident: str = "chunk_id", recall: int = 50, k_constant: int = RRF_K) -> DataFrame:
    """Weighted fusion of two ranked lanes, with routed weights."""
    weights = lane_weights(queries).select("query_id", "dense_weight", "sparse_weight")
    lane = lambda df, n, w: df.select("query_id", F.lit(n).alias("lane"), "rank", ident).join(weights, "query_id").select("query_id", "lane", "rank", ident, F.col(w).alias("weight"))
    return fuse(lane(dense, 0, "dense_weight").unionByName(lane(sparse, 1, "sparse_weight")), ident=ident, k_constant=k_constant, limit=recall)


def with_retry(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """Filtered results, and unfiltered ones of the questions that got none."""
    missing = unfiltered.join(filtered.select("query_id").distinct(), "query_id", "left_anti")
    return filtered.unionByName(missing)


def read_refs(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of refs(pos, file_path, start_line, end_line): repeats kept, missing ones dropped; order by pos."""
    return refs.join(chunks, ["file_path", "start_line", "end_line"])


def keyword_overlap(chunks: DataFrame, queries: DataFrame, k: int = 3, *, ident: str = "chunk_id", content: str = "content", order: list[str] | None = None) -> DataFrame:
    """query_id, rank, ident, overlap: most shared words of two letters or more."""
    order = order or [ident]
    keys = list(dict.fromkeys([*order, ident]))
    spelt = lambda c: F.array_join(text.token_set(F.col(c), "[A-Za-z_][A-Za-z0-9_]+"), " ").alias("words")
    chars = chunks.agg(F.sum(F.length(content) + 16)).first()[0]
    found = best_in_shards(chunks.select(*keys, F.lit(1).alias("w"), spelt(content)), queries.select("query_id", spelt("query")), k, keys, shards_of(chars))
    shared = found.select("query_id", *dict.fromkeys([ident, *order]), F.col("total").alias("overlap"))
    return ranked(shared, [F.col("overlap").desc(), *map(F.col, keys)], k)


def min_max(df: DataFrame, column: str, out: str, partition: str = "query_id") -> DataFrame:
    """Scales to [0, 1] in each partition; a constant partition becomes 1."""
    ends = df.groupBy(F.col(partition).alias("_p")).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    span = F.col("_high") - F.col("_low")
    met = df.join(ends, F.col(partition).eqNullSafe(F.col("_p")))
    return met.withColumn(out, F.when(span == 0, F.lit(1.0)).otherwise((F.col(column) - F.col("_low")) / span)).drop("_p", "_low", "_high")


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """Default pair scorer: share of a question's tokens that the text holds."""
    import re

    tokens = lambda s: {t.lower() for t in re.findall(text.IDENTIFIER, s)}
    out = []
    for q, t in zip(queries, texts, strict=True):
        a = tokens(q)
        out.append(len(a & tokens(t)) / len(a) if a else 0.0)
    return out


def score_pairs(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]] = overlap_scorer) -> DataFrame:
    """Adds `relevance` to pairs(query, text); a pair that occurs more than once in a batch is scored once."""

    @F.pandas_udf("double")
    def relevance(query, body):
        import pandas as pd

        frame = pd.DataFrame({"q": query.fillna(""), "t": body.fillna("")})
        unique = frame.drop_duplicates()
        scores = pd.Series(scorer(unique["q"].tolist(), unique["t"].tolist()), index=pd.MultiIndex.from_frame(unique), name="s")
        return frame.join(scores, on=["q", "t"])["s"].reset_index(drop=True).astype("float64")

    return pairs.withColumn("relevance", relevance("query", "text"))


def score_cached(pairs: DataFrame, cache: DataFrame, scorer: Callable[[list[str], list[str]], list[float]] = overlap_scorer, *, model: str, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs with `relevance`, cache as it is afterwards) of pairs(query, text) and cache(key, relevance, last_used).

    A pair's key is the sha256 of model, query and text, parted by NUL. Each distinct pair that the cache lacks is scored
    once; used entries get a new last_used. Write the cache before the next batch, which then scores
    nothing anew; `ledger.keep_recent` bounds it.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    keyed = pairs.withColumn("_key", F.sha2(F.concat_ws("\0", F.lit(model), blank("query"), blank("text")), 256))
    asked = keyed.groupBy("_key").agg(F.first(F.struct("query", "text")).alias("p")).select(F.col("_key").alias("key"), "p.*")
    fresh = score_pairs(asked.join(cache.select("key"), "key", "left_anti"), scorer).select("key", "relevance")
    stamp = (now if now is not None else F.current_timestamp()).alias("last_used")
    used = cache.select("key", "relevance").join(asked.select("key"), "key", "left_semi").unionByName(fresh).select("key", "relevance", stamp)
    left = cache.select("key", "relevance", "last_used").join(asked.select("key"), "key", "left_anti")
    scored = keyed.join(used.select(F.col("key").alias("_key"), "relevance"), "_key").drop("_key")
    return scored, used.unionByName(left)


def mmr_order(tokens: list[set[str]], relevance: list[float], k: int, balance: float) -> list[int]:
    """Greedy maximal marginal relevance: positions in the order chosen, ties to the first."""
    if not tokens or k <= 0:
        return []
    low, high = min(relevance), max(relevance)
    rel = [(r - low) / (high - low) if high > low else 1.0 for r in relevance]
    penalty, left, chosen = [0.0] * len(tokens), set(range(len(tokens))), []
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (balance * rel[i] - (1 - balance) * penalty[i], -i))
        chosen.append(best)
        left.discard(best)
        for i in left:
            a, b = tokens[i], tokens[best]
            if a and b:
                penalty[i] = max(penalty[i], len(a & b) / len(a | b))
    return chosen


def diversify(pool: DataFrame, k: int = 8, *, balance: float = 0.9, max_pool: int = 50, ident: str = "chunk_id") -> DataFrame:
    """query_id, rank, ident of pool(query_id, rank, ident, text, relevance) by marginal relevance.

    A group is a question's pool, at most max_pool rows, so the grouped function is bounded.
    """
    kind = pool.schema[ident].dataType.simpleString()

    def pick(frame):
        import re

        import pandas as pd

        frame = frame.sort_values("rank")
        tokens = [{t.lower() for t in re.findall(text.IDENTIFIER, s or "")} for s in frame["text"]]
        order = mmr_order(tokens, frame["relevance"].tolist(), k, balance)
        return pd.DataFrame({"query_id": frame["query_id"].iloc[order].to_numpy(), "rank": range(1, len(order) + 1), ident: frame[ident].iloc[order].to_numpy()})

    query_kind = pool.schema["query_id"].dataType.simpleString()
    head = pool.where(F.col("rank") <= max_pool).select("query_id", "rank", ident, "text", "relevance")
    return head.groupBy("query_id").applyInPandas(pick, f"query_id {query_kind}, rank int, {ident} {kind}")


def rerank(pool: DataFrame, queries: DataFrame, k: int = 8, *, scorer=overlap_scorer, balance: float = 0.9, max_pool: int = 50, ident: str = "chunk_id") -> DataFrame:
    """Scores the head of each pool(query_id, rank, ident, text) against its question, then diversifies."""
    head = pool.where(F.col("rank") <= max_pool).join(queries.select("query_id", "query"), "query_id")
    return diversify(score_pairs(head, scorer), k, balance=balance, max_pool=max_pool, ident=ident)


def pool_with_tail(reranked: DataFrame, pool: DataFrame, *, ident: str = "chunk_id") -> DataFrame:
    """Reranked head, then the rest of the pool in its own order."""
    tail = pool.join(reranked.select("query_id", ident), ["query_id", ident], "left_anti")
    both = reranked.select("query_id", ident, F.lit(0).alias("part"), "rank").unionByName(tail.select("query_id", ident, F.lit(1).alias("part"), "rank"))
    return both.select("query_id", ident, F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank")).alias("rank"))


def attribute(claims: DataFrame, chunks: DataFrame, k: int = 2, scorer=overlap_scorer) -> DataFrame:
    """claim_id, rank, chunk_id: best chunks of each claim among those of its answer (answer_id)."""
    pairs = claims.where(F.trim("text") != "").select("claim_id", "answer_id", F.col("text").alias("query")).join(chunks.select("answer_id", "chunk_id", F.col("content").alias("text")), "answer_id")
    return ranked(score_pairs(pairs, scorer), [F.col("relevance").desc(), F.col("chunk_id")], k, partition="claim_id").select("claim_id", "rank", "chunk_id")


def prompt_budget(chunks: DataFrame, *, per_chunk: int = 4000, total: int = 24000, cut_last: bool = True) -> DataFrame:
    """Chunks that fit a prompt by rank; the one that overflows is cut, or left out with all after it."""
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    sized = chunks.withColumn("chars", F.least(F.length("content"), F.lit(per_chunk)))
    out = sized.withColumn("used", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    if cut_last:
        return out.where(F.col("used") < total).withColumn("chars", F.least(F.col("chars"), total - F.col("used")))
    return out.where(F.col("used") + F.col("chars") <= total)


def embed_told(texts: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], *, dimension: int = 768, batch: int = 32) -> DataFrame:
    """text_key, vector, cached, problem for every distinct text: cache lookup, then one call for each batch of misses.

    A batch that fails is halved until single texts fail. Those have no vector but a problem (the error, no vector, or
    a vector of another length), so they can be put aside and tried again.
    """
    keyed = texts.select(F.sha2("text", 256).alias("text_key"), "text").dropDuplicates(["text_key"])
    hits = keyed.join(cache.select("text_key", "vector"), "text_key").select("text_key", "vector", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("problem"))
    misses = keyed.join(cache.select("text_key"), "text_key", "left_anti")

    def attempt(items: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(v, None if v is not None and len(v) == dimension else "no vector" if v is None else f"length {len(v)}") for v in embed(items)]
        except Exception as e:
            if len(items) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            half = len(items) // 2
            return attempt(items[:half]) + attempt(items[half:])

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                rows += [(k, None if p else v, False, p) for k, (v, p) in zip(part["text_key"], attempt(part["text"].tolist()), strict=True)]
            yield pd.DataFrame(rows, columns=["text_key", "vector", "cached", "problem"])

    return hits.unionByName(misses.mapInPandas(run, "text_key string, vector array<double>, cached boolean, problem string"))


def embed_missing(texts: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], *, dimension: int = 768, batch: int = 32) -> DataFrame:
    """text_key, vector of the texts that have one; see `embed_told` for the others."""
    return embed_told(texts, cache, embed, dimension=dimension, batch=batch).where("problem IS NULL").select("text_key", "vector")
