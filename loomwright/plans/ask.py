"""Read path: questions in, ranked chunks and prompts out, for a whole table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.constants import NON_SOURCE_PREFIXES
from ..operators import graph, retrieval
from ..operators.filters import corpus_filter, exclusions_for


def query_spec(questions: DataFrame) -> DataFrame:
    """Adds intent, multi_hop, symbols, paths, lexical query of questions(query_id, query)."""
    q = F.col("query")
    out = questions.withColumn("intent", text.intent_class(q)).withColumn("multi_hop", text.is_multi_hop(q))
    out = out.withColumn("symbols", text.hinted_symbols(q)).withColumn("paths", F.transform(text.hinted_paths(q), text.normalise_path))
    return out.withColumn("sparse_query", text.lexical_query(q, F.col("symbols")))


def retrieve(chunks: DataFrame, questions: DataFrame, *, keywords: list[str] | None = None, exclude: tuple[str, ...] = NON_SOURCE_PREFIXES, recall: int = 50) -> DataFrame:
    """query_id, rank, chunk_id, score of chunks(chunk_id, file_path, symbol, content, embedding).

    Questions that find nothing outside the excluded prefixes are searched again without exclusions;
    questions without a vector (null q) use the keyword lane alone.
    """
    spec = query_spec(questions)
    sparse_in = spec.select("query_id", F.col("sparse_query").alias("query"))

    def lanes(corpus: DataFrame, asked: DataFrame) -> DataFrame:
        ids = asked.select("query_id")
        dense = retrieval.nearest_batch(corpus.where("embedding IS NOT NULL"), questions.where("q IS NOT NULL").join(ids, "query_id", "left_semi").select("query_id", "q"), recall, ident="chunk_id")
        sparse = retrieval.keyword_search(corpus, sparse_in.join(ids, "query_id", "left_semi"), recall)
        return retrieval.hybrid(dense, sparse, questions, recall=recall)

    prefixes = exclusions_for(keywords or [], exclude)
    first = lanes(chunks.where(corpus_filter(exclude=prefixes)), questions)
    if not prefixes:
        return first
    missed = questions.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.unionByName(lanes(chunks, missed))


def context(chunks: DataFrame, questions: DataFrame, *, k: int = 8, pool: int = 25, scorer=retrieval.overlap_scorer, **options) -> DataFrame:
    """query_id, rank and chunk columns of the k chunks that answer each question."""
    hits = retrieve(chunks, questions, **options).where(F.col("rank") <= pool)
    body = chunks.select("chunk_id", text.rerank_text(F.col("symbol"), F.col("content")).alias("text"))
    best = retrieval.rerank(hits.select("query_id", "rank", "chunk_id").join(body, "chunk_id"), questions, k, scorer=scorer, max_pool=pool)
    return best.join(chunks.drop("embedding"), "chunk_id")


def prompts(found: DataFrame, *, per_chunk: int = 4000, total: int = 24000) -> DataFrame:
    """query_id, prompt: source blocks within the character budget, by rank."""
    fit = retrieval.prompt_budget(found, per_chunk=per_chunk, total=total)
    view = text.truncate_lines(F.col("content"), F.col("chars"))
    block = text.source_block(F.col("rank") - 1, F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("symbol"), view)
    return fit.select("query_id", "rank", block.alias("block")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("prompt"))


def claims(answers: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, line, text, refs, status of answers(query_id, answer); citations count from 0.

    A line without a valid citation points to the first chunk and stays unverified.
    """
    refs = found.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("rank") - 1).alias("k"), F.struct("file_path", "start_line", "end_line").alias("v")))).alias("pool"))
    said = answers.where(~text.is_not_found(F.col("answer"))).select("query_id", F.inline(text.claim_lines(F.col("answer"))))
    met = said.join(refs, "query_id")
    cited = F.array_distinct(F.filter(F.transform("citations", lambda c: F.try_element_at("pool", c)), lambda r: r.isNotNull()))
    out = met.withColumn("cited", cited)
    first = F.array(F.try_element_at("pool", F.lit(0)))
    return out.select("query_id", "line", "text", F.when(F.size("cited") > 0, F.col("cited")).otherwise(first).alias("refs"), F.when(F.size("cited") > 0, F.lit(None)).otherwise(F.lit("unverified")).cast("string").alias("status"))


def expand_hops(found: DataFrame, edges: DataFrame, chunks: DataFrame, depth: int = 2) -> DataFrame:
    """Spans that call paths from the found symbols lead to, without those already there."""
    starts = found.select("symbol").distinct()
    return graph.expand(graph.paths(edges, starts, depth=depth), chunks, found.select("file_path", "start_line", "end_line").distinct())
