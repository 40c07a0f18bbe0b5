"""Registered queries of sinks and sources (snapshots, datasets, reports), filters, counts and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation, filters, ledger, retrieval
from ..sources import files, labelled, tables
from ..storage import fresh_folder
from .ask import prompts
from .queries import _CHUNKS, _DENSE, _POSTINGS, _QUESTIONS, _R, _SPARSE, _TERMS, query
from .views import document_chunks, questions, table, trade_edges


def _text_key(column: str) -> Column:
    return F.sha2(F.col(column), 256)


# ---- filters and guards


@query(f"WITH {_CHUNKS} SELECT chunk_id, file_path FROM chunks WHERE source = 'src3' AND starts_with(file_path, 'src3/1')")
def repo_and_prefix(spark, sf_dir):
    return document_chunks(spark, sf_dir).where(filters.corpus_filter("src3", prefix="src3/1", repo_column="source")).select("chunk_id", "file_path")


@query("SELECT page_id FROM pages WHERE url ILIKE '%/10'")
def pages_by_slug(spark, sf_dir):
    return filters.with_slug(table(spark, sf_dir, "pages"), "10").select("page_id")


@query(f"WITH {_CHUNKS}, all_q AS (SELECT e.vec_id AS query_id, CASE WHEN e.vec_id % 100 = 0 THEN '  the of ' ELSE d.text END AS query FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 50 = 0), questions AS (SELECT * FROM all_q), {_TERMS}, {_POSTINGS}, {_SPARSE} SELECT query_id, rank, chunk_id FROM sparse WHERE rank <= 5")
def blank_questions(spark, sf_dir):
    """Questions without a content word find nothing; no k, no rows."""
    asked = questions(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 100 == 0, "  the of ").otherwise(F.col("query")))
    chunks = document_chunks(spark, sf_dir)
    none = retrieval.keyword_search(chunks, asked, 0).unionByName(retrieval.keyword_search(chunks, asked, -3))
    return retrieval.keyword_search(chunks, asked, 5).unionByName(none).select("query_id", "rank", "chunk_id")


# ---- counts and caches


@query("SELECT conv_id, count(*) AS next_ordinal FROM conversations GROUP BY conv_id")
def next_ordinals(spark, sf_dir):
    return ledger.next_ordinal(table(spark, sf_dir, "conversations"), "conv_id")


@query(f"""WITH {_CHUNKS}, e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT 's' || l_suppkey AS s FROM lineitem UNION SELECT 'p' || l_partkey FROM lineitem)
SELECT 'documents' AS repo_id, (SELECT count(DISTINCT file_path) FROM chunks) AS files, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM e) AS call_edges, (SELECT count(*) FROM n) AS nodes""")
def index_counts(spark, sf_dir):
    chunks, edges = (df.withColumn("repo_id", F.lit("documents")) for df in (document_chunks(spark, sf_dir), trade_edges(spark, sf_dir)))
    nodes = edges.select("repo_id", F.explode(F.array("src", "dst")).alias("symbol")).distinct()
    return ledger.index_counts(chunks, edges, nodes)


@query("SELECT count(*) AS files, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN length(t) - length(replace(t, chr(10), '')) + 1 WHEN t = '' THEN 0 ELSE len(string_split(regexp_replace(t, '\\n$', ''), chr(10))) END) AS BIGINT) AS loc FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def corpus_lines_of_code(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 2 == 0, "python").otherwise("text").alias("language"))
    return files.lines_of_code(d).select("files", F.col("loc").cast("long").alias("loc"))


@query("SELECT CAST(event_id AS VARCHAR) AS key FROM events ORDER BY ts DESC, key LIMIT 300")
def recent_verdicts(spark, sf_dir):
    verdicts = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.col("ts").alias("last_used"))
    return ledger.keep_recent(verdicts, 300).select("key")


# ---- reports


_SIDES = """m AS (SELECT CAST(user_id % 9 AS VARCHAR) AS repo, 'stage_' || event_type AS metric, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS b, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS a FROM events GROUP BY ALL)"""


def _delta(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("repo", (F.col("user_id") % 9).cast("string")).withColumn("metric", F.concat(F.lit("stage_"), F.col("event_type")))
    side = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("repo", "metric").agg(F.avg("value").alias("value"))
    return evaluation.deltas(side(0), side(1))


@query(f"WITH {_SIDES}, r AS (SELECT repo, metric, round(a - b, 6) AS delta, row_number() OVER (PARTITION BY repo ORDER BY a - b DESC, metric) AS rank FROM m WHERE a - b > 0) SELECT * FROM r WHERE rank <= 3")
def worst_stages(spark, sf_dir):
    return evaluation.worst_regressions(_delta(spark, sf_dir)).select("repo", "metric", _R("delta").alias("delta"), "rank")


@query(f"WITH {_SIDES} SELECT repo, metric FROM m WHERE metric = 'stage_click' AND a > 1.05 * b")
def stages_over_budget(spark, sf_dir):
    return evaluation.over_budget(_delta(spark, sf_dir), "stage_click", 1.05).select("repo", "metric")


@query(f"""WITH {_SIDES} SELECT repo, max(CASE WHEN metric = 'stage_click' THEN round(a, 4) END) AS stage_click, max(CASE WHEN metric = 'stage_error' THEN round(a, 4) END) AS stage_error, max(CASE WHEN metric = 'stage_view' THEN round(a, 4) END) AS stage_view FROM m GROUP BY repo""")
def metric_sheet(spark, sf_dir):
    """One row a repository, written as CSV and read back."""
    long = _delta(spark, sf_dir).select("repo", "metric", F.round("after", 4).alias("value")).where("metric IN ('stage_click', 'stage_error', 'stage_view')")
    path = f"{fresh_folder(spark, 'sheet')}/metrics.csv"
    tables.write_csv(tables.metric_table(long, ["stage_click", "stage_error", "stage_view"]), path)
    return spark.read.option("header", "true").schema("repo string, stage_click double, stage_error double, stage_view double").csv(path)


# ---- snapshots, labels and datasets


@query("SELECT source AS repo_id, count(*) AS chunks, max(sha256(text)) AS last FROM documents WHERE source <> 'src1' OR doc_id % 3 = 0 GROUP BY source")
def rewritten_snapshot(spark, sf_dir):
    """Snapshots of all sources, one of which is written again with a third of its chunks: the stale ones are gone, the others untouched."""
    root, chunks = fresh_folder(spark, "snapshots"), document_chunks(spark, sf_dir).select(F.col("source").alias("repo_id"), "chunk_id", "file_path", "start_line", "end_line", "symbol", "kind", "content")
    tables.write_snapshot({"chunks": chunks}, root, tables.manifest_entry(spark, "all", "u", "h1", 1, 1))
    third = chunks.where("repo_id = 'src1' AND chunk_id % 3 = 0")
    if not third.isEmpty():
        tables.write_snapshot({"chunks": third}, root, tables.manifest_entry(spark, "src1", "u", "h2", 1, 1))
    return spark.read.schema(chunks.schema).parquet(f"{root}/chunks").groupBy("repo_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(_text_key("content")).alias("last"))


@query(f"WITH {_CHUNKS} SELECT file_path, start_line, sha256(content) AS content FROM (SELECT *, 1 AS start_line FROM chunks) WHERE source = 'src5'")
def chunks_of_a_repository(spark, sf_dir):
    path = f"{fresh_folder(spark, 'chunks')}/chunks"
    document_chunks(spark, sf_dir).withColumn("repo_id", F.col("source")).write.partitionBy("repo_id").parquet(path)
    return tables.read_chunks(spark, path, "src5").select("file_path", "start_line", _text_key("content").alias("content"))


@query(f"WITH {_QUESTIONS}, {_DENSE}, {_CHUNKS}, p AS (SELECT d.query_id, d.rank, d.chunk_id FROM dense d JOIN chunks c USING (chunk_id) WHERE d.rank <= 150 AND NOT starts_with(c.file_path, 'src1') AND NOT starts_with(c.file_path, 'src2')), r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS label_rank FROM p) SELECT * FROM r WHERE label_rank <= 6")
def proposed_labels(spark, sf_dir):
    dense = retrieval.nearest_batch(table(spark, sf_dir, "embeddings"), questions(spark, sf_dir), 150).withColumnRenamed("vec_id", "chunk_id")
    return tables.propose_labels(dense, document_chunks(spark, sf_dir), ("src1", "src2")).select("query_id", "chunk_id", "label_rank")


@query("""WITH b AS (SELECT item_id, text, item_id % 4 AS file, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) AS n, count(*) FILTER (item_id % 3 = 0) OVER (PARTITION BY item_id % 4 ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blanks FROM benchmark WHERE length(text) > 0)
SELECT item_id, n + blanks AS line, sha256(text) AS claim, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS refs FROM b""")
def labelled_claims(spark, sf_dir):
    """A verifier dataset written as JSON Lines, with blank lines in between, and loaded with its line numbers."""
    root, item = fresh_folder(spark, "claims"), F.col("item_id")
    span = F.struct(F.lit("a.py").alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    row = F.struct(F.col("text").alias("claim"), F.lit("supported").alias("expected_verdict"), F.when(item % 2 == 0, F.array(span)).alias("refs"), F.array(F.struct("span.*", item.cast("string").alias("content"))).alias("chunks"))
    b = table(spark, sf_dir, "benchmark").where("length(text) > 0").withColumn("span", span).withColumn("part", item % 4)
    lines = b.repartition("part").sortWithinPartitions("part", "item_id").select("part", F.concat(F.to_json(row), F.when(item % 3 == 0, "\n").otherwise("")).alias("value"))
    lines.write.partitionBy("part").text(f"{root}/claims")
    got = labelled.load(spark, f"{root}/claims", "verifier")
    return got.select(F.get("chunks", F.lit(0))["content"].cast("long").alias("item_id"), "line", _text_key("claim").alias("claim"), F.size("refs").alias("refs"))


@query("SELECT file_path, row_number() OVER (ORDER BY file_path) AS ordinal FROM (SELECT source || '/' || doc_id || '.txt' AS file_path FROM documents)")
def file_ordinals(spark, sf_dir):
    return labelled.ordinals(document_chunks(spark, sf_dir).select("file_path"), "file_path")


# ---- prompts


@query("""WITH r AS (SELECT source, doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents), h AS (SELECT *, least(length(t), 400) AS c FROM r WHERE rank <= 8),
b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h), f AS (SELECT *, least(c, 1500 - used) AS n FROM b WHERE used < 1500),
v AS (SELECT *, CASE WHEN length(t) <= n THEN t ELSE regexp_replace(left(t, CAST(n AS BIGINT)), '\\n[^\\n]*\\z', '') || chr(10) || '… (chunk truncated for prompt size)' END AS view FROM f)
SELECT source AS query_id, sha256(string_agg('Chunk [' || (rank - 1) || ']:' || chr(10) || '<source file=' || source || ':1-9 symbol=''x''>' || chr(10) || rtrim(view, ' ') || chr(10) || '</source>', chr(10) || chr(10) ORDER BY rank)) AS prompt_sha256 FROM v GROUP BY source""")
def prompt_slices(spark, sf_dir):
    """The first eight chunks of each source as one prompt within its budget."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), place.alias("rank"), F.col("source").alias("file_path"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit("x").alias("symbol"), F.coalesce("text", F.lit("")).alias("content"))
    return prompts(d.where("rank <= 8"), per_chunk=400, total=1500).select("query_id", F.sha2("prompt", 256).alias("prompt_sha256"))
