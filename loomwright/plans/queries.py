"""Registered queries of the engine's own operators, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..functions.constants import STOPWORDS
from ..operators import communities as layered, contribute, evaluation, graph, ledger, retrieval, stored_index
from ..operators.filters import corpus_filter
from ..sources import files, python_code
from ..storage import fresh_folder
from .views import document_chunks, order_chunks, place_edges, questions, table, trade_edges

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_TOKENS = "regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]*')"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_CLEAN = "array_to_string(list_filter(" + _TOKENS + f", lambda t: NOT list_contains({_STOP}, lower(t))), ' ')"
_SPLIT = r"regexp_replace(regexp_replace(regexp_replace({}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[._]+', ' ', 'g')"
_CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, lang AS kind, source || '/' || doc_id || '.txt' AS file_path, source || '.TextUnit_' || doc_id AS symbol,
  text AS content, source FROM documents)"""
_QUESTIONS = "questions AS (SELECT e.vec_id AS query_id, e.embedding AS q, d.text AS query FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 50 = 0)"
_DOUBLES = "list_transform({}, lambda x: CAST(x AS DOUBLE))"
_DENSE = f"""dense AS (SELECT query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, distance FROM (
  SELECT query_id, vec_id, round(list_cosine_distance({_DOUBLES.format('q')}, {_DOUBLES.format('e.embedding')}), 9) AS distance FROM questions, embeddings e))"""
_TERMS = f"terms AS (SELECT DISTINCT query_id, lower(unnest({_TOKENS.format(_CLEAN.format('query'))})) AS term FROM questions)"
_POSTINGS = f"""postings AS (SELECT chunk_id, w, term, count(*) AS tf FROM (
  SELECT chunk_id, 1.0 AS w, lower(unnest({_TOKENS.format('symbol')})) AS term FROM chunks
  UNION ALL SELECT chunk_id, 0.4, lower(unnest({_TOKENS.format(_SPLIT.format('symbol'))})) FROM chunks
  UNION ALL SELECT chunk_id, 0.1, lower(unnest({_TOKENS.format('content')})) FROM chunks) GROUP BY ALL)"""
_SPARSE = """sparse AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(CAST(sum(tf * w) AS DOUBLE), 6) AS score FROM postings JOIN terms USING (term) GROUP BY ALL))"""
_LEXICAL = r"'([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*)|([A-Za-z0-9]+_[A-Za-z0-9_]+)|(\b[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)|(\b[A-Z]{2,}[a-z][A-Za-z0-9]*)'"
_EDGES = "edges AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE l_returnflag WHEN 'R' THEN 'calls' WHEN 'A' THEN 'imports' ELSE 'inherits' END AS type FROM lineitem)"
_SPANS = "spans AS (SELECT 'p' || l_partkey AS symbol, 's' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS file_path, l_linenumber * 10 AS start_line, l_linenumber * 10 + CAST(l_quantity AS INT) AS end_line, l_linestatus AS kind, l_orderkey FROM lineitem)"
_BOTH = """both_ways AS (SELECT DISTINCT * FROM (SELECT src AS symbol, dst AS neighbour, type AS edge FROM edges UNION ALL
  SELECT dst, src, CASE type WHEN 'calls' THEN 'called_by' WHEN 'imports' THEN 'imported_by' ELSE 'inherited_by' END FROM edges))"""
_ORDER = "list_position(['defined_by', 'calls', 'called_by', 'inherits', 'inherited_by', 'defines', 'imports', 'imported_by'], edge)"
_R = lambda c, n=6: F.round(c, n)


def _vector(spark, sf_dir: str, ident: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == ident).first()["embedding"]


# ---- dense, keyword and hybrid retrieval


@query(f"SELECT vec_id, round(list_cosine_distance({_DOUBLES.format('embedding')}, {_DOUBLES.format('(SELECT embedding FROM embeddings WHERE vec_id = 0)')}), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10")
def knn_cosine_topk(spark, sf_dir):
    return retrieval.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 10).select("vec_id", _R("distance").alias("distance"))


@query(f"SELECT vec_id, round(list_cosine_distance({_DOUBLES.format('embedding')}, {_DOUBLES.format('(SELECT embedding FROM embeddings WHERE vec_id = 0)')}), 6) AS distance FROM embeddings WHERE label = 3 ORDER BY distance, vec_id LIMIT 8")
def knn_filtered(spark, sf_dir):
    return retrieval.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 8, where=F.col("label") == 3).select("vec_id", _R("distance").alias("distance"))


@query(f"WITH {_QUESTIONS}, {_DENSE} SELECT query_id, rank, chunk_id, round(distance, 6) AS distance FROM dense WHERE rank <= 8")
def knn_batch_rank(spark, sf_dir):
    out = retrieval.nearest_batch(table(spark, sf_dir, "embeddings"), questions(spark, sf_dir), 8)
    return out.select("query_id", "rank", F.col("vec_id").alias("chunk_id"), _R("distance").alias("distance"))


@query(f"WITH {_CHUNKS}, {_QUESTIONS}, {_TERMS}, {_POSTINGS}, {_SPARSE} SELECT query_id, rank, chunk_id, score, round(greatest(0, 1 - score / max(score) OVER (PARTITION BY query_id)), 6) AS distance FROM sparse WHERE rank <= 50")
def fts_weighted_rank(spark, sf_dir):
    return retrieval.keyword_search(document_chunks(spark, sf_dir), questions(spark, sf_dir), 50).select("query_id", "rank", "chunk_id", _R("score").alias("score"), _R("distance").alias("distance"))


@query(f"SELECT conv_id, turn, {_CLEAN.format('text')} AS cleaned FROM conversations WHERE role = 'user'")
def fts_stopword_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.clean_query(F.col("text")).alias("cleaned"))


@query(f"SELECT page_id, {_SPLIT.format('url')} AS parts FROM pages")
def identifier_split(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.split_identifier(F.col("url")).alias("parts"))


_TWO_LANES = """lanes AS (SELECT lang AS query_id, 0 AS lane, doc_id AS chunk_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents
  UNION ALL SELECT lang, 1, doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) FROM documents)"""


def _lanes(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("chunk_id"), "n_chars", "source")
    long = retrieval.ranked(d, [F.col("n_chars").desc(), F.col("chunk_id")], 50).select("query_id", F.lit(0).alias("lane"), "rank", "chunk_id")
    named = retrieval.ranked(d, [F.col("source"), F.col("chunk_id")], 50).select("query_id", F.lit(1).alias("lane"), "rank", "chunk_id")
    return long.unionByName(named)


@query(f"WITH {_TWO_LANES} SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM lanes WHERE rank <= 50 GROUP BY ALL")
def rrf_fuse(spark, sf_dir):
    return retrieval.fuse(_lanes(spark, sf_dir).withColumn("weight", F.lit(1.0)), limit=100).select("query_id", "chunk_id", _R("score").alias("score"))


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, {_LEXICAL}) THEN 1.0 ELSE 3.0 END::DOUBLE AS dense_weight, CASE WHEN regexp_matches(text, {_LEXICAL}) THEN 2.0 ELSE 1.0 END::DOUBLE AS sparse_weight FROM conversations")
def rrf_weighted_router(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumnRenamed("text", "query")
    return retrieval.lane_weights(c).select("conv_id", "turn", "dense_weight", "sparse_weight")


@query(f"""WITH {_CHUNKS}, {_QUESTIONS}, {_TERMS}, {_POSTINGS}, {_SPARSE}, {_DENSE},
w AS (SELECT query_id, CASE WHEN regexp_matches(query, {_LEXICAL}) THEN 1.0 ELSE 3.0 END AS dw, CASE WHEN regexp_matches(query, {_LEXICAL}) THEN 2.0 ELSE 1.0 END AS sw FROM questions),
l AS (SELECT query_id, 0 AS lane, rank, chunk_id, dw AS weight FROM dense JOIN w USING (query_id) WHERE rank <= 50 UNION ALL SELECT query_id, 1, rank, chunk_id, sw FROM sparse JOIN w USING (query_id) WHERE rank <= 50),
f AS (SELECT query_id, chunk_id, CAST(sum(weight / (60 + rank)) AS DOUBLE) AS score, min({{'lane': lane, 'rank': rank}}) AS first FROM l GROUP BY ALL)
SELECT query_id, rank, chunk_id, round(score, 6) AS score, round(1 / (1 + score), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, chunk_id) AS rank FROM f) WHERE rank <= 50""")
def hybrid_topk(spark, sf_dir):
    qs = questions(spark, sf_dir)
    dense = retrieval.nearest_batch(table(spark, sf_dir, "embeddings"), qs, 50).withColumnRenamed("vec_id", "chunk_id")
    sparse = retrieval.keyword_search(document_chunks(spark, sf_dir), qs, 50)
    out = retrieval.hybrid(dense, sparse, qs)
    return out.select("query_id", "rank", "chunk_id", _R("score").alias("score"), _R("distance").alias("distance"))


@query("SELECT o_orderkey, round(CASE WHEN hi = lo THEN 1.0 ELSE (o_totalprice - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT *, min(o_totalprice) OVER p AS lo, max(o_totalprice) OVER p AS hi FROM orders WINDOW p AS (PARTITION BY o_orderpriority))")
def minmax_normalize(spark, sf_dir):
    return retrieval.min_max(table(spark, sf_dir, "orders"), "o_totalprice", "scaled", "o_orderpriority").select("o_orderkey", _R("scaled").alias("scaled"))


@query("""WITH t AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x))) AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.s, b.s)) > 0""")
def jaccard_pairs(spark, sf_dir):
    sets = table(spark, sf_dir, "benchmark").select("item_id", text.token_set(F.col("text")).alias("s"))
    words = sets.select("item_id", F.size("s").alias("n"), F.explode("s").alias("w"))
    left, right = words.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "w"), words.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "w")
    shared = left.join(right, "w").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    return shared.select("a", "b", _R(F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


@query("""WITH w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'))) AS t FROM documents),
q AS (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'))) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, count(*) AS overlap FROM w JOIN q USING (t) GROUP BY ALL)
SELECT item_id AS query_id, rank, doc_id AS chunk_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def keyword_overlap_top3(spark, sf_dir):
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.keyword_overlap(document_chunks(spark, sf_dir), qs).select("query_id", "rank", "chunk_id", "overlap")


@query("SELECT conv_id, turn AS pos, doc_id, n_chars FROM conversations c JOIN documents d ON d.doc_id = c.conv_id + c.turn")
def read_refs_ordered(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), (F.col("conv_id") + F.col("turn")).alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "n_chars")
    return retrieval.read_refs(c, d).select("conv_id", "pos", F.col("file_path").alias("doc_id"), "n_chars").orderBy("conv_id", "pos")


@query("SELECT doc_id, file_path FROM (SELECT doc_id, lang, source || '/' || doc_id || '.txt' AS file_path FROM documents) WHERE lang = 'en' AND NOT starts_with(file_path, 'src1') AND regexp_matches(file_path, '^(?:src.*/.*\\.txt)$')")
def filtered_corpus(spark, sf_dir):
    rows = document_chunks(spark, sf_dir).where(corpus_filter(kind="en", exclude=("src1",), glob="src%/%.txt"))
    return rows.select(F.col("chunk_id").alias("doc_id"), "file_path")


# ---- ledger


@query("""WITH c AS (SELECT o_custkey, count(*) AS n_chunks, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS n_embedded FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT o_custkey AS repo_id, n_chunks, n_embedded FROM c WHERE n_chunks > 0 AND n_embedded >= 0.99 * n_chunks""")
def snapshot_complete_having(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("repo_id"))
    li = table(spark, sf_dir, "lineitem")
    ident = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    counts = li.join(o, "l_orderkey").groupBy("repo_id").agg(F.count(ident).alias("n_chunks"), F.count_if(F.col("l_returnflag") != "R").alias("n_embedded"))
    return ledger.complete(counts)


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_snapshot(spark, sf_dir):
    return ledger.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings_anti(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return ledger.without(table(spark, sf_dir, "documents").select("doc_id"), e, "doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def has_children_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return ledger.having(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, "c_custkey")


@query("SELECT c_custkey, coalesce(n, 0) AS message_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def tours_with_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return ledger.tours_with_counts(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations")
def message_ordinals(spark, sf_dir):
    return ledger.message_ordinals(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("SELECT user_id, count(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 END) AS used, greatest(0, 3 - count(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 END)) AS remaining FROM events GROUP BY user_id")
def allowance_remaining(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.lit("index").alias("action"), F.col("event_type").alias("status"))
    return ledger.allowance(e, "user_id", "index", limit=3, counted=("purchase", "signup"))


@query("SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS status, max(ts) AS ts FROM events GROUP BY user_id")
def latest_status_fold(spark, sf_dir):
    return ledger.latest(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), "ts", "event_id"), "user_id", "ts", "event_id").drop("event_id")


@query("""WITH s AS (SELECT user_id, event_type, arg_max(CASE WHEN value > 50 THEN 'failed' ELSE 'completed' END, {'a': ts, 'b': event_id}) AS status, min({'a': ts, 'b': event_id}) AS since FROM events GROUP BY ALL)
SELECT user_id, event_type, status, status <> 'failed' AND row_number() OVER (PARTITION BY user_id, status = 'failed' ORDER BY since) = 1 AS granted FROM s""")
def reservation_ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.lit("index").alias("action"), F.col("event_type").alias("resource_id"), F.when(F.col("value") > 50, "failed").otherwise("completed").alias("status"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return ledger.reservations(e).select(F.col("session_id").alias("user_id"), F.col("resource_id").alias("event_type"), "status", "granted")


@query("""WITH c AS (SELECT o_custkey, arg_max(o_totalprice, {'a': o_orderdate, 'b': o_totalprice}) AS v FROM orders GROUP BY 1)
SELECT c_custkey, c_name, coalesce(v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def upsert_latest_wins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    o = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    change = o.select(F.col("o_custkey").alias("c_custkey"), "c_name", F.col("o_totalprice").alias("c_acctbal"), F.struct("o_orderdate", "o_totalprice").alias("at"))
    return ledger.upsert(c, change, ["c_custkey"], "at")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# ---- graph


@query(f"WITH {_EDGES}, p AS (SELECT DISTINCT src, dst FROM edges) SELECT symbol, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS symbol, 0 AS i, 1 AS o FROM p UNION ALL SELECT dst, 1, 0 FROM p) GROUP BY symbol")
def fan_in_out(spark, sf_dir):
    return graph.degrees(trade_edges(spark, sf_dir))


@query(f"""WITH {_EDGES}, p AS (SELECT DISTINCT src, dst FROM edges), d AS (SELECT symbol, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS symbol, 0 AS i, 1 AS o FROM p UNION ALL SELECT dst, 1, 0 FROM p) GROUP BY symbol),
asked AS (SELECT 'p' || p_partkey AS symbol, 2 * (p_size % 4) + CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS cyclomatic FROM part UNION ALL SELECT 's' || s_suppkey, 1 FROM supplier UNION ALL SELECT 'pkg.r' || r_regionkey, 0 FROM region),
tests AS (SELECT 'assert p' || s_suppkey * 7 AS content FROM supplier)
SELECT symbol, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, CAST(cyclomatic AS INT) AS cyclomatic, 0 AS churn, EXISTS (SELECT 1 FROM tests WHERE contains(content, regexp_extract(asked.symbol, '[^.]*$'))) AS has_tests FROM asked LEFT JOIN d USING (symbol)""")
def graph_metrics(spark, sf_dir):
    """Parts as symbols of branching code, suppliers as tests that mention parts, and regions without code."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    tested = F.concat(F.lit("assert p"), (F.col("s_suppkey") * 7).cast("string"))
    code = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("symbol"), F.concat("p_brand", F.lit(".py")).alias("file_path"), F.repeat(F.lit("if a and b:\n    x\n"), (F.col("p_size") % 4).cast("int")).alias("content"))
    tests = supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("symbol"), F.concat(F.lit("tests/t"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("file_path"), tested.alias("content"))
    chunks = code.unionByName(tests)
    asked = chunks.select("symbol").unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("pkg.r"), F.col("r_regionkey").cast("string")).alias("symbol")))
    return graph.metrics(trade_edges(spark, sf_dir), chunks, asked)


@query(f"WITH {_EDGES} SELECT dst AS symbol, count(DISTINCT src) AS score FROM edges WHERE type = 'calls' GROUP BY 1 ORDER BY score DESC, symbol LIMIT 20")
def graph_hubs(spark, sf_dir):
    return graph.hubs(trade_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT DISTINCT src AS symbol FROM edges WHERE type = 'calls' AND src NOT IN (SELECT dst FROM edges WHERE type = 'calls') ORDER BY symbol LIMIT 20")
def graph_entry_points(spark, sf_dir):
    return graph.entry_points(trade_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT src, dst, CASE min(list_position(['calls', 'inherits', 'imports'], type)) WHEN 1 THEN 'calls' WHEN 2 THEN 'inherits' ELSE 'imports' END AS type FROM edges GROUP BY src, dst")
def edge_priority_dedup(spark, sf_dir):
    return graph.one_edge_per_pair(trade_edges(spark, sf_dir))


@query(f"WITH {_EDGES}, {_BOTH} SELECT symbol, " + ", ".join(f"CAST(count(CASE WHEN edge = '{e}' THEN 1 END) AS INT) AS n_{e}, coalesce(string_agg(CASE WHEN edge = '{e}' THEN neighbour END, ',' ORDER BY neighbour), '') AS {e}" for e in ("calls", "called_by", "imports", "imported_by")) + " FROM both_ways GROUP BY symbol")
def adjacency_buckets(spark, sf_dir):
    a = graph.adjacency(trade_edges(spark, sf_dir))
    return a.select("symbol", *[c for e in ("calls", "called_by", "imports", "imported_by") for c in (F.size(e).alias(f"n_{e}"), F.array_join(e, ",").alias(e))])


@query(f"""WITH {_EDGES}, {_BOTH}, {_SPANS},
u AS (SELECT symbol, file_path, min(start_line) AS start_line, max(end_line) AS end_line FROM spans GROUP BY ALL),
f AS (SELECT symbol AS neighbour, min({{'f': file_path, 's': start_line, 'e': end_line}}) AS s FROM u GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {_ORDER}, neighbour) AS rn, count(*) OVER (PARTITION BY symbol) AS total FROM both_ways),
x AS (SELECT n.*, s IS NOT NULL AS resolved, split_part(neighbour, '.', 1) NOT IN (SELECT split_part(symbol, '.', 1) FROM spans) AS external FROM n LEFT JOIN f USING (neighbour) WHERE rn <= 60)
SELECT symbol, neighbour, edge, external, resolved, total, row_number() OVER (PARTITION BY symbol ORDER BY external, NOT resolved, rn) AS rank FROM x""")
def graph_neighbours(spark, sf_dir):
    e = trade_edges(spark, sf_dir)
    return graph.neighbours(e, order_chunks(spark, sf_dir)).select("symbol", "neighbour", "edge", "external", "resolved", "total", "rank")


@query("""WITH e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
SELECT src AS start, src || '>' || dst AS path, 1 AS depth FROM e UNION ALL
SELECT a.src, a.src || '>' || a.dst || '>' || b.dst, 2 FROM e a JOIN e b ON a.dst = b.src""")
def bounded_paths(spark, sf_dir):
    e = place_edges(spark, sf_dir)
    found = graph.paths(e, e.select(F.col("src").alias("symbol")).distinct(), depth=3)
    return found.select("start", F.array_join("path", ">").alias("path"), "depth")


@query(f"WITH {_SPANS} SELECT symbol, s.f AS file_path, s.s AS start_line, s.e AS end_line FROM (SELECT symbol, min({{'f': file_path, 's': start_line, 'e': end_line}}) AS s FROM spans GROUP BY symbol)")
def symbol_first_span(spark, sf_dir):
    return graph.first_span(order_chunks(spark, sf_dir))


@query(f"""WITH {_SPANS}, u AS (SELECT symbol, file_path, min(start_line) AS s, max(end_line) AS e, min(kind) AS kind FROM spans GROUP BY ALL)
SELECT symbol, file_path, s AS start_line, e AS end_line, kind FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY file_path) AS r FROM u) WHERE r = 1""")
def symbol_union_span(spark, sf_dir):
    return graph.union_span(order_chunks(spark, sf_dir))


@query("SELECT DISTINCT split_part(source || '.TextUnit_' || doc_id, '.', 1) AS root FROM documents")
def internal_roots_distinct(spark, sf_dir):
    return graph.internal_roots(document_chunks(spark, sf_dir))


# ---- evaluation


_HITS = f"""{_SPANS}, hits AS (SELECT l_orderkey AS query_id, file_path, start_line, end_line, row_number() OVER (PARTITION BY l_orderkey ORDER BY start_line, file_path, symbol, end_line) AS rank FROM spans),
expected AS (SELECT l_orderkey AS query_id, file_path, start_line + 5 AS start_line, end_line + 5 AS end_line, row_number() OVER (PARTITION BY l_orderkey ORDER BY start_line, file_path, symbol, end_line) AS expected_id FROM spans WHERE kind = 'O')"""


def _hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("query_id").orderBy("start_line", "file_path", "symbol", "end_line")
    spans = order_chunks(spark, sf_dir).withColumnRenamed("l_orderkey", "query_id")
    hits = spans.withColumn("rank", F.row_number().over(w))
    wanted = spans.where("kind = 'O'").withColumn("expected_id", F.row_number().over(w)).withColumn("start_line", F.col("start_line") + 5).withColumn("end_line", F.col("end_line") + 5)
    return hits, wanted


@query(f"WITH {_HITS} SELECT h.query_id, rank, expected_id FROM hits h JOIN expected e ON h.query_id = e.query_id AND h.file_path = e.file_path AND h.start_line <= e.end_line AND h.end_line >= e.start_line")
def range_overlap_match(spark, sf_dir):
    return evaluation.overlapping(*_hits(spark, sf_dir))


_RELS = """r AS (SELECT source AS query_id, quality AS rel, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)),
n AS (SELECT query_id, CAST(sum(rel) AS BIGINT) AS n FROM r GROUP BY 1)"""


@query(f"""WITH {_RELS} SELECT query_id, n AS n_expected, round(coalesce(max(CASE WHEN rel = 1 THEN 1.0 / rank END), 0), 6)::DOUBLE AS mrr,
round(CASE WHEN n = 0 THEN 1.0 ELSE sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) / n END, 6) AS recall_5,
round(CASE WHEN n = 0 THEN 1.0 ELSE sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg_10
FROM r JOIN n USING (query_id) GROUP BY query_id, n""")
def recall_ndcg_mrr(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rels = d.select(F.col("source").alias("query_id"), F.col("quality").alias("rel"), F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")).alias("rank"))
    counts = rels.groupBy("query_id").agg(F.sum("rel").alias("n_expected"))
    out = evaluation.ranking_metrics(rels, counts, (5, 10))
    return out.select("query_id", "n_expected", _R("mrr").alias("mrr"), _R("recall_5").alias("recall_5"), _R("ndcg_10").alias("ndcg_10"))


@query(f"WITH {_HITS} SELECT query_id, round(count(DISTINCT file_path) / least(5, count(*)), 6) AS diversity FROM hits WHERE rank <= 5 GROUP BY query_id")
def diversity_top5(spark, sf_dir):
    return evaluation.diversity(_hits(spark, sf_dir)[0]).select("query_id", _R("diversity").alias("diversity"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN k = CAST(round_even(CAST(0.5 * (n - 1) AS DOUBLE), 0) AS BIGINT) + 1 THEN value END) AS p50, max(CASE WHEN k = CAST(round_even(CAST(0.95 * (n - 1) AS DOUBLE), 0) AS BIGINT) + 1 THEN value END) AS p95 FROM r GROUP BY event_type""")
def nearest_rank_percentile(spark, sf_dir):
    return evaluation.percentiles(table(spark, sf_dir, "events"), "value", (50, 95), ("event_type",))


@query("""WITH t AS (SELECT user_id, sum(value) AS total, """ + ", ".join(f"sum(CASE WHEN event_type = '{s}' THEN value ELSE 0 END) AS {s}" for s in ("click", "view", "error")) + """ FROM events GROUP BY user_id HAVING sum(value) > 0)
SELECT round(avg(click / total), 6) AS click, round(avg(view / total), 6) AS view, round(avg(error / total), 6) AS error FROM t""")
def stage_mean_share(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    t = by.groupBy("user_id").agg(F.sum("v").alias("total_ms"), F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("stages")).where("total_ms > 0")
    out = evaluation.stage_shares(t, ["click", "view", "error"])
    return out.select(*[_R(c).alias(c) for c in out.columns])


@query("""WITH m AS (SELECT event_type AS metric, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS b, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS a FROM events GROUP BY 1)
SELECT metric, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS delta, a > 1.01 * b AS over FROM m WHERE a IS NOT NULL AND b IS NOT NULL""")
def metric_delta_guardrail(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value")).withColumn("repo", F.lit("all"))
    out = evaluation.deltas(side(0), side(1))
    return out.select("metric", _R("before").alias("before"), _R("after").alias("after"), _R("delta").alias("delta"), (F.col("after") > 1.01 * F.col("before")).alias("over"))


@query(f"""WITH {_SPANS}, m AS (SELECT l_orderkey AS key, start_line AS s, end_line AS e, max(end_line) OVER (PARTITION BY l_orderkey ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM spans),
g AS (SELECT key, s, e, sum(CASE WHEN s <= p + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT key, min(s) AS start, max(e) AS "end" FROM g GROUP BY key, g""")
def interval_merge(spark, sf_dir):
    r = order_chunks(spark, sf_dir).select(F.col("l_orderkey").alias("key"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return evaluation.merged_ranges(r, "key")


@query("""WITH r AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, least(length(text), 4000) AS c FROM documents),
b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r)
SELECT query_id, rank, CAST(least(c, 24000 - used) AS BIGINT) AS chars, CAST(used AS BIGINT) AS used FROM b WHERE used < 24000""")
def prompt_budget_running_sum(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"), F.col("text").alias("content"))
    return retrieval.prompt_budget(d).select("query_id", "rank", F.col("chars").cast("long").alias("chars"), F.col("used").cast("long").alias("used"))


# ---- planning and contribution


@query("""WITH o AS (SELECT p_partkey, p_brand AS repo_id, CASE p_size % 3 WHEN 0 THEN 'A_issue' WHEN 1 THEN 'B_quality' ELSE 'C_suspicion' END AS lane, p_name || p_partkey AS title, CASE p_size % 2 WHEN 0 THEN 'M' ELSE 'S' END AS difficulty,
  (p_size % 10) / 10.0 AS m, (p_size % 7) / 10.0 AS a, (p_size % 5) / 10.0 AS e FROM part),
s AS (SELECT *, 0.4 * m + 0.35 * a + 0.25 * e + CASE lane WHEN 'A_issue' THEN 0.34 ELSE 0.33 END AS score FROM o)
SELECT p_partkey, round(CAST(score AS DOUBLE), 6) AS score, row_number() OVER (PARTITION BY repo_id ORDER BY round(CAST(score AS DOUBLE), 9) DESC, difficulty, lane, title) AS rank FROM s""")
def opportunity_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lane = F.when(F.col("p_size") % 3 == 0, "A_issue").when(F.col("p_size") % 3 == 1, "B_quality").otherwise("C_suspicion")
    tenth = lambda n: F.round((F.col("p_size") % n) / 10.0, 1)
    o = p.select("p_partkey", F.col("p_brand").alias("repo_id"), lane.alias("lane"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("title"), F.when(F.col("p_size") % 2 == 0, "M").otherwise("S").alias("difficulty"), tenth(10).alias("mergeability"), tenth(7).alias("approachability"), tenth(5).alias("evidence_strength"))
    ranked = contribute.rank_opportunities(o, partition="repo_id")
    exact = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.round("score", 9).desc(), "difficulty", "lane", "title"))
    return ranked.withColumn("rank", exact).select("p_partkey", _R("score").alias("score"), "rank")


@query("SELECT p_partkey, round(greatest(0, least(1, 0.85 - least(p_size, 40) / 40 - least(p_size % 30, 20) / 40 + CASE WHEN p_size % 2 = 0 THEN 0.15 ELSE 0 END)), 6)::DOUBLE AS score FROM part")
def approachability(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", _R(scalar.approachability(size, size % 30, size % 2 == 0)).alias("score"))


@query("""SELECT conv_id, turn, CASE WHEN contains(t, 'compare') OR contains(t, 'difference') OR contains(t, 'versus') OR contains(t, ' vs ') THEN 'compare' WHEN contains(t, 'where') OR contains(t, 'located') OR contains(t, 'defined') THEN 'where_is'
WHEN contains(t, 'flow') OR contains(t, 'trace') OR contains(t, 'call') OR contains(t, 'through') OR contains(t, 'lifecycle') THEN 'architectural' WHEN contains(t, 'how') OR contains(t, 'steps') OR contains(t, 'process') THEN 'procedural' ELSE 'factual' END AS intent,
contains(t, 'how does') OR contains(t, 'flow') OR contains(t, 'trace') OR contains(t, 'from ') OR contains(t, 'through') OR contains(t, 'interact') OR contains(t, 'between') OR contains(t, 'end to end') AS multi_hop FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)""")
def question_intent(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.intent_class(F.col("text")).alias("intent"), text.is_multi_hop(F.col("text")).alias("multi_hop"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CASE WHEN ends_with(url, '/') THEN 'folder' ELSE 'file' END AS kind, sha256(url) AS key FROM pages")
def page_addresses(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.when(F.col("url").endswith("/"), "folder").otherwise("file").alias("kind"), F.sha2("url", 256).alias("key"))


@query("""WITH t AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}') AS w FROM documents)),
f AS (SELECT doc_id, arg_min(w, i) AS w, min(i) AS i FROM t GROUP BY doc_id, lower(w)),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f) WHERE r <= 12 GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END AS tokens, coalesce(words, '') AS words FROM documents LEFT JOIN k USING (doc_id)""")
def keyword_heads(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), F.array_join(text.keywords(F.col("text")), " ").alias("words"))


@query("SELECT doc_id, source || '/' || doc_id || '.txt' AS path, 1 AS s, length(text) - length(replace(text, chr(10), '')) + 1 AS e FROM documents")
def chunk_id_codec(spark, sf_dir):
    c = document_chunks(spark, sf_dir)
    code = scalar.encode_ref(F.lit("o/n@1"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("symbol"))
    back = c.select("chunk_id", code.alias("code")).select("chunk_id", scalar.decode_ref(F.col("code")).alias("x"))
    return back.select(F.col("chunk_id").alias("doc_id"), F.col("x.f").alias("path"), F.col("x.s").alias("s"), F.col("x.e").alias("e"))


# ---- operators without an SQL form


@query()
def mmr_select(spark, sf_dir):
    qs = questions(spark, sf_dir)
    hits = retrieval.nearest_batch(table(spark, sf_dir, "embeddings"), qs, 50)
    pool = hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").withColumnRenamed("vec_id", "chunk_id")
    return retrieval.rerank(pool, qs, 8)


@query()
def paired_bootstrap(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    pairs = e.groupBy(F.col("event_type").alias("metric"), F.col("user_id").alias("case_id")).agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("before"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("after"))
    return evaluation.bootstrap(pairs.dropna())


@query()
def text_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.lit("text").alias("language"), "text")
    return files.text_windows(d, max_lines=20, max_chars=6000, overlap=2)


_PLACES = """pairs AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
ways AS MATERIALIZED (SELECT a AS src, b AS dst FROM pairs UNION SELECT b, a FROM pairs), ends AS MATERIALIZED (SELECT src AS symbol, count(*) AS n FROM ways GROUP BY 1),
l0 AS MATERIALIZED (SELECT symbol, arg_min(other, {'n': -n, 'o': other}) AS community FROM (SELECT src AS symbol, dst AS other, n FROM ways JOIN ends ON symbol = dst UNION ALL SELECT symbol, symbol, n FROM ends) GROUP BY symbol)"""
_ROUND = """l{1} AS MATERIALIZED (SELECT symbol, arg_min(community, {{'n': -n, 'c': community}}) AS community FROM (SELECT symbol, community, sum(n) AS n FROM
  (SELECT src AS symbol, community, count(*) AS n FROM ways JOIN l{0} l ON l.symbol = dst GROUP BY ALL UNION ALL SELECT symbol, community, 1 FROM l{0}) GROUP BY ALL) GROUP BY symbol)"""


@query("WITH " + ", ".join([_PLACES, *[_ROUND.format(k, k + 1) for k in range(10)]]) + " SELECT symbol, community FROM l10")
def communities(spark, sf_dir):
    return graph.communities(place_edges(spark, sf_dir))


@query(f"WITH {_CHUNKS}, {_QUESTIONS}, {_TERMS}, {_POSTINGS}, {_SPARSE} SELECT query_id, rank, chunk_id, score FROM sparse WHERE rank <= 50")
def stored_keyword_rank(spark, sf_dir):
    """The keyword ranking from blocks of postings on disk, skipping what cannot win."""
    root = fresh_folder(spark, "stored-index")
    stored_index.write(document_chunks(spark, sf_dir), root)
    top = stored_index.StoredIndex(spark, root).top_k(questions(spark, sf_dir), 50)
    return top.select("query_id", "rank", F.col("id").alias("chunk_id"), _R("score").alias("score"))


_SPOTS = """spots AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""
_REGIONS = """near AS (SELECT src, dst FROM spots UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
  homes AS (SELECT 'n' || n_nationkey AS symbol, 'r' || n_regionkey AS community FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION ALL SELECT src, 'r' || n_regionkey FROM spots JOIN nation ON dst = 'n' || n_nationkey)"""


def _homes(spark, sf_dir) -> DataFrame:
    """Places labelled by their region."""
    edges, n = place_edges(spark, sf_dir), table(spark, sf_dir, "nation")
    label = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("community"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("symbol")).withColumn("community", F.col("symbol"))
    return edges.join(label, "dst").select(F.col("src").alias("symbol"), "community").unionByName(label.select(F.col("dst").alias("symbol"), "community")).unionByName(regions)


@query(f"WITH {_SPOTS} SELECT symbol, min(symbol) OVER (PARTITION BY dst) AS community FROM (SELECT src AS symbol, dst FROM spots UNION SELECT dst, dst FROM spots)")
def louvain_communities(spark, sf_dir):
    """Customers and suppliers around their nations: each nation is one community."""
    return layered.louvain(place_edges(spark, sf_dir).where(F.col("dst").startswith("n")))


@query(f"""WITH {_SPOTS}, {_REGIONS}, e AS (SELECT a.community AS x, b.community AS y FROM near JOIN homes a ON a.symbol = src JOIN homes b ON b.symbol = dst),
d AS (SELECT c, count(*) AS ends FROM (SELECT x AS c FROM e UNION ALL SELECT y FROM e) GROUP BY c)
SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM d) AS communities, round((SELECT count(*) FILTER (x = y) / count(*) FROM e) - (SELECT sum(ends * ends) FROM d) / (4.0 * (SELECT count(*) FROM e) ** 2), 9) AS modularity""")
def community_modularity(spark, sf_dir):
    return layered.modularity(place_edges(spark, sf_dir), _homes(spark, sf_dir)).withColumn("modularity", _R("modularity", 9))


@query(f"""WITH {_SPOTS}, {_REGIONS}, d AS (SELECT symbol, count(*) AS degree FROM (SELECT src AS symbol FROM near UNION ALL SELECT dst FROM near) GROUP BY symbol),
r AS (SELECT community, count(*) OVER (PARTITION BY community) AS size, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, symbol) AS rank, symbol, coalesce(degree, 0) AS degree FROM homes LEFT JOIN d USING (symbol))
SELECT * FROM r WHERE rank <= 4""")
def community_layers(spark, sf_dir):
    return layered.layers(_homes(spark, sf_dir), place_edges(spark, sf_dir), 4)


_RAW_TEXT = "CASE conv_id % 7 WHEN 0 THEN concat(text, ' issue') WHEN 1 THEN concat(text, ' the Flow') WHEN 2 THEN concat(text, ' an audit pr') WHEN 3 THEN concat('hunt ', text) WHEN 4 THEN concat(text, ' versus') WHEN 5 THEN concat(text, ' storage policy') ELSE text END AS raw_text"
_SHARES = ["(conv_id % 10) / 10.0 AS understand", "((conv_id * 3 + turn) % 10) / 10.0 AS change", "((conv_id * 7) % 10) / 10.0 AS evaluate", "((turn * 3) % 10) / 10.0 AS locate", "((conv_id + turn) % 5) / 10.0 AS compare"]


@query(f"""WITH p AS (SELECT conv_id, turn, {_RAW_TEXT}, {', '.join(_SHARES)}, conv_id % 3 AS k FROM conversations),
q AS (SELECT *, lower(raw_text) AS raw, lower(raw_text) || CASE k WHEN 1 THEN ' latency' WHEN 2 THEN ' hot path tour' ELSE ' ' END AS hay FROM p),
r AS (SELECT *, contains(raw, 'fragile') OR contains(raw, 'problem') OR contains(raw, 'audit') OR contains(raw, 'security') OR contains(raw, 'vulnerab') AS fragile, contains(raw, 'issue') OR list_contains(regexp_split_to_array(raw, '\\s+'), 'pr') AS issue FROM q),
f AS (SELECT *, list_filter([CASE WHEN understand >= 0.2 OR evaluate >= 0.2 OR locate >= 0.3 OR k > 0 THEN 'cartographer' END, CASE WHEN understand >= 0.4 OR contains(raw, 'lifecycle') OR contains(raw, 'flow') THEN 'flow_tracer' END, CASE WHEN change >= 0.4 AND issue THEN 'lane_a_issue_triage' END,
  CASE WHEN change >= 0.3 OR evaluate >= 0.4 THEN 'lane_b_code_health' END, CASE WHEN change >= 0.3 AND (fragile OR contains(raw, 'hunt')) THEN 'lane_c_suspicion' END], lambda x: x IS NOT NULL) AS fired FROM r),
u AS (SELECT *, CASE WHEN len(fired) = 0 THEN ['cartographer', 'lane_b_code_health'] ELSE fired END AS up FROM f)
SELECT conv_id, turn, array_to_string(up, ',') || ',teacher' AS active,
CASE WHEN compare >= 0.3 OR contains(raw, 'compare') OR contains(raw, 'vs ') OR contains(raw, 'versus') THEN 'comparison_table' WHEN len(list_filter(up, lambda x: starts_with(x, 'lane_'))) > 0 THEN 'ranked_list' WHEN contains(raw, 'audit') OR contains(raw, 'decision') OR contains(raw, 'dossier') THEN 'dossier' ELSE 'narrative' END AS output_shape,
CASE WHEN NOT list_contains(up, 'cartographer') THEN NULL WHEN regexp_matches(hay, 'data|schema|model|table|storage') THEN 'data_hubs' WHEN regexp_matches(hay, 'decision|strategy|tradeoff|policy') THEN 'decision_hubs' WHEN regexp_matches(hay, 'latency|throughput|hot path|performance|perf') THEN 'hot_path' ELSE 'balanced' END AS cartographer_tilt,
CASE WHEN NOT list_contains(up, 'lane_b_code_health') THEN NULL WHEN len(fired) > 0 AND evaluate > change THEN 'tradeoffs_visible_in_code' ELSE 'cleanup_opportunities' END AS lane_b_framing FROM u""")
def capability_plan(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", _RAW_TEXT, *_SHARES)
    kinds = ("understand", "change", "evaluate", "locate", "compare")
    weights = F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k).cast("double"))])
    words = F.when(F.col("conv_id") % 3 == 1, F.array(F.lit("Latency"))).when(F.col("conv_id") % 3 == 2, F.array(F.lit("hot path"), F.lit("tour"))).otherwise(F.array().cast("array<string>"))
    profiles = c.select("conv_id", "turn", "raw_text", weights.alias("modality_weights"), words.alias("focus_keywords"), F.lit("unspecified").alias("output_shape_preference"))
    return contribute.plan(profiles).select("conv_id", "turn", F.array_join("active", ",").alias("active"), "output_shape", "cartographer_tilt", "lane_b_framing")


def _own_sources(spark) -> DataFrame:
    """This package's own sources, read through Spark, as a corpus of code."""
    from pathlib import Path

    found = files.readable(files.discover(files.scan(spark, str(Path(__file__).resolve().parents[1]), glob="*.py")), max_line=100_000)
    return python_code.name_modules(found)


@query()
def parse_python_chunks(spark, sf_dir):
    return python_code.code_chunks(_own_sources(spark)).select("file_path", "symbol", "kind", "start_line", "end_line", "signature")


@query()
def python_symbol_graph(spark, sf_dir):
    return python_code.code_graph(_own_sources(spark))[1]


@query()
def symbol_complexity(spark, sf_dir):
    @F.pandas_udf("int")
    def points(content):
        return content.map(python_code.cyclomatic).astype("int32")

    return python_code.code_chunks(_own_sources(spark)).where("kind <> 'module'").select("symbol", "start_line", points("content").alias("cyclomatic"))
