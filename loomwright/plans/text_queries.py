"""Registered queries of text functions, prompts, replies, answers, rates and snapshot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, text
from ..functions.constants import FACT_ENTRIES, FACT_HEAD, FACT_HUBS, NO_ENTRIES, NO_ENTRY_NAMES, NO_HUB_NAMES, NO_HUBS
from ..operators import answer, contribute, evaluation, filters, graph, ledger, retrieval
from ..sources import labelled, tables
from ..storage import fresh_folder
from . import evaluate
from .queries import _CHUNKS, _EDGES, _LEXICAL, _POSTINGS, _R, _SPARSE, _TERMS, _TOKENS, _TWO_LANES, _lanes, query
from .views import document_chunks, place_edges, table, trade_edges

_NL = "chr(10)"
_LINES = f"CASE WHEN {{0}} = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace({{0}}, '\\n\\z', ''), {_NL}) END"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


# ---- text and templates


@query(f"""WITH c AS (SELECT doc_id, text, lang, source, source || '.Unit.f' || doc_id AS symbol, CASE doc_id % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'function' ELSE 'class' END AS kind FROM documents)
SELECT doc_id, sha256(concat_ws({_NL}, CASE WHEN kind = 'method' THEN '# class: Unit' END, '# symbol: ' || symbol, '# kind: ' || kind, CASE WHEN doc_id % 2 = 0 THEN '# decorators: ' || lang || ', cached' END,
  CASE WHEN kind <> 'class' THEN '# signature: def f(' || doc_id || '):' END, '# neighbors: ' || source || ', b, c, d, e', CASE WHEN doc_id % 5 > 0 THEN '# docstring keywords: ' || lang END, text)) AS enriched,
sha256('passage: # file: ' || source || {_NL} || '# symbol: ' || symbol || {_NL} || text) AS embedded, sha256(CASE WHEN doc_id % 7 = 0 THEN text ELSE symbol || {_NL} || text END) AS reranked FROM c""")
def prompt_texts(spark, sf_dir):
    symbol = F.concat("source", F.lit(".Unit.f"), F.col("doc_id").cast("string"))
    c = table(spark, sf_dir, "documents").withColumn("symbol", symbol).withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "method").when(F.col("doc_id") % 3 == 1, "function").otherwise("class"))
    signature = F.when(F.col("kind") != "class", F.concat(F.lit(" def   f("), F.col("doc_id").cast("string"), F.lit("):\n ")))
    enriched = text.enriched_text(F.col("symbol"), F.col("kind"), signature, F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.lit("cached"))), F.when(F.col("doc_id") % 5 > 0, F.array("lang")), F.array("source", *map(F.lit, "bcdef")), F.col("text"))
    return c.select("doc_id", F.sha2(enriched, 256).alias("enriched"), F.sha2(text.embedding_text("passage: ", F.col("source"), F.col("symbol"), F.col("text")), 256).alias("embedded"),
        F.sha2(text.rerank_text(F.when(F.col("doc_id") % 7 > 0, F.col("symbol")), F.col("text")), 256).alias("reranked"))


_URLS = "CASE c_custkey % 6 WHEN 0 THEN 'https://github.com/o-' || c_nationkey || '/' || c_mktsegment || '.git' WHEN 1 THEN ' http://github.com/o.x/n_' || c_custkey || '/ ' WHEN 2 THEN 'https://github.com/o/n?tab=' || c_custkey WHEN 3 THEN 'https://gitlab.com/o/n' WHEN 4 THEN 'https://github.com/o/n' || c_custkey ELSE 'https://github.com/o/n/tree' END"


@query(f"""WITH u AS (SELECT c_custkey, c_custkey % 6 AS m, {_URLS} AS url FROM customer),
p AS (SELECT c_custkey, url, CASE m WHEN 0 THEN split_part(url, '/', 4) WHEN 1 THEN 'o.x' WHEN 4 THEN 'o' END AS owner, CASE m WHEN 0 THEN split_part(replace(url, '.git', ''), '/', 5) WHEN 1 THEN 'n_' || c_custkey WHEN 4 THEN 'n' || c_custkey END AS name FROM u)
SELECT c_custkey, owner, name, owner || '/' || name || '@abc' AS repo, replace(replace(replace(owner || '/' || name || '@abc', '/', '%2F'), '@', '%40'), '#', '%23') AS slug, lower(url) LIKE '%/n' || c_custkey AS asked FROM p""")
def repo_addresses(spark, sf_dir):
    u = table(spark, sf_dir, "customer").withColumn("url", F.expr(_URLS))
    out = u.select("c_custkey", "url", text.repo_owner(F.col("url")).alias("owner"), text.repo_name(F.col("url")).alias("name"))
    out = out.withColumn("repo", text.repo_id(F.col("owner"), F.col("name"), F.lit("abc")))
    return out.select("c_custkey", "owner", "name", "repo", text.url_slug(F.col("repo")).alias("slug"), F.ilike("url", F.concat(F.lit("%/n"), F.col("c_custkey").cast("string"))).alias("asked"))


@query(r"""WITH t AS (SELECT conv_id, turn, text, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '[?.! ]+$', '') AS s, regexp_replace(regexp_replace(left(regexp_replace(text, '[^\p{L}\p{N}]', '-', 'g'), 40), '^-+', ''), '-+$', '') AS slug FROM conversations)
SELECT conv_id, turn, CASE WHEN length(s) > 48 THEN rtrim(left(s, 48), ' ') || '…' ELSE s END AS title, CASE WHEN slug = '' THEN 'tour' ELSE slug END || '-' || left(sha256(text), 12) AS tour FROM t""")
def titles_and_tours(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.chat_title(F.col("text")).alias("title"), text.tour_id(F.col("text"), F.col("text")).alias("tour"))


_MARKER = "chr(10) || '… (chunk truncated for prompt size)'"


@query(f"""WITH d AS (SELECT doc_id, source, text, {_LINES.format('text')} AS lines FROM documents),
v AS (SELECT *, list_filter(lines, lambda l, i: i + 9 BETWEEN 11 AND 12 OR i + 9 = 15) AS kept, list_transform(lines, lambda l, i: (i + 9) || ':' || l) AS numbered FROM d),
s AS (SELECT *, CASE WHEN len(kept) = 0 THEN text ELSE array_to_string(kept, {_NL}) END AS view FROM v)
SELECT doc_id, sha256(CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(left(text, 300), '\\n[^\\n]*\\z', '') || {_MARKER} END) AS cut,
sha256(CASE WHEN len(lines) = 0 THEN '10:' ELSE array_to_string(numbered, {_NL}) END) AS numbered, sha256(view) AS view,
sha256('Chunk [' || doc_id || ']:' || {_NL} || '<source file=' || source || ':10-' || (9 + len(lines)) || ' symbol=''x''>' || {_NL} || rtrim(view, ' ') || {_NL} || '</source>') AS block FROM s""")
def prompt_blocks(spark, sf_dir):
    d, body, start = table(spark, sf_dir, "documents"), F.col("text"), F.lit(10)
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((11, 12), (15, 15))])
    d = d.withColumn("view", text.span_view(body, start, spans)).withColumn("end", F.size(text.lines_of(body)) + 9)
    block = text.source_block(F.col("doc_id"), F.col("source"), start, F.col("end"), F.lit("x"), F.col("view"))
    return d.select("doc_id", *[F.sha2(c, 256).alias(n) for n, c in (("cut", text.truncate_lines(body, 300)), ("numbered", text.numbered_lines(body, start)), ("view", F.col("view")), ("block", block))])


_ANSWERS = "CASE WHEN turn % 4 = 2 THEN concat('# Head\n', 'I could not find it.') ELSE concat('<think>', left(text, 9), '</think># Head\n- ', replace(text, '. ', ' [1][2].\n• '), '\n-\n<think>open') END"


@query(f"""WITH a AS (SELECT conv_id, turn, {_ANSWERS.replace(chr(10), "' || chr(10) || '")} AS raw FROM conversations),
s AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', ''), ' ') AS t FROM a),
l AS (SELECT conv_id, turn, t, unnest(string_split(t, {_NL})) AS x, generate_subscripts(string_split(t, {_NL}), 1) - 1 AS line FROM s),
r AS (SELECT conv_id, turn, line, trim(trim(x, ' '), ' -•') AS x FROM l WHERE NOT starts_with(trim(x, ' '), '#') AND trim(trim(x, ' '), ' -•') <> ''),
c AS (SELECT *, trim(regexp_replace(x, '\\s*\\[\\d+\\]\\s*', '', 'g'), ' ') AS clean FROM r)
SELECT conv_id, turn, CAST(line AS INT) AS line, CASE WHEN clean = '' THEN x ELSE clean END AS text, array_to_string(regexp_extract_all(x, '\\[(\\d+)\\]', 1), ',') AS citations, turn % 4 = 2 AS not_found FROM c""")
def answer_claims(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_reasoning(F.expr(_ANSWERS)).alias("answer"))
    c = a.select("conv_id", "turn", text.is_not_found(F.col("answer")).alias("not_found"), F.explode(text.claim_lines(F.col("answer"))).alias("c"))
    return c.select("conv_id", "turn", F.col("c.line").alias("line"), F.col("c.text").alias("text"), F.array_join(F.col("c.citations").cast("array<string>"), ",").alias("citations"), "not_found")


_HINTED = "CASE WHEN conv_id % 4 = 0 THEN concat('where is `./src/app', conv_id, '.py` and `mod.fn_', turn, '` in docs/x.go') WHEN conv_id % 4 = 1 THEN concat('where is `src/a', conv_id, '` defined') WHEN conv_id % 4 = 2 THEN concat('how do a.py and `a.py` and `some_name` ', conv_id) ELSE 'tests for usage, `plain`' END"
_HINT = text.path_hint_pattern()


@query(f"""WITH q AS (SELECT conv_id, turn, {_HINTED} AS q FROM conversations),
t AS (SELECT *, regexp_extract_all(q, '`([^`]+)`', 1) AS ticks FROM q),
h AS (SELECT *, list_concat(list_filter(ticks, lambda h: contains(h, '/') OR regexp_matches(h, '^(?:{_HINT})$')), regexp_extract_all(q, '{_HINT}')) AS p, list_filter(ticks, lambda h: NOT (contains(h, '/') OR regexp_matches(h, '^(?:{_HINT})$')) AND (contains(h, '.') OR contains(h, '_'))) AS s FROM t),
o AS (SELECT conv_id, turn, q, {_FIRST.format('p')} AS p, {_FIRST.format('s')} AS s FROM h)
SELECT conv_id, turn, array_to_string(p, ',') AS paths, array_to_string(s, ',') AS symbols, array_to_string(list_transform(p, lambda x: regexp_replace(x, '^\\./', '')), ',') AS bare,
q || CASE WHEN conv_id % 2 = 0 THEN ' other.name' ELSE '' END AS lexical, CASE WHEN conv_id % 4 = 1 THEN 'src/a' || conv_id || '/' END AS prefix, CASE WHEN conv_id % 4 = 3 THEN 'docs/,docs_src/,scripts/' ELSE 'tests/,examples/,docs/,docs_src/,scripts/' END AS excluded FROM o""")
def question_hints(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_HINTED).alias("q"))
    q = q.withColumn("p", text.hinted_paths(F.col("q"))).withColumn("s", text.hinted_symbols(F.col("q")))
    symbols = F.concat("s", F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("other.name"))).otherwise(F.array().cast("array<string>")))
    prefix = filters.single_path_prefix(text.intent_class(F.col("q")), text.is_multi_hop(F.col("q")), F.col("p"))
    words = F.when(F.col("conv_id") % 4 == 3, F.array(F.lit("Tests, usage"))).otherwise(F.array(F.lit("speed")))
    return q.select("conv_id", "turn", F.array_join("p", ",").alias("paths"), F.array_join("s", ",").alias("symbols"), F.array_join(F.transform("p", text.normalise_path), ",").alias("bare"), text.lexical_query(F.col("q"), symbols).alias("lexical"), prefix.alias("prefix"), F.array_join(filters.exclusions_column(words), ",").alias("excluded"))


@query("""SELECT doc_id, doc_id % 3 < 2 AS placeholder, lang || ' ' || source || '.f in ' || source || '/x (summary unavailable)' AS fallback,
contains(lower(text), lower(lang)) AND contains(lower(text), 'the') AS all_words, doc_id % 4 = 0 OR contains(lower(text), lower(lang)) OR contains(lower(text), 'the') AS any_word,
CASE WHEN doc_id % 4 = 0 THEN 'BROKEN' WHEN doc_id % 4 = 1 THEN 'will  crash' END AS overclaim FROM documents""")
def summary_and_wording(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    summary = F.when(F.col("doc_id") % 3 == 1, F.concat("lang", F.lit(" (summary unavailable)"))).when(F.col("doc_id") % 3 == 2, F.col("lang"))
    words = F.array(F.upper("lang"), F.lit("THE"))
    said = F.when(F.col("doc_id") % 4 == 0, "It is BROKEN.").when(F.col("doc_id") % 4 == 1, "this will  crash, a bug").otherwise("debugging unbroken")
    return d.select("doc_id", text.is_placeholder_summary(summary).alias("placeholder"), text.fallback_summary(F.concat("source", F.lit(".f")), F.col("lang"), F.concat("source", F.lit("/x"))).alias("fallback"),
        text.contains_all(F.col("text"), words).alias("all_words"), text.contains_any(F.col("text"), F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(words)).alias("any_word"), text.overclaim(said).alias("overclaim"))


_PATHS = "concat('src\\\\', p_brand, '/mod_', p_partkey, element_at(array('.py', '.go', '.tsx', '/README.md', '/Dockerfile', '.unknown', '/requirements-dev.txt'), cast(p_partkey % 7 as int) + 1))"


@query(r"""WITH p AS (SELECT p_partkey, p_brand, 'src.' || p_brand || '.mod_' || p_partkey || ['', '.go', '.tsx', '.README.md', '.Dockerfile', '.unknown', '.requirements-dev.txt'][p_partkey % 7 + 1] AS symbol FROM part)
SELECT p_partkey, symbol, regexp_extract(symbol, '[^.]*$') AS label, [NULL, 'go', 'typescript', 'markdown', 'dockerfile', NULL, 'requirements'][p_partkey % 7 + 1] AS language, 'go:' || p_brand || ':' || p_partkey AS win FROM p""")
def path_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("path", F.expr(_PATHS))
    symbol = text.module_symbol(F.col("path"))
    return p.select("p_partkey", symbol.alias("symbol"), text.short_name(symbol).alias("label"), text.language_of(F.translate("path", "\\", "/")).alias("language"), text.window_symbol(F.lit("go"), F.col("p_brand"), F.col("p_partkey")).alias("win"))


@query(f"""SELECT r_name, 'Indexed snapshot across ' || count(*) || ' files and ' || sum(n_nationkey) || ' lines. Primary entry points: ' || CASE WHEN r_regionkey = 0 THEN '{NO_ENTRY_NAMES}' ELSE string_agg(n_name, ', ' ORDER BY n_name) END
|| '. Structural hubs: ' || CASE WHEN r_regionkey = 1 THEN '{NO_HUB_NAMES}' ELSE 'hub' || r_regionkey END || '.' AS said,
concat_ws({_NL}, '{FACT_HEAD}', '', '{FACT_HUBS}', CASE WHEN r_regionkey = 1 THEN '{NO_HUBS}' ELSE '  - a.hub' || r_regionkey || ' (callers=' || count(*) || ')' || CASE WHEN r_regionkey = 2 THEN '' ELSE '  fan_in=' || count(*) || ' fan_out=' || r_regionkey || ' cyclomatic=3' END END, '',
'{FACT_ENTRIES}', CASE WHEN r_regionkey = 0 THEN '{NO_ENTRIES}' ELSE '  - ' || string_agg('x.' || n_name, {_NL} || '  - ' ORDER BY n_name) END) AS facts FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name""")
def snapshot_impressions(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name")
    n = n.agg(F.count(F.lit(1)).alias("files"), F.sum("n_nationkey").alias("lines"), F.array_sort(F.collect_list(F.concat(F.lit("x."), F.col("n_name")))).alias("names"))
    empty, region = F.array().cast("array<string>"), F.col("r_regionkey")
    hub = F.concat(F.lit("a.hub"), region.cast("string"))
    known = lambda c: F.when(region != 2, c.cast("long"))
    facts = F.filter(F.array(F.struct(hub.alias("symbol"), F.col("files").alias("score"), known(F.col("files")).alias("fan_in"), known(region).alias("fan_out"), known(F.lit(3)).alias("cyclomatic"))), lambda h: region != 1)
    entries = F.when(region == 0, empty).otherwise(F.col("names"))
    return n.select("r_name", text.first_impression(F.col("files"), F.col("lines"), F.when(region == 1, empty).otherwise(F.array(hub)), entries).alias("said"), answer.fact_bundle(facts, entries).alias("facts"))


# ---- replies, headers, profiles


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' WHEN 2 THEN 'verified' END AS verdict, CASE event_id % 3 WHEN 0 THEN CAST(event_id % 90 AS DOUBLE) WHEN 1 THEN greatest(0.0, 50.0 - event_id % 100) ELSE 0.0 END AS wait,
'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame, event_type AS event, props AS data, sha256('{"event":"' || event_type || '","n":' || event_id || ',"x":null}') AS key, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events""")
def replies_and_frames(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    reply = F.when(k % 5 == 0, 'so {"decision": "maybe"} but {"decision": "verified"} {"decision": "rejected"}').when(k % 5 == 1, '{"decision": "rejected", "why": {"a": 1}}').when(k % 5 == 2, '```json\n{"x": 1}\n{"decision": "verified"}```').when(k % 5 == 3, "no object { at all")
    date = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(k % 3 == 0, (k % 90).cast("string")).when(k % 3 == 1, date).otherwise("soon")
    now = (F.col("ts").cast("timestamp").cast("long") + k % 100 - 50).cast("timestamp")
    frame = text.sse_frame(F.col("event_type"), F.col("props"))
    e = e.select("event_id", scalar.verdict(reply, ["verified", "rejected"]).alias("verdict"), text.retry_after_seconds(header, now).alias("wait"), frame.alias("frame"), text.parse_sse(frame).alias("sse"), scalar.cache_key(F.col("event_type").alias("event"), k.alias("n"), F.lit(None).cast("string").alias("x")).alias("key"), scalar.utc_stamp(F.col("ts")).alias("stamp"))
    return e.select("event_id", "verdict", "wait", "frame", "sse.event", "sse.data", "key", "stamp")


@query("""WITH w AS (SELECT conv_id, turn, text, greatest(0, least(1, (conv_id % 13) / 5.0 - 0.4))::DOUBLE AS u, greatest(0, least(1, (turn % 7) / 10.0))::DOUBLE AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN u > c THEN printf('understand=%.2f, change=%.2f', u, c) ELSE printf('change=%.2f, understand=%.2f', c, u) END AS weights, CASE WHEN u > c THEN 'understand' ELSE 'change' END AS dominant, 'role,two words,c,d,e,f' AS words FROM w""")
def clean_profiles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    raw = F.create_map(F.lit("understand"), F.round((F.col("conv_id") % 13) / 5.0 - 0.4, 1), F.lit("change"), F.round((F.col("turn") % 7) / 10.0, 1), F.lit("junk"), F.lit(9.0))
    words = F.array(F.lit(" Role "), F.lit(None).cast("string"), F.lit(" "), F.lit("Two Words"), *map(F.lit, "cdefgh"))
    c = c.withColumn("w", scalar.clean_weights(raw, ["understand", "change"]))
    return c.select("conv_id", "turn", text.weighted_terms(F.col("w")).alias("weights"), scalar.dominant_key(F.col("w")).alias("dominant"), F.array_join(scalar.clean_keywords(words), ",").alias("words"))


_KEEP = "concat('Sure: {\"keep\": [[', doc_id % 9, ', ', 4 + doc_id % 9, '], [', 2 + doc_id % 17, ', ', 6 + doc_id % 17, ']]}')"


@query(f"""WITH d AS (SELECT doc_id, len({_LINES.format('text')}) AS n, doc_id % 9 AS a, 4 + doc_id % 9 AS b, 2 + doc_id % 17 AS c, 6 + doc_id % 17 AS e FROM documents),
r AS (SELECT doc_id, n, unnest([{{'s': greatest(a, 3), 'e': least(b, n + 2)}}, {{'s': greatest(c, 3), 'e': least(e, n + 2)}}]) AS r FROM d WHERE n >= 15 AND doc_id % 6 <> 0 AND doc_id % 11 <> 0),
p AS (SELECT doc_id, list(r ORDER BY r) AS l FROM r WHERE r.e >= r.s GROUP BY doc_id),
k AS (SELECT doc_id, CASE WHEN len(l) = 1 THEN l[1].s || '-' || l[1].e WHEN l[2].s <= l[1].e + 1 THEN l[1].s || '-' || greatest(l[1].e, l[2].e) ELSE l[1].s || '-' || l[1].e || ',' || l[2].s || '-' || l[2].e END AS kept FROM p)
SELECT doc_id, kept FROM documents LEFT JOIN k USING (doc_id)""")
def compressed_chunks(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    reply = F.when(k % 11 == 0, "nothing to keep").otherwise(F.expr(_KEEP))
    chunks = d.select("doc_id", F.when(k % 6 == 0, "module").otherwise("function").alias("kind"), F.col("text").alias("content"), F.lit(3).alias("start_line"), (F.size(text.lines_of(F.col("text"))) + 2).alias("end_line"), reply.alias("reply"))
    shown = F.transform("kept_line_spans", lambda s: F.format_string("%d-%d", s["start"], s["end"]))
    return answer.compressed(chunks).select("doc_id", F.array_join(shown, ",").alias("kept"))


# ---- references, sections, tours


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'part' || l_partkey ELSE 's' || l_suppkey END AS file_path, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_linenumber END AS start_line, CASE WHEN l_partkey % 3 = 0 THEN 1 + p_size ELSE CAST(l_quantity AS INT) END AS end_line
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey % 3 = 0 OR (l_suppkey % 4 <> 0 AND CAST(l_quantity AS INT) >= l_linenumber)""")
def coerced_refs(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    name = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    refs = li.select(F.lit(0).alias("repo_id"), "l_orderkey", "l_linenumber", name.alias("symbol"), F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("file_path"), F.col("l_linenumber").alias("start_line"), F.col("l_quantity").cast("int").alias("end_line"))
    key = F.col("p_partkey").cast("string")
    allowed = p.select(F.lit(0).alias("repo_id"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("p"), key).alias("symbol"), F.concat(F.lit("part"), key).alias("file_path"), F.lit(1).alias("start_line"), (1 + F.col("p_size")).alias("end_line"))
    return answer.coerce_refs(refs, allowed).select("l_orderkey", "l_linenumber", "file_path", "start_line", "end_line")


@query("""WITH s AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN turn WHEN 1 THEN 100 - turn ELSE turn END AS w FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY w, turn) - 1 AS "order" FROM s""")
def section_order(spark, sf_dir):
    order = F.when(F.col("turn") % 3 == 1, 100 - F.col("turn")).when(F.col("turn") % 3 == 2, F.lit(-1))
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", order.alias("order"))
    return answer.resequence(s, "conv_id", position="turn")


@query("""WITH c AS (SELECT l_orderkey AS claim_id, 's' || l_suppkey AS f, l_linenumber % 3 AS a, l_linenumber AS p, l_returnflag AS r FROM lineitem),
x AS (SELECT claim_id, f, a, min(p) AS p FROM c GROUP BY ALL HAVING NOT bool_or(r = 'R'))
SELECT * FROM (SELECT claim_id, f AS file_path, a AS start_line, row_number() OVER (PARTITION BY claim_id ORDER BY p, f, a) AS rank FROM x) WHERE rank <= 8""")
def recheck_context(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    line = (F.col("l_linenumber") % 3).alias("start_line")
    refs = li.select(F.col("l_orderkey").alias("claim_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file_path"), line, line.alias("end_line"), F.col("l_linenumber").alias("position"), "l_returnflag")
    return answer.recheck_refs(refs.where("l_returnflag = 'R'"), refs).drop("end_line")


@query("""WITH c AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 5 AS need FROM conversations), m AS (SELECT conv_id, least(2, max(need)) AS a FROM c GROUP BY conv_id)
SELECT conv_id AS section_id, turn AS claim_id, CASE WHEN need <= a THEN 'verified' WHEN need % 2 = 0 THEN 'flagged' ELSE 'unverified' END AS status, CASE WHEN need <= a THEN 'fine' WHEN need % 2 = 0 THEN 'no step' ELSE 'provider_error' END AS note FROM c JOIN m USING (conv_id)""")
def verified_sections(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("section_id"), F.col("turn").alias("claim_id"), ((F.col("conv_id") * 7 + F.col("turn")) % 5).alias("need"), F.lit(0).alias("tries"))
    short = F.col("need") > F.col("tries")
    odd = F.col("need") % 2 == 1
    ground = lambda df: df.withColumn("decision", F.when(short & odd, "rejected").otherwise("verified")).withColumn("reason", F.when(short & odd, "provider_error").otherwise("fine"))
    act = lambda df: df.withColumn("decision", F.when(short & ~odd, "not_actionable").otherwise("actionable")).withColumn("reason", F.lit("no step"))
    out = answer.verify_sections(c, ground, act, lambda df: df.withColumn("tries", F.col("tries") + 1))
    return out.select("section_id", "claim_id", "status", "note")


@query("""SELECT o_orderkey, count(CASE WHEN l_returnflag = 'R' THEN 1 END) = 0 OR bool_and(l_returnflag <> 'R' OR l_suppkey IN (SELECT l_suppkey FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_linestatus = 'O')) AS cited FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def refs_cited(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("wanted"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("cited"))
    return by.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", scalar.is_subset(F.col("wanted"), F.col("cited")).alias("cited"))


@query("""WITH l AS (SELECT conv_id, turn, text FROM conversations WHERE conv_id % 4 <> 1)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, sha256(text) AS text FROM l""")
def tour_log(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("text", F.sha2("text", 256))
    old = ledger.message_ordinals(c.where("turn < 2 AND conv_id % 3 <> 0"), "conv_id", "turn").select("conv_id", "ordinal", "text")
    new = c.where("turn >= 2 OR conv_id % 3 = 0")
    return answer.without_tours(answer.append_messages(old, new, "conv_id", "turn"), c.where("conv_id % 4 = 1"), "conv_id")


@query("SELECT o_custkey AS session_id, o_orderkey AS tour_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def recent_tours(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("tour_id"), F.col("o_orderdate").alias("updated_at"))
    return answer.recent_first(o, "tour_id").drop("updated_at")


# ---- graph


@query("""WITH t AS (SELECT n_nationkey AS k, 'c' || c_custkey AS s, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS target, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT k AS n_nationkey, target, unnest([s || '>n' || n, s || '>n' || n || '>r' || r]) AS path, unnest([1, 2]) AS rank FROM t WHERE target <= 5""")
def traced_paths(spark, sf_dir):
    e = place_edges(spark, sf_dir)
    targets = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("ordinal"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("symbol"))
    out = answer.traced(graph.paths(e, targets.select("symbol")), targets, "n_nationkey")
    return out.select("n_nationkey", "target", F.array_join("path", ">").alias("path"), "rank")


@query(f"""WITH {_EDGES}, e AS (SELECT DISTINCT * FROM edges), a AS (SELECT 's' || s_suppkey AS symbol, s_suppkey % 3 AS k, list_sort(coalesce((SELECT list(dst) FROM e WHERE src = 's' || s_suppkey AND type = 'calls'), [])) AS c, list_sort(coalesce((SELECT list(dst) FROM e WHERE src = 's' || s_suppkey AND type = 'inherits'), [])) AS i, list_sort(coalesce((SELECT list(dst) FROM e WHERE src = 's' || s_suppkey AND type = 'imports'), [])) AS m FROM supplier),
p AS (SELECT symbol, CASE k WHEN 0 THEN c WHEN 1 THEN list_concat(i, c) ELSE m END AS l FROM a)
SELECT symbol, array_to_string(list_slice({_FIRST.format('l')}, 1, 5), ',') AS near FROM p""")
def neighbour_caps(spark, sf_dir):
    k = F.col("s_suppkey")
    chunks = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("symbol"), F.when(k % 3 == 0, "function").when(k % 3 == 1, "class").otherwise("module").alias("kind"))
    return graph.neighbour_names(chunks, trade_edges(spark, sf_dir)).select("symbol", F.array_join("neighbor_symbols", ",").alias("near"))


# ---- evaluation and contribution


@query(f"WITH {_TWO_LANES} SELECT query_id, chunk_id, min({{'b': chunk_id % 3 = 0 OR (lane = 0 AND chunk_id % 2 = 1), 'l': lane, 'r': rank, 's': CASE WHEN chunk_id % 3 = 0 OR (lane = 0 AND chunk_id % 2 = 1) THEN NULL ELSE lane || ':' || rank END}}).s AS symbol FROM lanes WHERE rank <= 50 GROUP BY ALL")
def lane_representatives(spark, sf_dir):
    bare = (F.col("chunk_id") % 3 == 0) | ((F.col("lane") == 0) & (F.col("chunk_id") % 2 == 1))
    return retrieval.representative(_lanes(spark, sf_dir).withColumn("symbol", F.when(~bare, F.concat_ws(":", F.col("lane").cast("string"), F.col("rank").cast("string")))))


@query(f"WITH {_TWO_LANES}, p AS (SELECT * FROM lanes WHERE lane = 0 AND rank <= 50) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id % 3 <> 0, CASE WHEN chunk_id % 3 = 0 THEN -rank ELSE rank END) AS rank FROM p")
def reranked_with_tail(spark, sf_dir):
    pool = _lanes(spark, sf_dir).where("lane = 0")
    return retrieval.pool_with_tail(pool.where("chunk_id % 3 = 0").withColumn("rank", -F.col("rank")), pool)


_TERMS_OF = "list_distinct(list_transform(" + _TOKENS.format("text") + ", lambda x: lower(x)))"


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, {_TERMS_OF} AS s FROM conversations WHERE text IS NOT NULL),
p AS (SELECT a.conv_id, a.turn AS claim, b.turn AS chunk, CASE WHEN len(a.s) = 0 THEN 0.0 ELSE len(list_intersect(a.s, b.s)) / len(a.s) END AS score FROM t a JOIN t b USING (conv_id) WHERE a.role = 'assistant' AND b.role = 'user' AND trim(a.text, ' ') <> '')
SELECT conv_id, claim, chunk, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, claim ORDER BY score DESC, chunk) AS rank FROM p) WHERE rank <= 2""")
def attribution_top2(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    claims = c.where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("claim_id"), F.col("conv_id").alias("answer_id"), "text")
    chunks = c.where("role = 'user'").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("chunk_id"), F.col("text").alias("content"))
    return retrieval.attribute(claims, chunks).select(F.col("claim_id.conv_id").alias("conv_id"), F.col("claim_id.turn").alias("claim"), F.col("chunk_id").alias("chunk"), "rank")


_CASES = ("event_id % 4 AS claims", "least(event_id % 4, event_id % 3) AS verified", "event_id % 5 > 1 AS all_keywords", "event_id % 7 > 2 AS refs_cited", "event_type = 'error' AS not_in_repo", "event_id % 6 = 0 AS not_found", "event_id % 3 AS hops")


@query(f"""WITH c AS (SELECT {', '.join(_CASES)} FROM events)
SELECT count(*) AS total, round(avg((claims > 0 AND verified = claims)::INT), 6) AS grounded_all, round(sum(verified) / sum(claims), 6) AS claim_rate, round(avg(CASE WHEN NOT not_in_repo THEN all_keywords::INT END), 6) AS keyword_rate, round(avg(CASE WHEN NOT not_in_repo THEN refs_cited::INT END), 6) AS ref_rate,
round(avg(CASE WHEN not_in_repo THEN (NOT not_found)::INT END), 6) AS hallucination_rate, round(avg((hops > 0)::INT), 6) AS multi_hop_rate FROM c""")
def grounding_rates(spark, sf_dir):
    out = evaluation.grounding(table(spark, sf_dir, "events").selectExpr(*_CASES))
    return out.select("total", *[_R(c).alias(c) for c in out.columns[1:]])


@query("SELECT count(*) AS total, round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels")
def verdict_accuracy(spark, sf_dir):
    out = evaluation.accuracy(table(spark, sf_dir, "labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("actual")))
    return out.select("total", _R("accuracy").alias("accuracy"))


@query("SELECT count(*) AS total, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels")
def metric_means(spark, sf_dir):
    out = evaluation.means(table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return out.select("total", _R("quality").alias("quality"), _R("toxic").alias("toxic"))


@query("""WITH u AS (SELECT event_type, greatest(0, 50 - coalesce(value, 0) - event_id % 7) AS v FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM u)
SELECT event_type, round(max(CASE WHEN k = CAST(round_even(CAST(0.95 * (n - 1) AS DOUBLE), 0) AS BIGINT) + 1 THEN v END), 6) AS p95 FROM r GROUP BY event_type""")
def unaccounted_p95(spark, sf_dir):
    stages = F.create_map(F.lit("a"), F.coalesce("value", F.lit(0.0)), F.lit("b"), (F.col("event_id") % 7).cast("double"))
    t = evaluation.unaccounted(table(spark, sf_dir, "events").select("event_type", F.lit(50.0).alias("total_ms"), stages.alias("stages")))
    return evaluation.percentiles(t, "unaccounted_ms", (95,), ("event_type",)).select("event_type", _R("p95").alias("p95"))


@query("SELECT event_type AS model, CAST(sum(event_id % 50) AS BIGINT) AS prompt_tokens, CAST(sum(user_id) AS BIGINT) AS completion_tokens FROM events GROUP BY 1")
def token_counters(spark, sf_dir):
    return ledger.tokens_by_model(table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 50).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens")))


@query("""WITH c AS (SELECT p_partkey, ['dead_code', 'missing_docstring', 'long_function'][p_partkey % 3 + 1] AS detector, p_size AS i, p_partkey % 20 AS y FROM part)
SELECT 'f' || p_partkey AS file_path, CASE detector WHEN 'dead_code' THEN 'Dead Code in ' WHEN 'missing_docstring' THEN 'Missing Docstring in ' ELSE 'Long Function in ' END || CASE WHEN p_partkey % 2 = 0 THEN 'f' || p_partkey ELSE 'x' END AS title, CASE WHEN i >= 20 OR y >= 15 THEN 'L' WHEN i >= 8 OR y >= 8 THEN 'M' ELSE 'S' END AS difficulty, CASE WHEN i >= 10 THEN 'hub' ELSE 'isolated' END AS blast_radius,
CASE WHEN p_partkey % 5 = 0 THEN 0.8 ELSE 0.55 END::DOUBLE AS mergeability, round(greatest(0.1, 1 - least(i, 30) / 40), 6)::DOUBLE AS approachability, CASE WHEN detector = 'long_function' THEN 0.65 ELSE 0.75 END::DOUBLE AS evidence_strength FROM c WHERE NOT (detector = 'dead_code' AND p_partkey % 4 = 0) AND NOT (detector = 'missing_docstring' AND p_partkey % 7 <> 0)""")
def quality_lane(spark, sf_dir):
    k = F.col("p_partkey")
    detector = F.when(k % 3 == 0, "dead_code").when(k % 3 == 1, "missing_docstring").otherwise("long_function")
    c = table(spark, sf_dir, "part").select(detector.alias("detector"), F.when(k % 2 == 1, "x").alias("symbol"), F.concat(F.lit("f"), k.cast("string")).alias("file_path"), F.col("p_size").alias("fan_in"), (k % 20).alias("cyclomatic"), (k % 5 == 0).alias("has_tests"), (k % 4 == 0).alias("is_entry_point"), (k % 7 == 0).alias("is_public_api"))
    return contribute.quality_candidates(c).drop("lane").withColumn("approachability", _R("approachability"))


# ---- snapshots, caches, labels


_COVERED = "c AS (SELECT source, count(*) AS n, count(vec_id) AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source)"


@query(f"WITH {_COVERED} SELECT source AS repo_id, n AS n_chunks, e AS n_embedded, n = e AS whole, n > e AS stale FROM c")
def snapshot_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").alias("chunk_id"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    counts = ledger.coverage(d, d, e)
    whole = ledger.complete(counts, 1.0).select("repo_id", F.lit(True).alias("whole"))
    kept = tables.drop_stale(d, e).select("repo_id").distinct().withColumn("stale", F.lit(False))
    return counts.join(whole, "repo_id", "left").join(kept, "repo_id", "left").select("repo_id", "n_chunks", "n_embedded", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("stale", F.lit(True)).alias("stale"))


@query("""WITH s AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id) SELECT c_custkey AS key, t IS NOT NULL AND t >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAYS AS hit FROM customer LEFT JOIN s ON user_id = c_custkey""")
def cache_lookup(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("created_at")).withColumn("value", F.lit("v"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    hits, misses = ledger.lookup(keys, seen, ttl_days=5, now="TIMESTAMP_NTZ '2024-01-20'")
    return hits.select("key", F.lit(True).alias("hit")).unionByName(misses.select("key", F.lit(False).alias("hit")))


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def reviewed_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("reviewed"), F.when(F.col("toxic") == 1, True).alias("rejected"))
    return tables.reviewed(rows)


@query("SELECT event_type AS suite, max({'stamp': strftime(ts, '%Y%m%dT%H%M%SZ'), 'value': user_id}).stamp AS stamp, max({'stamp': strftime(ts, '%Y%m%dT%H%M%SZ'), 'value': user_id}).value AS value FROM events GROUP BY 1")
def latest_reports(spark, sf_dir):
    return tables.latest_report(table(spark, sf_dir, "events").select(F.col("event_type").alias("suite"), scalar.utc_stamp(F.col("ts")).alias("stamp"), F.col("user_id").alias("value")))


@query("SELECT c_custkey, greatest(c_ts, t) AS last_seen_at FROM (SELECT c_custkey, TIMESTAMP '2024-01-10' AS c_ts FROM customer) LEFT JOIN (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) ON user_id = c_custkey")
def last_seen(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.expr("TIMESTAMP_NTZ '2024-01-10'").alias("last_seen_at"))
    visits = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"))
    return ledger.recently_seen(c, visits).select(F.col("session_id").alias("c_custkey"), "last_seen_at")


@query("SELECT c_custkey AS url, CASE WHEN (SELECT arg_max(o_orderstatus, {'a': o_orderdate, 'b': o_orderstatus}) FROM orders WHERE o_custkey = c_custkey) = 'F' THEN 'already_indexed' ELSE 'stale' END AS status FROM customer")
def revisit_status(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.lit("F").alias("head_sha"))
    indexed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderstatus").alias("head_sha"), F.col("o_orderdate").alias("indexed_at"))
    return ledger.revisit_status(wanted, indexed)


@query("SELECT p_partkey FROM part WHERE p_name = 'small ring' AND p_size >= 6")
def current_snapshots(spark, sf_dir):
    repos = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "/"), F.lit("@"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").alias("index_version"), F.lit("secret").alias("content"))
    return filters.snapshots_of(filters.scrub(filters.current_recipe(repos)), "small/ring").select("p_partkey")


@query("SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS jaccard FROM (SELECT doc_id, [lang, source, 'x'] AS a, [lang, 'x', CASE WHEN doc_id % 2 = 0 THEN source ELSE 'y' END] AS b FROM documents WHERE doc_id % 5 > 0) UNION ALL SELECT doc_id, 0.0 FROM documents WHERE doc_id % 5 = 0")
def jaccard_sets(spark, sf_dir):
    a = F.array("lang", "source", F.lit("x"))
    b = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", F.lit("x"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("y")))
    return table(spark, sf_dir, "documents").select("doc_id", _R(scalar.jaccard(a, b)).alias("jaccard"))


@query(f"SELECT chunk_id, lexical, CAST(n AS INT) AS uncovered FROM (SELECT doc_id AS chunk_id, regexp_matches(source || '.TextUnit_' || doc_id, {_LEXICAL}) AS lexical, length(text) - length(replace(text, {_NL}, '')) + 1 AS t, t - greatest(0, least(t, 4) - 1) - (t >= 6)::INT AS n FROM documents)")
def uncovered_lines(spark, sf_dir):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((2, 4), (6, 6))])
    return document_chunks(spark, sf_dir).select("chunk_id", text.looks_lexical(F.col("symbol")).alias("lexical"), F.size(scalar.uncovered_lines(F.col("end_line"), spans)).alias("uncovered"))


# ---- vectors, spans, lanes and verdicts


@query("""WITH d AS (SELECT DISTINCT sha256(text) AS text_key, length(text) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT sha256(text) AS text_key FROM documents WHERE doc_id % 2 = 0)
SELECT text_key, CAST(CASE WHEN text_key IN (SELECT text_key FROM c) THEN -1 ELSE n END AS BIGINT) AS first FROM d WHERE text_key IN (SELECT text_key FROM c) OR n % 10 <> 0""")
def embedding_cache(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    cache = d.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("text_key"), F.array(F.lit(-1.0), F.lit(0.0)).alias("vector")).distinct()

    def embed(texts):
        if any(len(t) % 10 == 0 for t in texts):
            raise ValueError("a model that refuses some texts")
        return [[float(len(t)), 1.0] for t in texts]

    out = retrieval.embed_missing(d.select("text"), cache, embed, dimension=2)
    return out.select("text_key", F.col("vector")[0].cast("long").alias("first"))


@query("""SELECT 'n' || n_nationkey AS symbol, 'nation/' || n_name AS file_path, CAST(n_nationkey + 1 AS INT) AS start_line FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey IN (SELECT c_nationkey FROM customer)""")
def expanded_spans(spark, sf_dir):
    e, key = place_edges(spark, sf_dir), F.col("n_nationkey")
    chunks = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), key.cast("string")).alias("symbol"), F.concat(F.lit("nation/"), F.col("n_name")).alias("file_path"), (key + 1).cast("int").alias("start_line"), (key + 9).cast("int").alias("end_line"), key)
    starts = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("symbol"))
    out = graph.expand(graph.paths(e, starts), chunks, chunks.where(key % 3 == 0).select("file_path", "start_line", "end_line"))
    return out.select("symbol", "file_path", "start_line")


@query("""WITH m AS (SELECT p_brand, p_type || p_size % 5 AS symbol, arg_min(p_size, p_partkey) AS fan, min(p_partkey) AS o FROM part GROUP BY ALL),
f AS (SELECT i.p_brand, i.p_partkey, arg_min(symbol, o) AS symbol, arg_min(fan, o) AS fan FROM part i JOIN m ON m.p_brand = i.p_brand AND contains('uses ' || i.p_type || i.p_size % 7, symbol) GROUP BY ALL),
s AS (SELECT p.p_brand, p.p_partkey, f.symbol, CASE WHEN f.symbol IS NULL THEN 0.35 ELSE greatest(0, least(1, 0.85 - least(fan, 40) / 40 - 0.1 + CASE WHEN fan % 2 = 0 THEN 0.15 ELSE 0 END)) END::DOUBLE AS score FROM part p LEFT JOIN f USING (p_partkey))
SELECT * FROM (SELECT p_brand AS repo_id, p_partkey AS number, symbol, round(score, 6) AS score, row_number() OVER (PARTITION BY p_brand ORDER BY round(score, 9) DESC, p_partkey) AS rank FROM s) WHERE rank <= 6""")
def issue_triage(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    named = lambda n: F.concat("p_type", (F.col("p_size") % n).cast("string"))
    issues = p.select(F.col("p_brand").alias("repo_id"), F.col("p_partkey").alias("number"), F.col("p_name").alias("title"), F.concat(F.lit("uses "), named(7)).alias("body"), F.array().cast("array<string>").alias("labels"), F.array().cast("array<string>").alias("referenced_files"))
    m = p.groupBy(F.col("p_brand").alias("repo_id"), named(5).alias("symbol")).agg(F.min_by("p_size", "p_partkey").alias("fan_in"), F.min("p_partkey").alias("ordinal"))
    m = m.withColumn("cyclomatic", F.lit(4)).withColumn("has_tests", F.col("fan_in") % 2 == 0)
    return contribute.triage(issues, m).select("repo_id", "number", "symbol", _R("score").alias("score"), "rank")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unverified' WHEN event_id % 3 = 0 OR event_id % 7 = 0 OR event_type = 'error' THEN 'flagged' ELSE 'verified' END AS status FROM events")
def claim_status(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    decision = F.when(k % 7 == 0, F.lit(None)).when(F.col("event_type") == "error", "rejected").otherwise("verified")
    return contribute.verify_status(e.select("event_id", decision.alias("decision"), (k % 5 == 0).alias("provider_error"), (k % 3).alias("n_chunks"))).select("event_id", "status")


@query("SELECT 'Investigate structural risk around ' || p_name || '/' || p_partkey AS title, p_name || '/' || p_partkey AS file_path FROM part WHERE p_name LIKE '%ring%' ORDER BY p_partkey LIMIT 5")
def suspicion_lane(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")).alias("file_path"), F.lit(None).cast("string").alias("symbol"))
    return contribute.suspicions(p, ["RING"]).select("title", "file_path")


@query(f"WITH {_EDGES} SELECT DISTINCT src AS symbol, type, 'in' AS way FROM edges WHERE dst = 'p1' UNION ALL SELECT DISTINCT dst, type, 'out' FROM edges WHERE src = 's1'")
def callers_and_callees(spark, sf_dir):
    e = trade_edges(spark, sf_dir)
    return graph.callers(e, "p1").withColumn("way", F.lit("in")).unionByName(graph.callees(e, "s1").withColumn("way", F.lit("out")))


_REPLIES = """CASE (conv_id * 3 + turn) % 8 WHEN 0 THEN '{"decision":"sufficient","reason":"ok"} done' WHEN 1 THEN '{"decision":"insufficient","reason":"need","next_symbol":"sym' || conv_id || '"}'
  WHEN 2 THEN '{"decision":"maybe"}' WHEN 3 THEN 'no json' WHEN 4 THEN '{"decision":"insufficient","reason":5}' WHEN 5 THEN '{broken}'
  WHEN 6 THEN 'so: {"verdict":"actionable","reason":"r' || turn || '"}' ELSE '{"verdict":"not_actionable","decision":"sufficient","next_symbol":null}' END"""
_LISTS = """CASE conv_id % 3 WHEN 0 THEN 'list [{"title":"a' || conv_id || '"}, 3, {"title":"b"}] end' WHEN 1 THEN '[1, "x"] and [2]' ELSE 'none' END"""


@query(f"""WITH r AS (SELECT conv_id, turn, translate(coalesce(text, ''), '{{}}[]', '    ') || {_REPLIES} AS reply, translate(coalesce(text, ''), '{{}}[]', '    ') || {_LISTS} AS list FROM conversations),
s AS (SELECT *, regexp_extract(reply, '\\{{.*\\}}', 0, 's') AS o, regexp_extract(list, '\\[.*\\]', 0, 's') AS a FROM r),
j AS (SELECT *, CASE WHEN json_valid(o) THEN o::JSON END AS v, CASE WHEN json_valid(a) THEN a::JSON END AS l FROM s),
f AS (SELECT *, coalesce(v->>'decision' IN ('sufficient', 'insufficient'), false) AND coalesce(json_type(v, '$.reason'), 'VARCHAR') = 'VARCHAR' AND coalesce(json_type(v, '$.next_symbol'), 'NULL') IN ('NULL', 'VARCHAR') AS fits,
  coalesce(v->>'verdict' IN ('actionable', 'not_actionable'), false) AND coalesce(json_type(v, '$.reason'), 'VARCHAR') = 'VARCHAR' AS rubric, list_filter(from_json(l, '["JSON"]'), lambda x: json_type(x) = 'OBJECT') AS objects FROM j)
SELECT conv_id, turn, CASE WHEN fits THEN v->>'decision' ELSE 'sufficient' END AS decision, CASE WHEN fits THEN coalesce(v->>'reason', '') WHEN v IS NULL THEN 'parse_error' ELSE 'schema_error' END AS reason, CASE WHEN fits THEN v->>'next_symbol' END AS next_symbol,
  CASE WHEN rubric THEN v->>'verdict' END AS verdict, CAST(coalesce(len(objects), 0) AS INT) AS objects, objects[1]->>'title' AS first_title FROM f""")
def model_replies(spark, sf_dir):
    """What judges' and rubrics' replies say, however they are wrapped or broken."""
    bare = F.translate(F.coalesce("text", F.lit("")), "{}[]", "    ")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(bare, F.expr(_REPLIES)).alias("reply"), F.concat(bare, F.expr(_LISTS)).alias("list"))
    told = c.select("conv_id", "turn", scalar.sufficiency(F.col("reply")).alias("s"), scalar.actionability(F.col("reply")).alias("a"), scalar.json_objects(F.col("list")).alias("o"))
    title = F.try_variant_get(F.get("o", F.lit(0)), "$.title", "string")
    return told.select("conv_id", "turn", "s.decision", "s.reason", "s.next_symbol", F.col("a.verdict").alias("verdict"), F.size("o").alias("objects"), title.alias("first_title"))


@query("""WITH p AS (SELECT *, [struct_pack(w := -(doc_id % 10) / 10.0, n := 'understand'), struct_pack(w := -(doc_id % 7) / 10.0, n := 'change')] AS weights FROM documents),
t AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN '(none stated)' ELSE array_to_string(list_transform(list_sort(weights), lambda x: x.n || '=' || printf('%.2f', abs(x.w))), ', ') END AS weighted FROM p)
SELECT doc_id, sha256(concat_ws(chr(10), 'USER GOAL (verbatim, do not rephrase):', '  "' || trim(coalesce(text, ''), ' ') || '"', '  modality_weights: ' || weighted, '  focus_keywords:   ' || CASE doc_id % 3 WHEN 0 THEN '(none)' WHEN 1 THEN 'pool' ELSE 'pool, leak' END,
  CASE WHEN doc_id % 5 = 1 THEN '  audience:         for ' || lang END, CASE WHEN doc_id % 2 = 1 THEN '  success looks like: done' END, '', 'PLAN TILT (set by the deterministic planner — honor it):', '  - active capabilities: cartographer, teacher', '  - output shape:        narrative',
  CASE WHEN doc_id % 3 = 1 THEN '  - cartographer hub bias: balanced' END, CASE doc_id % 3 WHEN 1 THEN '  - flow-tracer targets: pool' WHEN 2 THEN '  - flow-tracer targets: pool, leak' END, '', 'LAWS')) AS anchor_sha256 FROM t""")
def goal_anchors(spark, sf_dir):
    """The block that opens a prompt, over whole texts as goals."""
    k = F.col("doc_id")
    words = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("pool"))).otherwise(F.array(F.lit("pool"), F.lit("leak")))
    weights = F.when(k % 4 == 0, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("understand"), (k % 10) / 10, F.lit("change"), (k % 7) / 10))
    profile = F.struct(F.coalesce("text", F.lit("")).alias("raw_text"), weights.alias("modality_weights"), words.alias("focus_keywords"), F.when(k % 5 == 1, F.concat(F.lit("for "), F.col("lang"))).when(k % 5 == 2, F.lit("  ")).alias("audience_framing"), F.when(k % 2 == 1, F.lit(" done ")).alias("success_criterion"))
    plan = F.struct(F.array(F.lit("cartographer"), F.lit("teacher")).alias("active"), F.lit("narrative").alias("output_shape"), F.when(k % 3 == 1, F.lit("balanced")).alias("cartographer_tilt"), words.alias("flow_tracer_targets"), F.lit(None).cast("string").alias("lane_b_framing"))
    d = table(spark, sf_dir, "documents").withColumn("p", profile).withColumn("l", plan)
    return d.select("doc_id", F.sha2(text.goal_anchor(F.col("p"), F.col("l"), "LAWS"), 256).alias("anchor_sha256"))


_AT = lambda k: f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}, round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0.0 END), 6) AS ndcg_{k}"


@query(f"""WITH {_CHUNKS}, questions AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 50 = 0 AND length(text) > 0), {_TERMS}, {_POSTINGS}, {_SPARSE},
d AS (SELECT query_id, count(*) AS n FROM sparse WHERE rank <= 5 GROUP BY 1), h AS (SELECT q.query_id, s.rank, d.n FROM questions q LEFT JOIN sparse s ON s.query_id = q.query_id AND s.chunk_id = q.query_id AND s.rank <= 20 LEFT JOIN d ON d.query_id = q.query_id)
SELECT 'keyword_retrieval' AS eval_name, '20240202T000000Z' AS timestamp_utc, count(*) AS total, {', '.join(map(_AT, evaluate.KS))}, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 / rank END), 6) AS mrr, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS diversity FROM h""")
def retrieval_report(spark, sf_dir):
    """A keyword search graded over a labelled dataset in JSON Lines; the newest of two reports, read back."""
    root, chunks = fresh_folder(spark, "evaluation"), document_chunks(spark, sf_dir)
    ref = F.struct("file_path", "start_line", "end_line")
    chunks.where("chunk_id % 50 = 0 AND length(content) > 0").select(F.to_json(F.struct(F.col("content").alias("question"), F.array(ref).alias("expected_refs"))).alias("value")).write.text(f"{root}/dataset")
    spans = chunks.select("chunk_id", "file_path", "start_line", "end_line")
    cases = evaluate.retrieval_cases(labelled.load(spark, f"{root}/dataset", "grounding"), lambda asked: retrieval.keyword_search(chunks, asked, 20).select("query_id", "rank", "chunk_id").join(spans, "chunk_id"))
    summary = evaluate.retrieval_summary(cases)
    for stamp in ("20240202T000000Z", "20240101T000000Z"):
        evaluate.report(summary, f"{root}/reports", "keyword_retrieval", dataset="documents", headline="recall_10", gate=0.9, stamp=stamp)
    numbers = [F.round(f"payload.{c}", 6).alias(c) for c in summary.columns if c != "total"]
    return evaluate.latest_record(spark, f"{root}/reports", "keyword_retrieval").select("eval_name", "timestamp_utc", "payload.total", *numbers)


@query("""WITH p AS (SELECT conv_id, turn, coalesce(role, '') AS query, coalesce(text, '') AS text FROM conversations), m AS (SELECT *, conv_id % 2 = 0 AS known FROM p),
t AS (SELECT *, list_distinct(list_transform(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x))) AS q, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x))) AS w FROM m),
k AS (SELECT DISTINCT query, text FROM m WHERE known)
SELECT conv_id, turn, round(CASE WHEN k.text IS NOT NULL THEN 0.25 WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, w)) / len(q) END, 6)::DOUBLE AS relevance FROM t LEFT JOIN k ON k.query = t.query AND k.text = t.text""")
def cached_scores(spark, sf_dir):
    """Pairs of even conversations are in the cache at 0.25; the others are scored."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("query"), F.coalesce("text", F.lit("")).alias("text"))
    known = c.where("conv_id % 2 = 0").select(F.sha2(F.concat_ws("\0", F.lit("m"), "query", "text"), 256).alias("key")).distinct()
    cache = known.select("key", F.lit(0.25).alias("relevance"), F.lit("2024-01-01").cast("timestamp").alias("last_used"))
    return retrieval.score_cached(c, cache, model="m")[0].select("conv_id", "turn", _R("relevance").alias("relevance"))
