"""Quality rules per document, then per host with rates shrunk by an empirical beta prior.

Everything is a DataFrame expression. Document rules look only at their own text, so the scan needs
no shuffle; hosts are aggregated with map-side combine, which also absorbs a host that owns a third
of the corpus.

Defined cases: a null text counts as empty (no words, so it fails). Texts of any length are judged whole. A null host has no verdict, its
documents stand by their own rules. Repeated rows are judged one by one. An empty table gives an
empty result. Input columns other than the named ones are ignored by `document_rules` and passed
through by `apply_rules`; its working columns have reserved names (prefix `_qr_`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, read_table, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rejected hosts that may be broadcast.
FEW_HOSTS = 10_000


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: A host goes if its shrunken failure rate is so many standard deviations of the fitted prior above its
    #: mean, and at least this: one that still has more good documents than bad ones is not thrown away.
    host_deviations: float = 3.0
    min_host_rate: float = 0.5


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def document_rules(docs: DataFrame, rules: Rules = Rules(), *, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Columns `keep` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Windows are compared by a 64-bit hash of their eight words. Arrays that several later columns
    use sit in a projection of their own, so each is built once per row.
    """
    base = docs.select(*keep, text_of(text).alias("_qr_text"))
    base = base.withColumn("_qr_words", words_of(F.col("_qr_text")))
    lines = F.filter(F.split("_qr_text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    n = F.size("_qr_words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_qr_words", i, WINDOW))))
    base = base.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(_without(F.col("_qr_text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_qr_text") - F.length(_without(F.col("_qr_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("_qr_lines"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("_qr_windows"),
    )
    # Only texts with a repeated window (few) pay for the sort that finds its positions.
    ordered = F.when(
        F.size(F.array_distinct("_qr_windows")) < F.size("_qr_windows"),
        F.array_sort(F.transform("_qr_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    base = base.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long").alias("n_dup_lines"),
        ordered.alias("_qr_sorted"),
    )
    at = lambda j: F.get(F.col("_qr_sorted"), j)["h"]
    repeated = F.filter("_qr_sorted", lambda x, j: F.coalesce(at(j - 1) == x["h"], F.lit(False)) | F.coalesce(at(j + 1) == x["h"], F.lit(False)))
    positions = F.array_sort(F.transform(repeated, lambda x: x["i"]))
    covered = F.aggregate(
        positions,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    out = base.withColumn("n_repeat_words", F.when(F.col("_qr_sorted").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("_qr_sorted")
    # A generator of one row is where filters on the results stop: pushed further down, they would
    # repeat the whole chain of array expressions for each mention of a column.
    out = out.select(*keep, F.inline(F.array(F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, rules: Rules = Rules(), *, host: str = "source", work: Scratch | None = None) -> DataFrame:
    """One row per host: documents, failures, shrunken host_rate, host_rejected.

    The beta prior is fitted over hosts by the method of moments: the spread of host rates beyond
    what binomial noise explains sets its strength. Only the fitted pair of numbers reaches the
    driver. Without such spread, every host shrinks to the corpus rate. The limit comes from the prior
    as well (see Rules).
    """
    work = work or Scratch(judged.sparkSession)
    hosts = judged.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    hosts = work.cut(hosts)  # read twice: for the prior and for the rates
    rate = F.col("host_failed") / F.col("host_docs")
    s = hosts.agg(
        F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.count(F.lit(1)).alias("h"),
        F.sum(F.col("host_docs") * rate).alias("s1"), F.sum(F.col("host_docs") * rate * rate).alias("s2"),
    ).first()
    n, h = float(s["n"] or 0), float(s["h"] or 0)
    mean = (s["f"] or 0) / n if n else 0.0
    spread = (s["s2"] / n - mean * mean - mean * (1 - mean) * h / n) if n else 0.0
    strength = min(n, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 1e-12 else n
    shrunk = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    limit = max(rules.min_host_rate, mean + rules.host_deviations * (mean * (1 - mean) / (strength + 1)) ** 0.5)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > limit)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Digest of every document with its verdict `kept`. The narrow rule table is written once."""
    work = Scratch(docs.sparkSession)
    judged = work.cut(document_rules(docs, rules))
    hosts = host_verdicts(judged, rules, work=work).select("source", "host_rate", "host_rejected")
    out = judged.join(hosts, "source", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def apply_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with the columns they came with.

    One pass over the texts writes those that pass their own rules, and of the others the host alone;
    the host table (a row per host) decides on the rest.
    """
    columns, work = docs.columns, Scratch(docs.sparkSession)
    # Names of the rule columns may clash with the documents' own, so these travel under others.
    own = [f"_qr_c{i}" for i in range(len(columns))]
    text, host = own[columns.index("text")], own[columns.index("source")]
    judged = document_rules(docs.toDF(*own), rules, text=text, keep=tuple(own))
    judged = work.cut(judged.select(*[F.col(c) if c == host else F.when(~F.col("base_failed"), F.col(c)).alias(c) for c in own], "base_failed"))
    hosts = host_verdicts(judged.select(host, "base_failed"), rules, host=host, work=work)
    rejected = work.cut(hosts.where("host_rejected").select(F.col(host).alias("_qr_host")))
    kept = judged.where("not base_failed")
    some = rejected.limit(FEW_HOSTS + 1).count()
    if some:
        # Few hosts are sent to the texts; only more of them than that make the texts move.
        rejected = F.broadcast(rejected) if some <= FEW_HOSTS else rejected
        kept = kept.join(rejected, kept[host] == F.col("_qr_host"), "left_anti")
    return kept.select(*own).toDF(*columns)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate")
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, list_aggregate(w[i:i+7], 'string_agg', ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1
), q AS (
  SELECT doc_id, sum(least(8, i - coalesce(p, -8))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id
), l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), b AS (
  SELECT d.doc_id, d.source, len(w) AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN q USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
), h AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS x FROM f WHERE source IS NOT NULL GROUP BY source
), m AS (
  SELECT CAST(sum(n) AS DOUBLE) AS n, sum(x) / sum(n) AS p, count(*) AS h, sum(n * (x / n) * (x / n)) / sum(n) AS s2 FROM h
), v AS (SELECT n, p, s2 - p * p - p * (1 - p) * h / n AS spread FROM m
), s AS (SELECT p, CASE WHEN spread > 1e-12 THEN least(n, greatest(1.0, p * (1 - p) / spread - 1)) ELSE n END AS k FROM v
), z AS (SELECT source, (x + p * k) / (n + k) AS host_rate, greatest(0.5, p + 3 * sqrt(p * (1 - p) / (k + 1))) AS host_limit FROM h, s)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(host_rate > host_limit, false) AS kept, round(host_rate, 9) AS host_rate
FROM f LEFT JOIN z USING (source)
"""
