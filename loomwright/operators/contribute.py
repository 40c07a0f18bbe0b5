"""Capability planning and contribution lanes as expressions over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spellings
from ..functions import scalar, text
from ..functions.constants import (
    FRAGILITY_TERMS, HUB_BIAS_TERMS, LANES, RANKER_DEFAULT, RANKER_EVEN, RANKER_HUNT, RANKER_ISSUE, SUSPICION_STEP, SUSPICION_TITLE,
)


def _any(haystack: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(haystack, t))


def _weights(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def plan(profiles: DataFrame) -> DataFrame:
    """Adds the plan's fields to profiles(raw_text, modality_weights, focus_keywords, output_shape_preference)."""
    raw, words = F.lower("raw_text"), F.coalesce("focus_keywords", F.array().cast("array<string>"))
    weight = lambda k: F.coalesce(F.try_element_at("modality_weights", F.lit(k)), F.lit(0.0))
    issue = F.contains(raw, F.lit("issue")) | F.array_contains(F.split(raw, r"\s+"), "pr")
    fragile = _any(raw, FRAGILITY_TERMS)
    hunt = F.contains(raw, F.lit("hunt"))
    haystack = F.concat_ws(" ", raw, F.array_join(F.transform(words, F.lower), " "))
    bias = F.lit("balanced")
    for name, terms in reversed(HUB_BIAS_TERMS):
        bias = F.when(_any(haystack, terms), F.lit(name)).otherwise(bias)
    rules = {
        "cartographer": (weight("understand") >= 0.2) | (weight("evaluate") >= 0.2) | (weight("locate") >= 0.3) | (F.size(words) > 0),
        "flow_tracer": (weight("understand") >= 0.4) | F.contains(raw, F.lit("lifecycle")) | F.contains(raw, F.lit("flow")),
        "lane_a_issue_triage": (weight("change") >= 0.4) & issue,
        "lane_b_code_health": (weight("change") >= 0.3) | (weight("evaluate") >= 0.4),
        "lane_c_suspicion": (weight("change") >= 0.3) & (fragile | hunt),
    }
    fired = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    default = F.array(F.lit("cartographer"), F.lit("lane_b_code_health"))
    # Each step is a projection of its own, so later ones name columns and repeat no rule.
    out = profiles.withColumn("_fired", fired).withColumn("_upstream", F.when(F.size("_fired") == 0, default).otherwise(F.col("_fired")))
    has = lambda n: F.array_contains("_upstream", n)
    out = out.withColumn("active", F.concat("_upstream", F.array(F.lit("teacher"))))
    out = out.withColumn("cartographer_tilt", F.when(has("cartographer"), bias))
    out = out.withColumn("flow_tracer_targets", F.when(has("flow_tracer"), F.filter(words, lambda k: (k != "") & ~F.contains(k, F.lit(" ")))).otherwise(F.array().cast("array<string>")))
    tradeoff = (F.size("_fired") > 0) & (weight("evaluate") > weight("change"))
    out = out.withColumn("lane_b_framing", F.when(has("lane_b_code_health"), F.when(tradeoff, F.lit("tradeoffs_visible_in_code")).otherwise(F.lit("cleanup_opportunities"))))
    compare = (weight("compare") >= 0.3) | _any(raw, ("compare", "vs ", "versus"))
    contributes = has("lane_a_issue_triage") | has("lane_b_code_health") | has("lane_c_suspicion")
    shape = F.when(compare, "comparison_table").when(contributes, "ranked_list").when(_any(raw, ("audit", "decision", "dossier")), "dossier").otherwise("narrative")
    asked = F.coalesce("output_shape_preference", F.lit("unspecified"))
    out = out.withColumn("output_shape", F.when(asked != "unspecified", asked).otherwise(shape))
    leaning = F.when(hunt | fragile, _weights(RANKER_HUNT)).when(issue, _weights(RANKER_ISSUE)).otherwise(_weights(RANKER_EVEN))
    out = out.withColumn("ranker_weights", F.when(has("lane_a_issue_triage"), leaning).otherwise(F.create_map().cast("map<string,double>")))
    soft = has("flow_tracer") & has("cartographer") & (F.size("flow_tracer_targets") == 0)
    upstream = F.create_map(F.lit("teacher"), F.col("_upstream"))
    out = out.withColumn("dependencies", F.when(soft, F.map_concat(upstream, F.create_map(F.lit("flow_tracer"), F.array(F.lit("cartographer"))))).otherwise(upstream))
    return out.drop("_fired", "_upstream")


def triage(issues: DataFrame, metrics: DataFrame, focus: list[str] | None = None, *, limit: int = 3, key: str = "repo_id") -> DataFrame:
    """repo_id, number, title, symbol, score, verdict (accepted, rejected) of issues by approachability.

    issues: repo_id, number, title, body, labels, referenced_files; metrics: repo_id, ordinal, symbol,
    fan_in, cyclomatic, has_tests. An issue takes the first symbol that its body or a referenced path
    spells anywhere. Automata of the repository's symbols find it, each issue being read once for each shard of
    symbols. Of metrics with one ordinal, one is taken.
    """
    listed = F.array_join("referenced_files", " ")
    if focus:
        hay = F.concat_ws(" ", "title", "body", F.array_join("labels", " "), listed)
        issues = issues.where(text.contains_any(hay, F.array(*map(F.lit, focus))))
    spelt = issues.select(key, "number", "title", F.concat_ws("\n", "body", F.array_join("referenced_files", "\n")).alias("hay"))
    found = spellings.spelt(spelt.select(F.col(key).alias("key"), F.col("number").alias("text_id"), "hay"), metrics.select(F.col(key).alias("key"), F.col("ordinal").alias("word_id"), F.col("symbol").alias("word")), first=True)
    known = metrics.groupBy(key, "ordinal").agg(F.min(F.struct("symbol", "fan_in", "cyclomatic", "has_tests")).alias("m"))
    first = found.select(F.col("key").alias(key), F.col("text_id").alias("number"), F.col("word_id").alias("ordinal")).join(known, [key, "ordinal"]).select(key, "number", "m")
    scored = spelt.select(key, "number", "title").join(first, [key, "number"], "left")
    score = F.when(F.col("m").isNull(), 0.35).otherwise(scalar.approachability(F.col("m.fan_in"), F.col("m.cyclomatic"), F.col("m.has_tests")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "number"))
    out = scored.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= limit + 3)
    return out.select(key, "number", "title", F.col("m.symbol").alias("symbol"), "score", "rank", F.when(F.col("rank") <= limit, "accepted").otherwise("rejected").alias("verdict"))


def quality_candidates(candidates: DataFrame) -> DataFrame:
    """Scores of detector hits(detector, symbol, file_path, fan_in, cyclomatic, has_tests, is_entry_point, is_public_api)."""
    kept = candidates.where(~((F.col("detector") == "dead_code") & F.col("is_entry_point")) & ~((F.col("detector") == "missing_docstring") & ~F.col("is_public_api")))
    hard = F.when((F.col("fan_in") >= 20) | (F.col("cyclomatic") >= 15), "L").when((F.col("fan_in") >= 8) | (F.col("cyclomatic") >= 8), "M").otherwise("S")
    return kept.select(
        F.lit("B_quality").alias("lane"),
        F.concat(F.initcap(F.translate("detector", "_", " ")), F.lit(" in "), F.coalesce("symbol", "file_path")).alias("title"),
        "file_path", hard.alias("difficulty"), F.when(F.col("fan_in") >= 10, "hub").otherwise("isolated").alias("blast_radius"),
        F.when(F.col("has_tests"), 0.8).otherwise(0.55).alias("mergeability"),
        F.greatest(F.lit(0.1), 1 - F.least(F.col("fan_in"), F.lit(30)) / 40).alias("approachability"),
        F.when(F.col("detector").isin("dead_code", "missing_docstring"), 0.75).otherwise(0.65).alias("evidence_strength"),
    )


def suspicions(refs: DataFrame, focus: list[str] | None = None, limit: int = 5) -> DataFrame:
    """First refs(ordinal, file_path, symbol) in focus, in guarded words, with a step to confirm."""
    focus_col = F.array(*map(F.lit, focus)) if focus else F.array().cast("array<string>")
    name = F.coalesce("symbol", "file_path")
    said = lambda sentence: F.concat(F.lit(sentence.partition("{}")[0]), name, F.lit(sentence.partition("{}")[2]))
    title = said(SUSPICION_TITLE)
    rows = refs.where(text.contains_any(F.concat_ws(" ", "file_path", "symbol"), focus_col)).where(text.overclaim(title).isNull())
    return rows.orderBy("ordinal").limit(limit).select(
        F.lit("C_suspicion").alias("lane"), title.alias("title"), "file_path", F.lit("M").alias("difficulty"), F.lit("module-scoped").alias("blast_radius"),
        F.lit(0.45).alias("mergeability"), F.lit(0.55).alias("approachability"), F.lit(0.65).alias("evidence_strength"),
        said(SUSPICION_STEP).alias("confirm_before_pr"))


def rank_opportunities(opportunities: DataFrame, weights: dict[str, float] | None = None, limit: int | None = None, *, partition: str | None = None) -> DataFrame:
    """Adds score and rank: best score first, then difficulty, lane, title."""
    lane = F.try_element_at(F.create_map(*[x for k, v in LANES.items() for x in (F.lit(k), F.lit(v))]), F.col("lane"))
    bias = F.coalesce(F.try_element_at(_weights(weights or RANKER_DEFAULT), lane), F.lit(0.0))
    out = opportunities.withColumn("score", scalar.opportunity_score(F.col("mergeability"), F.col("approachability"), F.col("evidence_strength"), bias))
    order = [F.col("score").desc(), F.col("difficulty"), F.col("lane"), F.col("title")]
    if partition is None:
        out = out.orderBy(*order) if limit is None else out.orderBy(*order).limit(limit)
        return out
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
    return out if limit is None else out.where(F.col("rank") <= limit)


def verify_status(claims: DataFrame) -> DataFrame:
    """Status of claims(decision, provider_error, n_chunks): no chunks or no decision rejects, errors stay unverified."""
    decided = F.when(F.col("provider_error"), "unverified").when((F.col("n_chunks") == 0) | F.col("decision").isNull(), "rejected").otherwise(F.col("decision"))
    return claims.withColumn("status", F.when(decided == "rejected", "flagged").otherwise(decided))
