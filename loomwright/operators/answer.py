"""From model replies to checked answers: references, sections, compression, bundles, tour logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..functions.constants import (
    COMPRESS_LINES, FACT_ENTRIES, FACT_HEAD, FACT_HUBS, NO_ENTRIES, NO_HUBS, NO_PATHS, NO_SOURCES, PATH_HEAD, RECHECK_REFS, SECTION_RETRIES, SOURCE_HEAD, TRACE_PATHS, TRACE_TARGETS,
)

SPAN = ("file_path", "start_line", "end_line")


def coerce_refs(refs: DataFrame, allowed: DataFrame, key: str = "repo_id") -> DataFrame:
    """refs(key, symbol, file_path, start_line, end_line, ..) with the span of a known symbol, else their own if it is whole.

    allowed: key, ordinal, symbol, file_path, start_line, end_line; of a symbol named twice the first counts.
    References that have neither go.
    """
    known = allowed.where("symbol IS NOT NULL").groupBy(key, "symbol").agg(F.min_by(F.struct(*SPAN), "ordinal").alias("_known"))
    own = F.when(F.col("file_path").isNotNull() & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), F.struct(*SPAN))
    met = refs.join(known, [key, "symbol"], "left").withColumn("_span", F.coalesce("_known", own)).where("_span IS NOT NULL")
    return met.select(*[c for c in refs.columns if c not in SPAN], "_span.*")


def with_refs(payloads: DataFrame, refs: DataFrame, key: str, required: tuple[str, ...] = ("text",)) -> DataFrame:
    """Payloads whose required fields are not blank and that keep a reference; fields come out trimmed."""
    out = payloads
    for c in required:
        out = out.withColumn(c, F.trim(c)).where(F.col(c) != "")
    return out.join(refs.select(key), key, "left_semi")


def resequence(sections: DataFrame, key: str, *, order: str = "order", position: str = "position") -> DataFrame:
    """Sections numbered from 0 by their order; one without a valid order takes its position."""
    wanted = F.when(F.col(order) >= 0, F.col(order)).otherwise(F.col(position))
    return sections.withColumn(order, F.row_number().over(Window.partitionBy(key).orderBy(wanted, position)) - 1)


def recheck_refs(cited: DataFrame, context: DataFrame, claim: str = "claim_id", limit: int = RECHECK_REFS) -> DataFrame:
    """claim, rank and span of the context's first references (by position) that a claim does not cite."""
    once = context.groupBy(claim, *SPAN).agg(F.min("position").alias("position"))
    extra = once.join(cited.select(claim, *SPAN), [claim, *SPAN], "left_anti")
    rank = F.row_number().over(Window.partitionBy(claim).orderBy("position", *SPAN))
    return extra.withColumn("rank", rank).where(F.col("rank") <= limit).drop("position")


def rechecked(first: DataFrame, second: DataFrame, claim: str = "claim_id") -> DataFrame:
    """first(claim, decision, reason): a rejected claim takes a second verdict only if that verifies it."""
    again = second.where("decision = 'verified'").select(claim, F.col("decision").alias("_d"), F.col("reason").alias("_r"))
    flips = (F.col("decision") == "rejected") & F.col("_d").isNotNull()
    met = first.join(again, claim, "left")
    return met.withColumn("reason", F.when(flips, F.col("_r")).otherwise(F.col("reason"))).withColumn("decision", F.when(flips, F.col("_d")).otherwise(F.col("decision"))).drop("_d", "_r")


def traced(found: DataFrame, targets: DataFrame, key: str, *, limit: int = TRACE_TARGETS, per_target: int = TRACE_PATHS) -> DataFrame:
    """First paths(start, path, depth) of each key's first targets(key, ordinal, symbol), by depth, then path."""
    first = targets.withColumn("target", F.row_number().over(Window.partitionBy(key).orderBy("ordinal", "symbol"))).where(F.col("target") <= limit)
    met = first.select(key, "target", F.col("symbol").alias("start")).join(found, "start")
    rank = F.row_number().over(Window.partitionBy(key, "target").orderBy("depth", "path"))
    return met.withColumn("rank", rank).where(F.col("rank") <= per_target)


def _lines(array: Column, none: str) -> Column:
    return F.when(F.size(array) == 0, F.lit(none)).otherwise(F.array_join(array, "\n"))


def fact_bundle(hubs: Column, entries: Column) -> Column:
    """Text of hubs(symbol, score, fan_in, fan_out, cyclomatic) and entry point names; hubs without metrics show callers only."""
    facts = lambda h: F.when(h["fan_in"].isNull(), F.lit("")).otherwise(F.format_string("  fan_in=%d fan_out=%d cyclomatic=%d", h["fan_in"], h["fan_out"], h["cyclomatic"]))
    shown = F.transform(hubs, lambda h: F.concat(F.format_string("  - %s (callers=%d)", h["symbol"], h["score"]), facts(h)))
    named = F.transform(entries, lambda e: F.concat(F.lit("  - "), e))
    return F.concat_ws("\n", F.lit(FACT_HEAD), F.lit(""), F.lit(FACT_HUBS), _lines(shown, NO_HUBS), F.lit(""), F.lit(FACT_ENTRIES), _lines(named, NO_ENTRIES))


def path_bundle(targets: Column) -> Column:
    """Text of targets(start, paths(depth, path))."""
    chain = lambda p: F.format_string("  - depth=%d: %s", p["depth"], F.array_join(p["path"], " → "))
    block = F.transform(targets, lambda t: F.concat(F.lit("FROM "), t["start"], F.lit(":\n"), F.when(F.size(t["paths"]) == 0, F.lit(NO_PATHS)).otherwise(F.concat(F.array_join(F.transform(t["paths"], chain), "\n"), F.lit("\n")))))
    return F.concat_ws("\n", F.lit(PATH_HEAD), F.lit(""), F.array_join(block, "\n"))


def source_bundle(insights: Column) -> Column:
    """Text of insights(finding, because, so_what, goal_link, refs)."""
    one = lambda x, i: F.concat(F.format_string("[%d] finding: ", i + 1), x["finding"], F.lit("\n    because: "), x["because"], F.lit("\n    so_what: "), x["so_what"], F.lit("\n    goal_link: "), x["goal_link"], F.lit("\n    refs: "), F.array_join(x["refs"], ", "), F.lit("\n"))
    return F.when(F.size(insights) == 0, F.lit(NO_SOURCES)).otherwise(F.concat(F.lit(SOURCE_HEAD + "\n\n"), F.array_join(F.transform(insights, one), "\n")))


def compressed(chunks: DataFrame, *, min_lines: int = COMPRESS_LINES) -> DataFrame:
    """Adds kept_line_spans to chunks(kind, content, start_line, end_line, reply): the reply's ranges, clipped and merged.

    Null (all lines stay) for modules, short chunks, replies that do not parse and ranges outside the chunk.
    """
    kept = scalar.clip_ranges(scalar.keep_ranges(F.col("reply")), F.col("start_line"), F.col("end_line"))
    asked = (F.col("kind") != "module") & (F.greatest(F.lit(1), F.size(text.lines_of(F.col("content")))) >= min_lines)
    return chunks.withColumn("kept_line_spans", F.when(asked, kept)).withColumn("kept_line_spans", F.when(F.size("kept_line_spans") > 0, F.col("kept_line_spans")))


Grade = Callable[[DataFrame], DataFrame]


def verify_sections(claims: DataFrame, ground: Grade, act: Grade, revise: Grade | None = None, *, retries: int = SECTION_RETRIES) -> DataFrame:
    """claims(section_id, claim_id, ..) with status and note after at most `retries` revisions of the sections that fail.

    ground and act add decision and reason to all claims of a round at once. A claim is verified if it is
    grounded (not rejected) and not `not_actionable`. revise takes the graded claims of failing sections and
    returns them anew. What still fails is flagged, or unverified where the provider failed (reason
    `provider_error`); nothing is dropped. Without revise rejected claims stay rejected.
    """
    columns, done, open_ = claims.columns, None, claims
    for attempt in range(retries + 1):
        grounded = ground(open_).withColumnsRenamed({"decision": "_g", "reason": "note"})
        graded = act(grounded).withColumnsRenamed({"decision": "_a", "reason": "_n"})
        idle = (F.col("_g") != "rejected") & (F.col("_a") == "not_actionable")
        status = F.when((F.col("_g") == "rejected") | idle, "rejected").otherwise("verified")
        graded = graded.select(*columns, status.alias("status"), F.when(idle, F.col("_n")).otherwise(F.col("note")).alias("note")).cache()
        bad = graded.where("status = 'rejected'").select("section_id").distinct()
        good = graded.join(bad, "section_id", "left_anti")
        done = good if done is None else done.unionByName(good)
        failing = graded.join(bad, "section_id", "left_semi")
        if revise is None:
            return done.unionByName(failing)
        if attempt == retries:
            last = F.when(F.col("status") != "rejected", F.col("status")).when(F.col("note") == "provider_error", "unverified").otherwise("flagged")
            return done.unionByName(failing.withColumn("status", last))
        open_ = revise(failing).select(*columns)
    return done


def append_messages(log: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """log(key, ordinal, ..) with new(key, order, ..) after each tour's last message; columns as in log."""
    last = log.groupBy(key).agg((F.max("ordinal") + 1).alias("_next"))
    at = F.coalesce("_next", F.lit(0)) + F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return log.unionByName(new.join(last, key, "left").withColumn("ordinal", at).select(*log.columns))


def without_tours(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Tours or messages of tours that are not deleted."""
    return rows.join(gone.select(key), key, "left_anti")


def recent_first(tours: DataFrame, key: str, by: str = "updated_at") -> DataFrame:
    """A session's tours with their place, newest first, ties by key."""
    return tours.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col(by).desc(), key)))
