"""Numbers, arrays, maps and JSON over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rrf_term(weight: Column, rank0: Column, k: int = 60) -> Column:
    """weight / (k + rank + 1), ranks from 0."""
    return weight / (F.lit(k) + rank0 + 1)


def fused_distance(score: Column) -> Column:
    return 1 / (1 + score)


def relative_distance(score: Column, top: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - score / top)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / F.size(F.array_union(a, b)))


def is_subset(part: Column, whole: Column) -> Column:
    """Every element of part is in whole; an empty part always is."""
    return F.size(F.array_except(part, whole)) == 0


def clamp_unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def clean_weights(weights: Column, known: list[str]) -> Column:
    """Known keys only, values in [0, 1]."""
    return F.transform_values(F.map_filter(weights, lambda k, v: k.isin(*known)), lambda k, v: clamp_unit(v.cast("double")))


def clean_keywords(values: Column, limit: int = 6) -> Column:
    trimmed = F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.lower(F.trim(v)))
    return F.slice(F.filter(trimmed, lambda v: v != ""), 1, limit)


def merge_ranges(ranges: Column) -> Column:
    """Sorted (start, end) structs with overlapping and adjacent ones joined."""
    kind = "array<struct<start:int,end:int>>"
    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        apart = F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        return F.when(F.coalesce(x["start"] <= last["end"] + 1, F.lit(False)), joined).otherwise(apart)
    return F.aggregate(F.array_sort(ranges).cast(kind), F.array().cast(kind), step)


def clip_ranges(ranges: Column, start: Column, end: Column) -> Column:
    cut = F.transform(ranges, lambda r: F.struct(F.greatest(r["start"], start).alias("start"), F.least(r["end"], end).alias("end")))
    return merge_ranges(F.filter(cut, lambda r: r["end"] >= r["start"]))


def uncovered_lines(total: Column, spans: Column) -> Column:
    """Line numbers from 1 that lie in none of the spans."""
    every = F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i <= s["end"])))


def first_json_object(text: Column) -> Column:
    """The widest {...} in free text, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def _kind(value: Column) -> Column:
    """Type of a JSON value (OBJECT<..>, STRING, VOID, ...); null where there is none."""
    return F.schema_of_variant(value)


def parsed_json(text: Column) -> Column:
    """The JSON value that a text is, as a variant; null if it is none, or if anything follows it."""
    held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))  # the parser ignores what follows a value
    return F.when(F.try_variant_get(held, "$[1]", "variant").isNull(), F.try_variant_get(held, "$[0]", "variant"))


def json_objects(text: Column) -> Column:
    """The objects of the widest [...] in free text, as an array of variants; empty if it is no JSON array."""
    parsed = parsed_json(F.regexp_extract(text, r"(?s)\[.*\]", 0))
    items = F.when(_kind(parsed).startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>"))
    return F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False)))


def _reply(text: Column, field: str, allowed: list[str]) -> tuple[Column, Column, Column]:
    """Of the widest {...}: the object, whether it fits (an allowed word in `field`, reason a string), and reason."""
    parsed = parsed_json(first_json_object(text))
    of = lambda name: F.try_variant_get(parsed, f"$.{name}", "variant")
    word = F.when(_kind(of(field)) == "STRING", F.try_variant_get(parsed, f"$.{field}", "string"))
    reason = F.when(_kind(of("reason")) == "STRING", F.try_variant_get(parsed, "$.reason", "string"))
    fits = F.coalesce(word.isin(*allowed), F.lit(False)) & (of("reason").isNull() | reason.isNotNull())
    return parsed, fits, F.struct(word.alias(field), F.coalesce(reason, F.lit("")).alias("reason"))


def sufficiency(text: Column) -> Column:
    """decision, reason, next_symbol of a judge's reply; one that can't be read counts as sufficient, the reason telling why."""
    parsed, fits, told = _reply(text, "decision", ["sufficient", "insufficient"])
    kind = _kind(F.try_variant_get(parsed, "$.next_symbol", "variant"))
    symbol = F.when(kind == "STRING", F.try_variant_get(parsed, "$.next_symbol", "string"))
    fits = fits & F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))
    reply = lambda decision, reason, nxt: F.struct(decision.alias("decision"), reason.alias("reason"), nxt.cast("string").alias("next_symbol"))
    failed = lambda why: reply(F.lit("sufficient"), F.lit(why), F.lit(None))
    return F.when(parsed.isNull(), failed("parse_error")).when(fits, reply(told["decision"], told["reason"], symbol)).otherwise(failed("schema_error"))


def actionability(text: Column) -> Column:
    """verdict, reason of a rubric's reply; null if it can't be read."""
    _, fits, told = _reply(text, "verdict", ["actionable", "not_actionable"])
    return F.when(fits, told)


def verdict(text: Column, allowed: list[str]) -> Column:
    """First valid decision among the flat objects of the text, then its widest span."""
    flat = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))
    candidates = F.concat(flat, F.array(F.regexp_extract(text, r"(?s)\{.*\}", 0)))
    decisions = F.transform(candidates, lambda c: F.get_json_object(c, "$.decision"))
    return F.get(F.filter(decisions, lambda d: d.isNotNull() & d.isin(*allowed)), F.lit(0))


def keep_ranges(text: Column) -> Column:
    """`keep` pairs of a JSON object in free text as (start, end) structs; null on failure."""
    parsed = F.from_json(first_json_object(text), "keep array<array<int>>")["keep"]
    return F.transform(parsed, lambda p: F.struct(F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("end")))


def encode_ref(repo: Column, path: Column, start: Column, end: Column, symbol: Column) -> Column:
    """URL-safe opaque id of a span."""
    body = F.to_json(F.struct(repo.alias("r"), path.alias("f"), start.alias("s"), end.alias("e"), symbol.alias("y")))
    return F.translate(F.base64(F.encode(body, "UTF-8")), "+/=\r\n", "-_")


def decode_ref(chunk_id: Column) -> Column:
    padded = F.rpad(chunk_id, F.ceil(F.length(chunk_id) / 4).cast("int") * 4, F.lit("="))
    return F.from_json(F.decode(F.unbase64(F.translate(padded, "-_", "+/")), "UTF-8"), "r string, f string, s int, e int, y string")


def cache_key(*fields: Column) -> Column:
    """sha256 of the fields as compact JSON, names sorted by the caller's order."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def approachability(fan_in: Column, cyclomatic: Column, has_tests: Column) -> Column:
    bonus = F.when(has_tests, 0.15).otherwise(0.0)
    return clamp_unit(F.lit(0.85) - F.least(fan_in, F.lit(40)) / 40 - F.least(cyclomatic, F.lit(20)) / 40 + bonus)


def opportunity_score(mergeability: Column, approach: Column, evidence: Column, lane_weight: Column) -> Column:
    return 0.4 * mergeability + 0.35 * approach + 0.25 * evidence + lane_weight


def nearest_rank(values: Column, percent: float) -> Column:
    """Nearest-rank percentile, the rank rounded half to even."""
    return F.element_at(F.array_sort(values), F.bround(F.lit(percent / 100) * (F.size(values) - 1)).cast("int") + 1)


def dominant_key(weights: Column) -> Column:
    """Key of the largest weight, ties by name."""
    pairs = F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k"))))
    return F.get(pairs, F.lit(0))["k"]


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
