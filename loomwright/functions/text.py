"""Text functions over columns: tokens, identifiers, paths, templates, answer lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    CONTEXT_FILE_NAMES, GOAL_AUDIENCE, GOAL_HEAD, GOAL_KEYWORDS, GOAL_SUCCESS, GOAL_WEIGHTS, IDENTIFIER_IN_QUESTION, INTENT_WORDS, MULTI_HOP_PHRASES, NO_ENTRY_NAMES, NO_HUB_NAMES,
    NO_KEYWORDS, NO_WEIGHTS, PLAN_ACTIVE, PLAN_HEAD, PLAN_HUBS, PLAN_LANE_B, PLAN_SHAPE, PLAN_TARGETS, REPO_URL, SHORTENED, SOURCE_LANGUAGES, STOPWORDS, TOO_CERTAIN,
)

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def identifiers(text: Column, pattern: str = IDENTIFIER) -> Column:
    """All identifier tokens in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def lower_all(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def token_set(text: Column, pattern: str = IDENTIFIER) -> Column:
    return F.array_distinct(lower_all(identifiers(text, pattern)))


def clean_query(query: Column) -> Column:
    """Content words of a question, in order, joined by spaces."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_join(F.filter(identifiers(query), lambda t: ~F.array_contains(stop, F.lower(t))), " ")


def split_identifier(symbol: Column) -> Column:
    """camelCase, ACRONYMWord, dots and underscores become spaces."""
    acronym = F.regexp_replace(symbol, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    camel = F.regexp_replace(acronym, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(camel, "[._]+", " ")


def keywords(text: Column, limit: int = 12) -> Column:
    """First spellings of distinct tokens of three characters or more, case ignored."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
    # Lambda variables hold both arrays: the body of a lambda would make them anew for each keyword.
    first = lambda spelt, low: F.transform(F.slice(F.array_distinct(low), 1, limit), lambda k: F.element_at(spelt, F.array_position(low, k).cast("int")))
    return F.flatten(F.flatten(F.transform(F.array(tokens), lambda spelt: F.transform(F.array(lower_all(spelt)), lambda low: first(spelt, low)))))


def looks_lexical(query: Column) -> Column:
    return query.rlike(IDENTIFIER_IN_QUESTION)


def short_name(symbol: Column) -> Column:
    return F.element_at(F.split(symbol, r"\."), -1)


def root_name(symbol: Column) -> Column:
    return F.split_part(symbol, F.lit("."), F.lit(1))


def repo_owner(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(url), REPO_URL, 1), F.lit(""))


def repo_name(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(url), REPO_URL, 2), F.lit(""))


def repo_id(owner: Column, name: Column, sha: Column) -> Column:
    return F.concat(owner, F.lit("/"), name, F.lit("@"), sha)


def url_slug(repo: Column) -> Column:
    return F.url_encode(repo)


def module_symbol(path: Column) -> Column:
    """Dotted name of a file from its path alone."""
    slashes = F.regexp_replace(F.translate(path, "\\", "/"), r"\.py$", "")
    return F.ltrim(F.translate(slashes, "/", "."), F.lit("."))


def window_symbol(language: Column, path: Column, start: Column) -> Column:
    return F.concat_ws(":", language, path, start.cast("string"))


def normalise_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def language_of(path: Column) -> Column:
    """Language of a file by suffix or well-known name; null where it is neither."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    pairs = [F.lit(x) for kv in sorted(SOURCE_LANGUAGES.items()) for x in kv]
    by_suffix = F.try_element_at(F.create_map(*pairs), suffix)
    exact = F.when(suffix != "", F.substring(suffix, 2, 100)).otherwise(name)
    return F.coalesce(
        by_suffix,
        F.when(name.rlike(r"^readme.*\.(md|markdown|txt)$"), F.lit("markdown"))
        .when(name.rlike(r"^requirements.*\.txt$"), F.lit("requirements"))
        .when(name.rlike(r"^contributing.*\.(md|markdown|rst|txt)$"), F.lit("markdown"))
        .when(name.isin(*CONTEXT_FILE_NAMES), exact)
        .when(name.startswith("build.gradle"), F.lit("gradle")),
    )


def embedding_text(prefix: str, path: Column, symbol: Column, body: Column) -> Column:
    return F.concat(F.lit(prefix + "# file: "), path, F.lit("\n# symbol: "), symbol, F.lit("\n"), body)


def rerank_text(symbol: Column, content: Column) -> Column:
    return F.when(symbol.isNull() | (symbol == ""), content).otherwise(F.concat(symbol, F.lit("\n"), content))


def enriched_text(symbol: Column, kind: Column, signature: Column, decorators: Column, keywords_: Column, neighbours: Column, body: Column) -> Column:
    """Labelled header lines, those that apply, above the body."""
    parts = F.split(symbol, r"\.")
    label = lambda name, value: F.concat(F.lit(f"# {name}: "), value)
    some = lambda array: F.size(F.coalesce(array, F.array().cast("array<string>"))) > 0
    return F.concat_ws(
        "\n",
        F.when((kind == "method") & (F.size(parts) >= 2), label("class", F.try_element_at(parts, F.lit(-2)))),
        label("symbol", symbol),
        label("kind", kind),
        F.when(some(decorators), label("decorators", F.array_join(decorators, ", "))),
        F.when(signature.isNotNull() & (signature != ""), label("signature", F.trim(F.regexp_replace(signature, r"\s+", " ")))),
        F.when(some(neighbours), label("neighbors", F.array_join(F.slice(neighbours, 1, 5), ", "))),
        F.when(some(keywords_), label("docstring keywords", F.array_join(keywords_, ", "))),
        body,
    )


def is_placeholder_summary(summary: Column) -> Column:
    return summary.isNull() | summary.endswith("(summary unavailable)")


def fallback_summary(symbol: Column, kind: Column, path: Column) -> Column:
    return F.concat(kind, F.lit(" "), symbol, F.lit(" in "), path, F.lit(" (summary unavailable)"))


def tour_id(title: Column, entropy: Column) -> Column:
    """At most 40 letters and digits, other characters as dashes, and 12 hex digits."""
    slug = F.trim(F.left(F.regexp_replace(title, r"[^\p{L}\p{N}]", "-"), F.lit(40)), F.lit("-"))
    return F.concat(F.when(slug == "", "tour").otherwise(slug), F.lit("-"), F.left(F.sha2(entropy, 256), F.lit(12)))


def chat_title(text: Column, limit: int = 48) -> Column:
    squeezed = F.rtrim(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("?.! "))
    return F.when(F.length(squeezed) > limit, F.concat(F.rtrim(F.left(squeezed, F.lit(limit))), F.lit("…"))).otherwise(squeezed)


def truncate_lines(text: Column, limit: Column | int, marker: str = SHORTENED) -> Column:
    """At most `limit` characters, cut at a line end and marked."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.regexp_replace(F.left(text, limit), r"\n[^\n]*\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit(marker)))


def lines_of(text: Column) -> Column:
    """Lines without a last empty one after a trailing break."""
    bare = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(bare, "\n"))


def numbered_lines(text: Column, start: Column) -> Column:
    """`line:text` rows, counted from start."""
    numbered = F.transform(lines_of(text), lambda x, i: F.concat((start + i).cast("string"), F.lit(":"), x))
    return F.when(F.size(numbered) == 0, F.concat(start.cast("string"), F.lit(":"))).otherwise(F.array_join(numbered, "\n"))


def source_block(index: Column, path: Column, start: Column, end: Column, symbol: Column, view: Column) -> Column:
    return F.format_string("Chunk [%d]:\n<source file=%s:%d-%d symbol='%s'>\n%s\n</source>", index, path, start, end, symbol, F.rtrim(view))


def span_view(content: Column, start: Column, spans: Column) -> Column:
    """Lines of the kept spans (absolute numbers), or all of it if none is left."""
    lines = lines_of(content)
    kept = F.filter(lines, lambda x, i: F.exists(spans, lambda s: (start + i >= s["start"]) & (start + i <= s["end"])))
    return F.when(spans.isNull() | (F.size(kept) == 0), content).otherwise(F.array_join(kept, "\n"))


def strip_reasoning(text: Column) -> Column:
    closed = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(closed, r"(?is)<think>.*\z", ""))


def claim_lines(answer: Column) -> Column:
    """Array of (line, text, citations): lines that assert something, markers and bullets removed."""
    stripped = F.transform(F.split(answer, "\n"), lambda x, i: F.struct(i.alias("line"), F.trim(x).alias("raw")))
    said = F.filter(stripped, lambda x: ~x["raw"].startswith("#") & (F.trim(x["raw"], F.lit(" -•")) != ""))
    def parsed(x):
        text = F.trim(F.trim(x["raw"], F.lit(" -•")))
        cites = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda c: c.cast("int"))
        clean = F.trim(F.regexp_replace(text, r"\s*\[\d+\]\s*", ""))
        return F.struct(x["line"].alias("line"), F.when(clean == "", text).otherwise(clean).alias("text"), cites.alias("citations"))
    return F.transform(said, parsed)


def is_not_found(answer: Column) -> Column:
    """True if the whole answer, headers aside, is one line that says nothing was found."""
    lines = F.filter(F.split(answer, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    only = F.lower(F.trim(F.get(lines, F.lit(0))))
    return (F.size(lines) == 1) & F.coalesce(only.contains("couldn't find") | only.contains("could not find") | only.contains("not in the repo"), F.lit(False))


def intent_class(question: Column) -> Column:
    """First class, in order of precedence, one of whose words occurs."""
    low, out = F.lower(question), F.lit("factual")
    for name, words in reversed(INTENT_WORDS):
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def is_multi_hop(question: Column) -> Column:
    low = F.lower(question)
    return F.exists(F.array(*[F.lit(p) for p in MULTI_HOP_PHRASES]), lambda p: F.contains(low, p))


def path_hint_pattern() -> str:
    suffixes = "|".join(["py", *sorted(s.lstrip(".") for s in SOURCE_LANGUAGES)])
    return rf"[\w./-]+\.(?:{suffixes})\b"


def hinted_paths(question: Column) -> Column:
    ticks = F.regexp_extract_all(question, F.lit("`([^`]+)`"), F.lit(1))
    quoted = F.filter(ticks, lambda h: F.contains(h, F.lit("/")) | F.regexp_like(h, F.lit(f"^(?:{path_hint_pattern()})$")))
    return F.array_distinct(F.concat(quoted, F.regexp_extract_all(question, F.lit(path_hint_pattern()), F.lit(0))))


def hinted_symbols(question: Column) -> Column:
    ticks = F.regexp_extract_all(question, F.lit("`([^`]+)`"), F.lit(1))
    is_path = lambda h: F.contains(h, F.lit("/")) | F.regexp_like(h, F.lit(f"^(?:{path_hint_pattern()})$"))
    return F.array_distinct(F.filter(ticks, lambda h: ~is_path(h) & (F.contains(h, F.lit(".")) | F.contains(h, F.lit("_")))))


def lexical_query(question: Column, symbols: Column) -> Column:
    """The question and those symbols that it does not spell already."""
    extra = F.filter(symbols, lambda s: ~F.contains(question, s))
    return F.array_join(F.concat(F.array(question), extra), " ")


def contains_all(text: Column, words: Column) -> Column:
    return F.forall(words, lambda w: F.contains(F.lower(text), F.lower(w)))


def contains_any(text: Column, words: Column) -> Column:
    """Any word occurs, case ignored; no words is a match."""
    return (F.size(words) == 0) | F.exists(words, lambda w: F.contains(F.lower(text), F.lower(w)))


def overclaim(text: Column) -> Column:
    """The first phrase that is too certain for a suspicion, or null."""
    return F.nullif(F.regexp_extract(text, TOO_CERTAIN, 0), F.lit(""))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds given outright, or until an HTTP date, never negative."""
    seconds = header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    return F.greatest(F.lit(0.0), F.coalesce(seconds, (date.cast("long") - now.cast("long")).cast("double")))


def token_estimate(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4).cast("int")))


def sse_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def parse_sse(frame: Column) -> Column:
    """(event, data) of a frame; data lines are joined, comments such as heartbeats have neither."""
    lines = F.split(frame, "\n")
    said = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}: ")), lambda x: F.substr(x, F.lit(len(name) + 3)))
    data = said("data")
    return F.struct(F.get(said("event"), F.lit(0)).alias("event"), F.when(F.size(data) > 0, F.array_join(data, "\n")).alias("data"))


def first_impression(files: Column, lines: Column, hubs: Column, entries: Column) -> Column:
    named = lambda xs, none: F.coalesce(F.nullif(F.array_join(F.transform(xs, short_name), ", "), F.lit("")), F.lit(none))
    return F.format_string("Indexed snapshot across %d files and %d lines. Primary entry points: %s. Structural hubs: %s.", files, lines, named(entries, NO_ENTRY_NAMES), named(hubs, NO_HUB_NAMES))


def weighted_terms(weights: Column) -> Column:
    """`name=0.50, ...` by weight, then name."""
    pairs = F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k"))))
    return F.array_join(F.transform(pairs, lambda p: F.format_string("%s=%.2f", p["k"], -p["w"])), ", ")


def goal_anchor(profile: Column, plan: Column, laws: Column | str) -> Column:
    """The block that opens every prompt: the reader's goal, the plan's tilts and the caller's laws.

    profile: struct of raw_text, modality_weights, focus_keywords, audience_framing, success_criterion; plan: struct of
    active, output_shape, cartographer_tilt, flow_tracer_targets, lane_b_framing. Lines whose value is
    null or blank are left out.
    """
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    line = lambda head, value: F.concat(F.lit(head), value)
    listed = lambda c: F.nullif(F.array_join(c, ", "), F.lit(""))
    goal = [
        F.lit(GOAL_HEAD), F.concat(F.lit('  "'), F.trim(profile["raw_text"]), F.lit('"')),
        line(GOAL_WEIGHTS, F.coalesce(F.nullif(weighted_terms(profile["modality_weights"]), F.lit("")), F.lit(NO_WEIGHTS))),
        line(GOAL_KEYWORDS, F.coalesce(listed(profile["focus_keywords"]), F.lit(NO_KEYWORDS))),
        line(GOAL_AUDIENCE, some(profile["audience_framing"])), line(GOAL_SUCCESS, some(profile["success_criterion"])),
    ]
    tilts = [
        F.lit(PLAN_HEAD), line(PLAN_ACTIVE, F.array_join(plan["active"], ", ")), line(PLAN_SHAPE, plan["output_shape"]),
        line(PLAN_HUBS, some(plan["cartographer_tilt"])), line(PLAN_TARGETS, some(listed(plan["flow_tracer_targets"]))), line(PLAN_LANE_B, some(plan["lane_b_framing"])),
    ]
    return F.concat_ws("\n", *goal, F.lit(""), *tilts, F.lit(""), F.lit(laws) if isinstance(laws, str) else laws)
