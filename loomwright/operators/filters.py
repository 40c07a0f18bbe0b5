"""Corpus filters. Each is a Column or a DataFrame step that Catalyst can push to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import INDEX_VERSION, NON_SOURCE_PREFIXES, PRIORITY_PREFIXES


def similar_to(pattern: str) -> str:
    """SQL SIMILAR TO pattern as an anchored regular expression."""
    out = "".join({"%": ".*", "_": "."}.get(c, "\\" + c if c in ".^$\\" else c) for c in pattern)
    return f"^(?:{out})$"


def corpus_filter(repo: str | None = None, *, kind: str | None = None, prefix: str | None = None, glob: str | None = None, exclude: tuple[str, ...] = (), repo_column: str = "repo_id", kind_column: str = "kind", path_column: str = "file_path") -> Column:
    """Conjunction of the given conditions; values are literals, never SQL text."""
    path, parts = F.col(path_column), []
    if repo is not None:
        parts.append(F.col(repo_column) == repo)
    if kind is not None:
        parts.append(F.col(kind_column) == kind)
    if prefix is not None:
        parts.append(path.startswith(prefix))
    if glob is not None:
        parts.append(path.rlike(similar_to(glob)))
    parts += [~path.startswith(p) for p in exclude]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def exclusions_for(keywords: list[str], exclude: tuple[str, ...] = NON_SOURCE_PREFIXES) -> tuple[str, ...]:
    """Default exclusions without those that a reader's priorities need."""
    import re

    wanted = {p for k in keywords for w in re.findall("[a-z]+", k.lower()) for p in PRIORITY_PREFIXES.get(w, ())}
    return tuple(p for p in exclude if p not in wanted)


def exclusions_column(keywords: Column) -> Column:
    """The same for a column of keyword arrays."""
    words = F.flatten(F.transform(keywords, lambda k: F.regexp_extract_all(F.lower(k), F.lit("[a-z]+"), F.lit(0))))
    table = F.create_map(*[x for k, v in sorted(PRIORITY_PREFIXES.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
    unlocked = F.flatten(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull()))
    return F.array_except(F.array(*map(F.lit, NON_SOURCE_PREFIXES)), unlocked)


def single_path_prefix(intent: Column, multi_hop: Column, paths: Column) -> Column:
    """Prefix to restrict a where-is question of one path to; a last segment without a dot is a folder."""
    path = F.get(paths, F.lit(0))
    is_file = F.contains(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1), F.lit("."))
    return F.when((intent == "where_is") & ~multi_hop & (F.size(paths) == 1), F.when(is_file, path).otherwise(F.concat(F.rtrim(path, F.lit("/")), F.lit("/"))))


def mentions_test(path: Column) -> Column:
    """Paths of tests; an underscore in these patterns stands for any character."""
    return path.like("%tests/%") | path.like("test_%") | path.like("%_test.py")


def with_slug(df: DataFrame, slug: str, column: str = "url") -> DataFrame:
    return df.where(F.col(column).ilike(f"%/{slug}"))


def snapshots_of(repos: DataFrame, owner_and_name: str) -> DataFrame:
    return repos.where(F.col("id").startswith(f"{owner_and_name}@"))


def current_recipe(repos: DataFrame, version: int = INDEX_VERSION) -> DataFrame:
    return repos.where(F.col("index_version") >= version)


def scrub(df: DataFrame, fields: tuple[str, ...] = ("content", "prompt", "response", "text")) -> DataFrame:
    return df.drop(*[f for f in fields if f in df.columns])
