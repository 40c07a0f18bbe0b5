"""Protocols of the models that callers inject. None is shipped; defaults are deterministic."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float] | None]: ...


class Scorer(Protocol):
    """Relevance of (question, text) pairs."""

    def __call__(self, queries: list[str], texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    """Text for each prompt; None where the model gave none."""

    def __call__(self, prompts: list[str]) -> list[str | None]: ...


def summarise(chunks, generate: Generator, *, failures: int = 5):
    """Adds `summary` to chunks(symbol, kind, file_path, content); after so many failures in a row a task uses fallbacks."""
    from pyspark.sql import functions as F

    from .functions import text

    @F.pandas_udf("string")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = 0  # failures in a row, over all batches of the task
        for content in parts:
            out = []
            for c in content:
                got = None
                if run < failures:
                    try:
                        got = generate([c])[0]
                    except Exception:
                        got = None
                    run = 0 if got else run + 1
                out.append(got)
            yield pd.Series(out, dtype="object")

    return chunks.withColumn("summary", F.coalesce(made("content"), text.fallback_summary(F.col("symbol"), F.col("kind"), F.col("file_path"))))


def resummarise(chunks, generate: Generator):
    """Replaces placeholder summaries only; (chunks, those that still lack one)."""
    from pyspark.sql import functions as F

    from .functions import text

    need = text.is_placeholder_summary(F.col("summary"))
    done = summarise(chunks.where(need).drop("summary"), generate)
    out = chunks.where(~need).unionByName(done)
    return out, out.where(text.is_placeholder_summary(F.col("summary")))


def verdicts(claims, judge: Generator, cache):
    """claim_key, decision of claims(text, evidence): cached ones, then the model's, parsed tolerantly."""
    from pyspark.sql import functions as F

    from .functions import scalar

    keyed = claims.withColumn("claim_key", F.sha2(F.concat_ws("\0", "text", "evidence"), 256)).dropDuplicates(["claim_key"])
    hits = keyed.join(cache, "claim_key").select("claim_key", "decision")
    misses = keyed.join(cache, "claim_key", "left_anti")

    @F.pandas_udf("string")
    def said(text, evidence):
        import pandas as pd

        return pd.Series(judge([f"{t}\n{e}" for t, e in zip(text, evidence, strict=True)]), dtype="object")

    fresh = misses.select("claim_key", F.coalesce(scalar.verdict(said("text", "evidence"), ["verified", "rejected"]), F.lit("rejected")).alias("decision"))
    return hits.unionByName(fresh)
