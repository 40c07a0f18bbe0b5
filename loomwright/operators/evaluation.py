"""Ranking quality, grounding, latency and significance over tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def overlapping(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank, expected_id) where a hit's lines meet an expected span of the same file."""
    on = ["query_id", "file_path"]
    both = hits.select(*on, "rank", F.col("start_line").alias("hs"), F.col("end_line").alias("he")).join(
        expected.select(*on, "expected_id", F.col("start_line").alias("es"), F.col("end_line").alias("ee")), on)
    return both.where("hs <= ee AND he >= es").select("query_id", "rank", "expected_id")


def relevance(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, rank, rel: each expected span credits at most one hit, hits in rank order.

    The greedy match is a fold over the matches of one question, which its ranked list bounds.
    """
    met = overlapping(hits, expected).groupBy("query_id", "rank").agg(F.array_sort(F.collect_set("expected_id")).alias("options"))
    ordered = met.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "options"))).alias("m"))
    kind = f"array<{expected.schema['expected_id'].dataType.simpleString()}>"
    start = F.struct(F.array().cast("array<int>").alias("ranks"), F.array().cast(kind).alias("used"))
    def step(acc, x):
        free = F.array_except(x["options"], acc["used"])
        taken = F.struct(F.concat(acc["ranks"], F.array(x["rank"].cast("int"))).alias("ranks"), F.concat(acc["used"], F.slice(free, 1, 1)).alias("used"))
        return F.when(F.size(free) > 0, taken).otherwise(acc)
    credited = ordered.select("query_id", F.explode(F.aggregate("m", start, step, lambda a: a["ranks"])).alias("rank"), F.lit(1).alias("rel"))
    return hits.select("query_id", "rank").join(credited, ["query_id", "rank"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def ranking_metrics(rels: DataFrame, expected_counts: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """query_id, n_expected, recall_k, ndcg_k, mrr from rels(query_id, rank, rel) and (query_id, n_expected).

    Nothing expected counts as a perfect case.
    """
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    aggs: list[Column] = [F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr")]
    for k in ks:
        within = F.col("rank") <= k
        aggs += [F.sum(F.when(within, F.col("rel")).otherwise(0)).alias(f"_r{k}"), F.sum(F.when(within, gain).otherwise(0.0)).alias(f"_g{k}")]
    out = expected_counts.join(rels.groupBy("query_id").agg(*aggs), "query_id", "left").withColumn("mrr", F.coalesce("mrr", F.lit(0.0)))
    for k in ks:
        top = F.least(F.col("n_expected"), F.lit(k)).cast("int")
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        none = F.col("n_expected") == 0
        out = out.withColumn(f"recall_{k}", F.when(none, 1.0).otherwise(F.coalesce(f"_r{k}", F.lit(0)) / F.col("n_expected")))
        out = out.withColumn(f"ndcg_{k}", F.when(none, 1.0).otherwise(F.coalesce(f"_g{k}", F.lit(0.0)) / ideal))
    return out.drop(*[f"_{x}{k}" for k in ks for x in "rg"])


def diversity(hits: DataFrame, top: int = 5) -> DataFrame:
    """query_id, diversity: distinct files among the first hits over their number."""
    head = hits.where(F.col("rank") <= top)
    return head.groupBy("query_id").agg((F.countDistinct("file_path") / F.least(F.lit(top), F.count(F.lit(1)))).alias("diversity"))


def means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Averages over all rows; 0 without rows."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def grounding(cases: DataFrame) -> DataFrame:
    """Rates over cases(claims, verified, all_keywords, refs_cited, not_in_repo, not_found, hops)."""
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    answerable = ~F.col("not_in_repo")
    return cases.agg(
        F.count(F.lit(1)).alias("total"),
        rate((F.col("claims") > 0) & (F.col("verified") == F.col("claims"))).alias("grounded_all"),
        ratio(F.sum("verified").cast("double"), F.sum("claims").cast("double")).alias("claim_rate"),
        rate(F.when(answerable, F.col("all_keywords"))).alias("keyword_rate"),
        rate(F.when(answerable, F.col("refs_cited"))).alias("ref_rate"),
        rate(F.when(F.col("not_in_repo"), ~F.col("not_found"))).alias("hallucination_rate"),
        rate(F.col("hops") > 0).alias("multi_hop_rate"),
    )


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.avg((F.col("expected") == F.col("actual")).cast("double")), F.lit(0.0)).alias("accuracy"))


def percentiles(df: DataFrame, value: str, percents: tuple[float, ...] = (50, 95), by: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-rank percentiles p50, p95, ... without collecting a group.

    The position of each rank comes from the group's count, and the value from the row at it.
    """
    keys = [F.col(b) for b in by]
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_to", upto).withColumn("_n", F.sum("_c").over(w))
    place = lambda p: F.bround(F.lit(p / 100) * (F.col("_n") - 1)) + 1
    return rows.groupBy(*keys).agg(*[F.min(F.when(F.col("_to") >= place(p), F.col("_v"))).alias(f"p{p:g}") for p in percents])


def stage_shares(timings: DataFrame, stages: list[str]) -> DataFrame:
    """Mean share of each stage in its question's total, absent stages counting 0, and the rest."""
    at = lambda s: F.coalesce(F.try_element_at("stages", F.lit(s)), F.lit(0.0))
    return timings.agg(*[F.avg(at(s) / F.col("total_ms")).alias(s) for s in stages])


def unaccounted(timings: DataFrame) -> DataFrame:
    """total minus the sum of stages, not below 0."""
    spent = F.aggregate(F.map_values("stages"), F.lit(0.0), lambda a, x: a + x)
    return timings.withColumn("unaccounted_ms", F.greatest(F.lit(0.0), F.col("total_ms") - spent))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """repo, metric, before, after, delta of metrics that both tables hold as numbers."""
    both = before.select("repo", "metric", F.col("value").alias("before")).join(after.select("repo", "metric", F.col("value").alias("after")), ["repo", "metric"])
    return both.where("before IS NOT NULL AND after IS NOT NULL").withColumn("delta", F.col("after") - F.col("before"))


def worst_regressions(delta: DataFrame, prefix: str = "stage_", n: int = 3) -> DataFrame:
    rows = delta.where(F.col("metric").startswith(prefix) & (F.col("delta") > 0))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("delta").desc(), "metric"))).where(F.col("rank") <= n)


def over_budget(delta: DataFrame, metric: str = "latency_p95", factor: float = 1.5) -> DataFrame:
    return delta.where((F.col("metric") == metric) & (F.col("after") > factor * F.col("before")))


def bootstrap(pairs: DataFrame, *, alpha: float = 0.05, resamples: int = 10_000, seed: int = 0, by: str = "metric") -> DataFrame:
    """Paired bootstrap of mean deltas for each metric of pairs(metric, case_id, before, after).

    Draws equal those of the standard generator with this seed, cases in order of case_id. A group is
    one evaluation's cases, so it fits a task.
    """
    kind = pairs.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, n long, mean_before double, mean_after double, mean_delta double, ci_low double, ci_high double, significant boolean"

    def run(frame):
        import random
        from statistics import mean

        import numpy as np
        import pandas as pd

        frame = frame.sort_values("case_id")
        if frame[["before", "after"]].isna().any().any():
            raise ValueError("paired values must both be present")
        before, after = frame["before"].tolist(), frame["after"].tolist()
        delta, rng = [b - a for a, b in zip(before, after, strict=True)], random.Random(seed)
        # The same Mersenne Twister, drawn in blocks: a draw is floor(uniform * n) in both generators.
        source, words, n = np.random.RandomState(), rng.getstate()[1], len(delta)
        source.set_state(("MT19937", np.array(words[:-1], dtype=np.uint32), words[-1]))
        values, block = np.array(delta), max(1, 4_000_000 // n)
        sizes = [min(block, resamples - at) for at in range(0, resamples, block)]
        draws = np.sort(np.concatenate([values[(source.random_sample((k, n)) * n).astype(np.int64)].mean(axis=1) for k in sizes])).tolist()
        low, high = draws[int(alpha / 2 * resamples)], draws[min(int((1 - alpha / 2) * resamples), resamples - 1)]
        return pd.DataFrame([(frame[by].iloc[0], len(delta), mean(before), mean(after), mean(delta), low, high, low > 0 or high < 0)], columns=[c.split()[0] for c in schema.split(", ")])

    return pairs.groupBy(by).applyInPandas(run, schema)


def merged_ranges(df: DataFrame, key: str) -> DataFrame:
    """Joins overlapping and adjacent (start, end) ranges of each key by windows, for groups of any size."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col("start") <= reach + 1, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def dominant(profiles: DataFrame, column: str = "modality_weights") -> DataFrame:
    return profiles.withColumn("dominant", scalar.dominant_key(F.col(column)))
