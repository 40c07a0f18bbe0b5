"""Snapshots, upserts, tours, usage events and allowances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import COVERAGE


def coverage(snapshots: DataFrame, chunks: DataFrame, embedded: DataFrame, *, key: str = "repo_id", chunk: str = "chunk_id") -> DataFrame:
    """key, n_chunks, n_embedded: both counts in one aggregation of the left join."""
    joined = chunks.select(key, chunk).join(embedded.select(chunk, F.lit(1).alias("e")), chunk, "left")
    counts = joined.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.count("e").alias("n_embedded"))
    return snapshots.select(key).distinct().join(counts, key)


def complete(counts: DataFrame, share: float = COVERAGE) -> DataFrame:
    """Snapshots with chunks of which at least `share` are embedded (1.0: all)."""
    return counts.where((F.col("n_chunks") > 0) & (F.col("n_embedded") >= share * F.col("n_chunks")))


def latest(df: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """The newest row of each key, ties to the larger `tie`. One aggregation, no sort of a key's rows."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct(by, tie)).alias("_r")).select("_r.*")


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def having(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Current rows with changes applied: the last change of a key wins, columns as in current."""
    both = current.withColumn("_o", F.lit(None).cast(changes.schema[order].dataType)).withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_o", F.col(order)).withColumn("_new", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*[F.col(c) for c in current.columns])
    return both.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by(row, F.struct("_new", "_o")).alias("_r")).select("_r.*")


def tours_with_counts(tours: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    counts = messages.groupBy(key).agg(F.count(F.lit(1)).alias("message_count"))
    return tours.join(counts, key, "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def message_ordinals(messages: DataFrame, key: str, order: str) -> DataFrame:
    return messages.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def next_ordinal(messages: DataFrame, key: str) -> DataFrame:
    return messages.groupBy(key).agg(F.count(F.lit(1)).alias("next_ordinal"))


def allowance(events: DataFrame, key: str, action: str, *, limit: int = 1, counted: tuple[str, ...] = ("reserved", "completed"), action_column: str = "action", status: str = "status") -> DataFrame:
    """key, used, remaining; a reservation counts unless it failed."""
    used = F.count_if((F.col(action_column) == action) & F.col(status).isin(*counted))
    return events.groupBy(key).agg(used.alias("used")).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))


def reservations(events: DataFrame) -> DataFrame:
    """Latest status of each reservation (session_id, action, resource_id) and whether it was granted.

    events: session_id, action, resource_id, status, created_at, id. A resource that is reserved again
    counts once; of a session's reservations that did not fail, the first is granted.
    """
    state = events.groupBy("session_id", "action", "resource_id").agg(
        F.max_by("status", F.struct("created_at", "id")).alias("status"), F.min(F.struct("created_at", "id")).alias("since"))
    live = Window.partitionBy("session_id", "action", F.col("status") == "failed").orderBy("since")
    return state.withColumn("granted", (F.col("status") != "failed") & (F.row_number().over(live) == 1)).drop("since")


def recently_seen(accounts: DataFrame, visits: DataFrame) -> DataFrame:
    """Accounts with last_seen_at moved to the newest visit."""
    seen = visits.groupBy("session_id").agg(F.max("at").alias("at"))
    return accounts.join(seen, "session_id", "left").withColumn("last_seen_at", F.greatest("last_seen_at", "at")).drop("at")


def revisit_status(wanted: DataFrame, indexed: DataFrame) -> DataFrame:
    """url, status: already_indexed if the newest snapshot has the wanted head, else stale."""
    newest = latest(indexed, "url", "indexed_at", "head_sha").select("url", F.col("head_sha").alias("have"))
    known = wanted.join(newest, "url", "left")
    return known.select("url", F.when(F.col("have") == F.col("head_sha"), "already_indexed").otherwise("stale").alias("status"))


def lookup(keys: DataFrame, cache: DataFrame, *, ttl_days: int = 30, now: str = "current_timestamp()") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of keys(key) in cache(key, value, created_at), older entries left out."""
    fresh = cache.where(F.expr(f"created_at >= {now} - INTERVAL {int(ttl_days)} DAYS"))
    return keys.join(fresh, "key"), keys.join(fresh.select("key"), "key", "left_anti")


def keep_recent(verdicts: DataFrame, size: int = 2048) -> DataFrame:
    """The most recently used rows of a cache table."""
    return verdicts.orderBy(F.col("last_used").desc(), "key").limit(size)


def tokens_by_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def index_counts(chunks: DataFrame, edges: DataFrame, nodes: DataFrame, *, key: str = "repo_id") -> DataFrame:
    """key, files, chunks, call_edges, nodes of each snapshot; what a table lacks is 0."""
    pairs = edges.where("type = 'calls'").select(key, "src", "dst").distinct()
    per = lambda df, *aggs: df.groupBy(key).agg(*aggs)
    out = per(chunks, F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"))
    out = out.join(per(pairs, F.count(F.lit(1)).alias("call_edges")), key, "left").join(per(nodes, F.count(F.lit(1)).alias("nodes")), key, "left")
    return out.fillna(0, ["call_edges", "nodes"])
