"""Usage events as streams. Windows with late data are extensions beyond the batch operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEDGER = "session_id string, resource_id string, status string, granted boolean, used int"


def allowance_stream(events: DataFrame, limit: int = 1) -> DataFrame:
    """Folds reserve / completed / failed events of each session; a row for each event that changes it.

    events: session_id, resource_id, status, created_at. State is the map of a session's live
    reservations; a resource that is reserved again is the same reservation, a failed one is given back.
    """

    def fold(key, frames, state: GroupState):
        live: dict[str, str] = dict(zip(*state.get)) if state.exists else {}
        rows = []
        for f in frames:
            for r in f.sort_values("created_at").itertuples():
                if r.status == "failed":
                    live.pop(r.resource_id, None)
                    granted = False
                elif r.resource_id in live or len(live) < limit:
                    live[r.resource_id] = r.status
                    granted = True
                else:
                    granted = False
                rows.append((key[0], r.resource_id, r.status, granted, len(live)))
        state.update((list(live), list(live.values())))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEDGER.split(", ")])

    return events.groupBy("session_id").applyInPandasWithState(fold, LEDGER, "resources array<string>, statuses array<string>", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, *, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding event-time windows with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(window.alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def daily_parts(events: DataFrame) -> DataFrame:
    """day, user_id, event_type, n, total, first_at, last_at: what a batch of events adds to the ledger.

    total is exact, the values being taken to two decimals. Every column merges by sums, minima and maxima.
    """
    day = F.to_date("ts")
    value = F.coalesce(F.col("value").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    return events.groupBy(day.alias("day"), "user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).cast("decimal(28,2)").alias("total"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def merged_parts(parts: DataFrame, errors: str = "error") -> DataFrame:
    """day, user_id, events, kinds, failed, total, first_at, last_at of the parts of all batches."""
    return parts.groupBy("day", "user_id").agg(
        F.sum("n").alias("events"), F.countDistinct("event_type").alias("kinds"), F.coalesce(F.sum(F.when(F.col("event_type") == errors, F.col("n"))), F.lit(0)).alias("failed"),
        F.sum("total").cast("decimal(28,2)").alias("total"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def usable_events(events: DataFrame):
    """Condition under which an event can be put down to a day and a user."""
    return F.col("ts").isNotNull() & F.col("user_id").isNotNull()


class DailyLedger:
    """Folds micro-batches of events into a ledger by day, touching only the days a batch holds.

    A batch first writes its parts under its own number, then the days it touches are summed up anew from
    the parts of all batches. Both writes replace whole partitions, so a batch that is replayed after
    a crash, wherever it broke off, leaves the same files. `refused` keeps events without a time or user.
    """

    def __init__(self, root: str, errors: str = "error") -> None:
        self.parts, self.ledger, self.refused, self.errors = f"{root}/parts", f"{root}/ledger", f"{root}/refused", errors

    @staticmethod
    def _replace(df: DataFrame, path: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def add(self, events: DataFrame, batch: int) -> None:
        spark, good = events.sparkSession, usable_events(events)
        self._replace(events.where(~good).withColumn("batch", F.lit(batch)), self.refused, "batch")
        self._replace(daily_parts(events.where(good)).withColumn("batch", F.lit(batch)), self.parts, "day", "batch")
        parts = self.read_parts(spark)
        touched = parts.where(F.col("batch") == batch).select("day").distinct()
        self._replace(merged_parts(parts.join(touched, "day", "left_semi"), self.errors), self.ledger, "day")

    def read_parts(self, spark) -> DataFrame:
        return spark.read.schema("user_id long, event_type string, n long, total decimal(28,2), first_at timestamp_ntz, last_at timestamp_ntz, day date, batch long").parquet(self.parts)

    def read(self, spark) -> DataFrame:
        return spark.read.schema("user_id long, events long, kinds long, failed long, total decimal(28,2), first_at timestamp_ntz, last_at timestamp_ntz, day date").parquet(self.ledger)


def upsert_stream(changes: DataFrame, write: Callable[[DataFrame], None], read: Callable[[], DataFrame], key: list[str], order: str, checkpoint: str):
    """Applies micro-batches of changes to a table; read and write are the caller's, and write must replace atomically."""
    from ..operators.ledger import upsert

    def apply(batch: DataFrame, _: int) -> None:
        write(upsert(read(), batch, key, order))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
