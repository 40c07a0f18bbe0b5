"""Usage ledger by day and user from an events folder that grows: a stream that takes what is new and ends.

    python -m jobs.usage_ledger --source DIR --target DIR [--config FILE] [--files-per-batch N]

Reads Parquet files of events (ts, user_id, event_type, value; other columns are ignored) that no earlier run has
read (SOURCE is a folder or, as for a single file, a pattern); the stream's checkpoint in TARGET/checkpoint remembers which. Writes

    TARGET/ledger/day=...           user_id, events, kinds, failed, total, first_at, last_at
    TARGET/parts/day=.../batch=...  what each batch adds, summed by user and type
    TARGET/refused/batch=...        events without a time or a user, as they came

A run without new files changes nothing. A run that breaks off anywhere is made good by the next one: the
batch it was at is replayed and replaces its own files. Days are UTC.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import defaults, from_command_line, log
from loomwright.session import get_session
from loomwright.storage import fresh_folder, settings
from loomwright.streaming.usage import DailyLedger

COLUMNS = ("ts", "user_id", "event_type", "value")


def run(spark: SparkSession, config: dict) -> dict[str, int]:
    """Takes in all new files; the numbers of batches and events it read."""
    out, root = log("usage_ledger"), config["target"]
    ledger, seen = DailyLedger(root, config["error_type"]), {"batches": 0, "events": 0}
    with settings(spark, spark__sql__session__timeZone="UTC"):
        schema = spark.read.parquet(config["source"]).schema
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(config["source"])
        narrow = events.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("value").cast("double").alias("value"))

        def take(batch: DataFrame, number: int) -> None:
            ledger.add(batch, number)
            parts = ledger.read_parts(spark).where(F.col("batch") == number)
            told = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.countDistinct("day").alias("days")).first()
            seen["batches"] += 1
            seen["events"] += told["events"]
            out.info("batch %d: read %d events, wrote %d days of %s", number, told["events"], told["days"], ledger.ledger)

        stream = narrow.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
    out.info("read %d new events of %s in %d batches", seen["events"], config["source"], seen["batches"])
    return seen


def job2_usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all events after two runs into one new folder; the second finds nothing new."""
    config = defaults("usage_ledger") | {"source": f"{sf_dir}/event[s].parquet", "target": fresh_folder(spark, "usage-ledger")}
    for _ in range(2):
        run(spark, config)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return DailyLedger(config["target"]).read(spark).select(F.col("day").cast("string").alias("day"), "user_id", "events", "kinds", "failed", F.col("total").cast("string").alias("total"), stamp("first_at"), stamp("last_at"))


JOB2_SQL = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'error') AS failed,
  CAST(CAST(sum(coalesce(CAST(value AS DECIMAL(18, 2)), 0)) AS DECIMAL(28, 2)) AS VARCHAR) AS total, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at
FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY CAST(ts AS DATE), user_id
"""


def main(argv: list[str] | None = None) -> None:
    config = from_command_line("usage_ledger", __doc__.splitlines()[0], argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = get_session("usage-ledger")
    try:
        run(spark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
