"""Session factory with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "loomwright", master: str | None = None, **conf: str) -> SparkSession:
    """An active or new session: AQE with skew handling, UTC, Arrow on.

    Nothing cluster-specific is set; shuffle partitions stay the caller's choice because AQE
    coalesces from whatever upper bound the deployment picks.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # With it, Spark 4.1 plans joins on unions whose sides adaptive execution then gives different partition counts.
        "spark.sql.unionOutputPartitioning": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=fixed | conf).getOrCreate()
