"""Snapshot tables on Parquet: two-phase writes with a manifest, conditional deletes, reports, codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import INDEX_VERSION


def read_chunks(spark, path: str, repo: str, columns: tuple[str, ...] = ("file_path", "start_line", "end_line", "symbol", "kind", "content")) -> DataFrame:
    """Chunk columns of one repository; the partition filter prunes the others."""
    return spark.read.parquet(path).where(F.col("repo_id") == repo).select(*columns)


def write_snapshot(tables: dict[str, DataFrame], root: str, manifest_row: DataFrame) -> None:
    """Replaces a repository's partitions in every table, then appends its manifest row last.

    A reader trusts only snapshots in the manifest, so a write that dies half-way is never seen.
    Refuses an index without chunks.
    """
    if tables["chunks"].isEmpty():
        raise ValueError("a snapshot needs at least one chunk")
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{root}/{name}")
    manifest_row.write.mode("append").parquet(f"{root}/manifest")


def manifest_entry(spark, repo: str, url: str, head: str, loc: int, files: int) -> DataFrame:
    row = spark.createDataFrame([(repo, url, head, loc, files, INDEX_VERSION)], "repo_id string, url string, head_sha string, loc_total int, file_count int, index_version int")
    return row.withColumn("indexed_at", F.current_timestamp())


def published(spark, root: str) -> DataFrame:
    """Newest manifest row of each snapshot of the current recipe or a later one."""
    from ..operators.ledger import latest

    return latest(spark.read.parquet(f"{root}/manifest"), "repo_id", "indexed_at", "head_sha").where(F.col("index_version") >= INDEX_VERSION)


def drop_stale(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Chunks of snapshots of which every chunk is embedded; those of the others go."""
    stale = chunks.join(embedded.select("chunk_id"), "chunk_id", "left_anti").select("repo_id").distinct()
    return chunks.join(stale, "repo_id", "left_anti")


def write_report(metrics: DataFrame, path: str) -> None:
    """One JSON file of metric rows; the caller names it by stamp."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def latest_report(reports: DataFrame) -> DataFrame:
    """The newest row of each suite by stamp, ties to the larger value."""
    return reports.groupBy("suite").agg(F.max(F.struct("stamp", "value")).alias("r")).select("suite", "r.*")


def metric_table(long: DataFrame, metrics: list[str]) -> DataFrame:
    """repo rows, metric columns, in name order."""
    return long.groupBy("repo").pivot("metric", sorted(metrics)).agg(F.first("value"))


def write_csv(wide: DataFrame, path: str) -> None:
    wide.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def propose_labels(dense: DataFrame, chunks: DataFrame, noise: tuple[str, ...], keep: int = 6, pool: int = 150) -> DataFrame:
    """First candidates of each question's dense ranking outside noise paths."""
    from pyspark.sql import Window

    from ..operators.filters import corpus_filter

    hits = dense.where(F.col("rank") <= pool).join(chunks, "chunk_id").where(corpus_filter(exclude=noise))
    return hits.withColumn("label_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("label_rank") <= keep)


def reviewed(labels: DataFrame) -> DataFrame:
    return labels.where("reviewed AND NOT coalesce(rejected, false)").drop("reviewed", "rejected")
