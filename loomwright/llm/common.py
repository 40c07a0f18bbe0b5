"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters that are neither space nor \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words; no word gives an empty array. One regex pass, no per-element lambda."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def n_words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def shared_folder(spark) -> str:
    """The cluster's shared checkpoint folder, from the session (spark.checkpoint.dir).

    Where none is set a temporary one is made, but only if driver and executors are one local process;
    on a cluster that would be a folder of each machine, so there it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def delete(spark, path: str) -> None:
    """Removes a file or folder through Hadoop's file systems, so on any store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables an operator writes to the shared folder and reads again: lineage ends there.

    They are compressed Parquet, so they outlive executors, read back in few partitions however many
    tasks wrote them, and have a known size, by which Spark chooses broadcasts itself. The operator
    drops each once nothing reads it; what its result needs stays until the scope ends, or, outside any
    `scope`, for good.
    """

    open_scopes: list[list[Scratch]] = []

    def __init__(self, spark) -> None:
        self.spark, self.folder, self.tables = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex}", []
        if self.open_scopes:
            self.open_scopes[-1].append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *gone: DataFrame) -> None:
        for out, path in self.tables:
            if any(out is x for x in gone):
                delete(self.spark, path)
        self.tables = [x for x in self.tables if not any(x[0] is y for y in gone)]

    def finish(self, df: DataFrame) -> DataFrame:
        """df as a table of its own; all other tables go."""
        others = [out for out, _ in self.tables]
        out = self.cut(df)
        self.drop(*others)
        return out

    def clear(self) -> None:
        delete(self.spark, self.folder)
        self.tables = []


@contextmanager
def scope(spark):
    """On leaving, deletes the tables of all operators called within. Write their results before that."""
    made: list[Scratch] = []
    Scratch.open_scopes.append(made)
    try:
        yield
    finally:
        Scratch.open_scopes.remove(made)
        for x in made:
            x.clear()
        release(spark)


def release(spark) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more.

    They go when the driver's garbage is collected; iterative operators make many before it is.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unit_hash(*columns: Column) -> Column:
    """Deterministic draw in (0, 1) from the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


#: Bits of the filter that `likely_in` sends to all tasks: 8 MB whatever it is built from.
FILTER_BITS = 1 << 26


def likely_in(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows whose key may be among the wanted keys: all that are, and a few more.

    A bitmap of FILTER_BITS bits, one for each wanted key's hash, goes to every task, so that rows a
    join would drop anyway need not be shuffled. Its size is fixed; once more keys are wanted than it
    has bits it merely lets more rows through. The exact join has to follow.
    """
    at = lambda k: F.pmod(F.xxhash64(F.lit("filter"), k), F.lit(FILTER_BITS))
    bits = wanted.select(at(wanted_key).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    hashed = rows.withColumn("_at", at(key)).withColumn("_b", F.bitmap_bucket_number("_at"))
    joined = hashed.join(F.broadcast(bits), F.col("_b") == F.col("_bucket"))
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)), 16, 10) as int)"
    return joined.where(F.expr(f"shiftright({byte}, cast(bitmap_bit_position(_at) % 8 as int)) & 1 = 1")).select(*rows.columns)
