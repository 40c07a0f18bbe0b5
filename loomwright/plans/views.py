"""Stand-in tables: the driver's tables in the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark, sf_dir: str) -> DataFrame:
    """Documents as chunks: kind is the language, the file lies under the source."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    symbol = F.concat("source", F.lit(".TextUnit_"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("kind"), path.alias("file_path"), symbol.alias("symbol"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.col("text").alias("content"), "source")


def questions(spark, sf_dir: str) -> DataFrame:
    """One question for each embedding of an id divisible by 50: the text of that document."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return e.join(d, e["vec_id"] == d["doc_id"]).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("text").alias("query"))


def trade_edges(spark, sf_dir: str) -> DataFrame:
    """Line items as edges from suppliers to parts; the return flag gives the type."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "calls").when(F.col("l_returnflag") == "A", "imports").otherwise("inherits")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), kind.alias("type"))


def place_edges(spark, sf_dir: str) -> DataFrame:
    """Customers and suppliers call their nation, nations their region."""
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    return (
        c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
        .union(s.select(name("s", "s_suppkey"), name("n", "s_nationkey")))
        .union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
        .withColumn("type", F.lit("calls"))
    )


def order_chunks(spark, sf_dir: str) -> DataFrame:
    """Line items as spans: the part is the symbol, the supplier its file."""
    li = table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 10).cast("int")
    return li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("symbol"), F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("file_path"), start.alias("start_line"), (start + F.col("l_quantity").cast("int")).alias("end_line"), F.col("l_linestatus").alias("kind"), "l_orderkey")
