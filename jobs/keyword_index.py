"""Keyword index of a document collection, and the best documents for a table of questions.

    python -m jobs.keyword_index --documents PATH --questions PATH --target DIR [--config FILE] [--slices N] ...

Reads documents (doc_id, text, source) and questions (item_id, text), Parquet each. Writes

    TARGET/index/blocks/part=...    postings in blocks by impact, with bounds
    TARGET/index/vectors/slice=...  term weights of each document
    TARGET/answers/bucket=...       item_id, rank, doc_id, score, quotes

quotes tells that the document holds the question's text word for word. Every run writes all of it anew, so a
run that broke off is made good by the next, and the same input gives the same files' rows. Rows without an id
or text are left out and counted in the log.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import defaults, from_command_line, log
from loomwright.operators import stored_index
from loomwright.plans import queries as own
from loomwright.session import get_session
from loomwright.storage import Tables, fresh_folder


def run(spark: SparkSession, config: dict) -> dict[str, int]:
    """Writes index and answers; the numbers of rows read and written."""
    out, root = log("keyword_index"), config["target"]
    read = lambda path, ident: spark.read.parquet(path).withColumn("usable", F.col(ident).isNotNull() & F.col("text").isNotNull())
    documents, questions = read(config["documents"], "doc_id"), read(config["questions"], "item_id")
    told = {}
    for name, df in (("documents", documents), ("questions", questions)):
        n = df.agg(F.count(F.lit(1)).alias("all"), F.count_if("usable").alias("used")).first()
        told[name] = n["used"]
        out.info("read %d %s of %s, %d without id or text left out", n["all"], name, config[name], n["all"] - n["used"])
    texts = documents.where("usable").select(F.col("doc_id").alias("chunk_id"), F.concat(F.coalesce("source", F.lit("")), F.lit(".TextUnit_"), F.col("doc_id").cast("string")).alias("symbol"), F.col("text").alias("content"))
    stored_index.write(texts, f"{root}/index", slices=config["slices"])
    asked = questions.where("usable").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    tables = Tables(spark, "found")
    found = tables.cut(stored_index.StoredIndex(spark, f"{root}/index").top_k(asked, config["answers"]))  # of known size, so that texts need not move
    quoted = found.join(texts.select(F.col("chunk_id").alias("id"), "content"), "id").join(asked, "query_id")
    answers = quoted.select(
        F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score", F.contains("content", "query").alias("quotes"),
        F.pmod(F.xxhash64("query_id"), F.lit(config["buckets"])).cast("int").alias("bucket"))
    answers.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{root}/answers")
    tables.drop(found)
    told["answers"] = spark.read.parquet(f"{root}/answers").count()
    out.info("wrote %d answers to %s/answers", told["answers"], root)
    return told


def job1_keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the benchmark over all documents after two runs into one new folder."""
    config = defaults("keyword_index") | {"documents": f"{sf_dir}/documents.parquet", "questions": f"{sf_dir}/benchmark.parquet", "target": fresh_folder(spark, "keyword-index")}
    for _ in range(2):
        run(spark, config)
    return spark.read.parquet(f"{config['target']}/answers").select("item_id", "rank", "doc_id", "score", "quotes")


_CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, coalesce(source, '') || '.TextUnit_' || doc_id AS symbol, text AS content FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"
_QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)"
JOB1_SQL = f"""WITH {_CHUNKS}, {_QUESTIONS}, {own._TERMS}, {own._POSTINGS}, {own._SPARSE}
SELECT s.query_id AS item_id, s.rank, s.chunk_id AS doc_id, s.score, contains(c.content, q.query) AS quotes FROM sparse s JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id) WHERE s.rank <= 10"""


def main(argv: list[str] | None = None) -> None:
    config = from_command_line("keyword_index", __doc__.splitlines()[0], argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = get_session("keyword-index")
    try:
        run(spark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
