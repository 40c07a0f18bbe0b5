"""Write path: files to chunks, graph and vectors, published with a manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.constants import MAX_INDEX_LOC
from ..operators import graph
from ..sources import files, python_code, tables


@dataclass
class Index:
    status: str
    chunks: DataFrame | None = None
    edges: DataFrame | None = None
    nodes: DataFrame | None = None


def build(spark, root: str, repo: str, *, max_loc: int = MAX_INDEX_LOC) -> Index:
    """Chunks with enriched text, nodes and edges of a source tree; unsupported or too_large stop early."""
    found = files.readable(files.discover(files.scan(spark, root)), max_line=1_000_000)
    size = files.lines_of_code(found).first()
    if size["files"] == 0:
        return Index("unsupported")
    if size["loc"] > max_loc:
        return Index("too_large")
    python = python_code.name_modules(found.where("language = 'python'"))
    nodes, edges = python_code.code_graph(python)
    code = python_code.code_chunks(python)
    named = graph.neighbour_names(code, edges)
    enriched = text.enriched_text(F.col("symbol"), F.col("kind"), F.col("signature"), F.col("decorators"), text.keywords(F.col("docstring")), F.col("neighbor_symbols"), F.col("content"))
    columns = ["file_path", "symbol", "kind", "start_line", "end_line", "content", "enriched_text", "signature"]
    coded = named.withColumn("enriched_text", enriched).select(*columns)
    texts = files.text_windows(files.readable(found.where("language <> 'python'"))).select(*columns)
    chunks = coded.unionByName(texts).withColumn("repo_id", F.lit(repo))
    return Index("indexed", chunks, edges.withColumn("repo_id", F.lit(repo)), nodes.withColumn("repo_id", F.lit(repo)))


def publish(spark, index: Index, root: str, repo: str, url: str, head: str) -> str:
    """Writes an index unless the same snapshot is already published."""
    if index.status != "indexed":
        return index.status
    try:
        known = not tables.published(spark, root).where((F.col("repo_id") == repo) & (F.col("head_sha") == head)).isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = False
    if known:
        return "already_indexed"
    counts = index.chunks.agg(F.countDistinct("file_path").alias("files"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("loc")).first()
    entry = tables.manifest_entry(spark, repo, url, head, int(counts["loc"] or 0), int(counts["files"]))
    tables.write_snapshot({"chunks": index.chunks, "edges": index.edges, "nodes": index.nodes}, root, entry)
    return "indexed"
