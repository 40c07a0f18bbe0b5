"""Symbol graphs as edge tables: edges(src, dst, type), nodes(symbol, kind, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.constants import EDGE_PRIORITY, NEIGHBOUR_ORDER
from ..storage import Tables, shared_folder

LOADED = ("calls", "imports", "inherits")


def _place(column: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), column)


def one_edge_per_pair(edges: DataFrame) -> DataFrame:
    """The surviving type of each (src, dst): calls, then inherits, imports, defines."""
    best = F.min_by("type", _place(F.col("type"), EDGE_PRIORITY))
    return edges.groupBy("src", "dst").agg(best.alias("type"))


def loaded(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("type").isin(*LOADED))


def degrees(edges: DataFrame) -> DataFrame:
    """symbol, fan_in, fan_out over distinct pairs, in one aggregation of both ends."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("symbol"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("symbol"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.symbol").alias("symbol")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def hubs(edges: DataFrame, n: int = 20) -> DataFrame:
    calls = edges.where("type = 'calls'").select("src", "dst").distinct()
    return calls.groupBy(F.col("dst").alias("symbol")).agg(F.count(F.lit(1)).alias("score")).orderBy(F.col("score").desc(), "symbol").limit(n)


def entry_points(edges: DataFrame, n: int = 20) -> DataFrame:
    """Symbols that call and that nothing calls."""
    d = degrees(edges.where("type = 'calls'"))
    return d.where("fan_in = 0 AND fan_out > 0").select("symbol").orderBy("symbol").limit(n)


def callers(edges: DataFrame, symbol: str) -> DataFrame:
    return loaded(edges).where(F.col("dst") == symbol).select(F.col("src").alias("symbol"), "type").distinct()


def callees(edges: DataFrame, symbol: str) -> DataFrame:
    return loaded(edges).where(F.col("src") == symbol).select(F.col("dst").alias("symbol"), "type").distinct()


def paths(edges: DataFrame, starts: DataFrame, *, types: tuple[str, ...] = ("calls",), depth: int = 3) -> DataFrame:
    """start, path, depth: all simple paths of up to `depth` edges from starts(symbol)."""
    out_edges = edges.where(F.col("type").isin(*types)).select("src", "dst").distinct()
    frontier = starts.select(F.col("symbol").alias("start"), F.array("symbol").alias("path"), F.col("symbol").alias("tail"))
    found = None
    for d in range(1, depth + 1):
        step = frontier.join(out_edges, frontier["tail"] == out_edges["src"]).where(~F.array_contains("path", F.col("dst")))
        frontier = step.select("start", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("tail"))
        rows = frontier.select("start", "path", F.lit(d).alias("depth"))
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else frontier.select("start", "path", F.lit(0).alias("depth")).limit(0)


def resolve_paths(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Steps of paths as spans; symbols without a chunk point to `<unresolved>` line 1."""
    steps = found.select("start", "path", F.posexplode("path").alias("pos", "symbol"))
    met = steps.join(first_span(chunks), "symbol", "left")
    return met.select("start", "path", "pos", "symbol", F.coalesce("file_path", F.lit("<unresolved>")).alias("file_path"), F.coalesce("start_line", F.lit(1)).alias("start_line"), F.coalesce("end_line", F.lit(1)).alias("end_line"))


def expand(found: DataFrame, chunks: DataFrame, seen: DataFrame) -> DataFrame:
    """New spans on the paths: resolved, and not among seen(file_path, start_line, end_line)."""
    steps = resolve_paths(found, chunks).where("file_path <> '<unresolved>'").select("symbol", "file_path", "start_line", "end_line").distinct()
    return steps.join(seen, ["file_path", "start_line", "end_line"], "left_anti")


def first_span(chunks: DataFrame) -> DataFrame:
    """symbol, file_path, start_line, end_line of a symbol's first chunk by path and line."""
    best = F.min(F.struct("file_path", "start_line", "end_line")).alias("s")
    return chunks.groupBy("symbol").agg(best).select("symbol", "s.*")


def union_span(chunks: DataFrame) -> DataFrame:
    """A symbol's whole span in the first file that holds it."""
    by_file = chunks.groupBy("symbol", "file_path").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("kind").alias("kind"))
    return by_file.groupBy("symbol").agg(F.min(F.struct("file_path", "start_line", "end_line", "kind")).alias("s")).select("symbol", "s.*")


def internal_roots(chunks: DataFrame) -> DataFrame:
    return chunks.select(text.root_name(F.col("symbol")).alias("root")).where("root <> ''").distinct()


def both_directions(edges: DataFrame) -> DataFrame:
    """symbol, neighbour, edge in all eight kinds."""
    back = F.element_at(F.create_map(*[x for a, b in (("calls", "called_by"), ("inherits", "inherited_by"), ("imports", "imported_by"), ("defines", "defined_by")) for x in (F.lit(a), F.lit(b))]), F.col("type"))
    pair = F.array(F.struct(F.col("src").alias("symbol"), F.col("dst").alias("neighbour"), F.col("type").alias("edge")), F.struct(F.col("dst").alias("symbol"), F.col("src").alias("neighbour"), back.alias("edge")))
    return edges.select(F.inline(pair)).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """One row for each symbol with its eight sorted neighbour lists."""
    wide = both_directions(edges).groupBy("symbol")
    return wide.agg(*[F.array_sort(F.collect_list(F.when(F.col("edge") == e, F.col("neighbour")))).alias(e) for e in NEIGHBOUR_ORDER])


def neighbours(edges: DataFrame, chunks: DataFrame, symbols: DataFrame | None = None, limit: int = 60) -> DataFrame:
    """symbol, rank, neighbour, edge, label, external, resolved, total for symbols(symbol), by default all that edges have.

    The limit keeps the first by kind and name; then internal and resolved ones come first.
    """
    limit = max(1, min(limit, 200))
    near = both_directions(edges)
    near = near.where("symbol IS NOT NULL") if symbols is None else near.join(symbols, "symbol")
    # Read twice below, so made once.
    near = Tables(edges.sparkSession, "neighbours").cut(near)
    w = Window.partitionBy("symbol")
    # Counted apart from the ranking, so that each task keeps only the first rows of a hub before the shuffle.
    totals = near.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"))
    near = near.withColumn("rn", F.row_number().over(w.orderBy(_place(F.col("edge"), NEIGHBOUR_ORDER), "neighbour"))).where(F.col("rn") <= limit).join(totals, "symbol")
    spans = union_span(chunks).select(F.col("symbol").alias("neighbour"), "file_path", "start_line", "end_line", "kind")
    named = near.join(spans, "neighbour", "left").withColumn("root", text.root_name(F.col("neighbour")))
    named = named.join(internal_roots(chunks).withColumn("inside", F.lit(True)), "root", "left")
    named = named.select("symbol", "neighbour", "edge", text.short_name(F.col("neighbour")).alias("label"), F.col("inside").isNull().alias("external"), F.col("file_path").isNotNull().alias("resolved"), "file_path", "start_line", "end_line", "kind", "total", "rn")
    return named.withColumn("rank", F.row_number().over(w.orderBy("external", ~F.col("resolved"), "rn"))).drop("rn")


def neighbour_names(chunks: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Adds `neighbor_symbols`: callees of functions, bases then callees of classes, imports of modules."""
    lists = adjacency(edges).select("symbol", "calls", "inherits", "imports")
    empty = F.array().cast("array<string>")
    pick = F.when(F.col("kind").isin("function", "method"), F.col("calls")).when(F.col("kind") == "class", F.concat(F.coalesce("inherits", empty), F.coalesce("calls", empty))).otherwise(F.col("imports"))
    joined = chunks.join(lists, "symbol", "left")
    return joined.withColumn("neighbor_symbols", F.slice(F.array_distinct(F.coalesce(pick, empty)), 1, limit)).drop("calls", "inherits", "imports")


def metrics(edges: DataFrame, chunks: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """symbol, fan_in, fan_out, cyclomatic, churn, has_tests of symbols(symbol), by default all chunk symbols.

    Symbols without edges or chunks have zeros. Complexity is that of a symbol's first chunk (by file, then by
    start_line where there is one). A symbol has tests if the content of any test chunk holds its short name,
    anywhere and with underscores standing for any character. churn is always 0.
    """
    from ..sources.python_code import cyclomatic
    from .filters import mentions_test
    from .spellings import spelt_somewhere

    asked = (chunks if symbols is None else symbols).where("symbol IS NOT NULL").select("symbol").distinct().withColumn("name", text.short_name(F.col("symbol")))
    place = F.struct("file_path", *(["start_line"] if "start_line" in chunks.columns else []), "content")
    first = chunks.groupBy("symbol").agg(F.min(place).alias("first")).join(asked.select("symbol"), "symbol", "left_semi")

    @F.pandas_udf("int")
    def points(content):
        return content.map(lambda x: cyclomatic(x) if x else 0).astype("int32")

    complexity = first.select("symbol", points(F.col("first.content")).alias("cyclomatic"))
    tested = spelt_somewhere(asked, chunks.where(mentions_test(F.col("file_path"))).select(F.col("content").alias("hay"))).withColumn("has_tests", F.lit(True))
    known = asked.join(tested, "name", "left").join(degrees(loaded(edges)), "symbol", "left").join(complexity, "symbol", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return known.select("symbol", zero("fan_in"), zero("fan_out"), zero("cyclomatic"), F.lit(0).alias("churn"), F.coalesce("has_tests", F.lit(False)).alias("has_tests"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """symbol, community by synchronous label propagation with ties to the smallest label.

    Symbols start with the label of their best connected neighbour, or their own if none has more
    edges, which keeps neighbours from swapping labels forever. Deterministic for any partitioning; a
    label is the name of a member. `rounds` rounds are the definition, not a limit of effort: it ends earlier if
    no label changes any more. `communities.louvain` settles without a limit. Lineage is cut each round in
    the checkpoint folder, which has to be set on a cluster.
    """
    shared_folder(edges.sparkSession)
    pairs = edges.select("src", "dst").where("src <> dst")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint()
    ends = both.groupBy(F.col("src").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    near = both.join(ends.withColumnRenamed("symbol", "dst"), "dst").select(F.col("src").alias("symbol"), F.col("dst").alias("other"), "n")
    own = ends.select("symbol", F.col("symbol").alias("other"), "n")
    labels = near.unionByName(own).groupBy("symbol").agg(F.min_by("other", F.struct((-F.col("n")).alias("n"), "other")).alias("community")).checkpoint()
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("symbol", "dst"), "dst").groupBy(F.col("src").alias("symbol"), "community").agg(F.count(F.lit(1)).alias("n"))
        own = labels.withColumn("n", F.lit(1).cast("long"))  # a symbol's own label votes too, which stops two from swapping
        best = F.min_by("community", F.struct((-F.col("n")).alias("n"), "community"))
        told = votes.unionByName(own).groupBy("symbol", "community").agg(F.sum("n").alias("n")).groupBy("symbol").agg(best.alias("community"))
        last, labels = labels, told.checkpoint()
        if labels.join(last.withColumnRenamed("community", "was"), "symbol").where("community <> was").isEmpty():
            break
    return labels
