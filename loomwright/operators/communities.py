"""Communities of a symbol graph by modularity (Louvain), level by level, all as tables.

In whole numbers, a pair of nodes u, v in one community adds s(u, v) = 2m w(u, v) - k(u) k(v), where w is the weight
between them, k their degrees and m the weight of all edges; modularity is the sum of s over such pairs
(and a constant), so gains are exact.

A round of moves is a set of joins for all nodes at once. Moves made together disturb each other, so
a round looks only at moves up an order of communities (by total degree in even rounds, by a hash in odd
ones), and of these makes none to a community that some node wants to leave. Then
two moves disturb each other only where they share the giver or the taker, each time by k(u) k(v) at most.
Moves are put in order of gain by degree, and one stands if its gain is larger than what all moves
before it could take from it. So every round raises modularity; where a round accepts nothing, the single
best move is made. It ends when no move has a gain, without any limit of rounds. Then each community becomes
a node, edges between communities are added up, and the next level begins, until nothing merges.

Running sums in the order of moves are taken over (community, class of gain, hash) and not over moves, so a
hub's community costs no more than others.

Defined cases: directions, repeated edges and loops count for nothing; edges with a null end are left
out. A symbol without edges is in no community. An empty table gives an empty result. A community is named
after its smallest member. 2m times the largest degree has to fit a long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Tables

#: Moves of one gain class are dealt into so many steps of the running sum.
STEPS = 64


def simple(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: every connected pair once."""
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return ends.distinct()


def _moves(nodes: DataFrame, links: DataFrame, two_m: int, turn: int) -> DataFrame:
    """a, k, c, any_to, any_gain (best move of each node), to, gain (best one up the order of this turn)."""
    total = nodes.groupBy("c").agg(F.sum("k").alias("total"))
    here = nodes.join(total, "c")
    at = links.join(nodes.select(F.col("id").alias("b"), F.col("c").alias("to")), "b").groupBy("a", "to").agg(F.sum("w").alias("w"))
    at = at.join(total.select(F.col("c").alias("to"), F.col("total").alias("to_total")), "to").join(here.withColumnRenamed("id", "a"), "a")
    value = F.lit(two_m) * F.col("w") - F.col("k") * F.col("to_total")
    other = F.col("to") != F.col("c")
    drawn = lambda c: F.xxhash64(F.lit(turn), c)
    up = drawn(F.col("to")) > drawn(F.col("c")) if turn % 2 else F.struct("to_total", "to") > F.struct("total", "c")
    best = lambda ok: F.min(F.when(other & ok, F.struct((-value).alias("v"), "to")))
    stay = F.lit(two_m) * F.coalesce(F.sum(F.when(~other, F.col("w"))), F.lit(0)) - F.first("k") * (F.first("total") - F.first("k"))
    told = at.groupBy("a").agg(F.first("k").alias("k"), F.first("c").alias("c"), stay.alias("stay"), best(F.lit(True)).alias("x"), best(up).alias("y"))
    gain = lambda s: -F.col(f"{s}.v") - F.col("stay")
    return told.select("a", "k", "c", F.col("x.to").alias("any_to"), gain("x").alias("any_gain"), F.col("y.to").alias("to"), gain("y").alias("gain"))


def _accepted(moves: DataFrame) -> DataFrame:
    """id, to of the moves that stand whatever the others do."""
    rank = F.floor(F.log2(F.col("gain") / F.col("k"))).cast("int")
    wish = moves.where("gain > 0")
    ready = wish.join(wish.select(F.col("c").alias("to")).distinct(), "to", "left_anti").withColumn("rank", rank).withColumn("step", F.pmod(F.xxhash64("a"), F.lit(STEPS)).cast("int"))

    def before(side: str) -> DataFrame:
        sums = ready.groupBy(side, "rank", "step").agg(F.sum("k").alias("n"))
        order = Window.partitionBy(side).orderBy(F.col("rank").desc(), "step")
        return sums.select(side, "rank", "step", F.sum("n").over(order).alias(f"{side}_before"))

    met = ready.join(before("to"), ["to", "rank", "step"]).join(before("c"), ["c", "rank", "step"])
    return met.where("gain > k * (to_before + c_before - 2 * k)").select(F.col("a").alias("id"), "to")


def louvain(edges: DataFrame) -> DataFrame:
    """symbol, community of the symbols of edges(src, dst)."""
    work = Tables(edges.sparkSession, "louvain")
    pairs = work.cut(simple(edges))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = work.cut(both.withColumn("w", F.lit(1).cast("long")))
    nodes = work.cut(links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")))
    members = work.cut(nodes.select(F.col("id").alias("symbol"), "id"))
    two_m, turn = links.count(), 0
    while True:
        merged = False
        while True:
            moves = work.cut(_moves(nodes, links, two_m, turn))
            if moves.where("any_gain > 0").isEmpty():
                break
            chosen = work.cut(_accepted(moves))
            if chosen.isEmpty():
                top = moves.agg(F.max_by(F.struct(F.col("a").alias("id"), F.col("any_to").alias("to")), F.struct("any_gain", "a")).alias("m"))
                chosen = work.cut(top.select("m.*"))
            nodes = work.cut(nodes.join(chosen, "id", "left").select("id", "k", F.coalesce("to", "c").alias("c")))
            work.drop_others(links, nodes, members)
            merged, turn = True, turn + 1
        if not merged:
            break
        named = nodes.select("id", "c")
        members = work.cut(members.join(named, "id").select("symbol", F.col("c").alias("id")))
        ends = links.join(named.select(F.col("id").alias("a"), F.col("c").alias("x")), "a").join(named.select(F.col("id").alias("b"), F.col("c").alias("y")), "b").where("x <> y")
        links = work.cut(ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
        nodes = work.cut(nodes.groupBy(F.col("c").alias("id")).agg(F.sum("k").alias("k")).withColumn("c", F.col("id")))
        work.drop_others(links, nodes, members)
    names = members.groupBy("id").agg(F.min("symbol").alias("community"))
    out = work.cut(members.join(names, "id").select("symbol", "community"))
    work.drop_others(out)
    return out


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """edges, communities, modularity: one row; symbols outside all communities stand alone."""
    pairs = simple(edges)
    label = lambda c, to: communities.select(F.col("symbol").alias(c), F.col("community").alias(to))
    named = pairs.join(label("a", "x"), "a", "left").join(label("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    ends = named.select(F.inline(F.array(F.struct(F.col("x").alias("c"), (F.col("x") == F.col("y")).cast("long").alias("inside")), F.struct(F.col("y").alias("c"), F.lit(0).cast("long").alias("inside")))))
    each = ends.groupBy("c").agg(F.sum("inside").alias("inside"), F.count(F.lit(1)).alias("ends"))
    told = each.agg(F.sum("inside").alias("i"), F.sum("ends").alias("e"), F.sum(F.col("ends").cast("decimal(19,0)") * F.col("ends")).cast("double").alias("q"), F.count(F.lit(1)).alias("communities"))
    m = F.col("e") / 2
    return told.select(F.coalesce(m.cast("long"), F.lit(0)).alias("edges"), "communities", F.when(F.col("e") > 0, F.col("i") / m - F.col("q") / (4 * m * m)).alias("modularity"))


def layers(communities: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """community, size, rank, symbol, degree: the n best connected symbols of each community, ties by name."""
    degree = simple(edges).select(F.explode(F.array("a", "b")).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("degree"))
    known = communities.join(degree, "symbol", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = Window.partitionBy("community").orderBy(F.col("degree").desc(), "symbol")
    top = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return top.join(communities.groupBy("community").agg(F.count(F.lit(1)).alias("size")), "community").select("community", "size", "rank", "symbol", "degree")
