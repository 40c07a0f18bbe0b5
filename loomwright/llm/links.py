"""Links found through inverted lists, and the connected groups they form.

Nothing here gathers a list, a group or an edge set in one task or on the driver; the driver sees
whether a table is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release

#: Members of a list that meet in one task; longer lists are dealt into blocks of about so many.
BLOCK = 1024


def components(edges: DataFrame, work: Scratch | None = None) -> DataFrame:
    """(id, component) for every end of edges(a, b); component is the smallest id reachable.

    Each round gives every node, and the node it points to, the smallest pointer among its
    neighbours, then follows pointers of pointers; chains shrink by half or more in a round, so rounds
    grow with the logarithm of the longest path. A round is one job and one look whether anything
    changed. Minima are combined before the shuffle, so hubs cost no more.
    """
    work = work or Scratch(edges.sparkSession)
    one = edges.where("a <> b")
    both = work.cut(one.select("a", "b").unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    f = work.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("f")))
    while True:
        near = both.join(f.select(F.col("id").alias("b"), F.col("f").alias("fb")), "b").groupBy(F.col("a").alias("id")).agg(F.min("fb").alias("m"))
        seen = f.join(near, "id").select("id", "f", F.least("f", "m").alias("low"))
        told = seen.select(F.inline(F.array(F.struct("id", "low", F.col("f").alias("old")), F.struct(F.col("f").alias("id"), "low", F.lit(None).cast("long").alias("old")))))
        next_f = work.cut(told.groupBy("id").agg(F.min("low").alias("p"), F.max("old").alias("old")))
        jump = next_f.join(next_f.select(F.col("id").alias("p"), F.col("p").alias("pp")), "p")
        last, f = f, work.cut(jump.select("id", F.col("pp").alias("f"), (F.col("pp") != F.col("old")).alias("moved")))
        work.drop(last, next_f)
        if f.where("moved").isEmpty():
            work.drop(both)
            return f.select("id", F.col("f").alias("component"))


def _in_blocks(members: DataFrame, side: str, block: int) -> DataFrame:
    """members(key, id, .., b: blocks of the list) with lo and hi: the pairs of blocks a member is needed for."""
    own = F.pmod(F.xxhash64(F.lit("block"), f"{side}id"), F.col("b")).cast("int")
    out = members.withColumn(f"{side}own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    return out.withColumn("lo", F.least(f"{side}own", "other")).withColumn("hi", F.greatest(f"{side}own", "other")).drop("other", "b")


def link_groups(work: Scratch, postings: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column], attributes: list[str], *, hub_rounds: int = 2, one_hub: bool = False, refine: Callable[[DataFrame], DataFrame] | None = None, near_refined: Callable[[str, str], Column] | None = None, exact: bool = False, block: int = BLOCK) -> DataFrame:
    """Components of the graph of all verified pairs that share a key: (id, component).

    postings: key, id, weight and the attributes that `near(prefix_a, prefix_b)` reads, a cheap
    necessary condition on columns named with those prefixes; it must be materialised. verify maps
    candidate pairs (a, b) to those that are links.

    A list of n members isn't expanded into n^2 pairs. First each list's weightiest member, its hub,
    meets the others; members it links with need no further pair among themselves, as they are in
    one group already. After some rounds of hubs, lists that still hold several groups get all
    pairs across their groups that pass the condition, so no link between groups is lost. Lists longer
    than `block` are dealt into blocks for that, and each pair of blocks is a task's work of its own.
    With one_hub, a member first meets only the hub that it shares most lists with. No pair is verified twice.
    For the last step, refine(pairs of id and hub) may give further attributes of an id as seen from a
    list's hub (leaving out ids that can link with no other), and near_refined a sharper necessary
    condition on them, which the join itself applies. With exact, near_refined is the link test itself: a pair is
    compared where its ends meet and only links become rows, and refine gets the ids that meet one they could link
    with. It then also sees that ends share a list and are compared under one hub.
    """
    side = lambda p: [F.col("id").alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in attributes]]
    member = F.struct(F.col("weight"), F.bitwise_not("id").alias("back"), *[F.col(c) for c in attributes])
    edges, group, tested, open_ = None, None, None, postings

    once = (F.col("lo") == F.col("hi")) | (F.col("aown") != F.col("bown"))

    def in_tiles(members: DataFrame, block: int = block) -> list[DataFrame]:
        blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("b"))
        members = members.join(blocks, "key")
        return [_in_blocks(members.select("key", "b", F.col("g").alias(f"{s}g"), *side(s)), s, block) for s in ("a", "b")]

    def add(pairs: DataFrame, linked: bool = False) -> None:
        nonlocal edges, group, tested
        pairs = pairs.select(F.least("aid", "bid").alias("a"), F.greatest("aid", "bid").alias("b")).distinct()
        if not linked:
            pairs = work.cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
            tested = pairs if tested is None else work.cut(tested.unionByName(pairs))
        older = [t for t, _ in work.tables if t is not edges and t is not group]
        found = pairs if linked else verify(pairs)
        edges = work.cut(found if edges is None else edges.unionByName(found))
        group = work.cut(components(edges, work))
        work.drop(*[t for t, _ in work.tables if t is not edges and t is not group and not any(t is x for x in older)])
        release(edges.sparkSession)

    def still_open() -> DataFrame:
        """Postings, with their group, of lists that hold several groups."""
        named = postings.join(group.withColumnRenamed("component", "g"), "id", "left").withColumn("g", F.coalesce("g", "id"))
        several = named.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("key")
        return work.cut(named.join(several, "key"))

    for turn in range(hub_rounds):
        if not turn:
            hubs = open_.groupBy("key").agg(F.max(member).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1")
            mine = open_.select("key", *side("b"))
            met = mine.join(hubs, "key").select("key", *[F.col(x) for x in mine.columns if x != "key"], F.bitwise_not("h.back").alias("aid"), *[F.col(f"h.{c}").alias(f"a{c}") for c in attributes])
            met = met.where(F.col("aid") != F.col("bid")).where(near("a", "b"))
            if one_hub:
                shared = met.groupBy("aid", "bid").agg(F.count(F.lit(1)).alias("n"))
                met = shared.groupBy("bid").agg(F.max_by("aid", F.struct("n", F.bitwise_not("aid"))).alias("aid"))
            add(met)
        else:
            # The weightiest member outside the first hub's group meets all that are outside its own.
            lead = open_.groupBy("key").agg(F.max_by("g", F.struct("weight", F.bitwise_not("id"))).alias("lead"))
            rest = open_.join(lead, "key").where("g <> lead")
            hubs = rest.groupBy("key").agg(F.max(F.struct(F.col("weight"), F.bitwise_not("id").alias("back"), "g", *[F.col(c) for c in attributes])).alias("h"))
            mine = open_.select("key", F.col("g").alias("bg"), *side("b"))
            met = mine.join(hubs, "key").where(F.col("h.g") != F.col("bg")).select(*[F.col(x) for x in mine.columns if x != "key"], F.bitwise_not("h.back").alias("aid"), *[F.col(f"h.{c}").alias(f"a{c}") for c in attributes])
            add(met.where(near("a", "b")))
        last, open_ = open_, still_open()
        if turn:
            work.drop(last)
        if open_.isEmpty():
            return group
    if exact:
        # Nothing is compared yet but attributes, so blocks may be large and members are copied less often.
        left, right = in_tiles(open_, max(block, BLOCK))
        right = right.withColumnsRenamed({"key": "bkey", "lo": "blo", "hi": "bhi"})
        meet = (F.col("key") == F.col("bkey")) & (F.col("lo") == F.col("blo")) & (F.col("hi") == F.col("bhi"))
        able = left.join(right, meet & once & (F.col("ag") != F.col("bg")) & near("a", "b"), "left_semi")
        last, open_ = open_, work.cut(open_.join(able.select(F.col("aid").alias("id")).distinct(), "id"))
        work.drop(last)
        release(work.spark)
    if refine is not None:
        # Lists of one hub are taken as one: a row for each id and hub instead of one for each key.
        hubs = open_.groupBy("key").agg(F.max_by("id", F.struct("weight", F.bitwise_not("id"))).alias("hub"))
        seen = work.cut(open_.join(hubs, "key").select("id", "hub", "g", *attributes).distinct())
        finer = refine(seen.select("id", "hub"))
        attributes, near = [*attributes, *[c for c in finer.columns if c not in ("id", "hub")]], near_refined or near
        last, open_ = open_, work.cut(seen.join(finer, ["id", "hub"]).withColumnRenamed("hub", "key"))
        work.drop(last, seen)
    left, right = in_tiles(open_)
    if exact:  # Rows are few and pairs dear, so tiles are spread by number, not by bytes.
        parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
        left, right = (x.repartition(parts, "key", "lo", "hi") for x in (left, right))
    add(left.join(right, ["key", "lo", "hi"]).where(once & (F.col("ag") != F.col("bg")) & (F.col("aid") < F.col("bid")) & near("a", "b")), linked=exact)
    return group
