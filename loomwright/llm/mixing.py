"""Mixing sources to target weights by entropy balancing.

Rates r of the documents of a source minimise sum(r ln r - r) over documents subject to the token
constraint sum(r * size) = target and 0 <= r <= cap. The dual is convex in one multiplier for each
source, and its solution is the exponential tilt r = min(cap, exp(lambda * size / mean size)).
Newton steps, safeguarded by a bracket, run for all sources at once.

A rate depends on source and size only, so documents first collapse to a table (source, size, n).
Targets, multipliers and brackets are columns of a table with a row for each source; a Newton step
joins the two tables, sums, and writes the next state. The driver sees single numbers, never a row a
source. Rounding into copies walks the sizes from long to short and rounds running totals, so errors of
neighbours cancel; what is left is spread over ever shorter documents in a few further rounds. Running
totals come in two levels, within ranges of sizes and over the ranges, so no task holds a source. A hot
group (many documents of one source and size) is split into hash buckets first. All sums that decide
are of integers or decimals, so the order in which tasks finish changes nothing.

Defined cases: null texts have size 0 and get no copies; texts of any length count whole; a null source
is a source of its own, the last in order. Equal rows are told apart by nothing and may get different
copies; doc_id orders the rest, so reruns agree. Without words, all targets are 0. An empty table gives
an empty result. A multiplier that has not settled after `steps` is an error. Working columns of
`mixed_documents` have reserved names (prefix `_mx_`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words_of, read_table, text_of

CAP = 3
#: Documents in a bucket of one source and size, roughly.
BUCKET_ROWS = 5000
#: Sizes whose running totals one task makes.
RANGE = 64
STEPS = 200
TOLERANCE = 1e-7
#: Fractions of a copy are counted in these units.
UNIT = 1 << 20


def _same(a: str, b: str, *more: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")), *[F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in more]])


def _exact(x: Column) -> Column:
    """Sum of doubles that does not depend on their order."""
    return F.sum(F.round(x * 65536).cast("decimal(38,0)")).cast("double") / 65536


def cyclic_weights(sizes: DataFrame, work: Scratch) -> DataFrame:
    """sizes(source, ..) with weight 1, 2, 3, repeating, in code point order, null last.

    Sources are sorted by range; a place is the offset of its range and the place inside it.
    """
    inside = F.shiftleft(F.spark_partition_id().cast("long"), 33)
    placed = work.cut(sizes.orderBy(F.col("source").isNull(), F.col("source").cast("string")).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - inside))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    return placed.join(offsets, "part").select(*sizes.columns, ((F.col("at") + F.col("offset")) % 3 + 1).cast("double").alias("weight"))


def water_fill(weighted: DataFrame, cap: float = CAP) -> DataFrame:
    """weighted(source, tokens, weight, ..) with `target`: all tokens shared by weight, none above cap times its own; excess is reshared.

    The level (tokens a unit of weight) only rises, so the sources that are full follow from it.
    """
    total, level = weighted.agg(F.sum("tokens")).first()[0] or 0, None
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap * F.col("tokens")
        r = weighted.agg(F.sum(F.when(full, cap * F.col("tokens")).otherwise(0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(full.cast("long")).alias("n")).first()
        if not r["open"] or not total:
            return weighted.withColumn("target", F.least((cap * F.col("tokens")).cast("double"), F.lit(float(total))))
        risen = (total - r["held"]) / r["open"]
        if risen == level:
            return weighted.withColumn("target", F.least((cap * F.col("tokens")).cast("double"), F.lit(level) * F.col("weight")))
        level = risen


def solve_rates(groups: DataFrame, targets: DataFrame, work: Scratch, *, cap: float = CAP, steps: int = STEPS) -> DataFrame:
    """source, l (multiplier), scale, by Newton on the dual for all sources of targets(source, tokens, docs, target).

    groups: source, size, n with size > 0; docs are those of size > 0. The derivative counts only rates
    under the cap. A step that leaves the bracket, or an undefined one, is replaced by its midpoint (or
    by doubling while one end is open). Sources that want nothing get -inf, those that want all inf.
    """
    none, most = F.lit(None).cast("double"), cap * F.col("tokens").cast("double")
    want = F.least(F.col("target"), most)
    fixed = F.when(want <= 0, F.lit(float("-inf"))).when(want >= most * (1 - 1e-12), F.lit(float("inf")))
    state = work.cut(targets.select("source", F.try_divide(F.col("tokens"), F.col("docs")).alias("scale"), want.alias("t"), F.coalesce(fixed, F.lit(0.0)).alias("l"), none.alias("lo"), none.alias("hi"), fixed.isNotNull().alias("settled")))
    for _ in range(steps):
        if state.where("not settled").isEmpty():
            return state.select("source", "l", "scale")
        met = groups.alias("g").join(state.where("not settled").alias("s"), _same("g", "s")).select("g.source", "g.size", "g.n", "s.l", "s.scale")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("l") * F.col("size") / F.col("scale")))
        tokens = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, tokens * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = met.groupBy("source").agg(_exact(tokens).alias("g"), _exact(slope).alias("d"))
        x = state.alias("s").join(sums.alias("g"), _same("s", "g"), "left").select("s.*", "g.g", "g.d", (F.col("g.g") - F.col("s.t")).alias("gap"))
        x = x.withColumn("ready", F.col("settled") | (F.abs("gap") <= TOLERANCE * F.col("t")))
        x = x.withColumn("lo2", F.when(F.col("gap") <= 0, F.col("l")).otherwise(F.col("lo"))).withColumn("hi2", F.when(F.col("gap") > 0, F.col("l")).otherwise(F.col("hi")))
        newton = F.col("l") - F.try_divide(F.col("gap"), F.col("d"))
        inside = F.coalesce(newton > F.col("lo2"), F.lit(True)) & F.coalesce(newton < F.col("hi2"), F.lit(True)) & (F.abs(newton) < 700)
        other = F.coalesce((F.col("lo2") + F.col("hi2")) / 2, F.col("l") * 2 + F.when(F.col("gap") < 0, 1.0).otherwise(-1.0))
        step = F.when(F.col("ready"), F.col("l")).when((F.col("d") > 0) & inside, newton).otherwise(other)
        last, state = state, work.cut(x.select("source", "scale", "t", step.alias("l"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("ready").alias("settled")))
        work.drop(last)
    raise RuntimeError(f"multipliers have not settled after {steps} steps")


def mix(docs: DataFrame, targets: DataFrame | None = None, *, cap: int = CAP, bucket_rows: int = BUCKET_ROWS, work: Scratch | None = None) -> DataFrame:
    """doc_id, source, size, rate, copies, source_size, target for every row of docs(doc_id, source, size).

    targets: (source, target in tokens); by default all tokens are shared by `cyclic_weights`.
    """
    work = work or Scratch(docs.sparkSession)
    rows = work.cut(docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    groups = work.cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = work.cut(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs")))
    if targets is None:
        aimed = water_fill(work.cut(cyclic_weights(sizes, work)), cap).drop("weight")
    else:
        aimed = sizes.alias("s").join(targets.alias("t"), _same("s", "t"), "left").select("s.*", F.coalesce(F.col("t.target").cast("double"), F.lit(0.0)).alias("target"))
    aimed = work.cut(aimed)
    solved = solve_rates(groups.where("size > 0"), aimed, work, cap=cap)
    plan = work.cut(aimed.alias("a").join(solved.alias("s"), _same("a", "s")).select("a.source", "a.target", F.col("a.tokens").alias("source_size"), "s.l", "s.scale"))
    tilt = F.when(F.col("l") == float("inf"), float(cap)).when(F.col("l") == float("-inf"), 0.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("l") * F.col("size") / F.col("scale"))))
    rate = F.when(F.col("size") == 0, 0.0).otherwise(tilt)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(bucket_rows))).cast("int")
    rated = work.cut(groups.alias("g").join(plan.alias("p"), _same("g", "p")).select("g.source", "g.size", "g.n", rate.alias("rate"), "p.target", "p.source_size", buckets.alias("buckets")))
    bucket = F.pmod(F.xxhash64(F.lit("mix"), "d.doc_id"), F.col("g.buckets")).cast("int").alias("bucket")
    dealt = work.cut(rows.alias("d").join(rated.alias("g"), _same("d", "g", "size")).select("d.doc_id", "d.source", "d.size", "g.rate", "g.target", "g.source_size", bucket))
    cells = dealt.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"), F.first("rate").alias("rate"), F.first("target").alias("target"))
    cells = _round(work.cut(cells), cap, work)
    order = Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64(F.lit("mixed"), "doc_id"), "doc_id")
    ranked = dealt.withColumn("rank", F.row_number().over(order))
    joined = ranked.alias("d").join(cells.alias("c"), _same("d", "c", "size", "bucket"))
    copies = F.floor(F.col("c.copies") / F.col("c.n")) + (F.col("d.rank") <= F.col("c.copies") % F.col("c.n")).cast("long")
    return work.finish(joined.select("d.doc_id", "d.source", "d.size", "d.rate", copies.cast("long").alias("copies"), "d.source_size", "d.target"))


def _settle(cells: DataFrame) -> DataFrame:
    """cells(source, size, bucket, want in units) with `add`: running totals from long to short, rounded, and their steps."""
    ranges = cells.withColumn("range", F.expr(f"size div {RANGE}"))
    down = Window.partitionBy("source").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("source", "range").agg(F.sum("want").alias("whole")).select("source", "range", F.coalesce(F.sum("whole").over(down), F.lit(0)).alias("before"))
    joined = ranges.alias("c").join(before.alias("b"), _same("c", "b", "range")).select("c.*", "b.before")
    inside = Window.partitionBy("source", "range").orderBy(F.col("size").desc(), "bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = F.col("before") + F.sum("want").over(inside)
    rounded = lambda x: F.shiftright(x + UNIT // 2, UNIT.bit_length() - 1)
    return joined.withColumn("run", run).withColumn("add", rounded(F.col("run")) - rounded(F.col("run") - F.col("want"))).drop("range", "before", "run")


def _round(cells: DataFrame, cap: int, work: Scratch, rounds: int = 4) -> DataFrame:
    """Copies of each cell: running totals of wanted copies, rounded, from long to short.

    What the tokens still lack is then spread over cells of at most a quarter, 1/16, ... of the
    longest size, in proportion to the room they have, and rounded the same way.
    """
    out = _settle(cells.withColumn("want", F.round(F.col("n") * F.col("rate") * UNIT).cast("long")))
    out = work.cut(out.withColumn("copies", F.greatest(F.lit(0), F.least(cap * F.col("n"), F.col("add")))).drop("want", "add"))
    for k in range(1, rounds + 1):
        gap = F.max("target") - F.sum(F.col("copies") * F.col("size"))
        whole = out.groupBy("source").agg(gap.alias("gap"), F.max("size").alias("top"))
        told = out.alias("c").join(whole.alias("w"), _same("c", "w")).select("c.*", "w.gap", "w.top")
        room = F.when(F.col("gap") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        told = told.withColumn("room", F.when((F.col("size") > 0) & (F.col("size") * (4**k) <= F.col("top")), room).otherwise(F.lit(0)))
        free = told.groupBy("source").agg(F.sum(F.col("room") * F.col("size")).alias("free"))
        told = told.alias("c").join(free.alias("f"), _same("c", "f")).select("c.*", "f.free")
        share = F.when(F.col("free") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("gap") / F.col("free")))).otherwise(F.lit(0.0))
        told = _settle(told.withColumn("want", F.round(share * F.col("room") * UNIT).cast("long")))
        copies = F.greatest(F.lit(0), F.least(cap * F.col("n"), F.col("copies") + F.col("add")))
        last, out = out, work.cut(told.withColumn("copies", copies).select("source", "size", "bucket", "n", "target", "copies"))
        work.drop(last)
    return out


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words_of(text_of()).alias("size"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents in as many copies as the mix takes, columns unchanged.

    The text is joined to its copies by (doc_id, source, size, number among equals).
    """
    columns = docs.columns
    rows = docs.withColumn("_mx_size", n_words_of(text_of()))
    copies = mix(docs.select("doc_id", "source", n_words_of(text_of()).alias("size")))
    # Equal (doc_id, source, size) rows pool their copies: the pool is dealt over the rows.
    key = ["doc_id", "source", "size"]
    pool = copies.groupBy(*key).agg(F.sum("copies").alias("_mx_all"), F.count(F.lit(1)).alias("_mx_n")).where("_mx_all > 0")
    pool = pool.select(F.col("doc_id").alias("_mx_id"), F.col("source").alias("_mx_source"), F.col("size").alias("_mx_s"), "_mx_all", "_mx_n")
    on = reduce(lambda a, b: a & b, [rows["doc_id"].eqNullSafe(F.col("_mx_id")), rows["source"].eqNullSafe(F.col("_mx_source")), F.col("_mx_size") == F.col("_mx_s")])
    joined = rows.join(pool, on)
    alone = F.floor(F.col("_mx_all") / F.col("_mx_n"))
    extra = F.col("_mx_all") % F.col("_mx_n")
    number = F.row_number().over(Window.partitionBy("_mx_id", "_mx_source", "_mx_s").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in columns])))
    single = joined.where("_mx_n = 1").withColumn("_mx_k", F.col("_mx_all"))
    several = joined.where("_mx_n > 1").withColumn("_mx_r", number).withColumn("_mx_k", alone + (F.col("_mx_r") <= extra).cast("long")).drop("_mx_r")
    out = single.unionByName(several).where("_mx_k > 0")
    return out.withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_k").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(sized(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")
