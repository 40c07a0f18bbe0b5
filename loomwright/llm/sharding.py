"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

Each level is a weighted rendezvous draw: child c of the node reached so far scores ln(u) / weight
with u drawn from (row key, level, child), and the highest score wins. A node weighs as much as the
shards below it. A change of weights moves rows only between the subtrees whose weights changed;
a new region can only win rows, so a shard that comes as a region of its own takes rows only into
itself.

Slots are gapless inside a shard without sorting a shard in one task: rows of a shard fall into a
fixed number of hash buckets, each is numbered on its own, and offsets come from the table of bucket
counts, which has shards x buckets rows at most whatever the corpus holds.

Defined cases: a null text has no bytes and checksum 0; a null doc_id is a key like any other.
Repeated rows get the same shard and a slot each. An empty table gives an empty result. Other input
columns are passed through by `assign_shards` unless their name is one it produces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table, text_of, unit_hash

SLOT_BUCKETS = 1024
#: Bytes a row costs beside its text.
ROW_OVERHEAD = 8


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, *, racks: int = 3, per_rack: int = 4) -> list[Leaf]:
    """Shards 0.. filled into racks of `per_rack` and regions of `racks`, all of weight 1."""
    return [Leaf(s // (racks * per_rack), s // per_rack, s) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a rack and region of its own."""
    return [*tree, Leaf(max((x.region for x in tree), default=-1) + 1, max((x.rack for x in tree), default=-1) + 1, max((x.shard for x in tree), default=-1) + 1, weight)]


def _children(tree: list[Leaf], parent, child) -> Column:
    """Literal map from a node to the array of (id, weight) below it."""
    below: dict[int, dict[int, float]] = {}
    for x in tree:
        if x.weight > 0:
            kids = below.setdefault(parent(x), {})
            kids[child(x)] = kids.get(child(x), 0.0) + x.weight
    pairs = []
    for node, kids in sorted(below.items()):
        pairs += [F.lit(node), F.array(*[F.struct(F.lit(k).alias("id"), F.lit(w).alias("w")) for k, w in sorted(kids.items())])]
    return F.create_map(*pairs)


def draw_shard(key: list[Column], tree: list[Leaf]) -> Column:
    """Shard of each row by descending the tree. Ties of scores go to the smaller id."""

    def pick(level: str, children: Column) -> Column:
        scored = F.transform(children, lambda c: F.struct((F.log(unit_hash(*key, F.lit(level), c["id"])) / c["w"]).alias("score"), (-c["id"]).alias("back")))
        return -F.array_max(scored)["back"]

    region = pick("region", F.element_at(_children(tree, lambda x: 0, lambda x: x.region), F.lit(0)))
    rack = pick("rack", F.element_at(_children(tree, lambda x: x.region, lambda x: x.rack), region))
    return pick("shard", F.element_at(_children(tree, lambda x: x.rack, lambda x: x.shard), rack))


def number_slots(df: DataFrame, *, shard: str = "shard", key: tuple[str, ...] = ("doc_id",), buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds `slot`, 0.. without gaps inside each shard. Reads df twice: pass a materialised one."""
    inside = df.withColumn("_sh_bucket", F.pmod(F.xxhash64(F.lit("slot"), *key), F.lit(buckets)).cast("int"))
    counts = inside.groupBy(shard, "_sh_bucket").agg(F.count(F.lit(1)).alias("_sh_n"))
    before = Window.partitionBy(shard).orderBy("_sh_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias("_sh_shard"), F.col("_sh_bucket").alias("_sh_b"), F.coalesce(F.sum("_sh_n").over(before), F.lit(0)).alias("_sh_offset"))
    numbered = inside.withColumn("_sh_rank", F.row_number().over(Window.partitionBy(shard, "_sh_bucket").orderBy(*key)))
    joined = numbered.join(offsets, (F.col(shard) == F.col("_sh_shard")) & (F.col("_sh_bucket") == F.col("_sh_b")))
    return joined.withColumn("slot", F.col("_sh_offset") + F.col("_sh_rank") - 1).drop("_sh_bucket", "_sh_b", "_sh_shard", "_sh_n", "_sh_offset", "_sh_rank")


def assign_shards(docs: DataFrame, tree: list[Leaf], *, key: str = "doc_id") -> DataFrame:
    """The documents with `shard`. A projection: no shuffle, any number of rows."""
    return docs.withColumn("shard", draw_shard([F.col(key)], tree))


def write_shards(docs: DataFrame, tree: list[Leaf], path: str, *, files_per_shard: int = 8) -> None:
    """Writes path/shard=N/. Rows are dealt by shard and a salt, so no task holds a whole shard."""
    salt = F.pmod(F.xxhash64(F.lit("file"), "doc_id"), F.lit(files_per_shard))
    placed = assign_shards(docs, tree).withColumn("_sh_salt", salt)
    placed.repartition("shard", "_sh_salt").drop("_sh_salt").write.partitionBy("shard").mode("overwrite").parquet(path)


def op7_sharding(spark, sf_dir: str, shards: int = 24) -> DataFrame:
    tree = topology(shards)
    docs = read_table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (F.octet_length(text_of()) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))
    placed = assign_shards(sized, tree).withColumn("grown_shard", draw_shard([F.col("doc_id")], grown(tree)))
    out = number_slots(Scratch(spark).cut(placed), key=("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
