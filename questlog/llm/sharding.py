"""Shard placement by a hierarchical weighted hash tree.

Shards hang under racks, racks under regions. A document descends the tree: on each level every child draws
``-ln(u) / weight`` with ``u`` hashed from document and child, and the smallest draw wins. A child's draw
depends on nothing but the document and that child, so a weight that changes moves documents only into or out of the
subtree that holds it, in proportion to the change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questlog.session import materialise

ROOT = "root"


@dataclass(frozen=True)
class Tree:
    """``children``: for each inner node its (child, weight) pairs; leaves are ``s<number>``."""

    children: dict[str, tuple[tuple[str, float], ...]]
    levels: int = 3

    @staticmethod
    def even(shards: int, racks: int = 6, regions: int = 3) -> Tree:
        """Equal shards spread over racks and racks over regions, in order."""
        if shards < 1:
            raise ValueError("at least one shard is needed")
        racks = min(racks, shards)
        regions = min(regions, racks)
        rack_of = {s: s * racks // shards for s in range(shards)}
        region_of = {r: r * regions // racks for r in range(racks)}
        children: dict[str, list] = {ROOT: []}
        for r, region in region_of.items():
            leaves = [(f"s{s}", 1.0) for s in range(shards) if rack_of[s] == r]
            children[f"k{r}"] = leaves
            children.setdefault(f"g{region}", []).append((f"k{r}", float(len(leaves))))
        for g in range(regions):
            children[ROOT].append((f"g{g}", sum(w for _, w in children[f"g{g}"])))
        return Tree({k: tuple(v) for k, v in children.items()})

    def with_shard(self, shard: int, weight: float = 1.0) -> Tree:
        """One more shard in a region and rack of its own: no other subtree's weight changes, so documents move into the new
        shard only."""
        rack, region = f"k+{shard}", f"g+{shard}"
        grown = dict(self.children)
        grown[rack] = ((f"s{shard}", weight),)
        grown[region] = ((rack, weight),)
        grown[ROOT] = (*self.children[ROOT], (region, weight))
        return Tree(grown, self.levels)


def draw(key: Column, child: Column, weight: Column) -> Column:
    """An exponential draw of rate `weight`, fixed by key and child."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, child), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.ln(unit) / weight


def place(key: Column, tree: Tree) -> Column:
    """The leaf number that `key` (as text; null keys all count as one key) descends to."""
    nodes = F.create_map(
        *(x for node, kids in tree.children.items()
          for x in (F.lit(node), F.array(*(F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in kids)))))
    at = F.lit(ROOT)
    for _ in range(tree.levels):
        at = F.array_min(F.transform(nodes[at], lambda c: F.struct(draw(key, c["child"], c["weight"]).alias("draw"), c["child"].alias("child"))))["child"]
    return F.substring(at, 2, 10).cast("int")


def assign_shards(docs: DataFrame, shards: int, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs` (doc_id, text, more columns are left).

    The law is ``key``: doc_id and the number of shards decide. ``grown_shard`` is the place with one more shard. A null text has
    no bytes (size 8, checksum 0); null ids draw alike; repeated rows each get a slot. An empty table gives an empty result.

    Slots are counted in two steps, so that no task orders a whole shard: rows are numbered inside `buckets` hash buckets per
    shard (default: the shuffle partitions), and a table of shards x buckets counts says where each bucket begins.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tree = Tree.even(shards)
    key, text = F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit(""))
    placed = materialise(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        place(key, tree).alias("shard"), place(key, tree.with_shard(shards)).alias("grown_shard"),
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows")).select(
        "shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("row", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("row") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, shards: int, path: str, salt: int = 8) -> None:
    """Write `docs` as Parquet folders ``shard=<n>``, each dealt over `salt` tasks. Rows keep all their columns."""
    spread = F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(salt))
    (docs.withColumn("shard", place(F.col("doc_id").cast("string"), Tree.even(shards)))
     .repartition(F.col("shard"), spread).write.partitionBy("shard").parquet(path))
