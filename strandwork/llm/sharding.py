"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm.common import stored


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(n_shards: int, racks: int = 2, shards_each: int = 4) -> list[Shard]:
    """Shards of equal weight, filled into racks and regions in order."""
    return [Shard(s // (racks * shards_each), s // shards_each % racks, s) for s in range(n_shards)]


def _children(tree: list[Shard]) -> list[list[list[tuple[int, float, int]]]]:
    """For each level the lists of its nodes' children: (number, weight of the whole subtree, which list of the next level is its own)."""
    weights: list[dict[tuple[int, ...], float]] = [{}, {}, {}]
    for s in tree:
        for level, node in enumerate(((s.region,), (s.region, s.rack), (s.region, s.rack, s.shard))):
            weights[level][node] = weights[level].get(node, 0.0) + s.weight
    live = [sorted(n for n, w in level.items() if w > 0) for level in weights]
    parents = [[()], *live[:2]]
    return [[[(n[-1], weights[k][n], live[k].index(n)) for n in live[k] if n[:-1] == up] for up in parents[k]] for k in range(3)]


def tree_place(key: Column, tree: list[Shard]) -> Column:
    """struct(region, rack, shard): where the key's descent ends.

    At every level each child of the node that was reached draws an exponential number whose rate is the weight of the
    child's whole subtree, from a hash of the key and the child's own path; the descent goes on in the child with the least draw. So a
    key costs as many draws as the nodes on its way have children, however many shards there are. A child's draw depends on nothing but its
    path and weight: where a weight changes, the draws of the nodes above that shard change and no others, so that
    keys go into (or out of) those subtrees alone; between and inside all others nothing moves. A shard that comes in a region
    of its own takes keys into itself alone. Shards and subtrees of weight 0 get no keys; a null key is a key like any other.
    """
    if not any(s.weight > 0 for s in tree) or any(s.weight < 0 for s in tree):
        raise ValueError("weights must not be negative, and one must be positive")

    levels = _children(tree)
    node = lambda number, weight, own: F.struct(F.lit(number).alias("number"), F.lit(weight).alias("weight"), F.lit(own).alias("own"))
    lists = F.array(*(F.array(*(F.array(*(node(*child) for child in children)) for children in level)) for level in levels))
    leaves = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(leaf, ("region", "rack", "shard"), strict=True))) for leaf in sorted((s.region, s.rack, s.shard) for s in tree if s.weight > 0)))

    def descend(at: Column, level: Column) -> Column:
        def draw(child: Column) -> Column:
            seed = F.xxhash64(at["seed"], child["number"])
            return F.struct((-F.log((F.shiftrightunsigned(seed, 11) + 0.5) / float(1 << 53)) / child["weight"]).alias("draw"), child["own"].alias("own"), seed.alias("seed"))

        return F.array_min(F.transform(F.get(level, at["own"]), draw))

    start = F.struct(F.lit(0.0).alias("draw"), F.lit(0).alias("own"), F.xxhash64(key).alias("seed"))
    return F.aggregate(lists, start, descend, lambda at: F.get(leaves, at["own"]))


def assign_shards(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, key_col: str = "doc_id") -> DataFrame:
    """The rows with region, rack, shard and slot, and grown_shard under the grown tree if there is one.

    Slots count the rows of a shard from 0 without a gap. A row's slot is its number among the rows of its
    shard in its input split plus the rows of that shard in the splits before, so no task ever holds
    a whole shard: only counts of shards by splits meet. Repeated rows get a slot each; nulls are
    keys or values like any other; an empty table stays empty; columns that have the name of a new one are replaced.
    """
    place = tree_place(F.col(key_col), tree)
    placed = docs.withColumn("_place", place)
    more = {"grown_shard": tree_place(F.col(key_col), grown)["shard"]} if grown else {}
    placed = placed.withColumns({"region": F.col("_place.region"), "rack": F.col("_place.rack"), "shard": F.col("_place.shard"), **more}).drop("_place")
    kept = stored(placed.withColumn("_row", F.monotonically_increasing_id()), "shards").withColumn("_split", F.shiftright("_row", 33))
    counts = kept.groupBy("shard", "_split").agg(F.count("*").alias("_n"))
    base = counts.select("shard", "_split", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_split")) - F.col("_n")).alias("_base"))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_split").orderBy("_row")))
    return ranked.join(base, ["shard", "_split"]).withColumn("slot", F.col("_base") + F.col("_rank") - 1).drop("_row", "_split", "_rank", "_base")
