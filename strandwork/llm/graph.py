"""Connected components of an edge list by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import release, stored


#: Rows of minima that go to all tasks at most.
BROADCAST_ROWS = 1 << 20


def _with_least(edges: DataFrame, least: DataFrame, rows: int | None) -> DataFrame:
    """The edges with m, the least id that their u knows.

    A hub's edges stay where they are if the minima are few enough to broadcast; else the minima are stored, so that
    both sides of the join come straight from a shuffle and AQE can split a hub's edges.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        return edges.join(F.broadcast(least), "u")
    return edges.join(stored(least, "least"), "u")


def components(edges: DataFrame, rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """id and component, the least id that the edges a-b reach, for every id that has an edge to another.

    Each round links every id's larger neighbours, then its smaller ones, to the least id it knows
    (the large- and small-star steps of Kiveris et al. 2014), and keeps each edge once; the rounds grow with the
    logarithm of the ids and end when the edges no longer change. Edges with a null end and loops are left out.
    Only pairs of numbers are shuffled, and minima are aggregated before the shuffle. A round's edges are written to the shared folder, and deleted when the next round's are; rows
    bounds the ids. An empty table gives none.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("k")).filter("k and u <> v").select("u", "v").distinct(), "edges", rows)
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both.filter("v > u"), least, rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # u > v holds for every row of `large`: m is the least of u's own neighbourhood
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least, rows).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        old, now = now, stored(small.filter("u <> v").distinct(), "edges", rows)
        release(old)
        before, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
