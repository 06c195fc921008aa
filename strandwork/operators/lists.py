"""Linked lists, permutations and forests in tables: places along lists, orbits of permutations, spanning forests, by joins in few rounds.

Ids are longs, unique over the whole table. Pointers double: in a round each row takes over what the row that it points to points to. About every
SPACING-th id, by a hash, is a ruler: other rows stop at the first one, after rounds that grow with the logarithm of the largest gap, and
only the rulers, as a shorter list of their own, go the whole way. What has at most SHORT rows is walked by one task at once, as rounds cost a table each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.shared import stored

#: Ids to a ruler.
SPACING = 16
#: Rows of a batch of results.
BATCH = 50_000
#: Rows of a list, or links, that one task takes (some 200 bytes each while it does): the results are those of the rounds.
SHORT = 1 << 20


def is_ruler(column: str, level: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(level)), F.lit(SPACING)) == 0


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their number from 0 in that order: sorted over all tasks, a row's number is its place in its part and the rows of the parts before."""
    placed = stored(rows.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "numbered").withColumns({"_part": F.shiftright("_row", 33), "_row": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))})
    # one row for each part of the sort
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return placed.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_row")).drop("_part", "_row", "_base")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """The columns of all batches."""
    held = [*batches]
    return [np.concatenate([np.asarray(b.column(c)) if c != "there" else np.array(b.column(c), bool) for b in held]) if held else np.zeros(0, np.int64) for c in names]


def _jump_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rounds of `_jumped` on all rows of a short list."""
    names = ["id", "to", "low", "far", "there"]
    ids, to, low, far, there = _whole(batches, names)
    if not len(ids):
        return
    order = np.argsort(ids)
    ids, to, low, far, there = (x[order].copy() for x in (ids, to, low, far, there))
    at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    active = np.flatnonzero(~there)
    if (ids[at[active]] != to[active]).any():
        raise ValueError("a row points at an id that there is none of")
    before, passed = -1, 1
    while len(active) and not (len(active) == before and passed >= len(active)):
        by = at[active]
        new = np.minimum(low[active], low[by]), far[active] + far[by], to[by], at[by], there[by]
        for x, y in zip((low, far, to, at, there), new, strict=True):
            x[active] = y
        before, passed = len(active), passed * 2
        active = active[~there[active]]
    for i in range(0, len(ids), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + BATCH]) for x in (ids, to, low, far, there)], names)


def _least_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the forest of least ids of all links (Kruskal 1956; is_node false), and every node with the least of its tree (true)."""
    links, a, b = _whole(batches, ["id", "a", "b"])
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, order = list(range(len(nodes))), np.argsort(links)

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    chosen = []
    for k, x, y in zip(links[order].tolist(), ends[: len(a)][order].tolist(), ends[len(a) :][order].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            chosen.append(k)
    # a node never hangs on a larger one
    names = nodes[np.array([root(v) for v in range(len(nodes))], np.int64)]
    for kind, one, two in ((False, np.array(chosen, np.int64), np.array(chosen, np.int64)), (True, nodes.astype(np.int64), names)):
        for i in range(0, len(one), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(one[i : i + BATCH]), pa.array(two[i : i + BATCH]), pa.array(np.full(len(one[i : i + BATCH]), kind))], ["id", "root", "is_node"])


def _jumped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows id, to, low, far, there after all have come to a place to stop at (there: `to` is one), and those that go round in cycles without one.

    low is the least of the lows on the way, far the sum of what its steps are worth. What has stopped is only looked up. Between
    two places to stop at each round brings some row home, so where none has come, and the ways are as long as there are rows on
    them, the rest goes round, and its low covers its cycle.
    """
    state = stored(rows.select("id", "to", "low", F.col("far").cast("long").alias("far"), "there"), "jump")
    if state.count() <= SHORT:
        state = stored(state.coalesce(1).mapInArrow(_jump_all, state.schema), "jump")
        return state.filter("there"), state.filter("not there")
    done, active = [state.filter("there")], state.filter("not there")
    left, before, passed = active.count(), -1, 1
    while left and not (left == before and passed >= left):
        ahead = _union([active, *done]).select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"), F.col("far").alias("_far"), F.col("there").alias("_there"))
        moved = active.join(ahead, "to").select("id", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), (F.col("far") + F.col("_far")).alias("far"), F.col("_there").alias("there"))
        moved = stored(moved, "jump")
        done.append(moved.filter("there"))
        active = moved.filter("not there")
        before, passed = left, passed * 2
        left = active.count()
    return _union(done), active


def orbits(rows: DataFrame, level: int = 0) -> DataFrame:
    """id and orbit, the least low on its cycle, of a permutation's rows id, to, low."""
    rows = stored(rows.select("id", "to", "low", F.lit(0).cast("long").alias("far")), "permutation")
    if rows.count() <= SHORT:
        _, rest = _jumped(rows.withColumn("there", F.lit(False)))
        return rest.select("id", F.col("low").alias("orbit"))
    inner, rest = _jumped(rows.filter(~is_ruler("id", level)).withColumn("there", is_ruler("to", level)))
    inner = stored(inner.select("id", "to", "low"), "orbits")
    ahead = inner.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
    rulers = rows.filter(is_ruler("id", level)).join(ahead, "to", "left").select("id", F.coalesce("_to", "to").alias("to"), F.least("low", "_low").alias("low"))
    found = stored(orbits(rulers, level + 1), "orbits")
    met = inner.select("id", "to").join(found.withColumnRenamed("id", "to"), "to").select("id", "orbit")
    return _union([found, met, rest.select("id", F.col("low").alias("orbit"))])


def places(rows: DataFrame, level: int = 0) -> DataFrame:
    """id, first (of its list) and at (how far behind it) of rows id, before (null for the first) and far, how far a row lies behind the one before it. No row may lie on a cycle."""
    none = F.col("before").isNull()
    rows = stored(rows.select("id", F.coalesce("before", "id").alias("to"), none.alias("head"), F.when(none, 0).otherwise(F.col("far")).cast("long").alias("far")), "lists")
    heads, rest = rows.filter("head").withColumn("there", F.lit(True)).drop("head"), rows.filter("not head").drop("head")
    short = rest.count() <= SHORT
    inner = rest.withColumn("there", F.lit(False)) if short else rest.filter(~is_ruler("id", level)).withColumn("there", is_ruler("to", level))
    # a row behind a head finds it among the rows that have stopped
    inner, _ = _jumped(heads.unionByName(inner).withColumn("low", F.col("id")))
    if short:
        return inner.select("id", F.col("to").alias("first"), F.col("far").alias("at"))
    inner = stored(inner.select("id", "to", "far"), "places")
    ahead = inner.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"))
    rulers = rest.filter(is_ruler("id", level)).join(ahead, "to", "left").select("id", F.coalesce("_to", "to").alias("before"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"))
    found = stored(places(rulers.unionByName(heads.select("id", F.lit(None).cast("long").alias("before"), "far")), level + 1), "places")
    met = inner.filter("id <> to").join(found.select(F.col("id").alias("to"), "first", F.col("at").alias("_at")), "to").select("id", "first", (F.col("_at") + F.col("far")).alias("at"))
    return found.unionByName(met)


def forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of links id, a, b: the ids of a spanning forest (that of least ids, so there is only one), and id and root of every node, the least node of its tree.

    Every tree takes its least link to another tree (Boruvka 1926); trees that are joined so get one name by doubling pointers, links within a
    tree go and of several between two trees the least stays. Each round leaves at most half of the trees; the last SHORT links are one task's.
    """
    links = stored(links.select("id", "a", "b"), "links")
    roots = stored(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "roots")
    chosen = [links.filter("a <> b").select("id").limit(0)]
    live = links.filter("a <> b")
    while n := live.count():
        if n <= SHORT:
            both = stored(live.select("id", "a", "b").coalesce(1).mapInArrow(_least_forest, "id long, root long, is_node boolean"), "forest")
            chosen.append(both.filter("NOT is_node").select("id"))
            up = both.filter("is_node").select(F.col("id").alias("root"), F.col("root").alias("_root"))
            roots = stored(roots.join(up, "root", "left").select("id", F.coalesce("_root", "root").alias("root")), "roots")
            break
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "id"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "id"))).alias("e")).select("e.*")
        least = stored(ends.groupBy("node").agg(F.min(F.struct("id", "other")).alias("l")).select("node", "l.id", "l.other"), "least")
        chosen.append(stored(least.select("id").distinct(), "chosen"))
        # two trees that chose the same link: the lesser is the root of what hangs on them
        turned = least.select(F.col("node").alias("other"), F.col("id").alias("_id"))
        state = least.join(turned, "other").withColumn("there", (F.col("id") == F.col("_id")) & (F.col("node") < F.col("other")))
        state = state.select(F.col("node").alias("id"), F.when(F.col("there"), F.col("node")).otherwise(F.col("other")).alias("to"), F.lit(0).cast("long").alias("far"), "there")
        named, _ = _jumped(state.withColumn("low", F.col("id")))
        # the name of a tree is its least node
        low = named.groupBy("to").agg(F.min("id").alias("root"))
        named = stored(named.join(low, "to").select("id", "root"), "named")
        up = named.select(F.col("id").alias("root"), F.col("root").alias("_root"))
        roots = stored(roots.join(up, "root", "left").select("id", F.coalesce("_root", "root").alias("root")), "roots")
        for end in ("a", "b"):
            live = live.join(named.select(F.col("id").alias(end), F.col("root").alias(f"_{end}")), end).drop(end)
        live = live.filter("_a <> _b").groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("id").alias("id"))
        live = stored(live.select("id", "a", "b"), "live")
    return _union(chosen), roots
