"""Contraction and strong components of graphs of any size, as joins: for groups that do not fit a worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.operators import digraph, traverse
from strandwork.shared import release, stored

#: Called after each round with its number and how many rows are still on their way.
Progress = Callable[[int, int], None]


def _double(state: DataFrame, keys: list[str], rounds: int, progress: Progress | None = None) -> DataFrame:
    """(v, parent, dist, low, least, there) after all rows are there, that is point at a head, or `rounds` doublings.

    Rows that are there take no part in the join: the others' parents are all different, so no head is a hot key. A round
    in which no row comes home leaves only such as go round in cycles, and once windows are as long as there are rows left they cover these.
    """
    before = -1
    for number in range(rounds):
        up = state.select(*keys, F.col("v").alias("parent"), F.col("parent").alias("_up"), F.col("dist").alias("_dist"), F.col("low").alias("_low"), F.col("least").alias("_least"), F.col("there").alias("_there"))
        moved = state.filter("not there").join(up, [*keys, "parent"]).select(*keys, "v", F.col("_up").alias("parent"), (F.col("dist") + F.col("_dist")).alias("dist"), F.least("low", "_low").alias("low"), F.least("least", "_least").alias("least"), F.col("_there").alias("there"))
        old, state = state, stored(state.filter("there").unionByName(moved), "double")
        left = state.filter("not there").count()
        release(old)
        if progress:
            progress(number, left)
        if not left or left == before and 2 ** (number + 1) >= left:
            break
        before = left
    return state


def members(edges: DataFrame, must_match: bool = False, progress: Progress | None = None) -> DataFrame:
    """(group_key), head, dist, v, succ, m_out and the least multiplicity of the links up to v, of every vertex of a chain.

    Each vertex that joins its predecessor points at it; pointers double until they reach the heads, in rounds that grow with
    the logarithm of the longest chain. Rows that by then do not point at a head lie on cycles: their windows
    cover the cycle, so the least id seen is its head; its link is cut and they double again.
    """
    keys = ["group_key"] if "group_key" in edges.columns else []
    vertices = digraph.flags(edges).filter("NOT is_branch").select(*keys, F.col("id").alias("v"), "out_deg")
    after = edges.select(*keys, F.col("src").alias("v"), F.col("dst").alias("succ"), F.col("multiplicity").alias("m_out"))
    before = edges.select(*keys, F.col("dst").alias("v"), F.col("src").alias("pred"), F.col("multiplicity").alias("m_in"))
    plain = vertices.join(after, [*keys, "v"], "left").join(before, [*keys, "v"], "left")
    heads = vertices.select(*keys, F.col("v").alias("pred"), F.lit(True).alias("pred_plain"))
    joins = F.coalesce("pred_plain", F.lit(False)) & F.col("succ").isNotNull() & (F.col("pred") != F.col("v"))
    if must_match:
        joins = joins & (F.col("m_in") == F.col("m_out"))
    plain = stored(plain.join(heads, [*keys, "pred"], "left").select(*keys, "v", "succ", "m_out", "m_in", F.when(joins, F.col("pred")).alias("pred")), "plain")
    rounds = max(1, plain.count()).bit_length() + 1

    def start(rows: DataFrame) -> DataFrame:
        return stored(rows.select(*keys, "v", F.coalesce("pred", "v").alias("parent"), F.col("pred").isNotNull().cast("long").alias("dist"), F.col("v").alias("low"), F.when(F.col("pred").isNotNull(), F.col("m_in")).alias("least"), F.col("pred").isNull().alias("there")), "start")

    state = _double(start(plain), keys, rounds, progress)
    done = state.filter("there")
    stuck = state.filter("not there").select(*keys, "v", F.col("low").alias("head"))
    if not stuck.isEmpty():
        again = plain.join(stuck, [*keys, "v"]).withColumn("pred", F.when(F.col("v") != F.col("head"), F.col("pred")))
        done = done.unionByName(_double(start(again), keys, rounds, progress))
    return done.join(plain.select(*keys, "v", "succ", "m_out"), [*keys, "v"]).select(*keys, F.col("parent").alias("head"), "dist", "v", "succ", "m_out", "least")


def contract(edges: DataFrame, must_match: bool = False, progress: Progress | None = None, merge: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(group_key), head, tail, vertices, multiplicity, n_vertices: the chains that `traverse.contract` gives, for any size of group.

    Without merge groups of at most traverse.PIECE edges are contracted in one pass; the others' pointers double. merge names further columns of the edges and the aggregate (F.sum, F.min, F.collect_list ...) that a chain's links and the edge
    out of it are merged by.
    """
    keys = ["group_key"] if "group_key" in edges.columns else []
    if keys and not merge:
        found, left = traverse.settled(edges, traverse.CHAIN, lambda x: traverse.chain_rows(x, must_match))
        return found if left.isEmpty() else found.unionByName(by_joins(left, must_match, progress, None))
    return by_joins(edges, must_match, progress, merge)


def by_joins(edges: DataFrame, must_match: bool = False, progress: Progress | None = None, merge: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """contract without the pass over small groups."""
    keys = ["group_key"] if "group_key" in edges.columns else []
    links = members(edges, must_match, progress)
    order = F.sort_array(F.collect_list(F.struct("dist", "v")))
    last = F.max(F.struct("dist", "succ", "m_out", "least"))
    found = links.groupBy(*keys, "head").agg(F.transform(order, lambda x: x["v"]).alias("vertices"), last.alias("last"), F.count("*").cast("int").alias("n_vertices"))
    out = found.select(*keys, "head", F.col("last.succ").alias("tail"), "vertices", F.least("last.least", "last.m_out").alias("multiplicity"), "n_vertices")
    if not merge:
        return out
    # the only edge out of each vertex of a chain is a link of it or leads out of it
    own = edges.select(*keys, F.col("src").alias("v"), *merge)
    merged = links.select(*keys, "head", "v").join(own, [*keys, "v"]).groupBy(*keys, "head").agg(*(f(F.col(c)).alias(c) for c, f in merge.items()))
    return out.join(merged, [*keys, "head"], "left")


def reduced(edges: DataFrame, chains: DataFrame, lows: bool = False) -> DataFrame:
    """Edges between heads of chains and branches: a chain's is that to its tail, a branch keeps its own. lows adds low, the least vertex that src stands for, and place, where in its chain."""
    keys = ["group_key"] if "group_key" in edges.columns else []
    inside = chains.select(*keys, F.explode("vertices").alias("src"))
    own = edges.select(*keys, "src", "dst", "multiplicity").join(inside, [*keys, "src"], "left_anti")
    # the edge out of a chain has the multiplicity of its last vertex's edge
    least = F.array_min("vertices")
    last = chains.filter("tail IS NOT NULL").select(*keys, "head", F.element_at("vertices", -1).alias("src"), least.alias("low"), (F.array_position("vertices", least) - 1).cast("int").alias("place"))
    extra = ["low", "place"] if lows else []
    out = edges.join(last, [*keys, "src"]).select(*keys, F.col("head").alias("src"), "dst", "multiplicity", *extra)
    return own.withColumns({"low": F.col("src"), "place": F.lit(0)}).select(*keys, "src", "dst", "multiplicity", *extra).unionByName(out)


def _parted(links: DataFrame, nodes: DataFrame, keys: list[str], max_rounds: int, progress: Progress | None) -> DataFrame:
    """(group_key), id, root: the strong component of every node; equal roots are one component.

    Each node takes the least colour (a hash, then the id) of all that reach it, and the least of all that it reaches: along the links, and
    by looking up the colour of its colour, which reaches it too, so that ways double. Where both are the same, its owner and the
    node reach each other. Members of one component have both in common, so links between others go, and nodes without a link in or out are
    components by themselves; the rest is coloured anew.
    """
    found, rounds, salt = [], 0, 0
    own = lambda: F.struct(F.xxhash64(*keys, "id", F.lit(salt)).alias("h"), F.col("id").alias("id"))
    while True:
        # what no link leads into, or none out of, is a component by itself
        ends = lambda side: links.select(*keys, F.col(side).alias("id")).distinct()
        linked = stored(ends("src").join(ends("dst"), [*keys, "id"], "left_semi"), "linked")
        found.append(stored(nodes.join(linked, [*keys, "id"], "left_anti").select(*keys, "id", F.col("id").alias("root")), "single"))
        inner = lambda side: linked.select(*keys, F.col("id").alias(side))
        links = stored(links.join(inner("src"), [*keys, "src"], "left_semi").join(inner("dst"), [*keys, "dst"], "left_semi"), "inner")
        nodes = linked
        if nodes.isEmpty():
            return _all(found)
        state = stored(nodes.withColumns({"f": own(), "b": own()}), "colours")
        moved = 1
        while moved:
            rounds += 1
            if rounds > max_rounds:
                raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
            ahead = links.join(state.select(*keys, F.col("id").alias("src"), "f"), [*keys, "src"]).select(*keys, F.col("dst").alias("id"), "f", F.lit(None).cast(state.schema["b"].dataType).alias("b"))
            back = links.join(state.select(*keys, F.col("id").alias("dst"), "b"), [*keys, "dst"]).select(*keys, F.col("src").alias("id"), F.lit(None).cast(state.schema["f"].dataType).alias("f"), "b")
            sent = ahead.unionByName(back).groupBy(*keys, "id").agg(F.min("f").alias("_f"), F.min("b").alias("_b"))
            new = state.join(sent, [*keys, "id"], "left").select(*keys, "id", F.least("f", "_f").alias("f"), F.least("b", "_b").alias("b"), F.col("f").alias("was_f"), F.col("b").alias("was_b"))
            of = state.select(*keys, F.col("id").alias("_id"), F.col("f").alias("_f"), F.col("b").alias("_b"))
            jump = lambda rows, c: rows.withColumn("_id", F.col(f"{c}.id")).join(of.select(*keys, "_id", f"_{c}"), [*keys, "_id"]).withColumn(c, F.least(c, f"_{c}")).drop("_id", f"_{c}")
            new = stored(jump(jump(new, "f"), "b"), "colours")
            moved = new.filter((F.col("f") != F.col("was_f")) | (F.col("b") != F.col("was_b"))).count()
            release(state)
            state = new.drop("was_f", "was_b")
            state.stored_path = new.stored_path
            if progress:
                progress(rounds, moved)
        found.append(state.filter("f = b").select(*keys, "id", F.col("f.id").alias("root")))
        rest = state.filter("f <> b")
        side = lambda c: rest.select(*keys, F.col("id").alias(c), F.col("f").alias(f"f_{c}"), F.col("b").alias(f"b_{c}"))
        links = stored(links.join(side("src"), [*keys, "src"]).join(side("dst"), [*keys, "dst"]).filter("f_src = f_dst AND b_src = b_dst").select(*keys, "src", "dst"), "inner")
        nodes, salt = rest.select(*keys, "id"), salt + 1


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def strong_components(edges: DataFrame, max_rounds: int = 10_000, progress: Progress | None = None) -> DataFrame:
    """(group_key), id, component: strong components named by their least vertex.

    Groups of at most traverse.PIECE links are settled in one pass. Of the others, and of a graph without groups, chains are contracted first, in rounds that grow with the logarithm of the longest: of a chain either all vertices are in
    one component, if its node lies on a cycle, or each is one. The branches and heads that are left are parted by colours (`_parted`), whose
    ways double too. progress is called after each round of either.
    """
    if "group_key" in edges.columns:
        links = edges.select("group_key", "src", "dst").withColumn("multiplicity", F.lit(1).cast("long"))
        found, left = traverse.settled(links, "id ID, component ID", lambda x: list(traverse.strong_components(x).items()))
        return found if left.isEmpty() else found.unionByName(_components(left, max_rounds, progress))
    return _components(edges, max_rounds, progress)


def _components(edges: DataFrame, max_rounds: int, progress: Progress | None) -> DataFrame:
    """strong_components by joins."""
    keys = ["group_key"] if "group_key" in edges.columns else []
    links = stored(edges.select(*keys, "src", "dst").distinct(), "links")
    every = links.select(*keys, F.explode(F.array("src", "dst")).alias("id")).distinct()
    links = links.filter("src <> dst")
    inside = stored(members(links.withColumn("multiplicity", F.lit(1).cast("long")), progress=progress), "members")
    last = inside.groupBy(*keys, "head").agg(F.max(F.struct("dist", "succ")).alias("l")).select(*keys, F.col("head").alias("src"), F.col("l.succ").alias("dst"))
    out = links.join(inside.select(*keys, F.col("v").alias("src")), [*keys, "src"], "left_anti")
    between = stored(out.unionByName(last.filter("dst IS NOT NULL")), "between")
    nodes = every.join(inside.filter("dist > 0").select(*keys, F.col("v").alias("id")), [*keys, "id"], "left_anti")
    parts = stored(_parted(between.filter("src <> dst"), nodes, keys, max_rounds, progress), "parts")
    # nodes on a cycle: several in a component, or a chain that closes
    several = parts.groupBy(*keys, "root").agg(F.count("*").alias("n")).filter("n > 1").select(*keys, "root")
    closed = between.filter("src = dst").select(*keys, F.col("src").alias("root")).distinct()
    on_cycle = parts.join(several.unionByName(closed).distinct(), [*keys, "root"], "left_semi").select(*keys, F.col("id").alias("head"), "root")
    chained = inside.select(*keys, "head", F.col("v").alias("id")).join(on_cycle, [*keys, "head"], "left").select(*keys, "id", F.coalesce("root", "id").alias("root"))
    alone = parts.join(inside.select(*keys, F.col("v").alias("id")), [*keys, "id"], "left_anti").select(*keys, "id", "root")
    whole = stored(chained.unionByName(alone), "whole")
    names = whole.groupBy(*keys, "root").agg(F.min("id").alias("component"))
    return whole.join(names, [*keys, "root"]).select(*keys, "id", "component")


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(group_key), id of all that the starts reach along links (src, dst) without cycles, the starts among them.

    Each round goes a step ahead from the starts, and drops what no link leads into and is no start; either way it is done
    once it has come to its end, so rounds grow with the shorter of both: without cycles all that is left then is reached.
    """
    keys = ["group_key"] if "group_key" in links.columns else []
    links, starts = stored(links.select(*keys, "src", "dst").distinct(), "links"), stored(starts.select(*keys, "id").distinct(), "starts")
    seen = new = starts
    left = links
    while True:
        ahead = links.join(new.select(*keys, F.col("id").alias("src")), [*keys, "src"]).select(*keys, F.col("dst").alias("id")).distinct()
        new = stored(ahead.join(seen, [*keys, "id"], "left_anti"), "ahead")
        if new.isEmpty():
            return seen
        seen = stored(seen.unionByName(new), "seen")
        fed = left.select(*keys, F.col("dst").alias("src")).unionByName(starts.select(*keys, F.col("id").alias("src"))).distinct()
        if left.join(fed, [*keys, "src"], "left_anti").isEmpty():
            return left.select(*keys, F.col("dst").alias("id")).unionByName(starts).distinct()
        left = stored(left.join(fed, [*keys, "src"], "left_semi"), "left")


def spell_chains(chains: DataFrame) -> DataFrame:
    """The chains with label: the bases along the mers of their vertices."""
    rest = F.transform(F.slice("vertices", 2, F.greatest(F.size("vertices") - 1, F.lit(0))), lambda v: F.right(v, F.lit(1)))
    return chains.withColumn("label", F.concat(F.col("head"), F.array_join(rest, "")))
