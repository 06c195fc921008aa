"""Directed multigraphs as edge tables: (group_key), src, dst, multiplicity; any further edge columns pass through where noted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.shared import stored


def _keys(edges: DataFrame) -> list[str]:
    return ["group_key"] if "group_key" in edges.columns else []


def from_pairs(pairs: DataFrame, multi: bool = True) -> DataFrame:
    """Edges of rows src, dst: counted, or each once."""
    keys = [*_keys(pairs), "src", "dst"]
    return pairs.groupBy(*keys).agg((F.count("*") if multi else F.lit(1).cast("long")).alias("multiplicity"))


def add_edges(edges: DataFrame, more: DataFrame, multi: bool = True) -> DataFrame:
    """The union: multiplicities add up, or stay 1 without multi. It also merges the adjacency of vertices given in parts."""
    keys = [*_keys(edges), "src", "dst"]
    both = edges.select(*keys, "multiplicity").unionByName(more.select(*keys, "multiplicity"))
    return both.groupBy(*keys).agg((F.sum("multiplicity") if multi else F.lit(1).cast("long")).alias("multiplicity"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """One instance less for each row of gone (src, dst); edges without an instance left go."""
    keys = [*_keys(edges), "src", "dst"]
    taken = gone.groupBy(*keys).agg(F.count("*").alias("_gone"))
    left = edges.join(taken, keys, "left").withColumn("multiplicity", F.col("multiplicity") - F.coalesce("_gone", F.lit(0)))
    return left.filter("multiplicity > 0").drop("_gone")


def weighted(pairs: DataFrame, multi: bool = False) -> DataFrame:
    """Edges of rows src, dst, weight, ordinal: with multi all of them, else of each edge the first by ordinal."""
    keys = [*_keys(pairs), "src", "dst"]
    if multi:
        return pairs
    return pairs.groupBy(*keys).agg(F.min_by("weight", "ordinal").alias("weight"))


def degrees(edges: DataFrame, vertices: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """id, out_deg, in_deg (with multiplicities), n_out, n_in (distinct neighbours) of every vertex with an edge.

    One explosion of the edges into their two ends and one aggregation. Vertices (id) given besides come with null degrees
    if no edge touches them, -1 if compat.
    """
    keys = _keys(edges)
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("out"), "multiplicity"), F.struct(F.col("dst").alias("id"), F.lit(False).alias("out"), "multiplicity"))).alias("e")).select(*keys, "e.*")
    value = lambda side, what: F.sum(F.when(F.col("out") == side, what).otherwise(0)).cast("long")
    found = ends.groupBy(*keys, "id").agg(value(True, F.col("multiplicity")).alias("out_deg"), value(False, F.col("multiplicity")).alias("in_deg"), value(True, F.lit(1)).alias("n_out"), value(False, F.lit(1)).alias("n_in"))
    if vertices is None:
        return found
    names = ["out_deg", "in_deg", "n_out", "n_in"]
    out = vertices.select(*keys, "id").join(found, [*keys, "id"], "full")
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in names}) if compat else out


def flags(edges: DataFrame) -> DataFrame:
    """degrees with is_branch (several successors or predecessors), is_source (out only), is_sink (in only)."""
    return degrees(edges).withColumns({"is_branch": (F.col("n_out") > 1) | (F.col("n_in") > 1), "is_source": (F.col("out_deg") > 0) & (F.col("in_deg") == 0), "is_sink": (F.col("out_deg") == 0) & (F.col("in_deg") > 0)})


def in_range(edges: DataFrame, capacity: int, strict: bool = False) -> DataFrame:
    """Edges both of whose ends lie in 0..capacity-1, the places of a graph of fixed size; others are left out, or are an error if strict."""
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < capacity)
    fits = inside("src") & inside("dst")
    if strict:
        return edges.withColumn("src", F.when(fits, F.col("src")).otherwise(F.raise_error(F.concat(F.lit(f"a vertex outside 0..{capacity - 1}: "), F.coalesce(F.col("src").cast("string"), F.lit("null")), F.lit(" or "), F.coalesce(F.col("dst").cast("string"), F.lit("null")))).cast(edges.schema["src"].dataType)))
    return edges.filter(fits)


def renumber(edges: DataFrame) -> DataFrame:
    """(group_key), id, number: dense numbers from 0, sources first, then in order of the ids.

    Groups are numbered by themselves. One graph without groups is sorted over all tasks; a row's number is its place in its
    part plus the rows of the parts before, so that no task holds all vertices.
    """
    keys, rows = _keys(edges), flags(edges).withColumn("_late", ~F.col("is_source"))
    if keys:
        return rows.select(*keys, "id", (F.row_number().over(Window.partitionBy(*keys).orderBy("_late", "id")) - 1).cast("long").alias("number"))
    placed = stored(rows.orderBy("_late", "id").select("id", F.monotonically_increasing_id().alias("_row")), "numbers").withColumns({"_part": F.shiftright("_row", 33), "_place": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))})
    # one row for each part of the sort
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return placed.join(F.broadcast(base), "_part").select("id", (F.col("_base") + F.col("_place")).alias("number"))


def renumbered(edges: DataFrame) -> DataFrame:
    """The edges with their ends as the numbers of `renumber`."""
    keys, numbers = _keys(edges), renumber(edges)
    for end in ("src", "dst"):
        edges = edges.join(numbers.withColumnRenamed("id", end), [*keys, end]).drop(end).withColumnRenamed("number", end)
    return edges.select(*keys, "src", "dst", "multiplicity")


def no_way_out(degree_rows: DataFrame) -> DataFrame:
    """Vertices with an empty adjacency list, those without any edge among them."""
    return degree_rows.filter(F.coalesce("out_deg", F.lit(0)) <= 0)


def sources_and_sinks(edges: DataFrame) -> DataFrame:
    """Per group: n_sources, n_sinks and the largest source and sink."""
    keys = _keys(edges)
    rows = flags(edges)
    aggs = (F.count_if("is_source").alias("n_sources"), F.count_if("is_sink").alias("n_sinks"), F.max(F.when(F.col("is_source"), F.col("id"))).alias("last_source"), F.max(F.when(F.col("is_sink"), F.col("id"))).alias("last_sink"))
    return rows.groupBy(*keys).agg(*aggs)


def adjacency(edges: DataFrame, repeat: bool = True) -> DataFrame:
    """id and its successors in order, each as often as its edge occurs, or once without repeat."""
    keys = _keys(edges)
    pairs = edges.groupBy(*keys, F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "multiplicity"))).alias("p"))
    each = F.flatten(F.transform("p", lambda x: F.array_repeat(x["dst"], x["multiplicity"].cast("int")))) if repeat else F.transform("p", lambda x: x["dst"])
    return pairs.select(*keys, "id", each.alias("successors"))


def adjacency_pages(edges: DataFrame, page: int = 1000) -> DataFrame:
    """id, page and successors (structs dst, multiplicity, in order), `page` of them at most in a row: the sorted list of a vertex, in parts, so that no row holds a hub.

    Places along the lists come from one sort over all tasks, less the place of each list's first: a hub's edges lie in many tasks.
    """
    keys = _keys(edges)
    placed = stored(edges.orderBy(*keys, "src", "dst").select(*keys, "src", "dst", "multiplicity", F.monotonically_increasing_id().alias("_row")), "adjacent").withColumns({"_part": F.shiftright("_row", 33), "_place": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))})
    # one row for each part of the sort
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    placed = placed.join(F.broadcast(base), "_part").withColumn("_at", F.col("_base") + F.col("_place"))
    first = placed.groupBy(*keys, "src").agg(F.min("_at").alias("_first"))
    paged = placed.join(first, [*keys, "src"]).withColumn("page", F.floor((F.col("_at") - F.col("_first")) / page).cast("long"))
    return paged.groupBy(*keys, F.col("src").alias("id"), "page").agg(F.sort_array(F.collect_list(F.struct("dst", "multiplicity"))).alias("successors"))


def neighbours(edges: DataFrame) -> DataFrame:
    """src, dst, number: one row for each parallel edge, in the order that an iterator over sorted lists visits them."""
    return edges.select(*_keys(edges), "src", "dst", F.explode(F.sequence(F.lit(0), F.col("multiplicity").cast("int") - 1)).alias("number"))


def tails(edges: DataFrame) -> DataFrame:
    """id, tail (the only successor, null if there are several) and tail_count, the edges out."""
    keys = _keys(edges)
    return edges.groupBy(*keys, F.col("src").alias("id")).agg(F.when(F.count("*") == 1, F.max("dst")).alias("tail"), F.sum("multiplicity").alias("tail_count"))


def equal_vertices(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, equal: whether a vertex has the same successors and predecessors in both graphs, whatever the multiplicities."""
    keys = _keys(a)

    def sides(edges: DataFrame, name: str) -> DataFrame:
        ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("src").alias("id"), F.struct(F.lit(1).alias("side"), F.col("dst").alias("n")).alias("x")), F.struct(F.col("dst").alias("id"), F.struct(F.lit(0).alias("side"), F.col("src").alias("n")).alias("x")))).alias("e")).select(*keys, "e.*")
        return ends.groupBy(*keys, "id").agg(F.sort_array(F.collect_set("x")).alias(name))

    return sides(a, "_a").join(sides(b, "_b"), [*keys, "id"], "full").select(*keys, "id", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("equal"))


def vertices(edges: DataFrame) -> DataFrame:
    """id, is_branch, is_source, is_sink, out_nbrs, in_nbrs (repeated by multiplicity), one row a vertex."""
    keys = _keys(edges)
    turned = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    out, into = adjacency(edges).withColumnRenamed("successors", "out_nbrs"), adjacency(turned).withColumnRenamed("successors", "in_nbrs")
    rows = flags(edges).join(out, [*keys, "id"], "left").join(into, [*keys, "id"], "left")
    empty = F.array().cast(rows.schema["out_nbrs"].dataType)
    return rows.select(*keys, "id", "is_branch", "is_source", "is_sink", F.coalesce("out_nbrs", empty).alias("out_nbrs"), F.coalesce("in_nbrs", empty).alias("in_nbrs"))


def vertex_payload(edges: DataFrame, merge: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """id and the named columns of all edges out of a vertex or into it, merged by their aggregates."""
    keys = _keys(edges)
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("id"), *merge)
    return ends.groupBy(*keys, "id").agg(*(f(F.col(c)).alias(c) for c, f in merge.items()))


def vertex_text(vertex_rows: DataFrame, both: bool = True, payload: str | None = None) -> DataFrame:
    """value: `id;b;to,..;from,..;payload`, or without the predecessors `id;t;to,..;payload`."""
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    parts = [F.col("id").cast("string"), F.lit("b" if both else "t"), join("out_nbrs"), *([join("in_nbrs")] * both), F.coalesce(F.col(payload), F.lit("")) if payload else F.lit("")]
    return vertex_rows.select(F.concat_ws(";", *parts).alias("value"))


def parse_vertex_text(lines: DataFrame, multi: bool = True) -> DataFrame:
    """id, to, from (arrays in order, each neighbour once without multi) and payload of lines in that form; malformed numbers give null."""
    parts = F.split("value", ";", 5)
    both = F.coalesce(F.get(parts, 1) == "b", F.lit(False))

    def ids(text: Column) -> Column:
        found = F.sort_array(F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.try_cast("long")))
        return found if multi else F.array_distinct(found)

    return lines.select(F.get(parts, 0).try_cast("long").alias("id"), ids(F.coalesce(F.get(parts, 2), F.lit(""))).alias("to"), F.when(both, ids(F.coalesce(F.get(parts, 3), F.lit("")))).otherwise(F.array().cast("array<bigint>")).alias("from"), F.when(both, F.get(parts, 4)).otherwise(F.get(parts, 3)).alias("payload"))


def edges_of_vertices(parsed: DataFrame) -> DataFrame:
    """Edges of rows id, to, from: each to-neighbour is one edge out of the id. A vertex's predecessors repeat others' successors and are used only where the source has no row."""
    out = parsed.select(F.col("id").alias("src"), F.explode("to").alias("dst"))
    into = parsed.select(F.explode("from").alias("src"), F.col("id").alias("dst"))
    alone = into.join(parsed.select(F.col("id").alias("src")).distinct(), "src", "left_anti")
    return from_pairs(out.unionByName(alone))


def display(vertex_rows: DataFrame) -> DataFrame:
    """id and a readable line of its neighbours."""
    return vertex_rows.select("id", F.concat(F.lit("vertex "), F.col("id").cast("string"), F.lit(" to ["), F.array_join(F.col("out_nbrs").cast("array<string>"), " "), F.lit("] from ["), F.array_join(F.col("in_nbrs").cast("array<string>"), " "), F.lit("]")).alias("line"))
