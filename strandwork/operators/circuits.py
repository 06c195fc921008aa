"""Euler trails of one graph, or of groups, of any size: no task holds a graph, a trail or the edges of a hub.

Trails are as few as `traverse.euler_paths` gives, but not the same ones: there the least unused successor is taken step by step, which one worker
must do; here edges are paired at all vertices at once. Either way is one result for one graph, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.codec import LONGEST, mer_encode
from strandwork.operators import contract, digraph, kmers, lists
from strandwork.shared import drop_paths, recorded, stored

#: Copies of an edge that one row expands to at once.
COPIES = 1024
#: Bits of a place on a walk of at most kmers.PIECE steps.
PLACE = 17


def _nodes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains contracted: (group_key), v, node, dist of the vertices of chains, and the edges between branches and heads with n, the vertices that src stands for."""
    keys = ["group_key"] if "group_key" in edges.columns else []
    inside = stored(contract.members(edges, must_match=True), "members")
    last = inside.groupBy(*keys, "head").agg(F.max(F.struct("dist", "succ", "m_out")).alias("l")).filter("l.succ IS NOT NULL")
    out = last.select(*keys, F.col("head").alias("src"), F.col("l.succ").alias("dst"), F.col("l.m_out").alias("multiplicity"), (F.col("l.dist") + 1).alias("n"), F.lit(False).alias("branch"))
    own = edges.select(*keys, "src", "dst", "multiplicity").join(inside.select(*keys, F.col("v").alias("src")), [*keys, "src"], "left_anti")
    between = own.withColumns({"n": F.lit(1).cast("long"), "branch": F.lit(True)}).unionByName(out)
    return inside.select(*keys, "v", F.col("head").alias("node"), "dist"), between


def _copies(rows: DataFrame, count: str) -> DataFrame:
    """Each row as often as its count says, with copy from 0: in steps of COPIES, so that no array holds all of them."""
    steps = rows.filter(F.col(count) > 0).withColumn("_step", F.explode(F.expr(f"sequence(0L, (CAST({count} AS BIGINT) - 1) div {COPIES})")))
    each = F.expr(f"sequence(_step * {COPIES}, least(_step * {COPIES} + {COPIES}, CAST({count} AS BIGINT)) - 1)")
    return steps.withColumn("copy", F.explode(each)).drop("_step")


def _links(between: DataFrame, keys: list[str]) -> DataFrame:
    """Links from where a trail must end to where one must begin, so that as many lead into each vertex as out of it.

    Ends and beginnings are paired in their order; both have the same numbers in each group.
    """
    off = digraph.degrees(between.select(*keys, "src", "dst", "multiplicity")).withColumn("off", F.col("out_deg") - F.col("in_deg")).filter("off <> 0")
    off = _copies(stored(off.select(*keys, "id", "off", F.abs("off").alias("times")), "off"), "times")
    order = [F.col(c) for c in (*keys, "id", "copy")]
    begins = lists.numbered(off.filter("off > 0").select(*keys, "id", "copy"), order, "number").select("number", F.col("id").alias("dst"))
    ends = lists.numbered(off.filter("off < 0").select(*keys, "id", "copy"), order, "number").select(*keys, "number", F.col("id").alias("src"))
    return ends.join(begins, "number").select(*keys, "src", "dst", F.col("number").alias("copy"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("branch"), F.lit(True).alias("link"))


def _linked(between: DataFrame, keys: list[str]) -> DataFrame:
    """The edges one by one, and the links."""
    each = _copies(between, "multiplicity").select(*keys, "src", "dst", "copy", "n", "branch", F.lit(False).alias("link"))
    return each.unionByName(_links(between, keys))


def _paired(units: DataFrame, keys: list[str]) -> DataFrame:
    """The units numbered by id, and next, the unit that follows: at each vertex the ways in and the ways out have the same numbers: they are paired, and no vertex is one task's."""
    by = lambda a, b: [F.col(c) for c in (*keys, a, "link", b, "copy")]
    return stored(lists.numbered(lists.numbered(units, by("src", "dst"), "id"), by("dst", "src"), "next"), "units")


def _turned(ring: DataFrame) -> DataFrame:
    """id and _turned of rows id, into, orbit, next: at each vertex `into` every row goes on as the next one, by orbits, would have."""
    ring = stored(lists.numbered(ring, [F.col("into"), F.col("orbit")], "place").select("id", "into", "next", "place"), "rings")
    follows = ring.select((F.col("place") - 1).alias("place"), "into", F.col("next").alias("_next"))
    begin = ring.groupBy("into").agg(F.min_by("next", "place").alias("_first"))
    return ring.join(follows, ["place", "into"], "left").join(begin, "into").select("id", F.coalesce("_next", "_first").alias("_turned"))


def _places(pieces: DataFrame, closed: DataFrame) -> DataFrame:
    """id, first (of its trail) and at of the rows id, next, link, n that are no links. A trail begins behind a link; a closed one at the id that `closed` names."""
    steps = pieces.select(F.col("next").alias("id"), F.col("id").alias("before"), F.col("link").alias("behind"), F.col("n").alias("far")).join(closed.withColumn("begins", F.lit(True)), "id", "left")
    own = steps.join(pieces.filter("NOT link").select("id"), "id", "left_semi")
    return stored(lists.places(own.select("id", F.when(~F.col("behind") & F.col("begins").isNull(), F.col("before")).alias("before"), "far")), "found")


def _merged(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The permutation id to next of the units, its cycles merged into one wherever they meet, and what is known of each cycle: cycle, root.

    Of the vertices where cycles meet those are taken that a spanning forest of the cycles needs; there the chosen ways out are
    passed on around: each cycle goes on as the next one would have.
    """
    cycle = lists.orbits(units.select("id", F.col("next").alias("to"), F.col("id").alias("low")))
    cycles = stored(units.join(cycle, "id").select("id", "next", "into", "orbit", "link", "branch"), "cycles")
    # one way into each vertex for each cycle
    way = stored(cycles.groupBy("into", "orbit").agg(F.min("id").alias("id")), "ways")
    first = way.groupBy("into").agg(F.min("orbit").alias("a"), F.count("*").alias("m")).filter("m > 1").drop("m")
    star = stored(way.join(first, "into").select("id", "into", "a", F.col("orbit").alias("b")), "stars")
    chosen, roots = lists.forest(star.filter("a <> b").select("id", "a", "b"))
    taken = star.join(chosen, "id").select("id", "into", F.col("b").alias("orbit"))
    hubs = taken.select("into").distinct()
    hosts = star.filter("a = b").join(hubs, "into", "left_semi").select("id", "into", F.col("a").alias("orbit"))
    turned = _turned(taken.unionByName(hosts).join(units.select("id", "next"), "id"))
    merged = units.select("id", "next").join(turned, "id", "left").select("id", F.coalesce("_turned", "next").alias("next"))
    known = cycles.groupBy("orbit").agg(F.max("link").alias("link"), F.min(F.when(F.col("branch"), F.col("id"))).alias("at_branch"), F.min("id").alias("least"))
    known = known.join(roots.withColumnRenamed("id", "orbit"), "orbit", "left").withColumn("root", F.coalesce("root", "orbit"))
    return merged, known


def _walked(edges: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The units of all trails: (group_key), id, src, dst, path (its trail's first unit), at, n, last; and the vertices of chains."""
    keys = ["group_key"] if "group_key" in edges.columns else []
    inside, between = _nodes(edges)
    units = _paired(_linked(between, keys), keys)
    into = units.withColumn("into", F.xxhash64(*keys, "dst")) if keys or dict(units.dtypes)["dst"] not in ("bigint", "int") else units.withColumn("into", F.col("dst").cast("long"))
    merged, known = _merged(into)
    merged = stored(merged, "merged")
    # a closed trail begins at its least branch, or else its least vertex
    closed = known.groupBy("root").agg(F.max("link").alias("link"), F.min("at_branch").alias("at_branch"), F.min("least").alias("least")).filter("NOT link").select(F.coalesce("at_branch", "least").alias("id"))
    found = _places(merged.join(units.select("id", "link", "n"), "id"), closed)
    return units.filter("NOT link").join(found, "id").select(*keys, "id", "src", "dst", F.col("first").alias("path"), "at", "n"), inside, keys


def euler_trails(edges: DataFrame) -> DataFrame:
    """(group_key), path_id, pos, id: fewest trails that use every edge as often as its multiplicity says.

    Each vertex's ways in are paired with its ways out, both in order, which makes closed walks; where walks meet they are merged, along a
    spanning forest, so that one is left for each connected part; it is cut at the links from ends to beginnings that an
    unbalanced part needs. A closed trail begins at its least branch, or without one at its least vertex. Chains are contracted before and put in by a
    join. Rounds grow with the logarithm of the number of edges; there is no group in a task and no array of a trail. Trails are numbered in the order
    of their first edges; rows with null ends are left out. The result is stored.
    """
    with recorded(edges.sparkSession) as held:
        own = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
        walked, inside, keys = _walked(own)
        walked = stored(walked, "walked")
        # a trail's number within its group
        numbers = lists.numbered(walked.filter("id = path").select(*keys, "path"), [F.col(c) for c in (*keys, "path")], "number")
        numbers = stored(numbers, "numbers")
        least = numbers.groupBy(*keys).agg(F.min("number").alias("base"))
        numbers = (numbers.join(least, keys) if keys else numbers.crossJoin(F.broadcast(least))).select("path", (F.col("number") - F.col("base")).cast("int").alias("path_id"))
        ends = walked.groupBy("path").agg(F.max(F.struct("at", "n", *keys, "dst")).alias("e")).select(*(F.col(f"e.{k}").alias(k) for k in keys), "path", (F.col("e.at") + F.col("e.n")).alias("pos"), F.col("e.dst").alias("id"))
        nodes = walked.select(*keys, "path", "at", F.col("src").alias("node"))
        rows = nodes.join(inside, [*keys, "node"], "left").select(*keys, "path", (F.col("at") + F.coalesce("dist", F.lit(0))).alias("pos"), F.coalesce("v", "node").alias("id"))
        out = stored(rows.unionByName(ends).join(numbers, "path").select(*keys, "path_id", "pos", "id"), "trails")
    drop_paths(edges.sparkSession, [p for p in held if p != out.stored_path])
    return out


def _ways(walks: DataFrame, k1: int) -> DataFrame:
    """into (a mer's number), orbit and code of the vertices that the walks id, orbit, seq come to, one way for each in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, orbits, seq in ((b.column("id"), b.column("orbit"), b.column("seq")) for b in batches):
            for i, j in kmers.in_parts(seq):
                mer, owner, at = kmers.mer_numbers(seq.slice(i, j - i), k1)
                mer, owner, at = mer[at > 0], owner[at > 0] + i, at[at > 0]
                orbit, code = np.asarray(orbits)[owner], np.asarray(ids)[owner] << PLACE | at
                order = np.lexsort((code, orbit, mer))
                mer, orbit, code = mer[order], orbit[order], code[order]
                first = np.flatnonzero(np.diff(mer, prepend=-1) | np.diff(orbit, prepend=-1))
                for k in range(0, len(first), lists.BATCH):
                    part = first[k : k + lists.BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (mer, orbit, code)], ["into", "orbit", "code"])

    return walks.select("id", "orbit", "seq").mapInArrow(run, "into long, orbit long, code long")


def euler_walks(reads: DataFrame, k1: int) -> DataFrame:
    """path_id, pos, seq: fewest trails of the graph of all reads that use every edge as often as it occurs, spelled, in pieces.

    A piece's seq has the bases from its first mer, the trail's vertex at pos, to its last, where the trail's next piece begins. Reads (of bases alone) are walks already that use each edge as
    often as it occurs, so these are paired where they end and begin, which makes closed walks of reads; where those meet, at any mer, they are merged along a spanning forest: reads are cut there, and go on
    in each other. Then links are taken out, as in `euler_trails`, whose trails are as few. What rounds go over is one row a read, and a row for each cut; windows pass once, to tell where closed walks meet, counted by blocks.
    A closed trail begins with the piece of least number. The result is stored.
    """
    if k1 > LONGEST:
        raise ValueError(f"mers of at most {LONGEST} bases have numbers")
    with recorded(reads.sparkSession) as held:
        walks = stored(kmers.in_pieces(reads, k1 + 1).select(F.monotonically_increasing_id().alias("copy"), F.col("piece").alias("seq")), "walks")
        mer = lambda f, c: f(F.col(c), F.lit(k1))
        ends = stored(walks.select(mer(F.left, "seq").alias("src"), mer(F.right, "seq").alias("dst"), "copy", (F.length("seq") - k1).cast("long").alias("n"), F.lit(False).alias("branch"), F.lit(False).alias("link")), "ends")
        units = _paired(ends.unionByName(_links(ends.withColumn("multiplicity", F.lit(1).cast("long")), [])), [])
        orbits = lists.orbits(units.select("id", F.col("next").alias("to"), F.col("id").alias("low")))
        units = stored(units.join(orbits, "id").select("id", "next", "orbit", "link", "n", "dst", "copy"), "cycles")
        # one way into each vertex for each cycle, dealt by vertex once
        spelled = units.filter("NOT link").select("id", "orbit", "copy").join(walks, "copy")
        ways = _ways(spelled, k1).unionByName(units.filter("link").select(mer_encode(F.col("dst")).alias("into"), "orbit", F.shiftleft("id", PLACE).alias("code")))
        ways = ways.repartition("into").groupBy("into", "orbit").agg(F.min("code").alias("code"))
        by = Window.partitionBy("into").orderBy("orbit")
        ways = ways.select("into", "code", F.first("orbit").over(by).alias("a"), F.first("code").over(by).alias("host"), F.col("orbit").alias("b")).filter("a <> b")
        # of the vertices where two cycles meet one
        meets = ways.groupBy("a", "b").agg(F.min(F.struct("into", "host", "code")).alias("m")).select(F.monotonically_increasing_id().alias("id"), "a", "b", "m.*")
        meets = stored(meets, "meets")
        chosen, roots = lists.forest(meets.select("id", "a", "b"))
        taken = stored(meets.join(chosen, "id"), "taken")
        ring = taken.select("into", F.col("b").alias("orbit"), "code").unionByName(taken.select("into", F.col("a").alias("orbit"), F.col("host").alias("code")).distinct())
        ring = ring.withColumns({"id": F.shiftright("code", PLACE), "end": F.col("code").bitwiseAND(F.lit((1 << PLACE) - 1))}).join(units.select("id", "next", "n"), "id")
        ring = stored(ring.select("id", "end", "n", "into", "orbit", "code", F.when(F.col("end") < F.col("n"), F.col("code")).otherwise(F.shiftleft("next", PLACE)).alias("next")), "ring")
        turned = _turned(ring.select(F.col("code").alias("id"), "into", "orbit", "next")).select(F.col("id").alias("code"), "_turned")
        # walks are cut where they go on in another
        begins = units.select("id", F.lit(0).cast("long").alias("begin")).unionByName(ring.filter("end < n").select("id", F.col("end").alias("begin")))
        cut = begins.withColumn("end", F.lead("begin").over(Window.partitionBy("id").orderBy("begin"))).join(units, "id").withColumn("end", F.coalesce("end", "n"))
        cut = cut.withColumns({"code": F.shiftleft("id", PLACE).bitwiseOR(F.col("end")), "piece": F.shiftleft("id", PLACE).bitwiseOR(F.col("begin"))})
        onward = F.coalesce("_turned", F.when(F.col("end") < F.col("n"), F.col("code")).otherwise(F.shiftleft("next", PLACE)))
        cut = stored(cut.join(turned, "code", "left").select(F.col("piece").alias("id"), onward.alias("next"), "link", (F.col("end") - F.col("begin")).alias("n"), "begin", "orbit", "copy"), "cut")
        known = cut.join(roots.withColumnRenamed("id", "orbit"), "orbit", "left").groupBy(F.coalesce("root", "orbit").alias("root")).agg(F.max("link").alias("link"), F.min("id").alias("id"))
        found = _places(cut.select("id", "next", "link", "n"), known.filter("NOT link").select("id"))
        numbers = lists.numbered(found.filter("id = first").select("first"), [F.col("first")], "path_id").select("first", F.col("path_id").cast("int").alias("path_id"))
        placed = cut.filter("NOT link").join(found, "id").join(numbers, "first").join(walks, "copy")
        out = stored(placed.select("path_id", F.col("at").alias("pos"), F.substring("seq", F.col("begin").cast("int") + 1, F.col("n").cast("int") + k1).alias("seq")), "trails")
    drop_paths(reads.sparkSession, [p for p in held if p != out.stored_path])
    return out
