"""Repeats, assembly and its facades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.operators import build, contract, digraph, kmers, traverse
from strandwork.operators.traverse import Edges
from strandwork.shared import stored

#: Mer length of the plain facade.
DEFAULT_K1 = 3


def rectify(edges: Edges, coverage: int, source: object, branches: set | None = None) -> Edges:
    """Multiplicities of a graph in which no edge is walked more than twice.

    A walk leads from the source or a branch to the next branch or sink. It is walked twice if all its edges occur at least twice
    as often as an edge must, it starts at a branch, and both its ends reach each other; else once. Multiplicities
    only fall; edges that the source does not reach stay.
    """
    succ, pred = traverse.neighbours(edges)
    if branches is None:
        branches = {v for v in succ if len(succ[v]) > 1 or len(pred[v]) > 1}
    component = traverse.strong_components(edges)
    often = build.repeat_multiplicity(coverage)
    out, todo, seen = dict(edges), [source], {source}
    while todo:
        start = todo.pop()
        for w in succ.get(start, ()):
            walk, end = [(start, w)], w
            while end not in branches and succ[end] and end != start:
                walk.append((end, succ[end][0]))
                end = succ[end][0]
            twice = bool(succ[end]) and start in branches and component[start] == component[end] and all(edges[e] >= often for e in walk)
            for e in walk:
                out[e] = min(out[e], 2 if twice else 1)
            if end not in seen:
                seen.add(end)
                todo.append(end)
    return out


def spell_path(path: list[str]) -> str:
    return path[0] + "".join(v[-1] for v in path[1:])


def assemble_trails(edges: Edges, coverage: int | None = None, gate: bool = False, inside: dict | None = None) -> list[tuple[int, list | None, str]]:
    """contig_id, trail and status of one group's graph.

    Trails start at the source. status: ok for one trail, else multi_source, multi_sink or non_eulerian; with the gate a
    graph without exactly one source and one sink gives one row without a trail. inside as in traverse.trails.
    """
    if not edges:
        return [(0, None, "empty")]
    succ, pred = traverse.neighbours(edges)
    sources, sinks = [v for v in succ if succ[v] and not pred[v]], [v for v in succ if pred[v] and not succ[v]]
    status = "multi_source" if len(sources) > 1 else "multi_sink" if len(sinks) > 1 else None
    if gate and (len(sources) != 1 or len(sinks) != 1):
        return [(0, None, status or "no_end")]
    if coverage is not None and sources:
        edges = rectify(edges, coverage, min(sources))
    found = traverse.trails(edges, min(sources) if sources else None, inside)
    status = status or ("ok" if len(found) == 1 else "non_eulerian")
    return [(i, t, status) for i, t in enumerate(found)]


def assemble_group(edges: Edges, coverage: int | None = None, gate: bool = False) -> list[tuple[int, str | None, str]]:
    """contig_id, seq and status of one group's graph of mers: assemble_trails, spelled."""
    return [(i, spell_path(t) if t else None, status) for i, t, status in assemble_trails(edges, coverage, gate)]


def assemble_compat(edges: Edges) -> list[tuple[int, str, str]]:
    """contig_id, seq and status `compat`: the contigs of `traverse.compat_trails` with an edge from the largest sink to the largest source, if there are both, whose end every path loses.

    So tours start at their least mer, not at the source, and graphs that are no closed walk give odd contigs, empty ones among them.
    """
    succ, pred = traverse.neighbours(edges)
    sources, sinks = [v for v in succ if not pred[v]], [v for v in succ if not succ[v]]
    closing = (max(sinks), max(sources)) if sources and sinks else None
    paths = traverse.compat_trails({**edges, closing: edges.get(closing, 0) + 1} if closing else edges)
    cut = [t[:-1] if closing else t for t in paths]
    return [(i, spell_path(t) if t else "", "compat") for i, t in enumerate(cut)]


#: The columns of a contracted graph with the labels of its chains: a node's edge, if it has one, the least vertex that src stands for and its place, and a chain's label.
LABELLED = "src ID, dst ID, multiplicity bigint, low ID, place int, label string"


def _labelled_group(e: Edges) -> list[tuple]:
    """A group's contracted graph as rows of LABELLED: one for each chain, and one for each edge out of a branch."""
    chains = traverse.chains_of(e, must_match=True)
    inside = {v for c in chains for v in c["vertices"]}
    rows = [(u, v, m, u, 0, None) for (u, v), m in e.items() if u not in inside]
    for c in chains:
        last, low = (c["vertices"][-1], c["tail"]), min(c["vertices"])
        rows.append((c["head"], c["tail"], e.get(last), low, c["vertices"].index(low), spell_path(c["vertices"])))
    return rows


def _labelled(edges: DataFrame, k1: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The contracted graph of the edges (contract.reduced with lows) and the labels of its chains, by head. Groups of at most traverse.PIECE edges are contracted in one stored pass, from which labels come and no lists of vertices.

    With k1 reads are given in place of edges, which are counted in that pass.
    """
    keys = ["group_key"] if "group_key" in edges.columns else []

    def by_joins(own: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = stored(kmers.edges(own, k1, grouped=bool(keys)) if k1 else own, "edges")
        chains = stored(contract.spell_chains(contract.by_joins(own, must_match=True)), "chains")
        return contract.reduced(own, chains, lows=True), chains.select(*keys, "head", "label")

    if not keys:
        return by_joins(edges)
    found, left = traverse.settled(edges, LABELLED, _labelled_group, count=(lambda seqs: kmers.group_edges(seqs, k1)) if k1 else None)
    graph, labels = found.filter("dst IS NOT NULL").drop("label"), found.filter("label IS NOT NULL").select(*keys, F.col("src").alias("head"), "label")
    if left.isEmpty():
        return graph, labels
    more, more_labels = by_joins(left)
    return graph.unionByName(more), labels.unionByName(more_labels)


def assemble_large(edges: DataFrame, coverage: int | None = None, gate: bool = False, k1: int | None = None) -> DataFrame:
    """assemble_group for groups that do not fit a worker, on their contracted graphs.

    Chains of equal multiplicities are contracted, by joins but for small groups (_labelled); gate, repeats and trails see the branches and heads that are left (a
    contracted chain has one multiplicity and no branch, so that they decide alike); the labels of the chains are put in by a join. With k1
    reads are given in place of edges.
    """
    keys = ["group_key"] if "group_key" in edges.columns else []
    graph, labels = _labelled(edges, k1)

    def walk(e: Edges, inside: dict) -> list[tuple]:
        rows = []
        for number, path, status in assemble_trails(e, coverage, gate, {v: low for v, (low, _) in inside.items()}):
            rows += [(number, *row, status) for row in traverse.pieces(path, inside)] if path else [(number, 0, None, 0, None, status)]
        return rows

    found = traverse.per_group(graph, "contig_id int, pos int, id ID, skip int, take int, status string", walk)
    found = found.join(labels.withColumnRenamed("head", "id"), [*keys, "id"], "left")
    # what a node adds: the bases along its vertices on the trail, behind those that its first mer shares with the one before
    label = F.coalesce("label", "id")
    own = F.substring(label, F.col("skip") + 1, F.coalesce(F.col("take") - F.col("skip") - 1 + F.length("id"), F.length(label)))
    piece = F.when(F.col("pos") == 0, own).otherwise(F.substring(own, F.length("id"), F.length(own)))
    spelled = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda x: x["piece"]), "")
    return found.groupBy(*keys, "contig_id").agg(F.when(F.count("id") > 0, spelled).alias("seq"), F.min("status").alias("status"))


def assemble_reads(reads: DataFrame, k1: int, coverage: int | None = None, multi: bool = True, gate: bool | None = None, largest: int | None = None, most: int | None = None, compat: bool = False) -> DataFrame:
    """contigs(group_key, contig_id, seq, status) of each group's reads.

    Where all groups fit a worker (largest, a bound of a group's edges, tells), the edges of each are counted in the task that assembles it, and nothing but bases is shuffled (nor these, where the
    reads are dealt by group already). Else edges are counted and filtered by coverage over all groups at once; a group that fits is then assembled in one task, a larger one after its chains are contracted by joins (assemble_large). With coverage the graph must have one source and one sink and
    repeats are rectified. Groups without an edge give no contig. compat
    gives the contigs of the plain rule (assemble_compat) instead, each group in one task, whatever its size.
    """
    fits = largest is not None and largest <= (traverse.WORKER_EDGES if most is None else most)
    schema, gate = "contig_id int, seq string, status string", coverage is not None if gate is None else gate
    one = assemble_compat if compat else lambda x: assemble_group(x, coverage, gate)
    if fits and "group_key" in reads.columns:
        least = 1 if coverage is None else build.least_multiplicity(coverage)
        return traverse.per_group(reads, schema, one, lambda seqs: kmers.group_edges(seqs, k1, multi, least))
    edges = build.covered(kmers.edges(reads, k1, multi), coverage)
    if compat:
        return traverse.per_group(edges, schema, one)
    small = lambda e: traverse.per_group(e, schema, one)
    return traverse.by_size(edges, small, lambda e: assemble_large(e, coverage, gate).select("group_key", "contig_id", "seq", "status"), largest, most)


def assemble_slices(reads: DataFrame, compat: bool = False) -> DataFrame:
    """The plain facade: mers of three bases, every edge once; no group has more than 256 edges."""
    return assemble_reads(reads, DEFAULT_K1, multi=False, largest=4 ** (DEFAULT_K1 + 1), compat=compat)


def walks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The walks of `rectify`: (group_key), start, first, head, end, least, branch (whether it starts at one), open (whether something follows its end).

    first is the edge's other end where a walk starts at a branch, head the chain that it then goes along, if any; a source that is no branch is the
    head of its own walk. Besides, the members of the chains.
    """
    keys = ["group_key"] if "group_key" in edges.columns else []
    marks = stored(digraph.flags(edges).select(*keys, "id", "is_branch", "is_source", "n_out"), "flags")
    inside = stored(contract.members(edges), "members")
    chains = inside.groupBy(*keys, "head").agg(F.max_by("succ", "dist").alias("tail"), F.min("m_out").alias("chain_least"))
    branches = marks.filter("is_branch").select(*keys, F.col("id").alias("start"))
    out = edges.select(*keys, F.col("src").alias("start"), F.col("dst").alias("first"), "multiplicity").join(branches, [*keys, "start"], "left_semi")
    out = out.join(chains.withColumnRenamed("head", "first").withColumn("head", F.col("first")), [*keys, "first"], "left")
    out = out.select(*keys, "start", "first", "head", F.coalesce("tail", "first").alias("end"), F.least("multiplicity", "chain_least").alias("least"), F.lit(True).alias("branch"))
    own = chains.join(marks.filter("is_source AND NOT is_branch").select(*keys, F.col("id").alias("head")), [*keys, "head"], "left_semi")
    nothing = F.lit(None).cast(edges.schema["dst"].dataType)
    own = own.select(*keys, F.col("head").alias("start"), nothing.alias("first"), "head", F.col("tail").alias("end"), F.col("chain_least").alias("least"), F.lit(False).alias("branch"))
    ends = marks.select(*keys, F.col("id").alias("end"), (F.col("n_out") > 0).alias("open"))
    return stored(out.unionByName(own).join(ends, [*keys, "end"]), "walks"), inside


def _rectified_group(e: Edges, coverage: int) -> list[tuple]:
    """rectify from the least source, as rows; a group without a source stays."""
    succ, pred = traverse.neighbours(e)
    sources = [v for v in succ if succ[v] and not pred[v]]
    return [(u, v, m) for (u, v), m in (rectify(e, coverage, min(sources)) if sources else e).items()]


def rectified_by_joins(edges: DataFrame, coverage: int) -> DataFrame:
    """`rectified` as joins, for groups of any size and for one graph without groups.

    Groups of at most traverse.PIECE edges are settled in one pass. In the others walks are contracted chains between branches with their
    least multiplicity. Whether both ends reach each other is told by the strong components of the walks, whether the source reaches
    a walk by the steps between components, which have no cycles. Each walk then bounds its edges: that out of the branch by its ends,
    those of its chain by the chain's head.
    """
    if "group_key" in edges.columns:
        found, left = traverse.settled(edges, "src ID, dst ID, multiplicity bigint", lambda x: _rectified_group(x, coverage))
        return found if left.isEmpty() else found.unionByName(_rectified_large(left, coverage))
    return _rectified_large(edges, coverage)


def _rectified_large(edges: DataFrame, coverage: int) -> DataFrame:
    """rectified_by_joins without the pass over small groups."""
    keys = ["group_key"] if "group_key" in edges.columns else []
    edges = stored(edges, "edges")
    found, inside = walks(edges)
    sources = stored(digraph.flags(edges).filter("is_source").groupBy(*keys).agg(F.min("id").alias("id")).filter("id IS NOT NULL"), "sources")
    parts = stored(contract.strong_components(found.select(*keys, F.col("start").alias("src"), F.col("end").alias("dst"))), "parts")
    of = lambda c: parts.select(*keys, F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    found = stored(found.join(of("start"), [*keys, "start"]).join(of("end"), [*keys, "end"]), "walks")
    steps = found.filter("start_part <> end_part").select(*keys, F.col("start_part").alias("src"), F.col("end_part").alias("dst"))
    # a source is its own component
    near = contract.reached(steps, sources).select(*keys, F.col("id").alias("start_part"))
    twice = F.col("branch") & F.col("open") & (F.col("start_part") == F.col("end_part")) & (F.col("least") >= build.repeat_multiplicity(coverage))
    bound = stored(found.join(near, [*keys, "start_part"], "left_semi").withColumn("most", F.when(twice, 2).otherwise(1).cast("long")), "bounds")
    first = bound.filter("first IS NOT NULL").select(*keys, F.col("start").alias("src"), F.col("first").alias("dst"), "most")
    along = inside.filter("succ IS NOT NULL").select(*keys, "head", F.col("v").alias("src"), F.col("succ").alias("dst")).join(bound.filter("head IS NOT NULL").select(*keys, "head", "most"), [*keys, "head"]).select(*keys, "src", "dst", "most")
    return edges.join(first.unionByName(along), [*keys, "src", "dst"], "left").select(*keys, "src", "dst", F.least("multiplicity", "most").alias("multiplicity"))


def rectified(edges: DataFrame, coverage: int, largest: int | None = None, most: int | None = None) -> DataFrame:
    """(group_key), src, dst, multiplicity after `rectify` from each group's least source; groups without a source stay. Groups that do not fit a worker go by joins."""

    small = lambda e: traverse.per_group(e, "src ID, dst ID, multiplicity bigint", lambda x: _rectified_group(x, coverage))
    return traverse.by_size(edges, small, lambda e: rectified_by_joins(e, coverage), largest, most)


def unique_spelling(reads: DataFrame, k1: int) -> DataFrame:
    """Reads of more than k1 bases in which no mer occurs twice: they assemble to themselves. The mers of groups of at most traverse.PIECE bases are counted in the task that has them, those of others meet by a shuffle."""
    # edges between shorter mers are the mers
    counted, left = traverse.settled(reads, "n bigint, most bigint", lambda x: [(sum(x.values()), max(x.values()))], count=lambda seqs: kmers.group_edges(seqs, k1 - 1))
    if not left.isEmpty():
        more = kmers.counted(left, k1, ["group_key"]).groupBy("group_key", "kmer").agg(F.sum("n").alias("n")).groupBy("group_key").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        counted = counted.unionByName(more)
    return reads.join(counted.filter("most = 1 AND n > 1").select("group_key"), "group_key", "left_semi")
