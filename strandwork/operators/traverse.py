"""Traversals of one group's graph - components, trails, chains - and their runs over all groups.

The functions on dictionaries take the edges of one group as {(src, dst): multiplicity}; each group is one
task's work. Groups that do not fit a worker go by the joins of `contract.py`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandwork.operators import contract as joins
from strandwork.operators import kmers
from strandwork.shared import stored

Edges = dict[tuple, int]


def _summed(src: list, dst: list, multiplicity: list) -> Edges:
    out = dict(zip(zip(src, dst, strict=True), multiplicity, strict=True))
    if len(out) < len(src):
        out = dict.fromkeys(out, 0)
        for u, v, m in zip(src, dst, multiplicity, strict=True):
            out[u, v] += m
    return out


def edges_of(pdf: pd.DataFrame) -> Edges:
    return _summed(*(pdf[c].tolist() for c in ("src", "dst", "multiplicity")))


def neighbours(edges: Iterable[tuple]) -> tuple[dict, dict]:
    """Successors and predecessors of every vertex in order."""
    succ: dict = {}
    pred: dict = {}
    for u, v in sorted(edges):
        succ.setdefault(u, []).append(v)
        succ.setdefault(v, [])
        pred.setdefault(v, []).append(u)
        pred.setdefault(u, [])
    return succ, pred


def strong_components(edges: Edges) -> dict:
    """Vertex to the least vertex that it reaches and that reaches it (Tarjan 1972, without recursion)."""
    succ, _ = neighbours(edges)
    number: dict = {}
    low: dict = {}
    held: list = []
    inside: set = set()
    out: dict = {}
    for root in succ:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        held.append(root)
        inside.add(root)
        work = [(root, iter(succ[root]))]
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    members = []
                    while not members or members[-1] != v:
                        members.append(held.pop())
                    inside.difference_update(members)
                    out.update(dict.fromkeys(members, min(members)))
            elif w not in number:
                number[w] = low[w] = len(number)
                held.append(w)
                inside.add(w)
                work.append((w, iter(succ[w])))
            elif w in inside:
                low[v] = min(low[v], number[w])
    return out


def trails(edges: Edges, start: object = None, inside: dict | None = None) -> list[list]:
    """Fewest trails that use every edge as often as its multiplicity says.

    Where out- and in-degrees differ, each end that is one too often is linked to a start that is, both in order; the closed
    walk of every connected part (Hierholzer 1873, the least unused successor first) is then cut at those
    links. Without such ends a part's walk begins at `start` if it has it, else at its least vertex. Parts come in the order of their least
    vertices. Where chains are contracted, inside gives the least vertex that each node stands for, so that both are as they would be without.
    """
    left = dict(edges)
    balance: dict = {}
    for (u, v), m in edges.items():
        balance[u] = balance.get(u, 0) + m
        balance[v] = balance.get(v, 0) - m
    begins = [v for v in sorted(balance) for _ in range(balance[v])]
    ends = [v for v in sorted(balance) for _ in range(-balance[v])]
    succ, pred = neighbours(edges)
    links: dict = {}
    part: dict = {}
    for v in sorted(balance):
        if v not in part:
            todo = [v]
            part[v] = v
            while todo:
                x = todo.pop()
                for y in (*succ[x], *pred[x]):
                    if y not in part:
                        part[y] = v
                        todo.append(y)
    by_part: dict = {}
    for side, vertices in ((0, begins), (1, ends)):
        for v in vertices:
            by_part.setdefault(part[v], ([], []))[side].append(v)
    for b, e in by_part.values():
        for u, v in zip(e, b, strict=True):
            links.setdefault(u, []).append(v)
    low = lambda v: inside.get(v, v) if inside else v
    firsts: dict = {}
    for v in sorted(balance, key=low):
        firsts.setdefault(part[v], v)
    out = []
    for p, least in firsts.items():
        own = by_part.get(p, ([], []))[0]
        first = start if start is not None and part.get(start) == p and (not own or start in own) else own[0] if own else least
        # the stack holds (vertex, whether a link led to it); links are taken when no edge is left
        stack, walk, at = [(first, False)], [], dict.fromkeys(succ, 0)
        while stack:
            v, by_link = stack[-1]
            while at[v] < len(succ[v]) and not left[v, succ[v][at[v]]]:
                at[v] += 1
            if at[v] < len(succ[v]):
                w = succ[v][at[v]]
                left[v, w] -= 1
                stack.append((w, False))
            elif links.get(v):
                stack.append((links[v].pop(), True))
            else:
                walk.append(stack.pop())
        walk.reverse()
        # every vertex of the closed walk but the first, each with how it was entered
        body = walk[1:]
        cuts = [i for i, (_, by_link) in enumerate(body) if by_link]
        if cuts:
            pieces: list[list] = []
            for v, by_link in body[cuts[0] :] + body[: cuts[0]]:
                if by_link:
                    pieces.append([])
                pieces[-1].append(v)
            out += sorted((x for x in pieces if len(x) > 1), key=lambda x: (x[0] != first, x))
        elif len(walk) > 1:
            out.append([v for v, _ in walk])
    return out


def compat_trails(edges: Edges) -> list[list]:
    """Paths by the plain rule that knows no balance: from each vertex in order that has edges and was not found empty before, to the least unused successor.

    Where the way ends it goes on from the vertex before, as long as it comes back to that; what was not gone back over stays for
    later paths, so that graphs that are no closed walk give odd ones. Kept for comparison with results made so; use `trails`.
    """
    ahead: dict = {}
    for u, v in sorted(edges):
        ahead.setdefault(u, []).extend([v] * edges[u, v])
    looks = dict.fromkeys({v for e in edges for v in e}, 0)
    behind: list = []

    def farthest(v: object) -> object:
        """Where the way from v ends; each look past a vertex's last edge counts too."""
        while (looked := looks[v]) < len(ahead.get(v, ())):
            looks[v] += 1
            behind.append(v)
            v = ahead[v][looked]
        looks[v] += 1
        return v

    out = []
    for v in sorted(ahead):
        if looks[v] <= len(ahead[v]):
            path = [v]
            while farthest(path[-1]) == path[-1] and behind:
                path.append(behind.pop())
            out.append(path[::-1])
    return out


def chains_of(edges: Edges, must_match: bool = False) -> list[dict]:
    """Maximal runs of vertices without branches: head, vertices in order, tail (what follows, or None) and the least multiplicity.

    A vertex joins its only predecessor unless one of them branches or it is a sink; with must_match both edges
    of the joined vertex must occur equally often. A cycle of such vertices is cut before its least vertex.
    """
    succ, pred = neighbours(edges)
    plain = {v for v in succ if len(succ[v]) < 2 and len(pred[v]) < 2}
    follows = {}
    for v in plain:
        if succ[v] and pred[v] and pred[v][0] in plain and pred[v][0] != v and not (must_match and edges[pred[v][0], v] != edges[v, succ[v][0]]):
            follows[pred[v][0]] = v
    joined = set(follows.values())
    out, seen = [], set()
    for v in [x for x in sorted(plain) if x not in joined] + sorted(plain):
        if v in seen:
            continue
        run = [v]
        seen.add(v)
        while run[-1] in follows and follows[run[-1]] not in seen:
            run.append(follows[run[-1]])
            seen.add(run[-1])
        tail = succ[run[-1]][0] if succ[run[-1]] else None
        steps = [*zip(run, run[1:], strict=False), *([(run[-1], tail)] if tail is not None else [])]
        out.append({"head": v, "vertices": run, "tail": tail, "multiplicity": min((edges[s] for s in steps), default=None)})
    return out


#: The columns of contracted chains.
CHAIN = "head ID, tail ID, vertices array<ID>, multiplicity bigint, n_vertices int"


def chain_rows(edges: Edges, must_match: bool = False) -> list[tuple]:
    """chains_of as rows of CHAIN."""
    return [(c["head"], c["tail"], c["vertices"], c["multiplicity"], len(c["vertices"])) for c in chains_of(edges, must_match)]


#: Edges of a group that one worker takes at most; larger groups go by joins.
WORKER_EDGES = 2_000_000
#: Edges of a group that are settled in the pass that the joins begin with (`settled`); joins take what is left.
PIECE = 1 << 16


#: Rows of one batch of results, a group's more.
RESULTS = 20_000


def _groups(batches: Iterable[pa.RecordBatch], names: list[str], most: int | None = None) -> Iterator[tuple]:
    """Key and columns of each group of rows that come group by group, a group's first with _number 1, and whether the group is whole.

    Groups of more than `most` rows (bytes of reads, if they have a seq) come in parts of about as many, which are not whole: no more is held.
    """
    held: list[pa.RecordBatch] = []
    over = False
    # reads count by their bases
    size = lambda x: x.column("seq").nbytes if "seq" in names else x.num_rows

    def part() -> tuple:
        one = pa.Table.from_batches(held)
        return one.column("group_key").slice(0, 1), [one.column(c).to_pylist() for c in names], not over and (most is None or sum(map(size, held)) <= most)

    for batch in batches:
        number = np.asarray(batch.column("_number"))
        starts = np.flatnonzero(number == 1).tolist()
        before = starts[0] if starts else batch.num_rows
        if before:
            held.append(batch.slice(0, before))
        if held and (starts or most is not None and sum(map(size, held)) > most):
            yield part()
            held, over = [], not starts
        if not starts:
            continue
        over = False
        # groups that are whole are cut from lists of the batch
        keys, columns = batch.column("group_key"), [batch.column(c).to_pylist() for c in names]
        for i, j in zip(starts, starts[1:], strict=False):
            yield pa.chunked_array([keys.slice(i, 1)]), [c[i:j] for c in columns], most is None or size(batch.slice(i, j - i)) <= most
        held = [batch.slice(starts[-1])]
    if held:
        yield part()


def _marked(edges: DataFrame, read: list[str]) -> DataFrame:
    """The edges with _number, 1 for the first of each group: the window deals and sorts rows by group (not at all where they are dealt so already)."""
    return edges.select("group_key", *read, F.row_number().over(Window.partitionBy("group_key").orderBy("group_key")).alias("_number"))


def per_group(edges: DataFrame, schema: str, f: Callable[..., list[tuple]], count: Callable[[list], Edges] | None = None) -> DataFrame:
    """Rows of f for each group's edges, each group one task's work; without group_key all edges are one group.

    count makes a group's edges of its reads (group_key, seq), which are given in place of edges then: bases are shuffled and sorted, and no edge leaves its task.

    Edges with low and place (contract.reduced) give f besides what src stands for: {src: (low, place)}. A task takes its groups one behind
    the other from batches of rows sorted by group: most groups are small, and a call for each would cost more than its work.
    """
    grouped = "group_key" in edges.columns
    kind = "string" if count else edges.schema["src"].dataType.simpleString()
    own = T.StructType.fromDDL(schema.replace("ID", kind))
    whole = T.StructType([*([edges.schema["group_key"]] if grouped else []), *own.fields])
    names = whole.fieldNames()
    read = ["seq"] if count else ["src", "dst", "multiplicity", *(["low", "place"] if "low" in edges.columns else [])]

    def found(columns: list[list]) -> list[tuple]:
        if count:
            own_edges = count(columns[0])
            return f(own_edges) if own_edges else []
        src, _, _, *extra = columns
        return f(_summed(*columns[:3]), *([dict(zip(src, zip(*extra, strict=True), strict=True))] if extra else []))

    if not grouped:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(found([pdf[c].tolist() for c in read]), columns=names)

        return edges.groupBy().applyInPandas(run, whole)

    kinds = to_arrow_schema(own)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, rows = [], [], []

        def done() -> pa.RecordBatch:
            key = pa.concat_arrays([c for k in keys for c in k.chunks]).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            return pa.RecordBatch.from_arrays([key, *(pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), kinds, strict=True))], names)

        for key, columns, _ in _groups(batches, read):
            more = found(columns)
            if more:
                keys.append(key)
                sizes.append(len(more))
                rows += more
            if len(rows) >= RESULTS:
                yield done()
                keys, sizes, rows = [], [], []
        if rows:
            yield done()

    return _marked(edges, read).mapInArrow(stream, whole)


def settled(edges: DataFrame, schema: str, f: Callable[[Edges], list[tuple]], most: int | None = None, count: Callable[[list], Edges] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of f for each group of at most `most` (PIECE) edges, and the edges of all other groups, from one stored pass.

    count makes a group's edges of its reads, as in per_group; of groups of more than `most` bytes of bases the reads are left then.

    What algorithms by joins begin with: their rounds cost a table each, and most groups need none. A task holds the edges of one such
    group and a batch; larger groups pass in parts, as do those with null ends, which have no order.
    """
    most = PIECE if most is None else most
    read = ["seq"] if count else ["src", "dst", "multiplicity"]
    own = T.StructType.fromDDL(schema.replace("ID", "string" if count else edges.schema["src"].dataType.simpleString()))
    # both kinds of rows in one table
    fields = [T.StructField(f"found_{x.name}", x.dataType) for x in own.fields] + [T.StructField(f"left_{c}", edges.schema[c].dataType) for c in read]
    whole = T.StructType([edges.schema["group_key"], T.StructField("is_left", T.BooleanType()), *fields])
    kinds, n_own = to_arrow_schema(T.StructType(fields)), len(own.fields)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, rows = [], [], []

        def rows_of(key: pa.Array, columns: list, left: bool) -> pa.RecordBatch:
            mine = iter(columns)
            filled = [pa.array(next(mine), x.type) if (i >= n_own) == left else pa.nulls(len(key), x.type) for i, x in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([key, pa.array(np.full(len(key), left)), *filled], whole.fieldNames())

        def done() -> pa.RecordBatch:
            key = pa.concat_arrays([c for k in keys for c in k.chunks]).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            return rows_of(key, list(zip(*rows, strict=True)), False)

        for key, columns, is_whole in _groups(batches, read, most):
            if not is_whole or not count and (None in columns[0] or None in columns[1]):
                n = len(columns[0])
                yield rows_of(pa.concat_arrays(key.chunks).take(pa.array(np.zeros(n, np.int64))), columns, True)
                continue
            own_edges = count(columns[0]) if count else _summed(*columns)
            more = f(own_edges) if own_edges else []
            if more:
                keys.append(key)
                sizes.append(len(more))
                rows += more
            if len(rows) >= RESULTS:
                yield done()
                keys, sizes, rows = [], [], []
        if rows:
            yield done()

    both = stored(_marked(edges, read).mapInArrow(stream, whole), "settled")
    found = both.filter("NOT is_left").select("group_key", *(F.col(f"found_{x.name}").alias(x.name) for x in own.fields))
    return found, both.filter("is_left").select("group_key", *(F.col(f"left_{c}").alias(c) for c in read))


def by_size(edges: DataFrame, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame], largest: int | None = None, most: int | None = None) -> DataFrame:
    """small of the groups that fit a worker and large of the others.

    largest is a bound of a group's edges that the caller knows; without one the edges are stored and counted.
    """
    most = WORKER_EDGES if most is None else most
    if largest is not None and largest <= most:
        return small(edges)
    edges = stored(edges, "sized")
    if "group_key" not in edges.columns:
        return small(edges) if edges.count() <= most else large(edges)
    heavy = stored(edges.groupBy("group_key").count().filter(F.col("count") > most).select("group_key"), "heavy")
    if heavy.isEmpty():
        return small(edges)
    return small(edges.join(heavy, "group_key", "left_anti")).unionByName(large(edges.join(heavy, "group_key", "left_semi")))


def components(edges: DataFrame, largest: int | None = None, most: int | None = None) -> DataFrame:
    """(group_key), id, component: strong components named by their least vertex."""
    return by_size(edges, lambda e: per_group(e, "id ID, component ID", lambda x: sorted(strong_components(x).items())), joins.strong_components, largest, most)


def pieces(trail: list, inside: dict) -> list[tuple]:
    """pos, node, skip and take (null: all) of a trail over contracted chains: which of a node's vertices are on it at each step.

    The last node stands for its first vertex, as no edge of its chain is walked. A closed trail begins, and ends, at the place of the least vertex in its
    first node's chain.
    """
    turn = inside.get(trail[0], (None, 0))[1] if trail[0] == trail[-1] else 0
    return [(j, v, turn if j == 0 else 0, turn + 1 if j == len(trail) - 1 else None) for j, v in enumerate(trail)]


def euler_paths(edges: DataFrame, largest: int | None = None, most: int | None = None) -> DataFrame:
    """(group_key), path_id, pos, id: the trails of each group.

    Of a group that does not fit a worker the chains of equal multiplicities are contracted by joins; a worker walks
    the branches and heads that are left, and the vertices of the chains are put in by a join: the same trails. Where even that graph is too large for a
    worker, `circuits.euler_trails` finds trails without one (as few, but others).
    """
    schema = "path_id int, pos int, id ID"
    walk = lambda e: per_group(e, schema, lambda x: [(i, j, v) for i, t in enumerate(trails(x)) for j, v in enumerate(t)])

    def large(e: DataFrame) -> DataFrame:
        keys = ["group_key"] if "group_key" in e.columns else []
        chains = stored(joins.contract(e, must_match=True), "chains")
        nodes = per_group(joins.reduced(e, chains, lows=True), schema + ", skip int, take int", lambda x, inside: [(i, *row) for i, t in enumerate(trails(x, None, {v: k for v, (k, _) in inside.items()})) for row in pieces(t, inside)])
        found = nodes.join(chains.select(*keys, F.col("head").alias("id"), "vertices"), [*keys, "id"], "left")
        path = Window.partitionBy(*keys, "path_id").orderBy("pos")
        whole = F.coalesce("vertices", F.array("id"))
        found = found.withColumn("run", F.slice(whole, F.col("skip") + 1, F.coalesce("take", F.size(whole))))
        found = found.withColumn("at", F.sum(F.size("run")).over(path) - F.size("run"))
        return found.select(*keys, "path_id", "at", F.posexplode("run").alias("k", "id")).select(*keys, "path_id", (F.col("at") + F.col("k")).cast("int").alias("pos"), "id")

    return by_size(edges, walk, large, largest, most)


def euler_paths_of_reads(reads: DataFrame, k1: int, largest: int, most: int | None = None) -> DataFrame:
    """euler_paths of each group's reads: where groups fit a worker (largest, a bound of their edges, tells), their edges are counted in the task that walks them."""
    if largest > (WORKER_EDGES if most is None else most):
        return euler_paths(kmers.edges(reads, k1), largest, most)
    return per_group(reads, "path_id int, pos int, id ID", lambda x: [(i, j, v) for i, t in enumerate(trails(x)) for j, v in enumerate(t)], lambda seqs: kmers.group_edges(seqs, k1))


def walked_edges(reads: DataFrame, k1: int, largest: int, most: int | None = None) -> DataFrame:
    """(group_key), src, dst, multiplicity: the edges that the trails of euler_paths_of_reads take, as often as they do, counted in the task that walks a group that fits a worker."""
    if largest > (WORKER_EDGES if most is None else most):
        path = Window.partitionBy("group_key", "path_id").orderBy("pos")
        steps = euler_paths_of_reads(reads, k1, largest, most).select("group_key", F.col("id").alias("src"), F.lead("id").over(path).alias("dst")).filter("dst IS NOT NULL")
        return steps.groupBy("group_key", "src", "dst").agg(F.count("*").alias("multiplicity"))

    def steps_of(edges: Edges) -> list[tuple]:
        return [(*e, n) for e, n in Counter(e for t in trails(edges) for e in zip(t, t[1:], strict=False)).items()]

    return per_group(reads, "src ID, dst ID, multiplicity bigint", steps_of, lambda seqs: kmers.group_edges(seqs, k1))


def contract(edges: DataFrame, must_match: bool = False, largest: int | None = None, most: int | None = None) -> DataFrame:
    """(group_key), head, tail, vertices, multiplicity, n_vertices of each group's chains."""
    small = lambda e: per_group(e, CHAIN, lambda x: chain_rows(x, must_match))
    return by_size(edges, small, lambda e: joins.contract(e, must_match), largest, most)
