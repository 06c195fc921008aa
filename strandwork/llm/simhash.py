"""SimHash near-duplicates, found by BK-trees over shards of the fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm import graph
from strandwork.llm.common import forget, fraction, release, slices, stored, texts_of, tidy

#: Nodes of one shard tree at most; a shard with more fingerprints gets several trees.
TREE_NODES = 8192
#: Rows of trees that are searched together, and (query, node) pairs that are looked at together.
FOREST_ROWS, FRONTIER = 1 << 16, 1 << 18
#: Ids that link to one id at most, but for twice as many where digests are uneven.
STAR = 1024


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, A-Z in lower case, repeats included; a shorter text is one run, no word gives none."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(text.encode().lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=False)] or [xxh64_intdigest(joined, 42)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is in more than half of the hashes; no hash gives 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(shingle_hashes(t, words)) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """BK-trees over runs of equal shard: a child hangs on its parent by their integer Hamming distance.

    All trees grow together, level by level: of the values that reach a node at the same distance, the first
    becomes its child by that edge and the others move on to it - the trees that insertion one by one gives.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray) -> None:
        n = len(values)
        self.values = values
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        self.root = np.repeat(first, np.diff([*first, n]))
        parent, edge = np.full(n, -1), np.full(n, -1)
        left = np.setdiff1d(np.arange(n), first, assume_unique=True)
        above = self.root[left]
        while len(left):
            key = above * 65 + np.bitwise_count(values[left] ^ values[above]).astype(np.int64)
            _, at, group = np.unique(key, return_index=True, return_inverse=True)
            parent[left[at]], edge[left[at]] = above[at], key[at] % 65
            stays = np.ones(len(left), bool)
            stays[at] = False
            above, left = left[at][group][stays], left[stays]
        order = np.lexsort((edge, parent))
        order = order[parent[order] >= 0]
        self.child, self.child_edge = order, edge[order]
        counts = np.bincount(parent[order], minlength=n) if len(order) else np.zeros(n, np.int64)
        self.n_children, self.first_child = counts, np.cumsum(counts) - counts

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node) of values within the radius, following only edges in distance - radius .. distance + radius."""
        who, node = np.arange(len(queries)), roots
        while len(who):
            far = np.bitwise_count(queries[who] ^ self.values[node]).astype(np.int64)
            hit = far <= radius
            yield who[hit], node[hit]
            n = self.n_children[node]
            at = np.repeat(self.first_child[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            who, far = np.repeat(who, n), np.repeat(far, n)
            near = np.abs(self.child_edge[at] - far) <= radius
            who, node = who[near], self.child[at[near]]


class Union:
    """Sets of numbers that merge; the least member names a set."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = up

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            a, b = np.maximum(a, b), np.minimum(a, b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, a, b)
            self.parent = self.parent[self.parent]


def _links(values: np.ndarray, shard: np.ndarray, role: np.ndarray, radius: int) -> np.ndarray:
    """The first row number of each row's set: what all links within the shards join.

    Rows come in order of shard, role and value. Roles: 0 both node and query, 1 node, 2 query. Rows of equal value are
    one node and one query.
    """
    n = len(values)
    sets = Union(n)
    new = np.concatenate([[True], (shard[1:] != shard[:-1]) | (role[1:] != role[:-1]) | (values[1:] != values[:-1])])
    firsts = np.flatnonzero(new)
    sets.merge(np.arange(n), firsts[np.cumsum(new) - 1])
    role_, shard_ = role[firsts], shard[firsts]
    number = firsts[role_ < 2]
    node_shard = shard[number]
    forest = Forest(values[number], node_shard)
    roots = np.flatnonzero(np.concatenate([[True], node_shard[1:] != node_shard[:-1]]))
    sizes = np.diff([*roots, len(node_shard)])
    asks = firsts[role_ != 1]
    at = np.searchsorted(node_shard[roots], shard[asks])
    held = (at < len(roots)) & (node_shard[roots[np.minimum(at, len(roots) - 1)]] == shard[asks])
    asks, at = asks[held], at[held]
    load = np.cumsum(sizes[at])
    cut = 0
    while cut < len(asks):
        end = max(cut + 1, int(np.searchsorted(load, (load[cut - 1] if cut else 0) + FRONTIER, side="right")))
        mine = asks[cut:end]
        for who, node in forest.search(values[mine], roots[at[cut:end]], radius):
            sets.merge(mine[who], number[node])
        cut = end
    return sets.roots(np.arange(n))


def stars(ids: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Pairs that join the ids of each set (a number below their count) to its least one, so that most shards name the same.

    A set of more than STAR ids is dealt out by the ids' digests: ids link to the least of their part, and these to the least of all.
    """
    parts = 1 << np.ceil(np.log2(np.maximum(np.bincount(sets, minlength=len(ids)) / STAR, 1))).astype(np.int64)[sets]
    part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts
    _, own = np.unique(np.stack([sets, part], 1), axis=0, return_inverse=True)
    near, least = (np.full(len(ids), np.iinfo(np.int64).max) for _ in range(2))
    np.minimum.at(near, own.ravel(), ids)
    np.minimum.at(least, sets, ids)
    near, least = near[own.ravel()], least[sets]
    pairs = np.unique(np.concatenate([np.stack([ids, near], 1), np.stack([near, least], 1)]), axis=0)
    return pairs[pairs[:, 0] != pairs[:, 1]]


def link_forest(prints: DataFrame, radius: int, bands: tuple[str, ...] = ("fp",), id_col: str = "fp", blocks: int | None = None) -> DataFrame:
    """a, b: links between ids that join them exactly as all pairs do whose values in some band lie within the radius.

    Two values within the radius agree on at least blocks - radius of their blocks of bits. So every choice
    of that many blocks deals the values out to shards by their bits there, and near pairs meet in some
    shard. Each shard's BK-trees go to the tasks that hold its queries, and to no others: what
    a task gets does not grow with the corpus, as it would if all trees went to all tasks. A shard of more
    than TREE_NODES rows is dealt out over several trees and its queries visit each of them.
    """
    n = prints.count()
    blocks = blocks or next((b for b in range(radius + 2, 65) if 64 * (b - radius) // b >= min(48, max(1, n).bit_length() - 5)), radius + 2)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    ways = [F.struct(F.lit(k * len(masks) + i).alias("way"), F.col(band).bitwiseAND(F.lit(m)).alias("bits"), F.col(band).alias("value")) for k, band in enumerate(bands) for i, m in enumerate(signed)]
    keyed = prints.select(F.col(id_col).alias("id"), F.explode(F.array(*ways)).alias("k")).select("id", "k.*")
    large = keyed.groupBy("way", "bits").count().filter(F.col("count") > TREE_NODES).select("way", "bits", F.ceil(F.col("count") / TREE_NODES).cast("int").alias("trees"))
    dealt = keyed.join(large, ["way", "bits"], "left").select("way", "bits", "value", "id", F.coalesce("trees", F.lit(1)).alias("trees"), F.pmod(F.xxhash64("value"), F.coalesce("trees", F.lit(1))).cast("int").alias("own"))
    rows = dealt.select("way", "bits", "value", "id", F.explode(F.when(F.col("trees") == 1, F.array(F.struct(F.lit(0).alias("tree"), F.lit(0).alias("role")))).otherwise(F.concat(F.array(F.struct(F.col("own").alias("tree"), F.lit(1).alias("role"))), F.expr("transform(sequence(0, trees - 1), t -> struct(t AS tree, 2 AS role))")))).alias("t"))
    rows = rows.select("way", "bits", "t.tree", "t.role", "value", "id").repartition("way", "bits", "tree").sortWithinPartitions("way", "bits", "tree", "role", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            new = np.concatenate([[True], (table[1:, :3] != table[:-1, :3]).any(1)])
            shard = np.cumsum(new)
            crowd = np.bincount(shard)[shard] > 1
            table, shard = table[crowd], shard[crowd]
            if len(table):
                ends = _links(np.ascontiguousarray(table[:, 4]).view(np.uint64), shard, table[:, 3], radius)
                pairs = stars(table[:, 5], ends)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[np.ndarray]:
    """Sorted rows of numbers in tables of about FOREST_ROWS; a run of equal first n_keys columns is never cut."""
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], 1))
            n += batch.num_rows
        if n >= FOREST_ROWS:
            table = np.concatenate(held)
            starts = np.flatnonzero((table[1:, :n_keys] != table[:-1, :n_keys]).any(1))
            if len(starts):
                cut = int(starts[-1]) + 1
                yield table[:cut]
                table = table[cut:].copy()
            held, n = [table], len(table)
    if n:
        yield np.concatenate(held)
    held.clear()
    tidy()


def near_groups(prints: DataFrame, radius: int = 4) -> DataFrame:
    """The rows (doc_id, fp, ...) with component_id: the least doc_id that links of at most `radius` differing bits reach.

    Equal fingerprints are one node, so copies cost nothing beyond their row. Null doc_ids belong to a component but
    do not name it; repeated rows stay; an empty table stays empty.
    """
    n = prints.count()
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes", n)
    linked = graph.components(link_forest(classes.select("fp"), radius), n)
    named = classes.join(linked, classes["fp"] == linked["id"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    member = stored(named.join(names, "component").select("fp", "component_id"), "members", n)
    return prints.join(member, "fp", "left")


#: The fewest shingles at which sets can be near but unequal.
LEAST_SHINGLES = 4
#: Bands of two least hashes by which near sets are joined first, and ids that are broadcast at most to pick rows out of a large table.
BANDS, BROADCAST_IDS = 8, 1 << 20
#: Rows of the sample that tells common shingles, how many of these are kept, and rows of one of them that meet in one task.
COMMON_SAMPLE, COMMON_KEPT, COMMON_BLOCK = 8_000, 100_000, 8_192


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits of SHA-256 of a row's id and whole text: equal for rows that agree in both."""
    return F.unhex(F.substring(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))), 256), 1, 32))


def common_shingles(docs: DataFrame, words: int, n: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the shingles that several rows of a sample hold, and in how many of the n rows they are likely to be."""
    share = min(1.0, COMMON_SAMPLE / max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [np.unique(shingle_hashes(t, words)) for t in texts_of(batch)]
            h, m = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(m)], ["h", "m"])

    sample = docs.filter(fraction(id_col, 5) < share).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = sample.mapInArrow(run, "h long, m long").groupBy("h").agg(F.sum("m").alias("m")).filter("m > 1").orderBy(F.desc("m"), "h").limit(COMMON_KEPT).collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    m = np.array([r["m"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], np.ceil(m[order] / share).astype(np.int64)


#: Odd numbers by which 64-bit hashes are dealt anew for each least hash.
_DEAL = (np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_digests(hashes: np.ndarray) -> np.ndarray:
    """For each band a digest of two least hashes of the set, none for an empty one."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_DEAL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 14):
        dealt = hashes[None, at : at + (1 << 14)] * _DEAL[:, None]
        np.minimum(least, (dealt ^ dealt >> np.uint64(29)).min(1), out=least)
    mixed = (least[0::2] * np.uint64(0xBF58476D1CE4E5B9)) ^ (least[1::2] * np.uint64(0x94D049BB133111EB))
    return (mixed + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def parity_bits(hashes: np.ndarray) -> bytes:
    """For each residue modulo a power of two about the count of hashes, 512 at least, whether an odd number of them fall on it."""
    size = 1 << max(9, len(hashes).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def parities_apart(x: bytes, y: bytes) -> int:
    """In how many residues two parities differ, the wider folded to the other's size: no more than the sets differ in members."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _spread(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many rows each of the hashes is likely to be; 0 for those that are not common."""
    if not len(common[0]):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
    return np.where(common[0][at] == hashes, common[1][at], 0)


def word_prints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, common: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))) -> DataFrame:
    """row (a number of its own), doc_id, key (see row_key), set, n, fp, shingles, rare, bands, odd and parity of every row.

    set is a digest of the set of shingles and n its size; fp the SimHash of the set of words; shingles holds the sorted 32-bit hashes
    of the runs of `words` words, rare the 64-bit ones of the rarest: as many as cannot all be missing from a set of the similarity,
    so that any two such sets share one; bands holds digests of pairs of least hashes (MinHash), one of which near sets nearly always
    share; odd is the share of the shingles that are not common; parity has for each of some n residues (a power of two, 512 at least) whether an odd number of the
    shingles' hashes fall on it. Null texts count as empty and have no shingle.
    """
    schema = "row long, doc_id long, key binary, set binary, n int, fp long, shingles binary, rare binary, bands array<long>, odd double, parity binary"
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.float64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest, xxh64_intdigest

        forget("sets")
        for batch in slices(batches, "text"):
            out = []
            for text in texts_of(batch):
                wide = np.unique(shingle_hashes(text, words))
                single = np.array([xxh64_intdigest(w, 42) for w in {*text.encode().lower().split()}], np.uint64)
                spread = _spread(wide, common)
                rare = wide[np.argsort(spread, kind="stable")[: len(wide) - math.ceil(similarity * len(wide) - 1e-9) + 1]]
                out.append((xxh3_128_digest(wide.tobytes()), len(wide), fingerprint(single), np.unique(wide.astype(np.uint32)).tobytes(), rare.tobytes(), band_digests(wide), float((spread == 0).mean()) if len(wide) else 0.0, parity_bits(wide)))
            out = [list(v) for v in zip(*out, strict=True)]
            out[2] = np.array(out[2], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.select(["row", "doc_id", "key"]).columns, *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], ["row", "doc_id", "key", "set", "n", "fp", "shingles", "rare", "bands", "odd", "parity"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def band_links(classes: DataFrame) -> DataFrame:
    """a, b: ids (with bands and odd) that share a band joined to its centre, the one with the fewest odd shingles, which the others are copies of if any is.

    Where more than STAR ids share a band, they join the centres of parts, and these the centre of all.
    """
    keyed = classes.select("id", F.struct("odd", "id").alias("centre"), F.explode("bands").alias("h"))
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.count("*") / STAR, F.lit(1.0))))).cast("long")
    crowd = keyed.groupBy("h").agg(F.min("centre").alias("least"), parts.alias("parts"), F.count("*").alias("m")).filter("m > 1").drop("m")
    met = keyed.join(crowd, "h").select("h", "id", "centre", "least", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).alias("part"))
    near = met.groupBy("h", "part").agg(F.min("centre").alias("near"))
    pairs = met.join(near, ["h", "part"]).select(F.explode(F.array(F.struct(F.col("id").alias("a"), F.col("near.id").alias("b")), F.struct(F.col("near.id").alias("a"), F.col("least.id").alias("b")))).alias("p"))
    return pairs.select("p.*").filter("a <> b").distinct()


def shared_rare(members: DataFrame, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """a, b: all pairs of ids of unequal component that share a rare shingle and may by size and place reach the similarity.

    members has id, component, n and rare. In the order of rarity the first shingle that two sets share leaves room for only
    so many more, which most pairs fail. A common shingle's rows are dealt out over blocks, each pair
    of blocks one unit of work; a unit of one component only gives nothing.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "rare"):
            out = []
            for key, component, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = np.frombuffer(raw, np.uint64)
                blocks = -(-_spread(hashes, common) // COMMON_BLOCK)
                place = np.repeat(np.arange(len(hashes)), np.maximum(blocks, 1))
                blocks = np.maximum(blocks, 1)
                other = np.arange(len(place)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                own = (key * 0x9E3779B97F4A7C15 >> 20) % (1 << 40) % blocks[place]
                unit = (np.minimum(own, other) << 20 | np.maximum(own, other)).astype(np.uint64)
                keys = hashes[place] ^ unit * np.uint64(0xBF58476D1CE4E5B9)
                out.append(np.stack([keys.view(np.int64), np.full(len(place), component), n << 32 | place, np.full(len(place), key)]))
            table = np.concatenate(out, 1)
            for at in range(0, table.shape[1], FOREST_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + FOREST_ROWS]) for c in table], ["key", "component", "place", "id"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            first = np.flatnonzero(np.concatenate([[True], table[1:, 0] != table[:-1, 0]]))
            sizes = np.diff([*first, len(table)])
            mixed = np.minimum.reduceat(table[:, 1], first) != np.maximum.reduceat(table[:, 1], first)
            table, end = table[np.repeat(mixed, sizes)], np.repeat(np.cumsum(sizes[mixed]), sizes[mixed])
            n, place = table[:, 2] >> 32, table[:, 2] & 0xFFFFFFFF
            live, step, found = np.arange(len(table)), 1, [np.zeros((0, 2), np.int64)]
            while len(live := live[live + step < end[live]]):
                x, y = live, live + step
                room = np.minimum(n[x] - place[x], n[y] - place[y])
                hit = (table[x, 1] != table[y, 1]) & (room >= similarity / (1 + similarity) * (n[x] + n[y]) - 1e-6)
                x, y = table[x[hit], 3], table[y[hit], 3]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                step += 1
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = members.select("id", "component", "n", "rare").mapInArrow(deal, "key long, component long, place long, id long")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(pair, "a long, b long").distinct()


def picked(rows: DataFrame, ids: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose key is among the ids (and the ids' other columns), n of them at most.

    They are picked out where they lie if the ids are few enough to broadcast, so that no other row is shuffled; more ids meet the rows by a shuffle.
    """
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key)


def similar_pairs(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs a, b of rows of prints whose sets have a Jaccard similarity that reaches the bound.

    A sketch of each set rules out most pairs that do not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            hit = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(hit))

    # sets whose parities differ in k places differ in k shingles at least: what that rules out needs no set
    n = pairs.count()
    asked = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sketch = stored(picked(prints.select("row", "n", "parity"), asked, "row", 2 * n), "sketch", 2 * n)
    both = pairs.join(sketch.toDF("a", "n", "x"), "a").join(sketch.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    bound = (1 - similarity) / (1 + similarity)

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            n, m, x, y = (c.to_pylist() for c in batch.columns[2:])
            yield batch.select(["a", "b"]).filter(pa.array([parities_apart(u, v) <= bound * (i + j) + 1e-6 for i, j, u, v in zip(n, m, x, y, strict=True)]))

    left = stored(both.mapInArrow(rule_out, "a long, b long"), "left", n)
    n = left.count()

    def held(name: str, value: str) -> DataFrame:
        return picked(prints.select("row", F.col("shingles").alias(value)), left.select(F.col(name).alias("row")).distinct(), "row", n).withColumnRenamed("row", name)

    return left.join(held("a", "x"), "a").join(held("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, group_id and stays for every row: the doc_id of its group's first row, and whether the row is that one.

    Rows whose sets of word shingles are equal are one class. Classes link if the Jaccard similarity of their sets
    reaches the bound, and a group is what links reach. Candidates come twice, and each is decided by the exact similarity. BK-trees over
    SimHashes of the sets of words find classes within the radius, bands of least hashes others that are alike; what these links
    join is one component. Of classes of unequal components all pairs that share one of their rarest shingles are then compared
    (see word_prints): no pair of the similarity is missed, whether words are put in, left out or exchanged.
    A set of fewer than LEAST_SHINGLES shingles is near to equal sets only.
    Null texts count as empty; all texts without a word are one class. The first row is that of the least doc_id (nulls come last), among
    equal ids of the least key; rows that agree in id and text have one key (see row_key) and all of them `stay`. An empty table stays empty.
    """
    n_docs = docs.count()
    common = common_shingles(docs, words, n_docs, id_col, text_col)
    prints = stored(word_prints(docs, words, id_col, text_col, similarity, common), "wordprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("first")
    classes = stored(prints.groupBy("set").agg(F.min("row").alias("id"), first, F.min("n").alias("n"), F.min("fp").alias("fp")), "classes", n_docs)
    large = classes.filter(F.col("n") >= LEAST_SHINGLES).select("id", "fp")
    n_classes = classes.count()
    own = prints.withColumnRenamed("row", "id")
    near = link_forest(large, radius, ("fp",), "id").unionByName(band_links(picked(own.select("id", "bands", "odd"), large.select("id"), "id", n_classes))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = stored(near, "near", n_docs)
    links = stored(similar_pairs(near, prints, similarity), "links", n_docs)
    release(near)
    component = large.select("id").join(graph.components(links, n_docs), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    members = picked(own.select("id", "n", "rare"), component, "id", n_classes)
    pairs = stored(shared_rare(members, similarity, common), "pairs", n_docs)
    groups = graph.components(links.unionByName(similar_pairs(pairs, prints, similarity)), n_docs)
    release(pairs)
    named = stored(classes.join(groups, "id", "left").select("set", "first", F.coalesce("component", "id").alias("group")), "groups", n_docs)
    firsts = named.groupBy("group").agg(F.min("first").alias("first"))
    return prints.select("doc_id", "key", "set").join(named.select("set", "group").join(firsts, "group"), "set").select("doc_id", "key", F.col("first.doc_id").alias("group_id"), (F.col("key") == F.col("first.key")).alias("stays"))
