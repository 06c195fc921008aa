"""Reads to k-mers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.functions.codec import BASES, LONGEST, mer_encode

#: Bases that a task takes at once, and windows of one piece of a read.
BLOCK, PIECE = 1 << 20, 1 << 16


def normalise(texts: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """reads(group_key, read_id, seq): the bases of each text, upper case, other characters left out; one read a text."""
    seq = F.regexp_replace(F.upper(F.coalesce(F.col(text_col), F.lit(""))), "[^ACGT]+", "")
    # exploded, so that the optimizer does not put the search of a text into each place that reads its bases, filters and lambdas among them
    return texts.select(F.col(key_col).alias("group_key"), F.col(key_col).alias("read_id"), F.explode(F.array(seq)).alias("seq"))


def long_enough(reads: DataFrame, k1: int) -> DataFrame:
    """Reads of at least k1 bases; shorter ones have no mer."""
    return reads.filter(F.length("seq") >= k1)


def only_bases(reads: DataFrame, strict: bool = False) -> DataFrame:
    """Reads of A, C, G and T alone; others are left out, or are an error if strict."""
    fits = F.col("seq").rlike("^[ACGT]*$")
    if strict:
        return reads.withColumn("seq", F.when(fits, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not a sequence of bases: "), F.col("seq")))))
    return reads.filter(fits)


def in_pieces(reads: DataFrame, width: int, *cols: str) -> DataFrame:
    """cols, base (where it begins) and piece: the reads cut so that each window of `width` bases is in one piece, and no array holds a long read's."""
    cut = F.expr(f"transform(sequence(0, cast((length(seq) - {width}) div {PIECE} AS int)), c -> struct(c * {PIECE} AS base, substring(seq, c * {PIECE} + 1, {PIECE + width - 1}) AS piece))")
    return long_enough(reads, width).select(*cols, F.inline(cut))


def in_parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some BLOCK letters each, a longer read alone."""
    ends, start = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64), 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK, "right")) - 1)
        yield start, stop
        start = stop


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one behind the other, and where each begins and the last ends."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8), ends - ends[0]


def _places(ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Read and place in it of every window of `width` letters."""
    n = np.maximum(np.diff(ends) - width + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _strings(letters: np.ndarray) -> pa.Array:
    """Rows of bytes as strings."""
    n, width = letters.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(letters)))


def _listed(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Values as lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _in_blocks(f: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """f of some BLOCK letters at once: windows take many times a text's bytes, so that they leave a task in smaller batches than texts come."""

    def blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for seq in batches:
            for a, b in in_parts(seq):
                yield f(seq.slice(a, b - a))

    return blocks


def _windows(reads: DataFrame, width: int, *cols: str) -> DataFrame:
    """cols, pos (from 0) and mer of every window of `width` bases."""

    def block(seq: pa.Array) -> pa.Array:
        letters, ends = _letters(seq)
        n = np.maximum(np.diff(ends) - width + 1, 0)
        if not n.any() or letters.max() > 127:
            return pa.array([[x[i : i + width] for i in range(len(x) - width + 1)] for x in seq.to_pylist()], pa.list_(pa.string()))
        owner, at = _places(ends, width)
        return _listed(_strings(np.lib.stride_tricks.sliding_window_view(letters, width)[ends[owner] + at]), n)

    found = F.arrow_udf(_in_blocks(block), T.ArrayType(T.StringType()))
    pieces = in_pieces(reads, width, *cols).select(*cols, "base", found("piece").alias("mers"))
    return pieces.select(*cols, "base", F.posexplode_outer("mers").alias("at", "mer")).filter("mer IS NOT NULL").select(*cols, (F.col("base") + F.col("at")).alias("pos"), "mer")


def mer_numbers(seq: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of `width` bases of strings of bases as a number, two bits a base, with its string and its place there."""
    letters, ends = _letters(seq)
    digits = np.full(256, 4, np.int64)
    digits[list(BASES.encode())] = range(4)
    found = digits[letters]
    if len(found) and found.max() > 3:
        raise ValueError("not a sequence of bases")
    code = np.zeros(max(len(found) - width + 1, 0), np.int64)
    for i in range(width):
        code = code << 2 | found[i : len(code) + i]
    owner, at = _places(ends, width)
    return code[ends[owner] + at], owner, at


def counted(reads: DataFrame, width: int, keys: list[str], deal: bool = False) -> DataFrame:
    """keys, kmer and n: how often each window of `width` bases occurs in a piece of a read. deal: the counts of a piece go to its keys' task together."""
    kind = pa.struct([("kmer", pa.string()), ("n", pa.int64())])
    digits = np.full(256, 4, np.uint8)
    digits[list(BASES.encode())] = range(4)

    def block(seq: pa.Array) -> pa.Array:
        letters, ends = _letters(seq)
        found = digits[letters]
        if len(found) < width or found.max() > 3 or 2 * width + len(seq).bit_length() > 63:
            counts = [Counter(x[i : i + width] for i in range(len(x) - width + 1)) for x in seq.to_pylist()]
            return pa.array([[{"kmer": m, "n": n} for m, n in c.items()] for c in counts], pa.list_(kind))
        code = np.zeros(len(found) - width + 1, np.int64)
        for i in range(width):
            code = code << 2 | found[i : len(code) + i]
        # windows as numbers of two bits a base behind the number of their read
        owner, at = _places(ends, width)
        code = np.sort(code[ends[owner] + at] | owner << 2 * width)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        n, code = np.diff(first, append=len(code)), code[first]
        mer = np.empty((len(code), width), np.uint8)
        for i in range(width):
            mer[:, i] = code >> 2 * (width - 1 - i) & 3
        rows = pa.StructArray.from_arrays([_strings(np.frombuffer(BASES.encode(), np.uint8)[mer]), pa.array(n.astype(np.int64))], fields=list(kind))
        return _listed(rows, np.bincount(code >> 2 * width, minlength=len(seq)))

    counts = F.arrow_udf(_in_blocks(block), T.ArrayType(T.StructType([T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType())])))
    found = in_pieces(reads, width, *keys).select(*keys, counts("piece").alias("counts"))
    # outer: the others filter by the size of the list first, for which it would be made twice
    return (found.repartition(*keys) if deal and keys else found).select(*keys, F.inline_outer("counts")).filter("kmer IS NOT NULL")


def group_edges(seqs: list[str | None], k1: int, multi: bool = True, least: int = 1) -> dict[tuple[str, str], int]:
    """The edges of one group's reads as {(src, dst): multiplicity}, those that occur `least` times."""
    counts: Counter = Counter()
    for s in seqs:
        if s:
            counts.update(s[i : i + k1 + 1] for i in range(len(s) - k1))
    return {(m[:-1], m[1:]): n if multi else 1 for m, n in counts.items() if (n if multi else 1) >= least}


def mers(reads: DataFrame, length: int) -> DataFrame:
    """group_key, read_id, pos (from 0) and mer of every window of `length` bases."""
    return _windows(reads, length, "group_key", "read_id")


def occurrences(reads: DataFrame, k1: int, *carried: str) -> DataFrame:
    """group_key, kmer (k1 + 1 bases) and the carried columns of every edge occurrence, one row each: the only explosion of a plan."""
    return _windows(reads, k1 + 1, "group_key", *carried).select("group_key", F.col("mer").alias("kmer"), *carried)


def edges(reads: DataFrame, k1: int, multi: bool = True, grouped: bool = True, deal: bool = False, payload: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Edges (group_key), src, dst, multiplicity between the consecutive k1-mers of the reads.

    Occurrences are counted by k-mer, by blocks of reads before the one shuffle, and split into their ends afterwards. deal is for groups that fit a
    task: that shuffle is by group then, so that degrees, flags and graphs of groups need no further one (where no edge need leave its task, traverse.per_group and settled count them of the reads). Without multi every
    edge has multiplicity 1; without grouped all reads make one graph. payload names further columns of the reads and the aggregate (F.min,
    F.max, F.sum ...) that an edge's occurrences are merged by; contract.contract takes them on to chains, digraph.vertex_payload to vertices.
    """
    keys = ["group_key", "kmer"] if grouped else ["kmer"]
    if payload:
        merged = [f(F.col(c)).alias(c) for c, f in payload.items()]
        found = occurrences(reads, k1, *payload).groupBy(*keys).agg((F.count("*") if multi else F.lit(1).cast("long")).alias("multiplicity"), *merged)
    else:
        found = counted(reads, k1 + 1, keys[:-1], deal).groupBy(*keys).agg((F.sum("n") if multi else F.lit(1).cast("long")).alias("multiplicity"))
    return found.select(*keys[:-1], F.substring("kmer", 1, k1).alias("src"), F.substring("kmer", 2, k1).alias("dst"), "multiplicity", *(payload or {}))


def with_ids(edge_rows: DataFrame) -> DataFrame:
    """The edges with their ends as mer ids."""
    return edge_rows.withColumns({"src": mer_encode(F.col("src")), "dst": mer_encode(F.col("dst"))})


def isolated(reads: DataFrame, k1: int) -> DataFrame:
    """group_key and mer of the mers without any edge: reads of exactly k1 bases that no longer read of the group holds."""
    alone = reads.filter(F.length("seq") == k1).select("group_key", F.col("seq").alias("mer")).distinct()
    held = edges(reads, k1).select("group_key", F.explode(F.array("src", "dst")).alias("mer"))
    return alone.join(held, ["group_key", "mer"], "left_anti")
