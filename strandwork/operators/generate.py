"""Synthetic sequences and their reads, with explicit seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.operators.kmers import in_parts

# The linear congruential step that both this engine and plain SQL can compute in 64 bits.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2147483648


def lcg(x: Column) -> Column:
    """A number in 0..32767 from a non-negative integer."""
    return F.floor(F.pmod(F.pmod(x, F.lit(MODULUS)) * MULTIPLIER + INCREMENT, F.lit(MODULUS)) / 65536).cast("long")


def random_int(low: int, high: int, seed: int) -> Column:
    """Uniform in low..high, both included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")


def sequences(params: DataFrame) -> DataFrame:
    """The parameter rows (a_pct, c_pct, t_pct, g_pct, length, seed) with seq: exactly composed, uniformly permuted.

    A, C and T take their percentage of the length rounded down, G the rest. The percentages must add up to 100.
    """
    ok = F.assert_true((F.col("a_pct") + F.col("c_pct") + F.col("t_pct") + F.col("g_pct") == 100) & (F.least("a_pct", "c_pct", "t_pct", "g_pct") >= 0), F.lit("percentages must be 0 or more and add up to 100"))
    quota = lambda p: F.floor(F.col(p) * F.col("length") / 100).cast("int")
    letters = F.concat(F.array_repeat(F.lit("A"), quota("a_pct")), F.array_repeat(F.lit("C"), quota("c_pct")), F.array_repeat(F.lit("T"), quota("t_pct")), F.array_repeat(F.lit("G"), F.col("length").cast("int") - quota("a_pct") - quota("c_pct") - quota("t_pct")))
    keyed = F.transform(letters, lambda x, i: F.struct(F.xxhash64(F.col("seed"), i).alias("k"), i.alias("i"), x.alias("x")))
    return params.filter(ok.isNull()).withColumn("seq", F.array_join(F.transform(F.array_sort(keyed), lambda s: s["x"]), ""))


def split_reads(sequences_: DataFrame, low: int, high: int, copies: int, seed: int = 0, merge_tail: bool = True, progress: Observation | None = None) -> DataFrame:
    """reads(group_key, copy, read_id, start, seq): each copy of a sequence cut into pieces of low..high bases.

    Cuts are running sums of piece lengths; the last piece runs to the end from the first cut that leaves less than `low` bases (with
    merge_tail, so it may be longer), or that reaches the end (without, so it may be shorter). Empty sequences, and those without
    a key, give no reads. A sequence is cut where it lies: all its cuts at once, each piece from its own place.
    progress, an observation, is told by the job that reads them how many pieces and bases there are (pieces, bases), and how many pieces of each copy (copy_0, copy_1 ...).
    A stream of sequences takes no observation here but `observed_pieces`, whose counts its listeners get batch by batch.
    """
    if not 1 <= low <= high:
        raise ValueError("piece lengths take 1 <= low <= high")
    names = ["copy", "read_id", "start", "seq"]

    def cut_all(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        # the copies take many times a sequence's bytes
        for key, seq in batches:
            for a, b in in_parts(seq):
                yield cut(key.slice(a, b - a), seq.slice(a, b - a))

    def cut(key: pa.Array, seq: pa.Array) -> pa.Array:
        texts, parts, counts = seq.to_pylist(), [], []
        each = np.arange(copies, dtype=np.int64)[:, None]
        for k, n in zip(key.to_pylist(), map(len, texts), strict=True):
            j = np.arange(n // low + 1, dtype=np.int64)
            x = j + 1009 * each + 104729 * (k % 10007) + 7919 * seed
            ends = np.cumsum((x % MODULUS * MULTIPLIER + INCREMENT) % MODULUS // 65536 % (high - low + 1) + low, axis=1)
            # every copy has a stop: its last cut lies at n or behind it, or leaves less than low
            last = (ends > n - low if merge_tail else ends >= n).argmax(axis=1)
            copy, at = np.nonzero(j <= last[:, None])
            start = np.where(at > 0, ends[copy, at - 1], 0)
            parts.append((copy, at, start, np.where(at == last[copy], n, ends[copy, at])))
            counts.append(len(copy))
        copy, at, start, stop = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
        owner = np.repeat(np.arange(len(texts)), counts)
        pieces = [texts[i][a:b] for i, a, b in zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True)]
        columns = [pa.array(copy.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(start), pa.array(pieces, pa.string())]
        rows = pa.StructArray.from_arrays(columns, names=names)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), rows)

    kind = T.ArrayType(T.StructType([T.StructField("copy", T.IntegerType()), T.StructField("read_id", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("seq", T.StringType())]))
    whole = sequences_.filter((F.length("seq") > 0) & F.col("group_key").isNotNull())
    pieces = whole.select("group_key", F.arrow_udf(cut_all, kind)(F.col("group_key").cast("long"), "seq").alias("pieces"))
    # outer: the others filter by the size of the list first, for which it would be made twice
    out = pieces.select("group_key", F.inline_outer("pieces"))
    return out if progress is None else observed_pieces(out, progress, copies)


def observed_pieces(reads: DataFrame, progress: Observation | str, copies: int) -> DataFrame:
    """The reads, whose pieces and bases, and pieces of each copy, are counted as they pass: by an observation, or under a name that listeners of queries are told."""
    counts = [F.count("*").alias("pieces"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"), *(F.count_if(F.col("copy") == c).alias(f"copy_{c}") for c in range(copies))]
    return reads.observe(progress, *counts)


def one_sequence(spark: SparkSession, a: int, c: int, t: int, g: int, length: int, seed: int) -> DataFrame:
    return sequences(spark.createDataFrame([(a, c, t, g, length, seed)], "a_pct int, c_pct int, t_pct int, g_pct int, length int, seed long"))
