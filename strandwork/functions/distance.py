"""Distances of strings, and alignments."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hamming(a: Column, b: Column, strict: bool = False) -> Column:
    """Positions that differ, whatever the case; unequal lengths and nulls give null, or an error if strict."""
    differ = F.aggregate(F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    other = F.raise_error(F.lit("Hamming distance takes two strings of one length")).cast("int") if strict else F.lit(None).cast("int")
    return F.when(F.length(a) == F.length(b), differ).otherwise(other)


def levenshtein(a: Column, b: Column, strict: bool = False) -> Column:
    """Least insertions, deletions and substitutions, by case; nulls give null, or an error if strict."""
    if strict:
        return F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("Levenshtein distance takes two strings")).cast("int")).otherwise(F.levenshtein(a, b))
    return F.levenshtein(a, b)


def _rows(a: np.ndarray, b: np.ndarray, row: np.ndarray, mismatch: int, gap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Costs of the prefixes of b with each next letter of a, and the steps that lead there: 0 diagonal, 1 up, 2 left."""
    along = gap * np.arange(len(b) + 1)
    for x in a:
        diagonal = np.concatenate([[np.iinfo(np.int64).max // 2], row[:-1] + mismatch * (b != x)])
        up = row + gap
        # a run of steps to the left costs its length: the least cost so far, less what the places are apart
        new = np.minimum.accumulate(np.minimum(diagonal, up) - along) + along
        yield new, np.where(new == diagonal, 0, np.where(new == up, 1, 2)).astype(np.int8)
        row = new


def global_alignment(a: str, b: str, mismatch: int = 1, gap: int = 1) -> tuple[int, str]:
    """Cost and rendering in three lines of a cheapest global alignment; among equals diagonal, then up, then left.

    One row of costs in some sqrt(len(a)) is kept; the steps between two of them are found again on the way back, so memory grows with
    len(b) * sqrt(len(a)).
    """
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    n, m, block = len(a), len(b), max(1, math.isqrt(len(a)))
    row = gap * np.arange(m + 1)
    held = [row]
    for i, (row, _) in enumerate(_rows(x, y, row, mismatch, gap), 1):
        if i % block == 0:
            held.append(row)
    top, mid, low, i, j = [], [], [], n, m
    while i:
        first = (i - 1) // block * block
        steps = [s for _, s in _rows(x[first:i], y, held[first // block], mismatch, gap)]
        while i > first:
            step = steps[i - 1 - first][j] if j else 1
            i, j = i - (step < 2), j - (step != 1)
            top.append(a[i] if step < 2 else "-")
            low.append(b[j] if step != 1 else "-")
            mid.append(" " if step else "|" if a[i] == b[j] else ".")
    while j:
        j -= 1
        top.append("-")
        low.append(b[j])
        mid.append(" ")
    return int(row[m]), "\n".join("".join(reversed(z)) for z in (top, mid, low))


def edit_cost(a: str, b: str) -> int:
    """The cost of `global_alignment` with unit costs, without its steps.

    A string that is found in the other by leaving letters out differs by those. Else columns of costs are bits of whole numbers, 1 where a cost
    is one more or one less than that above it (Myers 1999, Hyyro 2003): one row costs len(a) / 64 steps, and only one is kept.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    rest = iter(long)
    if all(c in rest for c in short):
        return len(long) - len(short)
    top = 1 << (len(short) - 1)
    full = 2 * top - 1
    # a letter's places as bits, the first letter's the lowest
    places = {c: int("".join("1" if x == c else "0" for x in reversed(short)), 2) for c in set(short)}
    more, less, cost = full, 0, len(short)
    for c in long:
        here = places.get(c, 0)
        same = (((here & more) + more) ^ more) | here | less
        up = less | (full & ~(same | more))
        down = more & same
        cost += (up & top > 0) - (down & top > 0)
        up = up << 1 | 1
        more = (down << 1 | (~(same | up))) & full
        less = up & same & full
    return cost


@F.pandas_udf(T.IntegerType())
def pairwise_cost(a: pd.Series, b: pd.Series) -> pd.Series:
    """The cost of `pairwise` alone; nulls give null."""
    return pd.Series([None if x is None or y is None else edit_cost(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.StructType([T.StructField("cost", T.IntegerType()), T.StructField("alignment", T.StringType())]))
def pairwise(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Global alignment of two columns with unit costs; nulls give nulls."""
    rows = [(None, None) if x is None or y is None else global_alignment(x, y) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["cost", "alignment"])
