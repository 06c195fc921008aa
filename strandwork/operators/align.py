"""Contigs laid against a main sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.functions import distance

#: Share of the main sequence's length from which on a contig is aligned as a whole.
NEAR_FULL = 0.85
#: Offsets that are compared at once; letters from which on a contig is long, and how few of them may be different then.
BLOCK, LONG, FEW = 1 << 18, 128, 8


def by_length() -> list[Column]:
    """Order of contigs: longest first, equal lengths as they came."""
    return [F.length("contig").desc(), F.col("ordinal")]


def _letters(text: str) -> np.ndarray:
    """Code points, in upper case where that is one character."""
    if text.isascii():
        return np.frombuffer(text.upper().encode("ascii"), np.uint8)
    return np.frombuffer("".join(u if len(u := c.upper()) == 1 else c for c in text).encode("utf-32-le", "surrogatepass"), np.uint32)


def best_window(contig: np.ndarray, main: np.ndarray, block: int = BLOCK) -> tuple[int, int]:
    """Offset and distance of the leftmost window of main with the fewest places that differ from contig.

    Windows are compared in blocks of offsets, letter by letter of a short contig over all of them at once. For a long one of few different letters the
    places that agree are counted by convolutions, which cost the logarithm of its length instead (counts are small integers, so rounding is exact).
    """
    n, width = len(main) - len(contig) + 1, len(contig)
    symbols = np.unique(contig) if width > LONG else contig[:0]
    best = (width + 1, 0)
    for base in range(0, n, block):
        m = min(block, n - base)
        part = main[base : base + m + width - 1]
        if width > LONG and len(symbols) <= FEW:
            size = 1 << (len(part) + width).bit_length()
            agree = sum(np.fft.rfft(part == x, size) * np.fft.rfft((contig == x)[::-1], size) for x in symbols)
            differ = width - np.rint(np.fft.irfft(agree, size)[width - 1 : width - 1 + m]).astype(np.int64)
        else:
            differ = np.zeros(m, np.int32)
            for i, x in enumerate(contig):
                differ += part[i : i + m] != x
        at = int(differ.argmin())
        best = min(best, (int(differ[at]), base + at))
    return best[1], best[0]


@F.pandas_udf(T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("distance", T.IntegerType())]))
def _window(contig: pd.Series, main: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best_window(_letters(a), _letters(b)) for a, b in zip(contig, main, strict=True)], columns=["offset", "distance"])


def window_align(rows: DataFrame) -> DataFrame:
    """group_key, ordinal, contig, offset, distance: the leftmost offset (from 0) with the fewest differing bases, whatever their case.

    rows has group_key, ordinal, contig and main. Empty contigs and those longer than main have no window and are left out. A row is aligned where it
    lies: no row for an offset, no shuffle.
    """
    some = rows.filter((F.length("contig") > 0) & (F.length("contig") <= F.length("main")))
    return some.select("group_key", "ordinal", "contig", _window("contig", "main").alias("w")).select("group_key", "ordinal", "contig", "w.offset", "w.distance")


def layout(rows: DataFrame) -> DataFrame:
    """group_key, ordinal, contig, mode (window or pairwise), offset, distance, text of every contig that is not empty.

    A contig of at least NEAR_FULL of main's length is aligned as a whole (unit costs; the text is its alignment), the
    others are padded to their offset.
    """
    near = F.length("contig") >= NEAR_FULL * F.length("main")
    some = rows.filter(F.length("contig") > 0)
    window = window_align(some.filter(~near)).withColumns({"mode": F.lit("window"), "text": F.concat(F.expr("repeat(' ', offset)"), F.col("contig"))})
    # the alignment is found only where the text is read; distances alone take far less
    whole = some.filter(near).select("group_key", "ordinal", "contig", F.lit(None).cast("int").alias("offset"), distance.pairwise_cost("contig", "main").alias("distance"), F.lit("pairwise").alias("mode"), distance.pairwise("contig", "main")["alignment"].alias("text"))
    return window.unionByName(whole)


def render(rows: DataFrame) -> DataFrame:
    """group_key and text: the main sequence and below it each contig's text, longest first."""
    lines = layout(rows).groupBy("group_key").agg(F.sort_array(F.collect_list(F.struct((-F.length("contig")).alias("l"), "ordinal", "text"))).alias("x"))
    mains = rows.groupBy("group_key").agg(F.first("main").alias("main"))
    return mains.join(lines, "group_key", "left").select("group_key", F.concat_ws("\n", F.col("main"), F.transform("x", lambda s: s["text"])).alias("text"))
