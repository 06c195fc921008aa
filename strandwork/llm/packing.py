"""Best-fit-decreasing packing whose bin counts are certified by dual-feasible functions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm.common import SLICE_BYTES, forget, gathered, partitions, stored, tidy
from strandwork.llm.tokens import ENTRIES, encoder

#: Pieces that one task packs: some tens of MB, and about a second.
PIECES_EACH = 200_000


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, bytes_each: int = 4 * SLICE_BYTES, entries: int = ENTRIES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each text's ids with end_id, cut where longer than capacity.

    The first piece takes the remainder, all others are full. Null texts count as empty (one piece of
    one id); null ids and repeated rows pass through, each row with pieces of its own. Texts of some bytes_each are
    encoded together, and a worker keeps the ids of `entries` words: fewer take less memory and a little more time.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, entries)
        for batch in gathered(batches, "text", bytes_each):
            keys, out = batch.column("doc_id").to_pylist(), []
            flat, counts = encode.encode(batch.column("text"))
            ends = np.cumsum(counts)
            # every text's end id is put in at once
            flat = np.insert(flat.astype("<u4"), ends, end_id)
            ends = (ends + np.arange(1, len(ends) + 1)).tolist()
            for key, begin, end in zip(keys, [0, *ends], ends, strict=False):
                ids = flat[begin:end]
                first = len(ids) % capacity or capacity
                for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity), strict=True)):
                    out.append((key, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].tolist()] * with_ids)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=False)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(cut, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of each length, which must come in descending order.

    Bins of equal room wait in one list; a bit for each room that has bins gives the tightest fit at once.
    """
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n_full = int(np.searchsorted(-lengths, -capacity, side="right"))
    bins[:n_full], places[:n_full] = np.arange(n_full), 0
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, n_full
    for i, size in enumerate(lengths[n_full:].tolist(), n_full):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i], places[i] = b, capacity - room
        if left := room - size:
            waiting[left].append(b)
            rooms |= 1 << left
    return bins, places


@lru_cache(maxsize=2)
def dual_feasible(capacity: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Families of dual-feasible functions over the sizes 0 to capacity: (functions x sizes, unit of each function).

    A packed bin never holds more than one unit of such a function's values, so their sum over all
    sizes, in units and rounded up, bounds the bins from below. The families: sizes as they are, with small
    ones left out and large ones rounded up; sizes rounded to k-ths; sizes over a half by what fits beside them.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    e = np.arange(1, capacity // 2 + 1, dtype=np.int64)[:, None]
    plain = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
    plain = np.vstack([x, plain])
    k = np.arange(1, 33, dtype=np.int64)[:, None]
    kths = np.where((k + 1) * x % capacity == 0, k * x, capacity * ((k + 1) * x // capacity))
    most = capacity // e
    beside = np.where(2 * x > capacity, most - (capacity - x) // e, np.where(x >= e, 1, 0))
    return [(plain, np.full(len(plain), capacity)), (kths, (k * capacity).ravel()), (beside, most.ravel())]


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that the sizes need at least; histogram[s] counts the sizes s."""
    return max(int((-(-(f @ histogram) // unit)).max()) for f, unit in dual_feasible(capacity))


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", pieces_each: int = PIECES_EACH, max_rounds: int = 12) -> DataFrame:
    """The rows with sequence_id, offset, n_sequences, bound and certified: best-fit decreasing in partitions, repacked while the bound leaves a gap.

    Each task packs a share of the rows and bounds its bins by the dual-feasible functions. The bins of
    all shares are held against the bound of all rows (counts of each length, at most capacity + 1 of them).
    If the two meet, the packing is certified. Else shares without a certificate give up all their documents, certified ones
    those in bins with a fiftieth of room and in their loosest bin. These are dealt out anew to as few tasks as their number allows, and
    the better of the two packings stands. Once that no longer settles many of them, only the loose bins of all shares are exchanged, as long
    as that takes fewer bins. n_sequences, bound (the least number that any packing can have) and certified (they are equal) are the same in all rows.
    Lengths must lie in 1..capacity. Nulls and repeats in other columns pass through; an empty table gives none;
    columns of the rows that have the name of a new one are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset", "loose", "open", "n_sequences", "bound", "certified")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("loose", T.BooleanType()), T.StructField("open", T.BooleanType())])
    names = pieces.columns

    def share(tag: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forget("packing")
            rows = pd.concat([*frames], ignore_index=True)
            if not len(rows):
                return
            keys = [c for c in ("doc_id", "piece") if c in names]
            rows = rows.sort_values([length_col, *keys], ascending=[False] + [True] * len(keys), kind="stable", ignore_index=True)
            sizes = rows[length_col].to_numpy(np.int64)
            if sizes[0] > capacity or sizes[-1] < 1:
                raise ValueError(f"lengths must lie in 1 to {capacity}")
            bins, places = best_fit_decreasing(sizes, capacity)
            fill = np.bincount(bins, weights=sizes).astype(np.int64)
            certified = len(fill) == lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
            loose = fill < capacity - capacity // 50
            loose[np.argmin(fill)] |= fill.min() < capacity
            yield rows.assign(sequence_id=(tag << 48) + (TaskContext.get().partitionId() << 24) + bins, offset=places, loose=loose[bins], open=loose[bins] | (not certified))
            del rows, sizes, bins, places
            tidy()

        return run

    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy(F.col(length_col).alias("s")).count().collect():
        counts[row["s"]] = row["count"]
    n, bound = int(counts.sum()), lower_bound(counts, capacity)
    if not n:
        return pieces.withColumns({**{c: F.lit(0).cast("long") for c in ("sequence_id", "offset", "n_sequences", "bound")}, "certified": F.lit(True)})

    def bins_of(frame: DataFrame, given: str) -> tuple[int, int, int]:
        """Bins, and those that are given up with their rows."""
        bins = frame.groupBy("sequence_id").agg(F.max(given).alias("given"), F.count("*").alias("n"))
        found = {r["given"]: (r["b"], r["n"]) for r in bins.groupBy("given").agg(F.count("*").alias("b"), F.sum("n").alias("n")).collect()}
        return sum(b for b, _ in found.values()), *found.get(True, (0, 0))

    parts = partitions(n, pieces_each)
    now = stored(pieces.repartition(parts).mapInPandas(share(0), schema), "pack0")
    settled, fixed, given = [], 0, "open"
    used, before, n_left = bins_of(now, given)
    for tag in range(1, max_rounds):
        if parts == 1 or not before or fixed + used <= bound:
            break
        fewer = partitions(n_left, pieces_each)
        new = stored(now.filter(given).select(*names).repartition(fewer).mapInPandas(share(tag), schema), f"pack{tag}")
        again = bins_of(new, given)
        better = again[0] < before or given == "open" and again[0] == before
        if better:
            settled.append(now.filter(f"not {given}"))
            few = again[2] <= 0.9 * n_left
            fixed, parts, now, (used, before, n_left) = fixed + used - before, fewer, new, again
        if given == "open" and not (better and few):
            given = "loose"
            used, before, n_left = bins_of(now, given)
        elif not better:
            break
    out = now
    for more in settled:
        out = out.unionByName(more)
    total = fixed + used
    return out.select(*names, "sequence_id", "offset", F.lit(total).cast("long").alias("n_sequences"), F.lit(bound).cast("long").alias("bound"), F.lit(total == bound).alias("certified"))
