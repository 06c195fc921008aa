"""What the operators share: shared storage, Arrow slices and checksums."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.shared import drop_paths, fresh_path, recorded, release, shared_dir, stored  # noqa: F401


#: Rows of one Arrow batch; with whole texts in it a batch stays at a few MB.
ARROW_ROWS = 512
#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; Arrow batches of the session are held to ARROW_ROWS."""
    bounded_arrow(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_arrow(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What make() gives, once for each Python worker; whatever the worker kept for another key before is dropped."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            tidy()
        _kept[key] = make()
    return _kept[key]


def forget(operator: str) -> None:
    """Drops what other operators have kept in this worker; for tasks that keep nothing themselves."""
    kept((operator,), dict)


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores before it as make it new (whatever the case) among the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fraction(column: str, seed: int) -> Column:
    """A number in 0..1 (1 left out) from a hash of the column: what samples are taken by, however small their share."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11) / float(1 << 53)


def partitions(n_rows: int, rows_each: int) -> int:
    return max(1, -(-n_rows // rows_each))


def tidy() -> None:
    """Gives memory that a worker has freed back to the system, as idle workers are kept."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        # another C library than glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batches whose texts make up about `most` bytes; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        at, room = 0, most
        for i, size in enumerate(sizes):
            if size > room and i > at:
                yield batch.slice(at, i - at)
                at, room = i, most
            room -= size
        yield batch.slice(at)
    tidy()


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """slices, and small consecutive ones put together up to about `most` bytes."""
    held, room = [], most
    for part in slices(batches, column, most):
        size = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
        if held and size > room:
            yield pa.concat_batches(held)
            held, room = [], most
        held.append(part)
        room -= size
    if held:
        yield pa.concat_batches(held)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


#: Reversed polynomial of CRC-32C.
CASTAGNOLI = 0x82F63B78
_BLOCK = 256
_tables: tuple[np.ndarray, np.ndarray] | None = None


def _crc32c_tables() -> tuple[np.ndarray, np.ndarray]:
    """Effect of byte b with d bytes behind it, and of the initial state after d bytes."""
    global _tables
    if _tables is None:
        row = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            row = np.where(row & 1, (row >> 1) ^ np.uint32(CASTAGNOLI), row >> 1)
        first, effect, start = row.copy(), np.empty((_BLOCK, 256), np.uint32), np.empty(_BLOCK + 1, np.uint32)
        state = 0xFFFFFFFF
        for d in range(_BLOCK):
            effect[d], start[d] = row, state
            row = (row >> 8) ^ first[row & 255]
            state = (state >> 8) ^ int(first[state & 255])
        start[_BLOCK] = state
        _tables = effect, start
    return _tables


def crc32c_many(records: list[bytes], block: int = _BLOCK) -> np.ndarray:
    """CRC-32C of each record.

    A CRC is linear: that of a block is the exclusive or of one table entry for each byte, and zeros in front add
    nothing. So records are filled up in front to whole blocks, all blocks advance byte by byte together,
    and each record's blocks are then chained.
    """
    effect, start = _crc32c_tables()
    lengths = np.fromiter(map(len, records), np.int64, len(records))
    out = np.zeros(len(lengths), np.uint32)
    some = lengths > 0
    if not some.any():
        return out
    fill = bytes(block)
    rows = np.frombuffer(b"".join(x for r in records for x in (fill[: -len(r) % block], r)), np.uint8).reshape(-1, block).T.copy()
    blocks = np.zeros(rows.shape[1], np.uint32)
    for i in range(block):
        blocks ^= effect[block - 1 - i].take(rows[i])
    n_blocks = -(-lengths // block)
    firsts = (np.cumsum(n_blocks) - n_blocks)[some]
    state = start[(lengths - (n_blocks - 1) * block)[some]] ^ blocks[firsts]
    left, at = n_blocks[some] - 1, firsts + 1
    live = np.flatnonzero(left > 0)
    far = [effect[block - 1 - i] for i in range(4)]
    while len(live):
        s = state[live]
        state[live] = far[0][s & 255] ^ far[1][(s >> 8) & 255] ^ far[2][(s >> 16) & 255] ^ far[3][s >> 24] ^ blocks[at[live]]
        left[live] -= 1
        at[live] += 1
        live = live[left[live] > 0]
    out[some] = ~state
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """The rotated and shifted form, so that data which hold checksums can be checksummed again."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
