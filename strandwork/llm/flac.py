"""FLAC media columns: an encoder and a checking decoder that work on many frames at once.

All frames of a batch advance together, sample by sample (Rice codes, linear predictors) or as whole
arrays (checksums, fixed predictors), so that the cost for each sample is a few array operations.
Mono streams of 8-bit samples are written; the decoder takes any mono stream of 4 to 16 bits whose frames are
constant, verbatim, fixed or linear-predicted with Rice or escaped residuals.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import slices

#: Samples of a frame, and what the length of a stream must be a multiple of.
BLOCK, PARTITION = 1024, 64
#: Bytes of payload that are encoded or decoded together.
BATCH_BYTES = 1 << 19
RATE = 8000
#: Points of a SEEKTABLE, big-endian: first sample of a frame, its place behind the first frame's start, its samples; and how many a table takes.
POINT, MOST_POINTS = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]), 800_000
#: Order, precision and shift of the written linear predictors.
LPC_ORDER, LPC_BITS = 8, 10


def _crc_effect(bits: int, polynomial: int, reach: int) -> np.ndarray:
    """effect[d, b]: what byte b with d bytes behind it adds to a checksum, most significant bit first."""
    top, full = 1 << (bits - 1), (1 << bits) - 1
    row = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        row = np.where(row & top, (row << 1) ^ polynomial, row << 1) & full
    first, out = row.copy(), np.empty((reach, 256), np.uint16)
    for d in range(reach):
        out[d] = row
        row = ((row << 8) & full) ^ first[(row >> (bits - 8)) & 255]
    return out


_effects: dict[tuple[int, int], np.ndarray] = {}


def crc_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, polynomial: int) -> np.ndarray:
    """Checksums (initial value 0) of the byte ranges, which must not be empty."""
    sizes = ends - starts
    reach = 1 << max(4, int(sizes.max() - 1).bit_length())
    held = _effects.get((bits, polynomial))
    if held is None or len(held) < reach:
        held = _effects[bits, polynomial] = _crc_effect(bits, polynomial, reach)
    begins = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
    return np.bitwise_xor.reduceat(held[np.repeat(sizes, sizes) - 1 - at, data[np.repeat(starts, sizes) + at]], begins)


def crc8(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return crc_many(data, starts, ends, 8, 0x07)


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return crc_many(data, starts, ends, 16, 0x8005)


def _coded_number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 form of up to 7 bytes."""
    if n < 0x80:
        return bytes([n])
    for extra, lead in ((1, 0xC0), (2, 0xE0), (3, 0xF0), (4, 0xF8), (5, 0xFC), (6, 0xFE)):
        if n < 1 << (6 * extra + max(0, 6 - extra)):
            return bytes([lead | n >> 6 * extra, *(0x80 | n >> 6 * k & 63 for k in reversed(range(extra)))])
    raise ValueError("too many frames")


def _predictor(frames: np.ndarray) -> np.ndarray:
    """Quantised coefficients for each row: least squares over the row's own samples."""
    x = frames.astype(np.float64)
    lag = np.stack([(x[:, LPC_ORDER - k : x.shape[1] - k or None] * x[:, LPC_ORDER:]).sum(1) for k in range(LPC_ORDER + 1)], 1)
    toeplitz = lag[:, np.abs(np.subtract.outer(np.arange(LPC_ORDER), np.arange(LPC_ORDER)))] + np.eye(LPC_ORDER) * (1 + lag[:, :1, None] * 1e-6)
    solved = np.linalg.solve(toeplitz, lag[:, 1:, None])[:, :, 0]
    return np.clip(np.rint(solved * (1 << LPC_BITS - 2)), -(1 << LPC_BITS - 1), (1 << LPC_BITS - 1) - 1).astype(np.int32)


def _residuals(x: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Residuals of the rows under a fixed predictor of order 1 or a linear one; the warm-up samples come first."""
    if kind == "fixed":
        return np.diff(x, prepend=np.int32(0)), None
    coefficients = _predictor(x)
    guess = sum(coefficients[:, k : k + 1] * x[:, LPC_ORDER - 1 - k : x.shape[1] - 1 - k] for k in range(LPC_ORDER)) >> (LPC_BITS - 2)
    return np.concatenate([x[:, :LPC_ORDER], x[:, LPC_ORDER:] - guess], 1), coefficients


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for k in range(width):
        bits[at + k] = values >> (width - 1 - k) & 1


def _encode_rows(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """One frame for each row; all rows have the same number of samples, a multiple of PARTITION."""
    n, size = x.shape
    # parameters for each 256 samples where the size can be cut so, else for as many as it can
    order_of_partitions = max(0, int(size // PARTITION & -(size // PARTITION)).bit_length() - 3)
    n_parts = 1 << order_of_partitions
    options = []
    for kind, order in (("fixed", 1), ("linear", LPC_ORDER)):
        residual, coefficients = _residuals(x, kind)
        folded = residual << 1 ^ residual >> 31
        folded[:, :order] = 0
        cut = folded.reshape(n, n_parts, -1).copy()
        counts = np.full(n_parts, cut.shape[2])
        counts[0] -= order
        cost = np.zeros((10, n, n_parts), np.int64)
        for k in range(10):
            # residuals of 8-bit samples have at most 13 bits, so that a part's sum has no more than 32
            cost[k] = counts * (k + 1) + cut.sum(2, dtype=np.int32)
            cut >>= 1
        options.append((order, residual, coefficients, folded, cost.argmin(0), cost.min(0).sum(1) + (order * 8 + (9 + order * LPC_BITS) * (kind == "linear"))))
    linear = options[1][5] < options[0][5]
    out: list[bytes | None] = [None] * n
    for (order, residual, coefficients, folded, ks, _), rows in ((options[0], np.flatnonzero(~linear)), (options[1], np.flatnonzero(linear))):
        if not len(rows):
            continue
        heads = []
        for r in rows:
            head = bytes([0xFF, 0xF8, 0x70, 0x02]) + _coded_number(int(numbers[r])) + (size - 1).to_bytes(2, "big")
            heads.append(head)
        ends = np.cumsum([len(h) for h in heads])
        sums = crc8(np.frombuffer(b"".join(heads), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        heads = [h + bytes([int(c)]) for h, c in zip(heads, sums, strict=True)]
        sub = 8 + order * 8 + (9 + order * LPC_BITS) * (coefficients is not None)
        k_of = np.repeat(ks[rows], size // n_parts, axis=1)
        quotient = folded[rows] >> k_of
        width = quotient + 1 + k_of
        width[:, :order] = 0
        width[:, :: size // n_parts] += 4
        total = sub + 6 + width.sum(1)
        frame_bits = -(-total // 8) * 8
        base = np.cumsum(frame_bits) - frame_bits
        bits = np.zeros(int(frame_bits.sum()), np.uint8)
        _put(bits, base, np.full(len(rows), (0x08 | order if coefficients is None else 0x20 | order - 1) << 1), 8)
        for k in range(order):
            _put(bits, base + 8 + 8 * k, x[rows, k] & 255, 8)
        if coefficients is not None:
            at = base + 8 + 8 * order
            _put(bits, at, np.full(len(rows), (LPC_BITS - 1) << 5 | LPC_BITS - 2), 9)
            for k in range(order):
                _put(bits, at + 9 + LPC_BITS * k, coefficients[rows, k] & ((1 << LPC_BITS) - 1), LPC_BITS)
        _put(bits, base + sub, np.full(len(rows), order_of_partitions), 6)
        at = (base + sub + 6)[:, None] + np.cumsum(width, 1) - width
        _put(bits, at[:, :: size // n_parts].ravel(), ks[rows].ravel(), 4)
        at[:, :: size // n_parts] += 4
        code = np.ones((len(rows), size), bool)
        code[:, :order] = False
        stop = (at + quotient)[code]
        bits[stop] = 1
        low, k_flat = folded[rows][code], k_of[code]
        last = stop + k_flat
        for j in range(int(k_flat.max(initial=0))):
            if j >= k_flat.min():
                some = k_flat > j
                last, low, k_flat = last[some], low[some], k_flat[some]
            bits[last - j] = low >> j & 1
        packed, byte_base, byte_size = np.packbits(bits), base // 8, frame_bits // 8
        bodies = [h + packed[a : a + s].tobytes() for h, a, s in zip(heads, byte_base, byte_size, strict=True)]
        ends = np.cumsum([len(b) for b in bodies])
        sums = crc16(np.frombuffer(b"".join(bodies), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        for r, body, c in zip(rows, bodies, sums, strict=True):
            out[r] = body + int(c).to_bytes(2, "big")
    return out


def encode(payloads: list[bytes | memoryview], sizes: list[int] | None = None) -> list[bytes]:
    """A FLAC stream for each payload, whose bytes are two's-complement samples.

    sizes (else those of the payloads) must be positive multiples of 64: a shorter payload counts as filled up with zeros.
    The stream has STREAMINFO and a SEEKTABLE with a point for each frame, or for each few of them where a table can't hold more.
    Frames are made in groups of about BATCH_BYTES, so that a long payload takes little more than its stream.
    """
    sizes = [len(p) for p in payloads] if sizes is None else sizes
    frames: list[list[bytes]] = [[b""] * -(-n // BLOCK) for n in sizes]
    group: list[tuple[int, int]] = []

    def flush() -> None:
        by_size: dict[int, list[tuple[int, int]]] = {}
        for i, number in group:
            by_size.setdefault(min(BLOCK, sizes[i] - number * BLOCK), []).append((i, number))
        for size, members in by_size.items():
            x = np.zeros((len(members), size), np.int32)
            for row, (i, number) in zip(x, members, strict=True):
                held = np.frombuffer(payloads[i], np.int8)[number * BLOCK : number * BLOCK + size]
                row[: len(held)] = held
            for (i, number), frame in zip(members, _encode_rows(x, np.array([number for _, number in members])), strict=True):
                frames[i][number] = frame
        group.clear()

    for i, (p, n) in enumerate(zip(payloads, sizes, strict=True)):
        if not n or n % PARTITION or n < len(p):
            raise ValueError(f"payloads take positive multiples of {PARTITION} bytes")
        for number in range(len(frames[i])):
            group.append((i, number))
            if len(group) * BLOCK >= BATCH_BYTES:
                flush()
    flush()
    out = []
    for p, n, mine in zip(payloads, sizes, frames, strict=True):
        lengths = np.fromiter(map(len, mine), np.int64, len(mine))
        points = np.arange(0, len(mine), 1 + len(mine) // MOST_POINTS)
        table = np.zeros(len(points), POINT)
        table["sample"], table["offset"], table["samples"] = points * BLOCK, (np.cumsum(lengths) - lengths)[points], np.minimum(BLOCK, n - points * BLOCK)
        digest = hashlib.md5(p, usedforsecurity=False)
        digest.update(bytes(n - len(p)))
        info = BLOCK.to_bytes(2, "big") * 2 + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | n).to_bytes(8, "big") + digest.digest()
        out.append(b"".join([b"fLaC\x00", len(info).to_bytes(3, "big"), info, b"\x83", table.nbytes.to_bytes(3, "big"), table.tobytes(), *mine]))
        mine.clear()
    return out


class DamagedStream(ValueError):
    """A stream that breaks the format or fails one of its checksums."""


class _Bits:
    """Bits of the joined streams, readable at many places at once."""

    def __init__(self, data: bytes) -> None:
        padded = np.frombuffer(data + bytes(8), np.uint8)
        self.window = np.zeros(len(data) + 4, np.int64)
        for k in range(4):
            self.window |= padded[k : k + len(data) + 4].astype(np.int64) << (8 * (3 - k))

    def next_one(self, at: np.ndarray) -> np.ndarray:
        """Where the first set bit from there on is; the end if there is none."""
        stop, last = at.copy(), 8 * (len(self.window) - 4)
        left = slice(None)
        while True:
            here = stop[left]
            room = 32 - (here & 7)
            seen = self.window[here >> 3] & ((1 << room) - 1)
            # frexp gives the place of the highest bit; a window without one moves on by its size
            stop[left] = here + room - np.frexp(seen.astype(np.float64))[1]
            still = (seen == 0) & (stop[left] < last)
            if not still.any():
                return np.minimum(stop, last)
            left = np.flatnonzero(still) if isinstance(left, slice) else left[still]

    def get(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of up to 24 bits."""
        return self.window[at >> 3] >> (32 - (at & 7) - width) & ((1 << np.asarray(width, np.int64)) - 1)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        x = self.get(at, width)
        return x - ((x >> (np.maximum(width, 1) - 1) & 1) << width)


#: Samples of a frame by the code in its header; codes 6 and 7 give them in the bytes that follow.
_SIZES = {1: 192, **{k: 576 << k - 2 for k in range(2, 6)}, **{k: 256 << k - 8 for k in range(8, 16)}}
_WIDTHS = {1: 8, 2: 12, 4: 16}


def _search(data: bytes, begin: int) -> np.ndarray:
    """Where frames start from a place on: each ends where a header with the next number and a right CRC-8 begins, or with the stream.

    Sync codes inside a frame's body are told apart by the checksums; CRC-16 is verified for all frames afterwards.
    """
    starts, at, end = [], begin, len(data)
    number = None
    while at < end:
        head = _header(data, at, end)
        if head is None or number is not None and head[0] != number:
            raise DamagedStream(f"no frame at byte {at}")
        starts.append(at)
        number, at = head[0] + 1, at + head[4]
        while (at := data.find(b"\xff\xf8", at, end)) >= 0:
            after = _header(data, at, end)
            if after is not None and after[0] == number:
                break
            at += 1
        else:
            break
    return np.array(starts, np.int64)


def _headers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number, samples, bits of a sample, channel code and length of the header of each frame; raises where a CRC-8 is wrong.

    raw needs 16 bytes behind the last frame.
    """
    b2, b3, lead = raw[starts + 2].astype(np.int64), raw[starts + 3].astype(np.int64), raw[starts + 4].astype(np.int64)
    code, width = b2 >> 4, np.array([_WIDTHS.get(k, 0) for k in range(8)])[b3 >> 1 & 7]
    extra = _EXTRA[lead]
    number = np.where(extra == 0, lead, lead & (0x3F >> extra))
    for k in range(int(extra.max(initial=0))):
        number = np.where(extra > k, number << 6 | raw[starts + 5 + k] & 63, number)
    at = starts + 5 + extra
    size = np.array([_SIZES.get(k, 0) for k in range(16)])[code]
    one, two = raw[at].astype(np.int64), raw[at + 1].astype(np.int64)
    size = np.where(code == 6, one + 1, np.where(code == 7, (one << 8 | two) + 1, size))
    at = at + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.array([{12: 1, 13: 2, 14: 2}.get(k, 0) for k in range(16)])[b2 & 15]
    wrong = (raw[starts] != 0xFF) | (raw[starts + 1] != 0xF8) | (b3 & 1 > 0) | (size == 0) | (width == 0) | (at + 3 > ends) | (extra > 6)
    if wrong.any() or (crc8(raw, starts, at) != raw[at]).any():
        raise DamagedStream("a frame's header is damaged")
    return number, size, width, b3 >> 4, at + 1 - starts


#: Bytes behind the first one of a coded number.
_EXTRA = np.array([0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1 if lead >= 0xC0 else 7 for lead in range(256)])
_crc8_row: list[int] = [int(v) for v in _crc_effect(8, 0x07, 1)[0]]


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int, int, int] | None:
    """number, samples, bits of a sample, channel code and length of the header there, if its CRC-8 is right."""
    if end - at < 8 or data[at] != 0xFF or data[at + 1] != 0xF8 or data[at + 3] & 1:
        return None
    code, rate, width = data[at + 2] >> 4, data[at + 2] & 15, _WIDTHS.get(data[at + 3] >> 1 & 7)
    lead, k = data[at + 4], at + 5
    extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if lead < 0x80 else lead & (0x3F >> extra)
    for _ in range(extra):
        number, k = number << 6 | data[k] & 63, k + 1
    size = _SIZES.get(code)
    if code in (6, 7):
        size, k = int.from_bytes(data[k : k + code - 5], "big") + 1, k + code - 5
    k += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for b in data[at:k]:
        crc = _crc8_row[crc ^ b]
    if k >= end or size is None or width is None or crc != data[k]:
        return None
    return number, size, width, data[at + 3] >> 4, k + 1 - at


def layout(stream: bytes) -> tuple[bytes, np.ndarray, int]:
    """A stream's STREAMINFO, the points of its SEEKTABLE (none without one) and where its first frame starts."""
    if stream[:4] != b"fLaC" or len(stream) < 42:
        raise DamagedStream("no stream marker")
    at, last, info, table = 4, False, None, np.zeros(0, POINT)
    while not last:
        if at + 4 > len(stream):
            raise DamagedStream("the metadata are cut short")
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if at + 4 + size > len(stream):
            raise DamagedStream("the metadata are cut short")
        if kind == 0:
            info = bytes(stream[at + 4 : at + 4 + size])
        elif kind == 3:
            table = np.frombuffer(stream, POINT, size // POINT.itemsize, at + 4)
            # points of all ones only hold a place
            table = table[table["sample"] != np.uint64(2**64 - 1)]
        at += 4 + size
    if info is None or len(info) < 34:
        raise DamagedStream("no STREAMINFO")
    return info, table, at


def _starts(stream: bytes, info: bytes, table: np.ndarray, first: int) -> np.ndarray:
    """Where the frames start: by the SEEKTABLE if it names them all, else by search."""
    size, total = int.from_bytes(info[2:4], "big"), int.from_bytes(info[13:18], "big") & (1 << 36) - 1
    if size and len(table) and len(table) == -(-total // size):
        starts = table["offset"].astype(np.int64) + first
        if starts[0] == first and (np.diff(starts) > 0).all() and starts[-1] < len(stream):
            return starts
    return _search(bytes(stream), first)


def blocks(streams: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Groups of frames, decoded: numbers of stream and block, samples before the block, samples in it, and these.

    A group takes about BATCH_BYTES of the streams, however long they are. Raises DamagedStream where a CRC-8, CRC-16, count or MD5 is wrong.
    """
    infos, starts, ends, owner = [], [], [], []
    for i, s in enumerate(streams):
        info, table, first = layout(s)
        infos.append(info)
        mine = _starts(s, info, table, first) if first < len(s) else np.zeros(0, np.int64)
        starts.append(mine)
        ends.append(np.append(mine[1:], len(s))[: len(mine)])
        owner.append(np.full(len(mine), i))
    starts, ends, owner = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends, owner))
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    seen, digests = np.zeros(len(streams), np.int64), [hashlib.md5(usedforsecurity=False) for _ in streams]
    cuts = np.flatnonzero(np.diff(np.cumsum(ends - starts) // BATCH_BYTES, prepend=0))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(owner)], strict=True):
        if a == b:
            continue
        mine = owner[a:b]
        # the frames of a stream that are in the group lie side by side
        heads = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        tails = np.append(heads[1:], len(mine)) - 1
        data = b"".join(memoryview(streams[mine[h]])[starts[a + h] : ends[a + t]] for h, t in zip(heads, tails, strict=True))
        at = np.cumsum(ends[a:b] - starts[a:b]) - (ends[a:b] - starts[a:b])
        end = at + ends[a:b] - starts[a:b]
        raw = np.frombuffer(data + bytes(32), np.uint8)
        found, sizes, widths, channels, head = _headers(raw, at, end)
        if (found != number[a:b]).any():
            raise DamagedStream("a frame is not the next one")
        if channels.any():
            raise DamagedStream("more than one channel")
        if (end - at < head + 3).any() or (crc16(raw, at, end - 2) != (raw[end - 2].astype(np.uint16) << 8 | raw[end - 1])).any():
            raise DamagedStream("a frame's CRC-16 is wrong")
        grid = _frames(_Bits(data), (at + head) * 8, (end - 2) * 8, sizes, widths)
        samples = [row[:n] for row, n in zip(grid, sizes, strict=True)]
        before = np.cumsum(sizes) - sizes
        offsets = seen[mine] + before - before[heads][np.searchsorted(mine[heads], mine)]
        for h, t in zip(heads, tails, strict=True):
            i = mine[h]
            seen[i] += int(sizes[h : t + 1].sum())
            digests[i].update(np.concatenate(samples[h : t + 1]).astype(_kind(infos[i])).tobytes())
        yield mine, number[a:b], offsets, sizes, samples
    for i, info in enumerate(infos):
        if seen[i] != int.from_bytes(info[13:18], "big") & (1 << 36) - 1 or digests[i].digest() != info[18:34]:
            raise DamagedStream("the samples do not fit the stream's count or MD5")


def _kind(info: bytes) -> str:
    return "i1" if (int.from_bytes(info[12:14], "big") >> 4 & 31) < 8 else "<i2"


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream; raises DamagedStream where a CRC-8, CRC-16, count or MD5 is wrong."""
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for owner, _, _, _, samples in blocks(streams):
        for i, x in zip(owner, samples, strict=True):
            out[i].append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def read_at(stream: bytes, sample: int, count: int) -> np.ndarray:
    """The samples from `sample` on, `count` or as many as there are: only the frames behind the SEEKTABLE's last point before them are decoded."""
    info, table, first = layout(stream)
    total = int.from_bytes(info[13:18], "big") & (1 << 36) - 1
    stop = min(sample + count, total)
    if not 0 <= sample < stop:
        return np.zeros(0, np.int64)
    point = int(np.searchsorted(table["sample"].astype(np.int64), sample, side="right")) - 1
    behind = int(np.searchsorted(table["sample"].astype(np.int64), stop))
    begin = first + (int(table["offset"][point]) if point >= 0 else 0)
    until = first + int(table["offset"][behind]) if behind < len(table) else len(stream)
    offset = int(table["sample"][point]) if point >= 0 else 0
    data = bytes(stream[begin:until])
    starts = _search(data, 0)
    ends = np.append(starts[1:], len(data))
    raw = np.frombuffer(data + bytes(32), np.uint8)
    _, sizes, widths, channels, head = _headers(raw, starts, ends)
    if channels.any() or (crc16(raw, starts, ends - 2) != (raw[ends - 2].astype(np.uint16) << 8 | raw[ends - 1])).any():
        raise DamagedStream("a frame's CRC-16 is wrong")
    grid = _frames(_Bits(data), (starts + head) * 8, (ends - 2) * 8, sizes, widths)
    x = np.concatenate([row[:n] for row, n in zip(grid, sizes, strict=True)])
    return x[sample - offset : stop - offset]


def _frames(bits: _Bits, at: np.ndarray, end: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Samples of mono frames whose subframe begins at these bits."""
    n, most = len(at), int(sizes.max())
    x = np.zeros((n, most), np.int64)
    kind = bits.get(at + 1, 6)
    if (bits.get(at, 1) | bits.get(at + 7, 1)).any():
        raise DamagedStream("wasted bits or a set padding bit")
    at = at + 8
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if (~(fixed | linear | (kind < 2))).any():
        raise DamagedStream("a reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    for f in np.flatnonzero(kind == 0):
        x[f] = bits.signed(at[f : f + 1], widths[f])[0]
    for f in np.flatnonzero(kind == 1):
        x[f, : sizes[f]] = bits.signed(at[f] + widths[f] * np.arange(sizes[f]), widths[f])
    for k in range(int(order.max())):
        some = np.flatnonzero(order > k)
        x[some, k] = bits.signed(at[some], widths[some])
        at[some] += widths[some]
    coefficients, shift = np.zeros((n, int(order[linear].max(initial=1))), np.int64), np.zeros(n, np.int64)
    some = np.flatnonzero(linear)
    precision = bits.get(at[some], 4) + 1
    shift[some] = bits.signed(at[some] + 4, 5)
    at[some] += 9
    for k in range(coefficients.shape[1]):
        mine = order[some] > k
        coefficients[some[mine], k] = bits.signed(at[some[mine]], precision[mine])
        at[some[mine]] += precision[mine]
    coded = np.flatnonzero(fixed | linear)
    _rice(bits, x, coded, at, end, order, sizes)
    for f_order in range(1, 5):
        some = np.flatnonzero(fixed & (order == f_order))
        if len(some):
            x[some] = _integrate(x[some], f_order)
    for l_order in np.unique(order[linear]):
        some = np.flatnonzero(linear & (order == l_order))
        y, c, s = np.ascontiguousarray(x[some].T), np.ascontiguousarray(coefficients[some, :l_order].T[::-1]), shift[some]
        for i in range(l_order, int(sizes[some].max())):
            y[i] += (c * y[i - l_order : i]).sum(0) >> s
        x[some] = y.T
    return x


def _integrate(x: np.ndarray, order: int) -> np.ndarray:
    """Undoes `order` differences; the first `order` samples are given."""
    x = x.copy()
    levels = [x[:, :order].copy()]
    for _ in range(order - 1):
        levels.append(np.diff(levels[-1], axis=1))
    rest = x[:, order:]
    for level in reversed(levels):
        rest = level[:, -1:] + np.cumsum(rest, axis=1)
    x[:, order:] = rest
    return x


def _rice(bits: _Bits, x: np.ndarray, frames: np.ndarray, at: np.ndarray, end: np.ndarray, order: np.ndarray, sizes: np.ndarray) -> None:
    """Writes the residuals of the frames into x behind their warm-up samples."""
    if not len(frames):
        return
    frames = frames[np.argsort(-sizes[frames], kind="stable")]
    at, end, order, sizes = at[frames].copy(), end[frames], order[frames], sizes[frames]
    method = bits.get(at, 2)
    if (method > 1).any():
        raise DamagedStream("a reserved residual coding")
    length = sizes >> bits.get(at + 2, 4)
    at += 6
    k, raw, place = np.zeros(len(frames), np.int64), np.zeros(len(frames), bool), np.zeros(len(frames), np.int64)
    out = np.zeros((int(sizes[0]), len(frames)), np.int64)
    live, last, due = len(frames), 8 * (len(bits.window) - 4), 0
    for i in range(int(sizes[0])):
        while live and sizes[live - 1] <= i:
            live -= 1
        if i == due:
            opens = np.flatnonzero(place[:live] == i)
            width = 4 + method[opens]
            k[opens] = bits.get(at[opens], width)
            at[opens] += width
            raw[opens] = k[opens] == (1 << width) - 1
            escaped = opens[raw[opens]]
            k[escaped] = bits.get(at[escaped], 5)
            at[escaped] += 5
            place[opens] += np.maximum(length[opens], 1)
            due = int(place[:live].min())
        if i < 32 and (order[:live] > i).any():
            reads = np.flatnonzero(order[:live] <= i)
        else:
            reads = slice(0, live)
        a, w = at[reads], k[reads]
        stop = bits.next_one(np.minimum(a, last))
        folded = (stop - a) << w | bits.get(np.minimum(stop + 1, last), w)
        value = folded >> 1 ^ -(folded & 1)
        after = stop + 1 + w
        if raw[reads].any():
            plain = raw[reads]
            value = np.where(plain, bits.signed(np.minimum(a, last), w), value)
            after = np.where(plain, a + w, after)
        out[i, reads], at[reads] = value, after
    if (at > end).any() or (end - at >= 8).any():
        raise DamagedStream("a frame's residuals do not end with the frame")
    grid = out.T
    for f_order in np.unique(order):
        some = np.flatnonzero(order == f_order)
        x[frames[some], f_order : grid.shape[1]] = grid[some, f_order:]


def pcm_blocks(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Each stream's samples in blocks, one behind the other: the other columns, block, sample_offset, n_samples and pcm.

    sample_offset counts the samples before the block, so a reader seeks to sample s in the block whose
    offset is the largest up to s. pcm holds two's-complement samples, of a byte where the stream's have at most 8 bits, else of two. A
    null stream gives no block, a damaged one an error, repeated rows a set of blocks each; columns that have the name of a new
    one are replaced. A long stream is decoded frame group by frame group.
    """
    rest = [c for c in media.columns if c != media_col and c not in ("block", "sample_offset", "n_samples", "pcm")]
    fields = media.select(*rest).schema.add("block", "integer").add("sample_offset", "long").add("n_samples", "integer").add("pcm", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, media_col, BATCH_BYTES):
            streams = batch.column(media_col).to_pylist()
            some = np.array([i for i, s in enumerate(streams) if s is not None], np.int64)
            held = [s for s in streams if s is not None]
            kinds = [_kind(layout(s)[0]) for s in held]
            for owner, block, offset, size, samples in blocks(held):
                kept = batch.select(rest).take(pa.array(some[owner]))
                pcm = [x.astype(kinds[i]).tobytes() for i, x in zip(owner, samples, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(block, pa.int32()), pa.array(offset), pa.array(size, pa.int32()), pa.array(pcm, pa.binary())], fields.names)

    return media.select(*rest, media_col).mapInArrow(run, fields)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes, filled up with zeros to a multiple of 64, as a FLAC stream.

    Null texts count as empty, repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").cast(pa.large_binary())
            at, raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist(), memoryview(texts.buffers()[2] or b"")
            sizes = [b - a for a, b in zip(at, at[1:], strict=False)]
            media = encode([raw[a:b] for a, b in zip(at, at[1:], strict=False)], [max(PARTITION, -(-n // PARTITION) * PARTITION) for n in sizes])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def block_features(rows: DataFrame) -> DataFrame:
    """Digest and features of every stream from its PCM blocks of bytes, which must come one behind the other as pcm_blocks gives them.

    The other columns, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes) and feature: samples, the sum of their sizes,
    changes of sign, the largest sample and the blocks, as whole numbers. Only one block's state is held.
    """
    rest = [c for c in rows.columns if c not in ("block", "sample_offset", "n_samples", "pcm")]
    fields = rows.select(*rest).schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("feature", "string")):
        fields = fields.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, state = None, None
        for batch in batches:
            pcm, first = batch.column("pcm"), np.asarray(batch.column("block")) == 0
            at = np.frombuffer(pcm.buffers()[1], np.int32)[pcm.offset : pcm.offset + len(pcm) + 1]
            raw, offsets = memoryview(pcm.buffers()[2] or b""), np.asarray(batch.column("sample_offset"))
            heads = np.flatnonzero(first)
            done, out = [], []
            for a, b in zip([0, *heads.tolist()], [*heads.tolist(), len(pcm)], strict=True):
                if a == b:
                    continue
                if first[a]:
                    if state is not None:
                        done.append(kept)
                        out.append(state)
                    kept, state = batch.select(rest).slice(a, 1), [0, hashlib.sha256(), b"", 0, 0, 0, 0, 0]
                data = raw[at[a] : at[b]]
                x = np.frombuffer(data, np.int8).astype(np.int64)
                if offsets[a] != state[0]:
                    raise ValueError("a block is not the next one")
                below = np.concatenate([[state[7]], x < 0])
                state[0] += len(x)
                state[1].update(data)
                state[2] = (state[2] + bytes(data[-64:]))[-64:]
                size = np.abs(x)
                state[3] += int(size.sum())
                state[4] += int((below[1:] != below[:-1]).sum())
                state[5] = max(state[5], int(size.max()))
                state[6] += int(b - a)
                state[7] = int(x[-1] < 0)
            if done:
                yield finished(done, out)
        if state is not None:
            yield finished([kept], [state])

    def finished(done: list[pa.RecordBatch], out: list[list]) -> pa.RecordBatch:
        columns = pa.Table.from_batches(done).combine_chunks().columns
        new = [(n, sha.hexdigest(), zlib.crc32(tail), f"samples={n} energy={energy} crossings={turns} peak={peak} blocks={number}") for n, sha, tail, energy, turns, peak, number, _ in out]
        return pa.RecordBatch.from_arrays([*(c.chunk(0) for c in columns), *(pa.array(v, t) for v, t in zip(zip(*new, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True))], fields.names)

    return rows.mapInArrow(run, fields)


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows with media_bytes and media_sha256 of the stored stream and the digest and features of its decoded blocks; null streams give no row."""
    return block_features(pcm_blocks(media.withColumns({"media_bytes": F.octet_length(media_col).cast("long"), "media_sha256": F.sha2(media_col, 256)}), media_col))
