"""Codecs of bases: mer ids of two bits a base, packed bytes, overlap merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A, C, G, T are 0, 1, 2, 3, the first base in the highest bits.
BASES = "ACGT"
#: Bases that fit in a signed 64-bit id.
LONGEST = 31


def mer_encode(mer: Column) -> Column:
    """The id of a mer as BIGINT; case does not matter, '' is 0, other letters and more than 31 bases give null."""
    up = F.upper(mer)
    value = F.conv(F.translate(up, BASES, "0123"), 4, 10).cast("bigint")
    return F.when(up == "", F.lit(0).cast("bigint")).when(up.rlike(f"^[{BASES}]{{1,{LONGEST}}}$"), value)


def mer_decode(mer_id: Column, length: Column | int) -> Column:
    """The right-most `length` bases of an id; lengths outside 1..31 give null."""
    n = F.lit(length) if isinstance(length, int) else length
    digits = F.lpad(F.conv(mer_id.cast("string"), 10, 4), LONGEST, "0")
    return F.when((n >= 1) & (n <= LONGEST), F.translate(F.right(digits, n), "0123", BASES))


def merge_overlap(a: Column, b: Column, overlap: Column | int) -> Column:
    """a followed by b without its first `overlap` bases, which are not compared."""
    n = F.lit(overlap) if isinstance(overlap, int) else overlap
    return F.concat(a, F.substring(b, n + 1, F.length(b)))


def pack(seq: Column) -> Column:
    """BINARY: a byte with length mod 4, then four bases a byte; unused low bits of the last byte are 0."""
    padded = F.concat(seq, F.repeat(F.lit("A"), F.pmod(-F.length(seq), F.lit(4)).cast("int")))
    # a piece's lambda sees the piece alone: what it took from the whole string would be made anew for each
    pieces = F.transform(F.regexp_extract_all(padded, F.lit("(?s).{1,24}"), F.lit(0)), lambda x: F.lpad(F.conv(F.translate(x, BASES, "0123"), 4, 16), F.floor(F.length(x) / 2).cast("int"), F.lit("0")))
    return F.unhex(F.concat(F.lpad(F.hex(F.length(seq) % 4), 2, "0"), F.array_join(pieces, "")))


def unpack(packed: Column) -> Column:
    """The bases of `pack`'s bytes."""
    digits = F.substring(F.hex(packed), F.lit(3), F.octet_length(packed) * 2)
    pieces = F.transform(F.regexp_extract_all(digits, F.lit(".{1,12}"), F.lit(0)), lambda d: F.translate(F.lpad(F.conv(d, 16, 4), F.length(d) * 2, F.lit("0")), "0123", BASES))
    tail = F.conv(F.substring(F.hex(packed), 1, 2), 16, 10).cast("int")
    n = (F.octet_length(packed) - 1) * 4 - F.when(tail > 0, 4 - tail).otherwise(0)
    return F.substring(F.array_join(pieces, ""), F.lit(1), n.cast("int"))


def unpack_slice(packed: Column, start: int, length: int) -> Column:
    """`length` bases from place `start` (from 0) on, or as many as there are, read from their own bytes alone."""
    tail = F.conv(F.substring(F.hex(F.substring(packed, 1, 1)), 1, 2), 16, 10).cast("int")
    n = (F.octet_length(packed) - 1) * 4 - F.when(tail > 0, 4 - tail).otherwise(0)
    first, last = start // 4, (start + length + 3) // 4
    # a byte with the header of whole bytes goes before the cut ones
    own = F.concat(F.unhex(F.lit("00")), F.substring(packed, first + 2, last - first))
    return F.substring(unpack(own), F.lit(start % 4 + 1), F.least(F.lit(length), F.greatest(n - start, F.lit(0))).cast("int"))


def packed_equal(a: Column, b: Column) -> Column:
    """Equality of packed bytes, which is equality of the bases."""
    return a == b


def spell(path: Column, labels_overlap: int) -> Column:
    """One string along an array of labels: the first whole, the later ones without the bases they share."""
    return F.array_join(F.transform(path, lambda v, i: F.when(i == 0, v).otherwise(F.substring(v, F.lit(labels_overlap + 1), F.length(v)))), "")
