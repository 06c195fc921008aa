"""Product codes of vectors: integer codebooks, nearest entries by screened matrix products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm.common import bounded_arrow, free_name, stored

#: Unit roundoff of float32 and of float64.
UNIT_32, UNIT_64 = 2.0**-24, 2.0**-53
#: Integers of the components stay below this: sums of 1024 squared differences then fit a long.
LARGEST = 1 << 25
#: Dimensions of one part at most, for the same reason.
WIDEST = 1024


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each row of x the index of the nearest entry by squared Euclidean distance, ties to the lower index; both are int64.

    Distances are screened as |e|^2 - 2 x.e (|x|^2 is the same for all entries), where x.e is a float32 matrix product. For any order of its
    d additions that product is off by at most g * sum|x_i e_i| with g = n u / (1 - n u), n = d + 2 (two for rounding x and e), and the
    sum is at most |x||e|. What the float64 steps round comes on top. So each entry has an interval that holds its true
    value. Entries whose interval reaches below the least upper end may be the best: where a row has several, they
    are evaluated in int64, and the least index of the least distance stands.
    """
    n, d = x.shape
    if d > WIDEST or max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) >= LARGEST:
        raise ValueError(f"parts have at most {WIDEST} components, each of them below {LARGEST} in size")
    squares = (entries * entries).sum(1)
    wide = squares.astype(np.float64)
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    about = wide - 2.0 * product
    rounds = (d + 2) * UNIT_32
    # norms of float64 sums, taken a little larger than they can be
    norms = np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))) * (1 + 2 * d * UNIT_64)
    reach = np.sqrt(wide) * (1 + 4 * UNIT_64)
    off = 2.0 * rounds / (1 - rounds) * norms[:, None] * reach[None, :]
    off = (off + 4 * UNIT_64 * (wide[None, :] + np.abs(about))) * (1 + 8 * UNIT_64)
    possible = about - off <= (about + off).min(1)[:, None]
    best = possible.argmax(1)
    several = np.flatnonzero(possible.sum(1) > 1)
    if len(several):
        row, entry = np.nonzero(possible[several])
        exact = np.full((len(several), len(entries)), np.iinfo(np.int64).max)
        exact[row, entry] = squared(x[several[row]], entries[entry])
        best[several] = exact.argmin(1)
    return best


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows, in int64."""
    return ((x - y) ** 2).sum(1)


def kept_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and holds neither nulls nor components that are not finite."""
    broken = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.col(vector_col).isNotNull() & ~F.coalesce(broken, F.lit(True)))


def integers(batch: pa.RecordBatch, column: str, width: int, scale: int) -> np.ndarray:
    """floor(scale * component) of a batch of kept vectors; vectors of another length are an error."""
    lists = batch.column(column)
    lengths = np.diff(np.asarray(lists.offsets))
    if (lengths != width).any():
        raise ValueError(f"vectors of {sorted(set(lengths[lengths != width].tolist()))} components among those of {width}")
    values = np.floor(scale * np.asarray(lists.flatten(), np.float64))
    if np.abs(values).max(initial=0) >= LARGEST:
        raise ValueError(f"components of {LARGEST / scale} or more do not fit the integers of the codes")
    return values.astype(np.int64).reshape(len(lengths), width)


def _first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """(part, entry, position) from the `entries` least ids; equal ids are put in order by their vectors, null ids come last."""
    found = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not found:
        return None
    width = len(found[0]["v"])
    if not width or width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    batch = pa.RecordBatch.from_arrays([pa.array([r["v"] for r in found], pa.list_(pa.float64()))], ["v"])
    return integers(batch, "v", width, scale).reshape(len(found), parts, width // parts).transpose(1, 0, 2).copy()


def fit_codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray | None:
    """int64 codebooks (part, entry, position) of all kept vectors; None without any.

    They start as the parts of the vectors of the least ids. In each round every task assigns the parts of its vectors and hands on one row of
    counts and sums for each entry; entries that are used become the floor of their mean. Fewer vectors than
    entries give fewer entries. The driver holds the codebooks only.
    """
    bounded_arrow(vectors.sparkSession)
    rows = kept_vectors(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    books = _first_codebooks(rows, parts, entries, scale)
    if books is None:
        return None
    width = books.shape[0] * books.shape[2]

    def sums(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = integers(batch, "v", width, scale).reshape(batch.num_rows, parts, -1)
                for p in range(parts):
                    code = nearest(x[:, p], books[p])
                    order = np.argsort(code, kind="stable")
                    used, first = np.unique(code[order], return_index=True)
                    n[p] += np.bincount(code, minlength=books.shape[1])
                    total[p, used] += np.add.reduceat(x[order, p], first)
            part, entry = np.nonzero(n)
            for p, e in zip(part.tolist(), entry.tolist(), strict=True):
                d = books.shape[2]
                yield pa.RecordBatch.from_arrays([pa.array([p] * d), pa.array([e] * d), pa.array(range(d)), pa.array([n[p, e]] * d), pa.array(total[p, e])], ["part", "entry", "position", "n", "total"])

        return run

    for _ in range(rounds):
        books = books.copy()
        found = rows.select("v").mapInArrow(sums(books), "part long, entry long, position long, n long, total long")
        for r in found.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return books


def encode(vectors: DataFrame, books: np.ndarray | None, scale: int = 4096, vector_col: str = "embedding", code_col: str = "code", error_col: str = "error") -> DataFrame:
    """The kept rows with code, two hex digits for each part (more where a codebook has over 256 entries), and error, the squared distances summed over parts.

    Columns of those names are replaced; repeated rows stay.
    """
    bounded_arrow(vectors.sparkSession)
    rows = kept_vectors(vectors, vector_col).drop(code_col, error_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(code_col, T.StringType()), T.StructField(error_col, T.LongType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if books is None or not batch.num_rows:
                continue
            parts, entries, d = books.shape
            x = integers(batch, vector_col, parts * d, scale).reshape(-1, parts, d)
            codes, error = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p] = nearest(x[:, p], books[p])
                error += squared(x[:, p], books[p][codes[:, p]])
            digits = max(2, len(f"{entries - 1:x}"))
            shown = np.array([f"{e:0{digits}x}" for e in range(entries)])[codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(["".join(c) for c in shown.tolist()]), pa.array(error)], names)

    return rows.mapInArrow(run, schema)


def decode(codes: DataFrame, books: np.ndarray, scale: int = 4096, code_col: str = "code", vector_col: str = "vector") -> DataFrame:
    """The rows with the vector that a code stands for: its entries, divided by scale; null codes give null."""
    digits = max(2, len(f"{books.shape[1] - 1:x}"))
    table = F.array(*(F.array(*(F.array(*(F.lit(c / scale) for c in entry)) for entry in book.tolist())) for book in books))
    place = lambda p: F.conv(F.substring(F.col(code_col), p * digits + 1, digits), 16, 10).cast("int")
    return codes.withColumn(vector_col, F.when(F.col(code_col).isNotNull(), F.flatten(F.array(*(table[p][place(p)] for p in range(len(books)))))))


def books_text(books: np.ndarray | None) -> str:
    """All components by part, entry and position, with commas between."""
    return "" if books is None else ",".join(map(str, books.ravel().tolist()))


def label_errors(coded: DataFrame, label_col: str = "label", error_col: str = "error", sum_col: str = "label_error") -> DataFrame:
    """The rows with the errors summed over equal labels, nulls together: summed before the shuffle and joined back."""
    name = free_name(coded.columns, "same_label")
    sums = coded.groupBy(F.col(label_col).alias(name)).agg(F.sum(error_col).alias(sum_col))
    return coded.drop(sum_col).join(sums, F.col(label_col).eqNullSafe(F.col(name))).drop(name)


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the kept rows of embeddings(vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label")
    books = fit_codebooks(rows, parts, entries, rounds, scale)
    coded = stored(encode(rows, books, scale).select("vec_id", "label", "code", "error"), "codes")
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
