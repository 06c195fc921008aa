"""Importance resampling towards a target distribution of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm.common import gathered, stored

#: Bytes of text whose features a Python worker counts at once.
COUNT_BYTES = 2 << 20
#: Features whose gains go to all tasks: the most frequent ones. All others meet their gains in a join, so this changes the plan, not the rows.
FREQUENT = 1 << 16

# bytes of words: digits, letters and all bytes beyond ASCII, A to Z in lower case; 0 ends a word
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, A-Z lower-cased, and the number of the text that each is of; null texts have none.

    A word is a run of digits, letters a to z and characters beyond ASCII.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = _FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    inside = raw > 0
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    # a text's first byte begins a word whatever the text before ends with
    edges = np.unique(offsets[:-1] - offsets[0])
    edges = edges[edges < len(raw)]
    begins = inside & ~before
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    letters = raw[inside]
    # each word's first letter among the letters
    places = np.append(np.cumsum(inside)[starts] - 1, len(letters)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(letters))
    return found, np.searchsorted(offsets[1:] - offsets[0], starts, side="right")


def features(texts: pa.Array, longest: int) -> tuple[pa.Array, np.ndarray]:
    """All runs of 1 to `longest` consecutive words of each text, joined by a blank, with the number of their text."""
    single, owner = words(texts)
    all_of, owners, run = [single], [owner], single
    for n in range(2, longest + 1):
        if len(single) < n:
            break
        run = pc.binary_join_element_wise(run[:-1], single[n - 1 :], pa.scalar(" ", pa.large_string()))
        same = owner[: len(single) - n + 1] == owner[n - 1 :]
        all_of.append(run.filter(pa.array(same)))
        owners.append(owner[: len(single) - n + 1][same])
    return pa.concat_arrays(all_of), np.concatenate(owners)


def dictionary(texts: DataFrame, longest: int, buckets: int, text_col: str = "text") -> DataFrame:
    """feature, n and bucket: every distinct feature of all texts with how often it occurs, hashed once.

    Tasks hand on one row for each feature of some COUNT_BYTES of text; these are summed before and after the one shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", COUNT_BYTES):
            found, _ = features(batch.column("text"), longest)
            coded = found.dictionary_encode()
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)))], ["feature", "n"])

    counts = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return counts.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain, one row for each bucket of `source`: floor(1000 ln) of its share in the target over that in the source, each count with 1 added."""
    s, t = source.groupBy("bucket").agg(F.sum("n").alias("s")), target.groupBy("bucket").agg(F.sum("n").alias("t"))
    whole = lambda rows, c: rows.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]
    s, t = stored(s, "source", rows=buckets), stored(t, "target", rows=buckets)
    all_s, all_t = whole(s, "s"), whole(t, "t")
    ratio = ((F.coalesce("t", F.lit(0)) + 1).cast("double") * F.lit(float(all_s + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    return s.join(t, "bucket", "left").select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain"))


def least_frequent(gains: DataFrame, most: int) -> int:
    """The least n from which on no more than `most` features are as frequent, told by their counts on a scale of sixteen steps to a doubling."""
    steps = gains.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("features"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    held, least = 0, 1 << 62
    for r in steps:
        held += r["features"]
        if held > most:
            break
        least = r["n"]
    return least


def weights(docs: DataFrame, gains: DataFrame, longest: int, frequent: int = FREQUENT, text_col: str = "text") -> DataFrame:
    """The rows, without the text, with row (a number of their own), n_words, n_features and weight, the sum of their features' gains; columns of these names are replaced.

    gains is the dictionary with a gain for each feature. Those of at most `frequent` most frequent features go to all tasks, which add them up
    text by text; of each text's other features the counts meet the gains in a join on the string. A feature's counts are one row
    for each text, dealt out by the string: the frequent ones are none of them, so that no string is a hot key.
    """
    extra = T.StructType.fromDDL("row long, n_words long, n_features long, known long, others array<struct<feature: string, n: long>>")
    rest = [c for c in docs.columns if c not in (text_col, *extra.fieldNames(), "weight")]
    top = gains.filter(F.col("n") >= least_frequent(gains, frequent)).select("feature", "gain").toPandas()
    names, values = pa.array(top["feature"].tolist(), pa.large_string()), top["gain"].to_numpy(np.int64)
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    schema = T.StructType([*docs.select(*rest).schema.fields, *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, text_col, COUNT_BYTES):
            n_rows, texts = batch.num_rows, batch.column(text_col)
            found, owner = features(texts, longest)
            n_words = np.bincount(words(texts)[1] if longest > 1 else owner, minlength=n_rows)
            coded = found.dictionary_encode()
            which = np.asarray(coded.indices).astype(np.int64)
            # place among the frequent, -1 for others
            at = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=names), -1), np.int64)
            gain = np.append(values, 0)[at][which] if len(which) else np.zeros(0, np.int64)
            # sums of integers below 2 ** 53: exact
            known = np.bincount(owner, gain, n_rows).astype(np.int64)
            other = at[which] < 0
            # each text's other features once, with their counts, in the order of the texts
            pairs, n = np.unique(owner[other] * max(1, len(coded.dictionary)) + which[other], return_counts=True)
            of, feature = pairs // max(1, len(coded.dictionary)), pairs % max(1, len(coded.dictionary))
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n_rows))]).astype(np.int32)
            structs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(feature)).cast(pa.string()), pa.array(n.astype(np.int64))], ["feature", "n"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), batch.column("row"), pa.array(n_words.astype(np.int64)), pa.array(np.bincount(owner, minlength=n_rows).astype(np.int64)), pa.array(known), pa.ListArray.from_arrays(pa.array(ends), structs)], schema.fieldNames()
            )

    counted = stored(docs.mapInArrow(run, schema), "features")
    others = counted.select("row", F.explode("others").alias("o")).select("row", "o.feature", "o.n")
    met = others.join(gains.select("feature", "gain"), "feature").groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("more"))
    return counted.drop("others").join(met, "row", "left").withColumn("weight", F.col("known") + F.coalesce("more", F.lit(0))).drop("known", "more")


def gumbel(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of sha256 of `seed:id`; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.log(-F.log(u)) * -1000.0)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with rank, 1, 2, 3... in that order: sorted over all tasks, a row's rank is its place in its part and the rows of the parts before."""
    placed = stored(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumns({"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    # one row for each part of the sort
    counts = placed.groupBy("part").agg(F.count("*").alias("in_part"))
    base = counts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("base"))
    return placed.join(F.broadcast(base), "part").withColumn("rank", F.col("base") + F.col("place") + 1).drop("part", "place", "base")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of documents(doc_id, text); rank is null where a row is not drawn.

    Of the rows with `least_words` words floor(percent * rows / 100) are drawn: those of the highest weight plus Gumbel noise, ties to the
    smaller doc_id (null ids last). Null and empty texts have no feature and weigh 0; repeated rows are rows of their own; an empty target gives
    gains from its smoothing alone. Other columns are left out.
    """
    rows = docs.select("doc_id", "text")
    source = stored(dictionary(rows, longest, buckets), "dictionary")
    gains = bucket_gains(source, dictionary(target.select("text"), longest, buckets), buckets)
    # one row for each bucket at most
    gains = stored(source.join(F.broadcast(gains), "bucket").select("feature", "n", "gain"), "gains")
    scored = stored(weights(rows, gains, longest, frequent).withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "scored")
    long_enough = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * long_enough.count() // 100
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    places = ranked(long_enough.select("row", "score", "doc_id"), order).filter(F.col("rank") <= drawn).select("row", "rank")
    return scored.join(places, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
