"""Consistent weighted sampling: fingerprints whose collision rate is the generalised Jaccard similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm.common import stored

#: Samples of a fingerprint, and the bits that are kept of each.
SAMPLES, BITS = 32, 24
#: Text bytes whose terms one task holds.
TEXT_BYTES = 8 << 20
#: What a null id counts as.
NULL_KEY = -(1 << 63)


def predecessors(ids: DataFrame, rows_each: int = 100_000) -> DataFrame:
    """key, prev and prev_n: each distinct key (column key, length in n) with the next smaller key and its length; the smallest has the largest.

    Keys are dealt out by range and each part is looked through in order. What comes before a part's first key
    is the last key of the part before; of those there is one for each part. Rows of one key count once, with the largest n.
    """
    distinct = ids.groupBy("key").agg(F.max("n").alias("n"))
    parts = max(1, -(-ids.count() // rows_each))
    dealt = stored(distinct.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "ids")
    here = F.struct("key", "n")
    inside = dealt.withColumn("before", F.lag(here).over(Window.partitionBy("part").orderBy("key")))
    ends = dealt.groupBy("part").agg(F.max(here).alias("end"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select("part", F.coalesce(F.lag("end").over(order), F.max("end").over(whole)).alias("carried"))
    return inside.join(carried, "part").select("key", F.coalesce("before", "carried").alias("prev")).select("key", F.col("prev.key").alias("prev"), F.col("prev.n").alias("prev_n"))


def _samples(k: int, logs: list[str]) -> list[Column]:
    """The k-th sample's values for the terms' log weights (null: not in the set); the least over a set is its sample.

    With r and c from Gamma(2, 1) and b from (0, 1), all by hash of term and k: t = floor(ln w / r + b), ln y = r (t - b)
    and ln a = ln c - ln y - r (Ioffe 2010). The value depends on the weight by t alone, so equal least values
    mean the same term at the same quantised weight, which happens with the generalised Jaccard similarity.
    """
    low = F.lit((1 << 32) - 1)
    one, two, three = (F.xxhash64("term", F.lit(3 * k + i)) for i in range(3))
    r = -F.log((F.shiftrightunsigned(one, 32) + 0.5) * (one.bitwiseAND(low) + 0.5) / float(1 << 64))
    c = F.log(-F.log((F.shiftrightunsigned(two, 32) + 0.5) * (two.bitwiseAND(low) + 0.5) / float(1 << 64)))
    b = F.shiftrightunsigned(three, 11) / float(1 << 53)
    return [c - r * (F.floor(F.col(x) / r + b) - b + 1.0) for x in logs]


def weighted_samples(terms: DataFrame, keys: list[str], weights: list[str], extra: dict[str, Column] | None = None, samples: int = SAMPLES) -> DataFrame:
    """One row for each group of keys: for each weight column an array of its samples' hashes, and the extra aggregates.

    terms has one row for each group and term (a long); weights are not negative, 0 and null leave the term out.
    A group without a term gets a fixed fingerprint, equal for all such.
    """
    logs = {f"_log_{w}": F.when(F.col(w) > 0, F.log(w)) for w in weights}
    rows = terms.withColumns(logs)
    least = {f"{w}_{k}": F.min(v) for k in range(samples) for w, v in zip(weights, _samples(k, list(logs)), strict=True)}
    found = rows.groupBy(*keys).agg(*(v.alias(x) for x, v in (least | (extra or {})).items()))
    return found.select(*keys, *(extra or {}), *(F.array(*(F.pmod(F.xxhash64(f"{w}_{k}"), F.lit(1 << BITS)).cast("int") for k in range(samples))).alias(w) for w in weights))


def fingerprint(samples: Column, n: int = SAMPLES) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(F.element_at(samples, k + 1)), BITS // 4, "0")) for k in range(n)))


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples."""
    return reduce(lambda x, y: x + y, ((F.element_at(a, k + 1) == F.element_at(b, k + 1)).cast("int") for k in range(n))) / float(n)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next text.

    The edited text ends in the first floor(n/2) characters of the next document (by ascending id; after the last the first)
    instead of its own last ones. Terms are the words between white space, in lower case, weighted by how often they occur.
    Null texts count as empty and have the fingerprint of no term; a null id is the smallest id; rows that repeat
    an id each get a row, and the next document's text is the smallest of its id; an empty table stays empty.

    Texts are dealt out by id once, their beginnings once more to the id before; terms are counted and sampled
    where their text lies, without another shuffle. What a row needs besides its terms (lengths, digests) goes along as
    terms of other kinds, as numbers of 32 bits.
    """
    null_key = F.lit(NULL_KEY).cast("long")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), null_key).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    before = predecessors(base.select("key", F.char_length("text").cast("long").alias("n")))
    own = base.repartition(max(1, -(-size // TEXT_BYTES)), "key").join(before, "key")
    tails = own.select(F.col("prev").alias("key"), F.substring("text", F.lit(1), F.expr("cast(prev_n div 2 AS int)")).alias("tail")).groupBy("key").agg(F.min("tail").alias("tail"))
    full = own.join(tails, "key").withColumn("n", F.char_length("text"))
    full = full.withColumn("edited", F.concat(F.expr("substring(text, 1, n - n div 2)"), F.expr("substring(tail, 1, n div 2)"))).withColumn("row", F.monotonically_increasing_id())
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("t"))
    info = [F.substring(sha, 8 * i + 1, 8) for i in range(8)] + [F.hex("n"), F.hex(F.shiftrightunsigned("prev", 32)), F.hex(F.col("prev").bitwiseAND(F.lit((1 << 32) - 1)))]
    pieces = full.select("key", "row", F.explode(F.array(part(0, F.lower("text")), part(1, F.lower("edited")), *(part(2 + i, x) for i, x in enumerate(info)))).alias("p")).select("key", "row", "p.*")
    words = pieces.select("key", "row", "kind", F.explode(F.split("t", r"\s+")).alias("word")).filter("word <> '' OR kind > 1")
    terms = words.select("key", "row", F.greatest("kind", F.lit(1)).alias("kind"), F.when(F.col("kind") < 2, F.xxhash64("word")).otherwise(F.conv("word", 16, 10).cast("long")).alias("term"), (F.col("kind") == 0).cast("long").alias("w0"), (F.col("kind") == 1).cast("long").alias("w1"))
    counted = terms.groupBy("key", "row", "kind", "term").agg(F.sum("w0").alias("plain"), F.sum("w1").alias("edited"))
    extra = {f"i{i}": F.max(F.when(F.col("kind") == 2 + i, F.col("term"))) for i in range(len(info))}
    found = weighted_samples(counted, ["key", "row"], ["plain", "edited"], extra, samples)
    digest = F.concat(*(F.lower(F.lpad(F.hex(f"i{i}"), 8, "0")) for i in range(8)))
    prints = stored(found.select("key", F.col("i8").alias("n_chars"), digest.alias("edited_sha256"), "plain", "edited", F.shiftleft("i9", 32).bitwiseOR(F.col("i10")).alias("prev")), "prints")
    following = prints.groupBy(F.col("prev").alias("key")).agg(F.min("plain").alias("following"))
    return prints.join(following, "key").select(
        F.when(F.col("key") != null_key, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("plain"), samples).alias("fingerprint"), fingerprint(F.col("edited"), samples).alias("edited_fingerprint"),
        likeness(F.col("plain"), F.col("edited"), samples).alias("near_edited"), likeness(F.col("plain"), F.col("following"), samples).alias("near_next"),
    )
