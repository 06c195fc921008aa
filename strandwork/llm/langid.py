"""Language identification by fusing the evidence of text, markup, address and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm.common import SLICE_BYTES, forget, slices, stored, texts_of
from strandwork.llm.reputation import SUFFIXES, with_domain

#: Bins of letter trigrams.
BINS = 1 << 13
#: Languages that a model tells by name; all rarer ones of a corpus that has more are one, called REST.
LANGS = 256
REST = "(other)"
#: Share of the text's log likelihood that counts: a letter is in three trigrams, and neighbours depend on each other.
TEMPER = 0.2
#: Rows' worth that a prior weighs at each level below the one above it.
STRENGTH = 4.0

_LETTERS = np.zeros(256, np.int64)
_LETTERS[97:123] = np.arange(1, 27)
_LETTERS[65:91] = np.arange(1, 27)
_LETTERS[128:] = np.arange(27, 155)


def trigram_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all texts' trigrams of letters and word edges, and how many each text has; trigrams without a letter are left out."""
    raw = np.frombuffer("".join(f"  {t} " for t in texts).encode(), np.uint8)
    sizes = np.array([len(t.encode()) + 3 for t in texts], np.int64)
    c = _LETTERS[raw]
    bins = (c[:-2] * 24_593 + c[1:-1] * 1_543 + c[2:] * 97) % 1_000_003 % BINS
    kept = (c[:-2] | c[1:-1] | c[2:]) > 0
    ends = np.cumsum(sizes)[:-1]
    for back in (1, 2):
        kept[ends - back] = False
    owner = np.repeat(np.arange(len(texts)), sizes)[:-2]
    return bins[kept], np.bincount(owner[kept], minlength=len(texts))


def text_model(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = LANGS, bytes_each: int = SLICE_BYTES) -> tuple[list[str], np.ndarray]:
    """Languages and log P(bin | language): smoothed counts over every text whose language is declared.

    Tasks add up their texts and hand on one row for each language and bin; rows with a null
    language or text add nothing. Of a corpus with more than `most` languages the most frequent ones (ties by name) are told by name and all others
    are one, REST: so the model's size is bounded whatever the column holds, and no text is left out. Texts of some bytes_each are read together.
    """
    base = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    found = [r["lang"] for r in base.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most + 1).collect()] or ["und"]
    langs = sorted(found)
    if len(found) > most:
        langs = sorted({*found[: most - 1], REST})
        base = base.withColumn("lang", F.when(F.col("lang").isin(langs), F.col("lang")).otherwise(REST))
    known = set(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("languages")
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", bytes_each):
            langs, texts = batch.column("lang").to_pylist(), texts_of(batch)
            for lang in known.intersection(langs):
                bins, _ = trigram_bins([t for t, x in zip(texts, langs, strict=True) if x == lang])
                total.setdefault(lang, np.zeros(BINS, np.int64))
                total[lang] += np.bincount(bins, minlength=BINS)
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(counts[some])], ["lang", "bin", "n"])

    number = {lang: k for k, lang in enumerate(langs)}
    counts = np.full((BINS, len(langs)), 0.1)
    for r in base.mapInArrow(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"], number[r["lang"]]] += r["n"]
    return langs, np.log(counts / counts.sum(0))


def likelihoods(rows: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep_text: bool = False, bytes_each: int = SLICE_BYTES) -> DataFrame:
    """The rows with n_trigrams and loglik, the tempered log likelihood of the whole text by language, for the text column (or besides it).

    Columns that have the name of a new one are replaced; null texts count as empty.
    """
    langs, logp = model
    table = logp.astype(np.float32)
    rows = rows.drop(*(c for c in ("n_trigrams", "loglik") if c != text_col))
    rest = [c for c in rows.columns if keep_text or c != text_col]
    schema = rows.select(*rest).schema.add("n_trigrams", T.LongType()).add("loglik", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("languages")
        for batch in slices(batches, text_col, bytes_each):
            bins, counts = trigram_bins(texts_of(batch, text_col))
            sums = np.zeros((batch.num_rows, len(langs)))
            some = np.flatnonzero(counts)
            if len(some):
                sums[some] = np.add.reduceat(table[bins].astype(np.float64), (np.cumsum(counts) - counts)[some], axis=0)
            flat = pa.array(np.round(TEMPER * sums, 6).ravel())
            yield pa.RecordBatch.from_arrays([*batch.select(rest).columns, pa.array(counts), pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * len(langs) + 1, len(langs), dtype=np.int32)), flat)], [*rest, "n_trigrams", "loglik"])

    return rows.mapInArrow(run, schema)


def _softmax(logs: str) -> str:
    """SQL for the normalised exponentials of an array."""
    return f"transform({logs}, x -> exp(x - array_max({logs})) / aggregate({logs}, 0D, (s, y) -> s + exp(y - array_max({logs}))))"


def fuse(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """The rows with posterior (by language, in order), lang_id and confidence.

    evidence has host, domain, suffix, declared (all may be null) and loglik. Each row's text gives soft counts of languages;
    grouped sums over all rows give priors by level: the host's counts are smoothed by the domain's, these by the address
    suffix's and these by everyone's, each with the weight of STRENGTH rows. The declared language is a noisy channel whose rates, P(declared |
    language), are the same kind of counts. A row's own counts are taken out of every level and of the channel first, so that a text is no
    evidence for itself. Posterior: text likelihood x host prior x channel, normalised.
    Groups are summed before the shuffle; the joins back carry numbers, no texts, and AQE splits a hot host.
    Nulls make a group of their own; repeated rows count as often as they occur; an empty table stays empty.
    """
    n = len(langs)
    keyed = evidence.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in ("host", "domain", "suffix", "declared")}).withColumn("soft", F.expr(_softmax("loglik")))

    def sums(frame: DataFrame, *keys: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.array(*(F.sum(F.col("soft")[i]) for i in range(n))).alias("soft"))

    hosts = stored(sums(keyed, "host", "domain", "suffix"), "hosts", evidence.count())
    domains = sums(hosts, "domain", "suffix")
    suffixes = sums(domains, "suffix")
    whole = next((r for r in suffixes.agg(*(F.sum(F.col("soft")[i]) for i in range(n))).collect() if r[0] is not None), None)
    everyone = F.array(*(F.lit(float(x) + 1.0) for x in (whole if whole is not None else [0.0] * n)))
    above = domains.withColumnRenamed("soft", "_domain").join(suffixes.withColumnRenamed("soft", "_suffix"), "suffix")
    levels = hosts.withColumnRenamed("soft", "_host").join(above, ["domain", "suffix"])
    declared = sums(keyed, "declared").withColumnRenamed("soft", "_channel")
    rows = keyed.join(levels, ["host", "domain", "suffix"]).join(declared, "declared").withColumn("_prior", everyone)
    # everyone's counts without the row's own, then level by level down to the host's
    others = lambda c: F.zip_with(c, "soft", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumns({c: others(c) for c in ("_host", "_domain", "_suffix", "_channel", "_prior")})
    rows = rows.withColumn("_channel", F.zip_with("_channel", "_prior", lambda x, a: F.log((x + 0.5) / (a + 0.5 * n))))
    rows = rows.withColumn("_sum", total("_prior")).withColumn("_prior", F.transform("_prior", lambda x: x / F.col("_sum")))
    for level in ("_suffix", "_domain", "_host"):
        rows = rows.withColumn("_sum", total(level)).withColumn("_prior", F.zip_with(level, "_prior", lambda x, p: (x + STRENGTH * p) / (F.col("_sum") + STRENGTH)))
    rows = rows.withColumn("_logs", F.zip_with(F.zip_with("loglik", "_prior", lambda x, p: x + F.log(p)), "_channel", lambda x, y: x + y))
    rows = rows.withColumn("posterior", F.expr(_softmax("_logs"))).withColumn("confidence", F.array_max("posterior"))
    named = F.element_at(F.array(*(F.lit(x) for x in langs)), F.array_position("posterior", F.col("confidence")).cast("int"))
    return rows.withColumn("lang_id", named).drop("soft", "_host", "_domain", "_suffix", "_channel", "_prior", "_sum", "_logs")


def page_evidence(pages: DataFrame, suffixes: frozenset[str] = SUFFIXES) -> DataFrame:
    """page_id, host, domain, suffix, declared and visible text of web pages; missing parts are empty, a missing declaration null. suffixes as in reputation.with_domain."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    found = pages.select("page_id", host.alias("host"), F.when(declared != "", declared).alias("declared"), visible.alias("text"))
    return with_domain(found, suffixes).select("page_id", "host", "domain", "suffix", "declared", "text")


def identify(evidence: DataFrame, model: tuple[list[str], np.ndarray], keep_text: bool = False, bytes_each: int = SLICE_BYTES) -> DataFrame:
    """Evidence rows with text to rows with lang_id, confidence and posterior; likelihoods are written to the shared folder."""
    return fuse(stored(likelihoods(evidence, model, keep_text=keep_text, bytes_each=bytes_each), "likelihoods"), model[0])
