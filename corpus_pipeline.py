"""The corpus pipeline: five operators of strandwork.llm applied to documents one after another.

Each stage takes what its predecessor kept, written as Parquet and read again. All stages but the last return the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import langid, mixing, packing, simhash, toxicity
from strandwork.llm.common import bounded_arrow, drop_paths, free_name, recorded, stored
from strandwork.llm.queries import MIX_TARGETS, fold, tokenizer_path

#: Scores from which on a text counts as toxic.
TOXIC = 0.3
#: Confidence in the fused language below which no language is decided.
DECIDED = 0.5
#: Bytes of text that a task of a stage reads at once: less than the operators alone, as workers and executors hold more by then.
BYTES_EACH = 1 << 18
#: Tokens that a worker of a stage keeps, for the same reason: later ones are read each time.
ENTRIES = 20_000
#: Rows of a Parquet file that a task decodes at once: with whole texts in them, Spark's 4096 take arrays of many MB of the executor's heap.
READ_ROWS = 512
#: Share of texts that are expected to be in none of the corpus's languages.
OTHER = 0.01


READER = "spark.sql.parquet.columnarReaderBatchSize"
_last: dict[str, list[str]] = {}


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose intermediate tables go when the next one begins: by then its result has been written."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop_paths(spark, _last.pop(app, []))
        if int(spark.conf.get(READER)) > READ_ROWS:
            spark.conf.set(READER, str(READ_ROWS))
        with recorded(spark) as paths:
            out = f(spark, docs, sf_dir)
        _last[app] = paths
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose restored text scores below TOXIC."""
    bounded_arrow(spark)
    model = toxicity.fit_toxicity(docs.filter(fold(4) != 2), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(4) != 2), corpus=docs, bytes_each=BYTES_EACH, entries=ENTRIES)
    score = free_name(docs.columns, "toxicity")
    return toxicity.scored_rows(docs, model, score_col=score, bytes_each=BYTES_EACH, entries=ENTRIES).filter(F.col(score) < TOXIC).drop(score)


@stage
def drop_undecided_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose fused evidence (text, declared lang, source as host) decides on a language; texts without letters go.

    The posterior knows the corpus's own languages only, so another one stands against them: all trigrams are equally likely in it.
    Where that explains the text better than every language does, weighed by OTHER, the text is in none of them. Every row takes its own
    evidence along, so that rows need no key.
    """
    bounded_arrow(spark)
    source = F.col("source")
    row = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    evidence = docs.select(row, source.alias("host"), source.alias("domain"), F.lit(None).cast("string").alias("suffix"), F.col("lang").alias("declared"), "text")
    found = langid.identify(evidence, langid.text_model(docs, bytes_each=BYTES_EACH), keep_text=True, bytes_each=BYTES_EACH)
    other = F.lit(math.log(OTHER)) - F.col("n_trigrams") * F.lit(langid.TEMPER * math.log(langid.BINS))
    decided = found.filter((F.col("n_trigrams") > 0) & (other <= F.array_max("loglik")) & (F.col("confidence") >= DECIDED))
    return decided.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that of the least doc_id, by row and not by id.

    Rows that repeat an id are judged by their own texts; of rows that agree in id and text one stays; rows without an id come last.
    """
    bounded_arrow(spark)
    judged, key, n = simhash.near_duplicates(docs), free_name(docs.columns, "key"), docs.count()
    judged = stored(judged.groupBy("key").agg(F.first("stays").alias("stays"), F.count("*").alias("m")).filter("m > 1 or not stays"), "judged", n)
    keyed = docs.withColumn(key, simhash.row_key())
    lost = judged.select(F.col("key").alias(key))
    # few enough keys go to where the texts lie; more are met by a shuffle
    single = keyed.join(F.broadcast(lost) if lost.count() <= simhash.BROADCAST_IDS else lost, key, "left_anti").select(*docs.columns)
    repeated = judged.filter("stays").select(F.col("key").alias(key))
    if repeated.isEmpty():
        return single
    return single.unionByName(keyed.join(repeated, key).groupBy(key).agg(F.first(F.struct(*docs.columns)).alias(key + "_row")).select(key + "_row.*"))


@stage
def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix to MIX_TARGETS takes them; every row takes its own rate along, so that rows need no key."""
    features = mixing.domain_features(docs, F.concat_ws(":", F.col("doc_id"), F.md5("text")), keep=docs.columns)
    rates, _ = mixing.mix_rates(features, MIX_TARGETS)
    return rates.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in best-fit sequences."""
    bounded_arrow(spark)
    return packing.pack(stored(packing.token_pieces(docs, tokenizer_path(), end_id=0, capacity=2048, bytes_each=BYTES_EACH, entries=ENTRIES), "pieces"), 2048)


STAGES = [("toxicity", drop_toxic), ("language", drop_undecided_language), ("near_duplicates", drop_near_duplicates), ("mixing", mix_languages), ("packing", pack_sequences)]

#: Trained models, components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
