"""The named queries of the operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import codes, cws, flac, langid, mixing, oracles, packing, quality, records, reputation, resampling, sharding, simhash, toxicity
from strandwork.llm.common import documents, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_token_records(documents(spark, sf_dir), tokenizer_path(), end_id=2)
    return records.read_token_records(manifest, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(packing.token_pieces(documents(spark, sf_dir), tokenizer_path(), end_id=0, capacity=2048), "pieces")
    return packing.pack(pieces, 2048)


@query
def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = documents(spark, sf_dir).select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.assign_shards(digest, sharding.even_tree(16), sharding.even_tree(17))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(simhash.fingerprints(documents(spark, sf_dir), words=4), "prints")
    return simhash.near_groups(prints, radius=4).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Level of zstd by which media are stored: streams repeat little but for copies of texts, which a low level misses.
MEDIA_LEVEL = 9


@query
def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(flac.text_media(documents(spark, sf_dir)), "media", codec="zstd", level=MEDIA_LEVEL)
    return flac.media_features(media)


def fold(modulus: int):
    """crc32 of the doc_id as text, modulo: what deals documents out to folds."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def judged(scored: DataFrame, modulus: int, held: int) -> DataFrame:
    return scored.select("doc_id", (fold(modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit_quality(docs.filter(fold(5) != 0), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(5) != 0))
    return judged(quality.score(docs, model), 5, 0)


@query
def op7_toxicity_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_toxicity(docs.filter(fold(4) != 2), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(4) != 2), corpus=docs)
    return judged(toxicity.score(docs, model), 4, 2)


@query
def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.text_model(documents(spark, sf_dir))
    found = langid.identify(langid.page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")), model)
    return found.select("page_id", "host", "declared", "lang_id", F.round("confidence", 6).alias("confidence"), F.transform("posterior", lambda x: F.round(x, 6)).alias("posterior"))


#: The mix that the query and the pipeline ask for.
MIX_TARGETS = {"en": 0.6, "fr": 0.15, "de": 0.15, "es": 0.1}


@query
def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates, _ = mixing.mix_rates(mixing.domain_features(documents(spark, sf_dir)), MIX_TARGETS)
    return rates.withColumnRenamed("id", "doc_id")


@query
def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edited_likeness(documents(spark, sf_dir))


#: Rules of the query on urls.
URL_RULES = [reputation.rule("allow", "com/"), reputation.rule("block", "example.com/en/"), reputation.rule("allow", "www.example.com/en/"), reputation.rule("block", "net/es/"), reputation.rule("block", "net/fr/")]


@query
def op11_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return reputation.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("share", 6).alias("share"), F.round("bound", 6).alias("bound"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES |= {"op11_url_reputation": oracles.reputation_sql(URL_RULES), "op12_importance_resampling": oracles.resampling_sql(10_000, 10, 20, 2024), "op13_vector_codes": oracles.codes_sql()}
