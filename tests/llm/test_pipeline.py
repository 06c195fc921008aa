import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strandwork.llm import langid, simhash

SF = "/root/testdata/sf0.01"


def test_stages_of_the_job():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_undecided_language", "drop_near_duplicates", "mix_languages", "pack_sequences"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_toxic_documents_go(spark, docs):
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean, toxic = [k for k, y in labels.items() if not y], [k for k, y in labels.items() if y]
    assert sum(k in kept for k in clean) >= 0.97 * len(clean)
    assert sum(k not in kept for k in toxic) >= 0.7 * len(toxic)


def test_clean_documents_keep_their_language(spark, docs):
    out = corpus_pipeline.drop_undecided_language(spark, docs, SF)
    assert out.columns == docs.columns and out.count() == docs.filter("text rlike '[A-Za-z]'").count()
    odd = spark.createDataFrame([(1, "12 34 !!", "en", "s", 8), (2, "the river and the stone of the morning", "en", "s", 9), (3, None, None, None, None)], docs.schema)
    assert {r["doc_id"] for r in corpus_pipeline.drop_undecided_language(spark, odd, SF).collect()} == {2}


def test_texts_of_no_language_of_the_corpus_go(spark, docs):
    rng = random.Random(6)
    odd = ["Все люди рождаются свободными и равными в своем достоинстве и правах", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "すべての人間は、生まれながらにして自由であり", "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق"]
    odd += [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(12)) for _ in range(5)] + [" ".join(f"{rng.getrandbits(32):08x}" for _ in range(20)) for _ in range(5)]
    more = spark.createDataFrame([(10**9 + i, x, "en" if i % 2 else None, "s", len(x)) for i, x in enumerate(odd)], docs.schema)
    left = {r["doc_id"] for r in corpus_pipeline.drop_undecided_language(spark, docs.unionByName(more), SF).collect()}
    assert not [k for k in left if k >= 10**9] and len(left) == docs.filter("text rlike '[A-Za-z]'").select("doc_id").distinct().count()


def test_one_of_each_group_stays(spark, docs):
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    rows = {r["doc_id"]: set(simhash.shingle_hashes(r["text"] or "", 5).tolist()) for r in docs.collect()}
    parent = {k: k for k in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(rows)
    holders = {}
    for k in keys:
        for h in rows[k] or {None}:
            holders.setdefault(h, []).append(k)
    near = {(a, b) for ks in holders.values() for i, b in enumerate(ks) for a in ks[:i]}
    for a, b in near:
        x, y = rows[a], rows[b]
        if len(x & y) >= 0.8 * len(x | y):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    assert kept == {k for k in keys if root(k) == k}


def test_near_duplicates_go_by_row(spark, docs):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = spark.createDataFrame([(2, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "de", "t", 2), (7, a + " x y", "en", "s", 1), (9, "c d e", "en", "s", 1), (9, "c d e", "en", "s", 1), (None, b, None, None, None)], docs.schema)
    out = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, rows, SF).collect()]
    assert sorted(out) == [(2, a, "en", "s", 1), (5, b, "de", "t", 2), (9, "c d e", "en", "s", 1)]


def test_mix_takes_documents_whole(spark, docs):
    out = corpus_pipeline.mix_languages(spark, docs, SF)
    assert out.columns == docs.columns
    assert out.exceptAll(docs.unionByName(docs)).count() == 0 and 0 < out.count() <= docs.count()


def test_stages_decode_few_rows_at_once(spark, docs):
    reader = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(reader)
    try:
        spark.conf.set(reader, "4096")
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.mix_languages):
            stage(spark, docs, SF)
            assert int(spark.conf.get(reader)) == corpus_pipeline.READ_ROWS <= 512
        spark.conf.set(reader, "100")
        corpus_pipeline.mix_languages(spark, docs, SF)
        assert spark.conf.get(reader) == "100"
    finally:
        spark.conf.set(reader, before)


def test_languages_are_the_same_whatever_is_read_at_once(spark, docs):
    evidence = docs.select("doc_id", F.col("source").alias("host"), F.col("source").alias("domain"), F.lit(None).cast("string").alias("suffix"), F.col("lang").alias("declared"), "text")
    found = []
    for most in (1 << 10, 1 << 19):
        rows = langid.identify(evidence, langid.text_model(docs, bytes_each=most), bytes_each=most).select("doc_id", "n_trigrams", "lang_id", F.round("confidence", 6)).collect()
        found.append(sorted(map(tuple, rows)))
    assert found[0] == found[1] and len(found[0]) == docs.count()


def test_run_ends_in_pieces(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_sequences", "bound", "certified"} == set(out.columns) and out.count() > 0
