"""Every query over tables with every trouble, over empty ones, and over the small driver tables against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm.test_operators import placed

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.LLM_QUERIES)


@pytest.fixture(scope="session")
def small(spark):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def found(spark, name, folder=SF):
    return [r.asDict() for r in entry.queries()[name](spark, folder).collect()]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_all_are_registered():
    assert {re.match(r"op\d+|pipeline", n)[0] for n in NAMES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}


@pytest.mark.parametrize("name", NAMES)
def test_troubled_tables(spark, troubled, rows, name):
    out = found(spark, name, troubled)
    if name.startswith("op8"):
        assert Counter(r["page_id"] for r in out) == Counter([1, 1, 2, 3, 4, 5, 6])
    elif name == "pipeline":
        assert all(0 < r["length"] <= 2048 for r in out)
    elif name.startswith("op6"):
        assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    elif name.startswith("op11"):
        assert Counter(r["page_id"] for r in out) == Counter([1, 1, 2, 3, 4, 5, 6]) and {r["verdict"] for r in out} <= {"allow", "block"}
    elif name.startswith("op13"):
        assert Counter(r["vec_id"] for r in out) == Counter([*range(30), 3, 3, 40, None])
    else:
        ids = Counter(r["doc_id"] for r in out)
        assert set(ids) == {r[0] for r in rows} and ids[5] == 2
    if name.startswith("op9"):
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, nothing, name):
    assert found(spark, name, nothing) == []


def test_op1_bytes_come_back(spark, small):
    out = {r["doc_id"]: r for r in found(spark, "op1_flac_media")}
    for key, text in small:
        raw = text.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = out[key]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    by_text = defaultdict(set)
    for key, text in small:
        by_text[text].add((out[key]["media_sha256"], out[key]["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def words(text):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]


def jaccard(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_op2_estimates_generalised_jaccard(spark, small):
    out = {r["doc_id"]: r for r in found(spark, "op2_weighted_sampling")}
    errors = []
    for i, (key, text) in enumerate(small):
        following = small[(i + 1) % len(small)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = out[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, following)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.12
    by_text = defaultdict(set)
    for key, text in small:
        by_text[text].add(out[key]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_op3_ids_and_starts(spark, small):
    t, out, start = tokenizer(), {r["doc_id"]: r for r in found(spark, "op3_binary_records")}, 0
    for key, text in small:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert out[key] == {"doc_id": key, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)


def test_op4_equals_all_pairs(spark, small):
    from xxhash import xxh64_intdigest

    fps = []
    for _, text in small:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxh64_intdigest(x.encode(), 42) for x in runs]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)

    def root(i):
        return i if parent[i] == i else root(parent[i])

    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found(spark, "op4_simhash_near_dedup")}
    assert out == {key: (f"{fps[i]:016x}", small[root(i)][0]) for i, (key, _) in enumerate(small)}


@pytest.mark.parametrize(("name", "label", "modulus", "held", "least"), [("op5_quality_pu", "quality", 5, 0, 0.93), ("op7_toxicity_restored", "toxic", 4, 2, 0.85)])
def test_held_out_accuracy(spark, name, label, modulus, held, least):
    folder = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in found(spark, name, folder)}
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % modulus == held) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for k, r in out.items())
    right = [out[k]["predicted"] == y for k, y in labels.items() if out[k]["held_out"]]
    assert np.mean(right) >= least


def test_op7_leaves_ordinary_words_alone_and_sees_through_disguise(spark):
    from strandwork.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    plain = ["good morning", "tell me more", "a clock and a cloud", "good morning, the train will close once more", "hello letter address summer coffee committee", "Все люди рождаются свободными"]
    around = "it is plain that you are such {} and that is what we said of you last week"
    shown = {"trash": ["trash", "traash", "trrash", "tttrash", "TRASSSHHH", "tr@sh", "trаsh", "t.r.a.s.h"], "idiot": ["idiot", "iddiot", "1d10t", "іdiоt"], "scum": ["scum", "sccum", "ѕcum"], "moron": ["moron", "morron", "mоrоn", "m0r0n"]}
    probe = [*plain, around.format("friends"), *(around.format(x) for xs in shown.values() for x in xs)]
    found = toxicity.score(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), model).collect()
    scores = {probe[r["doc_id"]]: r["score"] for r in found}
    assert all(scores[x] < 0.3 for x in [*plain, around.format("friends")]), scores
    for word, forms in shown.items():
        # as any is at the cut
        assert all(scores[around.format(x)] >= 0.3 for x in forms), (word, {x: scores[around.format(x)] for x in forms})


def check_packing(spark, out, small, end_id):
    t, lengths = tokenizer(), 0
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
        lengths += r["length"]
    for key, text in small:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, end_id], "<u4")
        pieces, at = sorted(by_doc[key], key=lambda r: r["piece"]), 0
        for n, r in enumerate(pieces):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            assert n == 0 or r["length"] == 2048
            at += r["length"]
        assert at == len(ids) and (len(pieces) == 1) == (len(ids) <= 2048)
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_bin) <= -(-lengths // 2048) + 1
    assert {(r["n_sequences"], r["certified"]) for r in out} == {(len(by_bin), len(by_bin) == out[0]["bound"])} and len(by_bin) >= out[0]["bound"]


def test_op6_pieces_and_bins(spark, small):
    check_packing(spark, found(spark, "op6_best_fit_packing"), small, 0)


def test_op9_law_of_keys(spark, small):
    out = {r["doc_id"]: r for r in found(spark, "op9_hash_tree_shards")}
    for key, text in small:
        r = out[key]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "key")
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    assert any(r["grown_shard"] == 16 for r in out.values())


def test_op9_places_by_brute_force(spark, small):
    from strandwork.llm import sharding

    out = {r["doc_id"]: r for r in found(spark, "op9_hash_tree_shards")}
    for key, _ in small:
        assert placed(key, sharding.even_tree(16))[2] == out[key]["shard"] and placed(key, sharding.even_tree(17))[2] == out[key]["grown_shard"]
    slots = defaultdict(list)
    for r in out.values():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op10_totals_meet_the_targets(spark):
    from strandwork.llm.queries import MIX_TARGETS

    out = found(spark, "op10_soft_mixing", "/root/testdata/sf0.01")
    sums = sum(np.array(r["posterior"]) * r["n_tokens"] * r["rate"] for r in out)
    wanted = np.array([MIX_TARGETS[x] for x in sorted(MIX_TARGETS)])
    assert np.abs(sums / sums.sum() / wanted - 1).max() < 0.01
    assert all(r["converged"] for r in out)
    assert all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in out)


@pytest.mark.parametrize(("every", "least"), [(4, 40), (1, 240)])
def test_op8_tells_languages_that_are_not_declared(spark, every, least):
    """The declarations of all pages of every fourth host, or of all hosts, are taken away; what they said must be found."""
    from pyspark.sql import functions as F

    from strandwork.llm import langid

    folder = "/root/testdata/sf0.01"
    pages = langid.page_evidence(spark.read.parquet(f"{folder}/pages.parquet"))
    truth = {r["page_id"]: (r["host"], r["declared"]) for r in pages.collect()}
    hosts = sorted({host for host, _ in truth.values()})
    gone = hosts[::every]
    hidden = pages.withColumn("declared", F.when(~F.col("host").isin(gone), F.col("declared")))
    model = langid.text_model(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = langid.identify(hidden, model).select("page_id", "declared", "lang_id").collect()
    asked = {r["page_id"]: r["lang_id"] for r in rows if truth[r["page_id"]][0] in gone}
    assert len(asked) >= least and not any(r["declared"] for r in rows if r["page_id"] in asked)
    assert np.mean([found == truth[k][1] for k, found in asked.items()]) > 0.97


def test_op8_fuses_hosts_and_declarations(spark):
    """A text of two languages alike takes its host's; a declaration outweighs a host that is of two minds."""
    from strandwork.llm import langid

    rows = [(i, "a.x.com", "x.com", "com", "en", [0.0, -9.0]) for i in range(8)] + [(20 + i, "b.x.com", "x.com", "com", "fr", [-9.0, 0.0]) for i in range(8)]
    rows += [(40, "a.x.com", "x.com", "com", None, [0.0, 0.0]), (41, "b.x.com", "x.com", "com", None, [0.0, 0.0]), (42, "c.x.com", "x.com", "com", "fr", [0.0, 0.0]), (43, None, None, None, "en", [0.0, 0.0])]
    out = {r["k"]: r["lang_id"] for r in langid.fuse(spark.createDataFrame(rows, "k int, host string, domain string, suffix string, declared string, loglik array<double>"), ["en", "fr"]).collect()}
    assert (out[40], out[41], out[42], out[43]) == ("en", "fr", "fr", "en")


def test_op8_fusion_by_brute_force(spark):
    """Every level and the channel without the row's own counts."""
    import random

    from strandwork.llm import langid

    rng, langs, s = random.Random(5), ["de", "en", "fr"], langid.STRENGTH
    places = [("a.x.com", "x.com", "com"), ("b.x.com", "x.com", "com"), ("y.org", "y.org", "org"), (None, None, None), ("z.com", "z.com", "com")]
    rows = [(i, *rng.choices(places, [5, 2, 3, 1, 1])[0], rng.choice(["en", "fr", None, "xx"]), [rng.uniform(-3, 0) for _ in langs]) for i in range(40)] + [(40, "only.net", "only.net", "net", "de", [-1.0, -2.0, -0.5])]

    def softmax(x):
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    soft = {r[0]: softmax(r[5]) for r in rows}
    found = {r["k"]: r for r in langid.fuse(spark.createDataFrame(rows, "k int, host string, domain string, suffix string, declared string, loglik array<double>"), langs).collect()}
    for r in rows:
        rest = lambda *at: sum((soft[x[0]] for x in rows if x[0] != r[0] and all(x[i] == r[i] for i in at)), np.zeros(3))
        everyone = rest() + 1.0
        prior = everyone / everyone.sum()
        for at in ((3,), (2, 3), (1, 2, 3)):
            prior = (rest(*at) + s * prior) / (rest(*at).sum() + s)
        channel = np.log((rest(4) + 0.5) / (everyone + 0.5 * 3))
        want = softmax(np.array(r[5]) + np.log(prior) + channel)
        assert np.allclose(found[r[0]]["posterior"], want, atol=1e-9) and found[r[0]]["lang_id"] == langs[int(want.argmax())]


def test_op8_rarer_languages_are_one(spark):
    from strandwork.llm import langid

    texts = {"en": "the river and the stone", "de": "der Fluss und der Stein", "fr": "la pierre et la rivière", "pl": "rzeka i kamień", "cs": "řeka a kámen"}
    rows = [(k, t) for i, (k, t) in enumerate(texts.items()) for _ in range(9 - i)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert langid.text_model(frame)[0] == sorted(texts)
    langs, logp = langid.text_model(frame, most=3)
    assert langs == sorted(["en", "de", langid.REST]) and logp.shape == (langid.BINS, 3)
    out = langid.identify(spark.createDataFrame([(1, "kamień i rzeka"), (2, "the stone")], "k int, text string").selectExpr("k", "text", "'h' AS host", "'h' AS domain", "'' AS suffix", "CAST(NULL AS STRING) AS declared"), (langs, logp)).collect()
    assert {r["k"]: r["lang_id"] for r in out} == {1: langid.REST, 2: "en"}


def test_op8_languages_of_pages(spark):
    out = found(spark, "op8_language_fusion", "/root/testdata/sf0.01")
    assert np.mean([r["lang_id"] == r["declared"] for r in out]) > 0.97
    assert all(abs(sum(r["posterior"]) - 1) < 1e-5 for r in out)
