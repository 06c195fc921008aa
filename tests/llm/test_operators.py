"""The operators' own interfaces against plain, slow versions."""

import itertools
import pathlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwork.llm import common, cws, fit, flac, graph, langid, mixing, packing, queries, records, sharding, simhash, tokens, toxicity
from strandwork.llm.queries import tokenizer_path


def plain_crc(data, bits, polynomial):
    state = 0
    for byte in data:
        state ^= byte << (bits - 8)
        for _ in range(8):
            state = (state << 1 ^ polynomial if state >> (bits - 1) & 1 else state << 1) & (1 << bits) - 1
    return state


class Reader:
    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def zeros(self):
        n = 0
        while not self.take(1):
            n += 1
        return n


def plain_frame(body, size):
    """Samples of a mono 8-bit subframe, read bit by bit."""
    r = Reader(body)
    assert r.take(1) == 0
    kind, _ = r.take(6), r.take(1)
    if kind == 0:
        return [r.signed(8)] * size
    if kind == 1:
        return [r.signed(8) for _ in range(size)]
    order = kind - 8 if kind < 32 else kind - 31
    x = [r.signed(8) for _ in range(order)]
    if kind >= 32:
        precision, shift = r.take(4) + 1, r.signed(5)
        c = [r.signed(precision) for _ in range(order)]
    else:
        c, shift = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}[order], 0
    wide = r.take(2)
    parts = 1 << r.take(4)
    for p in range(parts):
        k = r.take(4 + wide)
        raw = r.take(5) if k == (1 << 4 + wide) - 1 else None
        for _ in range(size // parts - order * (p == 0)):
            if raw is not None:
                e = r.signed(raw)
            else:
                u = r.zeros() << k
                u |= r.take(k)
                e = u >> 1 if u % 2 == 0 else -(u >> 1) - 1
            x.append(e + (sum(a * b for a, b in zip(c, reversed(x[-order:]), strict=True)) >> shift if order else 0))
    return x


def payload_of(text):
    raw = text.encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def payloads():
    rng = random.Random(4)
    texts = ["", "x", "the river and the stone " * 60, "é漢🙂" * 40, "".join(chr(rng.randrange(32, 127)) for _ in range(3000))]
    return [payload_of(t) for t in texts] + [bytes(range(256)) * 5, bytes([0x80] * 64), bytes(rng.randrange(256) for _ in range(1088))]


def test_flac_frames_read_bit_by_bit():
    for payload, stream in zip(payloads(), flac.encode(payloads()), strict=True):
        info, table, first = flac.layout(stream)
        starts = flac._search(stream, first)
        assert starts.tolist() == (table["offset"].astype(int) + first).tolist()
        ends = np.append(starts[1:], len(stream))
        x = []
        for begin, end, number, size, width, channels, head in zip(starts.tolist(), ends.tolist(), *flac._headers(np.frombuffer(stream + bytes(32), np.uint8), starts, ends), strict=True):
            assert (width, channels, number) == (8, 0, len(x) // flac.BLOCK)
            assert plain_crc(stream[begin : begin + head - 1], 8, 0x07) == stream[begin + head - 1]
            assert plain_crc(stream[begin : end - 2], 16, 0x8005) == int.from_bytes(stream[end - 2 : end], "big")
            x += plain_frame(stream[begin + head : end - 2], size)
        assert bytes(v & 255 for v in x) == payload


def test_seeks_by_the_table(monkeypatch):
    rng = random.Random(5)
    payload = bytes(rng.randrange(256) for _ in range(20_032))
    whole = np.frombuffer(payload, np.int8)
    for most in (800_000, 6):
        monkeypatch.setattr(flac, "MOST_POINTS", most)
        stream = flac.encode([payload])[0]
        assert (flac.decode([stream])[0] == whole).all()
        damaged = bytearray(stream)
        damaged[-600] ^= 1
        for at, n in [(0, 64), (1023, 2), (5000, 3000), (19_968, 64), (20_000, 500), (30_000, 5)]:
            assert flac.read_at(stream, at, n).tolist() == whole[at : at + n].tolist()
        # what lies behind is not read
        assert flac.read_at(bytes(damaged), 100, 50).tolist() == whole[100:150].tolist()
        with pytest.raises(flac.DamagedStream):
            flac.read_at(bytes(damaged), 20_000, 5)


def test_a_long_text_takes_little_memory():
    import subprocess
    import sys

    code = """
import resource, sys
from strandwork.llm import flac
import numpy as np
text = np.random.default_rng(1).integers(97, 123, 12 << 20, dtype=np.uint8).tobytes()
flac.decode(flac.encode([text[: 1 << 20]]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
media = flac.encode([memoryview(text)])[0]
n = sum(int(size.sum()) for _, _, _, size, _ in flac.blocks([media]))
assert n == len(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    grown = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-1])
    assert grown < 100


def test_flac_round_trip_and_damage():
    streams = flac.encode(payloads())
    assert [x.astype(np.int8).tobytes() for x in flac.decode(streams)] == payloads()
    rng = random.Random(1)
    stream = streams[2]
    for _ in range(25):
        broken = bytearray(stream)
        at = rng.randrange(42 + 4 + 18, len(stream))
        broken[at] ^= 1 << rng.randrange(8)
        with pytest.raises(flac.DamagedStream):
            flac.decode([bytes(broken)])
    with pytest.raises(flac.DamagedStream):
        flac.decode([stream[:-3]])
    with pytest.raises(ValueError, match="64"):
        flac.encode([b"abc"])


def build_frame(bits, size):
    """A frame around the subframe bits of a stream's only block."""
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x70, 0x02, 0x00]) + (size - 1).to_bytes(2, "big")
    body = head + bytes([plain_crc(head, 8, 0x07)]) + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    return body + plain_crc(body, 16, 0x8005).to_bytes(2, "big")


@pytest.mark.parametrize("kind", ["constant", "verbatim", "fixed0", "fixed2", "fixed3", "fixed4", "escape", "wide"])
def test_flac_decodes_what_the_encoder_does_not_write(kind):
    import hashlib

    x = [(7 * i * i + i) % 40 - 20 for i in range(32)]
    b = lambda v, n: f"{v & (1 << n) - 1:0{n}b}"
    if kind == "constant":
        x, bits = [5] * 32, "0" + b(0, 6) + "0" + b(5, 8)
    elif kind == "verbatim":
        bits = "0" + b(1, 6) + "0" + "".join(b(v, 8) for v in x)
    else:
        order = int(kind[-1]) if kind[:5] == "fixed" else 1
        e = x
        for _ in range(order):
            e = [a - c for c, a in zip(e, e[1:], strict=False)]
        bits = "0" + b(8 + order, 6) + "0" + "".join(b(v, 8) for v in x[:order])
        code = lambda v, k: "0" * ((2 * v if v >= 0 else -2 * v - 1) >> k) + "1" + (b(2 * v if v >= 0 else -2 * v - 1, k) if k else "")
        if kind == "escape":
            bits += "00" + b(0, 4) + b(15, 4) + b(9, 5) + "".join(b(v, 9) for v in e)
        elif kind == "wide":
            bits += "01" + b(0, 4) + b(3, 5) + "".join(code(v, 3) for v in e)
        else:
            bits += "00" + b(0, 4) + b(4, 4) + "".join(code(v, 4) for v in e)
    pcm = bytes(v & 255 for v in x)
    info = (32).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 32).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + build_frame(bits, 32)
    assert flac.decode([stream])[0].tolist() == x


def test_stored_media_find_far_copies(spark):
    # incompressible texts, each of them again 2.4 MB later, too many for a dictionary
    rng = random.Random(7)
    texts = ["".join(chr(rng.randrange(32, 127)) for _ in range(3000)) for _ in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string").coalesce(1)
    size = lambda df: sum(f.stat().st_size for f in pathlib.Path(df.stored_path.removeprefix("file://")).glob("*.parquet"))
    media = flac.text_media(rows)
    plain, packed = common.stored(media, "media", codec="zstd"), common.stored(media, "media", codec="zstd", level=queries.MEDIA_LEVEL)
    assert size(packed) < 0.8 * size(plain)
    assert packed.orderBy("doc_id").collect() == plain.orderBy("doc_id").collect()


def test_pcm_blocks_seek(spark):
    rows = spark.createDataFrame([(1, "a" * 5000, 3), (2, None, 4)], "doc_id long, text string, block int")
    media = flac.text_media(rows)
    blocks = sorted(flac.pcm_blocks(media).filter("doc_id = 1").collect(), key=lambda r: r["block"])
    assert [r["sample_offset"] for r in blocks] == [1024 * i for i in range(5)]
    assert b"".join(bytes(r["pcm"]) for r in blocks) == payload_of("a" * 5000)
    assert flac.pcm_blocks(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0


def test_crc32c_known_value():
    assert common.crc32c_many([b"123456789", b"", b"a" * 700]).tolist()[:2] == [0xE3069283, 0]
    assert int(common.masked(np.array([0xE3069283], np.uint32))[0]) == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    rng = random.Random(2)
    texts = ["", " ", "\n", "a\n", "a  b", "a \n b", "a\tb c", "x y z", "don't we'll <|endoftext|> 12 345", "\x01a b", "é ü 漢字 🙂 x", "it's. he'll, x's! o'. Ünd;", *("".join(rng.choice("ab .,\n\t'1é ") for _ in range(40)) for _ in range(300))]
    texts += ["<|endoftext|>", "<|endoftext|> a", "a<|endoftext|>b c", "x <|endoftext|><|endoftext|> y <|endoftext|>", "a <|endoftext|> b", "word.<|endoftext|>, word"]
    texts += [" ".join(texts), "a b " + "x, y. " * 50]
    for part in (1 << 20, 30):
        monkeypatch.setattr(tokens, "PART", part)
        e = tokens.PieceEncoder(tokenizer_path(), entries=5)
        for _ in range(2):
            flat, counts = e.encode(texts)
            assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_records_seek_and_find_damage(spark, docs, tmp_path):
    manifest = records.write_token_records(docs, tokenizer_path(), 2, folder=f"file://{tmp_path}/r", shard_bytes=20_000)
    rows = sorted(records.read_token_records(manifest).collect(), key=lambda r: r["start"])
    assert len({r["shard"] for r in rows}) > 1 and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    paths = {r["shard"]: r["path"] for r in manifest.collect()}
    for r in random.Random(1).sample(rows, 10):
        key, ids = records.read_at(paths[r["shard"]], [r["record"]])[0]
        assert key == r["doc_id"] and ids.tolist() == r["ids"]
    data, starts = records.frame([b"abc", b"", b"x" * 5000])
    assert records.unframe(data, starts) == [b"abc", b"", b"x" * 5000]
    for at in (0, 9, 13, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError, match="damaged|short"):
            records.unframe(bytes(broken), starts)


def test_null_ids_come_first_in_records(spark, tmp_path):
    rows = spark.createDataFrame([(5, "five"), (None, "none"), (1, "one"), (5, "five")], "doc_id long, text string")
    out = records.read_token_records(records.write_token_records(rows, tokenizer_path(), 2, folder=f"file://{tmp_path}/n")).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, 1, 5, 5]


def test_a_hot_id_is_cut_over_files(spark, tmp_path):
    rows = spark.createDataFrame([(None, f"text {i} " * 20) for i in range(200)] + [(7, "same " * 40)] * 200, "doc_id long, text string").repartition(4)
    manifest = records.write_token_records(rows, tokenizer_path(), 2, folder=f"file://{tmp_path}/h", shard_bytes=4_000)
    out = records.read_token_records(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None] * 200 + [7] * 200
    assert max(r["n_records"] for r in manifest.collect()) < 100


def least_bins(sizes, capacity):
    """By trying all ways."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                place(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bounds_and_packings_enclose_the_least_bins(seed):
    rng = random.Random(seed)
    capacity = 24
    sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
    bins, places = packing.best_fit_decreasing(np.array(sizes), capacity)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= capacity and len(set(zip(bins, places, strict=True))) == len(sizes)
    least = least_bins(sizes, capacity)
    assert packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= least <= len(fill)


def test_best_fit_takes_the_tightest_room():
    sizes = sorted(random.Random(3).choices(range(1, 60), k=300), reverse=True)
    rooms, want = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            i = min(fits)[1]
            rooms[i] -= s
        else:
            rooms.append(100 - s)
    bins, _ = packing.best_fit_decreasing(np.array(sizes), 100)
    assert sorted(100 - np.bincount(bins, weights=sizes)) == sorted(rooms)


def test_exchange_closes_gaps(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 101) for _ in range(3000)]
    rows = spark.createDataFrame([(i, 0, s, "x") for i, s in enumerate(sizes)], "doc_id long, piece int, length long, offset string")
    out = packing.pack(rows, 100, pieces_each=150).collect()
    assert len(out) == 3000
    bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
    assert bound <= len({r["sequence_id"] for r in out}) <= 1.025 * bound


def test_forest_finds_what_all_pairs_find():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.integers(0, 64, 3)) for _ in range(400)], np.uint64)
    values = np.unique(np.concatenate([base, rng.choice(base, 400) ^ flips]))
    forest = simhash.Forest(values, np.zeros(len(values), np.int64))
    pairs = {(int(q), int(n)) for who, node in forest.search(values, np.zeros(len(values), np.int64), 4) for q, n in zip(who, node, strict=True)}
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    assert pairs == set(zip(*(x.tolist() for x in np.nonzero(far <= 4)), strict=True))


def test_large_shards_get_several_trees(spark, monkeypatch):
    rng = np.random.default_rng(3)
    flips = np.array([sum({1 << int(b) for b in rng.integers(0, 64, 2)}) for _ in range(300)], np.uint64)
    prints = [(i, int(v)) for i, v in enumerate((np.uint64(0x0123456789ABCDEF) ^ flips).view(np.int64))] + [(1000, 0), (1001, -1), (1002, -1)]
    rows = spark.createDataFrame(prints, "doc_id long, fp long")
    want = sorted(map(tuple, simhash.near_groups(rows).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(simhash, "TREE_NODES", 16)
    assert sorted(map(tuple, simhash.near_groups(rows).select("doc_id", "component_id").collect())) == want
    assert dict(want)[1002] == 1001 and {c for d, c in want if d < 1000} == {0}


@pytest.mark.parametrize("block", [8192, 16])
def test_texts_with_runs_put_in_or_left_out_are_near(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "COMMON_BLOCK", block, raising=False)
    rng = random.Random(4)
    stock = [f"s{rng.randrange(10**6)}" for _ in range(30)]
    texts = []
    for i in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 40, 104, 300]))]
        n = len(w) - 4
        run = [f"z{rng.randrange(10**6)}" for _ in range(n // 4)]
        cut = n - -(-4 * n // 5)
        twin = [w + run, run + w, w[: len(w) - cut], w[cut:], w[: len(w) // 2] + run[: max(0, len(run) - 5)] + w[len(w) // 2 :]][i % 5]
        tail = stock if i % 2 else []
        texts += [w + tail, twin + tail]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(rows).collect()}
    near = [len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, 80, 2)]
    assert sum(near) >= 25
    assert found == {i: i - 1 if i % 2 and near[i // 2] else i for i in range(80)}


def groups_of(texts, words=5, similarity=0.8):
    """The least number that near texts reach, all pairs compared."""
    sets = [{" ".join(t.split()[i : i + words]) for i in range(max(1, len(t.split()) - words + 1))} for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("star", [1024, 4])
def test_large_groups_are_joined_part_by_part(spark, monkeypatch, star):
    monkeypatch.setattr(simhash, "STAR", star)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(rows).collect()} == groups_of(texts)


def test_pairs_of_few_and_of_many_rows_are_equal(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    test_large_groups_are_joined_part_by_part(spark, monkeypatch, 8)


def test_no_cut_or_grown_copy_is_missed(spark):
    rng = random.Random(7)
    texts = []
    for size, kept in [(124, 100), (9, 8), (20, 17), (498, 400), (450, 400), (420, 400), (60, 49)]:
        for i in range(60):
            w = [f"w{rng.randrange(10**7)}" for _ in range(size)]
            texts += [" ".join(w), " ".join((w[:kept], w[-kept:])[i % 2])]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(near) > 300
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(rows).collect()} == {i: i - 1 if i % 2 and near[i // 2] else i for i in range(len(texts))}


def test_parities_differ_in_no_more_than_the_sets_do():
    rng = np.random.default_rng(4)
    for n, m, shared in [(0, 5, 0), (400, 420, 390), (3000, 700, 600), (5000, 5000, 0), (511, 513, 500)]:
        pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:shared], pool[n : n + m - shared]])
        apart = simhash.parities_apart(simhash.parity_bits(a), simhash.parity_bits(b))
        assert apart <= n + m - 2 * shared and apart == simhash.parities_apart(simhash.parity_bits(b), simhash.parity_bits(a))
        # sets without much in common are told apart
        assert shared or not n or apart > 0.25 * min(n, m)


def test_rows_are_judged_by_their_own_texts(spark):
    rng = random.Random(1)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(2))
    rows = [(2, a), (5, a), (5, b), (7, b + " x"), (7, b + " x"), (None, b), (None, ""), (8, None), (8, None)]
    out = [(r["doc_id"], r["group_id"], r["stays"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(out, key=str) == sorted([(2, 2, True), (5, 2, False), (5, 5, True), (7, 5, False), (7, 5, False), (None, 5, False), (None, 8, False), (8, 8, True), (8, 8, True)], key=str)


def test_components_of_a_path_a_star_and_rubbish(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(200, 100 + i) for i in range(50)] + [(7, None), (None, 3), (9, 9), (300, 300)]
    out = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(51), 0), **dict.fromkeys([*range(100, 150), 200], 100)}


def test_restore_undoes_disguises(spark):
    text = "the idiot is a moron and a loser and stupid trash people say idiot and moron " * 30
    model = toxicity.language_model(spark.createDataFrame([(text,)], "text string"))
    for token in ("1d10t", "i.d.i.o.t", "idiiiiot", "id1ot", "m0r0n", "l-o-s-e-r", "5tup1d", "tr@sh", "$tupid"):
        assert toxicity.restore(token, model) in ("idiot", "moron", "loser", "stupid", "trash"), token
    assert "idiot" in toxicity.readings("you i d i o t !", model)
    assert "idiot" in toxicity.readings("You IDIOT!!!", model)
    assert toxicity.readings("", model) == set() and toxicity.readings("12 555-0100", model) == set()


def test_blanks_and_separators_are_noise_or_edges(spark):
    text = "you are a moron and you stupid idiot keep that worthless trash in a river of stone said the man to me " * 30
    model = toxicity.language_model(spark.createDataFrame([(text,)], "text string"))
    cases = {"you are a m o r o n": "moron", "y o u s t u p i d": "stupid", "you,idiot": "idiot", "worthless/trash": "trash", "i  d  i  o  t": "idiot", "i. d. i. o. t.": "idiot", "a mo ron": "moron", "1 d 1 0 t": "idiot", "river" * 14 + ",1d10t": "idiot", "mo\nron": "moron"}
    for shown, word in cases.items():
        assert word in toxicity.readings(shown, model), (shown, toxicity.readings(shown, model))
    assert toxicity.readings("the man said to me", model) == {"the", "man", "said", "to", "me"}


def test_viterbi_takes_the_best_of_all_paths(spark):
    model = toxicity.language_model(spark.createDataFrame([("you are a moron and you stupid idiot keep that trash " * 5,)], "text string"))
    size = toxicity.SYMBOLS

    def scores(text):
        """All paths' scores by brute force."""
        paths = [((0, 0), 0.0)]
        for i in range(len(text)):
            options, skip, edge = toxicity.arcs(text, i)
            grown = [(s, v + skip) for s, v in paths] if skip is not None else []
            for (a, b), v in paths:
                grown += [((b, c), v + cost + model[(a * size + b) * size + c]) for _, c, cost in options]
                if edge is not None:
                    grown.append((((b, 0), v + edge + model[(a * size + b) * size]) if b else ((a, 0), v + edge)))
            paths = grown
        return [v + model[(a * size + b) * size] if b else v for (a, b), v in paths]

    rng = random.Random(3)
    for text in ["1d10t", "m o r", "a mo r0n", "i.d!", "tt 1|", *("".join(rng.choice("id10t mo.!|") for _ in range(8)).strip() for _ in range(40))]:
        if text:
            assert abs(toxicity.best_path(text, model)[0] - max(scores(text))) < 1e-9, text


def test_disguised_words_score_like_plain_ones(spark):
    rng = random.Random(1)
    words = "river stone paper light morning water garden letter window".split()
    rows = [(i, " ".join(rng.choices(words, k=20) + (["idiot"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(120)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    probe = spark.createDataFrame([(1, "river 1d1ot stone"), (2, "river stone garden"), (3, "i d i o t river"), (4, None)], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(probe, model).collect()}
    assert s[1] > 0.5 and s[3] > 0.5 and s[2] < 0.3 and s[4] < 0.3
    clash = toxicity.scored_rows(probe.selectExpr("doc_id", "text", "'x' AS score"), model).collect()
    assert {r["doc_id"]: r["score"] for r in clash} == s


def test_second_letters_go_where_the_lattice_drops_them(spark):
    model = toxicity.language_model(spark.createDataFrame([("all summer the letters of the committee were in the trash with the rest of the books and apples " * 5,)], "text string"))
    for word in ("trrash", "traash", "trash", "letters", "summer", "apples", "ttrash", "trashh", "books", "bookks", "iidiott"):
        found = toxicity.undoubled(word, model)
        assert found == toxicity.restore(word, model).replace(" ", ""), (word, found, toxicity.restore(word, model))
    assert toxicity.undoubled("trrash", model) == "trash" and toxicity.undoubled("letters", model) == "letters"


def test_features_of_rare_toxic_labels_count_by_their_odds(spark):
    rng = random.Random(2)
    words = "river stone paper light morning water garden letter window".split()
    rows = [(i, " ".join(rng.choices(words, k=20)) + f" n{i}" + (" idiot" if i % 50 == 0 or i % 25 == 1 else ""), int(i % 50 == 0)) for i in range(1500)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert model["values"]["=idiot"] > 2 and "=river" not in model["values"]


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_comes_from_positives_and_unlabelled_scores(share):
    rng = np.random.default_rng(1)
    y = rng.random(6000) < share
    unlabelled = rng.normal(0, 1, 6000) + np.where(y, 2.0, -2.0)
    positive = rng.normal(2.0, 1, 3000)
    assert abs(fit.class_prior(positive, unlabelled) - share) < 0.05


def test_quality_never_uses_labels_of_zero(spark):
    from strandwork.llm import quality

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    assert quality.fit_quality(docs, labels.filter("quality = 1"))["prior"] == model["prior"]
    assert abs(model["prior"] - labels.agg(F.avg("quality")).first()[0]) < 0.1


def test_pu_risk_separates_without_negatives():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.7
    x = rng.normal(0, 1, (4000, 5)) + np.where(y, 1.5, -1.5)[:, None]
    weights, risk = fit.nonnegative_pu(x[y][:1500], x, 0.7, steps=400)
    score = fit.sigmoid(fit.network(weights, x))
    assert ((score > 0.5) == y).mean() > 0.95 and risk[-1] < risk[0]


def placed(key, tree):
    """A key's region, rack and shard, one draw after the other."""
    import math
    import struct

    from xxhash import xxh64_intdigest

    seed, node = xxh64_intdigest(struct.pack("<q", key), 42), ()
    for level in range(3):
        weights = {}
        for t in tree:
            path = (t.region, t.rack, t.shard)
            if path[:level] == node and t.weight > 0:
                weights[path[level]] = weights.get(path[level], 0) + t.weight
        hashes = {c: xxh64_intdigest(struct.pack("<i", c), xxh64_intdigest(struct.pack("<Q", seed), 42)) for c in weights}
        child = min(weights, key=lambda c: -math.log(((hashes[c] >> 11) + 0.5) / 2**53) / weights[c])
        seed, node = hashes[child], (*node, child)
    return node


def test_descent_equals_brute_force_and_moves_stay_in_changed_subtrees(spark):
    keys = spark.range(4000)
    tree = [sharding.Shard(s // 8, s // 4 % 2, s, 1 + s % 3) for s in range(16)]
    changed = {2.0: "b", 0.5: "c", 0.0: "d"}
    trees = {"a": tree, **{n: [sharding.Shard(t.region, t.rack, t.shard, t.weight * (f if t.shard == 5 else 1)) for t in tree] for f, n in changed.items()}, "e": [*tree, sharding.Shard(2, 0, 16, 2.0)]}
    rows = [{n: tuple(r[n]) for n in trees} | {"id": r["id"]} for r in keys.select("id", *(sharding.tree_place(F.col("id"), t).alias(n) for n, t in trees.items())).collect()]
    for r in rows[:600]:
        assert all(r[n] == placed(r["id"], t) for n, t in trees.items())
    for n in "bcd":
        moved = [r for r in rows if r["a"] != r[n]]
        # shard 5 is in rack 1 of region 0: what moves, goes into (or out of) it, its rack or its region
        into, out = (n, "a") if n == "b" else ("a", n)
        assert moved and all(r[into][0] == 0 for r in moved)
        assert all(r[into][1] == 1 for r in moved if r[out][0] == 0) and all(r[into][2] == 5 for r in moved if r[out][:2] == (0, 1))
    assert {r["e"][2] for r in rows if r["a"] != r["e"]} == {16} and all(r["d"][2] != 5 for r in rows)
    share = np.bincount([r["a"][2] for r in rows], minlength=16) / 4000
    want = np.array([t.weight for t in tree]) / sum(t.weight for t in tree)
    assert np.abs(share - want).max() < 0.02
    with pytest.raises(ValueError, match="weights"):
        sharding.tree_place(F.col("id"), [sharding.Shard(0, 0, 0, 0.0)])


def test_weighted_samples_collide_as_often_as_sets_are_alike(spark):
    rows = [(1, t, 2.0, 1.0) for t in range(20)] + [(1, t, 0.5, None) for t in range(20, 40)] + [(1, t, None, 3.0) for t in range(40, 50)]
    out = cws.weighted_samples(spark.createDataFrame(rows, "g long, term long, a double, b double"), ["g"], ["a", "b"], samples=900).first()
    same = np.mean(np.array(out["a"]) == np.array(out["b"]))
    assert abs(same - 20 / (40 + 10 + 30)) < 0.05


def test_predecessors_across_parts(spark):
    ids = spark.createDataFrame([(k, k + 1) for k in [9, 3, 3, 7, 1, 20, -5]], "key long, n long")
    out = {r["key"]: (r["prev"], r["prev_n"]) for r in cws.predecessors(ids, rows_each=2).collect()}
    assert out == {-5: (20, 21), 1: (-5, -4), 3: (1, 2), 7: (3, 4), 9: (7, 8), 20: (9, 10)}


def test_mixing_tells_domains_by_any_letter(spark):
    rows = [(i, f"fox vina gala {'ab'[i % 2]} " * 5, "a") for i in range(20)] + [(30 + i, f"jormp broo dyl {'ab'[i % 2]} " * 5, "b") for i in range(20)] + [(60 + i, f"лес река {'ab'[i % 2]} " * 5, "c") for i in range(20)]
    rows += [(100, "vanilla", None), (101, "romp", None), (102, "река", None)]
    rates, mix = mixing.mix_rates(mixing.domain_features(spark.createDataFrame(rows, "doc_id long, text string, lang string")), {"a": 1.0, "b": 1.0, "c": 1.0})
    found = {r["id"]: r["posterior"] for r in rates.collect()}
    assert mix.domains == ["a", "b", "c"] and found[100][0] > 0.6 and found[101][1] > 0.6 and found[102][2] > 0.6


def test_rates_equal_brute_force_and_labels_are_not_their_own_evidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    targets = {"en": 0.6, "fr": 0.2, "de": 0.2}
    rates, mix = mixing.mix_rates(mixing.domain_features(docs), targets)
    found = {r["id"]: r for r in rates.collect()}
    texts = {r["doc_id"]: ((r["text"] or "").lower(), r["lang"]) for r in docs.collect()}
    count = lambda t: np.array([*(t.count(c) for c in mixing.LETTERS), sum(len(c.encode()) - 1 for c in t if c not in mixing.LETTERS), sum(c not in mixing.LETTERS for c in t)], float)
    keys = sorted(texts)
    x = np.array([count(texts[k][0]) for k in keys])
    n = np.array([len(texts[k][0].split()) for k in keys], float)
    fold = np.array([r[1] for r in sorted((r["doc_id"], r["f"]) for r in docs.selectExpr("doc_id", "pmod(xxhash64(md5(lower(coalesce(text, '')))), 2) AS f").collect())])
    name = np.array([texts[k][1] if texts[k][1] in targets else mixing.REST for k in keys])
    assert mix.domains == sorted({*name})
    p = np.zeros((len(keys), len(mix.domains)))
    for f in (0, 1):
        counts = np.array([1 + x[(fold != f) & (name == d)].sum(0) for d in mix.domains])
        prior = np.array([0.5 + ((fold != f) & (name == d)).sum() for d in mix.domains])
        logs = np.log(prior / prior.sum()) + mix.temper * x[fold == f] @ np.log(counts / counts.sum(1, keepdims=True)).T
        e = np.exp(logs - logs.max(1, keepdims=True))
        p[fold == f] = e / e.sum(1, keepdims=True)
    assert np.abs(p - np.array([found[k]["posterior"] for k in keys])).max() < 1e-6
    assert [found[k]["n_tokens"] for k in keys] == n.tolist()
    # projected gradient on all rates at once
    weights = np.array([targets.get(d, 0.0) for d in mix.domains])
    sums = n @ p
    total = min(sums[k] / w for k, w in enumerate(weights) if w)
    goal = weights / weights.sum() * total
    scale = np.maximum(goal, total / (100 * len(weights)))
    step = 1 / (np.linalg.eigvalsh((p * n[:, None]).T @ p / np.sqrt(np.outer(scale, scale))).max() + mix.pull)
    r = np.ones(len(keys))
    for _ in range(40):
        miss = ((r * n) @ p - goal) / scale
        if (np.abs(miss) <= 2e-4).all():
            break
        r = np.maximum(0, r - step * (p @ miss + mix.pull * (r - 1)))
    assert np.abs(r - np.array([found[k]["rate"] for k in keys])).max() < 1e-3


def test_mixing_without_labels_or_targets(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    rates, _ = mixing.mix_rates(mixing.domain_features(docs), {"en": 1.0})
    assert [(r["rate"], r["copies"]) for r in rates.collect()] == [(1.0, 1)]
    with pytest.raises(ValueError, match="targets"):
        mixing.mix_rates(mixing.domain_features(docs.withColumn("lang", F.lit("fr"))), {"en": 1.0})


def test_workers_keep_what_one_operator_needs():
    first = common.kept(("one",), list)
    assert common.kept(("one",), list) is first
    common.forget("two")
    assert common.kept(("one",), list) is not first


def test_stages_drop_what_workers_keep_and_read_less_at_once(spark, docs, monkeypatch):
    ran = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: ran.append(f) or self)
    langid.likelihoods(docs, (["en"], np.zeros((langid.BINS, 1))))
    simhash.word_prints(docs, 5)
    for f in ran:
        common.kept(("one",), list)
        list(f(iter([])))
        assert ("one",) not in common._kept
    packing.token_pieces(docs, tokenizer_path(), 0, 64, bytes_each=2000)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "text": ["the river " * 100] * 10})
    assert len(list(ran[-1](iter([batch])))) == 5


def test_what_workers_keep_is_bounded_by_the_caller(spark, docs, monkeypatch, tmp_path):
    import corpus_pipeline

    letters = toxicity.language_model(docs, "text")
    texts = pa.array([f"word{i} f.o.o{i}" for i in range(200)])
    few, many = toxicity._reader(letters, 5), toxicity.Reader(letters)
    assert all(list(a) == list(b) for a, b in zip(few.read(texts), many.read(texts), strict=True)) and len(few.memo) <= 5 < len(many.memo)
    spare = tokens.encoder(tokenizer_path(), 5)
    assert all((a == b).all() for a, b in zip(spare.encode(texts), tokens.PieceEncoder(tokenizer_path()).encode(texts), strict=True))
    # the pipeline's stages ask for less than the operators alone
    asked = []
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda *args, **given: asked.append(given) or {})
    monkeypatch.setattr(toxicity, "scored_rows", lambda rows, model, **given: asked.append(given) or rows.withColumn(given["score_col"], F.lit(0.0)))
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert len(asked) == 2 and all(x["bytes_each"] < toxicity.READ_BYTES and x["entries"] < toxicity.ENTRIES for x in asked)
