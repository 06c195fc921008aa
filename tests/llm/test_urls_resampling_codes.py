"""Reputations of hosts, importance resampling and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from strandwork.llm import codes, reputation, resampling
from strandwork.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"


def test_parts_and_rules_of_urls(spark):
    urls = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/", "https://example.com", "ftp://xexample.com/en/", "no address", None, "", "http://é.net/fr/ü?", "x://y://z/a", "http://shop.net?/es/", "//a.net/es/", "https://b.net/es", "https://b.net/es/#/fr/", "http://A.NET\n/es/x"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in reputation.judge(rows, URL_RULES).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(lower)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith(f".{r.host}")) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        assert out[i][:3] == (host, path, best and best.host + best.path), (u, out[i])
        assert out[i][3] == best.verdict if best else out[i][3] in ("allow", "block")


def test_registered_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"), "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "me@x.org:8080": ("x.org", "org"), "10.0.0.1:80": ("10.0.0.1", ""), "": ("", ""), "x.org.": ("x.org", "org")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: (r["domain"], r["suffix"]) for r in reputation.with_domain(rows).collect()} == hosts
    own = reputation.with_domain(rows.limit(1), frozenset({"example.com"})).first()
    assert (own["domain"], own["suffix"]) == ("b.example.com", "example.com")


def shrunk(outcomes):
    """reputations by loops."""
    hosts = {h: [float(n), float(y)] for h, (n, y) in outcomes.items()}
    domain = {h: ".".join(h.split(".")[-2:]) for h in hosts}
    mean = lambda n, y: (y + 0.5) / (n + 1)

    def alike(groups, above):
        over = room = k = 0.0
        for g, (n, y) in groups.items():
            if n > 1:
                p = mean(*above[g])
                over, room, k = over + (y - n * p) ** 2 - n * p * (1 - p), room + n * (n - 1) * p * (1 - p), k + 1
        r = over / room if room else 0.0
        return min(max((max(r, 0.0) * k + reputation.FIRST_ALIKE) / (k + 1), reputation.LEAST_ALIKE), reputation.MOST_ALIKE)

    def summed(groups, name):
        out = defaultdict(lambda: [0.0, 0.0])
        for g, (n, y) in groups.items():
            out[name(g)][0] += n
            out[name(g)][1] += y
        return out

    def less(groups, r):
        return {g: [n / (1 + max(n - 1, 0) * r), y / (1 + max(n - 1, 0) * r)] for g, (n, y) in groups.items()}

    plain = summed(hosts, domain.get)
    rh = alike(hosts, {h: plain[domain[h]] for h in hosts})
    wh = less(hosts, rh)
    domains = summed(wh, domain.get)
    end = lambda d: d.split(".")[-1]
    plain = summed(domains, end)
    rd = alike(domains, {d: plain[end(d)] for d in domains})
    wd = less(domains, rd)
    ends = summed(wd, end)
    total = [sum(x[0] for x in ends.values()), sum(x[1] for x in ends.values())]
    rs = alike(ends, dict.fromkeys(ends, total))
    ws = less(ends, rs)
    everyone = [sum(x[0] for x in ws.values()), sum(x[1] for x in ws.values())]

    def below(m, a, r, n, y):
        prior = a / (a + 1) * (1 - r)
        prior /= 1 - prior
        return (max(y, 0) + prior * m) / (max(n, 0) + prior), max(n, 0) + prior

    out = {}
    for h, (n, y) in hosts.items():
        d, s = domain[h], end(domain[h])
        rest = [max(everyone[k] - ws[s][k], 0) for k in (0, 1)]
        m, a = below(mean(*rest), rest[0] + 1, rs, ends[s][0] - wd[d][0], ends[s][1] - wd[d][1])
        m, a = below(m, a, rd, domains[d][0] - wh[h][0], domains[d][1] - wh[h][1])
        m, a = below(m, a, rh, n, y)
        out[h] = m, m - math.sqrt(19) * math.sqrt(m * (1 - m) / (a + 1))
    return out


def test_reputations_by_brute_force(spark):
    rng = random.Random(2)
    outcomes = {}
    for s in ("com", "net", "org"):
        for d in range(rng.choice([1, 6, 12])):
            bad = rng.betavariate(0.6, 0.9)
            for h in range(rng.choice([1, 3, 7])):
                n = rng.choice([0, 1, 4, 40, 400])
                outcomes[f"h{h}.d{d}{s}.{s}"] = n, sum(rng.random() < bad for _ in range(n))
    rows = spark.createDataFrame([(h, n, y) for h, (n, y) in outcomes.items()] + [("h0.d0com.com", None, None)], "host string, n long, y long")
    wanted = shrunk(outcomes)
    found = {r["host"]: (r["share"], r["bound"]) for r in reputation.reputations(rows).collect()}
    assert set(found) == set(wanted) and all(np.allclose(found[h], wanted[h], atol=1e-9) for h in wanted)


def test_reputation_shrinks_towards_domain_and_suffix(spark):
    rows = [("a.bad.com", 200, 200), ("b.bad.com", 150, 149), ("c.bad.com", 0, 0), ("a.good.com", 300, 2), ("b.good.com", 0, 0), ("x.odd.com", 4, 2), ("new.org", 0, 0)]
    rows += [(f"h{k}.d{k}.com", 50, 50 * (k % 2)) for k in range(10)] + [(f"g{k}.d{k}.com", 50, 50 * (k % 2)) for k in range(10)]
    r = {x["host"]: x for x in reputation.reputations(spark.createDataFrame(rows, "host string, n long, y long")).collect()}
    assert r["a.bad.com"]["bound"] > 0.8 and r["c.bad.com"]["share"] > 0.8 and r["b.good.com"]["share"] < 0.2
    assert r["new.org"]["bound"] < 0.5 and 0.2 < r["new.org"]["share"] < 0.8
    assert r["c.bad.com"]["bound"] < r["a.bad.com"]["bound"]
    pages = [(1, "http://a.bad.com/x"), (2, "http://a.good.com/y"), (3, None)]
    rules = [reputation.rule("block", "net/")]
    assert {x["page_id"] for x in reputation.kept_pages(spark.createDataFrame(pages, "page_id int, url string"), rules).collect()} == {1, 2, 3}


def brute_words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))


def brute_resample(docs, target, longest, buckets, percent, least, seed):
    def grams(text):
        w = brute_words(text)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in grams(x)), Counter(bucket(f) for x in target for f in grams(x))
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for key, x in docs:
        g = grams(x)
        h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(f)] for f in g)
        rows.append((key, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute_words(x)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(order[: percent * len(order) // 100])}
    return {r[0]: (*r[1:4], rank.get(r[0])) for r in rows}


def test_op12_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = {r["doc_id"]: tuple(r)[1:] for r in entry.queries()["op12_importance_resampling"](spark, SF).collect()}
    assert out == brute_resample(docs, target, 1, 10_000, 10, 20, 2024)


@pytest.mark.parametrize(("longest", "frequent"), [(1, 0), (2, 5), (3, 10**6)])
def test_resampling_of_runs_whatever_is_frequent(spark, rows, longest, frequent):
    docs = [(r[0], r[1]) for r in rows]
    target = ["the river and the stone", "paper light under the morning", None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = resampling.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), longest, 500, 30, 5, 7, frequent)
    assert {r["doc_id"]: tuple(r)[1:] for r in out.collect()} == brute_resample(docs, target, longest, 500, 30, 5, 7)


def test_words_of_texts():
    texts = ["Ab1-cd", None, "", "é漢 x", "x", "y z", "\x00a\x7fb", " lead", "end "]
    found, owner = resampling.words(pa.array(texts))
    assert [(int(o), w) for o, w in zip(owner, found.to_pylist(), strict=True)] == [(i, w) for i, t in enumerate(texts) for w in brute_words(t)]
    part = pa.array(texts).slice(3, 3)
    assert resampling.words(part)[0].to_pylist() == ["é漢", "x", "x", "y", "z"]
    assert resampling.words(pa.array([], pa.string()))[0].to_pylist() == []


def test_least_frequent_holds_the_bound(spark):
    rows = spark.createDataFrame([(f"f{i}", n) for i, n in enumerate([1] * 50 + [2] * 20 + [9] * 5 + [1000] * 3)], "feature string, n long")
    for most, held in ((0, 0), (3, 3), (7, 3), (8, 8), (30, 28), (100, 78)):
        assert rows.filter(rows.n >= resampling.least_frequent(rows, most)).count() == held


def exact_nearest(x, entries):
    return np.array([min(range(len(entries)), key=lambda k: (sum((int(a) - int(b)) ** 2 for a, b in zip(r, entries[k], strict=True)), k)) for r in x])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 24), st.integers(1, 20), st.sampled_from([1, 50, 5000, 2**24, 2**25 - 1]))
def test_screened_matches_exact(seed, d, k, size):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-size, size + 1, (k, d))
    # near and exact ties: entries a step apart, rows half way between two of them
    if k > 2:
        entries[1], entries[2] = entries[0], np.clip(entries[0] + rng.integers(-1, 2, d), -size, size)
    x = np.concatenate([rng.integers(-size, size + 1, (20, d)), entries, (entries + entries[::-1]) // 2])
    assert (codes.nearest(x, entries) == exact_nearest(x, entries)).all()


def test_float32_alone_would_be_wrong():
    """A case in which the plain float32 product names the wrong entry."""
    rng = np.random.default_rng(0)
    entries = 2**24 + rng.integers(-3, 4, (16, 8))
    x = 2**24 + rng.integers(-3, 4, (200, 8))
    product = x.astype(np.float32) @ entries.astype(np.float32).T
    plain = ((entries.astype(np.float32) ** 2).sum(1) - 2 * product).argmin(1)
    right = exact_nearest(x, entries)
    assert (codes.nearest(x, entries) == right).all() and (plain != right).any()
    with pytest.raises(ValueError, match="below"):
        codes.nearest(x * 4, entries)


def brute_codes(rows, parts, entries, rounds, scale):
    kept = sorted(((i, v, label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = [[math.floor(scale * c) for c in np.float32(v).astype(float)] for _, v, _ in kept]
    w = len(q[0]) // parts
    cut = [[r[p * w : p * w + w] for p in range(parts)] for r in q]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, book: min(range(len(book)), key=lambda k: (gap(v, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            of = [pick(r[p], books[p]) for r in cut]
            books[p] = [[sum(c) // of.count(k) for c in zip(*(r[p] for r, o in zip(cut, of, strict=True) if o == k), strict=True)] if k in of else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], Counter()
    for (key, _, label), r in zip(kept, cut, strict=True):
        code = [pick(r[p], books[p]) for p in range(parts)]
        error = sum(gap(r[p], books[p][c]) for p, c in enumerate(code))
        out.append((key, "".join(f"{c:02x}" for c in code), error, label))
        by_label[label] += error
    return Counter((k, c, e, by_label[label], digest) for k, c, e, label in out)


def test_op13_by_brute_force(spark, troubled):
    for folder in (troubled, SF):
        rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        out = Counter(map(tuple, entry.queries()["op13_vector_codes"](spark, folder).collect()))
        assert out == brute_codes(rows, 8, 16, 6, 4096)


def test_codes_come_back_as_vectors(spark):
    rng = random.Random(1)
    few = [(i, [rng.uniform(-2, 2) for _ in range(6)]) for i in range(5)]
    frame = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    books = codes.fit_codebooks(frame, parts=3, entries=16)
    assert books.shape == (3, 5, 2)
    for r in codes.decode(codes.encode(frame, books), books).collect():
        # fewer vectors than entries: each is its own entry
        assert r["error"] == 0 and np.abs(np.array(r["vector"]) - r["embedding"]).max() <= 1 / 4096
    with pytest.raises(ValueError, match="equal parts"):
        codes.fit_codebooks(frame, parts=4)
    odd = frame.unionByName(spark.createDataFrame([(9, [1.0])], frame.schema))
    with pytest.raises(Exception, match="components among those"):
        codes.fit_codebooks(odd, parts=3)
