import random

import pytest

WORDS = "the of and river stone paper light under morning water garden letter window silver branch harbour winter candle orchard meadow".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed=3, n=60):
    """Rows with every trouble: null and empty texts, a long one, copies, near copies, repeated rows, null columns, odd white space."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([1, 3, 8, 30, 120, 300]))
        if i % 7 == 0:
            text += " you " + rng.choice(["idiot", "moron", "scum"]) + " " + prose(rng, 20)
        if i % 9 == 4:
            text = " ".join(f"{w}***" for w in text.split())
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), len(text)))
    long = prose(rng, 20_000)
    near = prose(rng, 200)
    for k, text in enumerate([None, "", " \n\t ", long, near, near, near.replace("river", "rivers", 1), "é ü ñ 漢字 🙂\n\nx", "a\x00b\x01 c", "  lead and trail  ", "<|endoftext|> x"]):
        rows.append((1000 + 3 * k, text, None if k % 2 else "en", None if k % 3 else "s0", None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def troubled(spark, rows, tmp_path_factory):
    """A folder of tables with those rows, one of them twice, and extra columns whose names operators use themselves."""
    folder = str(tmp_path_factory.mktemp("troubled"))
    extra = ", ".join(f"{c} string" for c in ("score", "shard", "slot", "fp", "key", "part", "start", "id", "rate", "copies", "n", "component", "sequence_id", "weight", "feature", "row", "rank"))
    full = [(*r, *("x",) * 17) for r in [*rows, rows[5]]]
    spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 4), int(i % 7 == 0)) for i in range(60)] + [(3, 1, 0), (5, None, None), (7000, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(1, "https://a.example.com/x", "<html lang='en'><p>the river and the stone</p></html>"), (2, None, None), (3, "", ""), (4, "no address", "<html><script>x</script></html>"), (1, "https://a.example.com/x", "<html lang='en'><p>the river and the stone</p></html>")]
    pages += [(5, "HTTP://User@B.Example.co.uk:80?q#f", None), (6, "://example.net/es/", "")]
    spark.createDataFrame([(*p, *("x",) * 4) for p in pages], "page_id long, url string, html string, host string, rule string, verdict string, bound string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, "the river and the stone", "x"), (2, None, "x"), (3, "", "x"), (1, "the river and the stone", "x")], "item_id long, text string, n string").write.parquet(f"{folder}/benchmark.parquet")
    rng = random.Random(4)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(16)]
    vectors = [(i, vector(), i % 3 if i % 4 else None, "x") for i in range(30)]
    vectors += [vectors[3], (3, vector(), 1, "x"), (40, [0.0] * 16, None, "x"), (None, vector(), 2, "x"), (50, None, 1, "x"), (51, [*vector()[:15], None], 1, "x"), (52, [*vector()[:15], float("nan")], 1, "x"), (53, [float("-inf"), *vector()[:15]], 1, "x")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, code string").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def nothing(spark, troubled, tmp_path_factory):
    """The same tables without a row."""
    folder = str(tmp_path_factory.mktemp("nothing"))
    for t in ("documents", "labels", "pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{troubled}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder
