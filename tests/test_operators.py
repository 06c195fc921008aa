import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwork.functions import codec, distance
from strandwork.operators import align, assemble, build, circuits, contract, digraph, generate, kmers, lists, traverse
from strandwork.sources import files
from strandwork.streaming import edges as streaming


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def reads(spark, seqs):
    return files.from_list(spark, seqs)


def table(spark, rows, columns="src string, dst string, multiplicity long"):
    return spark.createDataFrame(rows, columns)


def test_distances(spark):
    assert one(spark, distance.levenshtein(F.lit("ACGTT"), F.lit("GT"))) == 3
    assert one(spark, distance.hamming(F.lit("ACG"), F.lit("ATG"))) == 1
    assert one(spark, distance.hamming(F.lit("acg"), F.lit("ATG"))) == 1
    assert one(spark, distance.hamming(F.lit("ACG"), F.lit("AT"))) is None
    assert one(spark, distance.hamming(F.lit(""), F.lit(""))) == 0
    with pytest.raises(Exception, match="one length"):
        one(spark, distance.hamming(F.lit("ACG"), F.lit("AT"), strict=True))
    with pytest.raises(Exception, match="two strings"):
        one(spark, distance.levenshtein(F.lit("A"), F.lit(None).cast("string"), strict=True))
    assert distance.global_alignment("ACGTT", "GT") == (3, "ACGTT\n  | |\n--G-T")
    assert distance.global_alignment("", "GT")[0] == 2


def test_codec(spark):
    assert one(spark, codec.mer_encode(F.lit("GAT"))) == 35
    assert one(spark, codec.mer_encode(F.lit("gat"))) == 35
    assert one(spark, codec.mer_encode(F.lit(""))) == 0
    assert one(spark, codec.mer_encode(F.lit("GNT"))) is None
    assert one(spark, codec.mer_encode(F.lit("A" * 32))) is None
    assert one(spark, codec.mer_decode(F.lit(35), 3)) == "GAT"
    assert one(spark, codec.mer_decode(F.lit(35), 1)) == "T"
    assert one(spark, codec.mer_decode(F.lit(35), 0)) is None
    assert one(spark, codec.merge_overlap(F.lit("ACGT"), F.lit("CGTA"), 3)) == "ACGTA"
    assert one(spark, codec.spell(F.array(F.lit("ACG"), F.lit("CGT"), F.lit("GTT")), 2)) == "ACGTT"
    assert bytes(one(spark, codec.pack(F.lit("ACGTT")))) == bytes([1, 0b00011011, 0b11000000])
    rng = random.Random(1)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in range(40)]
    rows = reads(spark, seqs).select("read_id", "seq", codec.unpack(codec.pack(F.col("seq"))).alias("back"), codec.mer_decode(codec.mer_encode(F.col("seq")), F.length("seq")).alias("mer")).collect()
    for r in rows:
        assert r["back"] == r["seq"]
        assert r["mer"] == (r["seq"] if 1 <= len(r["seq"]) <= 31 else None)


def test_reads(spark):
    r = reads(spark, ["ACGT", "AC", "", "ACN"])
    assert {x["seq"] for x in kmers.only_bases(r).collect()} == {"ACGT", "AC", ""}
    with pytest.raises(Exception, match="not a sequence"):
        kmers.only_bases(r, strict=True).collect()
    assert {x["seq"] for x in kmers.long_enough(r, 3).collect()} == {"ACGT", "ACN"}
    assert [(x["pos"], x["mer"]) for x in kmers.mers(reads(spark, ["ACGT"]), 3).collect()] == [(0, "ACG"), (1, "CGT")]
    assert [tuple(x) for x in kmers.isolated(reads(spark, ["ACG", "TTT", "ATTTA"]), 3).collect()] == [(0, "ACG")]
    assert [tuple(x) for x in kmers.with_ids(kmers.edges(reads(spark, ["GATT"]), 3)).collect()] == [(0, 35, 15, 1)]


def test_degrees_and_flags(spark):
    e = table(spark, [("a", "b", 2), ("b", "c", 1), ("b", "d", 1)])
    found = {r["id"]: r for r in digraph.flags(e).collect()}
    assert (found["b"]["out_deg"], found["b"]["in_deg"], found["b"]["is_branch"]) == (2, 2, True)
    assert found["a"]["is_source"] and not found["a"]["is_branch"] and found["c"]["is_sink"]
    given = spark.createDataFrame([("a",), ("z",)], "id string")
    assert {r["id"]: r["out_deg"] for r in digraph.degrees(e, given).collect()}["z"] is None
    assert {r["id"]: r["out_deg"] for r in digraph.degrees(e, given, compat=True).collect()}["z"] == -1
    assert {r["id"] for r in digraph.no_way_out(digraph.degrees(e, given)).collect()} == {"c", "d", "z"}
    assert {r["id"]: r["tail"] for r in digraph.tails(e).collect()} == {"a": "b", "b": None}


def test_edge_edits(spark):
    e = table(spark, [("a", "b", 2), ("b", "c", 1)])
    gone = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    assert {tuple(r) for r in digraph.remove_edges(e, gone).collect()} == {("a", "b", 1)}
    assert {tuple(r) for r in digraph.add_edges(e, e, multi=False).collect()} == {("a", "b", 1), ("b", "c", 1)}
    w = spark.createDataFrame([(1, 2, 5.0, 1), (1, 2, 3.0, 0)], "src int, dst int, weight float, ordinal int")
    assert [tuple(r) for r in digraph.weighted(w).collect()] == [(1, 2, 3.0)]
    assert digraph.weighted(w, multi=True).count() == 2


def test_vertex_text(spark, tmp_path):
    line = spark.createDataFrame([("7;b;8,9,9;3;",), ("8;t;9;rest;of;it",), ("bad",)], "value string")
    rows = {r["id"]: r for r in digraph.parse_vertex_text(line).collect()}
    assert (rows[7]["to"], rows[7]["from"], rows[7]["payload"]) == ([8, 9, 9], [3], "")
    assert rows[8]["to"] == [9]
    assert {r["id"]: r["to"] for r in digraph.parse_vertex_text(line, multi=False).collect()}[7] == [8, 9]
    v = digraph.vertices(table(spark, [(7, 8, 1), (7, 9, 2), (3, 7, 1)], "src long, dst long, multiplicity long"))
    assert "7;b;8,9,9;3;" in {r["value"] for r in digraph.vertex_text(v).collect()}
    assert "7;t;8,9,9;" in {r["value"] for r in digraph.vertex_text(v, both=False).collect()}
    assert "vertex 7 to [8 9 9] from [3]" in {r["line"] for r in digraph.display(v).collect()}
    digraph.vertex_text(v).write.text(str(tmp_path / "v"))
    again = files.read_vertex_text(spark, str(tmp_path / "v"))
    assert again.count() == 4
    assert {tuple(r) for r in digraph.edges_of_vertices(again).collect()} == {(7, 8, 1), (7, 9, 2), (3, 7, 1)}
    assert {tuple(r) for r in digraph.edges_of_vertices(again.filter("id = 7")).collect()} == {(7, 8, 1), (7, 9, 2), (3, 7, 1)}


def test_coverage_thresholds(spark):
    assert [build.least_multiplicity(c) for c in (1, 2, 3, 6)] == [1, 1, 2, 3]
    assert [build.repeat_multiplicity(c) for c in (1, 2, 3, 6)] == [2, 2, 4, 6]
    e = table(spark, [("a", "b", 1), ("b", "c", 2)])
    assert [r["src"] for r in build.covered(e, 3).collect()] == ["b"]
    assert build.covered(e, None).count() == 2


REPEAT = {("A", "B"): 2, ("B", "C"): 2, ("C", "D"): 6, ("D", "E"): 5, ("E", "G"): 3, ("E", "F"): 3, ("F", "C"): 3}


def test_repeat_and_its_trail():
    found = assemble.rectify(REPEAT, 3, "A")
    assert found == {("A", "B"): 1, ("B", "C"): 1, ("C", "D"): 2, ("D", "E"): 2, ("E", "F"): 1, ("F", "C"): 1, ("E", "G"): 1}
    assert traverse.trails(found) == [list("ABCDEFCDEG")]
    assert traverse.trails(found | {("G", "A"): 1})[0] == list("ABCDEFCDEGA")
    assert assemble.rectify({("x", "y"): 5}, 3, "A") == {("x", "y"): 5}


@pytest.mark.parametrize("seed", range(30))
def test_trails_use_each_edge_as_often_as_it_occurs(seed):
    rng = random.Random(seed)
    edges = {}
    for _ in range(rng.randrange(1, 40)):
        e = rng.randrange(8), rng.randrange(8)
        edges[e] = edges.get(e, 0) + 1
    used, found = {}, traverse.trails(edges)
    for t in found:
        for e in zip(t, t[1:], strict=False):
            used[e] = used.get(e, 0) + 1
    assert used == edges
    balance = {}
    for (u, v), m in edges.items():
        balance[u], balance[v] = balance.get(u, 0) + m, balance.get(v, 0) - m
    reach = lambda v, s: s | {v} if v in s else s  # noqa: E731, F841
    assert len(found) >= max(1, sum(b for b in balance.values() if b > 0))


@pytest.mark.parametrize("seed", range(20))
def test_strong_components(seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(10), rng.randrange(10)): 1 for _ in range(rng.randrange(1, 25))}
    vertices = {v for e in edges for v in e}
    reach = {v: {v} for v in vertices}
    for _ in vertices:
        for u, v in edges:
            for x in vertices:
                if u in reach[x]:
                    reach[x].add(v)
    assert traverse.strong_components(edges) == {v: min(w for w in reach[v] if v in reach[w]) for v in vertices}


@pytest.mark.parametrize(("seqs", "multi", "wanted"), [(["ACGTTGCA"], False, ["ACGTTGCA"]), (["ACGTTG", "GTTGCA"], False, ["ACGTTGCA"]), (["TTGCACGA"], False, ["TTGCACGA"]), (["AAAAA"], False, ["AAAA"]), (["AAAAA"], True, ["AAAAA"]), (["ACGT", "CGTA", "GTAC", "TACG"], False, ["ACGTACG"]), (["ACG"], False, []), (["AC"], False, [])])
def test_assembly(spark, seqs, multi, wanted):
    assert [r["seq"] for r in assemble.assemble_reads(reads(spark, seqs), 3, multi=multi).collect()] == wanted


def test_assembly_facade_and_status(spark, tmp_path):
    found = assemble.assemble_slices(reads(spark, ["GATTACA", "TACAGG", "CATTAG"])).collect()
    assert {r["status"] for r in found} == {"multi_source"}
    gated = assemble.assemble_reads(reads(spark, ["GATTACA", "CATTAG"] * 3), 3, coverage=2).collect()
    assert [(r["seq"], r["status"]) for r in gated] == [(None, "multi_source")]
    files.write_contigs(assemble.assemble_reads(reads(spark, ["ACGTTGCA"]), 3), str(tmp_path / "out"), one_file=True)
    assert [r["seq"] for r in files.read_lines(spark, str(tmp_path / "out")).collect()] == ["ACGTTGCA"]


def test_coverage_assembly_of_a_repeat(spark):
    # TTGTCCATG occurs twice; six whole copies, of seven that are expected, cover it
    seq = "ACAGTGACTTGTCCATGCGGTTGTCCATGATA"
    found = assemble.assemble_reads(reads(spark, [seq] * 6), 7, coverage=7).collect()
    assert [(r["seq"], r["status"]) for r in found] == [(seq, "ok")]


def test_contraction_agrees_with_doubling(spark):
    rng = random.Random(5)
    rows = [(g, f"{u:03d}", f"{v:03d}", rng.randrange(1, 4)) for g in range(4) for u, v in {(rng.randrange(60), rng.randrange(60)) for _ in range(45)}]
    rows += [(9, f"{i:03d}", f"{i + 1:03d}", 2) for i in range(100)] + [(8, f"{i:03d}", f"{(i + 1) % 7:03d}", 1 + i) for i in range(7)] + [(7, "001", "001", 3)]
    e = table(spark, rows, "group_key int, src string, dst string, multiplicity long")
    for match in (False, True):
        a = sorted(map(tuple, traverse.contract(e, match).select("group_key", "head", "tail", "vertices", "multiplicity", "n_vertices").collect()), key=str)
        b = sorted(map(tuple, contract.contract(e, match).select("group_key", "head", "tail", "vertices", "multiplicity", "n_vertices").collect()), key=str)
        assert a == b


def test_chains_of_a_line():
    assert traverse.chains_of({("a", "b"): 3, ("b", "c"): 2}) == [{"head": "a", "vertices": ["a", "b"], "tail": "c", "multiplicity": 2}, {"head": "c", "vertices": ["c"], "tail": None, "multiplicity": None}]
    assert [c["vertices"] for c in traverse.chains_of({("a", "b"): 3, ("b", "c"): 2}, must_match=True)] == [["a"], ["b"], ["c"]]


CONTIGS = ["AGTGGCAC", "CACGAAG", "AAG", "ATT", "TTCCGGT", "GTGATAT", "CACA", "AAGCACTATTAGTTCGTTT"]


def test_window_alignment_is_the_leftmost_best(spark):
    rng = random.Random(2)
    main = "".join(rng.choices("ACGT", k=40))
    rows = spark.createDataFrame([(0, i, c, main) for i, c in enumerate([*CONTIGS, "", main[:39]])], "group_key int, ordinal int, contig string, main string")
    found = {r["contig"]: (r["distance"], r["offset"]) for r in align.window_align(rows).collect()}
    for c in CONTIGS:
        assert found[c] == min((sum(x != y for x, y in zip(c, main[o:], strict=False)), o) for o in range(41 - len(c)))
    laid = {r["contig"]: r for r in align.layout(rows).collect()}
    assert laid[main[:39]]["mode"] == "pairwise" and laid[main[:39]]["distance"] == 1 and "" not in laid
    text = align.render(rows).first()["text"].split("\n")
    assert text[0] == main and text[-1].strip() in ("ATT", "AAG")


def test_later_contigs_keep_their_own_offset(spark):
    rows = spark.createDataFrame([(0, 0, "ACGTACGTA", "ACGTACGTAC"), (0, 1, "GTA", "ACGTACGTAC")], "group_key int, ordinal int, contig string, main string")
    assert {r["contig"]: r["offset"] for r in align.layout(rows).collect()}["GTA"] == 2


def test_generated_sequences(spark):
    seq = generate.one_sequence(spark, 50, 50, 0, 0, 9, 3).first()["seq"]
    assert (seq.count("A"), seq.count("C"), seq.count("T"), seq.count("G")) == (4, 4, 0, 1)
    assert generate.one_sequence(spark, 25, 25, 25, 25, 80, 3).first()["seq"] != generate.one_sequence(spark, 25, 25, 25, 25, 80, 4).first()["seq"]
    with pytest.raises(Exception, match="add up to 100"):
        generate.one_sequence(spark, 50, 50, 50, 0, 9, 3).collect()
    assert {r["x"] for r in spark.range(50).select(generate.random_int(2, 4, 1).alias("x")).collect()} == {2, 3, 4}


@pytest.mark.parametrize("merge_tail", [True, False])
def test_pieces_tile_the_sequence(spark, merge_tail):
    rng = random.Random(7)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (0, 1, 4, 5, 9, 60, 61, 200)]
    s = spark.createDataFrame([(i, x) for i, x in enumerate(seqs)], "group_key long, seq string")
    rows = generate.split_reads(s, 5, 9, 3, seed=1, merge_tail=merge_tail).orderBy("group_key", "copy", "read_id").collect()
    for g, seq in enumerate(seqs):
        for copy in range(3):
            pieces = [r["seq"] for r in rows if (r["group_key"], r["copy"]) == (g, copy)]
            assert "".join(pieces) == seq
            assert all(5 <= len(p) <= 9 for p in pieces[:-1])
            if merge_tail and len(seq) >= 5:
                assert 5 <= len(pieces[-1]) <= 13
    with pytest.raises(ValueError, match="low"):
        generate.split_reads(s, 0, 3, 1)


def test_files(spark, tmp_path):
    e = kmers.edges(reads(spark, ["ACGTTGCA", "ACGTA"]), 3)
    files.write_kinds(build.partition_kinds(e), str(tmp_path / "kinds"))
    again = files.read_vertices(spark, str(tmp_path / "kinds"))
    assert {r["kind"] for r in again.collect()} == {"branch", "chain"}
    files.write_vertices(digraph.vertices(e), str(tmp_path / "v"))
    assert files.read_vertices(spark, str(tmp_path / "v")).count() == digraph.degrees(e).count()


def test_streaming_counts_equal_batch_counts(spark, tmp_path):
    rows = reads(spark, ["ACGTTGCA", "ACGTA", "TTGCACGA"])
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.to_memory(streaming.count_edges(stream, 3), "edge_counts", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("edge_counts").collect()} == {tuple(r) for r in kmers.edges(rows, 3).collect()}


def test_streaming_counts_in_folders(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.txt").write_text("ACGTA\nACG\n")
    (folder / "b.txt").write_text("ACGT\n")
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).format("text").load(str(folder)).select(F.lit(0).cast("long").alias("group_key"), F.lit(0).alias("read_id"), F.col("value").alias("seq"))
    run = streaming.to_folder(streaming.count_edges(lines, 2), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    found = streaming.latest(spark, f"file://{tmp_path}/out")
    want = kmers.edges(reads(spark, ["ACGTA", "ACG", "ACGT"]), 2)
    assert sorted((r["src"], r["dst"], r["multiplicity"]) for r in found.collect()) == sorted((r["src"], r["dst"], r["multiplicity"]) for r in want.collect())


def test_vertex_text_runs_over_a_whole_graph(spark):
    folder = "/root/testdata/sf0.001"
    pairs = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("stack(2, l_partkey, l_suppkey) AS id").distinct()
    from strandwork.plans import catalogue

    assert catalogue.QUERIES["vertex_text"](spark, folder).count() == pairs.count() > 50


def random_edges(seed, n, m):
    rng = random.Random(seed)
    out = {}
    for _ in range(m):
        e = rng.randrange(n), rng.randrange(n)
        out[e] = out.get(e, 0) + 1
    return out


@pytest.mark.parametrize("seed", [1])
def test_large_groups_go_by_joins_and_give_the_same(spark, seed):
    groups = {0: random_edges(seed, 14, 16), 1: random_edges(seed + 10, 8, 6), 2: {(i, i + 1): 2 for i in range(9)}, 3: {(i, (i + 1) % 5): 1 for i in range(5)}}
    rows = spark.createDataFrame([(g, u, v, m) for g, e in groups.items() for (u, v), m in e.items()], "group_key long, src long, dst long, multiplicity long")
    one = rows.filter("group_key = 0").drop("group_key")
    for f, edges in ((traverse.components, one), (traverse.contract, rows), (traverse.contract, one), (lambda e, **kw: traverse.contract(e, must_match=True, **kw), rows)):
        small, large = (sorted(map(tuple, f(edges, most=most).collect()), key=repr) for most in (10**6, 5))
        assert small == large


def closed_edges(seed, n, walks):
    """Closed walks, so that as many edges lead into each vertex as out of it."""
    rng, out = random.Random(seed), {}
    for _ in range(walks):
        walk = [rng.randrange(n) for _ in range(rng.randrange(1, 7))]
        for e in zip(walk, [*walk[1:], walk[0]], strict=True):
            out[e] = out.get(e, 0) + 1
    return out


def steps_of(trails, keyed=True):
    """How often each edge is taken, and the trails by group and number."""
    at, walked = {}, {}
    for r in trails.collect():
        at.setdefault((r["group_key"] if keyed else 0, r["path_id"]), {})[r["pos"]] = r["id"]
    found = {k: [x[i] for i in range(len(x))] for k, x in at.items()}
    for (g, _), v in found.items():
        for step in zip(v, v[1:], strict=False):
            walked[g, *step] = walked.get((g, *step), 0) + 1
    return walked, found


def graphs(seed):
    """Random graphs, closed ones, chains, cycles and loops, as groups."""
    groups = {0: random_edges(seed, 14, 16), 1: closed_edges(seed, 9, 4), 2: {(i, i + 1): 2 for i in range(9)}, 3: {(i + 4, (i + 1) % 5 + 4): 3 for i in range(5)}, 4: {(7, 7): 2, (1, 2): 1, (2, 1): 1}}
    # a closed graph whose least vertex lies inside a chain
    return groups | {5: {(9, 3): 1, (3, 9): 2, (9, 1): 1, (1, 9): 1, (9, 9): 1, (9, 4): 1, (4, 3): 1}, 6: closed_edges(seed + 1, 40, 7)}


def test_trails_do_not_depend_on_how_large_a_group_may_be(spark):
    groups = graphs(3)
    rows = spark.createDataFrame([(g, u, v, m) for g, e in groups.items() for (u, v), m in e.items()], "group_key long, src long, dst long, multiplicity long")
    small, large = (sorted(map(tuple, traverse.euler_paths(rows, most=most).collect())) for most in (10**6, 1))
    assert small == large
    walked, _ = steps_of(traverse.euler_paths(rows))
    assert walked == {(g, *e): m for g, es in groups.items() for e, m in es.items()}
    assert traverse.trails({("AAC", "ACC"): 1, ("ACC", "CCA"): 2, ("CCA", "CAA"): 1, ("CAA", "AAC"): 1, ("CCA", "CAC"): 1, ("CAC", "ACC"): 1})[0][0] == "AAC"
    texts = ["AACCTACAACC", "CAGTCAGACAG", "TTTTTTT", "GATCGATCGAT"]
    reads_ = spark.createDataFrame([(g, 0, t) for g, t in enumerate(texts)], "group_key long, read_id long, seq string")
    small, large = (sorted(map(tuple, assemble.assemble_reads(reads_, 3, most=most).collect())) for most in (10**6, 1))
    assert small == large


@pytest.mark.parametrize("seed", [5])
def test_trails_by_joins_use_every_edge_in_as_few_trails(spark, monkeypatch, seed):
    # short lists would do without rulers
    monkeypatch.setattr(lists, "SHORT", 20)
    groups = graphs(seed)
    rows = spark.createDataFrame([(g, u, v, m) for g, e in groups.items() for (u, v), m in e.items()], "group_key long, src long, dst long, multiplicity long")
    walked, found = steps_of(circuits.euler_trails(rows))
    assert walked == {(g, *e): m for g, es in groups.items() for e, m in es.items()}
    _, sequential = steps_of(traverse.euler_paths(rows))
    assert set(found) == set(sequential)
    for g, e in groups.items():
        ends = lambda trails: sorted((v[0], v[-1]) for (k, _), v in trails.items() if k == g and v[0] != v[-1])
        assert [a for a, _ in ends(found)] == [a for a, _ in ends(sequential)] and sorted(b for _, b in ends(found)) == sorted(b for _, b in ends(sequential)), (g, e)
        # a closed trail begins at its least branch, or at its least vertex
        branches = {v for v in {x for s in e for x in s} if len({b for a, b in e if a == v}) > 1 or len({a for a, b in e if b == v}) > 1}
        for v in (v for (k, _), v in found.items() if k == g and v[0] == v[-1]):
            assert v[0] == min(branches & {*v} or v), (g, v)


@pytest.mark.parametrize("short", [1 << 20, 20])
def test_trails_of_reads_go_over_a_row_a_read(spark, monkeypatch, short):
    rng, rows = random.Random(short), []
    monkeypatch.setattr(lists, "SHORT", short)
    # a read of several pieces, circles, copies, reads without an edge, and letters that make parts of their own
    monkeypatch.setattr(kmers, "PIECE", 40)
    seqs = ["".join(rng.choices("ACG", k=rng.randrange(30))) for _ in range(40)] + ["T" * 50, "TTTTT", "ACG", "", "".join(rng.choices("ACGT", k=300))]
    circle = "GATTAGATCCATGGATT"
    given = reads(spark, [*seqs, circle + circle[:3], seqs[1], seqs[1]])
    plain = circuits.stored
    monkeypatch.setattr(circuits, "stored", lambda df, tag: rows.append(out := plain(df, tag)) or out)
    sizes = []
    monkeypatch.setattr(circuits, "drop_paths", lambda spark, paths: sizes.extend(spark.read.parquet(r.stored_path).count() for r in rows))
    out = circuits.euler_walks(given, 3)
    trails = {}
    for r in sorted(out.collect()):
        path = trails.setdefault(r["path_id"], r["seq"][:3] if r["pos"] == 0 else None)
        # a piece begins where the one before ends
        assert len(path) == r["pos"] + 3 and path[-3:] == r["seq"][:3] and len(r["seq"]) > 3
        trails[r["path_id"]] = path + r["seq"][3:]
    walked = Counter(t[i : i + 4] for t in trails.values() for i in range(len(t) - 3))
    edges = kmers.edges(given, 3, grouped=False)
    assert walked == Counter({r["src"] + r["dst"][-1]: r["multiplicity"] for r in edges.collect()})
    fewest = {}
    for r in traverse.euler_paths(edges).collect():
        fewest.setdefault(r["path_id"], {})[r["pos"]] = r["id"]
    ends = lambda found: (len(found), sorted(a for a, b in found if a != b), sorted(b for a, b in found if a != b))
    assert ends([(t[:3], t[-3:]) for t in trails.values()]) == ends([(t[0], t[max(t)]) for t in fewest.values()])
    # before, tables had a row for each edge as often as it occurs
    assert max(sizes) < 300 < sum(walked.values())


def test_copies_come_in_steps(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1024), ("d", 2500)], "k string, m long")
    out = circuits._copies(rows, "m").groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("d"), F.max("copy").alias("x")).collect()
    assert {tuple(r) for r in out} == {("b", 1, 1, 0), ("c", 1024, 1024, 1023), ("d", 2500, 2500, 2499)}


def test_orbits_places_and_forests(spark, monkeypatch):
    monkeypatch.setattr(lists, "SHORT", 15)
    rng = random.Random(4)
    to = list(range(300))
    rng.shuffle(to)
    # a long cycle, fixed points and short ones without a ruler among them
    rows = [(i, t, i) for i, t in enumerate(to)] + [(1000, 1000, 5), (1001, 1002, 9), (1002, 1001, 8)]
    found = {r["id"]: r["orbit"] for r in lists.orbits(spark.createDataFrame(rows, "id long, to long, low long")).collect()}
    step, low = {i: t for i, t, _ in rows}, {i: x for i, _, x in rows}
    for i in step:
        cycle, v = [i], step[i]
        while v != i:
            cycle.append(v)
            v = step[v]
        assert found[i] == min(low[x] for x in cycle)
    heads = sorted(rng.sample(range(300), 6))
    order = [i for i in range(300)]
    rng.shuffle(order)
    rows, want, cut = [], {}, sorted(rng.sample(range(1, 300), 5))
    for a, b in zip([0, *cut], [*cut, 300], strict=True):
        at = 0
        for k in range(a, b):
            far = rng.randrange(1, 5)
            at = 0 if k == a else at + far
            rows.append((order[k], None if k == a else order[k - 1], far))
            want[order[k]] = (order[a], at)
    assert heads and {r["id"]: (r["first"], r["at"]) for r in lists.places(spark.createDataFrame(rows, "id long, before long, far long")).collect()} == want
    links = [(k, rng.randrange(60), rng.randrange(60)) for k in range(70)]
    chosen, roots = lists.forest(spark.createDataFrame(links, "id long, a long, b long"))
    parent = {v: v for _, a, b in links for v in (a, b)}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    kruskal = set()
    for k, a, b in links:
        if root(a) != root(b):
            kruskal.add(k)
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r["id"] for r in chosen.collect()} == kruskal and {r["id"]: r["root"] for r in roots.collect()} == {v: root(v) for v in parent}


def test_short_lists_are_one_tasks_and_the_same_as_by_rounds(spark, monkeypatch):
    rng, counts = random.Random(9), []
    to = list(range(400))
    rng.shuffle(to)
    cycles = spark.createDataFrame([(7 * i, 7 * t, 1000 - i) for i, t in enumerate(to)], "id long, to long, low long")
    order = rng.sample(range(500), 500)
    chains = spark.createDataFrame([(v, order[i - 1] if i % 90 else None, i % 5) for i, v in enumerate(order)], "id long, before long, far long")
    links = spark.createDataFrame([(500 - k, rng.randrange(-90, 90), rng.randrange(90)) for k in range(200)], "id long, a long, b long")
    plain = lists.stored
    monkeypatch.setattr(lists, "stored", lambda df, tag: counts.append(tag) or plain(df, tag))

    def found():
        counts.clear()
        chosen, roots = lists.forest(links)
        return [sorted(map(tuple, x.collect())) for x in (lists.orbits(cycles), lists.places(chains), chosen, roots)], len(counts)

    short, few = found()
    monkeypatch.setattr(lists, "SHORT", 30)
    rounds, many = found()
    # before, a table for each round
    assert short == rounds and few <= 12 < many


def test_components_of_deep_graphs_take_few_rounds(spark):
    rounds = []
    path = spark.range(100_000).selectExpr("id AS src", "id + 1 AS dst", "1L AS multiplicity")
    found = contract.strong_components(path, progress=lambda number, left: rounds.append(left))
    assert found.count() == 100_001 and found.filter("id <> component").isEmpty() and len(rounds) < 40
    ring = path.unionByName(spark.createDataFrame([(100_000, 7, 1), (50_000, 50_000, 1)], path.schema))
    assert contract.strong_components(ring).groupBy("component").count().filter("count > 1").collect() == [(7, 99_994)]


@pytest.mark.parametrize("seed", [1])
def test_repeats_and_components_by_joins(spark, seed):
    rng, groups = random.Random(seed), {}
    for g in range(6):
        n = rng.choice([6, 20, 50])
        groups[g] = {e: m * rng.randrange(1, 4) for e, m in random_edges(seed * 10 + g, n, int(n * rng.choice([0.8, 1.1, 1.5]))).items()}
    groups[6] = {(i, (i + 1) % 7): 1 for i in range(7)}
    # the source branches at once; a loop that one walk returns to
    groups[7] = {(0, 1): 4, (0, 5): 2, (1, 2): 4, (2, 3): 4, (3, 1): 4, (2, 4): 1, (4, 4): 2}
    rows = spark.createDataFrame([(g, u, v, m) for g, e in groups.items() for (u, v), m in e.items()], "group_key long, src long, dst long, multiplicity long")
    assert sorted(map(tuple, traverse.components(rows, most=1).collect())) == sorted(map(tuple, traverse.components(rows).collect()))
    small, large = (sorted(map(tuple, assemble.rectified(rows, 2, most=most).collect())) for most in (10**6, 1))
    assert small == large
    fixture = spark.createDataFrame([("A", "B", 2), ("B", "C", 2), ("C", "D", 6), ("D", "E", 5), ("E", "G", 3), ("E", "F", 3), ("F", "C", 3)], "src string, dst string, multiplicity long")
    assert {tuple(r) for r in assemble.rectified_by_joins(fixture, 3).collect()} == {("A", "B", 1), ("B", "C", 1), ("C", "D", 2), ("D", "E", 2), ("E", "F", 1), ("F", "C", 1), ("E", "G", 1)}


def as_rows(spark, groups):
    return spark.createDataFrame([(g, u, v, m) for g, e in groups.items() for (u, v), m in e.items()], "group_key long, src long, dst long, multiplicity long")


@pytest.mark.parametrize("f", [contract.strong_components, lambda e: contract.contract(e, must_match=True), lambda e: assemble.rectified_by_joins(e, 2)], ids=["components", "contract", "rectified"])
def test_groups_of_bounded_size_are_settled_before_the_joins(spark, monkeypatch, f):
    # groups of 1 to 60 edges: all settled, some left for the joins, none settled
    rows = as_rows(spark, graphs(8) | {10: random_edges(2, 30, 60)})
    whole = sorted(map(tuple, f(rows).collect()))
    for most in (8, 0):
        monkeypatch.setattr(traverse, "PIECE", most)
        assert sorted(map(tuple, f(rows).collect())) == whole


def test_small_groups_take_no_rounds_and_cycles_few(spark):
    rounds = []
    contract.strong_components(as_rows(spark, graphs(2)), progress=lambda number, left: rounds.append(left)).collect()
    assert not rounds
    # one cycle among many chains of two: before, the doublings that so many rows allow
    pairs = spark.range(20_000).selectExpr("3 * id AS src", "3 * id + 1 AS dst", "1L AS multiplicity")
    ring = spark.createDataFrame([(-1, -2, 1), (-2, -3, 1), (-3, -1, 1)], "src long, dst long, multiplicity long")
    found = contract.contract(pairs.unionByName(ring), progress=lambda number, left: rounds.append(left))
    assert found.filter("head < 0").select("head", "tail", "vertices").collect() == [(-3, -3, [-3, -1, -2])] and len(rounds) < 8


def test_groups_pass_in_parts_of_bounded_size():
    numbers = [n for size in (3, 9, 1, 4, 5) for n in range(1, size + 1)]
    keys = [g for g, size in enumerate((3, 9, 1, 4, 5)) for _ in range(size)]
    for width in (1, 2, 5, 30):
        batches = [pa.RecordBatch.from_pydict({"group_key": keys[i : i + width], "src": numbers[i : i + width], "_number": numbers[i : i + width]}) for i in range(0, len(keys), width)]
        got = [(key.to_pylist()[0], columns[0], whole) for key, columns, whole in traverse._groups(batches, ["src"], 4)]
        assert [(k, c) for k, c, whole in got if whole] == [(0, [1, 2, 3]), (2, [1]), (3, [1, 2, 3, 4])]
        assert [x for k, c, whole in got if not whole for x in c] == [*range(1, 10), *range(1, 6)]
        assert all(len(c) <= 4 + width for _, c, whole in got if not whole)
        assert [(k.to_pylist()[0], len(c[0])) for k, c, _ in traverse._groups(batches, ["src"])] == [(0, 3), (1, 9), (2, 1), (3, 4), (4, 5)]


def test_groups_with_null_ends_are_left_to_the_joins(spark):
    rows = spark.createDataFrame([(1, 2, 3, 1), (1, 3, None, 1), (2, 5, 6, 1)], "group_key long, src long, dst long, multiplicity long")
    found, left = traverse.settled(rows, "id ID, component ID", lambda x: list(traverse.strong_components(x).items()))
    assert sorted(map(tuple, found.collect())) == [(2, 5, 5), (2, 6, 6)] and sorted(map(tuple, left.collect()), key=repr) == sorted([(1, 2, 3, 1), (1, 3, None, 1)], key=repr)


def test_compat_contigs(spark):
    # X11 to X17 of FIXTURES.md
    cases = {1: (["TTGCACGA"], ["ACGAGCAC"]), 2: (["AAAAA"], ["AAAA"]), 3: (["ACGACGT"], ["ACG", "ACGACGA"]), 4: (["GATTACA", "TACAGG", "CATTAG"], ["", "", "TTAC", "", "ACAGTAGTT"]), 5: (["ACGT", "CGTA", "GTAC", "TACG"], ["ACGTACG"]), 6: (["ACG"], []), 7: (["ACGTTG", "GTTGCA"], ["ACGTTGCA"])}
    rows = spark.createDataFrame([(g, i, s) for g, (seqs, _) in cases.items() for i, s in enumerate(seqs)], "group_key long, read_id long, seq string")
    found = {}
    for r in assemble.assemble_slices(rows, compat=True).orderBy("group_key", "contig_id").collect():
        found.setdefault(r["group_key"], []).append(r["seq"])
    assert found == {g: out for g, (_, out) in cases.items() if out}
    assert traverse.compat_trails({(0, 1): 1, (1, 2): 1}) == [[0], [0, 1, 1]]
    intended = {r["group_key"]: r["seq"] for r in assemble.assemble_slices(rows.filter("group_key IN (1, 5)")).collect()}
    assert intended == {1: "TTGCACGA", 5: "ACGTACG"}


def test_windows_by_brute_force(spark):
    rng = random.Random(8)
    for width, length, letters, block in ((1, 1, "ACGT", 8), (3, 40, "ACGT", 8), (5, 70, "acgTé漢", 16), (130, 700, "AC", 64), (150, 150, "ACGT", 64), (200, 1000, "ACGTNRYKM", 256)):
        main = "".join(rng.choices(letters, k=length))
        for contig in ("".join(rng.choices(letters, k=width)), main[length - width :].lower()):
            want = min((sum(a.upper() != b.upper() for a, b in zip(contig, main[o : o + width], strict=True)), o) for o in range(length - width + 1))
            assert align.best_window(align._letters(contig), align._letters(main), block) == (want[1], want[0])
    rows = spark.createDataFrame([(1, 0, "", "ACGT"), (1, 1, "ACGTA", "ACGT"), (1, 2, "gt", "ACGT"), (2, 0, None, "A"), (2, 1, "A", None)], "group_key long, ordinal int, contig string, main string")
    assert [tuple(r) for r in align.window_align(rows).collect()] == [(1, 2, "gt", 2, 0)]


def test_pieces_are_counted_as_they_pass(spark, tmp_path):
    from pyspark.sql import Observation
    from pyspark.sql.streaming import StreamingQueryListener

    rows = reads(spark, ["ACGTACGTACGTACGT" * 4, "ACGTTGCA"]).withColumn("group_key", F.col("read_id"))
    seen = Observation()
    out = generate.split_reads(rows, 5, 9, 3, progress=seen).collect()
    assert seen.get["pieces"] == len(out) and seen.get["bases"] == 3 * 72 and [seen.get[f"copy_{c}"] for c in range(3)] == [sum(r["copy"] == c for r in out) for c in range(3)]
    told = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            if row := event.progress.observedMetrics.get("pieces"):
                told.append((row["pieces"], row["bases"]))

        def onQueryTerminated(self, event):
            pass

    spark.createDataFrame(out).repartition(2).write.parquet(str(tmp_path / "pieces"))
    listener = Listener()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(spark.createDataFrame(out).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pieces"))
        run = generate.observed_pieces(stream, "pieces", 3).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).start()
        run.processAllAvailable()
        run.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert sum(n for n, _ in told) == len(out) and sum(b for _, b in told) == 3 * 72


def test_hubs_come_in_pages(spark):
    rows = spark.range(25_000).selectExpr("0L AS src", "id AS dst", "id % 3 + 1 AS multiplicity").unionByName(spark.createDataFrame([(5, 1, 2), (5, 0, 1)], "src long, dst long, multiplicity long"))
    out = {(r["id"], r["page"]): r["successors"] for r in digraph.adjacency_pages(rows, 1000).collect()}
    assert len(out) == 26 and [tuple(x) for x in out[5, 0]] == [(0, 1), (1, 2)]
    assert [tuple(x) for k in range(25) for x in out[0, k]] == [(i, i % 3 + 1) for i in range(25_000)]


def test_large_assemblies_equal_small_ones(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 12, 14, 60, 200, 400)] + ["ACGGTTACA" * 9, "AAAAAAAAAAAAAAAAAAAA"]
    reads = spark.createDataFrame([(g, 0, s) for g, s in enumerate(texts)], "group_key long, read_id long, seq string")
    pieces = generate.split_reads(reads, 30, 60, 6)
    for source, k1, coverage in ((reads, 6, None), (reads, 3, None), (pieces, 8, 3)):
        small, large = (sorted(map(tuple, assemble.assemble_reads(source, k1, coverage, most=most).collect()), key=repr) for most in (10**6, 3))
        assert small == large


def test_rounds_are_reported_and_edge_columns_merged(spark):
    seen = []
    rows = spark.createDataFrame([(i, i + 1, 1, i, f"e{i}") for i in range(20)], "src long, dst long, multiplicity long, cost long, name string")
    out = contract.contract(rows, progress=lambda number, left: seen.append((number, left)), merge={"cost": F.sum, "name": F.collect_set}).orderBy("head").collect()
    # the sink stays by itself
    assert [(r["head"], r["n_vertices"], r["cost"], len(r["name"] or [])) for r in out] == [(0, 20, sum(range(20)), 20), (20, 1, None, 0)]
    assert [n for n, _ in seen] == list(range(len(seen))) and seen[-1][1] == 0 and len(seen) <= 7


def test_ranges_are_guarded(spark):
    rows = spark.createDataFrame([(0, 3, 1), (4, 1, 1), (-1, 2, 1)], "src long, dst long, multiplicity long")
    assert [tuple(r) for r in digraph.in_range(rows, 4).collect()] == [(0, 3, 1)]
    with pytest.raises(Exception, match="outside"):
        digraph.in_range(rows, 4, strict=True).collect()


def test_numbers_are_dense_and_sources_come_first(spark):
    rows = spark.createDataFrame([(9, 4, 1), (4, 2, 1), (2, 7, 1), (2, 4, 1)], "src long, dst long, multiplicity long").repartition(3)
    assert {r["id"]: r["number"] for r in digraph.renumber(rows).collect()} == {9: 0, 2: 1, 4: 2, 7: 3}
    assert sorted((r["src"], r["dst"]) for r in digraph.renumbered(rows).collect()) == [(0, 2), (1, 2), (1, 3), (2, 1)]
    assert digraph.renumber(rows.limit(0)).count() == 0


def test_slices_of_packed_bases(spark):
    rng = random.Random(3)
    seqs = ["", "A", "ACG", "ACGT", "ACGTA", *("".join(rng.choice("ACGT") for _ in range(n)) for n in range(6, 40))]
    rows = spark.createDataFrame([(s,) for s in seqs], "seq string").select("seq", codec.pack(F.col("seq")).alias("p"))
    for start, length in ((0, 3), (1, 4), (3, 9), (8, 8), (30, 5)):
        got = {r["seq"]: r["x"] for r in rows.select("seq", codec.unpack_slice(F.col("p"), start, length).alias("x")).collect()}
        assert got == {s: s[start : start + length] for s in seqs}


def plain_alignment(a, b):
    cost = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    top, low, i, j = "", "", len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            top, low = a[i] + top, b[j] + low
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            top, low = a[i] + top, "-" + low
        else:
            j -= 1
            top, low = "-" + top, b[j] + low
    return cost[-1][-1], top, low


def test_alignments_equal_the_whole_table(spark):
    rng = random.Random(4)
    pairs = [("", ""), ("A", ""), ("", "AC"), ("kitten", "sitting"), *(("".join(rng.choice("ACGT") for _ in range(rng.randrange(30))), "".join(rng.choice("ACGT") for _ in range(rng.randrange(30)))) for _ in range(150))]
    for a, b in pairs:
        cost, text = distance.global_alignment(a, b)
        lines = text.split("\n")
        assert (cost, lines[0], lines[2]) == plain_alignment(a, b)


def test_tables_are_released(spark):
    from strandwork import shared

    one, two = shared.stored(spark.range(5).toDF("id"), "a"), shared.stored(spark.range(7).toDF("id"), "b", rows=7)
    assert one.count() == 5 and two.count() == 7
    shared.release(one)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND|not exist"):
        spark.read.parquet(one.stored_path)
    assert two.count() == 7 and shared.clear(spark) >= 1


def test_costs_alone_equal_those_of_alignments(spark):
    rng = random.Random(5)
    pairs = [("", ""), ("A", ""), ("ACGT", "AGT"), ("kitten", "sitting"), *(("".join(rng.choices("ACGTé", k=rng.randrange(40))), "".join(rng.choices("ACGT", k=rng.randrange(40)))) for _ in range(300))]
    for a, b in pairs:
        assert distance.edit_cost(a, b) == distance.edit_cost(b, a) == distance.global_alignment(a, b)[0]
    rows = spark.createDataFrame([(0, 0, "ACGTACGTA", "ACGTACGTAC"), (0, 1, None, "A")], "group_key int, ordinal int, contig string, main string")
    laid = align.layout(rows).select("distance")
    assert [r["distance"] for r in laid.collect()] == [1]
    # distances alone find no alignment
    plan = laid._jdf.queryExecution().optimizedPlan().toString()
    assert "pairwise_cost(" in plan and "pairwise(" not in plan


def test_a_text_is_searched_once_and_packed_in_its_length(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (*range(52), 400_003)]
    rows = kmers.normalise(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    some = rows.filter((F.length("seq") >= 0) & (F.length("seq") < 1_000_000))
    assert some._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    began = time.time()
    packed = some.select("seq", codec.pack(F.col("seq")).alias("packed"))
    for r in packed.select("seq", "packed", codec.unpack(F.col("packed")).alias("back"), codec.unpack_slice(F.col("packed"), 5, 7).alias("slice")).collect():
        whole = r["seq"] + "A" * (-len(r["seq"]) % 4)
        assert bytes(r["packed"]) == bytes([len(r["seq"]) % 4, *(sum("ACGT".index(c) << 6 - 2 * k for k, c in enumerate(whole[i : i + 4])) for i in range(0, len(whole), 4))])
        assert r["back"] == r["seq"] and r["slice"] == r["seq"][5:12]
    assert time.time() - began < 60


def test_windows_of_pieces_are_those_of_reads(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(kmers, "PIECE", 70)
    for letters in ("ACGT", "ACGTN", "acé\U0001f600T"):
        data = [(rng.choice([1, 2, None]), i, "".join(rng.choices(letters, k=rng.choice([0, 3, 4, 9, 60, 200])))) for i in range(20)]
        reads = spark.createDataFrame(data, "group_key long, read_id long, seq string")
        for k in (1, 9, 40):
            wanted = Counter((g, s[i : i + k + 1]) for g, _, s in data for i in range(len(s) - k))
            assert {(r[0], r[1] + r[2][-1]): r[3] for r in kmers.edges(reads, k).collect()} == dict(wanted)
            assert Counter(map(tuple, kmers.mers(reads, k).collect())) == Counter((g, i, p, s[p : p + k]) for g, i, s in data for p in range(len(s) - k + 1))
    # repeats of a read leave it once
    again = spark.createDataFrame([(1, 0, "A" * 60)], "group_key long, read_id long, seq string")
    assert [tuple(r) for r in kmers.counted(again, 9, ["group_key"]).collect()] == [(1, "A" * 9, 52)]


def test_pieces_are_cut_where_a_sequence_lies(spark):
    seqs = spark.createDataFrame([(k, "ACGTACGTTGCA" * n) for k, n in ((5, 1), (-3, 40), (70000, 3), (6, 0))] + [(None, "ACGT")], "group_key long, seq string")
    for merge in (True, False):
        found = generate.split_reads(seqs, 5, 15, 3, merge_tail=merge)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
        rows = found.collect()
        assert {r["group_key"] for r in rows} == {5, -3, 70000}
        for k, n in ((5, 1), (-3, 40), (70000, 3)):
            for copy in range(3):
                own = sorted((r for r in rows if r["group_key"] == k and r["copy"] == copy), key=lambda r: r["read_id"])
                assert "".join(r["seq"] for r in own) == "ACGTACGTTGCA" * n and [r["read_id"] for r in own] == list(range(len(own)))
                assert [r["start"] for r in own] == [sum(len(x["seq"]) for x in own[:i]) for i in range(len(own))]


def test_groups_are_whole_whatever_the_batches(spark):
    rows = [(g, f"{i:03d}", f"{i + 1:03d}", 1) for g, n in ((None, 5), (1, 1), (2, 9), (3, 2), (4, 3)) for i in range(n)]
    e = table(spark, rows, "group_key int, src string, dst string, multiplicity long").repartition(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 3, 7, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            found = traverse.per_group(e, "first ID, n bigint", lambda x: [(min(x)[0], len(x))] if len(x) != 2 else [])
            assert sorted(map(tuple, found.collect()), key=str) == [(1, "000", 1), (2, "000", 9), (4, "000", 3), (None, "000", 5)]
            # no call for each group
            assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def grouped_reads(seed):
    """Reads of groups: one of a repeat, one of several reads, long and short ones, one without an edge, nulls."""
    rng = random.Random(seed)
    seqs = [(g, "".join(rng.choices("ACGT" if g % 3 else "AC", k=rng.randrange(60)))) for g in range(25) for _ in range(rng.choice([1, 1, 4]))]
    return [*seqs, (30, "ACGTTGCAACCA"), (31, "AC"), (32, None), (33, "GATTACA" * 9), (33, "CATTAG")]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_windows_leave_a_task_in_small_batches(monkeypatch):
    monkeypatch.setattr(kmers, "BLOCK", 100)
    texts = ["ACGT" * 10] * 20 + ["A" * 300]
    # before, a batch of texts was one batch of windows
    sizes = [len(x) for x in kmers._in_blocks(lambda seq: seq)(iter([pa.array(texts), pa.array([], pa.string())]))]
    assert sum(sizes) == 21 and max(sizes) == 2


def test_walked_edges_are_counted_where_they_are_walked(spark):
    data = grouped_reads(1)
    given = spark.createDataFrame(data, "group_key long, seq string")
    want = Counter((g, s[i : i + 3], s[i + 1 : i + 4]) for g, s in data if s for i in range(len(s) - 3))
    for most in (None, 0):
        assert {tuple(r)[:3]: r[3] for r in traverse.walked_edges(given, 3, 100, most).collect()} == want
    # before, counts, trails and steps were shuffled
    found = traverse.walked_edges(given, 3, 100)
    assert shuffles(found) == 1 and "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    paths = [sorted(map(tuple, x.collect())) for x in (traverse.euler_paths_of_reads(given, 3, 100), traverse.euler_paths(kmers.edges(given, 3), 100))]
    assert paths[0] == paths[1]


def test_small_groups_are_assembled_where_their_bases_are(spark):
    given = spark.createDataFrame(grouped_reads(2), "group_key long, seq string")
    for coverage, multi in ((None, True), (None, False), (3, True)):
        found = assemble.assemble_reads(given, 3, coverage, multi, largest=100)
        rows = lambda x: sorted(map(tuple, x.select("group_key", "contig_id", "seq", "status").collect()), key=str)
        assert rows(found) == rows(assemble.assemble_reads(given, 3, coverage, multi)) != []
        # before, the counts of all windows were shuffled
        assert shuffles(found) == 1 and "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_large_assemblies_of_reads_store_labels_and_no_vertices(spark, monkeypatch):
    data = grouped_reads(3)
    given, tables = spark.createDataFrame(data, "group_key long, read_id long, seq string".replace("read_id long, ", "")), []
    want = sorted(map(tuple, assemble.assemble_reads(given, 3, largest=100).select("group_key", "contig_id", "seq", "status").collect()))
    by_group = Counter((g, s[i : i + 3]) for g, s in data if s for i in range(len(s) - 2))
    plain = traverse.stored
    monkeypatch.setattr(traverse, "stored", lambda df, tag: tables.append(df.columns) or plain(df, tag))
    for piece in (traverse.PIECE, 60, 0):
        monkeypatch.setattr(traverse, "PIECE", piece)
        found = assemble.assemble_large(given, k1=3).select("group_key", "contig_id", "seq", "status")
        assert sorted(map(tuple, found.collect())) == want
        single = {g for g, _ in by_group if max(n for (h, _), n in by_group.items() if h == g) == 1 < sum(n for (h, _), n in by_group.items() if h == g)}
        assert {r["group_key"] for r in assemble.unique_spelling(given, 3).collect()} == single
    # before, chains were stored with their vertices, and edges were counted anew for each step
    assert tables and not any("found_vertices" in columns for columns in tables)
