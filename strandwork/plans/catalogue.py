"""Named queries of the engine and the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.functions import codec, distance
from strandwork.operators import align, assemble, build, circuits, contract, digraph, generate, kmers, traverse
from strandwork.shared import fresh_path
from strandwork.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with its oracle if it has one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


SEQ = "regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g')"
READS = f"reads AS (SELECT doc_id AS group_key, {SEQ} AS seq FROM documents)"


def edges_sql(k1: int, keys: str = "group_key", source: str = READS) -> str:
    """CTEs reads, occ and e(keys, src, dst, multiplicity)."""
    head = f"{keys}, " if keys else ""
    return f"""{source},
    occ AS (SELECT group_key, unnest(list_transform(range(1, length(seq) - {k1} + 1), lambda i: substr(seq, i, {k1 + 1}))) AS kmer FROM reads WHERE length(seq) > {k1}),
    e AS (SELECT {head}substr(kmer, 1, {k1}) AS src, substr(kmer, 2, {k1}) AS dst, count(*) AS multiplicity FROM occ GROUP BY ALL)"""


def degrees_sql(table: str, keys: str = "group_key") -> str:
    """CTE d(keys, id, out_deg, in_deg, n_out, n_in) of an edge table."""
    head = f"{keys}, " if keys else ""
    return f"""d AS (SELECT {head}id, CAST(sum(o) AS BIGINT) AS out_deg, CAST(sum(i) AS BIGINT) AS in_deg, CAST(sum(x) AS BIGINT) AS n_out, CAST(sum(y) AS BIGINT) AS n_in FROM (
        SELECT {head}src AS id, multiplicity AS o, 0 AS i, 1 AS x, 0 AS y FROM {table} UNION ALL SELECT {head}dst, 0, multiplicity, 0, 1 FROM {table}) GROUP BY ALL)"""


FLAGS = "(n_out > 1 OR n_in > 1) AS is_branch, (out_deg > 0 AND in_deg = 0) AS is_source, (out_deg = 0 AND in_deg > 0) AS is_sink"


def chains_sql(k1: int, match: bool = False, keys: str = "group_key") -> str:
    """Every chain with its label: walks from the vertices that do not join their predecessor, and for cycles from their least vertices."""
    head, same = f"{keys}, " if keys else "", "AND i.multiplicity = o.multiplicity" if match else ""
    own = lambda a, b: f"{a}.{keys} = {b}.{keys} AND" if keys else ""
    of = lambda a: f"{a}.{keys}," if keys else ""
    return f"""WITH RECURSIVE {edges_sql(k1, keys)}, {degrees_sql('e', keys)}, plain AS (SELECT {head}id FROM d WHERE n_out <= 1 AND n_in <= 1),
    l AS (SELECT {of('p')} p.id, o.dst AS succ, o.multiplicity AS m_out, i.src AS pred, i.multiplicity AS m_in, coalesce(q.id IS NOT NULL AND o.dst IS NOT NULL AND i.src <> p.id {same}, false) AS joined
        FROM plain p LEFT JOIN e o ON {own('o', 'p')} o.src = p.id LEFT JOIN e i ON {own('i', 'p')} i.dst = p.id LEFT JOIN plain q ON {own('q', 'p')} q.id = i.src),
    j AS (SELECT * FROM l WHERE joined),
    w AS (SELECT {head}id AS head, id AS v, CAST(0 AS BIGINT) AS n FROM l WHERE NOT joined UNION ALL SELECT {of('w')} w.head, j.id, w.n + 1 FROM w JOIN j ON {own('j', 'w')} j.pred = w.v),
    c AS (SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM w WHERE {own('w', 'j')} w.v = j.id)),
    r AS (SELECT {head}id AS a, id AS b FROM c UNION SELECT {of('r')} r.a, c.id FROM r JOIN c ON {own('c', 'r')} c.pred = r.b),
    h AS (SELECT {head}a FROM r GROUP BY ALL HAVING min(b) = a),
    y AS (SELECT {head}a AS head, a AS v, CAST(0 AS BIGINT) AS n FROM h UNION ALL SELECT {of('y')} y.head, c.id, y.n + 1 FROM y JOIN c ON {own('c', 'y')} c.pred = y.v AND c.id <> y.head),
    a AS (SELECT x.*, l.succ, l.m_out, l.m_in FROM (SELECT * FROM w UNION ALL SELECT * FROM y) x JOIN l ON {own('l', 'x')} l.id = x.v),
    chains AS (SELECT {head}head, arg_max(succ, n) FILTER (n = last) AS tail, CAST(list_min([min(m_in) FILTER (n > 0), max(m_out) FILTER (n = last)]) AS BIGINT) AS multiplicity, CAST(count(*) AS INTEGER) AS n_vertices, head || coalesce(string_agg(right(v, 1), '' ORDER BY n) FILTER (n > 0), '') AS label
        FROM (SELECT *, max(n) OVER (PARTITION BY {head}head) AS last FROM a) GROUP BY {head}head)"""


#: r: all pairs of vertices of a group of which one reaches the other (or is it).
REACH = "r AS (SELECT group_key, id AS a, id AS b FROM d UNION SELECT r.group_key, r.a, e.dst FROM r JOIN e ON e.group_key = r.group_key AND e.src = r.b)"


def parted_sql(k1: int) -> str:
    """CTEs up to parts(group_key, node, root, several): strong components of the branches and heads of the chains of each group, as pairs that reach each other."""
    return f"""{chains_sql(k1)}, branch AS (SELECT group_key, id FROM d WHERE n_out > 1 OR n_in > 1),
    q AS (SELECT e.group_key, e.src, e.dst FROM e JOIN branch b ON b.group_key = e.group_key AND b.id = e.src UNION ALL SELECT group_key, head, tail FROM chains WHERE tail IS NOT NULL),
    nodes AS (SELECT group_key, id FROM branch UNION ALL SELECT group_key, head FROM chains),
    rr AS (SELECT group_key, id AS a, id AS b FROM nodes UNION SELECT rr.group_key, rr.a, q.dst FROM rr JOIN q ON q.group_key = rr.group_key AND q.src = rr.b),
    parts AS (SELECT x.group_key, x.a AS node, min(x.b) AS root, count(*) > 1 AS several FROM rr x JOIN rr y ON x.group_key = y.group_key AND x.a = y.b AND x.b = y.a GROUP BY ALL)"""


def components_sql(k1: int) -> str:
    """Strong components: a chain's vertices are one if its node is on a cycle, else each is one."""
    return f"""{parted_sql(k1)}, whole AS (SELECT p.group_key, p.node AS id, p.root FROM parts p JOIN branch b ON b.group_key = p.group_key AND b.id = p.node
        UNION ALL SELECT a.group_key, a.v, CASE WHEN p.several OR c.tail = c.head THEN p.root ELSE a.v END FROM a JOIN parts p ON p.group_key = a.group_key AND p.node = a.head JOIN chains c ON c.group_key = a.group_key AND c.head = a.head)
    SELECT group_key, id, min(id) OVER (PARTITION BY group_key, root) AS component FROM whole"""


def rectified_sql(k1: int, coverage: int) -> str:
    """Edges after rectification, walk by walk on contracted chains."""
    often = build.repeat_multiplicity(coverage)
    return f"""{parted_sql(k1)}, f AS (SELECT *, {FLAGS} FROM d), s AS (SELECT group_key, min(id) AS id FROM f WHERE is_source GROUP BY ALL),
    walk AS (SELECT e.group_key, e.src AS start, e.dst AS first, c.head, coalesce(c.tail, e.dst) AS stop, CAST(list_min([e.multiplicity, c.multiplicity]) AS BIGINT) AS least, true AS branch FROM e JOIN branch b ON b.group_key = e.group_key AND b.id = e.src LEFT JOIN chains c ON c.group_key = e.group_key AND c.head = e.dst
        UNION ALL SELECT c.group_key, c.head, NULL, c.head, c.tail, c.multiplicity, false FROM chains c JOIN f ON f.group_key = c.group_key AND f.id = c.head AND f.is_source),
    near AS (SELECT group_key, id FROM s UNION SELECT w.group_key, w.stop FROM near n JOIN walk w ON w.group_key = n.group_key AND w.start = n.id),
    most AS (SELECT w.group_key, w.start, w.first, w.head, CASE WHEN w.branch AND t.n_out > 0 AND x.root = y.root AND w.least >= {often} THEN 2 ELSE 1 END AS most FROM walk w JOIN near n ON n.group_key = w.group_key AND n.id = w.start
        JOIN f t ON t.group_key = w.group_key AND t.id = w.stop JOIN parts x ON x.group_key = w.group_key AND x.node = w.start JOIN parts y ON y.group_key = w.group_key AND y.node = w.stop),
    capped AS (SELECT group_key, start AS src, first AS dst, most FROM most WHERE first IS NOT NULL UNION ALL SELECT a.group_key, a.v, a.succ, m.most FROM most m JOIN a ON a.group_key = m.group_key AND a.head = m.head WHERE a.succ IS NOT NULL)
    SELECT e.group_key, e.src, e.dst, CAST(least(e.multiplicity, coalesce(c.most, e.multiplicity)) AS BIGINT) AS multiplicity FROM e LEFT JOIN capped c ON c.group_key = e.group_key AND c.src = e.src AND c.dst = e.dst"""


EVENT_PAIRS = "p AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT src, dst, count(*) AS multiplicity FROM p WHERE dst IS NOT NULL GROUP BY ALL)"
PART_PAIRS = "e AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS multiplicity FROM lineitem GROUP BY ALL)"


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bases of each document, where the scan leaves them."""
    return kmers.normalise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text")


#: Tasks among which texts are spread that the scan gives to fewer.
SPREAD = 32


def spread_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bases where each makes much work: texts that the scan gives to fewer tasks than the session's shuffles have (SPREAD at most) are dealt out first."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tasks = min(SPREAD, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return kmers.normalise(texts if texts.rdd.getNumPartitions() >= tasks else texts.repartition(tasks), "doc_id", "text")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bases of each document, dealt out by document, for queries that group by it.

    Bases are a tenth of what their k-mers take, so they are shuffled once and k-mers are then counted, and graphs built, in
    place: every later grouping has the document among its keys. The count of partitions is the session's, which
    AQE would else melt down to the bytes of the bases.
    """
    return spread_bases(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group_key")


def edges(spark: SparkSession, sf_dir: str, k1: int) -> DataFrame:
    """The edges of each document: counted where its bases lie and dealt out by document, which is what every later step groups by."""
    return kmers.edges(spread_bases(spark, sf_dir), k1, deal=True)


def most_bases(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the longest document: a bound of its edges, read without looking for bases."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.max(F.octet_length("text"))).first()[0] or 0


WORDS = "words AS (SELECT group_key, seq FROM (SELECT doc_id AS group_key, unnest(string_split_regex(upper(coalesce(text, '')), '[ \\n]+')) AS seq FROM documents) WHERE regexp_full_match(seq, '[ACGT]+'))"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents that are sequences of bases, as reads of their document."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("group_key"), F.posexplode(F.split(F.upper(F.coalesce("text", F.lit(""))), "[ \n]+")).alias("read_id", "seq"))
    return kmers.only_bases(rows.filter("seq <> ''"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between a user's consecutive events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    pairs = rows.select(F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst"))
    return digraph.from_pairs(pairs.filter("dst IS NOT NULL"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to their suppliers."""
    return digraph.from_pairs(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query(f"WITH {READS} SELECT group_key, seq, length(seq) AS n FROM reads")
def seq_normalize(spark, sf_dir):
    return bases(spark, sf_dir).select("group_key", "seq", F.length("seq").cast("long").alias("n"))


@query(f"WITH {READS} SELECT group_key, {', '.join(f'''length(seq) - length(replace(seq, '{b}', '')) AS n_{b.lower()}''' for b in 'ACGT')} FROM reads")
def base_composition(spark, sf_dir):
    return bases(spark, sf_dir).select("group_key", *((F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("long").alias(f"n_{b.lower()}") for b in "ACGT"))


@query(f"WITH {READS} SELECT group_key, i - 1 AS pos, substr(seq, i, 8) AS mer FROM (SELECT group_key, seq, unnest(range(1, length(seq) - 6)) AS i FROM reads WHERE length(seq) >= 8)")
def kmer_positions_k8(spark, sf_dir):
    return kmers.mers(bases(spark, sf_dir), 8).select("group_key", F.col("pos").cast("long").alias("pos"), "mer")


@query(f"WITH {READS}, m AS (SELECT DISTINCT unnest(list_transform(range(1, length(seq) - 10), lambda i: substr(seq, i, 12))) AS mer FROM reads WHERE length(seq) >= 12) SELECT mer, list_reduce(list_transform(range(1, 13), lambda i: CAST(strpos('ACGT', substr(mer, i, 1)) - 1 AS BIGINT)), lambda a, b: a * 4 + b) AS mer_id FROM m")
def mer_encode(spark, sf_dir):
    return kmers.mers(bases(spark, sf_dir), 12).select("mer").distinct().select("mer", codec.mer_encode(F.col("mer")).alias("mer_id"))


@query("SELECT p_partkey AS mer_id, list_aggregate(list_transform(range(9, -1, -1), lambda i: substr('ACGT', CAST((p_partkey >> (2 * i)) & 3 AS BIGINT) + 1, 1)), 'string_agg', '') AS mer FROM part")
def mer_decode(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("mer_id"), codec.mer_decode(F.col("p_partkey"), 10).alias("mer"))


@query(f"WITH {READS} SELECT group_key, seq, length(seq) % 4 AS header, 1 + CAST(ceil(length(seq) / 4.0) AS BIGINT) AS n_bytes FROM reads")
def packed_round_trip(spark, sf_dir):
    rows = bases(spark, sf_dir).withColumn("packed", codec.pack(F.col("seq")))
    return rows.select("group_key", codec.unpack(F.col("packed")).alias("seq"), F.conv(F.substring(F.hex("packed"), 1, 2), 16, 10).cast("long").alias("header"), F.octet_length("packed").cast("long").alias("n_bytes"))


@query(f"WITH {READS} SELECT group_key, substr(seq, 6, 7) AS slice FROM reads")
def packed_slice(spark, sf_dir):
    rows = bases(spark, sf_dir).select("group_key", codec.pack(F.col("seq")).alias("packed"))
    return rows.select("group_key", codec.unpack_slice(F.col("packed"), 5, 7).alias("slice"))


@query(f"WITH {READS}, p AS (SELECT left(seq, 12) AS key, arg_min(seq, group_key) AS other FROM reads GROUP BY 1) SELECT group_key, seq = other AS equal FROM reads JOIN p ON left(seq, 12) = key")
def packed_equality(spark, sf_dir):
    """Each document's bases, packed, against those of the first document that begins with the same twelve: copies are equal, others are not."""
    rows = bases(spark, sf_dir).select("group_key", F.left("seq", F.lit(12)).alias("key"), codec.pack(F.col("seq")).alias("packed"))
    first = rows.groupBy("key").agg(F.min_by("packed", "group_key").alias("other"))
    return rows.join(first, "key").select("group_key", codec.packed_equal(F.col("packed"), F.col("other")).alias("equal"))


@query(f"WITH {WORDS} SELECT * FROM words")
def alphabet_words(spark, sf_dir):
    return words(spark, sf_dir).select("group_key", "seq")


@query(f"WITH {READS} SELECT group_key, seq || substr(reverse(seq), 4) AS merged FROM reads")
def merge_overlap(spark, sf_dir):
    return bases(spark, sf_dir).select("group_key", codec.merge_overlap(F.col("seq"), F.reverse("seq"), 3).alias("merged"))


@query(f"WITH {edges_sql(3, '')} SELECT src, dst FROM e")
def debruijn_edges(spark, sf_dir):
    return kmers.edges(spread_bases(spark, sf_dir), 3, multi=False, grouped=False).select("src", "dst")


@query(f"WITH {edges_sql(3, '')} SELECT src, dst, multiplicity FROM e")
def debruijn_edges_multi(spark, sf_dir):
    return kmers.edges(spread_bases(spark, sf_dir), 3, grouped=False)


@query(f"WITH {edges_sql(8)} SELECT * FROM e")
def debruijn_edges_k8(spark, sf_dir):
    return edges(spark, sf_dir, 8)


@query(f"WITH {edges_sql(8)}, {degrees_sql('e')} SELECT group_key, id, out_deg, in_deg, n_out, n_in FROM d")
def vertex_degrees(spark, sf_dir):
    return digraph.degrees(edges(spark, sf_dir, 8))


@query(f"WITH {edges_sql(8)}, {degrees_sql('e')} SELECT group_key, id, {FLAGS} FROM d")
def vertex_flags(spark, sf_dir):
    return digraph.flags(edges(spark, sf_dir, 8)).select("group_key", "id", "is_branch", "is_source", "is_sink")


@query(f"WITH {edges_sql(8)}, {degrees_sql('e')}, f AS (SELECT *, {FLAGS} FROM d) SELECT group_key, count(*) FILTER (is_source) AS n_sources, count(*) FILTER (is_sink) AS n_sinks, max(id) FILTER (is_source) AS last_source, max(id) FILTER (is_sink) AS last_sink FROM f GROUP BY ALL")
def sources_sinks(spark, sf_dir):
    return digraph.sources_and_sinks(edges(spark, sf_dir, 8))


@query(f"WITH {EVENT_PAIRS} SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS successors FROM (SELECT src, dst, unnest(range(multiplicity)) FROM e) GROUP BY ALL")
def adjacency_lists(spark, sf_dir):
    return digraph.adjacency(events(spark, sf_dir)).select("id", F.array_join("successors", ",").alias("successors"))


@query(f"WITH {PART_PAIRS} SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS successors FROM e GROUP BY ALL")
def adjacency_multiples(spark, sf_dir):
    return digraph.adjacency(parts(spark, sf_dir), repeat=False).select("id", F.array_join(F.col("successors").cast("array<string>"), ",").alias("successors"))


@query(f"WITH {PART_PAIRS}, n AS (SELECT dst AS id, src, multiplicity, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1) // 50 AS page FROM e) SELECT id, page, string_agg(src || ':' || multiplicity, ',' ORDER BY src) AS successors FROM n GROUP BY ALL")
def adjacency_pages(spark, sf_dir):
    """The parts of each supplier, fifty to a page."""
    turned = parts(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "multiplicity")
    shown = F.transform("successors", lambda x: F.concat_ws(":", x["dst"].cast("string"), x["multiplicity"].cast("string")))
    return digraph.adjacency_pages(turned, 50).select("id", "page", F.array_join(shown, ",").alias("successors"))


@query(f"WITH {PART_PAIRS} SELECT src, dst, CAST(unnest(range(multiplicity)) AS INTEGER) AS number FROM e")
def adjacency_iterator(spark, sf_dir):
    return digraph.neighbours(parts(spark, sf_dir))


@query(f"""WITH {PART_PAIRS}, o AS (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS t FROM (SELECT src, dst, unnest(range(multiplicity)) FROM e) GROUP BY 1), i AS (SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS f FROM (SELECT src, dst, unnest(range(multiplicity)) FROM e) GROUP BY 1)
    SELECT coalesce(o.id, i.id) || ';b;' || coalesce(t, '') || ';' || coalesce(f, '') || ';' AS value FROM o FULL JOIN i ON o.id = i.id""")
def vertex_text(spark, sf_dir):
    return digraph.vertex_text(digraph.vertices(parts(spark, sf_dir)))


@query(f"WITH {PART_PAIRS} SELECT id, CAST(sum(o) AS BIGINT) AS n_to, CAST(sum(i) AS BIGINT) AS n_from FROM (SELECT src AS id, multiplicity AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, multiplicity FROM e) GROUP BY ALL")
def vertex_text_parsed(spark, sf_dir):
    return digraph.parse_vertex_text(vertex_text(spark, sf_dir)).select("id", F.size("to").cast("long").alias("n_to"), F.size("from").cast("long").alias("n_from"))


@query(f"WITH {PART_PAIRS} SELECT src, dst, multiplicity FROM e")
def vertex_text_edges(spark, sf_dir):
    return digraph.edges_of_vertices(digraph.parse_vertex_text(vertex_text(spark, sf_dir)))


@query(f"WITH {PART_PAIRS}, g AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT src, dst, multiplicity - coalesce(n, 0) AS multiplicity FROM e LEFT JOIN g USING (src, dst) WHERE multiplicity > coalesce(n, 0)")
def remove_edge(spark, sf_dir):
    gone = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return digraph.remove_edges(parts(spark, sf_dir), gone)


@query(f"WITH {PART_PAIRS} SELECT src, dst, multiplicity FROM e WHERE src BETWEEN 0 AND 999 AND dst BETWEEN 0 AND 999")
def range_guard(spark, sf_dir):
    """The edges that a graph of a thousand places takes."""
    return digraph.in_range(parts(spark, sf_dir), 1000)


@query(f"WITH {edges_sql(8)}, {degrees_sql('e')}, f AS (SELECT *, {FLAGS} FROM d) SELECT group_key, id, row_number() OVER (PARTITION BY group_key ORDER BY NOT is_source, id) - 1 AS number FROM f")
def renumber_k8(spark, sf_dir):
    return digraph.renumber(edges(spark, sf_dir, 8))


@query(f"WITH {PART_PAIRS}, {degrees_sql('e', '')}, f AS (SELECT *, {FLAGS} FROM d), n AS (SELECT id, row_number() OVER (ORDER BY NOT is_source, id) - 1 AS number FROM f) SELECT a.number AS src, b.number AS dst, multiplicity FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst")
def renumbered_edges(spark, sf_dir):
    return digraph.renumbered(parts(spark, sf_dir))


@query("SELECT DISTINCT -1 - l_suppkey AS id FROM lineitem")
def no_way_out(spark, sf_dir):
    """Suppliers, as numbers below 0 so that none of them is a part: nothing leads out of them."""
    return digraph.no_way_out(digraph.degrees(parts(spark, sf_dir).withColumn("dst", -1 - F.col("dst")))).select("id")


@query(f"WITH {PART_PAIRS}, o AS (SELECT src AS id, string_agg(dst, ' ' ORDER BY dst) AS t FROM (SELECT src, dst, unnest(range(multiplicity)) FROM e) GROUP BY 1), i AS (SELECT dst AS id, string_agg(src, ' ' ORDER BY src) AS f FROM (SELECT src, dst, unnest(range(multiplicity)) FROM e) GROUP BY 1) SELECT coalesce(o.id, i.id) AS id, 'vertex ' || coalesce(o.id, i.id) || ' to [' || coalesce(t, '') || '] from [' || coalesce(f, '') || ']' AS line FROM o FULL JOIN i ON o.id = i.id")
def vertex_display(spark, sf_dir):
    return digraph.display(digraph.vertices(parts(spark, sf_dir)))


@query(f"WITH {PART_PAIRS}, {degrees_sql('e', '')} SELECT id, out_deg AS n_to, in_deg AS n_from, CASE WHEN n_out > 1 OR n_in > 1 THEN 'branch' ELSE 'chain' END AS kind FROM d")
def vertex_files(spark, sf_dir):
    """Vertices written with a folder for each kind and read back."""
    rows = digraph.vertices(parts(spark, sf_dir)).withColumn("kind", F.when(F.col("is_branch"), "branch").otherwise("chain"))
    path = fresh_path(spark, "vertices")
    files.write_kinds(rows, path)
    return files.read_vertices(spark, path).select("id", F.size("out_nbrs").cast("long").alias("n_to"), F.size("in_nbrs").cast("long").alias("n_from"), "kind")


@query(f"WITH {READS}, m AS (SELECT group_key, unnest(list_transform(range(1, length(seq) - 10), lambda i: substr(seq, i, 12))) AS mer FROM reads WHERE length(seq) > 12), u AS (SELECT group_key FROM m GROUP BY 1 HAVING count(*) = count(DISTINCT mer)) SELECT seq FROM reads JOIN u USING (group_key)")
def contig_files(spark, sf_dir):
    """Contigs written as lines of text and read back as reads."""
    path = fresh_path(spark, "contigs")
    files.write_contigs(assemble.assemble_reads(assemble.unique_spelling(reads(spark, sf_dir), 12), 12, largest=most_bases(spark, sf_dir)), path)
    return files.read_lines(spark, path).select("seq")


@query(f"WITH {PART_PAIRS} SELECT src, dst, multiplicity FROM e")
def merge_vertices(spark, sf_dir):
    """The graphs of returned and of other lines, merged."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag")
    return digraph.add_edges(digraph.from_pairs(lines.filter("l_returnflag = 'R'")), digraph.from_pairs(lines.filter("l_returnflag <> 'R'")))


@query(f"WITH {PART_PAIRS}, a AS (SELECT src, dst FROM e), b AS (SELECT src, dst FROM e WHERE multiplicity > 1), x AS (SELECT src AS id FROM a UNION SELECT dst FROM a), bad AS (SELECT src, dst FROM a EXCEPT SELECT src, dst FROM b) SELECT id, NOT EXISTS (SELECT 1 FROM bad WHERE bad.src = x.id) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.dst = x.id) AS equal FROM x")
def vertex_set_equality(spark, sf_dir):
    e = parts(spark, sf_dir)
    return digraph.equal_vertices(e, e.filter("multiplicity > 1"))


@query(f"WITH {edges_sql(8)} SELECT * FROM e WHERE multiplicity >= ceil(3 / 2.0)")
def coverage_filter_c3(spark, sf_dir):
    return build.covered(edges(spark, sf_dir, 8), 3)


@query(f"WITH {edges_sql(8)}, {degrees_sql('e')} SELECT group_key, id, CASE WHEN n_out > 1 OR n_in > 1 THEN 'branch' ELSE 'chain' END AS kind FROM d")
def branch_chain_partition(spark, sf_dir):
    return build.partition_kinds(edges(spark, sf_dir, 8)).select("group_key", "id", "kind")


@query(f"""WITH {edges_sql(12)}, {degrees_sql('e')}, f AS (SELECT group_key, count(*) FILTER (out_deg > 0 AND in_deg = 0) AS n_sources, count(*) FILTER (out_deg = 0 AND in_deg > 0) AS n_sinks FROM d GROUP BY ALL)
    SELECT *, CASE WHEN n_sources = 1 AND n_sinks = 1 THEN 'ok' WHEN n_sources > 1 THEN 'multi_source' WHEN n_sinks > 1 THEN 'multi_sink' ELSE 'no_end' END AS status FROM f""")
def wellformed_groups(spark, sf_dir):
    return build.well_formed(edges(spark, sf_dir, 12))


@query(f"WITH {edges_sql(8)} SELECT group_key, src AS id, CASE WHEN count(DISTINCT dst) = 1 THEN max(dst) END AS tail, CAST(sum(multiplicity) AS BIGINT) AS tail_count FROM e GROUP BY ALL")
def tail_successor(spark, sf_dir):
    return digraph.tails(edges(spark, sf_dir, 8))


@query(f"{chains_sql(8)} SELECT * FROM chains")
def chain_contract_k8(spark, sf_dir):
    return contract.spell_chains(traverse.contract(edges(spark, sf_dir, 8), largest=most_bases(spark, sf_dir))).drop("vertices")


@query(f"{chains_sql(8, True)} SELECT group_key, head, tail, multiplicity, n_vertices FROM chains")
def chain_contract_match(spark, sf_dir):
    return traverse.contract(edges(spark, sf_dir, 8), must_match=True, largest=most_bases(spark, sf_dir)).drop("vertices")


@query(f"{chains_sql(12, False, '')} SELECT head, tail, multiplicity, n_vertices, label FROM chains")
def chain_contract_whole(spark, sf_dir):
    """One graph of all documents, contracted by joins."""
    return contract.spell_chains(contract.contract(kmers.edges(spread_bases(spark, sf_dir), 12, grouped=False))).drop("vertices")


@query(f"""{chains_sql(12, False, '')}, x AS (SELECT substr(kmer, 1, 12) AS src, min(group_key) AS read_id FROM occ GROUP BY ALL)
    SELECT c.head, c.label, p.read_id FROM chains c LEFT JOIN (SELECT a.head, min(x.read_id) AS read_id FROM a JOIN x ON x.src = a.v GROUP BY ALL) p ON p.head = c.head""")
def chain_payload_files(spark, sf_dir):
    """One graph of all documents: edges carry the first document that they occur in to their chains, which are written with their labels as packed bytes and read back."""
    first = {"read_id": F.min}
    chains = contract.contract(kmers.edges(spread_bases(spark, sf_dir), 12, grouped=False, payload=first), merge=first)
    path = fresh_path(spark, "payloads")
    files.write_vertices(contract.spell_chains(chains).select("head", codec.pack(F.col("label")).alias("payload"), "read_id"), path)
    return files.read_vertices(spark, path).select("head", codec.unpack(F.col("payload")).alias("label"), "read_id")


@query("WITH o AS (SELECT l_partkey AS p, -1 - l_suppkey AS s, l_shipdate AS t FROM lineitem) SELECT id, min(t) AS first, max(t) AS last FROM (SELECT p AS id, t FROM o UNION ALL SELECT s, t FROM o) GROUP BY ALL")
def vertex_payloads(spark, sf_dir):
    """When each part, and each supplier (as a number below 0), was first and last shipped: carried by their edges."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"), F.col("l_shipdate").alias("first"), F.col("l_shipdate").alias("last"))
    return digraph.vertex_payload(lines, {"first": F.min, "last": F.max})


@query(f"""WITH RECURSIVE {EVENT_PAIRS}, r AS (SELECT src AS a, src AS b FROM e UNION SELECT dst, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
    SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY ALL""")
def strong_components_events(spark, sf_dir):
    return traverse.components(events(spark, sf_dir))


@query(f"WITH RECURSIVE {edges_sql(3)}, {degrees_sql('e')}, {REACH} SELECT x.group_key, x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.group_key = y.group_key AND x.a = y.b AND x.b = y.a GROUP BY ALL")
def strong_components_k3(spark, sf_dir):
    return traverse.components(edges(spark, sf_dir, 3), largest=256)


@query(f"""WITH RECURSIVE {EVENT_PAIRS}, r AS (SELECT src AS a, src AS b FROM e UNION SELECT dst, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
    SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY ALL""")
def strong_components_joins(spark, sf_dir):
    """The same as strong_components_events, by joins."""
    return contract.strong_components(events(spark, sf_dir))


@query(components_sql(8))
def strong_components_k8(spark, sf_dir):
    return traverse.components(edges(spark, sf_dir, 8), largest=most_bases(spark, sf_dir))


@query(components_sql(8))
def strong_components_k8_joins(spark, sf_dir):
    """strong_components_k8 without a group of more than traverse.PIECE links in a task."""
    return contract.strong_components(edges(spark, sf_dir, 8))


@query(f"WITH {edges_sql(12)} SELECT group_key, CAST(sum(multiplicity) AS BIGINT) AS n_edges FROM e GROUP BY ALL")
def euler_edge_counts_k12(spark, sf_dir):
    paths = euler_paths_k12(spark, sf_dir)
    return paths.groupBy("group_key").agg((F.count("*") - F.count_distinct("path_id")).alias("n_edges"))


@query()
def euler_paths_k12(spark, sf_dir):
    return traverse.euler_paths_of_reads(reads(spark, sf_dir), 12, largest=most_bases(spark, sf_dir))


@query(f"WITH {edges_sql(12)} SELECT * FROM e")
def euler_edges_k12(spark, sf_dir):
    """The steps of all trails: every edge, as often as it occurs."""
    return traverse.walked_edges(reads(spark, sf_dir), 12, largest=most_bases(spark, sf_dir))


@query(f"WITH {edges_sql(12)}, {degrees_sql('e')} SELECT group_key, id, greatest(out_deg - in_deg, 0) AS n_starts, greatest(in_deg - out_deg, 0) AS n_ends FROM d WHERE out_deg <> in_deg")
def euler_ends_k12(spark, sf_dir):
    """Where the open trails start and end: as few as the degrees allow."""
    ends = euler_paths_k12(spark, sf_dir).groupBy("group_key", "path_id").agg(F.min_by("id", "pos").alias("a"), F.max_by("id", "pos").alias("b")).filter("a <> b")
    each = ends.select("group_key", F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("b").alias("id"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x")).select("group_key", "x.*")
    return each.groupBy("group_key", "id").agg(F.sum("s").alias("n_starts"), F.sum("e").alias("n_ends"))


@query(f"""WITH {edges_sql(12, '')}, {degrees_sql('e', '')} SELECT 'edge' AS what, src AS a, dst AS b, multiplicity AS n FROM e
    UNION ALL SELECT 'end', id, NULL, out_deg - in_deg FROM d WHERE out_deg <> in_deg""")
def euler_trails_whole(spark, sf_dir):
    """Trails of one graph of all documents, found by joins: all edges that they take, as often as they occur, and where more of them begin than end, as few as the degrees allow."""
    trails = circuits.euler_walks(spread_bases(spark, sf_dir), 12)
    edges = kmers.edges(trails.select("seq"), 12, grouped=False).select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("multiplicity").alias("n"))
    ends = trails.groupBy("path_id").agg(F.min_by(F.left("seq", F.lit(12)), "pos").alias("s"), F.max_by(F.right("seq", F.lit(12)), "pos").alias("e"))
    each = ends.select(F.explode(F.array(F.struct(F.col("s").alias("a"), F.lit(1).alias("n")), F.struct(F.col("e").alias("a"), F.lit(-1).alias("n")))).alias("x")).groupBy("x.a").agg(F.sum("x.n").alias("n"))
    return edges.unionByName(each.filter("n <> 0").select(F.lit("end").alias("what"), "a", F.lit(None).cast("string").alias("b"), "n"))


@query("""SELECT * FROM (VALUES ('A', 'B', 1), ('B', 'C', 1), ('C', 'D', 2), ('D', 'E', 2), ('E', 'F', 1), ('F', 'C', 1), ('E', 'G', 1)) t(src, dst, multiplicity)""")
def rectify_single_fixture(spark, sf_dir):
    rows = spark.createDataFrame([("A", "B", 2), ("B", "C", 2), ("C", "D", 6), ("D", "E", 5), ("E", "G", 3), ("E", "F", 3), ("F", "C", 3)], "src string, dst string, multiplicity long")
    return assemble.rectified(rows, 3).withColumn("multiplicity", F.col("multiplicity").cast("int"))


@query(rectified_sql(8, 2))
def rectify_single_docs(spark, sf_dir):
    return assemble.rectified(edges(spark, sf_dir, 8), 2, largest=most_bases(spark, sf_dir))


@query(rectified_sql(8, 2))
def rectify_by_joins(spark, sf_dir):
    """rectify_single_docs without a group of more than traverse.PIECE edges in a task."""
    return assemble.rectified_by_joins(edges(spark, sf_dir, 8), 2)


@query(f"""WITH RECURSIVE {edges_sql(3)}, {degrees_sql('e')}, {REACH}, f AS (SELECT *, {FLAGS} FROM d),
    s AS (SELECT group_key, min(id) AS id FROM f WHERE is_source GROUP BY ALL),
    starts AS (SELECT f.* FROM f JOIN s ON s.group_key = f.group_key JOIN r ON r.group_key = f.group_key AND r.a = s.id AND r.b = f.id WHERE f.is_branch OR f.id = s.id),
    w AS (SELECT e.group_key, e.src AS start, e.dst AS first, e.src, e.dst, e.multiplicity FROM starts JOIN e ON e.group_key = starts.group_key AND e.src = starts.id
        UNION ALL SELECT w.group_key, w.start, w.first, e.src, e.dst, e.multiplicity FROM w JOIN f ON f.group_key = w.group_key AND f.id = w.dst AND NOT f.is_branch JOIN e ON e.group_key = w.group_key AND e.src = w.dst),
    ends AS (SELECT w.group_key, w.start, w.first, max(w.dst) FILTER (f.is_branch OR f.n_out = 0) AS stop, min(w.multiplicity) AS least FROM w JOIN f ON f.group_key = w.group_key AND f.id = w.dst GROUP BY ALL),
    t AS (SELECT x.group_key, x.start, x.first, CASE WHEN x.least >= 2 AND a.is_branch AND b.n_out > 0 AND EXISTS (SELECT 1 FROM r WHERE r.group_key = x.group_key AND r.a = x.stop AND r.b = x.start) THEN 2 ELSE 1 END AS most
        FROM ends x JOIN f a ON a.group_key = x.group_key AND a.id = x.start JOIN f b ON b.group_key = x.group_key AND b.id = x.stop),
    walked AS (SELECT w.group_key, w.src, w.dst, t.most FROM w JOIN t ON t.group_key = w.group_key AND t.start = w.start AND t.first = w.first)
    SELECT e.group_key, e.src, e.dst, CAST(least(e.multiplicity, coalesce(walked.most, e.multiplicity)) AS BIGINT) AS multiplicity FROM e LEFT JOIN walked ON walked.group_key = e.group_key AND walked.src = e.src AND walked.dst = e.dst""")
def rectify_single_k3(spark, sf_dir):
    return assemble.rectified(edges(spark, sf_dir, 3), 2)


@query(f"WITH {READS}, m AS (SELECT group_key, unnest(list_transform(range(1, length(seq) - 10), lambda i: substr(seq, i, 12))) AS mer FROM reads WHERE length(seq) > 12), u AS (SELECT group_key FROM m GROUP BY 1 HAVING count(*) = count(DISTINCT mer)) SELECT group_key, seq, 'ok' AS status FROM reads JOIN u USING (group_key)")
def assemble_roundtrip_k12(spark, sf_dir):
    return assemble.assemble_reads(assemble.unique_spelling(reads(spark, sf_dir), 12), 12, largest=most_bases(spark, sf_dir)).select("group_key", "seq", "status")


@query()
def assemble_basic_k3(spark, sf_dir):
    return assemble.assemble_slices(spread_bases(spark, sf_dir))


@query(f"WITH {edges_sql(3)} SELECT group_key, src, dst, CAST(1 AS BIGINT) AS multiplicity FROM e")
def assemble_basic_edges(spark, sf_dir):
    """The edges that the plain facade's contigs spell: each edge of the document once."""
    return kmers.edges(assemble_basic_k3(spark, sf_dir).select("group_key", F.lit(0).alias("read_id"), "seq").filter("seq IS NOT NULL"), 3)


def split_sql(merge_tail: bool, low: int = 5, high: int = 15, copies: int = 6) -> str:
    """CTEs reads to pieces, and pieces(group_key, copy, read_id, start, seq)."""
    stop = f"b > length(seq) - {low}" if merge_tail else "b >= length(seq)"
    return f"""WITH RECURSIVE {READS}, s AS (SELECT group_key, seq, c AS copy, j, sum({low} + ((((j + 1009 * c + 104729 * (group_key % 10007)) % 2147483648) * 1103515245 + 12345) % 2147483648) // 65536 % {high - low + 1}) OVER (PARTITION BY group_key, c ORDER BY j) AS b
        FROM (SELECT *, unnest(range(0, length(seq) // {low} + 1)) AS j FROM (SELECT *, unnest(range({copies})) AS c FROM reads WHERE length(seq) > 0))),
    t AS (SELECT *, {stop} AS stop, lag(b, 1, 0) OVER w AS start, lag({stop}, 1, false) OVER w AS before FROM s WINDOW w AS (PARTITION BY group_key, copy ORDER BY j)),
    pieces AS (SELECT group_key, CAST(copy AS INTEGER) AS copy, CAST(j AS INTEGER) AS read_id, CAST(start AS BIGINT) AS start, substr(seq, CAST(start + 1 AS BIGINT), CAST(CASE WHEN stop THEN length(seq) ELSE b - start END AS BIGINT)) AS seq FROM t WHERE NOT before)"""


@query(f"{split_sql(True, copies=1)}, held AS (SELECT DISTINCT group_key, unnest(list_transform(range(1, length(seq) - 6), lambda i: substr(seq, i, 8))) AS mer FROM pieces WHERE length(seq) > 8) SELECT DISTINCT group_key, seq AS mer FROM pieces p WHERE length(seq) = 8 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.group_key = p.group_key AND h.mer = p.seq)")
def isolated_mers(spark, sf_dir):
    """Pieces of eight bases that no longer piece of their document holds."""
    return kmers.isolated(generate.split_reads(reads(spark, sf_dir), 5, 15, 1), 8)


#: The covered edges of the pieces that assemble_reads_cov assembles, their degrees, and each group's counts of sources and sinks.
COVERED = f"""{split_sql(True, 30, 60)}, occ AS (SELECT group_key, unnest(list_transform(range(1, length(seq) - 11), lambda i: substr(seq, i, 13))) AS kmer FROM pieces WHERE length(seq) > 12),
    e AS (SELECT group_key, substr(kmer, 1, 12) AS src, substr(kmer, 2, 12) AS dst, count(*) AS multiplicity FROM occ GROUP BY ALL HAVING count(*) >= 2), {degrees_sql('e')},
    g AS (SELECT group_key, count(*) FILTER (out_deg > 0 AND in_deg = 0) AS n_sources, count(*) FILTER (out_deg = 0 AND in_deg > 0) AS n_sinks FROM d GROUP BY ALL)"""


@query()
def assemble_reads_cov(spark, sf_dir):
    return assemble.assemble_reads(generate.split_reads(spread_bases(spark, sf_dir), 30, 60, 6), 12, coverage=3, largest=most_bases(spark, sf_dir))


@query(f"{COVERED} SELECT e.group_key, e.src, e.dst FROM e JOIN g USING (group_key) WHERE n_sources = 1 AND n_sinks = 1")
def assemble_cov_edges(spark, sf_dir):
    """The edges that the contigs spell: all covered ones of the groups that pass the gate."""
    contigs = assemble_reads_cov(spark, sf_dir).select("group_key", "seq").filter("seq IS NOT NULL")
    return traverse.per_group(contigs, "src ID, dst ID", list, lambda seqs: kmers.group_edges(seqs, 12, multi=False))


@query(f"{COVERED} SELECT group_key, CASE WHEN n_sources > 1 THEN 'multi_source' WHEN n_sinks > 1 THEN 'multi_sink' ELSE 'no_end' END AS status FROM g WHERE n_sources <> 1 OR n_sinks <> 1")
def assemble_cov_gate(spark, sf_dir):
    """The groups that the gate stops, and why."""
    return assemble_reads_cov(spark, sf_dir).filter("seq IS NULL").select("group_key", "status")


@query(f"WITH {READS}, m AS (SELECT group_key, unnest(list_transform(range(1, length(seq) - 10), lambda i: substr(seq, i, 12))) AS mer FROM reads WHERE length(seq) > 12), u AS (SELECT group_key FROM m GROUP BY 1 HAVING count(*) = count(DISTINCT mer)) SELECT group_key, seq, 'ok' AS status FROM reads JOIN u USING (group_key)")
def assemble_roundtrip_large(spark, sf_dir):
    """assemble_roundtrip_k12 on contracted chains, as for groups that do not fit a worker."""
    return assemble.assemble_large(assemble.unique_spelling(reads(spark, sf_dir), 12), k1=12).select("group_key", "seq", "status")


@query(f"{split_sql(True)} SELECT * FROM pieces")
def split_reads(spark, sf_dir):
    return generate.split_reads(spread_bases(spark, sf_dir), 5, 15, 6)


@query(f"{split_sql(False)} SELECT * FROM pieces")
def split_reads_untrimmed(spark, sf_dir):
    return generate.split_reads(spread_bases(spark, sf_dir), 5, 15, 6, merge_tail=False)


SHARES = "s_suppkey % 41 AS a, s_suppkey * 7 % 31 AS c, s_suppkey * 3 % 29 AS t, s_suppkey * 13 % 400 AS n"


@query(f"SELECT seed, a * n // 100 AS n_a, c * n // 100 AS n_c, t * n // 100 AS n_t, n - a * n // 100 - c * n // 100 - t * n // 100 AS n_g, n FROM (SELECT s_suppkey AS seed, {SHARES} FROM supplier)")
def generate_sequence(spark, sf_dir):
    """A sequence for each supplier: compositions of many shares, lengths from 0 on."""
    params = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS seed", *SHARES.split(", ")).selectExpr("seed", "a AS a_pct", "c AS c_pct", "t AS t_pct", "100 - a - c - t AS g_pct", "n AS length")
    count = lambda b: (F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("long")
    return generate.sequences(params).select("seed", *(count(b.upper()).alias(f"n_{b}") for b in "actg"), F.length("seq").cast("long").alias("n"))


@query(f"WITH {READS} SELECT group_key, hamming(seq, reverse(seq)) AS distance FROM reads WHERE seq <> ''")
def hamming_pairs(spark, sf_dir):
    return spread_bases(spark, sf_dir).filter("seq <> ''").select("group_key", distance.hamming(F.lower("seq"), F.reverse("seq")).cast("long").alias("distance"))


NAME_PAIRS = "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS {} FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select("n_regionkey", F.col("n_name").alias("a")).join(nation.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey").select("a", "b")


@query(NAME_PAIRS.format("distance"))
def levenshtein_pairs(spark, sf_dir):
    return name_pairs(spark, sf_dir).withColumn("distance", distance.levenshtein(F.col("a"), F.col("b")).cast("long"))


@query(NAME_PAIRS.format("cost"))
def pairwise_cost(spark, sf_dir):
    return name_pairs(spark, sf_dir).withColumn("cost", distance.pairwise("a", "b")["cost"].cast("long"))


CONTIGS = f"""{READS}, c AS (SELECT group_key, 0 AS ordinal, substr(seq, 21, 10) AS contig, seq AS main FROM reads WHERE length(seq) >= 42 UNION ALL SELECT group_key, 1, reverse(substr(seq, 31, 12)), seq FROM reads WHERE length(seq) >= 42)"""
BEST = "w AS (SELECT group_key, ordinal, contig, main, unnest(range(0, length(main) - length(contig) + 1)) AS o FROM c), b AS (SELECT group_key, ordinal, contig, main, arg_min(o, hamming(contig, substr(main, o + 1, length(contig))) * 1000000 + o) AS o, min(hamming(contig, substr(main, o + 1, length(contig)))) AS distance FROM w GROUP BY ALL)"


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two contigs for each document that has their bases (42) against all its bases: a part of them, and a reversed one."""
    r = spread_bases(spark, sf_dir).filter(F.length("seq") >= 42)
    pair = F.array(F.struct(F.lit(0).alias("ordinal"), F.substring("seq", 21, 10).alias("contig")), F.struct(F.lit(1).alias("ordinal"), F.reverse(F.substring("seq", 31, 12)).alias("contig")))
    return r.select("group_key", F.col("seq").alias("main"), F.explode(pair).alias("c")).select("group_key", "c.*", "main")


@query(f"WITH {CONTIGS}, {BEST} SELECT group_key, ordinal, contig, CAST(o AS INTEGER) AS offset, CAST(distance AS INTEGER) AS distance FROM b")
def window_align(spark, sf_dir):
    return align.window_align(contigs(spark, sf_dir))


@query(f"WITH {CONTIGS} SELECT group_key, ordinal, row_number() OVER (PARTITION BY group_key ORDER BY length(contig) DESC, ordinal) AS place FROM c")
def contig_order(spark, sf_dir):
    return contigs(spark, sf_dir).select("group_key", "ordinal", F.row_number().over(Window.partitionBy("group_key").orderBy(*align.by_length())).cast("long").alias("place"))


@query(f"WITH {CONTIGS}, {BEST} SELECT group_key, main || chr(10) || string_agg(repeat(' ', o) || contig, chr(10) ORDER BY length(contig) DESC, ordinal) AS text FROM b GROUP BY group_key, main")
def align_layout(spark, sf_dir):
    return align.render(contigs(spark, sf_dir))


@query(f"WITH {READS}, p AS (SELECT group_key, replace(seq, 'AC', 'A') AS contig, seq AS main FROM reads WHERE seq <> '') SELECT group_key, contig, CAST(levenshtein(contig, main) AS INTEGER) AS distance, 'pairwise' AS mode FROM p WHERE length(contig) >= 0.85 * length(main)")
def near_full_align(spark, sf_dir):
    """Of each document the contig without the C behind an A, aligned as a whole if it is nearly as long as the document's bases."""
    rows = spread_bases(spark, sf_dir).filter("seq <> ''").select("group_key", F.lit(0).alias("ordinal"), F.replace("seq", F.lit("AC"), F.lit("A")).alias("contig"), F.col("seq").alias("main"))
    return align.layout(rows.filter(F.length("contig") >= align.NEAR_FULL * F.length("main"))).select("group_key", "contig", "distance", "mode")


@query("SELECT l_partkey AS src, l_suppkey AS dst, arg_min(l_quantity, l_orderkey * 100 + l_linenumber) AS weight FROM lineitem GROUP BY ALL")
def weighted_edges_part_supplier(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return digraph.weighted(rows.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal")))


@query(f"WITH {EVENT_PAIRS} SELECT src, dst, multiplicity FROM e")
def event_transitions(spark, sf_dir):
    return events(spark, sf_dir)


@query(f"WITH {PART_PAIRS}, {degrees_sql('e', '')} SELECT id, out_deg, in_deg, n_out, n_in FROM d")
def degrees_part_supplier(spark, sf_dir):
    return digraph.degrees(parts(spark, sf_dir))
