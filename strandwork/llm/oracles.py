"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from strandwork.llm.reputation import FIRST_ALIKE, LEAST_ALIKE, MOST_ALIKE, SUFFIXES, Rule

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc_table() -> list[int]:
    """What each byte does to a CRC-32 (reversed polynomial EDB88320)."""
    row = list(range(256))
    for _ in range(8):
        row = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in row]
    return row


def resampling_sql(buckets: int, percent: int, least_words: int, seed: int) -> str:
    """op12 for single words."""
    found = lambda table, key: f"SELECT {key}unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {table}"
    return f"""WITH tab AS (SELECT {crc_table()} AS t),
    f AS ({found('documents', 'doc_id, ')}), g AS ({found('benchmark', '')}),
    k AS (SELECT DISTINCT w FROM (SELECT w FROM f UNION ALL SELECT w FROM g)),
    c AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(hex(w)), 2), lambda i: CAST('0x' || substr(hex(w), i, 2) AS BIGINT))), lambda x, b: xor(x >> 8, CAST(t[CAST(xor(x, b) & 255 AS BIGINT) + 1] AS BIGINT))), CAST(4294967295 AS BIGINT)) % {buckets} AS bucket FROM k, tab),
    s AS (SELECT bucket, count(*) AS s FROM f JOIN c USING (w) GROUP BY ALL), t AS (SELECT bucket, count(*) AS t FROM g JOIN c USING (w) GROUP BY ALL),
    gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM f) + {buckets} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT count(*) FROM g) + {buckets} AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
    x AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM f JOIN c USING (w) JOIN gain USING (bucket) GROUP BY ALL),
    y AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id),
    z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM y),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM z WHERE n_features >= {least_words})
    SELECT z.*, CASE WHEN place <= (SELECT {percent} * count(*) // 100 FROM r) THEN place END AS rank FROM z LEFT JOIN r USING (doc_id)"""


def reputation_sql(rules: list[Rule], threshold: float = 0.5, level: float = 0.95) -> str:
    """op11."""
    mean = lambda n, y: f"(({y} + 0.5::DOUBLE) / ({n} + 1.0::DOUBLE))"

    def alike(table: str, share: str) -> str:
        over, room = f"(y - n * p) * (y - n * p) - n * p * (1 - p)", "n * (n - 1) * p * (1 - p)"
        return f"(SELECT least(greatest((greatest(coalesce(sum({over}) / nullif(sum({room}), 0), 0), 0) * count(*) + {FIRST_ALIKE}::DOUBLE) / (count(*) + 1), {LEAST_ALIKE}::DOUBLE), {MOST_ALIKE}::DOUBLE) AS r FROM (SELECT *, {share} AS p FROM {table} WHERE n > 1))"

    def discounted(table: str, r: str) -> str:
        return f"(SELECT *, n / (1 + greatest(n - 1, 0) * r) AS w_n, y / (1 + greatest(n - 1, 0) * r) AS w_y FROM {table}, {r})"

    def below(table: str, r: str, n: str, y: str) -> str:
        """The table with mean m and concentration a taken one level down."""
        return f"(SELECT * EXCLUDE (m, a, q), (greatest({y}, 0) + q * m) / (greatest({n}, 0) + q) AS m, greatest({n}, 0) + q AS a FROM (SELECT x.*, (a / (a + 1) * (1 - r)) / (1 - a / (a + 1) * (1 - r)) AS q FROM {table} x, {r}))"

    pick = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{what(r)}'" for r in sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host)))) + " END"
    last = lambda k: f"array_to_string(list_slice(labels, greatest(len(labels) - {k - 1}, 1), len(labels)), '.')"
    long = f"{last(2)} IN ({', '.join(repr(s) for s in sorted(SUFFIXES))})"
    number = "regexp_matches(bare, '^[0-9.]+$|^\\[')"
    return f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
    o AS (SELECT *, {pick(lambda r: r.host + r.path)} AS rule, {pick(lambda r: r.verdict)} AS ruled FROM p),
    g AS (SELECT host, CAST(count(ruled) AS DOUBLE) AS n, CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) AS y, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|\\.+$', '') AS bare, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|\\.+$', ''), '.') AS labels FROM o GROUP BY ALL),
    h AS (SELECT host, n, y, CASE WHEN {number} THEN bare WHEN {long} THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {number} THEN '' WHEN {long} THEN {last(2)} ELSE {last(1)} END AS suffix FROM g),
    hd AS (SELECT *, sum(n) OVER w AS n_d, sum(y) OVER w AS y_d FROM h WINDOW w AS (PARTITION BY domain, suffix)),
    rh AS {alike('hd', mean('n_d', 'y_d'))}, h2 AS {discounted('h', 'rh')},
    d AS (SELECT domain, suffix, sum(w_n) AS n, sum(w_y) AS y FROM h2 GROUP BY ALL),
    ds AS (SELECT *, sum(n) OVER w AS n_s, sum(y) OVER w AS y_s FROM d WINDOW w AS (PARTITION BY suffix)),
    rd AS {alike('ds', mean('n_s', 'y_s'))}, d2 AS {discounted('d', 'rd')},
    s AS (SELECT suffix, sum(w_n) AS n, sum(w_y) AS y FROM d2 GROUP BY ALL), sa AS (SELECT *, sum(n) OVER () AS n_a, sum(y) OVER () AS y_a FROM s),
    rs AS {alike('sa', mean('n_a', 'y_a'))}, s2 AS (SELECT *, sum(w_n) OVER () AS all_n, sum(w_y) OVER () AS all_y FROM {discounted('s', 'rs')}),
    j0 AS (SELECT h2.host, h2.n, h2.y, h2.w_n, h2.w_y, d2.n AS n_d, d2.y AS y_d, d2.w_n AS w_n_d, d2.w_y AS w_y_d, s2.n AS n_s, s2.y AS y_s, {mean('greatest(all_n - s2.w_n, 0)', 'greatest(all_y - s2.w_y, 0)')} AS m, greatest(all_n - s2.w_n, 0) + 1.0::DOUBLE AS a FROM h2 JOIN d2 ON d2.domain = h2.domain AND d2.suffix = h2.suffix JOIN s2 ON s2.suffix = d2.suffix),
    j1 AS {below('j0', 'rs', 'n_s - w_n_d', 'y_s - w_y_d')}, j2 AS {below('j1', 'rd', 'n_d - w_n', 'y_d - w_y')}, j3 AS {below('j2', 'rh', 'n', 'y')},
    b AS (SELECT host, m AS share, m - {(level / (1 - level)) ** 0.5!r}::DOUBLE * sqrt(greatest(m * (1 - m), 0) / (a + 1)) AS bound FROM j3)
    SELECT page_id, o.host, path, rule, coalesce(ruled, CASE WHEN bound > {threshold} THEN 'block' ELSE 'allow' END) AS verdict, round(share, 6) AS share, round(bound, 6) AS bound FROM o JOIN b USING (host)"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """op13: one pair of tables for each round, the nearest entries and the entries that they give."""
    near = lambda k: f"a{k} AS (SELECT id, part, arg_min(entry, dist * {entries} + entry) AS entry, CAST(min(dist) AS BIGINT) AS dist FROM (SELECT x.id, x.part, b.entry, list_sum(list_transform(list_zip(x.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM x JOIN b{k} b USING (part)) GROUP BY ALL)"
    step = lambda k: f"""m{k} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS p FROM (SELECT a.part, a.entry, i, sum(x.p[i]) AS s, count(*) AS n FROM a{k} a JOIN x USING (id, part), range(1, (SELECT max(len(p)) FROM x) + 1) t(i) GROUP BY ALL) GROUP BY ALL),
    b{k + 1} AS (SELECT b.part, b.entry, coalesce(m.p, b.p) AS p FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""  # noqa: E731
    chain = ",\n    ".join(f"{near(k)},\n    {step(k)}" for k in range(rounds))
    return f"""WITH v AS (SELECT vec_id, label, embedding, len(embedding) // {parts} AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    i AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, w, list_transform(embedding, lambda c: CAST(floor({scale}::DOUBLE * c) AS BIGINT)) AS q FROM v),
    x AS (SELECT id, part, list_slice(q, part * w + 1, part * w + w) AS p FROM i, range({parts}) t(part)),
    b0 AS (SELECT part, id AS entry, p FROM x WHERE id < {entries}),
    {chain}, {near(rounds)},
    e AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL),
    o AS (SELECT vec_id, label, code, error FROM e JOIN i USING (id)),
    h AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"""
