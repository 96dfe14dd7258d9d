"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

from . import quality_mcd as Q
from . import shard_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shard_placement() -> str:
    table = ",".join(map(str, shard_table.fill(shard_table.shard_names())))
    return f"""WITH t AS (SELECT string_split('{table}', ',') AS shards),
s AS (SELECT doc_id, CAST(concat('0x', left(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 15)) AS BIGINT) % {shard_table.TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, slot, CAST(shards[slot + 1] AS BIGINT) AS shard FROM s, t"""


def quality_rules() -> str:
    p, pairs = Q.P, Q.PAIRS
    x = ", ".join(f"x_{i}" for i in range(p))
    alias = lambda steps: ", ".join(f"{e} AS {n}" for n, e in steps)
    factor, distance = alias(Q.cholesky_sql()), alias(Q.distance_sql())
    medians = ", ".join(f"quantile_cont(x_{i}, 0.5) AS med_{i}" for i in range(p))
    mads = ", ".join(f"quantile_cont(abs(x_{i} - med_{i}), 0.5) AS mad_{i}, any_value(med_{i}) AS med_{i}" for i in range(p))
    spreads = ", ".join(f"med_{i}, {e} AS s_{i}" for i, e in enumerate(Q.SPREAD_SQL))
    moved = ", ".join(f"{e} AS {'ab'[k - 1]}_{i}" for k, given in Q.START_SQL.items() for i, e in enumerate(given))
    moments = ", ".join(f"sum({c}_{i} * {c}_{j}) AS {c}_{i}_{j}" for c in "ab" for i, j in pairs)
    starts = " UNION ALL ".join(f"SELECT *, {factor} FROM (SELECT group_key, {k} AS start, {alias([(n, e) for n, e in Q.start_columns(k)])} FROM told)" for k in range(Q.STARTS))
    sums = "count(*) AS n, " + ", ".join(f"sum(x_{i}) AS s_{i}" for i in range(p)) + ", " + ", ".join(f"sum(x_{i} * x_{j}) AS s_{i}_{j}" for i, j in pairs)
    mean = {i: f"(CAST(s_{i} AS DOUBLE) / n)" for i in range(p)}
    value = lambda i, j: f"(CAST(s_{i}_{j} AS DOUBLE) / n - {mean[i]} * {mean[j]}) / {float(Q.SCALE) ** 2}" + (f" + {Q.FLOORS[i] ** 2}" if i == j else "")
    update = ", ".join(f"{mean[i]} / {float(Q.SCALE)} AS m_{i}" for i in range(p)) + ", " + ", ".join(f"{value(i, j)} AS c_{i}_{j}" for i, j in pairs)

    def step(k: int, before: str) -> str:
        return f"""b{k} AS MATERIALIZED (SELECT *, {Q.BIN_SQL} AS bin FROM (SELECT group_key, start, {x}, {distance} FROM keyed JOIN {before} USING (group_key))),
q{k} AS MATERIALIZED (SELECT group_key, start, quantile_cont(bin, {Q.SUBSET_PERCENT / 100}) AS limit_bin FROM b{k} GROUP BY group_key, start),
t{k} AS MATERIALIZED (SELECT group_key, start, {sums} FROM b{k} JOIN q{k} USING (group_key, start) WHERE bin <= limit_bin GROUP BY group_key, start),
e{k + 1} AS MATERIALIZED (SELECT *, {factor} FROM (SELECT group_key, start, {update} FROM t{k}))"""

    # Steps beyond the one at which nothing changes any more change nothing: their number is fixed here.
    steps = [step(k, f"e{k}") for k in range(Q.EXPLORE)]
    steps.append(f"best AS MATERIALIZED (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY {Q.LOGDET_SQL}, start) AS place FROM e{Q.EXPLORE}) WHERE place = 1)")
    last = Q.EXPLORE + Q.MOST_STEPS
    steps += [step(k, "best" if k == Q.EXPLORE else f"e{k}") for k in range(Q.EXPLORE, last)]
    last = f"e{last}"
    ws = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang_key, coalesce(source, '') AS source_key, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda v: v <> '') AS words FROM documents),
win AS (SELECT r, i, array_to_string(words[i:i + 2], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY r),
s AS MATERIALIZED (SELECT w.r, doc_id, lang_key, source_key, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(translate(t, '{Q.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
 CAST(len(list_filter(string_split(t, chr(10)), lambda v: length(trim(v, {ws})) > 0)) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda v: length(trim(v, {ws})) > 0))) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN hit ON hit.r = w.r),
f AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s),
v AS MATERIALIZED (SELECT *, {", ".join(f"CASE WHEN NOT base_failed THEN {Q.TRANSFORMS[i]} END AS x_{i}" for i in range(p))} FROM f),
sizes AS (SELECT lang_key, source_key, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
pools AS (SELECT lang_key, sum(n) AS pool FROM sizes WHERE n < {Q.MIN_GROUP} GROUP BY ALL),
keys AS MATERIALIZED (SELECT lang_key, source_key, CASE WHEN n >= {Q.MIN_GROUP} THEN lang_key || chr(1) || source_key WHEN pool >= {Q.MIN_GROUP} THEN lang_key || chr(2) ELSE chr(3) END AS group_key FROM sizes LEFT JOIN pools USING (lang_key)),
keyed AS MATERIALIZED (SELECT group_key, r, {x} FROM v JOIN keys USING (lang_key, source_key) WHERE NOT base_failed),
med AS MATERIALIZED (SELECT group_key, {medians} FROM keyed GROUP BY group_key),
mad AS MATERIALIZED (SELECT group_key, {mads} FROM keyed JOIN med USING (group_key) GROUP BY group_key),
spread AS MATERIALIZED (SELECT group_key, {spreads} FROM mad),
told AS MATERIALIZED (SELECT * FROM spread JOIN (SELECT group_key, count(*) AS n, {moments} FROM (SELECT group_key, {moved} FROM keyed JOIN spread USING (group_key)) GROUP BY group_key) USING (group_key)),
e0 AS MATERIALIZED ({starts}),
{", ".join(steps)},
d AS MATERIALIZED (SELECT group_key, r, {distance} FROM keyed JOIN {last} USING (group_key)),
mid AS (SELECT group_key, greatest(exp(quantile_cont({Q.BIN_SQL}, 0.5) / {float(Q.DISTANCE_SCALE)}) - 1, 1e-9) / {Q.CHI2_MEDIAN} AS factor, count(*) AS members FROM d GROUP BY group_key),
j AS (SELECT r, members < {Q.MIN_POOL} OR d2 / greatest(factor, 1.0) <= {Q.CUT} AS near FROM d JOIN mid USING (group_key))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(near, false) AS kept FROM f LEFT JOIN j USING (r)"""


DECONTAMINATE = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w FROM benchmark),
k AS (SELECT item, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM k)),
at_ AS MATERIALIZED (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win))),
m AS MATERIALIZED (SELECT r, i, at_.size, item FROM at_ JOIN win ON at_.size = win.size AND at_.g = win.g),
hits AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.r = d.r LEFT JOIN items ON items.r = d.r"""

JACCARD = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACES}'), lambda v: v <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON links.a = other)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id"""

WARC = """WITH p AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS h FROM pages),
g AS MATERIALIZED (SELECT r, page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, list_transform(range(0, 4), lambda k: CAST('0x' || substr(sha1(h), 10 * k + 1, 10) AS BIGINT)) AS v FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first_id FROM g)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v[i // 8 + 1] >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""


def _whole(vector: str, scale: int, kind: str) -> str:
    fit = f"{vector} IS NOT NULL AND len({vector}) = 64 AND len(list_filter({vector}, lambda x: x IS NULL OR NOT isfinite(x) OR abs(CAST(x AS DOUBLE) * {scale}) >= 67108864)) = 0"
    return f"list_transform({vector}, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS {kind})) AS x FROM embeddings WHERE {fit}"


#: The floor of s / n for integers: a remainder is taken off first, so that no rounding is left to do.
_FLOOR = "(({s} - (({s} % {n}) + {n}) % {n}) // {n})"


def distinct_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    width = 64 // parts
    apart = " + ".join(f"(d.part[{i}] - c.part[{i}]) * (d.part[{i}] - c.part[{i}])" for i in range(1, width + 1))
    sums = ", ".join(f"CAST(sum(w * part[{i}]) AS BIGINT) AS s{i}" for i in range(1, width + 1))
    mean = ", ".join(_FLOOR.format(s=f"s{i}", n="n") for i in range(1, width + 1))
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT pos, part, w, near // {entries} AS distance, near % {entries} AS entry FROM (SELECT d.pos, d.part, any_value(w) AS w, min(({apart}) * {entries} + entry) AS near FROM d JOIN c{r} c ON c.pos = d.pos GROUP BY d.pos, d.part))")
        if r < rounds:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.pos, c.entry, CASE WHEN n IS NULL THEN c.part ELSE [{mean}] END AS part FROM c{r} c LEFT JOIN (SELECT pos, entry, CAST(sum(w) AS BIGINT) AS n, {sums} FROM a{r} GROUP BY ALL) m ON m.pos = c.pos AND m.entry = c.entry)")
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, {_whole("embedding", 256, "BIGINT")}),
e AS MATERIALIZED (SELECT r, vec_id, label, x, unnest(range({parts})) AS pos FROM k),
p AS MATERIALIZED (SELECT r, vec_id, label, pos, x[{width} * pos + 1:{width} * pos + {width}] AS part FROM e),
d AS MATERIALIZED (SELECT pos, part, count(*) AS w FROM p GROUP BY ALL),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS entry FROM k),
c0 AS MATERIALIZED (SELECT pos, entry, part FROM p JOIN f USING (r) WHERE entry < {entries}),
{", ".join(steps)},
v AS MATERIALIZED (SELECT p.r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lpad(printf('%x', entry), 2, '0'), '' ORDER BY p.pos) AS code, CAST(sum(distance) AS BIGINT) AS error FROM p JOIN a{rounds} a ON a.pos = p.pos AND a.part = p.part GROUP BY p.r),
h AS (SELECT sha256(coalesce(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry), '')) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v, h"""


def centroid_clusters(clusters: int = 8, rounds: int = 10) -> str:
    mean = ", ".join(f"CAST({_FLOOR.format(s=f's{i}', n='n')} AS DOUBLE)" for i in range(1, 65))
    sums = ", ".join(f"CAST(sum(x[{i}]) AS BIGINT) AS s{i}" for i in range(1, 65))
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(CAST(list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y) AS BIGINT) * {clusters} + cluster) AS near FROM k, c{r} GROUP BY r)")
        if r < rounds:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, CASE WHEN n IS NULL THEN c.y ELSE [{mean}] END AS y FROM c{r} c LEFT JOIN (SELECT near % {clusters} AS cluster, count(*) AS n, {sums} FROM a{r} GROUP BY 1) m ON m.cluster = c.cluster)")
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_whole("embedding", 1024, "DOUBLE")}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS cluster, x AS y FROM k QUALIFY cluster < {clusters}),
{", ".join(steps)},
v AS (SELECT vec_id, near % {clusters} AS cluster, near // {clusters} AS distance FROM a{rounds})
SELECT vec_id, CAST(v.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY v.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(y, lambda i: CAST(i AS BIGINT)), ',')) AS centroid_sha256 FROM v JOIN c{rounds} c ON c.cluster = v.cluster"""
