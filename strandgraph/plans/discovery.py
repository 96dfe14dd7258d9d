"""Queries of finding things: entities in texts, names by their parts, neighbours of vectors. Each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tagging as T
from ..operators import trigrams as G
from ..operators.vector_index import VectorIndex
from ..sources import star
from .catalog import ENTITY, entities, query

LABELS = r"""lab AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
labs AS (SELECT array_to_string(p, ' ') AS phrase, CAST(len(p) AS INTEGER) AS size, min(id) AS id FROM (SELECT id, unnest([w[1:4], w[1:2], w[5:6]]) AS p FROM lab) WHERE len(p) > 0 GROUP BY ALL)"""
#: The reader's scan as a fold: a match is appended where the last one kept has ended.
MENTIONS = rf"""{LABELS},
dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
runs AS (SELECT doc_id, i - 1 AS start, n AS size, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT size AS n FROM labs))),
met AS (SELECT runs.doc_id, start, size, phrase, id FROM runs JOIN labs USING (phrase, size)),
top AS (SELECT doc_id, start, max(size) AS size FROM met GROUP BY ALL),
folded AS (SELECT doc_id, list_reduce(list(struct_pack(s := start, e := start + size, p := [start]) ORDER BY start), lambda a, x: CASE WHEN x.s >= a.e THEN struct_pack(s := x.s, e := x.e, p := list_append(a.p, x.s)) ELSE a END).p AS starts FROM top GROUP BY doc_id),
mention AS (SELECT met.doc_id, CAST(met.start AS INTEGER) AS start, met.size, met.phrase, met.id FROM (SELECT doc_id, unnest(starts) AS start FROM folded) f JOIN top ON top.doc_id = f.doc_id AND top.start = f.start JOIN met ON met.doc_id = f.doc_id AND met.start = f.start AND met.size = top.size)"""


def _mentions(spark, sf_dir):
    return T.mentions(star.read(spark, sf_dir, "documents").select("doc_id", "text"), star.topics(spark, sf_dir))


@query(f"WITH {MENTIONS} SELECT doc_id, start, size, phrase, id FROM mention")
def document_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir)


@query(f"WITH {MENTIONS} SELECT doc_id, id, count(*) AS times, min(start) AS first FROM mention GROUP BY doc_id, id")
def document_links(spark, sf_dir):
    return T.linked(_mentions(spark, sf_dir))


@query(rf"""WITH {MENTIONS}, names AS (SELECT doc_id, lower(unnest(list_distinct(regexp_extract_all(text, '\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+){{1,4}}')))) AS label FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM mention))
SELECT label, count(DISTINCT doc_id) AS docs FROM names WHERE label NOT IN (SELECT phrase FROM labs) GROUP BY label HAVING count(DISTINCT doc_id) >= 3""")
def shadow_labels(spark, sf_dir):
    docs = star.read(spark, sf_dir, "documents").select("doc_id", "text")
    rejected = T.gate(docs, _mentions(spark, sf_dir))[1]
    return T.shadows(rejected, star.topics(spark, sf_dir), 3).select("label", F.col("docs"))


@query(f"WITH {ENTITY} SELECT DISTINCT substr(lower(name) || chr(0) || chr(0), CAST(i AS BIGINT), 3) AS gram, id FROM (SELECT id, name, unnest(range(1, length(name) + 1)) AS i FROM entity)")
def name_trigrams(spark, sf_dir):
    return G.postings(entities(spark, sf_dir))


def _by_trigrams(spark, sf_dir, q, kind=None, limit=20):
    rows = entities(spark, sf_dir)
    return G.search(G.TrigramIndex.build(rows), rows, q, kind, limit)


@query(f"WITH {ENTITY} SELECT * FROM entity WHERE name ILIKE '%widget%' ESCAPE '\\' ORDER BY id LIMIT 20")
def search_trigrams(spark, sf_dir):
    return _by_trigrams(spark, sf_dir, " Widget ")


@query(f"WITH {ENTITY} SELECT * FROM entity WHERE kind = 'drug' AND name ILIKE '%ol_%gi_m%' ESCAPE '\\' ORDER BY id LIMIT 20")
def search_trigrams_wildcard(spark, sf_dir):
    return _by_trigrams(spark, sf_dir, "OL_%gi_m", "drug")


@query(f"WITH {ENTITY} SELECT * FROM entity WHERE name ILIKE '%1-%7%' ESCAPE '\\' ORDER BY id LIMIT 20")
def search_trigrams_short(spark, sf_dir):
    return _by_trigrams(spark, sf_dir, "1-%7")


@query("""WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT q.vec_id AS query, v.vec_id AS key, round(list_dot_product(q.x, v.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(v.x, v.x))), 6) AS similarity FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, key, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key) AS place FROM s QUALIFY place <= 10""")
def vector_neighbours(spark, sf_dir):
    """The searches' stated queries, rows whose id is divisible by 20, against all rows."""
    vectors = star.read(spark, sf_dir, "embeddings")
    return VectorIndex.build(vectors).search(vectors.where("vec_id % 20 = 0"), 10)
