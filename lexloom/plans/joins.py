"""Joins (inner, semi, anti, outer, self, similarity) and set operations."""

from pyspark.sql import functions as F

from ..catalog import frame
from ..functions.names import trigram_pairs
from ..functions.vectors import cosine
from .registry import query, sql

sql("c1_documents_of_entity", """SELECT d.id, d.title FROM {docs} d LEFT SEMI JOIN (SELECT document_id FROM {entities} WHERE entity_type = 'ORG'
  AND contains(value, 'tion')) e ON d.id = e.document_id ORDER BY d.id DESC LIMIT 50""",
    "SELECT id, title FROM {docs} WHERE id IN (SELECT document_id FROM {entities} WHERE entity_type = 'ORG' AND contains(value, 'tion')) ORDER BY id DESC LIMIT 50")
sql("c2_documents_of_category", "SELECT d.id, l.rank FROM {docs} d JOIN {links} l ON d.id = l.document_id WHERE l.category = 'click'")
sql("c3_mentions", """WITH m AS (SELECT DISTINCT document_id AS id FROM {entities} WHERE contains(value, 'blea')) SELECT id, (SELECT count(*)
  FROM m) AS total, (SELECT count(*) FROM m) > 10000 AS truncated FROM m ORDER BY id LIMIT 10000""",
    """SELECT id, count(*) OVER () AS total, count(*) OVER () > 10000 AS truncated FROM (SELECT DISTINCT document_id AS id FROM {entities}
  WHERE contains(value, 'blea')) ORDER BY id LIMIT 10000""")
sql("c5_backfill", """SELECT d.id AS document_id, f.feature FROM {docs} d CROSS JOIN (SELECT DISTINCT feature FROM {ledger}) f LEFT ANTI
  JOIN {ledger} l ON l.document_id = d.id AND l.feature = f.feature WHERE d.status = 'active'""",
    """SELECT id AS document_id, feature FROM {docs} CROSS JOIN (SELECT DISTINCT feature FROM {ledger}) f WHERE status = 'active' AND NOT EXISTS (SELECT 1
  FROM {ledger} WHERE ledger.document_id = id AND ledger.feature = f.feature)""")
sql("c6_orphan_prune", """SELECT n.id FROM {nodes} n LEFT ANTI JOIN (SELECT src AS id FROM {edges} WHERE predicate = 'CUSTOMER_OF' UNION SELECT dst FROM {edges}
  WHERE predicate = 'CUSTOMER_OF') e ON n.id = e.id""",
    "SELECT id FROM {nodes} WHERE id NOT IN (SELECT src FROM {edges} WHERE predicate = 'CUSTOMER_OF' UNION SELECT dst FROM {edges} WHERE predicate = 'CUSTOMER_OF')")
sql("c8_vocabulary_counts", """SELECT v.category, count(l.document_id) AS documents FROM (SELECT DISTINCT event_type AS category FROM {events} UNION SELECT 'unused') v LEFT
  JOIN {links} l ON v.category = l.category GROUP BY v.category""")
sql("c9_co_occurrence", """SELECT a.category AS first, b.category AS second, count(DISTINCT a.document_id) AS documents FROM {links} a
  JOIN {links} b ON a.document_id = b.document_id AND a.category < b.category GROUP BY a.category, b.category""",
    """WITH l AS (SELECT * FROM {links}) SELECT a.category AS first, b.category AS second, count(DISTINCT a.document_id) AS documents FROM l a
  JOIN l b ON a.document_id = b.document_id AND a.category < b.category GROUP BY a.category, b.category""")


_TRIGRAM_SQL = """WITH g AS (SELECT p_partkey AS id, p_type AS block, unnest(list_distinct(flatten(list_transform(string_split(lower(p_name), ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3)))))) AS gram
  FROM part),
 n AS (SELECT id, count(*) AS n FROM g GROUP BY id)
 SELECT a.id AS first, b.id AS second, count(*) / (na.n + nb.n - count(*))::DOUBLE AS score FROM g a JOIN g b ON a.gram = b.gram AND a.block = b.block
  AND a.id < b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id
 GROUP BY a.id, b.id, na.n, nb.n HAVING count(*) * 5 >= 3 * (na.n + nb.n - count(*))"""


@query("c10_fuzzy_pairs", _TRIGRAM_SQL)
def c10(spark, sf_dir):
    part = frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("block"), F.col("p_name").alias("name"))
    return trigram_pairs(part, threshold=(3, 5)).withColumnsRenamed({"a": "first", "b": "second"})


@query("c11_similar_documents", """WITH s AS (SELECT embedding FROM {vectors} WHERE document_id = 7),
 c AS (SELECT v.chunk_id, v.document_id, max(CAST(round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) * 1000000) AS BIGINT)) AS best
  FROM {vectors} v, s WHERE v.document_id <> 7 GROUP BY ALL)
 SELECT document_id, CAST(floor((2 * sum(best) + 10 * count(*)) / (20 * count(*))) AS BIGINT) / 100000.0::DOUBLE AS score FROM c GROUP BY document_id""".replace("{vectors} v", "(SELECT * FROM {vectors}) v"))
def c11(spark, sf_dir):
    """Means of whole millionths, so that both engines round the same numbers. The chunks of one document go to every task while Spark finds them small."""
    vectors = frame(spark, sf_dir, "vectors")
    source = vectors.where("document_id = 7").select(F.col("embedding").alias("q"))
    best = vectors.where("document_id <> 7").crossJoin(source).groupBy("chunk_id", "document_id").agg(F.max(F.round(cosine(F.col("embedding"), F.col("q")) * 1_000_000).cast("long")).alias("best"))
    mean = F.floor((2 * F.sum("best") + 10 * F.count("*")) / (20 * F.count("*")))
    return best.groupBy("document_id").agg((mean / 100_000.0).alias("score"))


sql("c12_edge_display", """SELECT e.src, s.label AS subject, e.predicate, o.label AS object, e.evidence FROM {edges} e JOIN {nodes} s ON e.src = s.id JOIN (SELECT id, label
  FROM {nodes}) o ON e.dst = o.id WHERE e.predicate = 'CUSTOMER_OF' ORDER BY e.evidence DESC, e.src, e.dst LIMIT 50""",
    """WITH n AS (SELECT * FROM {nodes}) SELECT e.src, s.label AS subject, e.predicate, o.label AS object, e.evidence FROM (SELECT * FROM {edges}) e
  JOIN n s ON e.src = s.id JOIN n o ON e.dst = o.id WHERE e.predicate = 'CUSTOMER_OF' ORDER BY e.evidence DESC, e.src, e.dst LIMIT 50""")
sql("c13_chunk_titles", "SELECT c.chunk_id, d.title FROM {chunks} c JOIN {docs} d ON c.document_id = d.id", "SELECT chunk_id, title FROM {chunks} JOIN {docs} ON document_id = id")
sql("c16_alias_resolve", """SELECT c.c_custkey, coalesce(concat('n', n.n_nationkey), concat('node:', c.c_mktsegment)) AS node FROM {customer} c LEFT
  JOIN {nation} n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey < 2""",
    """SELECT c_custkey, coalesce('n' || n_nationkey, concat('node:', c_mktsegment)) AS node FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey
  AND n_regionkey < 2""")
sql("c18_projection_points", """SELECT v.chunk_id, v.category, p.place % 20 AS colour FROM {vectors} v
  JOIN (SELECT category, row_number() OVER (ORDER BY n DESC, category) - 1 AS place FROM (SELECT category, count(*) AS n FROM {vectors}
  GROUP BY category)) p ON v.category = p.category""", """SELECT v.chunk_id, v.category, p.place % 20 AS colour FROM (SELECT * FROM {vectors}) v
  JOIN (SELECT category, row_number() OVER (ORDER BY n DESC, category) - 1 AS place FROM (SELECT category, count(*) AS n FROM {vectors}
  GROUP BY category)) p ON v.category = p.category""")
sql("c22_repoint_merge", """SELECT coalesce(m.target, p.src) AS src, p.predicate, p.dst, count(*) AS evidence FROM {provenance} p LEFT
  JOIN (SELECT concat('c', c_custkey) AS alias, concat('c', c_custkey - 1) AS target FROM {customer} WHERE c_custkey % 2 = 0
  AND c_custkey > 1) m ON p.src = m.alias GROUP BY ALL""")
sql("c23_circuit_breaker", """SELECT e.src, e.predicate, e.dst FROM {edges} e JOIN (VALUES ('CUSTOMER_OF'), ('LOCATED_IN')) v(predicate) ON e.predicate = v.predicate LEFT SEMI
  JOIN {nodes} n ON n.id = e.src AND n.entity_type IN ('PERSON', 'ORG')""",
    "SELECT src, predicate, dst FROM {edges} WHERE predicate IN ('CUSTOMER_OF', 'LOCATED_IN') AND src IN (SELECT id FROM {nodes} WHERE entity_type IN ('PERSON', 'ORG'))")
sql("g4_additive_merge", """SELECT chunk_id FROM {vectors} WHERE category = 1 UNION ALL SELECT v.chunk_id FROM {vectors} v LEFT ANTI JOIN (SELECT chunk_id FROM {vectors}
  WHERE category = 1) a ON v.chunk_id = a.chunk_id WHERE v.category IN (1, 2)""", "SELECT chunk_id FROM {vectors} WHERE category = 1 UNION ALL SELECT chunk_id FROM {vectors} WHERE category = 2")
sql("g5_set_operations", """SELECT 'both' AS kind, n.k AS id FROM (SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier}) n
  UNION ALL SELECT 'only', k FROM (SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000) m""")
sql("g6_exact_dedup", "SELECT id, min(id) OVER (PARTITION BY tenant_id, sha256) AS duplicate_of FROM {docs}")
sql("g8_mention_dedup", "SELECT src, predicate, dst, max_by(document_id, document_id) AS best FROM {provenance} GROUP BY ALL")
sql("g10_replace", "SELECT document_id, category, rank FROM {links} WHERE document_id NOT IN (1, 2) UNION ALL SELECT 1, 'fresh', 0")
sql("g11_upsert", """SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT n_nationkey AS k, n_name AS v FROM {nation} WHERE n_nationkey < 20) o FULL
  JOIN (SELECT n_nationkey AS k, lower(n_name) AS v FROM {nation} WHERE n_nationkey > 10) n ON o.k = n.k""")
