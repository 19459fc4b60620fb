"""Knowledge graph: neighbourhoods, paths, profiles, components."""

from pyspark.sql import functions as F

from ..catalog import frame
from ..operators.graph import induced_edges, label_components, neighbourhood, shortest_paths
from .registry import query, sql

_STEPS = "b AS (SELECT DISTINCT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges})"


@query("c14_neighbourhood", f"""WITH {_STEPS}, d1 AS (SELECT b AS id FROM b WHERE a = 'c7'), d2 AS (SELECT DISTINCT b.b AS id FROM b JOIN d1 ON b.a = d1.id)
 SELECT 'c7' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2 WHERE id <> 'c7' AND id NOT IN (SELECT id FROM d1)""")
def c14(spark, sf_dir):
    return neighbourhood(frame(spark, sf_dir, "provenance"), spark.createDataFrame([("c7",)], "id string"), 2)


@query("c14_induced_edges", f"""WITH {_STEPS}, n AS (SELECT 'c7' AS id UNION SELECT b FROM b WHERE a = 'c7')
 SELECT src, predicate, dst, evidence FROM {{edges}} WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def c14b(spark, sf_dir):
    edges = frame(spark, sf_dir, "edges")
    return induced_edges(edges, neighbourhood(frame(spark, sf_dir, "provenance"), spark.createDataFrame([("c7",)], "id string"), 1))


def _paths(end: str, most: int) -> str:
    """SQL for the least shortest path from c7 to a node: what each hop reaches first, by its least path."""
    hops = [f"{_STEPS}, p0 AS (SELECT 'c7' AS id, ['c7'] AS path)"]
    for k in range(1, most + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM p{i}" for i in range(k))
        hops.append(f"p{k} AS (SELECT b.b AS id, min(list_append(path, b.b)) AS path FROM p{k - 1} JOIN b ON b.a = p{k - 1}.id WHERE b.b NOT IN ({seen}) GROUP BY b.b)")
    found = " UNION ALL ".join(f"SELECT path FROM p{k} WHERE id = '{end}'" for k in range(1, most + 1))
    return f"WITH {', '.join(hops)} {found}"


@query("c15_shortest_path", _paths("c11", 4))
def c15(spark, sf_dir):
    return shortest_paths(frame(spark, sf_dir, "provenance"), "c7", "c11")


@query("c15_longer_path", _paths("r0", 4) + " UNION ALL " + _paths("r4", 4).replace("WITH ", "SELECT * FROM (WITH ", 1) + ")")
def c15_longer(spark, sf_dir):
    """To two regions: one may lie behind a supplier's nation, three edges away."""
    edges = frame(spark, sf_dir, "provenance")
    return shortest_paths(edges, "c7", "r0").unionByName(shortest_paths(edges, "c7", "r4"))


@query("g12_components", """WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 25 AS b FROM supplier WHERE s_suppkey + 25 <= (SELECT max(s_suppkey)
  FROM supplier)), t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r(id, other) AS (SELECT a, a FROM t UNION SELECT r.id, t.b FROM r JOIN t ON r.other = t.a) SELECT id, min(other) AS label FROM r GROUP BY id""")
def g12(spark, sf_dir):
    supplier = frame(spark, sf_dir, "supplier")
    top = supplier.agg(F.max("s_suppkey").alias("top"))
    links = supplier.join(F.broadcast(top)).where("s_suppkey + 25 <= top").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 25).alias("dst"))
    return label_components(links)


sql("k14_entity_profile",
    "SELECT src, slice(sort_array(collect_list(concat(predicate, ' ', dst))), 1, 5) AS neighbours FROM {edges} GROUP BY src",
    "SELECT src, list_sort(list(concat(predicate, ' ', dst)))[1:5] AS neighbours FROM {edges} GROUP BY src")
sql("l7_canonical_root", "SELECT n_nationkey AS id, CASE WHEN n_nationkey >= 10 THEN n_nationkey % 5 WHEN n_nationkey >= 5 THEN n_nationkey - 5 ELSE n_nationkey END AS root FROM {nation}")
sql("l11_edges_touching", "SELECT src, predicate, dst FROM {edges} WHERE src = 's3' OR dst = 's3'")
sql("l12_provenance", "SELECT predicate, dst, document_id FROM {provenance} WHERE src IN ('c1', 'c2', 'c4')")
sql("l10_purge_document", "SELECT src, predicate, dst, count(*) AS evidence FROM {provenance} WHERE document_id % 100 <> 1 GROUP BY ALL")
sql("b15_canonical_only", "SELECT id, label FROM {nodes} WHERE entity_type IN ('GPE', 'REGION')")
sql("l8_mentions_of_node", "SELECT document_id FROM {provenance} WHERE dst = 's1' ORDER BY document_id LIMIT 50")
sql("e7_unique_longest", """SELECT alias, target
  FROM (SELECT a.n_name AS alias, b.n_name AS target, length(b.n_name) AS len, max(length(b.n_name)) OVER (PARTITION BY a.n_name) AS longest, count(*) OVER (PARTITION BY a.n_name, length(b.n_name)) AS ties
  FROM {nation} a JOIN {nation} b ON a.n_name <> b.n_name AND substr(b.n_name, 1, 1) = substr(a.n_name, 1, 1)) WHERE len = longest AND ties = 1""")
sql("e8_strongest_suggestion",
    "SELECT src, max_by(dst, struct(evidence, dst)) AS best FROM {edges} WHERE predicate = 'CUSTOMER_OF' GROUP BY src",
    "SELECT src, arg_max(dst, row(evidence, dst)) AS best FROM {edges} WHERE predicate = 'CUSTOMER_OF' GROUP BY src")
