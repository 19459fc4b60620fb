"""Predicates and projections over documents, records, categories and metadata."""

from pyspark.sql import functions as F

from ..catalog import frame
from ..operators.filters import document_filter, tri_state
from .registry import query, sql


@query("b1_document_filter", """SELECT id, status, title FROM {docs} WHERE status = 'active' AND contains(lower(title), 'the') AND unidentifiable IS NOT TRUE AND EXISTS (SELECT 1
  FROM {entities} WHERE document_id = id AND value IN ('anything', 'erthinging', 'thingtion'))""")
def b1(spark, sf_dir):
    docs, entities = frame(spark, sf_dir, "docs"), frame(spark, sf_dir, "entities")
    return document_filter(docs, status="active", title="the", unidentifiable=False, entities=entities, any_tokens=["anything", "erthinging", "thingtion"]).select("id", "status", "title")


@query("b2_title_contains", "SELECT id, title FROM {docs} WHERE contains(lower(title), 'th')")
def b2(spark, sf_dir):
    return document_filter(frame(spark, sf_dir, "docs"), title="TH").select("id", "title")


sql("b3_prefix_suggest", "SELECT value, count(*) AS n FROM {entities} WHERE value LIKE 'the%' GROUP BY value", None)


@query("b4_tri_state", """SELECT 'true' AS mode, count(*) AS n FROM {docs} WHERE unidentifiable IS TRUE UNION ALL SELECT 'false', count(*) FROM {docs}
  WHERE unidentifiable IS NOT TRUE UNION ALL SELECT 'any', count(*) FROM {docs}""")
def b4(spark, sf_dir):
    docs = frame(spark, sf_dir, "docs").select("unidentifiable")
    count = lambda mode, flag: tri_state(docs, "unidentifiable", flag).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
    return count("true", True).unionByName(count("false", False)).unionByName(count("any", None))


@query("b6_all_tokens", """SELECT document_id FROM {entities} WHERE value IN (SELECT value FROM {entities} GROUP BY value ORDER BY count(*) DESC, value LIMIT 2)
  GROUP BY document_id HAVING count(DISTINCT value) = 2""")
def b6(spark, sf_dir):
    entities = frame(spark, sf_dir, "entities")
    wanted = [r["value"] for r in entities.groupBy("value").count().orderBy(F.desc("count"), "value").limit(2).collect()]
    return document_filter(entities.select(F.col("document_id").alias("id")).distinct(), entities=entities, all_tokens=wanted).select(F.col("id").alias("document_id"))


sql("b7_tags_any", "SELECT DISTINCT document_id FROM {links} WHERE category IN ('click', 'purchase')")
sql("b7_tags_all", "SELECT document_id FROM {links} WHERE category IN ('click', 'purchase') GROUP BY document_id HAVING count(DISTINCT category) = 2")
sql("b8_category_predicate",
    "SELECT d.id, d.title FROM {docs} d LEFT SEMI JOIN {links} l ON d.id = l.document_id AND l.category = 'view'",
    "SELECT id, title FROM {docs} WHERE id IN (SELECT document_id FROM {links} WHERE category = 'view')")
sql("b9_date_and_unknown_category", """SELECT id, document_date FROM {docs} WHERE document_date BETWEEN DATE '2024-02-01' AND DATE '2024-03-01' AND (NOT EXISTS (SELECT 1 FROM {links}
  WHERE category = 'no such') OR id IN (SELECT document_id FROM {links} WHERE category = 'no such'))""")
sql("b10_record_filter", """SELECT id, merchant, amount_minor FROM {records} WHERE record_type = 'transaction' AND direction = 'debit'
  AND currency = 'USD' OR contains(replace(lower(merchant), ' ', ''), 'green')""")
sql("b11_activity_prefix", "SELECT event_id, ts, event_type FROM {events} WHERE event_type LIKE 'cl%' OR event_type LIKE 'pur%' ORDER BY ts DESC, event_id DESC LIMIT 200")
sql("b12_json_key",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events} WHERE CAST(get_json_object(props, '$.k') AS INT) > 50",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM {events} WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50")
sql("b13_id_list", "SELECT id, title FROM {docs} WHERE id IN (1, 2, 3, 500, 999999)")
sql("b14_tuple_list",
    "SELECT document_id, category, rank FROM {links} LEFT SEMI JOIN (VALUES (1, 'view'), (2, 'click'), (9, 'none')) w(id, name) ON document_id = w.id AND category = w.name",
    "SELECT document_id, category, rank FROM {links} WHERE (document_id, category) IN (VALUES (1, 'view'), (2, 'click'), (9, 'none'))")
sql("b16_snippet", r"""SELECT id, CASE WHEN length(s) > 240 THEN concat(substr(s, 1, 240), '...') ELSE s END AS snippet
  FROM (SELECT id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ')) AS s FROM {docs})""", r"""SELECT id, CASE WHEN length(s) > 240 THEN concat(substr(s, 1, 240), '...') ELSE s END AS snippet
  FROM (SELECT id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS s FROM {docs})""")
sql("b18_metadata_merge", "SELECT id, CASE WHEN id % 3 = 0 THEN title ELSE coalesce(CASE WHEN id % 2 = 0 THEN concat('new ', title) END, title) END AS title FROM {docs}")
sql("b20_routing_gates", """SELECT conv_id, turn, CASE WHEN regexp_like(lower(text), '(how many|count)') AND regexp_like(lower(text), '(document|file)') THEN 'count'
  WHEN regexp_like(lower(text), '(total|sum|spent)') THEN 'aggregate' WHEN regexp_like(lower(text), '(related|between)') THEN 'relational'
  ELSE 'passages' END AS route FROM {conversations} WHERE role = 'user'""",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(how many|count)') AND regexp_matches(lower(text), '(document|file)') THEN 'count'
  WHEN regexp_matches(lower(text), '(total|sum|spent)') THEN 'aggregate' WHEN regexp_matches(lower(text), '(related|between)') THEN 'relational'
  ELSE 'passages' END AS route FROM {conversations} WHERE role = 'user'""")
sql("a4_admission", """SELECT page_id, CASE WHEN length(html) > 20000 THEN 'reject' WHEN contains(url, '.exe') THEN 'quarantine' WHEN url LIKE 'http%' THEN 'allow'
  ELSE 'reject' END AS decision FROM {pages}""")
sql("a3_content_hash", "SELECT page_id, sha2(html, 256) AS sha256 FROM {pages}", "SELECT page_id, sha256(html) AS sha256 FROM {pages}")
sql("a12_registry_rebuild",
    "SELECT d.id FROM {docs} d LEFT ANTI JOIN {links} l ON d.id = l.document_id WHERE d.status = 'active'",
    "SELECT id FROM {docs} WHERE status = 'active' AND id NOT IN (SELECT document_id FROM {links})")
sql("a13_artifact_repair", """SELECT d.id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 0 THEN 'corrupted' ELSE 'ok' END AS state FROM {docs} d LEFT
  JOIN {labels} l ON d.id = l.doc_id WHERE d.status = 'active'""")
sql("a15_hash_chain",
    "SELECT event_id, coalesce(lag(sha2(props, 256)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'start') AS previous FROM {events}",
    "SELECT event_id, coalesce(lag(sha256(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'start') AS previous FROM {events}")
