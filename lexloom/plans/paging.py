"""Sorted lists and pages."""

import datetime

from pyspark.sql import functions as F

from ..catalog import frame
from ..operators.paging import decode_cursor, encode_cursor, page
from .registry import query, sql


@query("f1_keyset_page", """SELECT id, document_date FROM {docs} WHERE status = 'active' AND (document_date < DATE '2024-06-01' OR document_date = DATE '2024-06-01' AND id < 500)
  ORDER BY document_date DESC NULLS LAST, id DESC LIMIT 25""")
def f1(spark, sf_dir):
    day, last = decode_cursor(encode_cursor("document_date", True, "2024-06-01", 500), "document_date", True)
    docs = frame(spark, sf_dir, "docs").where("status = 'active'").select("id", "document_date")
    return page(docs, "document_date", 25, after=(datetime.date.fromisoformat(day), last))


@query("f1_keyset_page_nulls", """SELECT id, n FROM (SELECT id, CASE WHEN id % 3 <> 0 THEN id % 10 END AS n FROM {docs}) WHERE n > 8 OR n = 8 AND id > 100 OR n IS NULL
  ORDER BY n NULLS LAST, id LIMIT 200""")
def f1_nulls(spark, sf_dir):
    rows = frame(spark, sf_dir, "docs").select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 10).alias("n"))
    return page(rows, "n", 200, descending=False, after=(8, 100))


sql("f2_sort_by_counts", """SELECT d.id, coalesce(e.n, 0) AS entities FROM {docs} d LEFT JOIN (SELECT document_id, count(*) AS n FROM {entities}
  GROUP BY document_id) e ON d.id = e.document_id ORDER BY entities DESC, d.id LIMIT 50""",
    """SELECT id, coalesce(e.n, 0) AS entities FROM {docs} LEFT JOIN (SELECT document_id, count(*) AS n FROM {entities}
  GROUP BY document_id) e ON id = e.document_id ORDER BY entities DESC, id LIMIT 50""")
sql("f3_select_all_ids", "SELECT id, (SELECT count(*) FROM {docs}) AS total FROM {docs} ORDER BY id LIMIT 10000", "SELECT id, count(*) OVER () AS total FROM {docs} ORDER BY id LIMIT 10000")
sql("f4_offset_page", "SELECT id, occurred_on FROM {records} ORDER BY occurred_on NULLS LAST, id LIMIT 50 OFFSET 100")
sql("f7_sample_rows", "SELECT id, occurred_on, amount_minor FROM {records} ORDER BY occurred_on DESC NULLS LAST, id LIMIT 20")
sql("f12_oldest_first", """SELECT tenant_id, id FROM (SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id ORDER BY document_date, id) AS place FROM {docs}
  WHERE status = 'active') WHERE place = 1""")
sql("f14_entity_page", "SELECT id, label FROM {nodes} WHERE entity_type = 'ORG' AND contains(lower(label), '1') ORDER BY label, id LIMIT 50")
sql("e1_primary_category", "SELECT document_id, category FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank, category) AS rn FROM {links}) WHERE rn = 1")
sql("e9_recent_turns", "SELECT thread_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ordinal DESC) AS back FROM {messages}) WHERE back <= 8")
sql("l4_records_of_document", "SELECT id, occurred_on FROM {records} WHERE document_id = 7 ORDER BY occurred_on NULLS LAST, id")
sql("l5_entities_of_document", "SELECT value, frequency FROM {entities} WHERE document_id = 5 ORDER BY frequency DESC, value")
sql("l24_thread_summary", "SELECT thread_id, min_by(text, ordinal) AS opening, count(*) AS messages FROM {messages} GROUP BY thread_id")
sql("k17_caps", "SELECT document_id, category FROM {links} WHERE rank < 3")
