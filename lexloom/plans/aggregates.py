"""Money, facets, histograms, fingerprints and evaluation metrics."""

from .registry import sql

sql("d1_money_by_currency",
    "SELECT currency, coalesce(sum(amount_minor), 0) AS total_minor, count(*) AS n FROM {records} GROUP BY currency",
    "SELECT currency, CAST(coalesce(sum(amount_minor), 0) AS BIGINT) AS total_minor, count(*) AS n FROM {records} GROUP BY currency")
sql("d2_confidence_buckets", """SELECT count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence >= 0.5
  AND confidence < 0.8) AS middle, count(*) FILTER (WHERE confidence < 0.5) AS low, count(*) FILTER (WHERE confidence IS NULL) AS unknown FROM {records}""")
sql("d2_debit_credit",
    """SELECT currency, CAST(sum(amount_minor) FILTER (WHERE direction = 'debit') AS BIGINT) AS debit, CAST(sum(amount_minor) FILTER (WHERE direction = 'credit') AS BIGINT) AS credit
  FROM {records} GROUP BY currency""")
sql("d3_date_range", "SELECT tenant_id, min(occurred_on) AS first_day, max(occurred_on) AS last_day FROM {records} GROUP BY tenant_id")
sql("d4_type_counts", "SELECT record_type, count(*) AS n FROM {records} GROUP BY record_type")
sql("d5_top_merchants", """SELECT merchant, currency, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM {records} GROUP BY merchant, currency
  ORDER BY n DESC, merchant, currency NULLS LAST LIMIT 5""")
sql("d6_entity_facets", """SELECT entity_type, value, count(DISTINCT document_id) AS documents, CAST(sum(frequency) AS BIGINT) AS occurrences FROM {entities}
  GROUP BY entity_type, value ORDER BY occurrences DESC, value, entity_type LIMIT 100""")
sql("d7_facet_suggest", """WITH e AS (SELECT document_id, value FROM {entities}), s AS (SELECT value AS picked FROM e GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)
  SELECT e.value, count(DISTINCT e.document_id) AS documents FROM e JOIN (SELECT document_id FROM e
  JOIN s ON e.value = s.picked) d ON e.document_id = d.document_id WHERE e.value NOT IN (SELECT picked FROM s) AND e.value LIKE 't%' GROUP BY e.value""")
sql("d8_counts_by_document", "SELECT document_id, count(*) AS n FROM {entities} GROUP BY document_id")
sql("d9_corpus_stats",
    "SELECT count(DISTINCT entity_type, value) AS entities, count(DISTINCT document_id) AS documents, count(*) AS mentions FROM {entities}",
    "SELECT count(DISTINCT (entity_type, value)) AS entities, count(DISTINCT document_id) AS documents, count(*) AS mentions FROM {entities}")
sql("d9_status_histogram", "SELECT status, count(*) AS n, count(DISTINCT document_id) AS documents FROM {ledger} GROUP BY status")
sql("d10_fingerprint",
    "SELECT concat('chunks=', CAST(count(*) AS STRING), ';latest=', CAST(max(document_id) AS STRING)) AS token FROM {chunks}",
    "SELECT concat('chunks=', CAST(count(*) AS VARCHAR), ';latest=', CAST(max(document_id) AS VARCHAR)) AS token FROM {chunks}")
sql("d12_node_types", "SELECT entity_type, count(*) AS n FROM {nodes} GROUP BY entity_type")
sql("d13_graph_counts", "SELECT (SELECT count(*) FROM {nodes}) AS nodes, (SELECT count(*) FROM {edges}) AS edges")
sql("d14_shared_names", "SELECT lower(split_part(c_mktsegment, ' ', 1)) AS family, count(*) AS n FROM {customer} WHERE c_acctbal > 0 GROUP BY ALL HAVING count(*) > 1")
sql("d15_thread_counts", "SELECT thread_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars, max(ordinal) AS last FROM {messages} GROUP BY thread_id")
sql("d16_evidence_recount", "SELECT src, predicate, dst, count(*) AS evidence FROM {provenance} GROUP BY src, predicate, dst")
sql("d17_occurrence_fold", """SELECT document_id, lower(value) AS folded, min_by(value, place) AS surface, count(*) AS frequency
  FROM (SELECT id AS document_id, posexplode(regexp_extract_all(text, '[A-Z][a-z]{6,}', 0)) AS (place, value) FROM {docs})
  GROUP BY document_id, lower(value)""", """SELECT document_id, lower(value) AS folded, min_by(value, place) AS surface, count(*) AS frequency
  FROM (SELECT id AS document_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS value, unnest(generate_series(1, len(regexp_extract_all(text, '[A-Z][a-z]{6,}')))) AS place
  FROM {docs}) GROUP BY document_id, lower(value)""")
sql("d18_substring_frequency", "SELECT id, greatest(1, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT)) AS frequency FROM {docs}")
sql("d19_dual_lens", """SELECT 'title' AS lens, count(*) AS documents FROM {docs} WHERE contains(lower(title), 'ing') UNION ALL SELECT 'mention', count(DISTINCT document_id)
  FROM {entities} WHERE contains(value, 'ing')""")
sql("d21_usage_sum", "SELECT role, CAST(sum(greatest(1, CAST(floor(length(text) / 4) AS BIGINT))) AS BIGINT) AS tokens, bool_or(length(text) < 40) AS any_short FROM {messages} GROUP BY role")
sql("d22_telemetry_fold", """SELECT document_id, count(*) AS steps, CAST(sum(CASE WHEN status = 'done' THEN attempts END) AS BIGINT) AS measured, max(last_attempt) AS latest
  FROM {ledger} GROUP BY document_id""")
sql("d23_eval_metrics", "SELECT lang, avg(CAST(quality AS DOUBLE)) AS pass_rate, count(*) AS n FROM {labels} JOIN {documents} USING (doc_id) GROUP BY lang")
sql("d24_edge_scores", """WITH e AS (SELECT src, predicate, dst, count(DISTINCT document_id) > 1 AS gold, count(*) > 1 AS predicted FROM {provenance} GROUP BY src, predicate, dst),
  c AS (SELECT predicate, sum(CASE WHEN gold THEN 1 ELSE 0 END) AS gold, sum(CASE WHEN predicted THEN 1 ELSE 0 END) AS predicted,
  sum(CASE WHEN gold AND predicted THEN 1 ELSE 0 END) AS hits FROM e GROUP BY predicate)
  SELECT predicate, CAST(gold AS BIGINT) AS gold, CAST(predicted AS BIGINT) AS predicted, CAST(hits AS DOUBLE) / nullif(CAST(predicted AS DOUBLE), 0.0) AS precision,
  CAST(hits AS DOUBLE) / nullif(CAST(gold AS DOUBLE), 0.0) AS recall, CAST(2 * hits AS DOUBLE) / nullif(CAST(gold + predicted AS DOUBLE), 0.0) AS f1 FROM c""",
  """WITH e AS (SELECT src, predicate, dst, count(DISTINCT document_id) > 1 AS gold, count(*) > 1 AS predicted FROM {provenance} GROUP BY src, predicate, dst),
  c AS (SELECT predicate, count(*) FILTER (WHERE gold) AS gold, count(*) FILTER (WHERE predicted) AS predicted, count(*) FILTER (WHERE gold AND predicted) AS hits FROM e GROUP BY predicate)
  SELECT predicate, gold, predicted, hits / nullif(predicted, 0)::DOUBLE AS precision, hits / nullif(gold, 0)::DOUBLE AS recall, 2 * hits / nullif(gold + predicted, 0)::DOUBLE AS f1 FROM c""")
sql("d25_summary_cube", """SELECT currency, direction, grouping(currency) AS all_currencies, grouping(direction) AS all_directions, count(*) AS n FROM {records}
  GROUP BY CUBE (currency, direction)""", """SELECT currency, direction, CAST(grouping(currency) AS TINYINT) AS all_currencies, CAST(grouping(direction) AS TINYINT) AS all_directions, count(*) AS n
  FROM {records} GROUP BY CUBE (currency, direction)""")
