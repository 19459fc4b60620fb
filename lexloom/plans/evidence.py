"""Evidence: ranked lists merged, interleaved and traced; graph retrieval; document lists; evaluation."""

from pyspark.sql import functions as F

from ..catalog import frame, run_sql
from ..functions import text as texts
from ..functions.vectors import cosine
from ..operators import languages
from ..operators.graph import neighbourhood
from ..operators.patches import leaves, merged_documents
from ..workspace import Workspace
from .registry import query, sql

# two ranked lists for each user: their latest events, and their events of highest value
_LISTS = """a AS (SELECT user_id, event_type AS key, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) - 1 AS rank FROM {events}
  GROUP BY user_id, event_type),
 b AS (SELECT user_id, event_type AS key, row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, event_type) - 1 AS rank FROM {events}
  WHERE event_type <> 'view' GROUP BY user_id, event_type)"""
_MERGED = f"""WITH {_LISTS}, u AS (SELECT user_id, key, 0 AS source, rank FROM a UNION ALL SELECT user_id, key, 1, rank FROM b),
 s AS (SELECT user_id, key, sum(1.0{{D}} / (61 + rank)) AS score, min(source * 1000 + rank) AS seen FROM u GROUP BY user_id, key)
 SELECT user_id, key, CAST(row_number() OVER (PARTITION BY user_id
  ORDER BY score DESC, seen) AS INT) AS place, round(score / max(score) OVER (PARTITION BY user_id), 9) AS relevance FROM s"""
sql("e3_merged_evidence", f"SELECT * FROM ({_MERGED.replace('{D}', 'D')}) WHERE place <= 8", f"SELECT * FROM ({_MERGED.replace('{D}', '::DOUBLE')}) WHERE place <= 8")

_RANKED = "SELECT thread_id, ordinal, row_number() OVER (PARTITION BY thread_id ORDER BY length(text) DESC, ordinal) - 1 AS i FROM {messages} WHERE text IS NOT NULL"
sql(
    "e5_edges_best_order",
    f"SELECT thread_id, ordinal, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY CASE WHEN i % 2 = 0 THEN i ELSE 1000000 - i END) AS INT) AS place FROM ({_RANKED})",
    f"""WITH r AS ({_RANKED}), l AS (SELECT thread_id, list_concat(list(ordinal ORDER BY i) FILTER (WHERE i % 2 = 0), coalesce(list(ordinal
  ORDER BY i DESC) FILTER (WHERE i % 2 = 1), [])) AS o FROM r GROUP BY thread_id)
  SELECT thread_id, unnest(o) AS ordinal, CAST(generate_subscripts(o, 1) AS INT) AS place FROM l""",
)
sql(
    "f13_ranking_trace",
    f"""WITH {_LISTS} SELECT user_id, key, selected, CAST(row_number() OVER (PARTITION BY user_id ORDER BY selected DESC, rank, key) AS INT) AS place
  FROM (SELECT user_id, key, TRUE AS selected, rank FROM a WHERE rank < 2 UNION ALL SELECT b.user_id, b.key, FALSE, b.rank FROM b LEFT ANTI
  JOIN (SELECT * FROM a WHERE rank < 2) s ON b.user_id = s.user_id AND b.key = s.key)""",
    f"""WITH {_LISTS} SELECT user_id, key, selected, CAST(row_number() OVER (PARTITION BY user_id ORDER BY selected DESC, rank, key) AS INT) AS place
  FROM (SELECT user_id, key, TRUE AS selected, rank FROM a WHERE rank < 2 UNION ALL SELECT b.user_id, b.key, FALSE, b.rank FROM b
  WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.rank < 2 AND b.user_id = a.user_id AND b.key = a.key))""",
)
sql(
    "g4_merged_hits",
    f"""WITH {_LISTS} SELECT user_id, key, 0 AS arm FROM a WHERE rank < 2 UNION ALL SELECT b.user_id, b.key, 1 FROM b LEFT ANTI JOIN (SELECT * FROM a
  WHERE rank < 2) s ON b.user_id = s.user_id AND b.key = s.key""",
    f"""WITH {_LISTS} SELECT user_id, key, 0 AS arm FROM a WHERE rank < 2 UNION ALL SELECT user_id, key, 1 FROM b
  WHERE (user_id, key) NOT IN (SELECT (user_id, key) FROM a WHERE rank < 2)""",
)


@query("f8_memory_recall", """WITH v AS (SELECT * FROM {vectors}), q AS (SELECT embedding AS q FROM v WHERE chunk_id = 3)
  SELECT chunk_id, CAST(row_number() OVER (ORDER BY s DESC, chunk_id) AS INT) AS place
  FROM (SELECT chunk_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS s FROM v, q WHERE category <> 4
  AND embedding IS NOT NULL ORDER BY s DESC, chunk_id LIMIT 5)""")
def f8(spark, sf_dir):
    """The five memories nearest to one, superseded ones (a category here) left out."""
    from pyspark.sql import Window as W

    vectors = frame(spark, sf_dir, "vectors")
    wanted = vectors.where("chunk_id = 3").select("embedding").limit(1).collect()  # the question's vector
    if not wanted:
        return vectors.limit(0).select("chunk_id", F.lit(0).alias("place"))
    question = F.array(*(F.lit(float(x)) for x in wanted[0]["embedding"]))
    best = vectors.where("category <> 4 AND embedding IS NOT NULL").select("chunk_id", F.round(cosine(F.col("embedding"), question), 6).alias("s")).orderBy(F.desc("s"), "chunk_id").limit(5)
    return best.select("chunk_id", F.row_number().over(W.orderBy(F.desc("s"), "chunk_id")).alias("place"))  # five rows


_K12 = """WITH e AS (SELECT src, predicate, dst, evidence FROM {edges}), n AS (SELECT 's2' AS id UNION SELECT dst FROM e WHERE src = 's2' UNION SELECT src
  FROM e WHERE dst = 's2'),
 i AS (SELECT * FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) ORDER BY evidence DESC, src, predicate, dst LIMIT 40)"""


@query("k12_graph_retrieval", f"""{_K12}
  SELECT src, predicate, dst, CAST(row_number() OVER (ORDER BY evidence DESC, src, predicate, dst) AS INT) AS place, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY evidence DESC, src, predicate, dst)) AS score
  FROM i""")
def k12(spark, sf_dir):
    """Triples around a linked node, by falling evidence, at most 40, with rank scores."""
    from pyspark.sql import Window as W

    from ..operators.graph import induced_edges

    near = neighbourhood(frame(spark, sf_dir, "provenance"), spark.createDataFrame([("s2",)], "id string"), 1)
    inner = induced_edges(frame(spark, sf_dir, "edges"), near, 40)
    place = F.row_number().over(W.orderBy(F.desc("evidence"), "src", "predicate", "dst"))  # of 40 rows
    return inner.select("src", "predicate", "dst", place.alias("place"), (1.0 / (60 + place)).alias("score"))


@query("l35_graph_hits", f"""{_K12}, p AS (SELECT src, predicate, dst, min(document_id) AS document_id FROM {{provenance}} GROUP BY ALL)
  SELECT document_id, count(*) AS triples, max(evidence) AS evidence FROM i JOIN p USING (src, predicate, dst) GROUP BY document_id""")
def l35(spark, sf_dir):
    """The first document of each retrieved triple, each document once."""
    from ..operators.graph import induced_edges

    provenance = frame(spark, sf_dir, "provenance")
    near = neighbourhood(provenance, spark.createDataFrame([("s2",)], "id string"), 1)
    inner = induced_edges(frame(spark, sf_dir, "edges"), near, 40)
    first = provenance.join(F.broadcast(inner), ["src", "predicate", "dst"]).groupBy("src", "predicate", "dst", "evidence").agg(F.min("document_id").alias("document_id"))  # 40 rows at most
    return first.groupBy("document_id").agg(F.count("*").alias("triples"), F.max("evidence").alias("evidence"))


@query("k7_graph_lookup", """SELECT DISTINCT predicate, dst AS other, 'out' AS way FROM {provenance} WHERE src = 'n3' UNION ALL SELECT DISTINCT predicate, src, 'in'
  FROM {provenance} WHERE dst = 'n3'""")
def k7(spark, sf_dir):
    edges = frame(spark, sf_dir, "provenance")
    out, into = (edges.where(F.col(a) == "n3").select("predicate", F.col(b).alias("other"), F.lit(way).alias("way")).distinct() for a, b, way in (("src", "dst", "out"), ("dst", "src", "in")))
    return out.unionByName(into)


sql(
    "l36_relationship_block",
    """SELECT DISTINCT p.src, p.predicate, p.dst FROM {provenance} p LEFT SEMI JOIN (SELECT o_orderkey AS document_id FROM {orders}
  WHERE o_orderpriority = '1-URGENT') k ON p.document_id = k.document_id""",
    "SELECT DISTINCT src, predicate, dst FROM {provenance} WHERE document_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
sql(
    "k5_passages_tool",
    """SELECT document_id, count(*) AS passages, max_by(chunk_id, struct(n, chunk_id)) AS best
  FROM (SELECT document_id, chunk_id, size(regexp_extract_all(lower(text), '[a-z]*tion', 0)) AS n FROM {chunks}) WHERE n > 0 GROUP BY document_id""",
    """SELECT document_id, count(*) AS passages, arg_max(chunk_id, row(n, chunk_id)) AS best
  FROM (SELECT document_id, chunk_id, len(regexp_extract_all(lower(text), '[a-z]*tion')) AS n FROM {chunks}) WHERE n > 0 GROUP BY document_id""",
)
sql(
    "k8_corpus_tools",
    """SELECT 'documents' AS what, count(*) AS n FROM {docs} WHERE status = 'active' UNION ALL SELECT 'tenants', count(DISTINCT tenant_id) FROM {docs}
  UNION ALL SELECT concat('category ', category), count(DISTINCT document_id) FROM {links} GROUP BY category UNION ALL SELECT 'records', count(*)
  FROM {records}""",
)
sql(
    "c17_document_list",
    """SELECT d.id, coalesce(e.n, 0) AS entities, coalesce(c.n, 0) AS chunks, p.category AS primary_category, f.done FROM {docs} d LEFT
  JOIN (SELECT document_id, count(*) AS n FROM {entities} GROUP BY document_id) e ON e.document_id = d.id
       LEFT JOIN (SELECT document_id, count(*) AS n FROM {chunks} GROUP BY document_id) c ON c.document_id = d.id LEFT
  JOIN (SELECT document_id, min_by(category, rank) AS category FROM {links} GROUP BY document_id) p ON p.document_id = d.id
       LEFT JOIN (SELECT document_id, count_if(status = 'done') AS done FROM {ledger} GROUP BY document_id) f ON f.document_id = d.id
  WHERE d.status = 'active'""",
    """WITH d AS (SELECT * FROM {docs} WHERE status = 'active'), e AS (SELECT document_id, count(*) AS n FROM {entities}
  GROUP BY 1), c AS (SELECT document_id, count(*) AS n FROM {chunks} GROUP BY 1), p AS (SELECT document_id, category FROM {links}
  WHERE rank = 0), f AS (SELECT document_id, count(*) FILTER (WHERE status = 'done') AS done FROM {ledger} GROUP BY 1)
       SELECT d.id, coalesce(e.n, 0) AS entities, coalesce(c.n, 0) AS chunks, p.category AS primary_category, f.done FROM d LEFT
  JOIN e ON e.document_id = d.id LEFT JOIN c ON c.document_id = d.id LEFT JOIN p ON p.document_id = d.id LEFT JOIN f ON f.document_id = d.id""",
)
sql(
    "g8_best_relations",
    """SELECT src, predicate, dst, max_by(document_id, struct(score, -document_id)) AS document_id, max(score) AS score
  FROM (SELECT src, predicate, dst, document_id, CAST(abs(document_id) % 10 AS DOUBLE) / 10 AS score FROM {provenance}) GROUP BY src, predicate, dst""",
    """SELECT src, predicate, dst, document_id, score FROM (SELECT *, row_number() OVER (PARTITION BY src, predicate, dst
  ORDER BY score DESC, document_id) AS n FROM (SELECT src, predicate, dst, document_id, CAST(abs(document_id) % 10 AS DOUBLE) / 10 AS score
  FROM {provenance})) WHERE n = 1""",
)
# What each event says about its user, as a merge patch: nested values, lists that replace, nulls that delete, scalars over objects.
_PATCHES = """SELECT user_id, event_id, CASE event_id % 5
  WHEN 0 THEN concat('{"profile": {"tags": ["', event_type, '", ', event_id % 7, '], "address": {"zip": ', event_id % 1000, ', "city": null}}}')
  WHEN 1 THEN concat('{"profile": {"address": {"city": "', event_type, '"}}, "props": ', props, '}')
  WHEN 2 THEN concat('{"seen": {"', event_type, '": {"at": ', event_id, ', "n": ', event_id % 3, '}}, "props": {"k": null}}')
  WHEN 3 THEN concat('{"profile": ', CASE WHEN event_id % 2 = 0 THEN '{"address": "none"}' ELSE 'null' END, ', "last": "', event_type, '"}')
  ELSE concat('{"seen": {"', event_type, '": null}, "last": {"type": "', event_type, '", "more": {}}}') END AS patch FROM {events}"""


@query(
    "g11_merged_patches",
    """WITH merged AS (SELECT user_id, list_reduce(list(CAST(patch AS JSON) ORDER BY event_id), lambda a, b: json_merge_patch(a, b), CAST('{}' AS JSON)) AS j FROM ("""
    + _PATCHES.replace("{events}", "events")
    + """) WHERE patch IS NOT NULL GROUP BY user_id)
SELECT user_id, replace(substr(t.fullkey, 2), '.', '/') AS path, CASE WHEN t.type = 'OBJECT' THEN 'object' ELSE 'value' END AS kind,
  CASE WHEN t.type = 'OBJECT' THEN NULL ELSE CAST(t.value AS VARCHAR) END AS value FROM merged, json_tree(merged.j) t WHERE NOT contains(t.fullkey, '[')""",
)
def g11_patches(spark, sf_dir):
    """The document that all events of a user leave, by its paths."""
    return leaves(merged_documents(run_sql(spark, sf_dir, _PATCHES), ["user_id"], "event_id", "patch"), ["user_id"])


sql(
    "g11_json_upsert",
    """WITH o AS (SELECT user_id, max_by(from_json(props, 'map<string,int>'), event_id) AS m FROM {events} WHERE event_type = 'view'
  GROUP BY user_id), n AS (SELECT user_id, map('k', CAST(max(event_id) AS INT), 'seen', CAST(count(*) AS INT)) AS m FROM {events}
  WHERE event_type = 'click' AND user_id % 3 = 0 GROUP BY user_id)
       SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.m['k'], o.m['k']) AS k, coalesce(n.m['seen'], o.m['seen']) AS seen FROM o FULL
  JOIN n ON o.user_id = n.user_id""",
    """WITH o AS (SELECT user_id, CAST(json_extract(arg_max(props, event_id), '$.k') AS INT) AS k FROM events WHERE event_type = 'view'
  GROUP BY user_id), n AS (SELECT user_id, max(event_id) AS k, count(*) AS seen FROM events WHERE event_type = 'click' AND user_id % 3 = 0
  GROUP BY user_id)
       SELECT coalesce(o.user_id, n.user_id) AS user_id, CAST(coalesce(n.k, o.k) AS INT) AS k, CAST(n.seen AS INT) AS seen FROM o FULL
  JOIN n ON o.user_id = n.user_id""",
)
sql(
    "e6_chain_check",
    """WITH l AS (SELECT user_id, event_id, concat_ws('|', event_id, event_type) AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
  FROM {events}),
       c AS (SELECT user_id, n, line, CASE WHEN event_id % 41 = 5 THEN 'broken' ELSE sha2(lag(line) OVER (PARTITION BY user_id
  ORDER BY n), 256) END AS kept FROM l)
       SELECT user_id, min(CASE WHEN n > 1 AND kept <> expected OR n = 1 AND kept IS NOT NULL THEN n END) AS first_break, count(*) AS lines
  FROM (SELECT *, sha2(lag(line) OVER (PARTITION BY user_id ORDER BY n), 256) AS expected FROM c) GROUP BY user_id""",
    """WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
  SELECT user_id, min(n) FILTER (WHERE event_id % 41 = 5) AS first_break, count(*) AS lines FROM l GROUP BY user_id""",
)
sql("d10_tenant_fingerprints",
    "SELECT tenant_id, format_string('documents=%d;latest=%s', count(*), CAST(max(document_date) AS STRING)) AS print FROM {docs} GROUP BY tenant_id",
    "SELECT tenant_id, printf('documents=%d;latest=%s', count(*), CAST(max(document_date) AS VARCHAR)) AS print FROM {docs} GROUP BY tenant_id")
sql("d23_eval_summary", """SELECT event_type AS kind, count(*) AS cases, avg(CASE WHEN value >= 50 THEN 1.0D ELSE 0.0D END) AS pass_rate, avg(CASE WHEN user_id % 2 = 0 THEN CASE
  WHEN value >= 50 THEN 1.0D ELSE 0.0D END END) AS recall FROM {events} GROUP BY event_type""",
    """SELECT event_type AS kind, count(*) AS cases, count(*) FILTER (WHERE value >= 50) / count(*)::DOUBLE AS pass_rate, count(*) FILTER (WHERE value >= 50
  AND user_id % 2 = 0) / count(*) FILTER (WHERE user_id % 2 = 0)::DOUBLE AS recall FROM events GROUP BY event_type""")
sql("l34_enrichment_cases", """SELECT id, title IS NOT NULL AND length(trim(title)) BETWEEN 1 AND 60 AS title_ok, document_date >= DATE '2024-01-01' AS date_ok, CASE
  WHEN unidentifiable IS NULL THEN TRUE ELSE NOT unidentifiable END AS identity_ok FROM {docs}""", """SELECT id, title IS NOT NULL AND length(trim(title)) BETWEEN 1
  AND 60 AS title_ok, document_date >= DATE '2024-01-01' AS date_ok, coalesce(NOT unidentifiable, TRUE) AS identity_ok FROM {docs}""")
sql(
    "d18_substring_frequencies",
    """SELECT e.document_id, e.value, size(split(lower(d.text), e.value, -1)) - 1 AS n FROM (SELECT document_id, value FROM {entities}
  WHERE frequency >= 2) e JOIN {docs} d ON d.id = e.document_id""",
    """SELECT e.document_id, e.value, CAST((length(lower(d.text)) - length(replace(lower(d.text), e.value, ''))) // length(e.value) AS INT) AS n
  FROM (SELECT document_id, value FROM {entities} WHERE frequency >= 2) e JOIN (SELECT * FROM {docs}) d ON d.id = e.document_id""",
)


@query("h26_languages", """SELECT doc_id AS id, CASE WHEN length(trim(text)) < 20 THEN 'unknown' WHEN m = 0 THEN 'unknown' WHEN en = m THEN 'en' WHEN fr = m THEN 'fr'
  WHEN de = m THEN 'de' ELSE 'es' END AS language FROM (SELECT *, greatest(en, fr, de, es) AS m FROM (SELECT doc_id, text, """ + ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in words)}], x))) AS {lang}" for lang, words in texts.STOPWORDS.items()) + " FROM (SELECT doc_id, text, string_split_regex(lower(text), '[^a-zà-öø-ÿß]+') AS w FROM documents WHERE text IS NOT NULL)))")
def h26(spark, sf_dir):
    return frame(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), texts.language(F.col("text")).alias("language"))


@query(
    "h26_language_model",
    r"""WITH words AS (SELECT doc_id, lang, text, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents),
  cut AS (SELECT word, unnest(list_concat(list_concat(list_transform(range(1, length(word) + 1), lambda i: substr(word, i, 1)), list_transform(range(1, length(word) + 2),
    lambda i: substr(' ' || word || ' ', i, 2))), list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3)))) AS gram FROM (SELECT DISTINCT word FROM words)),
  counts AS (SELECT lang, gram, sum(n) AS n FROM (SELECT lang, word, count(*) AS n FROM words WHERE lang IS NOT NULL GROUP BY lang, word) JOIN cut USING (word) GROUP BY lang, gram),
  kinds AS (SELECT length(gram) AS k, count(DISTINCT gram) AS v FROM counts GROUP BY k),
  sizes AS (SELECT lang, k, CAST(round(ln(sum(n) + any_value(v)) * 1000000) AS BIGINT) AS base FROM counts JOIN kinds ON k = length(gram) GROUP BY lang, k),
  gained AS (SELECT c.word, s.lang, sum(coalesce(CAST(round(ln(n + 1) * 1000000) AS BIGINT), 0) - base) AS score FROM cut c JOIN sizes s ON s.k = length(c.gram) LEFT JOIN counts o ON o.lang = s.lang AND o.gram = c.gram GROUP BY ALL),
  scored AS (SELECT doc_id, lang, sum(score) AS score FROM (SELECT doc_id, word FROM words WHERE length(trim(text)) >= 20) JOIN gained USING (word) GROUP BY doc_id, lang),
  best AS (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS n FROM scored) WHERE n = 1)
SELECT d.doc_id AS id, coalesce(b.lang, 'unknown') AS language FROM documents d LEFT JOIN best b USING (doc_id)""",
)
def h26_model(spark, sf_dir):
    """Each document's language by the model that all labelled documents teach."""
    ws, docs = Workspace(spark, "languages"), frame(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    words = ws.save(languages.word_counts(docs), "words")
    return languages.detected(docs, languages.Model(languages.gram_counts(words), ws), words, ws).select(F.col("doc_id").alias("id"), "language")


@query("h28_term_plausibility", r"""SELECT DISTINCT term, length(regexp_replace(term, '[^\p{L}]', '', 'g')) >= 3 AND NOT regexp_matches(term, '(RUNS)')
   AND NOT regexp_matches(term, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Cyrillic}]')
  AND length(regexp_replace(term, '[^aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ]', '', 'g')) >= 0.15 * length(regexp_replace(term, '[^\p{L}]', '', 'g'))
  AND length(regexp_replace(term, '[^aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ]', '', 'g')) > 0 AS plausible
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS term FROM documents)""".replace("RUNS", "|".join(4 * chr(c) for c in [*range(97, 123), *range(0xE0, 0xF7), *range(0xF8, 0x100)])))
def h28(spark, sf_dir):
    terms = frame(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))).alias("term")).distinct()
    return terms.select("term", texts.plausible(F.col("term")).alias("plausible"))
