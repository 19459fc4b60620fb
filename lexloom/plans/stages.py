"""The ledger drained, stages in order, rate limits, sources and sinks, evidence and evaluation."""

from pyspark.sql import functions as F

from ..catalog import frame
from ..functions.text import text_quality
from ..operators import resolution, stages as st
from ..operators.graph import both_ways
from ..workspace import Workspace
from .registry import query, sql

_NOW = "2024-01-30 12:00:00"


@query("j7_drained_ledger", f"""WITH l AS (SELECT * FROM {{ledger}}), due AS (SELECT *, status = 'pending' OR status = 'failed' AND attempts < 3
  AND floor(epoch(TIMESTAMP '{_NOW}')) - floor(epoch(last_attempt)) >= 30 * pow(2, greatest(attempts - 1, 0)) OR status = 'running'
  AND floor(epoch(TIMESTAMP '{_NOW}')) - floor(epoch(last_attempt)) >= 600 AS d FROM l),
 first AS (SELECT *, d AND feature NOT IN ('purchase', 'click') AS hit FROM due), views AS (SELECT document_id FROM first WHERE feature = 'view'
  AND (status = 'done' AND NOT hit OR hit AND document_id % 7 <> 0)),
 both_ AS (SELECT *, hit OR d AND feature IN ('purchase', 'click') AND document_id IN (SELECT document_id FROM views) AS h FROM first)
 SELECT document_id, feature, CAST(CASE WHEN h THEN attempts + 1 ELSE attempts END AS INT) AS attempts, CASE WHEN h THEN CASE
  WHEN document_id % 7 = 0 THEN 'failed' ELSE 'done' END ELSE status END AS status FROM both_""")
def j7(spark, sf_dir):
    needs = spark.createDataFrame([("purchase", "view"), ("click", "view")], "feature string, prerequisite string")
    table = st.drained(frame(spark, sf_dir, "ledger"), needs, _NOW, F.col("document_id") % 7 == 0)
    return table.select("document_id", "feature", "attempts", "status")


@query("l23_seeded_ledger", """WITH l AS (SELECT document_id, feature, version, status FROM {ledger}) SELECT * FROM l UNION ALL SELECT d.document_id, s.feature, s.version, 'pending'
  FROM (SELECT DISTINCT document_id FROM l) d, (VALUES ('embed', 3), ('view', 2)) s(feature, version) WHERE NOT EXISTS (SELECT 1 FROM l
  WHERE l.document_id = d.document_id AND l.feature = s.feature)""")
def l23(spark, sf_dir):
    ledger = frame(spark, sf_dir, "ledger")
    return st.seeded(ledger, ledger, spark.createDataFrame([("embed", 3), ("view", 2)], "feature string, version int"))


@query("j11_token_buckets", """WITH RECURSIVE e AS (SELECT event_id, user_id, floor(epoch(ts))::DOUBLE AS s, row_number() OVER (PARTITION BY user_id
  ORDER BY floor(epoch(ts)), event_id) AS n FROM events WHERE user_id IS NOT NULL),
 r(event_id, user_id, s, n, held, ok) AS (SELECT event_id, user_id, s, n, 1.0::DOUBLE, TRUE FROM e WHERE n = 1
  UNION ALL SELECT event_id, user_id, s, n, CASE WHEN h >= 1 THEN h - 1 ELSE h END, h >= 1
  FROM (SELECT e.*, least(2.0::DOUBLE, r.held + (e.s - r.s) * 0.00001::DOUBLE) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
 SELECT event_id AS call_id, CAST(user_id AS VARCHAR) AS key, ok AS allowed, CAST(CASE WHEN ok THEN 0
  ELSE floor((1 - held) / 0.00001::DOUBLE) + 1 END AS INT) AS retry_after FROM r""")
def j11(spark, sf_dir):
    calls = frame(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("key"), F.floor(F.unix_timestamp("ts")).alias("at"))
    return st.rate_limited(calls, 2.0, 0.00001)


@query("j14_folds_applied", """WITH n AS (SELECT id, entity_type, string_split(value, ' ') AS w FROM (SELECT entity_type, value, min(id) AS id FROM {named}
  GROUP BY entity_type, value)), o AS (SELECT regexp_full_match(x, '[0-9]+|i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii|xiii|xiv|xv|xvi|xvii|xviii|xix|xx') AS o, x
  FROM (SELECT DISTINCT unnest(w) AS x FROM n)),
 s AS (SELECT a.id AS a, b.id AS b, len(b.w) AS n FROM n a JOIN n b ON a.entity_type = b.entity_type AND len(b.w) > len(a.w) AND b.w[1:len(a.w)] = a.w
  JOIN o ON o.x = b.w[len(a.w) + 1] AND NOT o.o WHERE length(array_to_string(a.w, ' ')) >= 3),
 f AS (SELECT a, min(b) AS b FROM s WHERE n = (SELECT max(n) FROM s t WHERE t.a = s.a) GROUP BY a HAVING count(*) = 1),
 m AS (SELECT x.id AS document_id, n.id FROM {named} x JOIN n ON n.entity_type = x.entity_type AND array_to_string(n.w, ' ') = x.value)
 SELECT coalesce(f.b, m.id) AS node, count(*) AS mentions FROM m LEFT JOIN f ON f.a = m.id GROUP BY 1""".replace("FROM {named} x", "FROM (SELECT * FROM {named}) x"))
def j14(spark, sf_dir):
    """Mentions of each node after one pass of folds."""
    named = frame(spark, sf_dir, "named")
    nodes = resolution.nodes_of(named).select("id", "entity_type", "value")
    mentions = named.select("entity_type", "value").join(nodes, ["entity_type", "value"])
    return mentions.join(resolution.alias_folds(named), F.col("id") == F.col("alias_id"), "left").groupBy(F.coalesce("canonical_id", "id").alias("node")).agg(F.count("*").alias("mentions"))


@query("k2_stage_registry", "SELECT lang, count(*) AS documents, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY lang")
def k2(spark, sf_dir):
    """Stages given out of order, run in order of what they need."""
    registry = st.Stages()

    @registry.add("rollup", "tokens", "languages")
    def rollup(tokens, languages):
        return tokens.join(languages, "doc_id").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))

    @registry.add("tokens", "documents")
    def tokens(docs):
        return docs.where("text IS NOT NULL").select("doc_id", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"))

    @registry.add("languages", "documents")
    def languages(docs):
        return docs.select("doc_id", "lang")

    registry.add("documents")(lambda: None)
    return registry.run(Workspace(spark, "stages"), documents=frame(spark, sf_dir, "documents"))["rollup"]


@query("a2_mime_types", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/x-empty'
  WHEN 3 THEN 'application/octet-stream' ELSE CASE WHEN regexp_matches(html, '^\\s*<(!doctype html|html)', 'i') THEN 'text/html'
  ELSE 'text/plain' END END AS mime FROM pages WHERE html IS NOT NULL""")
def a2(spark, sf_dir):
    k, html = F.col("page_id") % 5, F.col("html").cast("binary")
    content = F.when(k == 0, F.concat(F.unhex(F.lit("255044462D312E37")), html)).when(k == 1, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), html)).when(k == 2, F.unhex(F.lit(""))).when(k == 3, F.concat(F.unhex(F.lit("4100420043")), html)).otherwise(html)
    return frame(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", st.mime_of(content).alias("mime"))


@query("a16_replaced_partitions", """SELECT n_regionkey AS tenant, n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 'fresh' ELSE n_name END AS name FROM nation
  WHERE n_regionkey <> 2 OR n_nationkey % 2 = 0""")
def a16(spark, sf_dir):
    """A table by tenant, of which one tenant's rows are then replaced."""
    folder = Workspace(spark, "sink").path("points")
    rows = frame(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("tenant"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    st.replace_partitions(rows, folder, ["tenant"])
    st.replace_partitions(rows.where("tenant = 2 AND id % 2 = 0").withColumn("name", F.lit("fresh")), folder, ["tenant"])
    return spark.read.schema(rows.schema).parquet(folder)


@query("a11_artifacts", "SELECT id, tenant_id, sha256, length(text) AS size FROM {docs} WHERE status = 'active' AND tenant_id IS NOT NULL")
def a11(spark, sf_dir):
    """A manifest line and the content of each document, by tenant, written and read back."""
    ws = Workspace(spark, "artifacts")
    docs = frame(spark, sf_dir, "docs").where("status = 'active' AND tenant_id IS NOT NULL")
    docs.select("tenant_id", F.to_json(F.struct("id", "sha256")).alias("value")).write.partitionBy("tenant_id").text(ws.path("manifest"))
    docs.select("tenant_id", "id", "text").write.partitionBy("tenant_id").json(ws.path("content"))
    manifest = spark.read.schema("value string, tenant_id string").text(ws.path("manifest")).select("tenant_id", F.from_json("value", "id long, sha256 string").alias("m"))
    content = spark.read.schema("id long, text string, tenant_id string").json(ws.path("content"))
    return manifest.select("tenant_id", "m.*").join(content.select("id", F.length("text").cast("long").alias("size")), "id").select("id", "tenant_id", "sha256", "size")


@query("a5_whole_texts", "SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(length(concat('# ', n_name, chr(10), n_name, chr(10)))) AS BIGINT) AS characters FROM nation")
def a5(spark, sf_dir):
    """Files of markdown, each read as one text."""
    folder = Workspace(spark, "texts").path("files")
    nation = frame(spark, sf_dir, "nation")
    nation.select(F.concat(F.lit("# "), "n_name", F.lit("\n"), "n_name").alias("value"), F.col("n_nationkey").alias("k")).repartition(25, "k").write.partitionBy("k").text(folder)
    texts = spark.read.text(folder, wholetext=True)
    return texts.agg(F.count("*").alias("files"), F.sum(F.length("value")).alias("characters"))


@query("a21_tenant_scan", "SELECT id, title FROM {docs} WHERE tenant_id = 'src1' AND status = 'active'")
def a21(spark, sf_dir):
    """One tenant's rows of a table that is kept by tenant: only its folder is read."""
    folder = Workspace(spark, "tenants").path("docs")
    frame(spark, sf_dir, "docs").where("status = 'active'").select("id", "title", "tenant_id").write.partitionBy("tenant_id").parquet(folder)
    return spark.read.parquet(folder).where("tenant_id = 'src1'").select("id", "title")


@query("i19_hmac",
    "SELECT n_nationkey AS id, sha256(unhex(o) || unhex(sha256(unhex(i) || encode(n_name)))) AS mac FROM nation, (SELECT '{o}' AS o, '{i}' AS i)".replace("{o}", bytes(b ^ 0x5C for b in b"secret".ljust(64, b"\0")).hex()).replace("{i}", bytes(b ^ 0x36 for b in b"secret".ljust(64, b"\0")).hex()))
def i19(spark, sf_dir):
    return frame(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), st.hmac_sha256("secret", F.col("n_name")).alias("mac"))


@query("i12_projection")
def i12(spark, sf_dir):
    return st.projected(frame(spark, sf_dir, "vectors"))


@query("g1_reachable", """WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}), r(id, depth) AS (SELECT 's3', 0 UNION
  SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.id WHERE depth < 2) SELECT * FROM r""")
def g1(spark, sf_dir):
    """Every (node, depth) that walks of up to two edges reach."""
    edges = frame(spark, sf_dir, "provenance")
    now = found = spark.createDataFrame([("s3", 0)], "id string, depth int")
    for depth in (1, 2):
        now = both_ways(edges).join(now, F.col("a") == F.col("id")).select(F.col("b").alias("id")).distinct().withColumn("depth", F.lit(depth))
        found = found.unionByName(now)
    return found


@query("g2_walks", """WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {edges} WHERE predicate IN ('LOCATED_IN', 'PART_OF')), r(id, path) AS (SELECT a, [a] FROM e
  WHERE a LIKE 's%' UNION ALL SELECT e.b, list_append(path, e.b) FROM r JOIN e ON e.a = r.id AND NOT list_contains(path, e.b) WHERE len(path) < 4)
  SELECT id, array_to_string(path, '>') AS path FROM r""")
def g2(spark, sf_dir):
    """Every walk from suppliers over places, no node twice."""
    edges = frame(spark, sf_dir, "edges").where("predicate IN ('LOCATED_IN', 'PART_OF')").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    now = found = edges.where("a LIKE 's%'").select(F.col("a").alias("id"), F.array("a").alias("path"))
    for _ in range(3):
        now = now.join(edges, F.col("id") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("id"), F.array_append("path", F.col("b")).alias("path"))
        found = found.unionByName(now)
    return found.select("id", F.array_join("path", ">").alias("path"))


@query("l29_metadata_stage", "SELECT doc_id AS id, left(text, 6000) = text AS whole, trim(string_split(text, chr(10))[1]) AS title FROM documents WHERE text IS NOT NULL")
def l29(spark, sf_dir):
    """The flag reads the whole text, the title its head only."""
    docs = frame(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("quality", text_quality(F.col("text"))).where("quality >= 0")
    return docs.select(F.col("doc_id").alias("id"), (F.substr("text", F.lit(1), F.lit(6000)) == F.col("text")).alias("whole"), F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


sql("b17_vector_literals",
    """SELECT chunk_id, concat('[', array_join(transform(embedding, x -> CAST(round(CAST(x AS DOUBLE), 3) + 0.0D AS STRING)), ','), ']') AS literal, size(from_json(to_json(embedding), 'array<float>')) AS n
  FROM {vectors}""",
    """SELECT chunk_id, concat('[', array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE), 3) + 0.0::DOUBLE AS VARCHAR)), ','), ']') AS literal, CAST(len(embedding) AS INT) AS n
  FROM {vectors}""")
sql("i13_projection_fingerprints",
    "SELECT concat_ws('|', format_string('chunks=%d;latest=%d', count(*), max(chunk_id)), 'pca', '2') AS fingerprint FROM {vectors}",
    "SELECT concat_ws('|', printf('chunks=%d;latest=%d', count(*), max(chunk_id)), 'pca', '2') AS fingerprint FROM {vectors}")
sql(
    "l42_projection_status",
    """WITH now AS (SELECT category AS dim, format_string('chunks=%d;latest=%d', count(*), max(chunk_id)) AS print, count(*) AS points FROM {vectors}
  GROUP BY category), kept AS (SELECT category AS dim, format_string('chunks=%d;latest=%d', count(*), max(chunk_id)) AS print FROM {vectors}
  WHERE category % 3 <> 0 OR chunk_id % 2 = 0 GROUP BY category HAVING category <> 1)
  SELECT n.dim, k.dim IS NOT NULL AS computed, coalesce(k.print <> n.print, FALSE) AS stale, n.points FROM now n LEFT JOIN kept k ON n.dim = k.dim""",
    """SELECT category AS dim, category <> 1 AS computed, category % 3 = 0
  AND count(*) > count(*) FILTER (WHERE chunk_id % 2 = 0) AS stale, count(*) AS points FROM {vectors} GROUP BY category""",
)
sql("i15_term_frequencies", """SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, explode(split(lower(text), '[^a-z]+')) AS term FROM {documents})
  WHERE length(term) >= 3 GROUP BY doc_id, term""",
    """SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents)
  WHERE length(term) >= 3 GROUP BY doc_id, term""")
sql("l43_context_sizes", """SELECT thread_id, CASE WHEN role = 'user' THEN 'question' WHEN role = 'assistant' THEN 'answer'
  ELSE 'other' END AS bucket, sum(length(text)) AS characters, CAST(floor(sum(length(text)) / 4 + 0.5) AS BIGINT) AS tokens FROM {messages} GROUP BY ALL""",
    """SELECT thread_id, CASE WHEN role = 'user' THEN 'question' WHEN role = 'assistant' THEN 'answer'
  ELSE 'other' END AS bucket, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(floor(sum(length(text)) / 4 + 0.5) AS BIGINT) AS tokens
  FROM {messages} GROUP BY ALL""")
sql(
    "k16_compacted_threads",
    """SELECT thread_id, ordinal, role, n > 8 AND place = 8 AS summarised FROM (SELECT *, row_number() OVER (PARTITION BY thread_id
  ORDER BY ordinal DESC) AS place, count(*) OVER (PARTITION BY thread_id) AS n FROM {messages}) WHERE place <= 8""",
    """SELECT thread_id, ordinal, role, (SELECT count(*) FROM (SELECT * FROM {messages}) o WHERE o.thread_id = m.thread_id) > 8 AND later = 7 AS summarised
  FROM (SELECT thread_id, ordinal, role, (SELECT count(*) FROM (SELECT * FROM {messages}) o WHERE o.thread_id = x.thread_id
  AND o.ordinal > x.ordinal) AS later FROM (SELECT * FROM {messages}) x) m WHERE later < 8""",
)
sql("l1_active_by_hash", """SELECT a.id AS id, min(b.id) AS active FROM {docs} a JOIN {docs} b ON a.tenant_id = b.tenant_id AND a.sha256 = b.sha256 AND b.status = 'active'
  WHERE a.status = 'duplicate' GROUP BY a.id""", """WITH d AS (SELECT * FROM {docs}) SELECT id, (SELECT min(b.id) FROM d b WHERE a.tenant_id = b.tenant_id AND a.sha256 = b.sha256) AS active FROM d a
  WHERE status = 'duplicate' AND tenant_id IS NOT NULL""")
sql("l39_terminal_states", """SELECT d.id, CASE WHEN d.status = 'duplicate' THEN 'duplicate' WHEN length(trim(coalesce(d.text, ''))) = 0 THEN 'failed'
  ELSE 'active' END AS state, CASE WHEN d.status = 'duplicate' THEN f.first END AS duplicate_of FROM {docs} d LEFT
  JOIN (SELECT tenant_id, sha256, min(id) AS first FROM {docs} GROUP BY tenant_id, sha256) f ON d.tenant_id <=> f.tenant_id AND d.sha256 <=> f.sha256""",
    """SELECT id, CASE WHEN status = 'duplicate' THEN 'duplicate' WHEN length(trim(coalesce(text, ''))) = 0 THEN 'failed' ELSE 'active' END AS state, CASE
  WHEN status = 'duplicate' THEN min(id) OVER (PARTITION BY tenant_id, sha256) END AS duplicate_of FROM {docs}""")
sql("l6_chunk_vectors", """SELECT c.chunk_id, v.chunk_id AS vector_id, size(v.embedding) AS dim FROM (SELECT chunk_id, CAST(document_id AS BIGINT) AS k FROM {chunks}
  WHERE start = 0) c JOIN {vectors} v ON c.k = v.chunk_id""", """SELECT c.chunk_id, v.chunk_id AS vector_id, CAST(len(v.embedding) AS INT) AS dim FROM (SELECT chunk_id, document_id AS k FROM {chunks}
  WHERE start = 0) c JOIN (SELECT * FROM {vectors}) v ON c.k = v.chunk_id""")
sql("l9_documents_of_node", "SELECT document_id, min(src) AS first FROM {provenance} WHERE dst = 's1' GROUP BY document_id ORDER BY first, document_id LIMIT 50")
sql("l15_verdicts",
    "SELECT user_id, event_type, max_by(value, struct(ts, event_id)) AS verdict FROM {events} GROUP BY user_id, event_type",
    """SELECT user_id, event_type, value AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n
  FROM events) WHERE n = 1""")
sql("l3_job_lists", "SELECT event_id, user_id, ts FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
sql("l38_understanding", """SELECT conv_id, turn, nullif(trim(x.query), '') AS query, x.category, try_cast(x.since AS DATE) AS since FROM (SELECT conv_id, turn, from_json(CASE
  WHEN turn % 3 = 0 THEN 'no json' ELSE to_json(named_struct('query', CASE WHEN turn % 2 = 0 THEN role
  ELSE ' ' END, 'category', 'invoice', 'since', CASE WHEN turn % 2 = 0 THEN '2024-02-01'
  ELSE 'soon' END)) END, 'query string, category string, since string') AS x FROM {conversations})""",
    """SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 AND turn % 2 = 0 THEN role END AS query, CASE WHEN turn % 3 <> 0 THEN 'invoice' END AS category, CASE
  WHEN turn % 3 <> 0 AND turn % 2 = 0 THEN DATE '2024-02-01' END AS since FROM conversations""")
sql("l33_answer_cases", """SELECT conv_id, count(*) AS turns, avg(CASE WHEN contains(lower(text), 'the') THEN 1.0D ELSE 0.0D END) AS correct, sum(CASE
  WHEN text IS NULL OR length(text) < 20 THEN 1 ELSE 0 END) AS refused FROM {conversations} WHERE role = 'assistant' GROUP BY conv_id""",
    """SELECT conv_id, count(*) AS turns, avg(CASE WHEN contains(lower(text), 'the') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS correct, CAST(sum(CASE
  WHEN text IS NULL OR length(text) < 20 THEN 1 ELSE 0 END) AS BIGINT) AS refused FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
sql("l41_processing_summaries", """SELECT document_id, count_if(status = 'done') AS done, count_if(status = 'failed') AS failed, count(*) AS features, max(attempts) AS attempts
  FROM {ledger} GROUP BY document_id""",
    """SELECT document_id, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS features, max(attempts) AS attempts
  FROM {ledger} GROUP BY document_id""")
sql("l2_activated", "SELECT id, CASE WHEN id % 4 = 0 AND status = 'active' THEN TRUE ELSE FALSE END AS changed FROM {docs}", "SELECT id, id % 4 = 0 AND status = 'active' AS changed FROM {docs}")
