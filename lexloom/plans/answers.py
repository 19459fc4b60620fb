"""Questions and answers: count intents, tools, citations; vocabularies of categories and tags."""

from pyspark.sql import functions as F

from ..catalog import frame, run_sql
from ..functions import names
from ..functions import questions as q
from ..operators import phrases
from ..operators import vocabularies as v
from ..workspace import Workspace
from .registry import query, sql

_QUESTIONS = """SELECT conv_id * 1000 + turn AS id, concat(CASE turn % 5 WHEN 0 THEN 'How many invoices from ' WHEN 1 THEN 'List all documents about '
  WHEN 2 THEN 'how much did I spend at ' WHEN 3 THEN 'Number of letters, please: ' ELSE 'Who is ' END, CASE WHEN conv_id % 4 = 0 THEN 'the system'
  ELSE {word} END, '?') AS question FROM {conversations} WHERE role = 'user' AND text IS NOT NULL"""
_ASKED = _QUESTIONS.replace("{word}", "coalesce(get(regexp_extract_all(lower(text), '[a-z]{5,}', 0), 0), 'm-net')")
_DUCK_ASKED = _QUESTIONS.replace("{word}", "coalesce(regexp_extract_all(lower(text), '[a-z]{5,}')[1], 'm-net')")


def _duck(pattern: str) -> str:
    return "'" + pattern.removeprefix("(?i)").replace("'", "''") + "'"


_INTENT = f"""asked AS ({_DUCK_ASKED}), gated AS (SELECT *, lower(regexp_extract(question, {_duck(q.DOCUMENT_NOUN)}, 1, 'i')) AS noun,
   trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(question, {_duck(q.COUNT_VERB)}, ' ', 'gi'), {_duck(q.DOCUMENT_NOUN)}, ' ', 'gi'), {_duck(q.FILLER)}, ' ', 'gi'), '[^\\w\\s.\\-@&]', ' ', 'g'), '\\s+', ' ', 'g')) AS rest
  FROM asked WHERE regexp_matches(question, {_duck(q.COUNT_VERB)}, 'i') AND regexp_matches(question, {_duck(q.DOCUMENT_NOUN)}, 'i')),
 intents AS (SELECT id, nullif(rest, '') AS entity, CASE WHEN length(noun) > 3 AND noun LIKE '%s' THEN left(noun, length(noun) - 1)
  ELSE noun END AS doc_type FROM gated)"""


def _intents(spark, sf_dir):
    asked = run_sql(spark, sf_dir, _ASKED)
    return asked.select("id", q.count_intent(F.col("question")).alias("i")).where("i IS NOT NULL").select("id", "i.entity", "i.doc_type")


@query("b21_count_intents", f"WITH {_INTENT} SELECT * FROM intents")
def b21(spark, sf_dir):
    return _intents(spark, sf_dir)


def _counts(spark, sf_dir):
    """id, entity, doc_type, titled, mentioned, total: exact counts of active documents under each lens."""
    intents = _intents(spark, sf_dir)
    docs = frame(spark, sf_dir, "docs").where("status = 'active'").select("id", "title")
    needle = F.lower("entity").alias("needle")
    wanted = intents.where("entity IS NOT NULL").select(needle)
    titled = phrases.contained(docs.select("id", F.lower("title").alias("title")), ["id"], wanted, "title").groupBy("needle").agg(F.count("*").alias("titled"))
    mentions = phrases.contained(frame(spark, sf_dir, "entities").select("document_id", "value"), ["document_id"], wanted, "value")
    mentioned = mentions.distinct().groupBy("needle").agg(F.count("document_id").alias("mentioned"))
    total = docs.agg(F.count("*").alias("total"))  # one row
    found = intents.withColumn("needle", F.lower("entity")).join(titled, "needle", "left").join(mentioned, "needle", "left").join(F.broadcast(total))
    return found.select("id", "entity", "doc_type", F.coalesce("titled", F.lit(0)).alias("titled"), F.coalesce("mentioned", F.lit(0)).alias("mentioned"), "total")


_COUNTED = f"""{_INTENT}, d AS (SELECT id, lower(title) AS title FROM {{docs}} WHERE status = 'active'), w AS (SELECT DISTINCT entity FROM intents
  WHERE entity IS NOT NULL), e AS (SELECT document_id, value FROM {{entities}}),
 t AS (SELECT entity, count(*) AS n FROM w JOIN d ON contains(title, lower(entity))
  GROUP BY entity), m AS (SELECT entity, count(DISTINCT document_id) AS n FROM w JOIN e ON contains(value, lower(entity)) GROUP BY entity),
 counted AS (SELECT i.id, i.entity, i.doc_type, coalesce(t.n, 0) AS titled, coalesce(m.n, 0) AS mentioned, (SELECT count(*) FROM d) AS total
  FROM intents i LEFT JOIN t ON t.entity = i.entity LEFT JOIN m ON m.entity = i.entity)"""


@query("k4_count_tool", f"WITH {_COUNTED} SELECT * FROM counted")
def k4(spark, sf_dir):
    return _counts(spark, sf_dir)


@query("l37_count_answers", f"""WITH {_COUNTED}, n AS (SELECT *, CASE WHEN doc_type IN ('document', 'file', 'pdf', 'scan', 'page') THEN ''
  ELSE ' Filtering to only ' || doc_type || 's is not available yet, so this counts all matching documents.' END AS note FROM counted)
 SELECT id, CASE WHEN entity IS NOT NULL
  AND titled + mentioned > 0 THEN 'For “' || entity || '” I found ' || titled || ' with it in the title or name; ' || mentioned || ' that mention it.' || note
  WHEN entity IS NULL AND total > 0 THEN 'There are ' || total || ' in the system.' || note END AS answer FROM n""")
def l37(spark, sf_dir):
    return _counts(spark, sf_dir).select("id", q.count_answer(*(F.col(c) for c in ("entity", "doc_type", "titled", "mentioned", "total"))).alias("answer"))


@query("k6_aggregate_tool", """SELECT merchant, currency, printf('%.2f', sum(amount_minor) / 100.0::DOUBLE) AS total, count(*) AS records FROM {records} WHERE direction = 'debit'
  AND record_type = 'transaction' GROUP BY merchant, currency""")
def k6(spark, sf_dir):
    rows = frame(spark, sf_dir, "records").where("direction = 'debit' AND record_type = 'transaction'")
    return rows.groupBy("merchant", "currency").agg(q.money(F.sum("amount_minor")).alias("total"), F.count("*").alias("records"))


@query("k9_tool_plans", f"""SELECT id, CASE WHEN regexp_matches(question, {_duck(q.COUNT_VERB)}, 'i')
  AND regexp_matches(question, {_duck(q.DOCUMENT_NOUN)}, 'i') THEN 'passages,count'
  WHEN regexp_matches(question, '\\bwho\\b', 'i') THEN 'passages,graph' WHEN regexp_matches(question, {_duck(q.TOTAL)}, 'i') THEN 'passages,total'
  ELSE 'passages' END AS tools FROM ({_DUCK_ASKED})""")
def k9(spark, sf_dir):
    asked, x = run_sql(spark, sf_dir, _ASKED), F.col("question")
    more = F.when(q.asks_count(x), "count").when(x.rlike(r"(?i)\bwho\b"), "graph").when(q.asks_total(x), "total")
    return asked.select("id", F.concat_ws(",", F.lit("passages"), more).alias("tools"))


@query("h42_citations", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '1,3' WHEN 1 THEN '2' ELSE '1,2,3,4' END AS cited, turn % 4 < 2 AS marked FROM conversations WHERE text IS NOT NULL""")
def h42(spark, sf_dir):
    said = F.concat(q.neutralised(F.col("text")), F.when(F.col("turn") % 4 == 0, " see [3] and [1], [3]").when(F.col("turn") % 4 == 1, " [2][9] [0]").otherwise(" [12]"))
    rows = frame(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", q.cited(said, F.lit(4)).alias("c"))
    return rows.select("conv_id", "turn", F.array_join("c", ",").alias("cited"), (F.size("c") < 4).alias("marked"))


@query("h43_phrases", "SELECT p_partkey AS id, contains(concat(' ', lower(p_name), ' '), ' ring ') AS found FROM part")
def h43(spark, sf_dir):
    return frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), q.contains_phrase(names.display_key(F.col("p_name")), F.lit("ring")).alias("found"))


@query("c19_linked_entities", """WITH s AS (SELECT p_name AS surface, min(p_partkey) AS node FROM part GROUP BY p_name UNION ALL SELECT string_split(p_name, ' ')[1], min(p_partkey)
  FROM part GROUP BY 1),
 x AS (SELECT o_orderkey AS id, concat(' do you know the ', (SELECT p_name FROM part
  WHERE p_partkey = o_orderkey % 40), ' from ', lower(o_orderpriority), ' ') AS question FROM orders)
 SELECT DISTINCT id, node FROM x JOIN s ON contains(question, concat(' ', surface, ' ')) AND length(surface) >= 3""")
def c19(spark, sf_dir):
    part = frame(spark, sf_dir, "part")
    surfaces = part.groupBy(F.col("p_name").alias("surface")).agg(F.min("p_partkey").alias("node")).unionByName(part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("surface")).agg(F.min("p_partkey").alias("node")))
    asked = frame(spark, sf_dir, "orders").withColumn("p", F.col("o_orderkey") % 40).join(part.select(F.col("p_partkey").alias("p"), "p_name"), "p")
    asked = asked.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("do you know the "), "p_name", F.lit(" from "), F.lower("o_orderpriority")).alias("question"))
    return phrases.linked_spans(asked, ["id"], surfaces, overlapping=True, text_column="question").select("id", "node").distinct()


@query("i18_first_objects", """SELECT event_id, '{"a": {"k": ' || props || '}}' AS object, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def i18(spark, sf_dir):
    said = F.concat(F.lit('Here it is: {"a": {"k": '), "props", F.lit('}} and {"b": 1}. Bye }'))
    found = frame(spark, sf_dir, "events").select("event_id", q.first_object(said).alias("object"))
    return found.select("event_id", "object", F.get_json_object("object", "$.a.k.k").cast("int").alias("k"))


# labels of documents: variants of order priorities and market segments
_LABELS = """SELECT o_orderkey AS document_id, 1 AS place, CASE o_orderkey % 3 WHEN 0 THEN concat(lower(c_mktsegment), 's') WHEN 1 THEN c_mktsegment
  ELSE concat(c_mktsegment, ' goods') END AS label FROM {orders} JOIN {customer} ON o_custkey = c_custkey UNION ALL
  SELECT o_orderkey, 2, concat('Prio ', o_orderpriority) FROM {orders}"""
_CATEGORIES = "SELECT DISTINCT c_mktsegment AS category FROM {customer} WHERE c_mktsegment <> 'MACHINERY'"
_KEYED = "CASE WHEN length(k) > 3 AND k LIKE '%s' AND k NOT LIKE '%ss' THEN left(k, length(k) - 1) ELSE k END"
_G = "list_distinct(flatten(list_transform(list_filter(string_split_regex(KEY, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3)))))"
_RESOLVED = f"""lab AS ({_LABELS}), cat AS ({_CATEGORIES}), n AS (SELECT label, first, {_KEYED} AS key
  FROM (SELECT label, min(document_id * 10 + place) AS first, trim(regexp_replace(regexp_replace(lower(label), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS k
  FROM lab GROUP BY label)),
 ks AS (SELECT key, arg_min(label, first) AS label, min(first) AS first FROM n GROUP BY key), h AS (SELECT category, {_KEYED} AS held
  FROM (SELECT category, lower(category) AS k FROM cat)),
 s AS (SELECT key, category, held, len(list_intersect({_G.replace('KEY', 'key')}, {_G.replace('KEY', 'held')})) AS b, len(list_distinct(list_concat({_G.replace('KEY', 'key')}, {_G.replace('KEY', 'held')}))) AS e
  FROM ks, h),
 o AS (SELECT key, max(CASE WHEN key = held THEN category END) AS exact, arg_min(category, row(-(b / e::DOUBLE), category)) AS near, max(CASE
  WHEN b * 10 >= e * 7 THEN 1 ELSE 0 END) AS fuzzy FROM s GROUP BY key),
 f AS (SELECT o.*, ks.label, ks.first, CASE WHEN exact IS NULL AND fuzzy = 0 THEN sum(CASE WHEN exact IS NULL AND fuzzy = 0 THEN 1
  ELSE 0 END) OVER (ORDER BY ks.first, o.key) END AS place FROM o JOIN ks USING (key)),
 g AS (SELECT key, CASE WHEN exact IS NOT NULL THEN exact WHEN fuzzy = 1 THEN near WHEN place <= 6 - (SELECT count(*) FROM cat) THEN trim(label)
  ELSE near END AS category, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN fuzzy = 1 THEN 'fuzzy' WHEN place <= 6 - (SELECT count(*)
  FROM cat) THEN 'new' ELSE 'nearest' END AS how FROM f),
 resolved AS (SELECT n.label, n.key, g.category, g.how FROM n JOIN g USING (key))"""


def _resolved(spark, sf_dir):
    labels = run_sql(spark, sf_dir, _LABELS)
    return labels, v.resolve_labels(labels.select("label", (F.col("document_id") * 10 + F.col("place")).alias("first")), run_sql(spark, sf_dir, _CATEGORIES), most=6)


@query("l18_category_cascade", f"WITH {_RESOLVED} SELECT * FROM resolved")
def l18(spark, sf_dir):
    return _resolved(spark, sf_dir)[1]


@query("l19_document_categories", f"""WITH {_RESOLVED}, d AS (SELECT document_id, category, min(place) AS place FROM lab JOIN resolved USING (label) GROUP BY ALL)
  SELECT document_id, category, CAST(row_number() OVER (PARTITION BY document_id ORDER BY place, category) - 1 AS INT) AS rank FROM d""")
def l19(spark, sf_dir):
    labels, resolved = _resolved(spark, sf_dir)
    return v.document_categories(labels, resolved)


@query("l17_new_categories", f"WITH {_RESOLVED} SELECT DISTINCT category FROM resolved WHERE how = 'new'")
def l17(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].where("how = 'new'").select("category").distinct()


@query("f10_nearest_category", f"WITH {_RESOLVED} SELECT key, near AS nearest FROM f")
def f10(spark, sf_dir):
    labels = run_sql(spark, sf_dir, _LABELS)
    keys = labels.select(names.category_key(F.col("label")).alias("key")).distinct()
    held = run_sql(spark, sf_dir, _CATEGORIES).select("category", names.category_key(F.col("category")).alias("held_key"))
    return v.nearest(keys, held).select("key", "nearest")


@query("h9_tag_keys", "SELECT p_partkey AS id, lower(p_name) || ' fi1' AS key FROM part")
def h9(spark, sf_dir):
    raw = F.concat(F.lit("\U0001f600 "), F.upper("p_name"), F.lit("  ﬁ① ☀️"))
    return frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), v.tag_key(raw).alias("key"))


@query("f11_similar_tags", """WITH t AS (SELECT DISTINCT value AS tag, list_distinct(string_split(value, ' ')) AS w FROM {named}),
 s AS (SELECT a.tag AS query, b.tag, len(list_intersect(a.w, b.w)) AS b, len(list_distinct(list_concat(a.w, b.w))) AS e FROM t a, t b),
 o AS (SELECT query, tag, b / e::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY b / e::DOUBLE DESC, tag) AS place FROM s
  WHERE b * 5 >= e * 3) SELECT query, tag, score, CAST(place AS INT) AS place FROM o WHERE place <= 3""")
def f11(spark, sf_dir):
    tags = Workspace(spark, "tags").save(frame(spark, sf_dir, "named").select(F.col("value").alias("tag")).distinct(), "tags")
    return v.similar_tags(tags.select(F.col("tag").alias("query")), tags)


@query("d20_tag_merges", """WITH l AS (SELECT document_id, category AS tag FROM {links}) SELECT CASE tag WHEN 'view' THEN 'click'
  ELSE tag END AS tag, count(DISTINCT document_id) AS documents, count(DISTINCT CASE WHEN tag = 'view' THEN document_id END) AS moved FROM l GROUP BY 1""")
def d20(spark, sf_dir):
    links = frame(spark, sf_dir, "links").select("document_id", F.col("category").alias("tag"))
    merges = spark.createDataFrame([("view", "click")], "loser string, survivor string")
    counted = v.merged_tags(links, merges).groupBy("tag").agg(F.count("*").alias("documents"))
    moved = links.join(merges, F.col("tag") == F.col("loser")).groupBy(F.col("survivor").alias("tag")).agg(F.countDistinct("document_id").alias("moved"))
    return counted.join(moved, "tag", "left").select("tag", "documents", F.coalesce("moved", F.lit(0)).alias("moved"))


@query("l21_bulk_tags", """WITH l AS (SELECT DISTINCT document_id, category AS tag FROM {links}) SELECT document_id, tag FROM l WHERE NOT (document_id < 20 AND tag = 'view')
  UNION SELECT document_id, 'fresh' FROM l WHERE document_id < 20""")
def l21(spark, sf_dir):
    links = frame(spark, sf_dir, "links").select("document_id", F.col("category").alias("tag")).distinct()
    named = [spark.createDataFrame([(t,) for t in tags], "tag string") for tags in (["fresh", "view"], ["view"])]
    return v.updated_tags(links, links.where("document_id < 20").select("document_id"), *named)


sql("l20_tag_reads", "SELECT category AS tag, count(*) AS links, count(DISTINCT document_id) AS documents FROM {links} GROUP BY category ORDER BY category")
