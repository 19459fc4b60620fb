"""Resolving names: keys, the match cascade, candidates, alias folds, canonical roots, adjudication."""

from pyspark.sql import functions as F

from ..catalog import frame
from ..functions import names
from ..operators import resolution as r
from ..workspace import Workspace
from .registry import query, sql

# what the oracles state of a name v: its tokens and its trigrams
_TOKENS = r"list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(v, '[^\w\s]', ' ', 'g')), '\s+'), lambda x: x <> '')))"
_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(v), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3)))))"
_ORDINAL = "regexp_full_match(x, '[0-9]+|i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii|xiii|xiv|xv|xvi|xvii|xviii|xix|xx')"
_NODES = f"""nodes AS (SELECT id, entity_type, v AS value, {_TOKENS} AS t, {_GRAMS} AS g FROM (SELECT entity_type, value AS v, min(id) AS id FROM {{named}}
  GROUP BY entity_type, value))"""
_PAIRS = f"""{_NODES}, p AS (
 
  SELECT a.id AS a, b.id AS b, a.t AS ta, b.t AS tb, a.value AS va, b.value AS vb, list_filter(a.t, lambda x: NOT list_contains(b.t, x)) AS oa, list_filter(b.t, lambda x: NOT list_contains(a.t, x)) AS ob,
    len(list_intersect(a.g, b.g)) AS both_, len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS either_
  FROM nodes a JOIN nodes b ON a.entity_type = b.entity_type AND a.id < b.id),
 c AS (SELECT *, CASE WHEN len(oa) + len(ob) = 0 THEN 'token_set' WHEN least(len(ta), len(tb)) >= 2 AND len(ta) <> len(tb)
  AND least(len(oa), len(ob)) = 0 THEN 'token_subset'
    WHEN len(ta) = len(tb) AND len(ta) >= 2 AND len(oa) = 1 AND len(ob) = 1 AND least(length(oa[1]), length(ob[1])) >= 4
  AND left(oa[1], 1) = left(ob[1], 1) AND damerau_levenshtein(oa[1], ob[1]) <= 1 THEN 'token_typo'
    WHEN both_ * 5 >= either_ * 3 THEN 'fuzzy_trgm' END AS method
  FROM p WHERE NOT (len(oa) + len(ob) > 0 AND len(oa) < len(ta) AND len(list_filter(list_concat(oa, ob), lambda x: NOT {_ORDINAL})) = 0)),
 m AS (SELECT CASE WHEN (len(ta), length(va), -a) > (len(tb), length(vb), -b) THEN a ELSE b END AS canonical_id, CASE
  WHEN (len(ta), length(va), -a) > (len(tb), length(vb), -b) THEN b ELSE a END AS alias_id, method,
    CASE method WHEN 'token_set' THEN 1.0::DOUBLE WHEN 'token_subset' THEN 0.85::DOUBLE WHEN 'token_typo' THEN 0.75::DOUBLE
  ELSE both_ / either_::DOUBLE END AS score FROM c WHERE method IS NOT NULL)"""


@query("h19_match_cascade", f"WITH {_PAIRS} SELECT * FROM m")
def h19(spark, sf_dir):
    return r.matches(frame(spark, sf_dir, "named"))


@query("l31_merge_candidates", f"WITH {_PAIRS} SELECT * FROM m ORDER BY score DESC, canonical_id, alias_id LIMIT 50")
def l31(spark, sf_dir):
    return r.matches(frame(spark, sf_dir, "named")).orderBy(F.desc("score"), "canonical_id", "alias_id").limit(50)


@query("l30_stage_counts", f"WITH {_PAIRS} SELECT method, count(*) AS pairs FROM m GROUP BY method")
def l30(spark, sf_dir):
    return r.matches(frame(spark, sf_dir, "named")).groupBy("method").agg(F.count("*").alias("pairs"))


@query("h14_ordinal_veto", f"""WITH {_NODES} SELECT a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.entity_type = b.entity_type AND a.id < b.id
  AND list_filter(a.t, lambda x: NOT {_ORDINAL}) = list_filter(b.t, lambda x: NOT {_ORDINAL}) WHERE a.t <> b.t AND len(list_intersect(a.t, b.t)) > 0""")
def h14(spark, sf_dir):
    nodes = r.nodes_of(frame(spark, sf_dir, "named")).withColumn("base", F.array_join(F.filter("tokens", lambda x: ~names.is_ordinal(x)), " "))
    a, b = (nodes.select(F.col("id").alias(x), "entity_type", "base", F.col("tokens").alias(f"{x}_tokens")) for x in "ab")
    # names that differ by ordinals only have one base
    return a.join(b, ["entity_type", "base"]).where("a < b").where(r.differs_by_ordinal(F.col("a_tokens"), F.col("b_tokens"))).select("a", "b")


@query("l14_alias_folds", f"""WITH n AS (SELECT id, entity_type, string_split(value, ' ') AS w FROM (SELECT entity_type, value, min(id) AS id FROM {{named}}
  GROUP BY entity_type, value)),
 s AS (SELECT a.id AS alias_id, b.id AS canonical_id, len(b.w) AS n FROM n a JOIN n b ON a.entity_type = b.entity_type AND len(b.w) > len(a.w)
  AND b.w[1:len(a.w)] = a.w AND NOT {_ORDINAL.replace('(x,', '(b.w[len(a.w) + 1],')} WHERE length(array_to_string(a.w, ' ')) >= 3)
 SELECT alias_id, min(canonical_id) AS canonical_id FROM s WHERE n = (SELECT max(n) FROM s o WHERE o.alias_id = s.alias_id) GROUP BY alias_id
  HAVING count(*) = 1""")
def l14(spark, sf_dir):
    return r.alias_folds(frame(spark, sf_dir, "named"))


@query("e7_longest_superset", f"""WITH n AS (SELECT id, entity_type, string_split(value, ' ') AS w FROM (SELECT entity_type, value, min(id) AS id FROM {{named}}
  GROUP BY entity_type, value)),
 s AS (SELECT a.id AS alias_id, b.id AS b, len(b.w) AS n FROM n a JOIN n b ON a.entity_type = b.entity_type AND len(b.w) > len(a.w)
  AND b.w[1:len(a.w)] = a.w AND NOT {_ORDINAL.replace('(x,', '(b.w[len(a.w) + 1],')} WHERE length(array_to_string(a.w, ' ')) >= 3)
 SELECT x.entity_type, count(*) AS folded FROM (SELECT alias_id FROM s WHERE n = (SELECT max(n) FROM s o WHERE o.alias_id = s.alias_id)
  GROUP BY alias_id HAVING count(*) = 1) f JOIN n x ON x.id = f.alias_id GROUP BY x.entity_type""")
def e7(spark, sf_dir):
    entities = frame(spark, sf_dir, "named")
    return r.alias_folds(entities).join(r.nodes_of(entities).withColumnRenamed("id", "alias_id"), "alias_id").groupBy("entity_type").agg(F.count("*").alias("folded"))


# customers point at their third part, but for some that point at each other
_POINTER = "CASE WHEN c_custkey % 97 = 5 THEN c_custkey + 1 WHEN c_custkey % 97 = 6 THEN c_custkey - 1 WHEN c_custkey % 89 = 7 THEN c_custkey WHEN c_custkey > 3 THEN CAST(floor(c_custkey / 3) AS BIGINT) END"


@query("l7_canonical_chain", f"""WITH RECURSIVE l AS (SELECT c_custkey AS id, coalesce({_POINTER}, c_custkey) AS nxt FROM customer), e AS (SELECT id, nxt FROM l UNION SELECT nxt, nxt
  FROM l WHERE nxt NOT IN (SELECT id FROM l)),
 w(id, nxt, seen) AS (SELECT id, nxt, [id] FROM e UNION ALL SELECT w.id, e.nxt, list_append(w.seen, w.nxt) FROM w JOIN e ON w.nxt = e.id
  WHERE NOT list_contains(w.seen, w.nxt))
 SELECT id, list_min(seen[list_position(seen, nxt):]) AS root, len(seen) > list_position(seen, nxt) AS cyclic FROM w WHERE list_contains(seen, nxt)""")
def l7(spark, sf_dir):
    return r.canonical_roots(frame(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{_POINTER} AS canonical_id"))


@query("k13_adjudication", f"""WITH {_PAIRS}, k AS (SELECT *, CASE WHEN method <> 'fuzzy_trgm' THEN 'trusted' WHEN (canonical_id + alias_id) % 3 = 0 THEN 'open'
  WHEN (canonical_id + alias_id) % 3 = 1 THEN 'same' END AS outcome FROM m)
 SELECT * FROM k WHERE outcome IS NOT NULL""")
def k13(spark, sf_dir):
    found = Workspace(spark, "matches").save(r.matches(frame(spark, sf_dir, "named")), "matches")  # read three times
    total = F.col("canonical_id") + F.col("alias_id")
    judged = found.where("method = 'fuzzy_trgm'").where(total % 3 > 0).select(r.pair_key(F.col("canonical_id"), F.col("alias_id")).alias("pair_key"), "method", r.score_bucket(F.col("score")).alias("bucket"), (total % 3).alias("kind"))
    # an older verdict says the opposite of the last
    old, new = (judged.select("pair_key", "method", "bucket", (F.col("kind") == kind).alias("same"), F.lit(at).alias("at")) for kind, at in ((2, 1), (1, 2)))
    return r.adjudicated(found, old.unionByName(new))


@query("f9_fuzzy_top", f"""WITH {_NODES}, q AS (SELECT id AS query_id, entity_type, g FROM nodes WHERE id % 50 = 0), s AS (
  SELECT query_id, n.id, len(list_intersect(q.g, n.g)) AS b, len(q.g) + len(n.g) - len(list_intersect(q.g, n.g)) AS e FROM q
  JOIN nodes n ON q.entity_type = n.entity_type),
 o AS (SELECT query_id, id, b / e::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY b / e::DOUBLE DESC, id) AS place FROM s
  WHERE b * 10 >= e * 7)
 SELECT query_id, id, score, CAST(place AS INT) AS place FROM o WHERE place <= 10""")
def f9(spark, sf_dir):
    entities = Workspace(spark, "named").save(frame(spark, sf_dir, "named"), "named")
    wanted = r.nodes_of(entities).where("id % 50 = 0").select(F.col("id").alias("query_id"), "entity_type", "value")
    return r.fuzzy_top(entities, wanted)


@query("h5_display_keys", "SELECT doc_id AS id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[ \\t\\r\\f\\v]+', ' ', 'g')) AS key FROM documents WHERE text IS NOT NULL")
def h5(spark, sf_dir):
    return frame(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), names.display_key(F.split_part("text", F.lit("\n"), F.lit(1))).alias("key"))


@query("h10_merchant_keys", "SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(concat(p_brand, '  & ', p_name, '.')), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part")
def h10(spark, sf_dir):
    return frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.merchant_key(F.concat("p_brand", F.lit("  & "), "p_name", F.lit("."))).alias("key"))


@query("h7_postal_places", """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 2 THEN lpad(CAST(10000 + c_custkey % 80000 AS VARCHAR), 5, '0') END AS code, CASE
  WHEN c_custkey % 3 <> 2 THEN c_mktsegment END AS place FROM customer""")
def h7(spark, sf_dir):
    code = F.lpad((10000 + F.col("c_custkey") % 80000).cast("string"), 5, "0")
    raw = F.when(F.col("c_custkey") % 3 == 2, F.concat(code, F.lit(" 2nd"))).otherwise(F.concat(F.lit(" "), code, F.lit("  "), F.col("c_mktsegment")))
    found = frame(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), names.postal_place(raw).alias("p"))
    return found.select("id", "p.code", "p.place")


@query("h18_typo_tokens", """WITH t AS (SELECT DISTINCT unnest(string_split(value, ' ')) AS t FROM {named}) SELECT a.t AS first, b.t AS second FROM t a JOIN t b ON a.t < b.t
  AND left(a.t, 1) = left(b.t, 1) AND abs(length(a.t) - length(b.t)) <= 1 AND least(length(a.t), length(b.t)) >= 4
  WHERE damerau_levenshtein(a.t, b.t) <= 1""")
def h18(spark, sf_dir):
    values = frame(spark, sf_dir, "named").select(F.explode(F.split("value", " ")).alias("value")).where("length(value) >= 4")
    return names.one_edit_pairs(values).where("substr(first, 1, 1) = substr(second, 1, 1)")


sql(
    "h13_ordinal_tokens",
    """SELECT token, token RLIKE '^[0-9]+$' OR token IN ('i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xii', 'xiii', 'xiv', 'xv', 'xvi', 'xvii', 'xviii', 'xix', 'xx') AS ordinal
  FROM (SELECT DISTINCT explode(split(value, ' ')) AS token FROM {named})""",
    f"SELECT x AS token, {_ORDINAL} AS ordinal FROM (SELECT DISTINCT unnest(string_split(value, ' ')) AS x FROM {{named}})",
)
sql("h21_pair_keys", "SELECT src, dst, concat_ws('|', least(src, dst), greatest(src, dst)) AS pair_key FROM {edges} WHERE predicate = 'CUSTOMER_OF'")
sql("h22_score_buckets", "SELECT chunk_id, format_string('%.2f', embedding[0]) AS bucket FROM {vectors}", "SELECT chunk_id, printf('%.2f', embedding[1]::DOUBLE) AS bucket FROM {vectors}")

sql(
    "h23_deterministic_ids",
    """SELECT id, concat(substr(h, 1, 12), '5', substr(h, 14, 3), substr('89ab', CAST(conv(substr(h, 17, 1), 16, 10) AS INT) % 4 + 1, 1), substr(h, 18, 15)) AS node_id
  FROM (SELECT id, sha1(concat(unhex('6ba7b8109dad11d180b400c04fd430c8'), encode(concat_ws('|', entity_type, value), 'utf-8'))) AS h FROM {named})""",
    """SELECT id, concat(substr(h, 1, 12), '5', substr(h, 14, 3), substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS INT), 1), substr(h, 18, 15)) AS node_id
  FROM (SELECT id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws('|', entity_type, value))) AS h FROM {named})""",
)
