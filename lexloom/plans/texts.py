"""Text, name, money and identifier functions over whole columns."""

from pyspark.sql import functions as F

from ..catalog import frame
from ..functions import money, names, text
from .registry import query, sql


@query("h1_chunks", "SELECT document_id AS id, start, text FROM {chunks}")
def h1(spark, sf_dir):
    return text.chunks(frame(spark, sf_dir, "docs").where("status = 'active'")).select("id", "start", "text")


sql("h2_token_estimate", "SELECT id, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS tokens FROM {docs}", "SELECT id, greatest(1, length(text) // 4) AS tokens FROM {docs}")


@query("h16_trigram_similarity",
    """WITH g AS (SELECT p_partkey, list_distinct(flatten(list_transform(string_split(lower(p_name), ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3))))) AS x,
 list_distinct(flatten(list_transform(string_split(lower(p_type), ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3))))) AS y
  FROM part)
 SELECT p_partkey AS id, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE AS score FROM g""")
def h16(spark, sf_dir):
    return frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.trigram_similarity(F.col("p_name"), F.col("p_type")).alias("score"))


@query("h6_resolution_key", "SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), ' ') AS key FROM part")
def h6(spark, sf_dir):
    return frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.resolution_key(F.col("p_name")).alias("key"))


@query("h8_category_key", """SELECT DISTINCT p_type AS name, CASE WHEN length(p_type) > 3 AND right(p_type, 1) IN ('s', 'S')
  AND lower(right(p_type, 2)) <> 'ss' THEN left(lower(p_type), length(p_type) - 1) ELSE lower(p_type) END AS key FROM part""")
def h8(spark, sf_dir):
    return frame(spark, sf_dir, "part").select(F.col("p_type").alias("name"), names.category_key(F.col("p_type")).alias("key")).distinct()


@query("h17_one_edit", """WITH v AS (SELECT DISTINCT entity_type, value FROM {entities}) SELECT a.entity_type, a.value AS first, b.value AS second FROM v a
  JOIN v b ON a.entity_type = b.entity_type AND a.value < b.value AND abs(length(a.value) - length(b.value)) <= 1 WHERE damerau_levenshtein(a.value, b.value) <= 1""")
def h17(spark, sf_dir):
    """Pairs of one entity type; h17_one_edit_pairs has those of all types."""
    typed = frame(spark, sf_dir, "entities").select("entity_type", "value").distinct()
    pairs = names.one_edit_pairs(typed).join(typed.withColumnRenamed("value", "first"), "first")
    return pairs.join(typed.withColumnRenamed("value", "second"), ["second", "entity_type"]).select("entity_type", "first", "second")


@query("h17_one_edit_pairs", """WITH v AS (SELECT DISTINCT value FROM {entities}) SELECT a.value AS first, b.value AS second FROM v a JOIN v b ON a.value < b.value
  AND abs(length(a.value) - length(b.value)) <= 1 WHERE damerau_levenshtein(a.value, b.value) <= 1""")
def h17_pairs(spark, sf_dir):
    return names.one_edit_pairs(frame(spark, sf_dir, "entities"))


@query("h24_text_quality",
    """WITH d AS (SELECT id, text, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS solid
  FROM {docs}),
 q AS (SELECT id, text, CASE
  WHEN len(w) > 0 THEN round(0.6::DOUBLE * len(list_filter(w, lambda x: regexp_full_match(x, '[\\p{L}]{2,}[.,;:!?]?'))) / len(w) + 0.4::DOUBLE * length(regexp_replace(solid, '[^\\p{L}]', '', 'g')) / greatest(length(solid), 1), 4)
  ELSE 0.0::DOUBLE END AS quality FROM d)
 SELECT id, quality, CASE WHEN length(trim(text)) >= 40 THEN quality < 0.35 END AS unidentifiable FROM q""")
def h24(spark, sf_dir):
    return frame(spark, sf_dir, "docs").select("id", text.text_quality(F.col("text")).alias("quality"), text.unidentifiable(F.col("text")).alias("unidentifiable"))


sql("h27_lexical_terms", """SELECT term, count(*) AS n FROM (SELECT explode(regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', ' ')), '[a-z]{3,}', 0)) AS term FROM {pages})
  WHERE term NOT IN ('the', 'and', 'amp', 'nbsp') GROUP BY term ORDER BY n DESC, term LIMIT 200""",
    """SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[a-z]{3,}')) AS term
  FROM {pages}) WHERE term NOT IN ('the', 'and', 'amp', 'nbsp') GROUP BY term ORDER BY n DESC, term LIMIT 200""")
sql("h28_plausible_terms",
    "SELECT DISTINCT value FROM {entities} WHERE length(value) - length(translate(value, 'aeiouy', '')) >= 0.15 * length(value) AND NOT regexp_like(value, 'aaaa|eeee|tttt')",
    """SELECT DISTINCT value FROM {entities} WHERE length(value) - length(translate(value, 'aeiouy', '')) >= 0.15 * length(value)
  AND NOT regexp_matches(value, 'aaaa|eeee|tttt')""")
sql("h29_emails",
    "SELECT id, lower(email) AS email FROM (SELECT id, explode(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+[.][a-z]+', 0)) AS email FROM {docs})",
    "SELECT id, lower(email) AS email FROM (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+[.][a-z]+')) AS email FROM {docs})")
sql("h29_urls", "SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '?', 1) AS base FROM {pages}")


@query("i4_amounts", """SELECT id, raw, minor
  FROM (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.50 EUR' AS raw, CAST(CAST(l_quantity AS INT) * 100 + 50 AS BIGINT) AS minor
  FROM lineitem)""")
def i4(spark, sf_dir):
    raw = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".50 EUR"))
    return frame(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), raw.alias("raw"), money.amount_minor(raw).alias("minor"))


@query("i5_dates", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) END AS day FROM events")
def i5(spark, sf_dir):
    raw = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "dd.MM.yyyy"))
    return frame(spark, sf_dir, "events").select("event_id", money.iso_date(raw).alias("day"))


sql("i8_metadata_normalise",
    "SELECT id, CASE WHEN lower(trim(title)) IN ('', 'n/a', 'none', 'unknown') THEN NULL ELSE array_join(slice(split(title, ' '), 1, 15), ' ') END AS title FROM {docs}",
    "SELECT id, CASE WHEN lower(trim(title)) IN ('', 'n/a', 'none', 'unknown') THEN NULL ELSE array_to_string(string_split(title, ' ')[1:15], ' ') END AS title FROM {docs}")
sql("i10_derived_duration", """SELECT user_id, event_id, CASE WHEN gap > 0 THEN gap END AS seconds
  FROM (SELECT user_id, event_id, unix_timestamp(ts) - unix_timestamp(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM {events})""",
    """SELECT user_id, event_id, CASE WHEN gap > 0 THEN gap END AS seconds
  FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS gap
  FROM events)""")
sql("i17_json_merge",
    "SELECT event_id, to_json(map_concat(from_json(props, 'map<string,int>'), map('seen', 1))) AS props FROM {events}",
    """SELECT event_id, replace(CAST(json_merge_patch(props, '{"seen": 1}') AS VARCHAR), ' ', '') AS props FROM events""")
sql("l26_head_slice", "SELECT id, substr(text, 1, 6000) AS head FROM {docs}")
@query("l32_provenance_check", "SELECT b.item_id, d.doc_id FROM {benchmark} b JOIN {documents} d ON contains(d.text, b.text) WHERE trim(b.text) <> ''")
def l32(spark, sf_dir):
    """Passages that stand in documents: both meet on a run of five inner words of the passage, shorter passages look at every document."""
    run = 5
    passages = frame(spark, sf_dir, "benchmark").where("trim(text) <> ''").select("item_id", F.col("text").alias("passage"), F.split("text", " ").alias("w"))
    anchored = passages.where(F.size("w") >= run + 2).select("item_id", "passage", F.xxhash64(F.array_join(F.slice("w", 2, run), " ")).alias("anchor"))
    docs = frame(spark, sf_dir, "documents").select("doc_id", "text")
    # words by place, zipped with themselves moved on: slices in a lambda would split the text at every place
    split = docs.select("doc_id", F.split("text", " ").alias("w")).where(F.size("w") >= run)
    moved = F.arrays_zip(*(F.slice("w", F.lit(k), F.size("w") - run + 1).alias(f"w{k}") for k in range(1, run + 1)))
    places = split.select("doc_id", F.explode(moved).alias("z")).select("doc_id", F.xxhash64(F.concat_ws(" ", *(f"z.w{k}" for k in range(1, run + 1)))).alias("anchor"))
    met = places.join(anchored, "anchor").select("doc_id", "item_id", "passage").distinct()
    long = docs.join(met, "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id")
    short = passages.where(F.size("w") < run + 2).select("item_id", "passage").join(docs, F.contains("text", "passage")).select("item_id", "doc_id")
    return long.unionByName(short)
