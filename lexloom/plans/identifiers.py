"""Identifiers, addresses and names in letters; windows of texts and their records."""

import re

from pyspark.sql import functions as F

from ..catalog import frame
from ..functions import identifiers as ids
from ..functions import numbering
from ..functions.spans import preceded, sentence, spans
from ..operators import windows
from .registry import query

# letters are made of known parts, so the oracles state what is in them
_FOUND = """SELECT id, 'IBAN' AS kind, iban AS value FROM {letters} WHERE id % 4 <> 3
 UNION ALL SELECT id, 'VAT_ID', CASE id % 5 WHEN 0 THEN 'DE136695976' WHEN 2 THEN 'ATU13585627' ELSE 'FR40303265045' END FROM {letters} WHERE id % 5 IN (0, 2, 3)
 UNION ALL SELECT id, 'REGISTRATION_NUMBER', concat(CASE id % 3 WHEN 0 THEN 'HRB ' ELSE 'VR ' END, CAST(id % 100000 AS VARCHAR)) FROM {letters} WHERE id % 3 < 2
 UNION ALL SELECT id, 'TAX_NUMBER', '12/345/67890' FROM {letters} WHERE id % 2 = 0
 UNION ALL SELECT id, 'PHONE', '+49301234567' FROM {letters} WHERE id % 3 < 2"""


@query("h31_identifiers", _FOUND)
def h31(spark, sf_dir):
    rows = frame(spark, sf_dir, "letters").select("id", F.explode(ids.identifiers(F.col("text"))).alias("x"))
    return rows.select("id", "x.kind", "x.value")


# plans line by line; the line whose code and leading digits are longest decides
_LINES = ", ".join(f"('{code}{lead}', {len(code + re.sub(r'\[[^]]*\]', 'x', lead))}, {[len(code) + n for n in lengths]})" for code, lead, lengths in numbering.lines())
_JUDGED = f"plans(lead, depth, lengths) AS (VALUES {_LINES})"


@query("h31_phone_numbers", rf"""WITH {_JUDGED},
 m AS (SELECT doc_id AS id, regexp_replace(translate(text, chr(1), ' '), '(^|^[^\w#]|[^0-9][^\w#]|[0-9][^\w# ])((?:\+[1-9]|00[1-9]|\(?0)[0-9 ()/.\-]{{5,18}}[0-9]\b)', '\1' || chr(1) || '\2' || chr(1), 'g') AS text FROM documents WHERE text IS NOT NULL),
 p AS (SELECT id, string_split(text, chr(1)) AS p FROM m WHERE contains(text, chr(1))),
 c AS (SELECT id, i, array_to_string(p[1:i - 1], '') AS before, regexp_replace(p[i], ' +- .*$', '') AS raw FROM (SELECT id, p, unnest(generate_series(2, len(p), 2)) AS i FROM p)),
 k AS (SELECT id, i, before, g, regexp_replace(raw, '(?:[ ()/.\-]+[0-9]+){{' || g || '}}$', '') AS cut, raw FROM c, range(0, 11) r(g)),
 d AS (SELECT *, ltrim(cut, '(') AS bare FROM k WHERE g = 0 OR cut <> raw),
 n AS (SELECT *, CASE WHEN bare LIKE '+%' THEN regexp_replace(replace(bare, '(0)', ''), '[^0-9]', '', 'g')
  WHEN bare LIKE '00%' THEN substr(regexp_replace(replace(bare, '(0)', ''), '[^0-9]', '', 'g'), 3) WHEN bare LIKE '0%' THEN concat('49', substr(regexp_replace(bare, '[^0-9]', '', 'g'), 2)) END AS digits FROM d),
 j AS (SELECT id, i, g, any_value(before) AS before, any_value(cut) AS cut, any_value(digits) AS digits, list_contains(arg_max(lengths, depth), length(any_value(digits))) AS good
  FROM n JOIN plans ON regexp_matches(digits, '^' || lead) GROUP BY id, i, g)
 SELECT id, CAST(length(before) AS INT) AS start, CAST(length(before) + length(cut) AS INT) AS "end", '+' || digits AS value FROM (SELECT * FROM j WHERE good QUALIFY row_number() OVER (PARTITION BY id, i ORDER BY g) = 1)
 WHERE regexp_matches(cut, '^(?:\+|00)') OR regexp_matches(right(before, 24), '{ids.PHONE_CUE}')""")
def h31_phones(spark, sf_dir):
    """Telephone numbers of all documents, with their offsets."""
    rows = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(ids.phone_spans(F.col("text"))).alias("x"))
    return rows.select("id", "x.start", "x.end", numbering.e164(F.col("x.value")).alias("value"))


@query("h31_numbering_plans", f"""WITH {_JUDGED}, n AS (SELECT DISTINCT CAST(o_orderkey * 7368787 AS VARCHAR) || lpad(CAST(o_custkey * 31 % 10000 AS VARCHAR), CAST(2 + o_orderkey % 3 AS INT), '0') AS digits FROM orders WHERE o_custkey IS NOT NULL)
 SELECT digits, coalesce((SELECT list_contains(arg_max(lengths, depth), length(digits)) FROM plans WHERE regexp_matches(digits, '^' || lead)), false) AS planned FROM n""")
def h31_plans(spark, sf_dir):
    """Digits made of orders, judged by their plan."""
    key = F.col("o_orderkey")
    digits = F.concat((key * 7368787).cast("string"), F.lpad((F.col("o_custkey") * 31 % 10000).cast("string"), (2 + key % 3).cast("int"), F.lit("0")))
    return frame(spark, sf_dir, "orders").where("o_custkey IS NOT NULL").select(digits.alias("digits")).distinct().withColumn("planned", numbering.planned(F.col("digits")))


@query("h31_identifier_offsets", "SELECT id, CAST(instr(text, '/345/') - 3 AS INT) AS start, CAST(instr(text, '/345/') + 9 AS INT) AS \"end\" FROM {letters} WHERE id % 2 = 0")
def h31_offsets(spark, sf_dir):
    rows = frame(spark, sf_dir, "letters").select("id", F.explode(ids.identifiers(F.col("text"))).alias("x")).where("x.kind = 'TAX_NUMBER'")
    return rows.select("id", "x.start", "x.end")


@query("h30_iban_valid", "SELECT id, id % 4 <> 3 AS valid FROM {letters}")
def h30(spark, sf_dir):
    return frame(spark, sf_dir, "letters").select("id", ids.registered_iban(F.col("iban")).alias("valid"))




@query("h32_vat_checksums", """WITH RECURSIVE s AS (SELECT s_suppkey AS id, lpad(CAST(s_suppkey * 104729 % 1000000000 AS VARCHAR), 9, '0') AS d FROM supplier),
 r(id, d, k, p) AS (SELECT id, d, 0, 10 FROM s UNION ALL SELECT id, d, k + 1, (CASE WHEN (CAST(d[k + 1] AS INT) + p) % 10 = 0 THEN 10
  ELSE (CAST(d[k + 1] AS INT) + p) % 10 END * 2) % 11 FROM r WHERE k < 8),
 a AS (SELECT s_suppkey AS id, lpad(CAST(s_suppkey * 104729 % 100000000 AS VARCHAR), 8, '0') AS d FROM supplier)
 SELECT r.id, (11 - p) % 10 = CAST(r.d[9] AS INT) AS german, (96 - (SELECT sum(CASE
  WHEN i % 2 = 0 THEN CAST(substr('0246813579', CAST(a.d[i] AS INT) + 1, 1) AS INT) ELSE CAST(a.d[i] AS INT) END)
  FROM (SELECT CAST(unnest(generate_series(1, 7)) AS INT) AS i))) % 10 = CAST(a.d[8] AS INT) AS austrian
 FROM r JOIN a ON a.id = r.id WHERE k = 8""")
def h32(spark, sf_dir):
    n = F.col("s_suppkey") * 104729
    german, austrian = (F.lpad((n % 10**w).cast("string"), w, "0") for w in (9, 8))
    return frame(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ids.german_vat(F.concat(F.lit("DE"), german)).alias("german"), ids.austrian_vat(F.concat(F.lit("ATU"), austrian)).alias("austrian"))


@query("h33_cue_windows", "SELECT id, id % 2 = 0 AS cued FROM {letters}")
def h33(spark, sf_dir):
    letters = frame(spark, sf_dir, "letters")
    return letters.select("id", preceded(F.col("text"), F.instr("text", "12/345") - 1, ids.TAX_CUE, 40).alias("cued"))


@query("h34_addresses",
    """SELECT id, concat('Hauptstraße ', CAST(1 + id % 90 AS VARCHAR), ', ', CAST(10000 + id % 80000 AS VARCHAR), ' München') AS address, CAST(instr(text, 'Hauptstraße') - 1 AS INT) AS start
  FROM {letters}""")
def h34(spark, sf_dir):
    rows = frame(spark, sf_dir, "letters").select("id", F.explode(ids.addresses(F.col("text"))).alias("x"))
    return rows.select("id", F.col("x.value").alias("address"), "x.start")


@query("h35_person_parts", """SELECT id, CASE WHEN id % 5 < 4 THEN 'Anna' END AS given, CASE WHEN id % 5 < 4 THEN CASE id % 5 WHEN 1 THEN 'Maria' ELSE '' END END AS middle, CASE
  WHEN id % 5 < 4 THEN CASE id % 5 WHEN 2 THEN 'von der ' ELSE '' END || word END AS family
 FROM (SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS word FROM part)""")
def h35(spark, sf_dir):
    word, id_ = F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_partkey")
    raw = F.when(id_ % 5 == 0, F.concat(F.lit("Anna  "), word)).when(id_ % 5 == 1, F.concat(word, F.lit(", Anna Maria"))).when(id_ % 5 == 2, F.concat(F.lit("Anna von der "), word)).when(id_ % 5 == 3, F.concat(word, F.lit(",Anna"))).otherwise(F.when(id_ % 2 == 0, word).otherwise(F.concat(word, F.lit(" 7"))))
    found = frame(spark, sf_dir, "part").select(id_.alias("id"), ids.person_parts(raw).alias("p"))
    return found.select("id", "p.given", F.array_join("p.middle", " ").alias("middle"), "p.family")


@query("h41_sentences", "SELECT id, concat(CASE id % 3 WHEN 0 THEN 'Ruf +49 30 1234567' WHEN 1 THEN '030 1234567' ELSE 'Kunde 030 1234567' END) AS sentence FROM {letters}")
def h41(spark, sf_dir):
    at = F.instr("text", "1234567") - 1
    return frame(spark, sf_dir, "letters").select("id", sentence(F.col("text"), at, at + 7).alias("sentence"))


@query("l51_address_lines", "SELECT id, CAST(len(string_split(text, chr(10))) AS INT) AS n, CAST(length(string_split(text, chr(10))[1]) AS INT) AS \"end\" FROM {letters}")
def l51(spark, sf_dir):
    rows = spans(F.col("text"), r"[^\n]*[^\s][^\n]*")
    return frame(spark, sf_dir, "letters").select("id", F.size(rows).alias("n"), F.get(rows, F.lit(0))["end"].alias("end"))


@query("h3_line_windows",
    """WITH RECURSIVE p AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n
  FROM documents WHERE text IS NOT NULL),
 c AS (SELECT id, list(e ORDER BY i) AS c FROM (SELECT id, i, n, length(line) + CASE WHEN i < n THEN 1 ELSE 0 END AS w, sum(length(line) + CASE
  WHEN i < n THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS e FROM p) WHERE w > 0 GROUP BY id),
 r(id, c, f, l) AS (SELECT id, c, 0, greatest(1, len(list_filter(c, lambda x: x <= 300))) FROM c
  UNION ALL
  SELECT id, c, greatest(l - 2, f + 1), greatest(greatest(l - 2, f + 1) + 1, len(list_filter(c, lambda x: x <= c[greatest(l - 2, f + 1)] + 300))) FROM r
  WHERE l < len(c))
 SELECT id, CAST(CASE WHEN f = 0 THEN 0 ELSE c[f] END AS INT) AS start, CAST(c[l] AS INT) AS "end" FROM r""")
def h3(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return windows.line_windows(docs, 300, 2).select("id", "start", "end")


@query("h4_break_windows", """WITH RECURSIVE d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
 n(id, t, a, e) AS (SELECT id, t, 0, CASE WHEN length(t) <= 1500 THEN length(t)
  WHEN regexp_matches(substr(t, 751, 750), '[ \\n]') THEN 750 + length(regexp_extract(substr(t, 751, 750), '(?s)^(.*)[ \\n]', 1)) ELSE 1500 END FROM d
  UNION ALL SELECT id, t, e, CASE WHEN length(t) - e <= 1500 THEN length(t)
  WHEN regexp_matches(substr(t, e + 751, 750), '[ \\n]') THEN e + 750 + length(regexp_extract(substr(t, e + 751, 750), '(?s)^(.*)[ \\n]', 1))
  ELSE e + 1500 END FROM n WHERE e < length(t))
 SELECT id, CAST(a AS INT) AS start, CAST(e AS INT) AS "end" FROM n""")
def h4(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return windows.break_windows(docs).select("id", "start", "end")


def _windowed(spark, sf_dir):
    """Lines of orders in windows of four that share two lines with the next."""
    from pyspark.sql import Window as W

    rows = frame(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1)
    last = F.greatest(F.floor((F.count("*").over(W.partitionBy("l_orderkey")) - 3) / 2), F.lit(0))
    rows = rows.withColumn("last", last).withColumn("window", F.explode(F.filter(F.array(F.floor(F.col("i") / 2), F.floor(F.col("i") / 2) - 1), lambda w: w >= 0))).where("window <= last")
    return rows.select(F.col("l_orderkey").alias("document_id"), "window", F.col("i").alias("position"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.format_string("%.2f", "l_extendedprice").alias("amount"), F.when(F.col("l_linenumber") != 3, "eur").alias("currency"), F.lit(" Debit").alias("direction"), F.concat(F.lit("Shop & "), F.col("l_partkey")).alias("merchant"), F.concat(F.lit("line "), "l_linenumber").alias("description"))


@query("g9_stitched_records", """SELECT l_orderkey AS document_id, count(*) AS records, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_linenumber <> 3) AS BIGINT) AS minor
  FROM lineitem GROUP BY l_orderkey""")
def g9(spark, sf_dir):
    records = windows.normalised_records(_windowed(spark, sf_dir))
    whole = windows.stitched(records, ["occurred_on", "merchant", "amount_minor", "currency", "direction", "description"])
    return whole.groupBy("document_id").agg(F.count("*").alias("records"), F.sum("amount_minor").alias("minor"))


@query("i7_transactions", """SELECT l_orderkey AS document_id, CAST(l_shipdate AS DATE) AS occurred_on, CASE
  WHEN l_linenumber <> 3 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS amount_minor, CASE
  WHEN l_linenumber <> 3 THEN 'EUR' END AS currency, concat('shop ', CAST(l_partkey AS VARCHAR)) AS merchant FROM lineitem""")
def i7(spark, sf_dir):
    rows = frame(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(0).alias("window"), F.lit(0).alias("position"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.format_string("%.2f", "l_extendedprice").alias("amount"), F.when(F.col("l_linenumber") != 3, "eur").alias("currency"), F.lit("").alias("direction"), F.concat(F.lit("Shop & "), F.col("l_partkey")).alias("merchant"), F.lit(None).cast("string").alias("description"))
    return windows.normalised_records(rows).select("document_id", "occurred_on", "amount_minor", "currency", "merchant")


@query("l28_record_stage", "SELECT l_orderkey % 100 AS bucket, count(*) AS records FROM lineitem GROUP BY ALL")
def l28(spark, sf_dir):
    records = windows.normalised_records(_windowed(spark, sf_dir))
    whole = windows.stitched(records, ["occurred_on", "merchant", "amount_minor", "currency", "direction", "description"])
    return whole.groupBy((F.col("document_id") % 100).alias("bucket")).agg(F.count("*").alias("records"))
