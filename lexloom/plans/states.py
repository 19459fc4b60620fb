"""What happens to rows: admission by content, jobs and their states, pages in chunks, folds, splits, tools."""

from pyspark.sql import functions as F

from ..catalog import frame
from ..functions import money, text
from ..operators import ledger as led
from ..operators import stages as st
from ..tools import Gateway
from .registry import query, sql

_MIME = r"""CASE WHEN html IS NULL OR page_id % 5 = 2 THEN 'application/x-empty' WHEN page_id % 5 = 0 THEN 'application/pdf' WHEN page_id % 5 = 1 THEN 'image/png' WHEN page_id % 5 = 3 THEN 'application/octet-stream'
  WHEN regexp_matches(html, '(?i)^\s*<(!doctype html|html)') THEN 'text/html' WHEN html = '' THEN 'application/x-empty' ELSE 'text/plain' END"""


@query(
    "a4_admission_by_content",
    f"""SELECT page_id, mime, CASE WHEN mime = 'application/x-empty' OR size > 20000 THEN 'reject' WHEN mime = 'application/octet-stream' THEN 'quarantine'
  ELSE 'admit' END AS verdict
        FROM (SELECT page_id, {_MIME} AS mime, octet_length(encode(html)) AS size FROM pages)""",
)
def a4(spark, sf_dir):
    """Empty and oversized content is rejected, content of no known kind is set aside; names play no part."""
    k, html = F.col("page_id") % 5, F.col("html").cast("binary")
    magic = F.when(k == 0, "255044462D").when(k == 1, "89504E470D0A1A0A").when(k == 3, "0001")
    content = F.when(k == 2, F.unhex(F.lit(""))).when(magic.isNotNull(), F.concat(F.unhex(magic), html)).otherwise(html)
    rows = frame(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("size"), st.mime_of(content).alias("mime"))
    return rows.select("page_id", "mime", st.verdict_of(F.col("mime"), F.col("size"), 20_000).alias("verdict"))


@query(
    "i4_amount_forms",
    """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 5 WHEN 0 THEN -q * 100 - 5 WHEN 1 THEN q * 100000 + 150 WHEN 2 THEN q * 100000 + 150
  WHEN 3 THEN q * 100 ELSE NULL END AS minor
       FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)""",
)
def i4_forms(spark, sf_dir):
    """Amounts as 12,05 and 1.001,50 and 1,001.50 and 12, and what is none."""
    q, k = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber") % 5
    raw = F.when(k == 0, F.concat(F.lit("-"), q, F.lit(",05 EUR"))).when(k == 1, F.concat(q, F.lit(".001,50"))).when(k == 2, F.concat(F.lit("$ "), q, F.lit(",001.50"))).when(k == 3, q).otherwise(F.lit("n/a"))
    return frame(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), money.amount_minor(raw).alias("minor"))


@query("i6_currency_codes", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' WHEN o_orderkey % 3 = 1 THEN 'USD' END AS currency FROM orders")
def i6(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 3 == 0, " eur").when(F.col("o_orderkey") % 3 == 1, "Usd ").otherwise("€")
    return frame(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), money.currency_code(raw).alias("currency"))


@query(
    "j6_marked_rows",
    """SELECT document_id, feature, CAST(CASE document_id % 5 WHEN 1 THEN attempts + 1 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE attempts END AS INT) AS attempts,
         CASE document_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' WHEN 3 THEN 'pending' ELSE status END AS status FROM {ledger}""",
)
def j6(spark, sf_dir):
    """Outcomes of rows: done, failed once more, reset, requeued; others stay."""
    ledger = frame(spark, sf_dir, "ledger")
    k = F.col("document_id") % 5
    outcomes = ledger.where("document_id % 5 < 4").select("document_id", "feature", F.when(k == 0, "done").when(k == 1, "failed").when(k == 2, "reset").otherwise("requeue").alias("outcome"))
    return led.marked(ledger, outcomes).select("document_id", "feature", "attempts", "status")


@query(
    "l25_chunk_stage",
    """SELECT doc_id AS id, CAST(page AS INT) AS page, CAST(k AS INT) AS start, CAST(length(substr(line, k + 1, 120)) AS INT) AS size
       FROM (SELECT *, unnest(generate_series(0, greatest(length(line) - 21, 0), 100)) AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents
  WHERE text IS NOT NULL))
       WHERE trim(substr(line, k + 1, 120)) <> ''""",
)
def l25(spark, sf_dir):
    """Chunks of each page (a line here), the page's number kept."""
    docs = frame(spark, sf_dir, "documents").where("text IS NOT NULL")
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("id", F.struct("doc_id", F.col("page") + 1))
    found = text.chunks(pages.select("id", "text"), 120, 20)
    return found.select("id.doc_id", F.col("id.col2").alias("page"), "start", F.length("text").alias("size")).withColumnRenamed("doc_id", "id")


sql(
    "d17_occurrence_folds",
    """SELECT document_id, lower(value) AS key, count(*) AS n, min(start) AS first, array_join(array_sort(collect_set(value)), '|') AS forms
       FROM {spots} GROUP BY document_id, lower(value)""",
    """SELECT document_id, lower(value) AS key, count(*) AS n, min(start) AS first, array_to_string(list_sort(list(DISTINCT value)), '|') AS forms
       FROM {spots} GROUP BY document_id, lower(value)""",
)
sql(
    "d22_document_telemetry",
    """SELECT document_id, array_join(array_sort(collect_list(concat(feature, '=', status))), ',') AS states, max(attempts) AS attempts
       FROM {ledger} GROUP BY document_id""",
    """SELECT document_id, array_to_string(list_sort(list(concat(feature, '=', status))), ',') AS states, max(attempts) AS attempts
       FROM {ledger} GROUP BY document_id""",
)
sql(
    "k21_split_node",
    """SELECT src, predicate, CASE WHEN dst = 's1' AND document_id % 2 = 1 THEN 's1/b' ELSE dst END AS dst, count(*) AS evidence
       FROM {provenance} WHERE src = 's1' OR dst IN ('s1', 's2') GROUP BY ALL""",
)
sql(
    "l24_chat_threads",
    """SELECT thread_id, count(*) AS turns, max_by(role, ordinal) AS last_role, max_by(substr(text, 1, 80), ordinal) AS last_text, min_by(substr(text, 1, 40), ordinal) AS title
       FROM {messages} GROUP BY thread_id""",
    """SELECT thread_id, count(*) AS turns, arg_max(role, ordinal) AS last_role, arg_max(left(text, 80), ordinal) AS last_text, arg_min(left(text, 40), ordinal) AS title
       FROM {messages} GROUP BY thread_id""",
)
sql(
    "f7_stable_sample",
    "SELECT id, sha256 FROM {docs} WHERE status = 'active' ORDER BY sha256, id LIMIT 25",
)
sql(
    "j2_illegal_transitions",
    """SELECT user_id, event_id, before, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id
  ORDER BY ts, event_id) AS before FROM {events})
      
  WHERE NOT coalesce(array_contains(array('signup>view', 'view>click', 'view>view', 'click>purchase', 'click>view', 'purchase>view'), concat(before, '>', event_type)), TRUE)""",
    """SELECT user_id, event_id, before, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id
  ORDER BY ts, event_id) AS before FROM events)
       WHERE before IS NOT NULL
  AND concat(before, '>', event_type) NOT IN ('signup>view', 'view>click', 'view>view', 'click>purchase', 'click>view', 'purchase>view')""",
)


def gateway() -> Gateway:
    """The read-only tools, by name, with their arguments."""
    tools = Gateway()

    @tools.add(merchant=str)
    def aggregate_transactions(spark, sf_dir, merchant):
        rows = frame(spark, sf_dir, "records").where((F.col("direction") == "debit") & (F.col("merchant") == merchant))
        return rows.groupBy("currency").agg(F.sum("amount_minor").alias("minor"), F.count("*").alias("records"))

    @tools.add(node=str)
    def graph_lookup(spark, sf_dir, node):
        edges = frame(spark, sf_dir, "provenance")
        return edges.where((F.col("src") == node) | (F.col("dst") == node)).select("src", "predicate", "dst").distinct()

    @tools.add()
    def list_categories(spark, sf_dir):
        return frame(spark, sf_dir, "links").groupBy("category").agg(F.countDistinct("document_id").alias("documents"))

    return tools


@query(
    "k3_tool_gateway",
    """SELECT currency, CAST(sum(amount_minor) AS BIGINT) AS minor, count(*) AS records FROM {records} WHERE direction = 'debit' AND merchant = 'red widget'
  GROUP BY currency""",
)
def k3(spark, sf_dir):
    result = gateway().call("aggregate_transactions", spark, sf_dir, merchant="red widget")
    if not result.ok:
        raise ValueError(result.error)
    return result.rows
