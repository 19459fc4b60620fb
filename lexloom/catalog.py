"""Document-system tables over the standard input tables, as DataFrames; SQL states the same tables for the oracle.

Every table carries what the operators need and no more; all are lazy, so unused columns are pruned from the scans.
"""

import re

from pyspark.sql import DataFrame, SparkSession

#: name: (Spark SQL, DuckDB SQL; None where the first serves both). Braces name other tables of this catalog or input files.
DEFINITIONS: dict[str, tuple[str, str | None]] = {
    "docs": (
        """SELECT doc_id AS id, source AS tenant_id, sha2(text, 256) AS sha256, lang AS language, text,
             CASE WHEN first IS NULL THEN 'duplicate' ELSE 'active' END AS status,
             substr(split_part(text, chr(10), 1), 1, 60) AS title, date_add(DATE '2024-01-01', CAST(doc_id % 365 AS INT)) AS document_date,
             CASE WHEN doc_id % 7 = 0 THEN TRUE WHEN doc_id % 7 = 1 THEN FALSE END AS unidentifiable
           FROM {documents} LEFT JOIN (SELECT min(doc_id) AS first FROM {documents} GROUP BY source, sha2(text, 256)) ON doc_id = first""",
        """SELECT doc_id AS id, source AS tenant_id, sha256(text) AS sha256, lang AS language, text,
             CASE WHEN row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1 THEN 'active' ELSE 'duplicate' END AS status,
             substr(split_part(text, chr(10), 1), 1, 60) AS title, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS DATE) AS document_date,
             CASE WHEN doc_id % 7 = 0 THEN TRUE WHEN doc_id % 7 = 1 THEN FALSE END AS unidentifiable FROM {documents}""",
    ),
    "records": (
        """SELECT l_orderkey * 10 + l_linenumber AS id, concat('t', CAST(l_suppkey % 4 AS STRING)) AS tenant_id, l_orderkey AS document_id,
             CASE WHEN l_linenumber % 5 = 0 THEN 'fee' ELSE 'transaction' END AS record_type, CAST(l_shipdate AS DATE) AS occurred_on,
             CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor, CASE l_returnflag WHEN 'R' THEN 'USD' WHEN 'A' THEN 'EUR' END AS currency,
             CASE l_linestatus WHEN 'O' THEN 'debit' ELSE 'credit' END AS direction, p_name AS merchant,
             CASE WHEN l_linenumber <> 7 THEN l_discount * 10 END AS confidence
           FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
        """SELECT l_orderkey * 10 + l_linenumber AS id, 't' || (l_suppkey % 4) AS tenant_id, l_orderkey AS document_id,
             CASE WHEN l_linenumber % 5 = 0 THEN 'fee' ELSE 'transaction' END AS record_type, CAST(l_shipdate AS DATE) AS occurred_on,
             CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor, CASE l_returnflag WHEN 'R' THEN 'USD' WHEN 'A' THEN 'EUR' END AS currency,
             CASE l_linestatus WHEN 'O' THEN 'debit' ELSE 'credit' END AS direction, p_name AS merchant,
             CASE WHEN l_linenumber <> 7 THEN l_discount * 10 END AS confidence
           FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    ),
    "entities": (
        """SELECT id AS document_id, tenant_id, CASE WHEN length(value) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS entity_type, value, count(*) AS frequency
           FROM (SELECT id, tenant_id, explode(regexp_extract_all(text, '[a-z]{9,}', 0)) AS value FROM {docs} WHERE status = 'active') GROUP BY ALL""",
        """SELECT id AS document_id, tenant_id, CASE WHEN length(value) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS entity_type, value, count(*) AS frequency
           FROM (SELECT id, tenant_id, unnest(regexp_extract_all(text, '[a-z]{9,}')) AS value FROM {docs} WHERE status = 'active') GROUP BY ALL""",
    ),
    "links": (
        """SELECT document_id, category, CAST(row_number() OVER (PARTITION BY document_id ORDER BY n DESC, category) - 1 AS INT) AS rank
           FROM (SELECT user_id AS document_id, event_type AS category, count(*) AS n FROM {events} GROUP BY ALL)""",
        None,
    ),
    "nodes": (
        """SELECT concat('c', c_custkey) AS id, 'PERSON' AS entity_type, c_name AS label FROM {customer}
           UNION ALL SELECT concat('s', s_suppkey), 'ORG', s_name FROM {supplier}
           UNION ALL SELECT concat('n', n_nationkey), 'GPE', n_name FROM {nation}
           UNION ALL SELECT concat('r', r_regionkey), 'REGION', r_name FROM {region}""",
        None,
    ),
    "provenance": (
        """SELECT concat('c', o_custkey) AS src, 'CUSTOMER_OF' AS predicate, concat('s', l_suppkey) AS dst, l_orderkey AS document_id
           FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
           UNION ALL SELECT concat('c', c_custkey), 'RESIDES_IN', concat('n', c_nationkey), -c_custkey FROM {customer}
           UNION ALL SELECT concat('s', s_suppkey), 'LOCATED_IN', concat('n', s_nationkey), -s_suppkey FROM {supplier}
           UNION ALL SELECT concat('n', n_nationkey), 'PART_OF', concat('r', n_regionkey), -n_nationkey FROM {nation}""",
        None,
    ),
    "edges": ("SELECT src, predicate, dst, count(*) AS evidence FROM {provenance} GROUP BY ALL", None),
    "ledger": (
        """SELECT user_id AS document_id, event_type AS feature, CAST(1 + event_id % 2 AS INT) AS version, CAST(event_id % 4 AS INT) AS attempts, ts AS last_attempt,
             CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'done' END AS status
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) WHERE rn = 1""",
        None,
    ),
    "messages": ("SELECT conv_id AS thread_id, turn AS ordinal, role, text FROM {conversations}", None),
    "chunks": (
        """SELECT id AS document_id, tenant_id, concat(id, ':', CAST(start DIV 1000 AS STRING)) AS chunk_id, start, substr(text, start + 1, 1200) AS text
           FROM (SELECT id, tenant_id, text, explode(sequence(0, CAST(greatest(length(text) - 201, 0) AS INT), 1000)) AS start FROM {docs} WHERE status = 'active')
           WHERE trim(substr(text, start + 1, 1200)) <> ''""",
        """SELECT id AS document_id, tenant_id, concat(id, ':', CAST(start // 1000 AS VARCHAR)) AS chunk_id, start, substr(text, start + 1, 1200) AS text
           FROM (SELECT id, tenant_id, text, CAST(unnest(generate_series(0, greatest(length(text) - 201, 0), 1000)) AS INT) AS start FROM {docs} WHERE status = 'active')
           WHERE trim(substr(text, start + 1, 1200)) <> ''""",
    ),
    "named": (
        """SELECT id, CASE WHEN id % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS entity_type,
             concat(array_join(CASE WHEN id % 7 = 0 THEN reverse(w) ELSE w END, ' '), CASE WHEN id % 13 = 0 THEN ' ii' WHEN id % 5 = 1 THEN 'q'
  ELSE '' END) AS value
          
  FROM (SELECT doc_id AS id, slice(filter(split(lower(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z]+', ' ')), ' '), x -> x <> ''), 1, CAST(2 + doc_id % 3 AS INT)) AS w
  FROM {documents})
           WHERE size(w) > 0""",
        """SELECT id, CASE WHEN id % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS entity_type,
             concat(array_to_string(CASE WHEN id % 7 = 0 THEN list_reverse(w) ELSE w END, ' '), CASE WHEN id % 13 = 0 THEN ' ii'
  WHEN id % 5 = 1 THEN 'q' ELSE '' END) AS value
          
  FROM (SELECT doc_id AS id, list_filter(string_split(lower(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z]+', ' ', 'g')), ' '), lambda x: x <> '')[1:2 + doc_id % 3] AS w
  FROM {documents})
           WHERE len(w) > 0""",
    ),
    # words of titles as mentions of entities
    "spots": (
        """SELECT id AS document_id, title, s.start AS start, s.end AS stop, s.value AS value, CASE WHEN length(s.value) % 2 = 0 THEN 'PERSON'
  ELSE 'ORG' END AS label, CAST(length(s.value) % 7 AS DOUBLE) / 8 AS score
          
  FROM (SELECT id, title, explode(transform(sequence(1, size(m)), i -> named_struct('start', aggregate(slice(g, 1, i), 0, (a, x) -> a + length(x)) + aggregate(slice(m, 1, i - 1), 0, (a, x) -> a + length(x)),
               'end', aggregate(slice(g, 1, i), 0, (a, x) -> a + length(x)) + aggregate(slice(m, 1, i), 0, (a, x) -> a + length(x)), 'value', m[i - 1]))) AS s
             FROM (SELECT id, title, split(title, '[A-Z][a-z]+|[a-z]{5,}', -1) AS g, regexp_extract_all(title, '[A-Z][a-z]+|[a-z]{5,}', 0) AS m
  FROM {docs} WHERE status = 'active') WHERE size(m) > 0)""",
        """SELECT document_id, title, CAST(start AS INT) AS start, CAST(start + length(value) AS INT) AS stop, value, CASE
  WHEN length(value) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS label, CAST(length(value) % 7 AS DOUBLE) / 8 AS score
          
  FROM (SELECT document_id, title, m[i] AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
             FROM (SELECT *, unnest(generate_series(1, len(m))) AS i
  FROM (SELECT id AS document_id, title, string_split_regex(title, '[A-Z][a-z]+|[a-z]{5,}') AS g, regexp_extract_all(title, '[A-Z][a-z]+|[a-z]{5,}') AS m
  FROM {docs} WHERE status = 'active')))""",
    ),
    "letters": (
        """SELECT id, iban, concat_ws(chr(10), c_name, concat('Konto: ', CASE WHEN k % 2 = 0 THEN iban
  ELSE concat_ws(' ', substr(iban, 1, 4), substr(iban, 5, 4), substr(iban, 9, 4), substr(iban, 13, 4), substr(iban, 17, 4), substr(iban, 21, 2)) END),
             CASE k % 5 WHEN 0 THEN 'USt-IdNr. DE136695976' WHEN 1 THEN 'USt-IdNr. DE136695977' WHEN 2 THEN 'Nummer ATU13585627'
  WHEN 3 THEN 'VAT FR40303265045' ELSE 'Ref FR40303265045' END,
             CASE k % 3 WHEN 0 THEN concat('Register: HRB ', CAST(k % 100000 AS STRING))
  WHEN 1 THEN concat('Amtsgericht Bonn, VR ', CAST(k % 100000 AS STRING)) ELSE 'Code PR 77' END,
             CASE k % 2 WHEN 0 THEN 'Steuernummer 12/345/67890' ELSE 'Az. 12/345/67890' END,
             CASE k % 3 WHEN 0 THEN 'Ruf +49 30 1234567' WHEN 1 THEN 'Tel. 030 1234567' ELSE 'Kunde 030 1234567' END,
             concat('Hauptstraße ', CAST(1 + k % 90 AS STRING)), concat(CAST(10000 + k % 80000 AS STRING), ' München'), 'Ende.') AS text
  FROM (SELECT *, concat('DE', lpad(CAST(98 - CAST(CAST(concat(bban, '131400') AS DECIMAL(38, 0)) % 97 AS INT) AS STRING), 2, '0'), substr(bban, 1, 17), CASE
  WHEN broken = 3 THEN CAST((CAST(substr(bban, 18, 1) AS INT) + 1) % 10 AS STRING) ELSE substr(bban, 18, 1) END) AS iban
  FROM (SELECT c_custkey AS id, lpad(CAST(c_custkey * 7919 AS STRING), 18, '0') AS bban, c_custkey % 4 AS broken, c_name, CAST(c_custkey AS STRING) AS n, c_custkey AS k
  FROM {customer}))""",
        """SELECT id, iban, concat_ws(chr(10), c_name, concat('Konto: ', CASE WHEN k % 2 = 0 THEN iban
  ELSE concat_ws(' ', substr(iban, 1, 4), substr(iban, 5, 4), substr(iban, 9, 4), substr(iban, 13, 4), substr(iban, 17, 4), substr(iban, 21, 2)) END),
             CASE k % 5 WHEN 0 THEN 'USt-IdNr. DE136695976' WHEN 1 THEN 'USt-IdNr. DE136695977' WHEN 2 THEN 'Nummer ATU13585627'
  WHEN 3 THEN 'VAT FR40303265045' ELSE 'Ref FR40303265045' END,
             CASE k % 3 WHEN 0 THEN concat('Register: HRB ', CAST(k % 100000 AS VARCHAR))
  WHEN 1 THEN concat('Amtsgericht Bonn, VR ', CAST(k % 100000 AS VARCHAR)) ELSE 'Code PR 77' END,
             CASE k % 2 WHEN 0 THEN 'Steuernummer 12/345/67890' ELSE 'Az. 12/345/67890' END,
             CASE k % 3 WHEN 0 THEN 'Ruf +49 30 1234567' WHEN 1 THEN 'Tel. 030 1234567' ELSE 'Kunde 030 1234567' END,
             concat('Hauptstraße ', CAST(1 + k % 90 AS VARCHAR)), concat(CAST(10000 + k % 80000 AS VARCHAR), ' München'), 'Ende.') AS text
  FROM (SELECT *, concat('DE', lpad(CAST(98 - CAST(CAST(concat(bban, '131400') AS HUGEINT) % 97 AS INT) AS VARCHAR), 2, '0'), substr(bban, 1, 17), CASE
  WHEN broken = 3 THEN CAST((CAST(substr(bban, 18, 1) AS INT) + 1) % 10 AS VARCHAR) ELSE substr(bban, 18, 1) END) AS iban
  FROM (SELECT c_custkey AS id, lpad(CAST(c_custkey * 7919 AS VARCHAR), 18, '0') AS bban, c_custkey % 4 AS broken, c_name, CAST(c_custkey AS VARCHAR) AS n, c_custkey AS k
  FROM {customer}))""",
    ),
    "vectors": ("SELECT vec_id AS chunk_id, CAST(floor(vec_id / 5) AS BIGINT) AS document_id, label AS category, embedding FROM {embeddings}", None),
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names(sql: str) -> list[str]:
    return [n for n in [*DEFINITIONS, *TABLES] if "{" + n + "}" in sql]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalog table or an input table as a DataFrame."""
    if name in DEFINITIONS:
        return run_sql(spark, sf_dir, DEFINITIONS[name][0])
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    """Spark SQL in which {name} stands for a table of this catalog, an input table or a DataFrame given by name."""
    used = {n: frame(spark, sf_dir, n) for n in _names(sql) if n not in more}
    kept = {**used, **more}
    # other braces, as in regular expressions, are doubled: Spark formats the text
    parts = re.split(r"\{(" + "|".join(kept) + r")\}", sql) if kept else [sql]
    text = "".join("{" + p + "}" if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(parts)) if kept else sql
    return spark.sql(text, **kept)


def oracle(sql: str) -> str:
    """The same text for DuckDB: each catalog table it needs, directly or not, becomes a common table expression."""
    needed, todo = set(), _names(sql)
    while todo:
        n = todo.pop()
        if n in DEFINITIONS and n not in needed:
            needed.add(n)
            todo += _names(DEFINITIONS[n][0])
    tables = [f"{n} AS ({d[1] or d[0]})" for n, d in DEFINITIONS.items() if n in needed]
    text = f"WITH {', '.join(tables)} SELECT * FROM ({sql})" if tables else sql
    return re.sub(r"\{(" + "|".join([*DEFINITIONS, *TABLES]) + r")\}", r"\1", text)
