"""Files that land and settle, and documents that are extracted and activated: pages as files that a crawler writes, looked at again and again."""

from pyspark.sql import functions as F

from ..catalog import frame, run_sql
from ..operators.activation import ActiveTable, activate
from ..streaming import stability
from ..workspace import Workspace
from .registry import query

QUIET, FORGET, START = 20, 60, 1_700_000_000
# A page's file is written 4,096 characters a look (every 10 seconds), then stands for 4 looks. Some writers pause for one look,
# some files are written over later, some vanish for longer than they are remembered and come back, some are hidden.
_LOOKS = """
  SELECT page_id, n, m, {series} AS look FROM (SELECT page_id, CAST(length(coalesce(html, '')) AS BIGINT) AS n, CAST(ceil(length(coalesce(html, '')) / 4096.0) AS BIGINT) AS m FROM {pages} WHERE page_id IS NOT NULL)"""
_FILES = """
  SELECT concat('/in/', CASE WHEN page_id % 11 = 0 THEN '.' ELSE '' END, CAST(page_id AS STRING), '.html') AS path,
    CASE WHEN page_id % 5 = 0 AND look >= m + 4 THEN n + 1 WHEN page_id % 3 = 0 AND look >= 1 THEN least(n, 4096 * (look - 1)) ELSE least(n, 4096 * look) END AS size,
    {start} + 10 * CASE WHEN page_id % 5 = 0 AND look >= m + 4 THEN m + 4 WHEN page_id % 3 = 0 AND look >= 1 THEN least(look, m + 1) ELSE least(look, m) END AS modified,
    {start} + 10 * look + CASE WHEN page_id % 7 = 3 AND look > m + 6 THEN 70 ELSE 0 END AS seen
  FROM ({looks})"""


def _observations(series: str, pages: str) -> str:
    return _FILES.replace("{looks}", _LOOKS).replace("{series}", series).replace("{pages}", pages).replace("{start}", str(START))


_SPARK = _observations("explode(sequence(CAST(0 AS BIGINT), m + 10))", "{pages}")
_DUCK = _observations("unnest(range(0, m + 11))", "pages").replace("AS STRING", "AS VARCHAR")


@query(
    "a1_settled_files",
    f"""WITH looks AS (SELECT DISTINCT path, size, modified, seen FROM ({_DUCK}) WHERE NOT regexp_matches(path, '/[.][^/]*$')),
  marked AS (SELECT *, CASE WHEN lag(size) OVER w = size AND lag(modified) OVER w = modified AND seen - lag(seen) OVER w <= {FORGET} THEN 0 ELSE 1 END AS fresh FROM looks WINDOW w AS (PARTITION BY path ORDER BY seen, modified, size)),
  runs AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY seen, modified, size) AS run FROM marked),
  begun AS (SELECT *, min(seen) OVER (PARTITION BY path, run) AS since FROM runs)
SELECT path, size, modified, since, min(seen) AS settled_at FROM begun WHERE seen - since >= {QUIET} GROUP BY path, run, size, modified, since""",
)
def a1(spark, sf_dir):
    """Every settled file of the log, by the stream with one state and one timer a path."""
    ws = Workspace(spark, "landing")
    ws.save(run_sql(spark, sf_dir, _SPARK), "log")
    ws.save(spark.createDataFrame([], stability.SETTLED), "settled/batch_id=-1")  # so that a log without settled files can be read
    stability.gate_run(spark, ws.path("log"), ws.path("settled"), ws.path("checkpoint"), QUIET, FORGET).awaitTermination()
    ws.drop("log", "checkpoint")
    return spark.read.schema(stability.SETTLED).parquet(ws.path("settled")).select("path", "size", "modified", "since", "settled_at")


@query(
    "l52_pending_files",
    f"""WITH looks AS (SELECT * FROM ({_DUCK}) WHERE NOT regexp_matches(path, '/[.][^/]*$')), last AS (SELECT DISTINCT path, size FROM looks WHERE seen = (SELECT max(seen) FROM looks))
SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM last""",
)
def l52(spark, sf_dir):
    """What waits in the folder at the last look."""
    return stability.pending(run_sql(spark, sf_dir, _SPARK))


@query(
    "l40_staged_extract",
    """WITH rows AS (SELECT doc_id AS document_id, sha256(coalesce(text, '')) AS sha256, CAST(length(coalesce(text, '')) AS BIGINT) AS size, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS version FROM documents WHERE doc_id IS NOT NULL),
  owned AS (SELECT *, first_value(document_id) OVER (PARTITION BY sha256 ORDER BY version, document_id) AS owner FROM rows)
SELECT document_id, sha256, size, CASE WHEN owner = document_id THEN 'active' ELSE 'duplicate' END AS state, CASE WHEN owner <> document_id THEN owner END AS duplicate_of, CAST(version AS BIGINT) AS version FROM owned""",
)
def l40(spark, sf_dir):
    """All documents in two jobs, English ones first: each is active or a duplicate of the one that was active before it."""
    table = ActiveTable(spark, Workspace(spark, "extract").path("table"))
    rows = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("first"))
    activate(table, "english", rows.where("first"))
    activate(table, "others", rows.where("NOT first"))
    return table.read()
