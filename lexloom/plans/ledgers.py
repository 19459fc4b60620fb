"""The work ledger and activity streams, as batch equivalents."""

from ..catalog import frame
from ..operators.ledger import bumped, claimable
from .registry import query, sql

_NOW = "2024-01-30 12:00:00"


@query("j5_claim", f"""WITH l AS (SELECT * FROM {{ledger}}) SELECT document_id, feature FROM l WHERE (status = 'pending'
  OR status = 'failed' AND attempts < 3 AND floor(epoch(TIMESTAMP '{_NOW}')) - floor(epoch(last_attempt)) >= 30 * pow(2, greatest(attempts - 1, 0))
  OR status = 'running' AND floor(epoch(TIMESTAMP '{_NOW}')) - floor(epoch(last_attempt)) >= 600)
  AND NOT EXISTS (SELECT 1 FROM (VALUES ('purchase', 'view'), ('click', 'view')) n(feature, needs) WHERE n.feature = l.feature
    AND NOT EXISTS (SELECT 1 FROM l d WHERE d.document_id = l.document_id AND d.feature = n.needs AND d.status = 'done'))""")
def j5(spark, sf_dir):
    needs = spark.createDataFrame([("purchase", "view"), ("click", "view")], "feature string, prerequisite string")
    return claimable(frame(spark, sf_dir, "ledger"), needs, _NOW).select("document_id", "feature")


@query("j4_version_bump", """SELECT document_id, feature, CASE WHEN status = 'done' AND version < 2 AND feature = 'view' THEN 2 ELSE version END AS version, CASE
  WHEN status = 'done' AND version < 2 AND feature = 'view' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'done' AND version < 2
  AND feature = 'view' THEN 0 ELSE attempts END AS attempts FROM {ledger}""")
def j4(spark, sf_dir):
    return bumped(frame(spark, sf_dir, "ledger"), spark.createDataFrame([("view", 2)], "feature string, current int"))


sql("j3_stale_recovery", "SELECT document_id, feature FROM {ledger} WHERE status NOT IN ('done', 'failed') AND last_attempt < TIMESTAMP '2024-01-20 00:00:00'")
sql("j8_recompute_queue", "SELECT tenant_id, min(id) AS next FROM {docs} WHERE status <> 'active' GROUP BY tenant_id")
sql("j9_view_dedup",
    "SELECT user_id, CAST(floor(unix_timestamp(ts) / 5) AS BIGINT) AS bucket, min(event_id) AS event_id FROM {events} WHERE event_type = 'view' GROUP BY ALL",
    "SELECT user_id, CAST(floor(floor(epoch(ts)) / 5) AS BIGINT) AS bucket, min(event_id) AS event_id FROM {events} WHERE event_type = 'view' GROUP BY ALL")
sql("j10_activity_snapshot",
    "SELECT e.event_id, e.event_type, d.title FROM {events} e LEFT JOIN {docs} d ON e.user_id = d.id",
    "SELECT event_id, event_type, title FROM events LEFT JOIN {docs} ON user_id = id")
sql("j12_request_metrics", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM {events} GROUP BY event_type")
sql("j16_tumbling_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM {events} GROUP BY ALL")
sql("j16_sessions", """SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM {events})
  WHERE previous IS NULL OR ts > previous + INTERVAL 30 MINUTES GROUP BY user_id""")
sql("j2_job_states", """SELECT document_id, feature, CASE WHEN status = 'done' THEN 'active' WHEN attempts >= 3 THEN 'quarantined' WHEN status = 'failed' THEN 'failed'
  ELSE 'queued' END AS state FROM {ledger}""")
sql("j6_mark_failed", """SELECT document_id, feature, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN attempts + 1
  ELSE attempts END AS attempts FROM {ledger}""")
sql("i9_backoff", "SELECT document_id, feature, CAST(30 * pow(2, greatest(attempts - 1, 0)) AS BIGINT) AS wait_s FROM {ledger} WHERE status = 'failed'")
sql("l22_feature_list", "SELECT document_id, feature, status FROM {ledger} ORDER BY document_id, feature LIMIT 2000")
