"""Catalogue: access by token, job progress and the alert table over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.operators import ledgers
from loamworks.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(read_table(spark, sf_dir, "events"))
        SQL[f.__name__] = sql
        return f

    return register


@query(
    """WITH p AS (SELECT user_id, ts AS bought FROM events WHERE event_type = 'purchase'),
c AS (SELECT e.event_id, e.user_id, e.ts, p.bought FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.bought WHERE e.event_type = 'view'),
v AS (SELECT *, coalesce(ts < bought + INTERVAL 5 DAY, false) AND NOT EXISTS (SELECT 1 FROM events r
  WHERE r.event_type = 'error' AND r.value > 50 AND r.user_id = c.user_id AND r.ts BETWEEN c.bought AND c.ts) AS good FROM c),
t AS (SELECT *, count(*) FILTER (WHERE good) OVER (PARTITION BY user_id, bought ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM v)
SELECT event_id, user_id, good AND turn <= 2 AS granted, least(turn, 2)::BIGINT AS used FROM t"""
)
def access_gate(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "purchase").when(F.col("event_type") == "view", "call").when((F.col("event_type") == "error") & (F.col("value") > 50), "revoke")
    log = events.select("event_id", "user_id", "ts", kind.alias("kind"), F.lit(2).alias("quota"), F.lit(5 * 86400.0).alias("ttl")).where("kind IS NOT NULL")
    return ledgers.access_calls(log, ["user_id"], "ts", "event_id")


@query(
    """WITH r AS (SELECT user_id AS job, event_id, epoch_us(ts) / 1e6 AS secs, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE event_type END AS stage FROM events),
s AS (SELECT *, min(secs) OVER (PARTITION BY job) AS start, stage IN ('done', 'failed') AS final FROM r),
o AS (SELECT *, coalesce(bool_or(final) OVER (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM s WHERE secs <= start + 172800)
SELECT job, secs AS "at", stage, NULL::VARCHAR AS error FROM o WHERE NOT over
UNION ALL SELECT job, start + 172800, 'failed', 'timeout' FROM o WHERE NOT over GROUP BY job, start HAVING NOT bool_or(final)"""
)
def job_watch(events: DataFrame) -> DataFrame:
    stage = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    updates = events.select(F.col("user_id").alias("job"), "event_id", "ts", stage.alias("stage"))
    return ledgers.job_progress(updates, "job", "ts", "event_id", timeout_s=172_800)


@query(
    """WITH e AS (SELECT CASE WHEN value > 100 THEN 'critical' ELSE 'warning' END AS severity, user_id::VARCHAR AS job, 'scoring' AS stage, props AS message, ts AS since, user_id % 2 = 0 AS resolved FROM events WHERE event_type = 'error'),
a AS (SELECT * FROM e UNION ALL SELECT 'critical', 'manual', 'packaging', 'stopped by hand', TIMESTAMP '2024-01-20 12:00:00', false),
n AS (SELECT *, md5(concat_ws('|', severity, job, stage, message, epoch_us(since)::VARCHAR)) AS alert_id FROM a)
SELECT alert_id, severity, job, stage, message FROM n WHERE NOT resolved ORDER BY since DESC, alert_id DESC LIMIT 500"""
)
def alert_table(events: DataFrame) -> DataFrame:
    severity = F.when(F.col("value") > 100, "critical").otherwise("warning")
    rows = events.where("event_type = 'error'").select(
        severity.alias("severity"), F.col("user_id").cast("string").alias("job"), F.lit("scoring").alias("stage"), F.col("props").alias("message"), F.col("ts").cast("timestamp").alias("at"), F.lit(False).alias("resolved")
    )
    alerts = rows.withColumn("alert_id", ledgers.alert_id(rows))
    alerts = ledgers.fired(alerts, "manual", "packaging", "critical", "stopped by hand", "2024-01-20 12:00:00")
    even = alerts.where("try_cast(job AS long) % 2 = 0").select("alert_id")
    return ledgers.shown_alerts(ledgers.resolved(alerts, even), limit=500).select("alert_id", "severity", "job", "stage", "message")
