"""Catalogue: admission control and windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamworks.session import read_table
from loamworks.streaming import state as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(read_table(spark, sf_dir, "events"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


TURNS = "SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events"


@query(
    f"""WITH RECURSIVE r AS ({TURNS}),
s AS (SELECT user_id, event_id, i, [t] AS taken, true AS allowed FROM r WHERE i = 1
  UNION ALL SELECT user_id, event_id, i, CASE WHEN len(recent) < 2 THEN list_append(recent, t) ELSE recent END, len(recent) < 2
  FROM (SELECT r.*, list_filter(s.taken, lambda a: a > r.t - 86400) AS recent FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1))
SELECT user_id, event_id, allowed FROM s"""
)
def rate_limit(events):
    return S.rate_limit(events, "user_id", "ts", "event_id", 2, 86400.0)


@query(
    f"""WITH RECURSIVE r AS ({TURNS}),
s AS (SELECT user_id, event_id, i, t, 2::DOUBLE AS level, true AS allowed FROM r WHERE i = 1
  UNION ALL SELECT user_id, event_id, i, t, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END, filled >= 1
  FROM (SELECT r.*, least(3::DOUBLE, s.level + (r.t - s.t) * (3::DOUBLE / 86400)) AS filled FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1))
SELECT user_id, event_id, allowed FROM s"""
)
def token_bucket(events):
    return S.token_bucket(events, "user_id", "ts", "event_id", 3.0, 3 / 86400)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(events):
    return S.stream_windows(events, "ts", ["event_type"], "1 day")


@query("SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY ALL")
def sliding_windows(events):
    return S.stream_windows(events, "ts", ["event_type"], "24 hours", "12 hours")


@query("WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, event_id, ts, max(new) OVER (PARTITION BY user_id, ts) * (row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1)::INT AS new FROM g)) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(events):
    return S.sessions(events, "ts", "user_id", "6 hours")


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS balance, count(*) AS entries FROM events GROUP BY 1")
def ledger_accumulate(events):
    out = S.stream_balances(events, "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0))
    return out.withColumn("balance", F.round("balance", 4))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
def requests_in_window(events):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return events.select("event_id", F.count("*").over(w).alias("n"))


@query(
    """WITH RECURSIVE r AS (SELECT event_id, event_type AS route, user_id % 5 AS who, epoch_us(ts) / 1e6 AS t, CASE event_type WHEN 'click' THEN 2 ELSE 1 END AS most,
    row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('click', 'purchase', 'view')),
s AS (SELECT route, who, event_id, i, t, [t] AS taken, 0::DOUBLE AS level, true AS allowed FROM r WHERE i = 1
  UNION ALL SELECT route, who, event_id, i, t, CASE WHEN ok THEN list_append(recent, t) ELSE recent END, CASE WHEN ok THEN filled - 1 ELSE filled END, ok
  FROM (SELECT *, CASE WHEN route = 'view' THEN filled >= 1 ELSE len(recent) < most END AS ok
    FROM (SELECT r.*, list_filter(s.taken, lambda a: a > r.t - 3600) AS recent, least(1::DOUBLE, s.level + (r.t - s.t) * (1::DOUBLE / 60)) AS filled FROM s JOIN r ON r.route = s.route AND r.who = s.who AND r.i = s.i + 1)))
SELECT event_id, allowed FROM s UNION ALL SELECT event_id, true FROM events WHERE event_type NOT IN ('click', 'purchase', 'view')"""
)
def routed_limits(events):
    path = F.when(F.col("event_type") == "view", "/api/valuate").when(F.col("event_type") == "click", "/api/auth/login").when(F.col("event_type") == "purchase", "/api/dataset/batch_ingest").otherwise("/api/other")
    rows = events.select("event_id", "ts", path.alias("path"), S.client(F.lit(None).cast("string"), (F.col("user_id") % 5).cast("string")).alias("who"))
    return S.routed_limits(rows, "path", "who", "ts", "event_id", {"/api/auth/login": (2, 3600.0), "/api/dataset/batch_ingest": (1, 3600.0)}, {"/api/valuate": 1})
