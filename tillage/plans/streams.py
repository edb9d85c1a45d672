"""Queries that drain a stream over the events and return what it emitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillage.plans.catalogue import REGISTRY
from tillage.streaming import stateful as K
from tillage.streaming import telemetry as Z

add = REGISTRY.add


def _events(spark, sf_dir):
    return Z.timed(Z.read_stream(spark, sf_dir, "events"))


_MARK = "m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)"


@add(
    "stream_daily_avg",
    f"""WITH {_MARK} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, round(avg(value), 6) AS avg_value, count(*) AS n FROM events, m
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY ALL""",
)
def stream_daily_avg(spark, sf_dir):
    """Windows behind the watermark: the last day stays open."""
    out = Z.drained(Z.window_means(_events(spark, sf_dir), "1 day", by=["event_type"]))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", F.round("avg_value", 6).alias("avg_value"), "n")


@add("stream_dedupe", "SELECT DISTINCT user_id, event_type, 'texto ' || CAST(floor(value / 50) AS BIGINT) AS text FROM events")
def stream_dedupe(spark, sf_dir):
    """One of each recommendation (crop, action, text) of a batch; which one is left open, so only the keys are shown."""
    e = Z.timed(Z.read_stream(spark, sf_dir, "events"), late="75 minutes")
    e = e.withColumn("text", F.concat(F.lit("texto "), F.floor(F.col("value") / 50).cast("string")))
    return Z.drained(Z.first_in_window(e, ["user_id", "event_type", "text"]).select("user_id", "event_type", "text"))


@add(
    "stream_sessions",
    f"""WITH {_MARK}, g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g), t AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS z, count(*) AS n FROM s GROUP BY user_id, s)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(z, '%Y-%m-%d %H:%M:%S') AS "end", n FROM t, m WHERE z <= mark""",
)
def stream_sessions(spark, sf_dir):
    """A user's events less than half an hour apart, once the watermark has passed them."""
    out = Z.drained(Z.sessions(_events(spark, sf_dir), "user_id", "30 minutes"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("user_id", shown("start").alias("start"), shown("end").alias("end"), "n")


@add(
    "stream_latest_state",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, count(*) AS seen FROM events GROUP BY user_id"
)
def stream_latest_state(spark, sf_dir):
    found = Z.drained(K.latest_state(_events(spark, sf_dir)), "update")
    return found.groupBy("user_id").agg(F.max_by("event_id", "seen").alias("event_id"), F.max_by("value", "seen").alias("value"), F.max("seen").alias("seen"))


@add(
    "stream_breaker",
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_ms(ts) AS ms_at, event_type <> 'error' AS ok, value AS ms FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, 'closed' AS kind, 0::BIGINT AS since, []::STRUCT(ok BOOLEAN, ms DOUBLE)[] AS recent, 0.0::DOUBLE AS error_rate, 0.0::DOUBLE AS p95 FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, i, kind, CASE WHEN kind = 'open' AND was <> 'open' THEN ms_at ELSE since END, recent, error_rate, p95 FROM (
    SELECT *, CASE WHEN was = 'half-open' THEN CASE WHEN NOT ok OR p95 > 140 THEN 'open' WHEN len(recent) >= 5 THEN 'closed' ELSE was END
                   WHEN was = 'closed' AND (error_rate > 0.3 OR p95 > 140) THEN 'open' ELSE was END AS kind
    FROM (SELECT *, len(list_filter(recent, lambda x: NOT x.ok)) / len(recent) AS error_rate, list_sort(list_transform(recent, lambda x: x.ms))[least(len(recent), 1 + CAST(floor(len(recent) * 0.95) AS INT))] AS p95
      FROM (SELECT e.user_id, e.i, e.ms_at, e.ok, r.since, CASE WHEN r.kind = 'open' AND e.ms_at - r.since >= 30000 THEN 'half-open' ELSE r.kind END AS was,
                   list_append(CASE WHEN r.kind = 'open' AND e.ms_at - r.since >= 30000 THEN [] ELSE r.recent END, {'ok': e.ok, 'ms': e.ms})[-30:] AS recent
            FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))),
m AS (SELECT max(epoch_ms(ts)) - 600000 AS mark FROM events)
SELECT user_id, CASE WHEN kind = 'open' AND since + 30000 <= mark THEN 'half-open' ELSE kind END AS state, round(error_rate, 9) AS error_rate, p95
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS n FROM r), m WHERE n = 1""",
)
def stream_breaker(spark, sf_dir):
    """The last state of every user: timers half-open those that stay open until the watermark."""
    e = _events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    out = Z.drained(K.breaker(e, "user_id", "ok", "value", max_error=0.3, max_p95=140.0), "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("state", "error_rate", "p95"), F.struct("at", F.col("state") == "half-open")).alias("s"))
    return last.select("user_id", "s.state", F.round("s.error_rate", 9).alias("error_rate"), "s.p95")


@add("stream_late_rows", "SELECT 3::BIGINT AS late, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def stream_late_rows(spark, sf_dir):
    """Rows that come behind the watermark are counted, not lost in silence: three of them follow the newest ten days."""
    return Z.late_rows(spark, sf_dir)
