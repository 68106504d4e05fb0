"""Event-time windows over the events table (the same plans run on streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.windows import event_windows
from .registry import query, t


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, round(sum(value), 3) AS total, count(value) AS n FROM events GROUP BY 1, 2")
def tumbling_5m(spark, d):
    out = event_windows(t(spark, d, "events"), "ts").tumbling("5 minutes").agg("value", "sum", "total").agg("value", "count", "n").frame()
    return out.withColumn("total", F.round("total", 3))


@query("""SELECT ws AS window_start, ws + INTERVAL 10 MINUTE AS window_end, event_type, round(avg(value), 4) AS m FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS ws FROM events) GROUP BY 1, 2, 3""")
def sliding_10m_5m(spark, d):
    out = event_windows(t(spark, d, "events"), "ts", ["event_type"]).sliding("10 minutes", "5 minutes").agg("value", "mean", "m").frame()
    return out.withColumn("m", F.round("m", 4))


@query("""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS event_count FROM s GROUP BY user_id, sid""")
def session_gap(spark, d):
    return event_windows(t(spark, d, "events"), "ts", ["user_id"]).session("6 hours").frame()
