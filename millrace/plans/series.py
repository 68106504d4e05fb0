"""Queries whose work is a numpy kernel for each series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from ..timeseries import series
from .registry import query, t

_DAILY = "SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY 1, 2"
_NUMBERED = f"SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, v - avg(v) OVER (PARTITION BY event_type) AS c FROM ({_DAILY})"


def _daily(spark, d):
    e = t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return e.groupBy("event_type", "day").agg(F.avg("value").alias("v"))


@query("""WITH RECURSIVE x AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r(event_id, user_id, i, e) AS (SELECT event_id, user_id, i, value FROM x WHERE i = 1 UNION ALL SELECT x.event_id, x.user_id, x.i, x.value / 3 + r.e * 2 / 3 FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1)
SELECT event_id, round(e, 6) AS value_ewm FROM r""")
def ewm_mean(spark, d):
    out = windows.ewm_mean(t(spark, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"], span=5)
    return out.select("event_id", F.round("value_ewm", 6).alias("value_ewm"))


@query(f"""WITH x AS ({_NUMBERED}), w AS (SELECT *, CASE WHEN i >= 3 AND i < n - 3 THEN avg(v) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend FROM x),
p AS (SELECT event_type, i % 7 AS k, avg(v - trend) AS s FROM w GROUP BY 1, 2), c AS (SELECT event_type, k, s - avg(s) OVER (PARTITION BY event_type) AS s FROM p)
SELECT event_type, i AS position, round(v, 6) AS observed, round(trend, 6) AS trend, round(s, 6) AS seasonal, round(v - trend - s, 6) AS residual FROM w JOIN c USING (event_type) WHERE i % 7 = k AND n >= 14""")
def seasonal_decompose(spark, d):
    out = series.seasonal_decompose(_daily(spark, d), "v", 7, ["event_type"], ["day"])
    return out.withColumns({c: F.round(c, 6) for c in ("observed", "trend", "seasonal", "residual")})


@query()
def forecast_arima(spark, d):
    return series.forecast(_daily(spark, d), "v", 5, ["event_type"], ["day"], "arima", p=2, d=0, q=1)


@query(f"""WITH RECURSIVE x AS ({_NUMBERED}), r(event_type, i, n, level) AS (SELECT event_type, i, n, v FROM x WHERE i = 0 UNION ALL SELECT x.event_type, x.i, x.n, 0.3 * x.v + 0.7 * r.level FROM r JOIN x ON x.event_type = r.event_type AND x.i = r.i + 1)
SELECT event_type, step::INT AS step, round(level, 6) AS forecast FROM r, range(1, 4) AS s(step) WHERE i = n - 1""")
def forecast_smoothing(spark, d):
    out = series.forecast(_daily(spark, d), "v", 3, ["event_type"], ["day"], "smoothing", kind="simple", alpha=0.3)
    return out.withColumn("forecast", F.round("forecast", 6))


@query()
def diagnostics(spark, d):
    return series.diagnostics(_daily(spark, d), "v", 3, ["event_type"], ["day"])


@query(f"""WITH x AS ({_NUMBERED}), l AS (SELECT event_type, n, k, sum(c * c1) AS a FROM (SELECT *, lag(c, k::INT) OVER (PARTITION BY event_type, k ORDER BY i) AS c1 FROM x, range(1, 4) AS s(k)) GROUP BY 1, 2, 3),
v AS (SELECT event_type, sum(c * c) AS q FROM x GROUP BY 1) SELECT event_type, round(n * (n + 2) * sum(pow(a / q, 2) / (n - k)), 5) AS ljung_box FROM l JOIN v USING (event_type) GROUP BY event_type, n""")
def ljung_box(spark, d):
    return series.diagnostics(_daily(spark, d), "v", 3, ["event_type"], ["day"]).select("event_type", F.round("ljung_box", 5).alias("ljung_box"))


@query(f"""WITH x AS ({_NUMBERED}), m AS (SELECT event_type, n, round(pow(n, 1 / 3.0::DOUBLE))::INT AS lags, sum(c * c) / n AS s0 FROM x GROUP BY 1, 2),
g AS (SELECT m.event_type, sum((1 - k / (lags + 1.0::DOUBLE)) * a) AS b FROM m JOIN (SELECT event_type, k, sum(c * c1) AS a FROM (SELECT *, lag(c, k::INT) OVER (PARTITION BY event_type, k ORDER BY i) AS c1 FROM x, range(1, 20) AS s(k)) GROUP BY 1, 2) z ON z.event_type = m.event_type AND k <= lags GROUP BY 1),
p AS (SELECT event_type, sum(u * u) AS e FROM (SELECT event_type, sum(c) OVER (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING) AS u FROM x) GROUP BY 1)
SELECT event_type, round(e / (n * n * (s0 + 2.0 / n * b)), 6) AS kpss, e / (n * n * (s0 + 2.0 / n * b)) < 0.463 AS kpss_stationary FROM m JOIN g USING (event_type) JOIN p USING (event_type)""")
def kpss(spark, d):
    return series.diagnostics(_daily(spark, d), "v", 3, ["event_type"], ["day"]).select("event_type", F.round("kpss", 6).alias("kpss"), "kpss_stationary")


@query(f"""WITH x AS ({_NUMBERED}), l AS (SELECT event_type, lag(c) OVER w AS y, v, c, c - lag(c) OVER w AS dy, lag(v) OVER w AS p FROM x WINDOW w AS (PARTITION BY event_type ORDER BY i)),
a AS (SELECT event_type, k, sum(c * c1) / any_value(q) AS r FROM (SELECT event_type, c, k, lag(c, k::INT) OVER (PARTITION BY event_type, k ORDER BY i) AS c1, sum(c * c) OVER (PARTITION BY event_type, k) AS q FROM x, range(1, 3) AS s(k)) GROUP BY 1, 2),
b AS (SELECT event_type, max(r) FILTER (k = 1) AS r1, max(r) FILTER (k = 2) AS r2 FROM a GROUP BY 1)
SELECT event_type, lag::INT AS lag, round(CASE lag WHEN 0 THEN 1 WHEN 1 THEN r1 ELSE (r2 - r1 * r1) / (1 - r1 * r1) END, 6) AS pacf FROM b, range(3) AS s(lag)""")
def partial_autocorrelation(spark, d):
    return series.partial_autocorrelation(_daily(spark, d), "v", 2, ["event_type"], ["day"]).withColumn("pacf", F.round("pacf", 6))


@query(f"""WITH x AS ({_NUMBERED}), f AS (SELECT event_type, n, k, (pow(sum(c * cos(2 * pi() * k * i / n)), 2) + pow(sum(c * sin(2 * pi() * k * i / n)), 2)) / n AS p FROM x, range(1, 400) AS s(k) WHERE k <= n // 2 GROUP BY 1, 2, 3)
SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY p DESC)::INT AS rank, round(k / n::DOUBLE, 6) AS frequency, round(p, 5) AS power FROM f QUALIFY rank <= 3""")
def spectrum(spark, d):
    return series.spectrum(_daily(spark, d), "v", ["event_type"], ["day"]).withColumns({"frequency": F.round("frequency", 6), "power": F.round("power", 5)})


_PENALTY = 40.0


@query(f"""WITH RECURSIVE x AS ({_NUMBERED}), s AS (SELECT event_type, i, n, sum(c) OVER w AS a, sum(c * c) OVER w AS b FROM x WINDOW w AS (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT event_type, n, list_prepend(0.0::DOUBLE, list(a ORDER BY i)) AS a, list_prepend(0.0::DOUBLE, list(b ORDER BY i)) AS b FROM s GROUP BY 1, 2),
r(event_type, t, best, prev) AS (SELECT event_type, 1, [-{_PENALTY}::DOUBLE, 'inf'::DOUBLE], [0, 0]::BIGINT[] FROM p
  UNION ALL SELECT event_type, t + 1, list_append(best, list_min(v)), list_append(prev, list_position(v, list_min(v)) - 1)
  FROM (SELECT r.event_type, r.t, r.best, r.prev, list_transform(range(0, r.t), lambda z: r.best[z + 1] + p.b[r.t + 2] - p.b[z + 1] - pow(p.a[r.t + 2] - p.a[z + 1], 2) / (r.t + 1 - z) + {_PENALTY}) AS v FROM r JOIN p ON p.event_type = r.event_type WHERE r.t < p.n)),
k(event_type, pos, prev) AS (SELECT r.event_type, r.prev[p.n + 1], r.prev FROM r JOIN p ON p.event_type = r.event_type AND r.t = p.n UNION ALL SELECT event_type, prev[pos + 1], prev FROM k WHERE pos > 0)
SELECT event_type, pos AS position FROM k WHERE pos > 0""")
def changepoints(spark, d):
    return series.changepoints(_daily(spark, d), "v", ["event_type"], ["day"], penalty=_PENALTY)


@query("SELECT event_id, value, user_id, ts, time_bucket(INTERVAL 1 DAY, ts) AS day FROM events")
def calendar_floor(spark, d):
    from ..functions import datetimes

    return t(spark, d, "events").select("event_id", "value", "user_id", "ts", datetimes.floor("ts", "1d").alias("day"))

