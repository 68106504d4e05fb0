"""Rolling, expanding, cumulative, rank, shift, missing data and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import missing, windows
from ..operators.groupby import group_by
from ..ordering import cumulative, row_windows, with_position
from ..timeseries import features
from .registry import query, t

ORDER = ["o_orderdate", "o_orderkey"]


def _orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


@query("SELECT o_orderkey, round(CASE WHEN count(o_totalprice) OVER w = 7 THEN avg(o_totalprice) OVER w END, 4) AS r FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS 6 PRECEDING)")
def rolling_mean_7(spark, d):
    return windows.rolling(_orders(spark, d), "o_totalprice", 7, "mean", ORDER, out="r").select("o_orderkey", F.round("r", 4).alias("r"))


@query("SELECT o_orderkey, CASE WHEN count(*) OVER w = 4 THEN max(o_totalprice) OVER w END AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def rolling_center_by_key(spark, d):
    return windows.rolling(_orders(spark, d), "o_totalprice", 4, "max", ORDER, ["o_custkey"], center=True, out="r").select("o_orderkey", "r")


@query("SELECT o_orderkey, round(stddev_samp(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS 9 PRECEDING), 3) AS r FROM orders")
def rolling_std_min_periods(spark, d):
    return windows.rolling(_orders(spark, d), "o_totalprice", 10, "std", ORDER, min_periods=1, out="r").select("o_orderkey", F.round("r", 3).alias("r"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def expanding_sum(spark, d):
    out = windows.expanding(_orders(spark, d), "o_totalprice", "sum", ORDER, out="s")
    return out.select("o_orderkey", F.round("s", 2).alias("s"))


_SHIFTED = "(SELECT o_orderkey, o_orderdate, o_totalprice + 1e9::DOUBLE AS v FROM orders)"


def _shifted(spark, d):
    """Values with a large offset, which cost a sum of squares all its digits."""
    return _orders(spark, d).withColumn("v", F.col("o_totalprice") + 1e9)


@query(f"SELECT o_orderkey, round(stddev_samp(v) OVER w, 0) AS s, round(var_samp(v) OVER w / 1e6::DOUBLE, 0) AS q FROM {_SHIFTED} WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def expanding_std(spark, d):
    out = windows.expanding(_shifted(spark, d), "v", "std", ORDER, out="s")
    return windows.expanding(out, "v", "var", ORDER, out="q").select("o_orderkey", F.round("s", 0).alias("s"), F.round(F.col("q") / 1e6, 0).alias("q"))


@query(f"SELECT o_orderkey, round(avg(v - 1e9) OVER w, 0) AS m, CASE WHEN count(*) OVER w >= 5 THEN min(v) OVER w END AS lo, max(v) OVER w AS hi FROM {_SHIFTED} WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def expanding_mean_min_max(spark, d):
    out = windows.expanding(_shifted(spark, d), "v", "mean", ORDER, out="m")
    out = windows.expanding(out, "v", "min", ORDER, min_periods=5, out="lo")
    return windows.expanding(out, "v", "max", ORDER, out="hi").select("o_orderkey", F.round(F.col("m") - 1e9, 0).alias("m"), "lo", "hi")


@query("SELECT c_custkey, (row_number() OVER w - 1)::BIGINT AS p, round(sum(c_acctbal) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS s FROM customer WINDOW w AS (ORDER BY c_name DESC, c_custkey)")
def positions_by_name(spark, d):
    """An order by text whose first bytes are all alike, descending."""
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    at = with_position(c, ["c_name", "c_custkey"], [False, True], "p")
    return cumulative(at, ["p"], {"s": ("sum", F.col("c_acctbal"))}).select("c_custkey", "p", F.round("s", 2).alias("s"))


@query("SELECT event_id, (count(CASE WHEN event_id % 7 NOT IN (0, 1) THEN 1 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS n FROM events WHERE event_id % 7 NOT IN (0, 1)")
def column_cumcount(spark, d):
    return windows.cumcount(_gaps(spark, d), "v", ["ts", "event_id"], out="n").where("v IS NOT NULL").select("event_id", "n")


@query("SELECT o_orderkey, max(o_totalprice) OVER w AS hi, min(o_totalprice) OVER w AS lo, count(*) OVER w AS n FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def cum_max_min(spark, d):
    c = F.col("o_totalprice")
    return cumulative(_orders(spark, d), ORDER, {"hi": ("max", c), "lo": ("min", c), "n": ("count", c)}).select("o_orderkey", "hi", "lo", "n")


@query("SELECT p_partkey, round(exp(sum(ln(1 + p_size / 1000)) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)), 8) AS p FROM part")
def cum_prod(spark, d):
    p = t(spark, d, "part").withColumn("f", 1 + F.col("p_size") / 1000)
    return windows.cum(p, "f", "prod", ["p_partkey"], ["p_brand"], "p").select("p_partkey", F.round("p", 8).alias("p"))


_RANK = "SELECT p_partkey, ({}) AS r FROM part"


@query(_RANK.format("rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE"))
def rank_average(spark, d):
    return windows.rank(t(spark, d, "part"), "p_size", "average", out="r").select("p_partkey", "r")


@query(_RANK.format("(dense_rank() OVER (ORDER BY p_size DESC))::DOUBLE"))
def rank_dense_desc(spark, d):
    return windows.rank(t(spark, d, "part"), "p_size", "dense", ascending=False, out="r").select("p_partkey", "r")


@query(_RANK.format("(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + count(*) OVER (PARTITION BY p_brand, p_size) - 1)::DOUBLE"))
def rank_max_by_key(spark, d):
    return windows.rank(t(spark, d, "part"), "p_size", "max", partition_by=["p_brand"], out="r").select("p_partkey", "r")


@query(_RANK.format("(row_number() OVER (ORDER BY p_size, p_partkey))::DOUBLE"))
def rank_first(spark, d):
    return windows.rank(t(spark, d, "part"), "p_size", "first", tie_break=["p_partkey"], out="r").select("p_partkey", "r")


@query("SELECT o_orderkey, lag(o_totalprice, 3) OVER w AS s3, lead(o_totalprice, 2) OVER w AS s2, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS df FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)")
def shift_diff(spark, d):
    c = F.col("o_totalprice")
    made = row_windows(_orders(spark, d), ORDER, lambda w: {"s3": F.lag(c, 3).over(w), "s2": F.lead(c, 2).over(w), "df": c - F.lag(c).over(w)}, 3, 2)
    return made.select("o_orderkey", "s3", "s2", F.round("df", 4).alias("df"))


@query("SELECT event_id, round((value - lead(value) OVER w) / NULLIF(lead(value) OVER w, 0), 8) AS pc FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def pct_change_backward(spark, d):
    return windows.pct_change(t(spark, d, "events"), "value", -1, ["ts", "event_id"], ["user_id"], "pc").select("event_id", F.round("pc", 8).alias("pc"))


# missing -----------------------------------------------------------------------

_GAPS = "SELECT event_id, user_id, ts, CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS v FROM events"


def _gaps(spark, d):
    return t(spark, d, "events").select("event_id", "user_id", "ts", F.when(~(F.col("event_id") % 7).isin(0, 1), F.col("value")).alias("v"))


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM ({_GAPS})")
def fillna_directions(spark, d):
    a = missing.fill_direction(_gaps(spark, d), "v", True, ["ts", "event_id"], out="f")
    return missing.fill_direction(a, "v", False, ["ts", "event_id"], ["user_id"], "b").select("event_id", "f", "b")


@query(f"SELECT event_id, coalesce(v, -1) AS v FROM ({_GAPS})")
def fillna_value(spark, d):
    return missing.fill_value(_gaps(spark, d), {"v": -1}).select("event_id", "v")


@query(f"SELECT event_id FROM ({_GAPS}) WHERE v IS NOT NULL")
def dropna_threshold(spark, d):
    return missing.drop_na(_gaps(spark, d), threshold=4).select("event_id")


@query(f"""WITH g AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS p FROM ({_GAPS})),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS bp, last_value(v IGNORE NULLS) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS bv,
first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ap, first_value(v IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS av FROM g)
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN bp IS NULL THEN av WHEN ap IS NULL THEN bv ELSE bv + (av - bv) * (p - bp) / (ap - bp) END, 6) AS v FROM k""")
def interpolate_linear(spark, d):
    return missing.interpolate_linear(_gaps(spark, d), "v", ["ts", "event_id"]).select("event_id", F.round("v", 6).alias("v"))


# resampling and features ------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, event_type, count(*) AS n, round(avg(value), 4) AS m FROM events GROUP BY 1, 2")
def resample_1h(spark, d):
    g = features.resample(t(spark, d, "events"), "ts", "1h", ["event_type"])
    return g.agg(n=("event_id", "count"), m=("value", "mean")).withColumn("m", F.round("m", 4))


@query("SELECT time_bucket(INTERVAL 7 DAY, ts) AS ts, round(sum(value), 3) AS s FROM events GROUP BY 1")
def resample_week(spark, d):
    return features.resample(t(spark, d, "events"), "ts", "1w").agg(s=("value", "sum")).withColumn("s", F.round("s", 3))


@query("SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_features(spark, d):
    return features.lag_features(t(spark, d, "events"), "value", [1, 3], ["ts", "event_id"], ["user_id"]).select("event_id", "value_lag_1", "value_lag_3")


@query("SELECT event_id, round(CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END, 5) AS m, round(CASE WHEN count(*) OVER w = 5 THEN stddev_samp(value) OVER w END, 5) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)")
def rolling_features(spark, d):
    out = features.rolling_features(t(spark, d, "events"), "value", [5], ["ts", "event_id"], ["user_id"])
    return out.select("event_id", F.round("value_roll_5_mean", 5).alias("m"), F.round("value_roll_5_std", 5).alias("s"))


@query("SELECT event_id, dayofweek(ts)::INT AS dow, month(ts)::INT AS mon, quarter(ts)::INT AS q, dayofweek(ts) IN (0, 6) AS weekend, dayofyear(ts)::INT AS doy FROM events")
def datetime_features(spark, d):
    out = features.datetime_features(t(spark, d, "events"), "ts")
    return out.select("event_id", F.col("ts_day_of_week").alias("dow"), F.col("ts_month").alias("mon"), F.col("ts_quarter").alias("q"), F.col("ts_is_weekend").alias("weekend"), F.col("ts_day_of_year").alias("doy"))


@query("WITH x AS (SELECT event_id, (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 86400000000.0::DOUBLE AS t FROM events) SELECT event_id, round(sin(t * (2 * pi() * 2 / 7)), 6) AS s, round(cos(t * (2 * pi() * 1 / 7)), 6) AS c FROM x")
def fourier_features(spark, d):
    out = features.fourier_features(t(spark, d, "events"), [7], 2, "ts")
    return out.select("event_id", F.round("fourier_p7_k2_sin", 6).alias("s"), F.round("fourier_p7_k1_cos", 6).alias("c"))


@query("""WITH b AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events), l AS (SELECT user_id, d, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, k::INT AS lag, round(CASE k WHEN 0 THEN 1.0 WHEN 1 THEN sum(d * d1) / NULLIF(sum(d * d), 0) ELSE sum(d * d2) / NULLIF(sum(d * d), 0) END, 6) AS acf FROM l, unnest([0, 1, 2]) AS u(k) GROUP BY user_id, k""")
def autocorrelation(spark, d):
    return features.autocorrelation(t(spark, d, "events"), "value", 2, ["ts", "event_id"], ["user_id"]).withColumn("acf", F.round("acf", 6))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1 ORDER BY s DESC, o_custkey LIMIT 10")
def top_customers(spark, d):
    g = group_by(t(spark, d, "orders"), "o_custkey").agg(s=("o_totalprice", "sum")).withColumn("s", F.round("s", 2))
    return g.orderBy(F.desc("s"), "o_custkey").limit(10)
