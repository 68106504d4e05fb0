"""The rest of the surface: sources, selection, column and row functions, groups, learning, geography and streams."""

from __future__ import annotations

import datetime
import os

import numpy as np
from pyspark.sql import functions as F

from .. import frame, geo, text
from ..functions import columns as fc
from ..functions import datetimes as dt
from ..functions import strings as st
from ..ml import evaluation as ev
from ..ml import models as md
from ..ml import transformers as tr
from ..operators import missing, selection, stats
from ..operators.groupby import group_by
from ..session import scratch
from ..sources import files, jdbc, memory
from ..streaming.windows import event_windows, file_stream
from .registry import query, t

# sources and sinks ---------------------------------------------------------------


@query("SELECT * FROM (VALUES ('dict', 1.0::DOUBLE, 'x'), ('dict', 2.5, NULL), ('matrix', 3.0, NULL), ('matrix', 5.0, NULL), ('tuples', 7.0, 'y'), ('records', 8.0, 'z')) AS v(src, a, b)")
def from_memory(spark, d):
    made = {
        "dict": memory.from_dict(spark, {"a": [1.0, 2.5], "b": ["x", None]}),
        "matrix": memory.from_matrix(spark, [[3, 4], [5, 6]], ["a", "c"]).selectExpr("a", "CAST(NULL AS string) AS b"),
        "tuples": memory.from_tuples(spark, ["a", "b"], [(7.0, "y")]),
        "records": memory.from_records(spark, [{"a": 8.0, "b": "z"}]),
    }
    out = None
    for name, df in made.items():
        part = df.select(F.lit(name).alias("src"), "a", "b")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT ts, 'end' AS by FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 36 HOUR) AS g(ts) UNION ALL SELECT TIMESTAMP '2024-01-01' + INTERVAL 15 MINUTE * i, 'periods' FROM range(100) AS r(i)")
def date_range(spark, d):
    a = dt.date_range(spark, "2024-01-01", "2024-03-01", "36h", name="ts").withColumn("by", F.lit("end"))
    return a.unionByName(dt.date_range(spark, "2024-01-01", step="15m", periods=100, name="ts").withColumn("by", F.lit("periods")))


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer"


def _customer(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


def _typed(df):
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query(_CUSTOMER)
def csv_round_trip(spark, d):
    path = scratch(spark, "csv")
    files.write_csv(_customer(spark, d), path, sep=";")
    return _typed(files.read_csv(spark, path, sep=";"))


@query(_CUSTOMER)
def json_lines_round_trip(spark, d):
    path = scratch(spark, "jsonl")
    files.write_json_lines(_customer(spark, d), path)
    return _typed(files.read_json(spark, path, orient="lines"))


@query(_CUSTOMER + " WHERE c_mktsegment = 'BUILDING'")
def parquet_partitions(spark, d):
    path = scratch(spark, "parquet")
    files.write_parquet(_customer(spark, d), path, ["c_mktsegment"])
    return files.read_parquet(spark, path, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]).where("c_mktsegment = 'BUILDING'")


@query(_CUSTOMER)
def orc_round_trip(spark, d):
    path = scratch(spark, "orc")
    files.write_orc(_customer(spark, d), path)
    return files.read_orc(spark, path)


@query("SELECT r_regionkey, r_name FROM region")
def arrow_round_trip(spark, d):
    path = scratch(spark, "arrow")
    files.write_arrow(t(spark, d, "region"), path)
    return files.read_arrow(spark, path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def excel_round_trip(spark, d):
    path = scratch(spark, "excel") + ".xlsx"
    files.write_excel(t(spark, d, "nation"), path, "nations")
    assert files.list_sheets(path) == ["nations"]
    return files.read_excel(spark, path, "nations").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def save_and_load(spark, d):
    path = scratch(spark, "any") + ".parquet"
    files.save(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return files.load(spark, path)


def _derby(name: str) -> dict[str, str]:
    return {"url": f"jdbc:derby:memory:{name};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1")
def jdbc_aggregate(spark, d):
    """Written to a database in memory and grouped there (one process: the driver's)."""
    options = _derby("millrace_" + os.urandom(6).hex())
    jdbc.to_sql(t(spark, d, "nation"), options, "nation", batch_size=10)
    pool = jdbc.Pool(spark).register("db", options)
    return pool.table("db", "nation").group_by(["n_regionkey"], F.count(F.lit(1)).alias("n"), where="n_nationkey > 3").selectExpr("n_regionkey", "n")


@query("SELECT DISTINCT n_name, n_nationkey FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey LIMIT 3")
def jdbc_scan(spark, d):
    options = _derby("millrace_" + os.urandom(6).hex())
    jdbc.to_sql(t(spark, d, "nation"), options, "nation")
    return jdbc.Scanner(spark, options, "nation").scan(["n_name", "n_nationkey"], "n_regionkey = 2", ["n_nationkey"], 3, True)


_PLACES = "SELECT c_custkey, ((c_custkey % 170) - 85)::DOUBLE AS lat, ((c_custkey * 7 % 360) - 180)::DOUBLE AS lon FROM customer"


def _places(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(k, ((k % 170) - 85).cast("double").alias("lat"), ((k * 7 % 360) - 180).cast("double").alias("lon"))


@query(_PLACES)
def geoparquet_round_trip(spark, d):
    path = scratch(spark, "geo")
    geo.write_geoparquet(_places(spark, d), path, "lat", "lon")
    return geo.read_geoparquet(spark, path).select("c_custkey", "lat", "lon")


@query(f"SELECT c_custkey, round(6378137.0::DOUBLE * radians(lon), 2) AS x, round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2)), 2) AS y FROM ({_PLACES})")
def web_mercator(spark, d):
    x, y = geo.to_web_mercator("lat", "lon")
    return _places(spark, d).select("c_custkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query(_PLACES)
def web_mercator_and_back(spark, d):
    x, y = geo.to_web_mercator("lat", "lon")
    at = _places(spark, d).select("c_custkey", x.alias("x"), y.alias("y"))
    lat, lon = geo.from_web_mercator("x", "y")
    return at.select("c_custkey", (F.round(lat, 6) + 0.0).alias("lat"), (F.round(lon, 6) + 0.0).alias("lon"))


# selection ------------------------------------------------------------------------


@query("SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation, upper(c_mktsegment) AS segment FROM customer")
def columns_reworked(spark, d):
    """Dropped, renamed, reordered, cast, assigned and replaced columns."""
    f = frame(t(spark, d, "customer"), "c_custkey").drop("c_name", "c_acctbal").rename({"c_custkey": "id", "c_nationkey": "nation"})
    f = f.cast("nation", "bigint").with_column("segment", F.upper("c_mktsegment")).drop("c_mktsegment")
    return selection.reorder(f.df.select("id", "nation", "segment"), ["segment", "id", "nation"])


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def numeric_columns(spark, d):
    return selection.select_dtypes(t(spark, d, "customer"), "number")


@query("SELECT c_name, c_mktsegment FROM customer")
def columns_of_text(spark, d):
    return selection.select_dtypes(t(spark, d, "customer"), "number", exclude=True)


@query("SELECT o_orderkey FROM orders ORDER BY md5('0:' || o_orderkey), o_orderkey LIMIT 77")
def sample_rows(spark, d):
    return selection.sample(t(spark, d, "orders"), 77, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('0:' || o_orderkey), 1, 8))::BIGINT < 0.1 * 4294967296")
def sample_share(spark, d):
    return selection.sample_fraction(t(spark, d, "orders"), 0.1, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders")
def row_batches(spark, d):
    return selection.batches(t(spark, d, "orders"), 1000, ["o_orderkey"]).select("o_orderkey", "batch")


@query("SELECT s_suppkey, least(greatest(s_nationkey, 5), 12)::INT AS s_nationkey, least(greatest(s_acctbal, 5.0), 12.0)::DOUBLE AS s_acctbal FROM (SELECT * FROM supplier)")
def clip_columns(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    clipped = selection.clip_frame(s.drop("s_suppkey").withColumn("k", F.lit(7)), 5, 12)
    assert clipped.columns == ["s_nationkey", "s_acctbal", "k"]
    both = selection.clip_frame(s.withColumnRenamed("s_suppkey", "x").select(F.col("x").cast("string").alias("s_suppkey"), "s_nationkey", "s_acctbal"), 5, 12)
    return both.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_nationkey").cast("int").alias("s_nationkey"), F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("SELECT true AS same, false AS other, count(*) AS n FROM nation")
def frames_equal(spark, d):
    n = t(spark, d, "nation")
    same, other = selection.content_equals(n, n.orderBy(F.desc("n_name"))), selection.content_equals(n, n.where("n_nationkey > 0"))
    return n.agg(F.lit(same).alias("same"), F.lit(other).alias("other"), F.count(F.lit(1)).alias("n"))


@query("""SELECT 'r_regionkey' AS "column", '0' AS c0, '1' AS c1 UNION ALL SELECT 'r_name', max(r_name) FILTER (r_regionkey = 0), max(r_name) FILTER (r_regionkey = 1) FROM region""")
def transposed(spark, d):
    out = selection.transpose(t(spark, d, "region").where("r_regionkey < 2"), ["r_regionkey"])
    a, b, c = out.columns
    return out.select(F.col(a).alias("column"), F.col(b).alias("c0"), F.col(c).alias("c1"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END || '-' || o_orderstatus AS tag, round(o_totalprice * 2 + 1, 4) AS twice FROM orders")
def row_and_column_functions(spark, d):
    f = frame(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    f = f.apply(lambda r: ("odd" if r["o_orderkey"] % 2 else "even") + "-" + r["o_orderstatus"], "tag", "string")
    return f.map("o_totalprice", lambda v: v * 2 + 1, "double", "twice").df.select("o_orderkey", "tag", F.round("twice", 4).alias("twice"))


@query("SELECT sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F')")
def batch_function(spark, d):
    f = frame(t(spark, d, "orders").select("o_orderstatus"), "o_orderstatus").repartition(5)
    out = f.map_partitions(lambda p: p[p["o_orderstatus"] == "F"].assign(n=1)[["n"]].sum().to_frame().T.astype("int64"), "n long")
    return out.df.agg(F.sum("n").alias("n"))


# columns ---------------------------------------------------------------------------


@query("SELECT o_orderkey, round_even(o_totalprice, 0)::INT AS whole, TRY_CAST(o_orderpriority AS INT) AS none, o_totalprice::VARCHAR IS NOT NULL AS shown FROM orders")
def casts(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", fc.cast(o, "o_totalprice", "int").alias("whole"), fc.cast(o, "o_orderpriority", "int").alias("none"), fc.cast(o, "o_totalprice", "string").isNotNull().alias("shown"))


@query("SELECT bool_or(o_totalprice > 400000) AS some, bool_and(o_totalprice > 0) AS every, count(*) FILTER (o_totalprice > 200000) AS n FROM orders")
def boolean_aggregates(spark, d):
    o = t(spark, d, "orders").select((F.col("o_totalprice") > 400000).alias("a"), (F.col("o_totalprice") > 0).alias("b"), (F.col("o_totalprice") > 200000).alias("c"))
    return o.agg(fc.any_true("a").alias("some"), fc.all_true("b").alias("every"), fc.count_true("c").alias("n"))


@query("SELECT o_orderkey, a AND b AS both, a OR b AS either, NOT a AS neither, a <> b AS one FROM (SELECT o_orderkey, o_totalprice > 150000 AS a, o_orderstatus = 'F' AS b FROM orders)")
def masks(spark, d):
    a, b = fc.gt("o_totalprice", 150000), fc.eq("o_orderstatus", "F")
    return t(spark, d, "orders").select("o_orderkey", fc.mask_and(a, b).alias("both"), fc.mask_or(a, b).alias("either"), fc.mask_not(a).alias("neither"), fc.mask_xor(a, b).alias("one"))


@query("""SELECT p_partkey, regexp_matches(p_name, '[aeiou]{2}') AS vowels, repeat(p_brand, 2) AS twice, contains(lower(p_type), lower('BRASS')) AS brass, starts_with(lower(p_type), lower('eco')) AS eco, ends_with(lower(p_type), 'el') AS el,
regexp_replace(p_type, 'st', '*', 'gi') AS starred, nfc_normalize(p_name || chr(101) || chr(769)) AS composed FROM part""")
def more_string_functions(spark, d):
    p = t(spark, d, "part").withColumn("loose", F.concat("p_name", F.lit("é")))
    return p.select("p_partkey", st.match("p_name", "[aeiou]{2}").alias("vowels"), st.repeat("p_brand", 2).alias("twice"), st.contains_ignore_case("p_type", "BRASS").alias("brass"), st.starts_with_ignore_case("p_type", "eco").alias("eco"),
                    st.ends_with_ignore_case("p_type", "EL").alias("el"), st.replace_ignore_case("p_type", "st", "*").alias("starred"), st.normalize_unicode("loose").alias("composed"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS o_orderpriority_0, split_part(o_orderpriority, '-', 2) AS o_orderpriority_1 FROM orders")
def split_text(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return st.split_columns(o, "o_orderpriority", "-", 2).select("o_orderkey", "o_orderpriority_0", "o_orderpriority_1")


@query("SELECT string_agg(r_name, '|' ORDER BY r_regionkey DESC) AS r_name FROM (SELECT -r_regionkey AS r_regionkey, r_name FROM region)")
def joined_text(spark, d):
    return st.cat(t(spark, d, "region"), "r_name", "|", ["r_regionkey"])


@query("""SELECT event_id, (epoch_us(ts) // 1000 % 1000)::INT AS ms, (epoch_us(ts) % 1000)::INT AS us, time_bucket(INTERVAL 15 MINUTE, ts) AS lo, CASE WHEN time_bucket(INTERVAL 15 MINUTE, ts) = ts THEN ts ELSE time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE END AS hi,
time_bucket(INTERVAL 1 HOUR, ts + INTERVAL 30 MINUTE) AS near, ts + INTERVAL 10 DAY AS d10, ts - INTERVAL 5 HOUR AS h5, ts + INTERVAL 1 MONTH AS m1, ts + INTERVAL 2 YEAR AS y2, date_trunc('day', ts)::TIMESTAMP AS day FROM events""")
def datetime_arithmetic(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", dt.millisecond("ts").alias("ms"), dt.microsecond("ts").alias("us"), dt.floor("ts", "15m").alias("lo"), dt.ceil("ts", "15m").alias("hi"), dt.round_half_up("ts", "1h").alias("near"),
                    dt.add_days("ts", 10).alias("d10"), dt.add_hours("ts", -5).alias("h5"), dt.add_months("ts", 1).alias("m1"), dt.add_years("ts", 2).alias("y2"), dt.date("ts").alias("day"))


# groups and statistics ------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def get_group(spark, d):
    return group_by(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderpriority").get_group("1-URGENT").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, round(c_acctbal - median(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS gap FROM customer")
def group_function_values(spark, d):
    g = group_by(t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", order_by=["c_custkey"])
    return g.transform_values("c_acctbal", lambda v: v - np.median(v), "gap").select("c_custkey", F.round("gap", 4).alias("gap"))


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS reach FROM customer GROUP BY 1")
def group_function(spark, d):
    import pandas as pd

    g = group_by(t(spark, d, "customer").select("c_nationkey", "c_acctbal"), "c_nationkey")
    out = g.apply(lambda p: pd.DataFrame({"c_nationkey": [p["c_nationkey"].iloc[0]], "reach": [p["c_acctbal"].max() - p["c_acctbal"].min()]}), "c_nationkey int, reach double")
    return out.withColumn("reach", F.round("reach", 4))


@query("""SELECT 'o_orderstatus' AS "column", count(o_orderstatus) AS count, count(*) - count(o_orderstatus) AS missing, count(DISTINCT o_orderstatus) AS "unique" FROM orders UNION ALL SELECT 'o_custkey', count(o_custkey), count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM orders""")
def describe_all_columns(spark, d):
    return stats.describe_all(t(spark, d, "orders").select("o_orderstatus", "o_custkey")).select("column", "count", "missing", "unique")


@query("""WITH x AS (SELECT s_nationkey::DOUBLE AS a, s_acctbal AS b FROM supplier), p AS (SELECT sign(x.a - y.a) * sign(x.b - y.b) AS s, x.a = y.a AS ta, x.b = y.b AS tb FROM x, x AS y WHERE x.b < y.b OR (x.b = y.b AND x.a < y.a))
SELECT round(sum(s) / sqrt((count(*) FILTER (NOT ta))::DOUBLE * count(*) FILTER (NOT tb)), 6) AS tau FROM p""")
def corr_kendall(spark, d):
    s = t(spark, d, "supplier")
    tau = stats.corr_kendall(s, "s_nationkey", "s_acctbal")
    return s.agg(F.round(F.lit(tau), 6).alias("tau"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS statuses FROM orders")
def profile_figures(spark, d):
    p = stats.profile(t(spark, d, "orders").select("o_orderstatus", "o_totalprice"), exact=True)
    n = p["rows"]
    kinds = next(c for c in p["columns"] if c["name"] == "o_orderstatus") if isinstance(p["columns"], list) else p["columns"]["o_orderstatus"]
    return spark.createDataFrame([(n, kinds["unique"])], "n long, statuses long")


# learning -----------------------------------------------------------------------------


@query("SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part)) / ((SELECT max(p_size) - min(p_size) FROM part))::DOUBLE, 6) AS s FROM part")
def min_max_scale(spark, d):
    return tr.MinMaxScaler("p_size").fit_transform(t(spark, d, "part")).select("p_partkey", F.round("p_size", 6).alias("s"))


_HOLES = "SELECT event_id, CASE WHEN event_id % 7 > 1 THEN value END AS v, CASE WHEN event_id % 5 > 0 THEN event_type END AS k, CASE WHEN event_id % 3 > 0 THEN value END AS w FROM events"


def _holes(spark, d):
    i = F.col("event_id")
    return t(spark, d, "events").select(i, F.when(i % 7 > 1, F.col("value")).alias("v"), F.when(i % 5 > 0, F.col("event_type")).alias("k"), F.when(i % 3 > 0, F.col("value")).alias("w"))


@query(f"WITH x AS ({_HOLES}) SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM x)), 5) AS v, coalesce(k, 'none') AS k, round(coalesce(w, (SELECT median(w) FROM x)), 5) AS w FROM x")
def impute(spark, d):
    x = _holes(spark, d)
    x = tr.Imputer("v", strategy="mean").fit_transform(x)
    x = tr.Imputer("k", strategy="constant", value="none").fit_transform(x)
    x = tr.Imputer("w", strategy="median").fit_transform(x)
    return x.select("event_id", F.round("v", 5).alias("v"), "k", F.round("w", 5).alias("w"))


@query(f"WITH x AS ({_HOLES}), m AS (SELECT k FROM x WHERE k IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 1) SELECT event_id, coalesce(k, (SELECT k FROM m)) AS k FROM x")
def impute_mode(spark, d):
    return tr.Imputer("k", strategy="mode").fit_transform(_holes(spark, d)).select("event_id", "k")


@query("""WITH z AS (SELECT p_partkey, (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part) AS z FROM part)
SELECT p_partkey, round((z - (SELECT min(z) FROM z)) / (SELECT max(z) - min(z) FROM z), 6) AS s FROM z""")
def stored_pipeline(spark, d):
    """Fitted, written as text, read again and applied."""
    p = t(spark, d, "part")
    fitted = tr.FeaturePipeline(tr.StandardScaler("p_size"), tr.MinMaxScaler("p_size")).fit(p)
    return tr.FeaturePipeline.from_json(fitted.to_json()).transform(p).select("p_partkey", F.round("p_size", 6).alias("s"))


@query("SELECT p_partkey, list_position(['Brand#11', 'Brand#12', 'Brand#13'], p_brand) - 1 AS code FROM (SELECT p_partkey, p_brand FROM part)")
def ordinal_encode(spark, d):
    out = tr.OrdinalEncoder("p_brand", orders={"p_brand": ["Brand#11", "Brand#12", "Brand#13"]}).transform(t(spark, d, "part"))
    return out.select("p_partkey", F.col("p_brand").cast("int").alias("code"))


@query("""WITH x AS (SELECT p_partkey, p_name, regexp_split_to_array(lower(p_name), '[^a-z0-9]+') AS w FROM part), u AS (SELECT unnest(w) AS g FROM x), f AS (SELECT g FROM u WHERE g <> '' GROUP BY 1 ORDER BY count(*) DESC, g LIMIT 1)
SELECT p_partkey, len(list_filter(w, lambda z: z = g))::INT AS n FROM x, f""")
def count_vector(spark, d):
    out = tr.TextVectorizer("p_name", max_features=1).fit_transform(t(spark, d, "part").select("p_partkey", "p_name"))
    made = next(c for c in out.columns if c not in ("p_partkey", "p_name"))
    return out.select("p_partkey", F.col(f"`{made}`").cast("int").alias("n"))


@query("SELECT o_orderkey, CASE WHEN r < round(n * 0.2) THEN 'test' WHEN r < round(n * 0.2) + round(n * 0.1) THEN 'val' ELSE 'train' END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)")
def three_way_split(spark, d):
    out = None
    for name, df in zip(("train", "val", "test"), ev.train_val_test_split(t(spark, d, "orders"), ["o_orderkey"]), strict=True):
        part = df.select("o_orderkey", F.lit(name).alias("part"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1) % 4)::INT AS fold FROM orders")
def stratified_folds(spark, d):
    return ev.k_fold(t(spark, d, "orders"), ["o_orderkey"], 4, stratify="o_orderstatus").select("o_orderkey", "fold")


@query("SELECT f::INT AS fold, count(*) FILTER (r < n - (3 - f) * (n // 4)) AS train, count(*) FILTER (r >= n - (3 - f) * (n // 4) AND r < n - (2 - f) * (n // 4)) AS test FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM events), range(3) AS k(f) GROUP BY f")
def time_folds(spark, d):
    out = None
    for i, (a, b) in enumerate(ev.time_series_split(t(spark, d, "events"), ["ts", "event_id"], 3)):
        part = a.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(F.lit(0), F.lit(1))).agg(F.lit(i).alias("fold"), F.sum("a").alias("train"), F.sum("b").alias("test"))
        out = part if out is None else out.unionAll(part)
    return out


@query("""WITH x AS (SELECT o_orderstatus AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS p FROM orders), c AS (SELECT DISTINCT y AS class FROM x)
SELECT class, round(count(*) FILTER (y = class AND p = class) / NULLIF(count(*) FILTER (p = class), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (y = class AND p = class) / (count(*) FILTER (y = class))::DOUBLE, 6) AS recall, count(*) FILTER (y = class) AS support FROM c, x GROUP BY class""")
def multiclass_metrics(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderstatus").alias("y"), F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("p"))
    m = ev.multiclass_metrics(o, "y", "p")
    return m.select("class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support")


@query("""WITH x AS (SELECT (o_totalprice > 150000) AS y, o_custkey AS s FROM orders), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM x)
SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)), 6) AS auc FROM r""")
def area_under_curve(spark, d):
    o = t(spark, d, "orders").select((F.col("o_totalprice") > 150000).cast("int").alias("y"), "o_custkey")
    return o.agg(F.round(F.lit(ev.roc_auc(o, "y", "o_custkey")), 6).alias("auc"))


@query("""WITH x AS (SELECT s_nationkey % 3 AS c, s_acctbal AS a, s_nationkey::DOUBLE AS b FROM supplier), m AS (SELECT c, count(*) AS n, avg(a) AS ma, avg(b) AS mb FROM x GROUP BY 1),
s AS (SELECT c, avg(sqrt(pow(a - ma, 2) + pow(b - mb, 2))) AS s, sum(pow(a - ma, 2) + pow(b - mb, 2)) AS w FROM x JOIN m USING (c) GROUP BY 1), k AS (SELECT * FROM m JOIN s USING (c)),
d AS (SELECT max((p.s + q.s) / sqrt(pow(p.ma - q.ma, 2) + pow(p.mb - q.mb, 2))) AS r FROM k p JOIN k q ON p.c <> q.c GROUP BY p.c), g AS (SELECT avg(a) AS ga, avg(b) AS gb, count(*) AS n FROM x)
SELECT round((SELECT avg(r) FROM d), 5) AS davies_bouldin, round(sum(k.n * (pow(ma - ga, 2) + pow(mb - gb, 2))) / (count(*) - 1) / (sum(w) / (any_value(g.n) - count(*))), 5) AS calinski_harabasz FROM k, g""")
def cluster_scores(spark, d):
    s = t(spark, d, "supplier").select((F.col("s_nationkey") % 3).alias("c"), F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    m = ev.cluster_metrics(s, "c", ["a", "b"])
    return spark.createDataFrame([(round(m["davies_bouldin"], 5), round(m["calinski_harabasz"], 5))], "davies_bouldin double, calinski_harabasz double")


@query("SELECT p_partkey, round(regr_intercept(p_retailprice, p_size) OVER () + regr_slope(p_retailprice, p_size) OVER () * p_size, 2) AS prediction FROM part")
def linear_regression(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    out = md.Model("linear_regression", ["p_size"], "p_retailprice").fit(p).predict(p)
    return out.select("p_partkey", F.round("prediction", 2).alias("prediction"))


@query("""WITH x AS (SELECT s_suppkey, s_acctbal AS a, (s_nationkey % 2)::DOUBLE AS y FROM supplier), n AS (SELECT q.s_suppkey, t.y, row_number() OVER (PARTITION BY q.s_suppkey ORDER BY abs(t.a - q.a), t.s_suppkey) AS r FROM x q, x t)
SELECT s_suppkey, round(avg(y), 6) AS prediction FROM n WHERE r <= 3 GROUP BY 1""")
def nearest_neighbours_mean(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") % 2).cast("double").alias("y")).orderBy("s_suppkey")
    return md.knn(s, s, ["s_acctbal"], "y", ["s_suppkey"], k=3, classify=False).withColumn("prediction", F.round("prediction", 6))


@query("SELECT id, CASE WHEN a + b + c >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM (SELECT o_orderkey AS id, (o_orderkey % 2)::INT AS a, (o_orderkey % 3 = 0)::INT AS b, (o_totalprice > 100000)::INT AS c FROM orders)")
def vote(spark, d):
    o = t(spark, d, "orders")
    k = F.col("o_orderkey").alias("id")
    votes = [o.select(k, v.cast("double").alias("prediction")) for v in (F.col("o_orderkey") % 2, (F.col("o_orderkey") % 3 == 0).cast("int"), (F.col("o_totalprice") > 100000).cast("int"))]
    return md.voting(votes, ["id"]).select("id", F.col("prediction").cast("double").alias("prediction"))


# text -------------------------------------------------------------------------------


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_type, '\\s+'), lambda w: lower(w) NOT IN ('brass', 'steel', 'the')), ' ') AS kept FROM part")
def custom_stop_words(spark, d):
    return t(spark, d, "part").select("p_partkey", text.remove_stop_words("p_type", "en", ["BRASS", "steel"]).alias("kept"))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 11 / 12.0::DOUBLE END, 6) AS s FROM customer")
def jaro_winkler(spark, d):
    """One letter of eight replaced at the front: seven of eight match, no common prefix."""
    k = F.col("c_custkey") % 5
    a = F.concat(F.when(k == 0, "a").otherwise(k.cast("string")), F.lit("bcdefgh"))
    return t(spark, d, "customer").select("c_custkey", F.round(text.jaro_winkler(a, F.lit("abcdefgh")), 6).alias("s"))


# streams -------------------------------------------------------------------------------

_WINDOWED = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, round(sum(value), 3) AS total, count(value) AS n, max(value) AS hi FROM events GROUP BY 1, 2, 3"


@query(_WINDOWED)
def stream_to_windows(spark, d):
    """The table replayed as a stream of files, in several triggers, with a watermark that no row is later than."""
    path = scratch(spark, "stream")
    t(spark, d, "events").repartition(3).write.parquet(path)
    events = file_stream(spark, path, spark.read.parquet(path).schema, max_files=1)
    windows = event_windows(events, "ts", ["event_type"]).tumbling("1 day").agg("value", "sum", "total").agg("value", "count", "n").agg("value", "max", "hi").watermark("3650 days")
    name = "millrace_" + os.urandom(6).hex()
    return windows.collect_stream(scratch(spark, "state"), name).withColumn("total", F.round("total", 3))


@query("SELECT TIMESTAMP '2024-01-01 00:00:00' AS window_start, 2::BIGINT AS n UNION ALL SELECT TIMESTAMP '2024-01-01 00:10:00', 1")
def stream_drops_late_rows(spark, d):
    """Files one after the other; the row of the last that is two hours late is left out, the open windows are not emitted."""
    path, out = scratch(spark, "late"), scratch(spark, "late-out")
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    batches = [[(at(1), 1.0), (at(2), 2.0)], [(at(11), 3.0), (at(180), 4.0)], [(at(185), 7.0)], [(at(3), 5.0), (at(190), 6.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp_ntz, value double").coalesce(1).write.mode("append").option("compression", "none").parquet(f"{path}/{i}")
    events = file_stream(spark, path + "/*", "ts timestamp_ntz, value double", max_files=1, latestFirst="false")
    windows = event_windows(events, "ts").tumbling("10 minutes").agg("value", "count", "n").watermark("5 minutes")
    run = windows.start(lambda df, _: df.write.mode("append").parquet(out), scratch(spark, "late-state"), available_now=True)
    run.awaitTermination()
    return spark.read.parquet(out).select("window_start", "n")
