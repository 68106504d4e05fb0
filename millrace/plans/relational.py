"""Projection, filters, joins, aggregation and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import frame
from ..functions import columns as fc
from ..functions import datetimes as dt
from ..functions import parser
from ..functions import strings as st
from ..operators import joins, reshape, selection
from ..operators.groupby import group_by
from .registry import query, t


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    li = t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE (o_totalprice > 150000 AND o_orderstatus = 'F') OR o_orderpriority = '1-URGENT'")
def filter_query_string(spark, d):
    o = t(spark, d, "orders")
    return o.where(parser.query_condition(o, "o_totalprice > 150000 and o_orderstatus = 'F' or o_orderpriority = '1-URGENT'")).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_quantity * 2 > 60 AND NOT (l_discount = 0)")
def eval_computed(spark, d):
    li = frame(t(spark, d, "lineitem")).eval("l_quantity * 2 > 60 and not (l_discount == 0)").eval("revenue = l_extendedprice * (1 - l_discount)").df
    return li.select("l_orderkey", "l_linenumber", F.round("revenue", 4).alias("revenue"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN NULL ELSE round(1000 / o_totalprice, 8) END AS inverse, round(-o_totalprice / NULLIF(o_custkey - o_custkey, 0), 4) AS by_zero FROM orders")
def divide_by_zero(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", F.round(fc.safe_divide(F.lit(1000), "o_totalprice"), 8).alias("inverse"), F.round(fc.safe_divide(fc.negate("o_totalprice"), F.col("o_custkey") - F.col("o_custkey")), 4).alias("by_zero"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, 'pending') AS status, o_orderstatus || '-' || o_orderpriority AS joined,
TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) AS level, round_even(o_totalprice / 1000, 0) AS thousands FROM orders""")
def expressions(spark, d):
    o = t(spark, d, "orders")
    return o.select(
        "o_orderkey", F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low").alias("band"),
        F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("pending")).alias("status"),
        F.concat("o_orderstatus", F.lit("-"), "o_orderpriority").alias("joined"), F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"),
        fc.rounded(F.col("o_totalprice") / 1000).alias("thousands"))


@query("SELECT o_orderkey, least(greatest(o_totalprice, 50000), 200000) AS clipped, CASE WHEN o_totalprice BETWEEN 60000 AND 90000 THEN true ELSE false END AS mid, o_orderstatus IN ('F', 'O') AS done, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 6) AS lg, abs(-o_totalprice) AS mag FROM orders")
def column_math(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", fc.clip("o_totalprice", 50000.0, 200000.0).alias("clipped"), fc.between("o_totalprice", 60000, 90000).alias("mid"), fc.is_in("o_orderstatus", ["F", "O"]).alias("done"), F.round(fc.sqrt("o_totalprice"), 6).alias("root"), F.round(fc.log("o_totalprice"), 6).alias("lg"), fc.absolute(fc.negate("o_totalprice")).alias("mag"))


@query("""WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, (max(l_quantity) - min(l_quantity)) / 7 AS w FROM lineitem)
SELECT b, count(*) AS n FROM (SELECT CASE WHEN l_quantity <= lo + w THEN 0 WHEN l_quantity <= lo + 2 * w THEN 1 WHEN l_quantity <= lo + 3 * w THEN 2 WHEN l_quantity <= lo + 4 * w THEN 3 WHEN l_quantity <= lo + 5 * w THEN 4 WHEN l_quantity <= lo + 6 * w THEN 5 ELSE 6 END::VARCHAR AS b FROM lineitem, e) GROUP BY b""")
def cut_bins(spark, d):
    li = fc.cut(t(spark, d, "lineitem").select("l_quantity"), "l_quantity", 7, [str(i) for i in range(7)])
    return li.groupBy(F.col("l_quantity_bin").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)
SELECT CASE WHEN o_totalprice <= q[1] THEN 'a' WHEN o_totalprice <= q[2] THEN 'b' WHEN o_totalprice <= q[3] THEN 'c' ELSE 'd' END AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def qcut_bins(spark, d):
    o = fc.qcut(t(spark, d, "orders"), "o_totalprice", 4, list("abcd"))
    return o.groupBy(F.col("o_totalprice_bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / ((SELECT max(o_totalprice) FROM orders) - (SELECT min(o_totalprice) FROM orders)), 6) AS scaled, o_orderkey FROM orders")
def normalize_min_max(spark, d):
    return fc.normalize_min_max(t(spark, d, "orders"), "o_totalprice", "scaled").select(F.round("scaled", 6).alias("scaled"), "o_orderkey")


@query("""SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name) AS len, contains(c_name, '00') AS has, instr(c_name, '#') - 1 AS pos,
replace(c_name, 'Customer', 'Cust') AS rep, lpad(c_custkey::VARCHAR, 8, '0') AS z, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS cap,
(length(c_name) - length(replace(c_name, '0', '')))::INT AS zeros, CASE WHEN regexp_matches(c_name, '#(0*)([1-9][0-9]*)') THEN regexp_extract(c_name, '#(0*)([1-9][0-9]*)', 2) END AS num,
substr(c_name, 3, 4) AS sl, repeat('x', 3) AS r, split_part(c_name, '#', 2) AS tail FROM customer""")
def string_functions(spark, d):
    c = t(spark, d, "customer")
    return c.select(
        "c_custkey", st.upper("c_name").alias("up"), st.lower("c_mktsegment").alias("low"), st.length("c_name").alias("len"), st.contains("c_name", "00").alias("has"), st.find("c_name", "#").alias("pos"),
        st.replace("c_name", "Customer", "Cust").alias("rep"), st.zfill(F.col("c_custkey").cast("string"), 8).alias("z"), st.capitalize("c_mktsegment").alias("cap"), st.count_text("c_name", "0").alias("zeros"),
        st.extract("c_name", "#(0*)([1-9][0-9]*)", 2).alias("num"), st.slice_text("c_name", 2, 4).alias("sl"), st.repeat(F.lit("x"), 3).alias("r"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, dayofweek(o_orderdate)::INT AS dow, dayofyear(o_orderdate)::INT AS doy, quarter(o_orderdate)::INT AS q,
o_orderdate::DATE = last_day(o_orderdate) AS month_end, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap,
time_bucket(INTERVAL 7 DAY, o_orderdate) AS week, o_orderdate + INTERVAL 5 DAY AS later FROM orders""")
def datetime_functions(spark, d):
    o = t(spark, d, "orders")
    c = "o_orderdate"
    return o.select("o_orderkey", dt.year(c).alias("y"), dt.month(c).alias("m"), dt.day(c).alias("d"), dt.day_of_week(c).alias("dow"), dt.day_of_year(c).alias("doy"), dt.quarter(c).alias("q"), dt.is_month_end(c).alias("month_end"), dt.is_leap_year(c).alias("leap"), dt.floor(c, "1w").alias("week"), dt.add_days(c, 5).alias("later"))


# selection -------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_topk(spark, d):
    return selection.nlargest(t(spark, d, "orders"), 25, "o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def dedup_keep_first(spark, d):
    return selection.drop_duplicates(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1 AS dup FROM orders")
def duplicated_flag(spark, d):
    return selection.duplicated(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "dup").select("o_orderkey", "dup")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 100")
def slice_rows(spark, d):
    return frame(t(spark, d, "orders"), "o_orderdate", "o_orderkey").slice(100, 40).df.select("o_orderkey", "o_totalprice")


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12)")
def tail_rows(spark, d):
    return frame(t(spark, d, "orders"), "o_orderdate", "o_orderkey").tail(12).df.select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def cross_section(spark, d):
    return selection.cross_section(t(spark, d, "customer"), "c_nationkey", 3).select("c_custkey", "c_name")


@query("SELECT p_partkey, CASE WHEN p_size >= p_retailprice / 40 THEN 'p_size' ELSE 'p_price' END AS widest FROM part")
def row_argmax(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 40).alias("p_price"))
    return selection.row_extreme_name(p.withColumn("p_partkey", F.col("p_partkey").cast("string")), True, "widest").select(F.col("p_partkey").cast("long").alias("p_partkey"), "widest")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS v FROM supplier) a FULL JOIN (SELECT s_suppkey + 5 AS k, s_acctbal * 2 AS v FROM supplier) b ON a.k = b.k")
def combine_first(spark, d):
    s = t(spark, d, "supplier")
    a = s.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("v"))
    b = s.select((F.col("s_suppkey") + 5).alias("k"), (F.col("s_acctbal") * 2).alias("v"))
    return selection.combine_first(a, b, ["k"])


@query("SELECT s_suppkey, 'v' AS \"column\", round(s_acctbal, 2)::DECIMAL(18,2)::VARCHAR AS self, round(CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END, 2)::DECIMAL(18,2)::VARCHAR AS other FROM supplier WHERE s_suppkey % 4 = 0")
def compare_frames(spark, d):
    s = t(spark, d, "supplier")
    money = lambda c: F.round(c, 2).cast("decimal(18,2)").alias("v")
    a = s.select("s_suppkey", money(F.col("s_acctbal")))
    b = s.select("s_suppkey", money(F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))))
    return selection.compare(a, b, ["s_suppkey"])


# joins -----------------------------------------------------------------------


@query("SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return joins.join(t(spark, d, "orders"), t(spark, d, "customer"), left_on=["o_custkey"], right_on=["c_custkey"], null_equals=False).select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "c_name", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_left(spark, d):
    return joins.join(t(spark, d, "customer"), t(spark, d, "orders"), left_on=["c_custkey"], right_on=["o_custkey"], how="left", null_equals=False).select("c_custkey", "o_orderkey")


@query("SELECT p_partkey AS k, s_name, p_name FROM supplier RIGHT JOIN part ON s_suppkey = p_partkey")
def join_right(spark, d):
    return joins.join(t(spark, d, "supplier"), t(spark, d, "part"), left_on=["s_suppkey"], right_on=["p_partkey"], how="right", null_equals=False).select(F.col("s_suppkey").alias("k"), "s_name", "p_name")


@query("SELECT coalesce(a.k, b.k) AS k, a.v AS v_x, b.v AS v_y FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) a FULL JOIN (SELECT s_suppkey * 2 - 10 AS k, s_acctbal AS v FROM supplier) b ON a.k = b.k")
def join_outer(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return joins.join(a, t(spark, d, "supplier").select((F.col("s_suppkey") * 2 - 10).alias("k"), F.col("s_acctbal").alias("v")), "k", "outer")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, d):
    return joins.join(t(spark, d, "customer"), t(spark, d, "orders"), left_on=["c_custkey"], right_on=["o_custkey"], how="anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(spark, d):
    return joins.join(t(spark, d, "customer"), t(spark, d, "orders"), left_on=["c_custkey"], right_on=["o_custkey"], how="semi").select("c_custkey", "c_name")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    return joins.join(t(spark, d, "region"), t(spark, d, "nation"), how="cross").select("r_name", "n_name")


@query("SELECT coalesce(a.k, -1) AS k, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer) a JOIN (SELECT CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_nationkey END AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY 1")
def join_null_keys(spark, d):
    a = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("k"))
    b = t(spark, d, "nation").select(F.when(F.col("n_nationkey") % 7 != 0, F.col("n_nationkey")).alias("k"))
    return joins.join(a, b, "k").groupBy(F.coalesce("k", F.lit(-1)).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def join_star(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_extendedprice")
    wide = joins.join_many(li, [("p_partkey", t(spark, d, "part")), ("s_suppkey", t(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")), ("n_nationkey", t(spark, d, "nation"))])
    return wide.where("p_brand IS NOT NULL AND n_name IS NOT NULL").groupBy("p_brand", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


_ASOF = """WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'), r0 AS (SELECT user_id, ts, value AS price, event_id AS rid FROM events WHERE event_type = 'view'),
r AS (SELECT user_id, ts, arg_min(price, rid) AS price FROM r0 GROUP BY user_id, ts)
SELECT event_id, round(value, 4) AS value, round(price, 4) AS price FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts {op} r.ts"""


def _sides(spark, d):
    e = t(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("price"), F.col("event_id").alias("rid"))
    return left, right


@query(_ASOF.format(op=">="))
def asof_backward(spark, d):
    left, right = _sides(spark, d)
    return joins.asof_join(left, right, "ts", "backward", ["user_id"], right_order="rid").select("event_id", F.round("value", 4).alias("value"), F.round("price", 4).alias("price"))


@query(_ASOF.format(op="<="))
def asof_forward(spark, d):
    left, right = _sides(spark, d)
    return joins.asof_join(left, right, "ts", "forward", ["user_id"], right_order="rid").select("event_id", F.round("value", 4).alias("value"), F.round("price", 4).alias("price"))


@query("""WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT ts, min(event_id) AS rid FROM events WHERE event_type = 'view' GROUP BY ts),
b AS (SELECT l.event_id, l.ts, r.ts AS bts, r.rid AS brid FROM l ASOF LEFT JOIN r ON l.ts >= r.ts), f AS (SELECT l.event_id, r.ts AS fts, r.rid AS frid FROM l ASOF LEFT JOIN r ON l.ts <= r.ts)
SELECT b.event_id, CASE WHEN fts IS NULL OR (bts IS NOT NULL AND epoch_us(ts) - epoch_us(bts) <= epoch_us(fts) - epoch_us(ts)) THEN brid ELSE frid END AS rid FROM b JOIN f USING (event_id)""")
def asof_nearest(spark, d):
    left, right = _sides(spark, d)
    return joins.asof_join(left.select("event_id", "ts"), right.select("ts", "rid"), "ts", "nearest", right_order="rid").select("event_id", "rid")


@query("SELECT c_custkey AS k, c_acctbal AS bal, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def concat_rows(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return joins.concat_rows(a, t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), "s_name"))


@query("SELECT n_name, s_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a FULL JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) b USING (i)")
def concat_columns(spark, d):
    return joins.concat_columns(t(spark, d, "nation").select("n_nationkey", "n_name"), t(spark, d, "supplier").select("s_suppkey", "s_name"), ["n_nationkey"], ["s_suppkey"]).select("n_name", "s_name")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return joins.union_distinct(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


# aggregation -------------------------------------------------------------------


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1")
def agg_named(spark, d):
    out = group_by(t(spark, d, "orders"), "o_custkey").agg(total=("o_totalprice", "sum"), mean=("o_totalprice", "mean"), lo=("o_totalprice", "min"), hi=("o_totalprice", "max"), n=("o_totalprice", "count"), kinds=("o_orderstatus", "nunique"))
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS med, round(stddev_samp(o_totalprice), 4) AS sd, round(var_samp(o_totalprice), 2) AS var FROM orders GROUP BY 1")
def agg_median_std(spark, d):
    out = group_by(t(spark, d, "orders"), "o_orderpriority").agg(med=("o_totalprice", "median"), sd=("o_totalprice", "std"), var=("o_totalprice", "var"))
    return out.withColumns({"med": F.round("med", 4), "sd": F.round("sd", 4), "var": F.round("var", 2)})


@query("SELECT o_custkey, arg_min(o_totalprice, row(o_orderdate, o_orderkey)) AS first_price, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS last_price FROM orders GROUP BY 1")
def agg_first_last(spark, d):
    return group_by(t(spark, d, "orders"), "o_custkey", order_by=["o_orderdate", "o_orderkey"]).agg(first_price=("o_totalprice", "first"), last_price=("o_totalprice", "last"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 2")
def group_nth(spark, d):
    return group_by(t(spark, d, "orders"), "o_custkey", order_by=["o_orderdate", "o_orderkey"]).nth(1).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS cc FROM orders")
def group_cumcount(spark, d):
    return group_by(t(spark, d, "orders"), "o_custkey", order_by=["o_orderdate", "o_orderkey"]).cumcount("cc").select("o_orderkey", F.col("cc").cast("long").alias("cc"))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY first_key) - 1 AS grp FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_key FROM orders)")
def group_ngroup(spark, d):
    return group_by(t(spark, d, "orders"), "o_custkey", order_by=["o_orderkey"]).ngroup("grp").select("o_orderkey", "grp")


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS mean_price FROM orders")
def group_transform(spark, d):
    return group_by(t(spark, d, "orders"), "o_custkey").transform("o_totalprice", "mean", "mean_price").select("o_orderkey", F.round("mean_price", 6).alias("mean_price"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)")
def group_filter(spark, d):
    return group_by(t(spark, d, "orders"), "o_custkey").filter(F.count(F.lit(1)) > 12).select("o_orderkey")


@query("SELECT coalesce(k, 'none') AS k, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS k FROM orders) WHERE k IS NOT NULL GROUP BY 1")
def group_null_excluded(spark, d):
    o = t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("k"))
    return group_by(o, "k", null_groups=False).size().select(F.coalesce("k", F.lit("none")).alias("k"), F.col("size").alias("n"))


@query("SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS diff, round((o_totalprice - lag(o_totalprice) OVER w) / NULLIF(lag(o_totalprice) OVER w, 0), 8) AS pct FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def group_diff_pct(spark, d):
    g = group_by(t(spark, d, "orders"), "o_custkey", order_by=["o_orderdate", "o_orderkey"])
    g2 = group_by(g.diff("o_totalprice", 1, "diff"), "o_custkey", order_by=["o_orderdate", "o_orderkey"])
    return g2.pct_change("o_totalprice", 1, "pct").select("o_orderkey", F.round("diff", 4).alias("diff"), F.round("pct", 8).alias("pct"))


# reshape -----------------------------------------------------------------------


@query("SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1")
def pivot_table(spark, d):
    out = reshape.pivot_table(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "sum", ["F", "O", "P"])
    return out.withColumns({c: F.round(c, 2) for c in "FOP"})


@query("SELECT o_custkey, max_by(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS F, max_by(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1")
def pivot_last(spark, d):
    return reshape.pivot(t(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", ["o_orderkey"], ["F", "O"])


@query("SELECT p_partkey, variable, value FROM (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part) UNPIVOT INCLUDE NULLS (value FOR variable IN (p_size, p_retailprice))")
def melt(spark, d):
    return reshape.melt(t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"])


@query("SELECT o_orderkey, o_orderstatus = 'F' AS st_F, o_orderstatus = 'O' AS st_O, o_orderstatus = 'P' AS st_P FROM orders")
def dummies(spark, d):
    return reshape.get_dummies(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "st", ["F", "O", "P"])


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def crosstab(spark, d):
    return reshape.crosstab(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT p_partkey, trim(part) AS p_type FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS part FROM part)")
def explode_text(spark, d):
    return reshape.explode(t(spark, d, "part").select("p_partkey", "p_type"), "p_type", " ")
