"""Describe, correlation, moments, validation, scalers, encoders, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ml import evaluation as ev
from ..ml import transformers as tr
from ..operators import schema, stats
from ..operators.quantiles import exact_quantiles
from ..semantics import kurtosis, skewness
from .registry import query, t


@query("""WITH s AS (SELECT count(l_quantity)::DOUBLE AS c, avg(l_quantity) AS m, stddev_samp(l_quantity) AS d, min(l_quantity) AS lo, quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS e, max(l_quantity) AS hi FROM lineitem)
SELECT statistic, round(v, 4) AS l_quantity FROM s, LATERAL (VALUES ('count', c), ('mean', m), ('std', d), ('min', lo), ('25%', a), ('50%', b), ('75%', e), ('max', hi)) AS x(statistic, v)""")
def describe_frame(spark, d):
    return stats.describe(t(spark, d, "lineitem").select("l_quantity")).withColumn("l_quantity", F.round("l_quantity", 4))


@query("SELECT round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders")
def quantiles(spark, d):
    o = t(spark, d, "orders")
    q = exact_quantiles(o, {"p": F.col("o_totalprice")}, [0.1, 0.5, 0.99])["p"]
    return spark.createDataFrame([tuple(q)], "p10 double, p50 double, p99 double").select(*[F.round(c, 4).alias(c) for c in ("p10", "p50", "p99")])


@query("""SELECT 'l_quantity' AS "column", round(1.0, 6) AS l_quantity, round(corr(l_quantity, l_extendedprice), 6) AS l_extendedprice, round(corr(l_quantity, l_discount), 6) AS l_discount FROM lineitem
UNION ALL SELECT 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6), 1.0, round(corr(l_extendedprice, l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_discount', round(corr(l_quantity, l_discount), 6), round(corr(l_extendedprice, l_discount), 6), 1.0 FROM lineitem""")
def corr_matrix(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return stats.corr(t(spark, d, "lineitem"), cols).withColumns({c: F.round(c, 6) for c in cols})


@query("""SELECT 'p_size' AS "column", round(var_samp(p_size), 3) AS p_size, round(covar_samp(p_size, p_retailprice), 3) AS p_retailprice FROM part
UNION ALL SELECT 'p_retailprice', round(covar_samp(p_size, p_retailprice), 3), round(var_samp(p_retailprice), 3) FROM part""")
def cov_matrix(spark, d):
    return stats.cov(t(spark, d, "part"), ["p_size", "p_retailprice"]).withColumns({c: F.round(c, 3) for c in ("p_size", "p_retailprice")})


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT round(corr(a, b), 6) AS rho FROM r""")
def corr_spearman(spark, d):
    out = stats.corr_spearman(t(spark, d, "part"), ["p_size", "p_retailprice"])
    return out.where(F.col("column") == "p_size").select(F.round("p_retailprice", 6).alias("rho"))


@query("SELECT l_returnflag, round(skewness(l_extendedprice), 5) AS sk, round(kurtosis(l_extendedprice), 5) AS ku, round(stddev_samp(l_extendedprice) / sqrt(count(*)), 5) AS sem FROM lineitem GROUP BY 1")
def skew_kurt(spark, d):
    c = F.col("l_extendedprice")
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(skewness(c), 5).alias("sk"), F.round(kurtosis(c), 5).alias("ku"), F.round(F.stddev_samp(c) / F.sqrt(F.count(c)), 5).alias("sem"))


@query("SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1")
def value_counts(spark, d):
    return stats.value_counts(t(spark, d, "customer"), "c_mktsegment")


@query("SELECT count(DISTINCT c_nationkey) AS c_nationkey, count(DISTINCT c_mktsegment) AS c_mktsegment FROM customer")
def nunique(spark, d):
    return stats.nunique(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT 'price' AS rule, count(*) FILTER (NOT o_totalprice > 1000) AS violations FROM orders UNION ALL SELECT 'status', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders UNION ALL SELECT 'priority', count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]')) FROM orders")
def schema_rules(spark, d):
    return schema.rule_counts(t(spark, d, "orders"), {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O"), "priority": F.col("o_orderpriority").rlike("^[1-3]")})


@query("""SELECT 'o_custkey' AS "column", 'bigint' AS dtype, count(o_custkey) AS present, count(*) - count(o_custkey) AS missing FROM orders UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus), count(*) - count(o_orderstatus) FROM orders""")
def info(spark, d):
    return stats.info(t(spark, d, "orders").select("o_custkey", "o_orderstatus"))


@query("SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS z FROM part")
def standard_scale(spark, d):
    return tr.StandardScaler("p_retailprice").fit_transform(t(spark, d, "part")).select("p_partkey", F.round("p_retailprice", 6).alias("z"))


@query("SELECT p_partkey, round((p_retailprice - (SELECT median(p_retailprice) FROM part)) / (SELECT quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) FROM part), 6) AS r FROM part")
def robust_scale(spark, d):
    return tr.RobustScaler("p_retailprice").fit_transform(t(spark, d, "part")).select("p_partkey", F.round("p_retailprice", 6).alias("r"))


@query("WITH g AS (SELECT avg(o_totalprice) AS a FROM orders), k AS (SELECT o_orderpriority AS p, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT o_orderkey, round((n * m + 10 * a) / (n + 10), 4) AS e FROM orders JOIN k ON p = o_orderpriority, g")
def target_encode(spark, d):
    out = tr.TargetEncoder("o_orderpriority", target="o_totalprice").fit_transform(t(spark, d, "orders"))
    return out.select("o_orderkey", F.round("o_orderpriority", 4).alias("e"))


@query("WITH k AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS c FROM customer GROUP BY 1) SELECT c_custkey, c::INT AS code FROM customer JOIN k ON s = c_mktsegment")
def label_encode(spark, d):
    out = tr.LabelEncoder("c_mktsegment", order_by=["c_custkey"]).fit_transform(t(spark, d, "customer"))
    return out.select("c_custkey", F.col("c_mktsegment").alias("code"))


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS b, (c_mktsegment = 'MACHINERY')::INT AS m FROM customer")
def one_hot(spark, d):
    out = tr.OneHotEncoder("c_mktsegment").fit_transform(t(spark, d, "customer"))
    pick = lambda n: F.col(f"c_mktsegment_{n}") if f"c_mktsegment_{n}" in out.columns else F.lit(0)
    return out.select("c_custkey", pick("BUILDING").alias("b"), pick("MACHINERY").alias("m"))


@query("WITH e AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) SELECT p_partkey, ((p_size >= lo + (hi - lo) * 1 / 4.0::DOUBLE)::INT + (p_size >= lo + (hi - lo) * 2 / 4.0::DOUBLE)::INT + (p_size >= lo + (hi - lo) * 3 / 4.0::DOUBLE)::INT)::INT AS bin FROM part, e")
def discretize(spark, d):
    return tr.Discretizer("p_size", bins=4).fit_transform(t(spark, d, "part")).select("p_partkey", F.col("p_size").alias("bin"))


@query("SELECT p_partkey, power(p_size, 2)::DOUBLE AS sq, round(p_size * p_retailprice, 4) AS prod FROM part")
def polynomial(spark, d):
    out = tr.PolynomialFeatures("p_size", "p_retailprice", degree=2).transform(t(spark, d, "part"))
    return out.select("p_partkey", F.col("`p_size^2`").alias("sq"), F.round("`p_size*p_retailprice`", 4).alias("prod"))


_PRED = "(SELECT o_orderkey, (o_totalprice > 150000)::INT AS y, (o_orderkey % 3 = 0)::INT AS p FROM orders)"


def _predicted(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") > 150000).cast("int").alias("y"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("p"))


@query(f"SELECT round(avg((y = p)::INT), 6) AS accuracy, round(sum(y * p) / NULLIF(sum(p), 0), 6) AS precision, round(sum(y * p) / NULLIF(sum(y), 0), 6) AS recall, sum(y * p)::BIGINT AS tp FROM {_PRED}")
def classification_metrics(spark, d):
    m = ev.classification_metrics(_predicted(spark, d), "y", "p")
    return m.select(F.round("accuracy", 6).alias("accuracy"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "tp")


@query("SELECT y AS label, p AS prediction, count(*) AS n FROM " + _PRED + " GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return ev.confusion_matrix(_predicted(spark, d), "y", "p")


@query("SELECT round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT o_totalprice AS y, o_totalprice - (o_orderkey % 1000) * 300 AS e FROM orders)")
def regression_metrics(spark, d):
    o = t(spark, d, "orders").select(F.col("o_totalprice").alias("y"), ((F.col("o_orderkey") % 1000) * 300).cast("double").alias("p"))
    m = ev.regression_metrics(o, "y", "p")
    return m.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("""WITH r AS (SELECT o_custkey AS q, (o_orderstatus = 'F')::INT::DOUBLE AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, (o_orderstatus = 'F')::INT DESC) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F')::INT DESC) AS i FROM orders),
p AS (SELECT q, sum(CASE WHEN r <= 10 THEN g / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 10 THEN g / log2(i + 1) ELSE 0 END) AS best, coalesce(1.0 / min(CASE WHEN g > 0 THEN r END), 0) AS rr FROM r GROUP BY q)
SELECT round(avg(coalesce(dcg / NULLIF(best, 0), 0)), 6) AS ndcg, round(avg(rr), 6) AS mrr FROM p""")
def ranking_metrics(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("rel"))
    m = ev.ranking_metrics(o, "o_custkey", "o_totalprice", "rel")
    return m.select(F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))


@query("""SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0:' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE r <= greatest(1, round(n * 0.2))""")
def stratified_split(spark, d):
    _, test = ev.train_test_split(t(spark, d, "orders"), ["o_orderkey"], 0.2, stratify="o_orderpriority")
    return test.select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def k_folds(spark, d):
    return ev.k_fold(t(spark, d, "orders"), ["o_orderkey"], 5).select("o_orderkey", "fold")
