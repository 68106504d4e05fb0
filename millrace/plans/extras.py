"""Set operations, grouping sets, ranking and range windows, custom reducers, label indexes, chunked and partly failing reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets
from ..session import scratch
from ..sources import files
from ..streaming.windows import file_stream
from .registry import query, t


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, d):
    return sets.intersect(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def except_keys(spark, d):
    return sets.difference(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")))


_TOTAL = "o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS grouping, count(*) AS n, round(sum(o_totalprice), 2) AS s, count(DISTINCT o_custkey) FILTER (o_totalprice > 100000) AS c FROM orders GROUP BY"


def _aggregates():
    return F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"), F.countDistinct(F.when(F.col("o_totalprice") > 100000, F.col("o_custkey"))).alias("c")


_KEYS = ["o_orderstatus", "o_orderpriority"]


@query(f"SELECT {_TOTAL} ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_totals(spark, d):
    return sets.rollup(t(spark, d, "orders"), _KEYS, *_aggregates())


@query(f"SELECT {_TOTAL} CUBE (o_orderstatus, o_orderpriority)")
def cube_totals(spark, d):
    return sets.cube(t(spark, d, "orders"), _KEYS, *_aggregates())


@query(f"SELECT {_TOTAL} GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_set_totals(spark, d):
    return sets.grouping_sets(t(spark, d, "orders"), [["o_orderstatus"], ["o_orderpriority"], []], _KEYS, *_aggregates())


@query("SELECT c_custkey, ntile(4) OVER w AS ntile, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist, nth_value(c_acctbal, 2) OVER (w ROWS UNBOUNDED PRECEDING) AS second FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
def ranking_windows(spark, d):
    order = ["c_acctbal", "c_custkey"]
    c = sets.ranking(t(spark, d, "customer"), order, ["c_nationkey"])
    c = sets.nth_value(c, "c_acctbal", 2, order, ["c_nationkey"], "second")
    return c.select("c_custkey", F.col("ntile").cast("long").alias("ntile"), F.round("percent_rank", 6).alias("percent_rank"), F.round("cume_dist", 6).alias("cume_dist"), "second")


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 500 FOLLOWING), 4) AS m FROM orders")
def range_window_mean(spark, d):
    return sets.range_window(t(spark, d, "orders"), "o_totalprice", F.avg, "o_orderkey", 1000, 500, ["o_custkey"], "m").select("o_orderkey", F.round("m", 4).alias("m"))


@query("SELECT round(sum(o_totalprice * o_totalprice) / 1e9::DOUBLE, 2) AS price, sum(o_custkey * o_custkey)::DOUBLE AS customer FROM orders")
def custom_reducer(spark, d):
    got = sets.reduce_columns(t(spark, d, "orders"), ["o_totalprice", "o_custkey"], 0.0, lambda s, v: s + float((v * v).sum()), lambda a, b: a + b)
    return spark.createDataFrame([(round(got["o_totalprice"] / 1e9, 2), got["o_custkey"])], "price double, customer double")


@query("SELECT i::BIGINT AS position FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, * FROM orders) WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def label_locations(spark, d):
    return sets.MultiIndex(t(spark, d, "orders"), _KEYS, ["o_orderkey"]).locations("F", "1-URGENT")


@query("SELECT i // 100 AS chunk, count(*) AS n, sum(s_suppkey)::BIGINT AS k FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_suppkey FROM supplier) GROUP BY 1")
def chunked_read(spark, d):
    path = scratch(spark, "chunks")
    files.write_csv(t(spark, d, "supplier").select("s_suppkey", "s_name").coalesce(1).sortWithinPartitions("s_suppkey"), path)
    out = files.read_chunked(spark, path, 100)
    return out.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").cast("long").alias("k"))


@query("SELECT r_name AS name, 'read' AS how FROM region UNION ALL SELECT n_name, 'read' FROM nation UNION ALL SELECT 'gone', 'failed'")
def many_files_one_missing(spark, d):
    a, b = scratch(spark, "many"), scratch(spark, "many")
    files.write_csv(t(spark, d, "region").select(F.col("r_name").alias("name")), a)
    files.write_csv(t(spark, d, "nation").select(F.col("n_name").alias("name")), b)
    out, failed = files.read_many(spark, [a, scratch(spark, "gone"), b])
    lost = spark.createDataFrame([("gone", "failed") for _ in failed], "name string, how string")
    return out.select("name", F.lit("read").alias("how")).unionByName(lost)


@query("SELECT o.event_id AS left_id, p.event_id AS right_id FROM events o JOIN events p ON o.user_id = p.user_id AND p.ts >= o.ts AND p.ts <= o.ts + INTERVAL 1 HOUR WHERE o.event_type < p.event_type")
def stream_to_stream_join(spark, d):
    """The events joined with themselves as two streams, within an hour, with watermarks on both sides."""
    path = scratch(spark, "pairs")
    t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(path)
    schema = spark.read.parquet(path).schema
    side = lambda name: file_stream(spark, path, schema).select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("event_type").alias(f"{name}_type"), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", "3650 days")
    near = (F.col("left_user") == F.col("right_user")) & (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr("INTERVAL 1 HOUR")) & (F.col("left_type") < F.col("right_type"))
    out = scratch(spark, "joined")
    run = side("left").join(side("right"), near).select("left_id", "right_id").writeStream.format("parquet").option("checkpointLocation", scratch(spark, "join-state")).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema("left_id long, right_id long").parquet(out)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark, d):
    path, out = scratch(spark, "repeats"), scratch(spark, "single")
    t(spark, d, "events").select("user_id", "event_type").repartition(3).write.parquet(path)
    rows = file_stream(spark, path, "user_id long, event_type string", max_files=1).dropDuplicates(["user_id", "event_type"])
    run = rows.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "dedup-state")).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(out)
