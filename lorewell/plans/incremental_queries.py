"""Queries of the incremental operators, in their batch form and as streams that are drained."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import stores, views
from ..streaming import incremental
from .base import query, tidy


@query("trigger_queue", "SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'purchase'")
def trigger_queue(spark, d):
    return views.triggers(spark, d)


@query("run_version", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events WHERE event_type = 'purchase'")
def run_version(spark, d):
    return incremental.run_versions(views.triggers(spark, d)).select("event_id", "user_id", F.col("run").cast("long").alias("run"))


@query("run_version_stream", "SELECT user_id, count(*) AS runs FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def run_version_stream(spark, d):
    """The stateful stream, drained into a table; the newest state of each key is the batch result."""
    out = f"{stores.shared_root(spark)}/runs-{uuid.uuid4().hex}"
    schema = views.table(spark, d, "events").schema
    stream = spark.readStream.format("parquet").schema(schema).load(f"{d}/events*.parquet")
    runs = incremental.run_version_stream(stream.filter("event_type = 'purchase'").select("user_id"))
    incremental.drain(runs, f"{out}-state", lambda df, _: df.write.mode("append").parquet(out), "update").awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.max("runs").alias("runs"))


@query("ripple_once", "SELECT DISTINCT node FROM (SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_custkey % 100 = 0)")
def ripple_once(spark, d):
    changed = views.table(spark, d, "customer").filter("c_custkey % 100 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    links = views.table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    return incremental.ripple(changed, links)


@query("learned_standing", "SELECT event_type AS key, sum(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS ind, sum(CASE WHEN user_id % 3 = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS coll, sum(CASE WHEN user_id % 3 = 2 THEN 1.0 ELSE 0.0 END)::DOUBLE AS unk FROM events GROUP BY 1")
def learned_standing(spark, d):
    k = F.col("user_id") % 3
    rows = views.table(spark, d, "events").select(F.col("event_type").alias("key"), F.when(k == 0, "INDIVIDUAL").when(k == 1, "COLLECTION").otherwise("UNKNOWN").alias("kind"), F.lit(1.0).alias("weight"))
    return incremental.learned_standing(rows, "key")


@query("changed_rows", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0")
def changed_rows(spark, d):
    c = views.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    old = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return stores.changed_rows(c, old, ["c_custkey"])


@query("export_script", "SELECT 'addnode ' || n_name AS line FROM nation UNION ALL SELECT 'addedge ( isa ' || '\"' || n_name || ' x\" ''' || n_nationkey || ' )' FROM nation")
def export_script(spark, d):
    n = views.table(spark, d, "nation")
    nodes = n.select(F.col("n_name").alias("name"))
    return stores.export_script(nodes, n.select(F.lit("isa").alias("pred"), F.concat("n_name", F.lit(" x")).alias("arg1"), F.col("n_nationkey").cast("string").alias("arg2")))
