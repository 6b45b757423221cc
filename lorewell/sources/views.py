"""Articles, links, ontology edges and the other relations of the engine, as views over the star-schema tables.

Each function reads only the columns it names; filters on the results reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR = '<a href="/([^"]*)">([^<]*)</a>'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, title, page_type, html)."""
    kind = F.when(F.col("page_id") % 20 == 0, "disambiguation").when(F.col("page_id") % 20 == 1, "redirect").when(F.col("page_id") % 20 == 2, "category").otherwise("article")
    return table(spark, d, "pages").select(F.col("page_id").alias("article_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), kind.alias("page_type"), "html")


def links(spark: SparkSession, d: str) -> DataFrame:
    """(src, target, label): one row for each anchor."""
    found = F.arrays_zip(F.expr(f"regexp_extract_all(html, '{ANCHOR}', 1)").alias("target"), F.expr(f"regexp_extract_all(html, '{ANCHOR}', 2)").alias("label"))
    return table(spark, d, "pages").select(F.col("page_id").alias("src"), F.explode(found).alias("a")).select("src", F.col("a.target").alias("target"), F.col("a.label").alias("label"))


def plain_label(col: str):
    return F.lower(F.translate(F.col(col), ".,;", ""))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(pred, arg1, arg2): genls nation-region-Thing and type-Thing, isa customer/supplier-nation and part-type, disjointWith of regions and of types."""
    t = lambda n: table(spark, d, n)
    row = lambda p, a, b: [F.lit(p).alias("pred"), a.cast("string").alias("arg1"), b.cast("string").alias("arg2")]
    region, nation = t("region"), t("nation")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey)
    types = t("part").select("p_type").distinct()
    out = named.select(*row("genls", F.col("n_name"), F.col("r_name")))
    out = out.union(region.select(*row("genls", F.col("r_name"), F.lit("Thing"))))
    out = out.union(types.select(*row("genls", F.col("p_type"), F.lit("Thing"))))
    out = out.union(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(*row("isa", F.col("c_name"), F.col("n_name"))))
    out = out.union(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(*row("isa", F.col("s_name"), F.col("n_name"))))
    out = out.union(t("part").select(*row("isa", F.concat(F.lit("Part#"), F.col("p_partkey")), F.col("p_type"))))
    a, b = region.select(F.col("r_name").alias("a")), region.select(F.col("r_name").alias("b"))
    out = out.union(a.join(b, F.col("a") < F.col("b")).select(*row("disjointWith", F.col("a"), F.col("b"))))
    return out.union(types.select(F.col("p_type").alias("a")).join(types.select(F.col("p_type").alias("b")), F.col("a") < F.col("b")).select(*row("disjointWith", F.col("a"), F.col("b"))))


def redirects(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): pages of type redirect; chains and cycles occur."""
    pages = table(spark, d, "pages").select("page_id")
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    return pages.filter("page_id % 20 = 1").join(F.broadcast(n), how="cross").select(F.col("page_id").alias("src"), ((F.col("page_id") * 7 + 14) % F.col("n")).alias("dst"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """(subject, heuristic, target, weight): a customer's nations by the suppliers of its orders, and by its own nation."""
    o, li, s, n = (table(spark, d, x) for x in ("orders", "lineitem", "supplier", "nation"))
    bought = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    votes = bought.groupBy("o_custkey", "s_nationkey").agg(F.count(F.lit(1)).cast("double").alias("weight")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    one = votes.select(F.col("o_custkey").alias("subject"), F.lit("supplier").alias("heuristic"), F.col("n_name").alias("target"), "weight")
    own = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return one.unionByName(own.select(F.col("c_custkey").alias("subject"), F.lit("own").alias("heuristic"), F.col("n_name").alias("target"), F.lit(1.0).alias("weight")))


def triples(spark: SparkSession, d: str) -> DataFrame:
    """(s, p, o) of orders: status, priority, and the customer for two orders in three."""
    o = table(spark, d, "orders")
    row = lambda p, v: o.select(F.concat(F.lit("order/"), F.col("o_orderkey")).alias("s"), F.lit(p).alias("p"), v.cast("string").alias("o"))
    some = row("customer", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))).filter("o is not null")
    return row("status", F.col("o_orderstatus")).union(row("priority", F.col("o_orderpriority"))).union(some)


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, truth, score): labelled quality and a score from the length."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", (F.col("quality") == 1).alias("truth"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))


def triggers(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, ts, user_id, value): queued triggers."""
    return table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "ts", "user_id", "value")
