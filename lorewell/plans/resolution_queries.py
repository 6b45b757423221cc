"""Queries of text resolution, properties, samples and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exports, graph, lookups, resolution
from ..sources import views
from .base import EDGES, LINKS, UP, query, tidy

_REC = f"WITH RECURSIVE {EDGES}, {UP}"


def _nations(spark, d):
    return views.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("C-"), F.col("n_nationkey")).alias("concept"))


def _texts(spark, d):
    """Nation names in several forms, numbers, dates and other text."""
    c = views.table(spark, d, "customer").join(views.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 6
    text = (
        F.when(k == 0, F.lower("n_name")).when(k == 1, F.format_number(F.col("c_custkey") * 1000, 0)).when(k == 2, F.concat(F.lit("x y, "), "n_name", F.lit(" (of old)")))
        .when(k == 3, F.concat(F.lit("{{start date|19"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("|7}}"))).when(k == 4, F.lit("1990-1999")).otherwise(F.lit("nothing known"))
    )
    return c.select(F.col("c_custkey").alias("id"), text.alias("text"), "n_nationkey")


@query("concept_by_name", "SELECT lower(n_name) AS name, 'C-' || n_nationkey AS concept FROM nation")
def concept_by_name(spark, d):
    asked = views.table(spark, d, "nation").select(F.lower("n_name").alias("name"))
    return resolution.find_concepts(asked, _nations(spark, d))


@query("filtered_concept_by_name", "SELECT lower(n_name) AS name, 'C-' || n_nationkey AS concept FROM nation WHERE n_regionkey = 2")
def filtered_concept_by_name(spark, d):
    allowed = views.table(spark, d, "nation").filter("n_regionkey = 2").select(F.concat(F.lit("C-"), F.col("n_nationkey")).alias("concept"))
    return resolution.filtered_concepts(concept_by_name(spark, d), allowed).select("name", "concept")


@query(
    "resolve_text",
    """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 1 THEN 'number' WHEN 3 THEN 'date' WHEN 4 THEN 'interval' ELSE 'concept' END AS kind,
    CASE c_custkey % 6 WHEN 1 THEN CAST(CAST(c_custkey * 1000 AS BIGINT) AS VARCHAR) WHEN 3 THEN '19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-07' WHEN 4 THEN '1990..1999' ELSE 'C-' || n_nationkey END AS value, CAST(1.0 AS DOUBLE) AS weight
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 6 <> 5""",
)
def resolve_text(spark, d):
    out = resolution.resolve(_texts(spark, d), _nations(spark, d))
    return out.withColumn("value", F.when(F.col("kind") == "number", F.col("value").cast("double").cast("long").cast("string")).otherwise(F.col("value")))


@query("preprocess_tree", None)
def preprocess_tree(spark, d):
    return resolution.preprocess(_texts(spark, d))


@query("title_fallback", "SELECT n_nationkey AS source, 'C-' || n_nationkey AS target, CAST(1.0 AS DOUBLE) AS weight FROM nation")
def title_fallback(spark, d):
    n = views.table(spark, d, "nation")
    k = F.col("n_nationkey") % 3
    title = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat("n_name", F.lit(" (country)"))).otherwise(F.concat("n_name", F.lit(" (Old)")))
    names = n.select(F.when(k == 2, F.concat("n_name", F.lit(" (The Old)"))).otherwise(F.col("n_name")).alias("name"), F.concat(F.lit("C-"), "n_nationkey").alias("concept"))
    return resolution.title_fallback(n.select(F.col("n_nationkey").alias("source"), title.alias("title")), names)


@query("function_terms", "SELECT n_nationkey AS id, 'concept' AS kind, '(CitizenFn C-' || n_nationkey || ')' AS value, CAST(1.0 AS DOUBLE) AS weight FROM nation WHERE n_nationkey % 2 = 0")
def function_terms(spark, d):
    n = views.table(spark, d, "nation")
    texts = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("citizen of "), "n_name").alias("text"))
    functions = spark.createDataFrame([("Citizen of ______", "CitizenFn")], "name string, concept string")
    valid = _nations(spark, d).filter("cast(substring(concept, 3) as int) % 2 = 0").select(F.lit("CitizenFn").alias("function"), F.col("concept").alias("arg"))
    return resolution.function_terms(texts, functions, _nations(spark, d), valid)


@query("anchor_resolution", "SELECT n_nationkey AS id, 'concept' AS kind, 'C-' || n_nationkey AS value, CAST(1.0 AS DOUBLE) AS weight FROM nation WHERE n_nationkey % 2 = 0")
def anchor_resolution(spark, d):
    n = views.table(spark, d, "nation")
    texts = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("[["), "n_name", F.lit("|that]]"), F.when(F.col("n_nationkey") % 2 == 1, " more").otherwise("")).alias("text"))
    return resolution.by_anchor(texts, _nations(spark, d).withColumnRenamed("name", "title"))


@query("linked_text", "SELECT n_nationkey AS id, 'In ' || CASE WHEN n_nationkey < 10 THEN '[[C-' || n_nationkey || '|here]]' ELSE 'here' END || ' we are.' AS text FROM nation")
def linked_text(spark, d):
    n = views.table(spark, d, "nation")
    paragraphs = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("In [["), "n_name", F.lit("|here]] we are.")).alias("text"))
    return resolution.link_text(paragraphs, n.filter("n_nationkey < 10").select(F.col("n_name").alias("title"), F.concat(F.lit("C-"), "n_nationkey").alias("concept")))


@query("rdf_resolution", "SELECT 'c/' || c_custkey AS s, CASE c_custkey % 3 WHEN 0 THEN 'isaGenls' WHEN 1 THEN 'size' ELSE 'note' END AS relation, CASE c_custkey % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'number' ELSE 'string' END AS kind, CASE c_custkey % 3 WHEN 0 THEN 'C-' || n_nationkey WHEN 1 THEN c_custkey || '.0' ELSE '\"' || c_name || '\"' END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rdf_resolution(spark, d):
    c = views.table(spark, d, "customer").join(views.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    t = c.select(F.concat(F.lit("c/"), "c_custkey").alias("s"), F.when(k == 0, "type").when(k == 1, "size").otherwise("note").alias("p"), F.when(k == 0, F.col("n_name")).when(k == 1, F.col("c_custkey").cast("string")).otherwise(F.col("c_name")).alias("o"))
    return resolution.rdf_nodes(t, spark.createDataFrame([], "name string, concept string"), _nations(spark, d).withColumnRenamed("name", "title"))


@query("new_concept_names", None)
def new_concept_names(spark, d):
    p = views.table(spark, d, "part")
    return resolution.new_names(p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("title")), p.select(F.initcap("p_brand").alias("name")).distinct())


@query("property_search", "SELECT c_custkey AS node FROM customer WHERE regexp_matches(c_mktsegment, '^B')")
def property_search(spark, d):
    props = views.table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.lit("segment").alias("prop"), F.col("c_mktsegment").alias("value"))
    return exports.search_property(props, "segment", "^B")


@query("property_changes", "SELECT c_custkey AS node, 'segment' AS prop, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 5 <> 0")
def property_changes(spark, d):
    props = views.table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.lit("segment").alias("prop"), F.col("c_mktsegment").alias("value"))
    new = props.filter("node % 2 = 0").withColumn("value", F.lit("NEW"))
    return exports.remove_property(exports.set_property(props, new), props.filter("node % 5 = 0"))


@query("known_mappings", "SELECT o_custkey AS article, arg_max('o' || o_orderkey, struct_pack(r := o_orderkey % 4, c := 'o' || o_orderkey)) AS concept, max(o_orderkey % 4) AS run FROM orders GROUP BY o_custkey")
def known_mappings(spark, d):
    o = views.table(spark, d, "orders")
    e = o.select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("article"), F.concat(F.lit("o"), "o_orderkey").alias("concept"))
    return exports.known_runs(e, o.select(F.col("o_orderkey").alias("node"), F.lit("run").alias("prop"), (F.col("o_orderkey") % 4).cast("string").alias("value")))


@query("replay_script", f"WITH {EDGES} SELECT pred, arg1, arg2 FROM edges WHERE NOT (pred = 'genls' AND arg2 = 'ASIA') UNION ALL SELECT 'isa', n_name || ' x', n_name FROM nation")
def replay_script(spark, d):
    e = views.edges(spark, d)
    gone = e.filter("pred = 'genls' and arg2 = 'ASIA'").select(F.lit(2).alias("no"), F.concat(F.lit("removeedge ( genls "), "arg1", F.lit(" ASIA )")).alias("line"))
    new = views.table(spark, d, "nation").select(F.lit(1).alias("no"), F.concat(F.lit('addedge ( isa "'), "n_name", F.lit(' x" '), "n_name", F.lit(" )")).alias("line"))
    return exports.replay(gone.union(new), e)


@query("random_pairs", None)
def random_pairs(spark, d):
    return exports.random_pairs(views.table(spark, d, "nation").select(F.col("n_name").alias("term")), 10, 1)


@query("weighted_draws", "WITH s AS (SELECT p_type AS item, count(*) AS n FROM part GROUP BY 1), c AS (SELECT item, (sum(n) OVER (ORDER BY item) - n) * 1.0 / sum(n) OVER () AS lo, sum(n) OVER (ORDER BY item) * 1.0 / sum(n) OVER () AS hi FROM s) SELECT s_suppkey AS draw, item FROM supplier JOIN c ON (s_suppkey % 97) / 97.0 >= lo AND (s_suppkey % 97) / 97.0 < hi")
def weighted_draws(spark, d):
    kinds = views.table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return exports.weighted_draw(kinds, "p_type", "n", views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("draw"), ((F.col("s_suppkey") % 97) / 97.0).alias("u")))


@query("impact_summary", "SELECT count(*) AS n, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS sd FROM part WHERE p_partkey % 10 <> 0")
def impact_summary(spark, d):
    reply = F.when(F.col("p_partkey") % 10 == 0, "failed").otherwise(F.concat(F.lit("done, impact: "), F.col("p_size").cast("string")))
    return tidy(exports.impact(views.table(spark, d, "part").select(reply.alias("reply"))), "mean", "sd")


@query("converted_edges", f"WITH {EDGES}, m AS (SELECT n_name AS c FROM nation UNION SELECT c_name FROM customer WHERE c_custkey % 2 = 0) SELECT count(*) AS edges, sum(CASE WHEN arg1 IN (FROM m) AND arg2 IN (FROM m) THEN 1 ELSE 0 END)::BIGINT AS \"both\" FROM edges")
def converted_edges(spark, d):
    m = views.table(spark, d, "nation").select(F.col("n_name").alias("concept")).union(views.table(spark, d, "customer").filter("c_custkey % 2 = 0").select("c_name"))
    return exports.converted(views.edges(spark, d), m)


@query("salience_export", f"WITH {LINKS}, rich AS (SELECT src FROM links GROUP BY src HAVING count(*) >= 6) SELECT DISTINCT src, 'C-' || target AS concept FROM links WHERE src IN (FROM rich) AND length(target) % 2 = 0")
def salience_export(spark, d):
    li = views.links(spark, d)
    m = li.select(F.col("target").alias("title")).distinct().filter("length(title) % 2 = 0").withColumn("concept", F.concat(F.lit("C-"), "title"))
    return exports.salience(li, m, 6)


@query("relevant_categories", "SELECT p_partkey AS article_id, p_name || ' of ' || p_type AS category FROM part WHERE p_partkey % 2 = 0")
def relevant_categories(spark, d):
    p = views.table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("article_id"), F.upper("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" of "), "p_type")).otherwise(F.lit("0 other")).alias("category"))
    return exports.relevant_categories(rows)


@query("to_process", "SELECT p_partkey AS article_id FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0")
def to_process(spark, d):
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("article_id"))
    rows = p.withColumn("title", F.when(F.col("article_id") % 4 == 0, "Lists of parts").otherwise("Part"))
    return exports.to_process(rows, p.filter("article_id % 3 = 0"), lookups.is_list_title("title")).select("article_id")


@query("under_all_parents", f"{_REC} SELECT n AS concept FROM (SELECT n_name AS n FROM nation UNION ALL SELECT 'Brand new') c WHERE n NOT IN (SELECT node FROM up) OR (EXISTS (SELECT 1 FROM up WHERE node = c.n AND ancestor = 'ASIA') AND EXISTS (SELECT 1 FROM up WHERE node = c.n AND ancestor = 'Thing'))")
def under_all_parents(spark, d):
    up = graph.closure(graph.of(views.edges(spark, d), "genls"))
    c = views.table(spark, d, "nation").select(F.col("n_name").alias("concept")).union(spark.createDataFrame([("Brand new",)], "concept string"))
    return exports.under_all_parents(c, spark.createDataFrame([("ASIA",), ("Thing",)], "parent string"), up)


@query("fragment_gaps", None)
def fragment_gaps(spark, d):
    best = lookups.most_likely_sense(lookups.senses(views.links(spark, d), views.plain_label("target"))).filter("label <> ''")
    a = views.articles(spark, d).select(F.col("article_id").alias("id"), F.col("title").alias("text"))
    return exports.fragment_pairs(lookups.longest_annotations(lookups.annotate(a, best)))


@query("focus_columns", "SELECT n_nationkey AS \"table\", 'Nations' AS header FROM nation WHERE n_nationkey % 2 = 0")
def focus_columns(spark, d):
    n = views.table(spark, d, "nation").select(F.col("n_nationkey").alias("table"), F.explode(F.array(F.lit("Year"), F.when(F.col("n_nationkey") % 2 == 0, "Nations").otherwise("Population"))).alias("header"))
    return exports.focus_column(n.withColumn("focus", F.lit("nation")))
