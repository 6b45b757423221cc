"""Queries over articles, links, senses and triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import weights
from ..operators import lookups
from ..sources import views
from .base import ARTICLES, LINKS, SENSES, TRIPLES, query, tidy


def _article(spark, d):
    return views.articles(spark, d).select("article_id", "title", "page_type")


def _senses(spark, d):
    return lookups.senses(views.links(spark, d), views.plain_label("target"))


@query("scan_articles", f"WITH {ARTICLES} SELECT * FROM articles WHERE page_type IN ('article', 'disambiguation') AND article_id > 20")
def scan_articles(spark, d):
    return lookups.scan_articles(_article(spark, d), after=20)


@query("scan_articles_back", f"WITH {ARTICLES} SELECT * FROM articles WHERE page_type IN ('article', 'disambiguation') AND article_id < 40 ORDER BY article_id DESC LIMIT 10")
def scan_articles_back(spark, d):
    return lookups.scan_articles(_article(spark, d), after=40, most=10, descending=True)


@query("scan_by_type", f"WITH {ARTICLES} SELECT page_type, count(*) AS n, min(article_id) AS lo, max(article_id) AS hi FROM articles GROUP BY page_type")
def scan_by_type(spark, d):
    return _article(spark, d).groupBy("page_type").agg(F.count(F.lit(1)).alias("n"), F.min("article_id").alias("lo"), F.max("article_id").alias("hi"))


@query("scan_concepts", "SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 7 <> 0 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 7 = 0)")
def scan_concepts(spark, d):
    part = views.table(spark, d, "part")
    return lookups.scan_concepts(part.select(F.col("p_name").alias("name")).distinct(), part.filter("p_partkey % 7 = 0").select(F.col("p_name").alias("name")))


@query("title_to_id", f"WITH {ARTICLES}, asked AS (SELECT DISTINCT title FROM articles WHERE article_id % 2 = 0 UNION SELECT c_name FROM customer WHERE c_custkey <= 10) SELECT asked.title, article_id FROM asked LEFT JOIN articles ON asked.title = articles.title")
def title_to_id(spark, d):
    a = _article(spark, d)
    asked = a.filter("article_id % 2 = 0").select("title").union(views.table(spark, d, "customer").filter("c_custkey <= 10").select("c_name")).distinct()
    return lookups.titles_to_ids(asked, a)


@query("title_context", "SELECT p_partkey AS id, p_name AS short, p_type AS context FROM part")
def title_context(spark, d):
    short, context = lookups.split_title("title")
    titled = views.table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("title"))
    return titled.select(F.col("p_partkey").alias("id"), short.alias("short"), context.alias("context"))


@query("list_articles", f"WITH {ARTICLES} SELECT article_id, 'List of ' || title AS title FROM articles WHERE article_id % 5 = 0")
def list_articles(spark, d):
    a = _article(spark, d).select("article_id", F.when(F.col("article_id") % 5 == 0, F.concat(F.lit("List of "), "title")).otherwise(F.concat(F.lit("Not a "), "title")).alias("title"))
    return a.filter(lookups.is_list_title("title"))


@query("labels_with_counts", f"WITH {LINKS} SELECT target, label, count(*) AS n FROM links GROUP BY target, label")
def labels_with_counts(spark, d):
    return lookups.labels_with_counts(views.links(spark, d))


@query("senses", f"WITH {SENSES} SELECT label, target, n, round(p, 6) AS p FROM senses")
def senses(spark, d):
    return tidy(_senses(spark, d), "p")


@query("most_likely_sense", f"WITH {SENSES} SELECT label, target, n, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, target) AS r FROM senses) WHERE r = 1")
def most_likely_sense(spark, d):
    return tidy(lookups.most_likely_sense(_senses(spark, d)), "p")


@query("tied_senses", f"WITH {SENSES} SELECT label, target, n, round(p, 6) AS p FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY n DESC) AS r FROM senses) WHERE r = 1")
def tied_senses(spark, d):
    return tidy(weights.most_likely(_senses(spark, d), ["label"], "n"), "p")


@query("inlinks_popularity", f"WITH {LINKS} SELECT target, inlinks, row_number() OVER (ORDER BY inlinks DESC, target) AS place FROM (SELECT target, count(*) AS inlinks FROM links GROUP BY target) ORDER BY place LIMIT 50")
def inlinks_popularity(spark, d):
    # The rank is given to the top 50 only: the window runs over what the top-n leaves.
    from pyspark.sql import Window

    top = lookups.in_links(views.links(spark, d)).orderBy(F.desc("inlinks"), "target").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("inlinks"), "target")).cast("long"))


@query("outlinks", f"WITH {LINKS} SELECT src, count(*) AS outlinks FROM links GROUP BY src")
def outlinks(spark, d):
    return lookups.out_links(views.links(spark, d))


@query("article_list_export", f"WITH {ARTICLES}, {LINKS} SELECT article_id, title, inlinks FROM articles JOIN (SELECT target, count(*) AS inlinks FROM links GROUP BY target HAVING count(*) >= 2) ON title = target WHERE page_type IN ('article', 'disambiguation')")
def article_list_export(spark, d):
    return lookups.popular(_article(spark, d), views.links(spark, d), 2)


@query(
    "relatedness",
    f"""WITH {LINKS}, one AS (SELECT DISTINCT src, target FROM links), size AS (SELECT target, count(*) AS n FROM one GROUP BY target),
    shared AS (SELECT a.target AS a, b.target AS b, count(*) AS k FROM one a JOIN one b ON a.src = b.src AND a.target < b.target GROUP BY 1, 2)
    SELECT a, b, round(k * 1.0 / (x.n + y.n - k), 6) AS relatedness FROM shared JOIN size x ON x.target = a JOIN size y ON y.target = b""",
)
def relatedness(spark, d):
    return tidy(lookups.relatedness(views.links(spark, d)), "relatedness")


@query(
    "annotate_titles",
    f"""WITH {SENSES}, best AS (SELECT label, target FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, target) AS r FROM senses) WHERE r = 1 AND label <> ''),
    t AS (SELECT page_id AS id, string_split_regex(lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))), '\\s+') AS w FROM pages),
    g AS (SELECT id, w, unnest(range(len(w))) AS pos FROM t), h AS (SELECT id, w, pos, unnest(range(1, least(4, len(w) - pos) + 1)) AS size FROM g),
    k AS (SELECT id, pos::INT AS "at", size::INT AS size, array_to_string(w[pos + 1 : pos + size], ' ') AS label FROM h)
    SELECT k.id, k."at", k.size, k.label, best.target FROM k JOIN best ON k.label = best.label""",
)
def annotate_titles(spark, d):
    best = lookups.most_likely_sense(_senses(spark, d)).filter("label <> ''")
    return lookups.annotate(_article(spark, d).select(F.col("article_id").alias("id"), F.col("title").alias("text")), best).select("id", "at", "size", "label", "target")


@query("triple_optional", f"WITH {TRIPLES} SELECT a.s AS x, a.o AS status, c.o AS customer FROM triples a LEFT JOIN triples c ON c.s = a.s AND c.p = 'customer' WHERE a.p = 'status'")
def triple_optional(spark, d):
    t = views.triples(spark, d)
    return lookups.match_optional(lookups.match(t, ("?x", "status", "?status")), t, ("?x", "customer", "?customer"))


@query("triple_join", f"WITH {TRIPLES} SELECT a.s AS x, b.o AS priority FROM triples a JOIN triples b ON a.s = b.s AND b.p = 'priority' WHERE a.p = 'status' AND a.o = 'F'")
def triple_join(spark, d):
    return lookups.match(views.triples(spark, d), ("?x", "status", "F"), ("?x", "priority", "?priority"))


@query("triple_ask", f"WITH {TRIPLES} SELECT count(*) > 0 AS answer FROM triples WHERE p = 'priority' AND o = '1-URGENT'")
def triple_ask(spark, d):
    return lookups.ask(lookups.match(views.triples(spark, d), ("?x", "priority", "1-URGENT")))


@query("triple_filter", f"WITH {TRIPLES} SELECT s AS x, o AS y FROM triples WHERE p = 'priority' AND regexp_matches(o, '^[12]-')")
def triple_filter(spark, d):
    return lookups.match(views.triples(spark, d), ("?x", "priority", "?y")).filter(F.col("y").rlike("^[12]-"))


@query("triple_single", f"WITH {TRIPLES} SELECT s AS x, min(o) AS y FROM triples WHERE p = 'customer' GROUP BY s")
def triple_single(spark, d):
    return lookups.match(views.triples(spark, d), ("?x", "customer", "?y")).groupBy("x").agg(F.min("y").alias("y"))


@query("blacklist_props", f"WITH {TRIPLES} SELECT s, p, o FROM triples WHERE p <> 'priority'")
def blacklist_props(spark, d):
    return lookups.without_listed(views.triples(spark, d), spark.createDataFrame([("priority",), ("priority",), ("none",)], "uri string"))


@query("article_text_export", f"WITH {ARTICLES} SELECT article_id, title FROM articles WHERE page_type = 'article' AND NOT contains(lower(title), 'list of') AND NOT regexp_matches(string_split(title, ' ')[-1], '^[a-z]')")
def article_text_export(spark, d):
    return lookups.export_text(views.articles(spark, d), F.col("html")).select("article_id", "title")
