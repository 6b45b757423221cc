"""Queries that extract information from titles, texts and properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import standing, weights, wikitext
from ..operators import lookups, mining
from ..sources import views
from .base import ARTICLES, LINKS, TRIPLES, query, r6, tidy

_VOTES = "sv AS (SELECT p_type AS key, CASE WHEN p_size > 30 THEN 'INDIVIDUAL' WHEN p_size > 10 THEN 'COLLECTION' ELSE 'UNKNOWN' END AS kind, 0.5 + p_size % 2 AS weight FROM part)"
_TALLY = _VOTES + ", t AS (SELECT key, sum(CASE WHEN kind = 'INDIVIDUAL' THEN weight ELSE 0 END) AS ind, sum(CASE WHEN kind = 'COLLECTION' THEN weight ELSE 0 END) AS coll, sum(CASE WHEN kind = 'UNKNOWN' THEN weight ELSE 0 END) AS unk FROM sv GROUP BY key)"


def _tally(spark, d):
    s = F.col("p_size")
    votes = views.table(spark, d, "part").select(F.col("p_type").alias("key"), F.when(s > 30, "INDIVIDUAL").when(s > 10, "COLLECTION").otherwise("UNKNOWN").alias("kind"), (F.lit(0.5) + s % 2).alias("weight"))
    return votes, standing.tally(votes, ["key"])


@query("standing_laplace", f"WITH {_TALLY} SELECT key, CAST(ind AS DOUBLE) AS ind, CAST(coll AS DOUBLE) AS coll, CAST(unk AS DOUBLE) AS unk, CAST(ind + coll AS DOUBLE) AS total, round((ind + 1) / (ind + coll + 2), 6) AS ind_share, round((coll + 1) / (ind + coll + 2), 6) AS coll_share FROM t")
def standing_laplace(spark, d):
    return tidy(standing.with_share(_tally(spark, d)[1]), "ind_share", "coll_share")


@query(
    "standing_vs_global",
    f"""WITH {_TALLY}, g AS (SELECT sum(ind) AS gi, sum(coll) AS gc FROM t), s AS (SELECT key, unk, ((ind + 1) / (ind + coll + 2)) / ((gi + 1) / (gi + gc + 2)) AS i, ((coll + 1) / (ind + coll + 2)) / ((gc + 1) / (gi + gc + 2)) AS c FROM t, g)
    SELECT key, round(i / (i + c), 6) AS ind, round(c / (i + c), 6) AS coll, CAST(unk AS DOUBLE) AS unk, CAST(1.0 AS DOUBLE) AS total FROM s""",
)
def standing_vs_global(spark, d):
    votes, t = _tally(spark, d)
    return tidy(standing.against_global(t, standing.tally(votes, [])), "ind", "coll")


@query("standing_merge", None)
def standing_merge(spark, d):
    """Tallies by part size in order, folded into one for each type."""
    s = F.col("p_size")
    votes = views.table(spark, d, "part").select(F.col("p_type").alias("key"), s.alias("src"), F.when(s > 30, "INDIVIDUAL").otherwise("COLLECTION").alias("kind"), F.lit(1.0).alias("weight"))
    return tidy(standing.merge(standing.tally(votes, ["key", "src"]), ["key"], "src"), "ind", "coll", "total")


@query("title_standing", f"WITH {ARTICLES}, w AS (SELECT article_id, string_split_regex(trim(string_split(title, ',')[1]), '\\s+') AS w FROM articles WHERE NOT regexp_matches(title, '^Lists? of .*$')) SELECT article_id, 'title' AS heuristic, CASE WHEN regexp_matches(w[-1], '^[A-Z]') THEN 'INDIVIDUAL' ELSE 'COLLECTION' END AS kind, CAST(1.0 AS DOUBLE) AS weight FROM w WHERE len(w) > 1")
def title_standing(spark, d):
    return mining.title_standing(views.articles(spark, d).select("article_id", "title"))


@query("majority_vote", "SELECT source, lang, n, total FROM (SELECT *, sum(n) OVER (PARTITION BY source)::BIGINT AS total, max(n) OVER (PARTITION BY source) AS top FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE n = top AND total >= 30 AND top >= 0.5 * total")
def majority_vote(spark, d):
    return mining.majority(views.table(spark, d, "documents"), "source", "lang", 30, 0.5)


@query("unique_mode", "SELECT key AS source, value AS lang, n FROM (SELECT *, count(*) OVER (PARTITION BY key) AS c FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY n DESC) AS r FROM (SELECT source AS key, lang AS value, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE r = 1) WHERE c = 1")
def unique_mode(spark, d):
    return mining.unique_mode(views.table(spark, d, "documents"), "source", "lang")


@query(
    "ewma_by_user",
    """WITH e AS (SELECT user_id, list(least(1.0, greatest(0.0, value / 100.0)) ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
    SELECT user_id, round(list_reduce(list_prepend(1.0, v), lambda a, x : 0.1 * x + 0.9 * a), 6) AS weight FROM e""",
)
def ewma_by_user(spark, d):
    e = views.table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") / 100.0).alias("v"))
    return tidy(weights.moving_average(e, "user_id", ["ts", "event_id"], "v"), "weight")


@query("mined_bits", "SELECT l_orderkey AS article_id, bit_or(1 << (l_linenumber % 5)) AS mined FROM lineitem GROUP BY l_orderkey")
def mined_bits(spark, d):
    rows = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.expr("shiftleft(1, l_linenumber % 5)").alias("bits"))
    return mining.produced(rows)


@query("first_paragraph", "SELECT doc_id, CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10))[1] WHEN contains(text, '==') THEN string_split(text, '==')[1] ELSE text END AS paragraph FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)")
def first_paragraph(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return docs.select("doc_id", wikitext.first_paragraph(F.col("text")).alias("paragraph"))


_MARKUP = "m AS (SELECT page_id AS article_id, '[[' || target || '|' || label || ']] is a ' || label || '.' AS markup FROM (SELECT src AS page_id, target, label FROM links))"


def _markup(spark, d):
    li = views.links(spark, d)
    return li.select(F.col("src").alias("article_id"), F.concat(F.lit("[["), "target", F.lit("|"), "label", F.lit("]] is a "), "label", F.lit(".")).alias("markup"))


@query("anchor_extract", f"WITH {LINKS}, {_MARKUP} SELECT article_id, regexp_extract(markup, '\\[\\[([^|\\]]*)\\|([^\\]]*)\\]\\]', 1) AS target, regexp_extract(markup, '\\[\\[([^|\\]]*)\\|([^\\]]*)\\]\\]', 2) AS label FROM m WHERE regexp_matches(markup, '\\[\\[[^|\\[\\]]+\\|')")
def anchor_extract(spark, d):
    return _markup(spark, d).select("article_id", F.explode(wikitext.anchors("markup")).alias("a")).select("article_id", "a.target", "a.label")


@query("clean_markup", None)
def clean_markup(spark, d):
    return _markup(spark, d).select("article_id", wikitext.clean_markup(F.col("markup")).alias("text"))


@query("copula_phrases", None)
def copula_phrases(spark, d):
    sentences = views.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.split("text", r"\.")[0].alias("sentence"))
    return mining.parsed_sentence(sentences)


@query("infobox_parse", None)
def infobox_parse(spark, d):
    p = views.table(spark, d, "part")
    boxed = p.select(F.col("p_partkey").alias("article_id"), F.concat(F.lit("{{Infobox part_kind | name1 = "), "p_name", F.lit(" | brand = {{x|"), "p_brand", F.lit("}} | size = "), F.col("p_size").cast("string"), F.lit("}}")).alias("markup"))
    return mining.infobox_relations(boxed)


@query("relation_assertions", "SELECT p_partkey AS article_id, 'infobox relation' AS heuristic, CASE p_partkey % 4 WHEN 0 THEN 'conceptImage' WHEN 1 THEN 'homepage' ELSE 'maker' END AS relation, CASE WHEN p_partkey % 4 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END AS arg, CAST(1.0 AS DOUBLE) AS weight FROM part WHERE p_partkey % 4 <> 3")
def relation_assertions(spark, d):
    k = F.col("p_partkey") % 4
    rows = views.table(spark, d, "part").select(F.col("p_partkey").alias("article_id"), F.lit("t").alias("type"), F.when(k == 0, "image").when(k == 1, "website").when(k == 2, "maker12").otherwise("caption").alias("name"), F.col("p_name").alias("arg"))
    return mining.relation_assertions(rows)


@query("bullet_lists", None)
def bullet_lists(spark, d):
    li = views.links(spark, d)
    text = li.groupBy("src").agg(F.concat(F.lit("==Links==\n* [["), F.array_join(F.array_sort(F.collect_set("target")), "]]\n* [["), F.lit("]]")).alias("text"))
    parse = wikitext.column(wikitext.bullets, "array<struct<header:string,depth:int,item:string>>")
    return text.select("src", F.posexplode(parse(F.col("text"))).alias("place", "b")).select("src", "place", "b.header", "b.depth", "b.item")


@query("tables", None)
def tables(spark, d):
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("|-\n| "), x["n_nationkey"].cast("string"), F.lit(" || "), x["n_name"], F.lit("\n"))), "")
    text = views.table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("==Nations==\n{|\n! key !! name\n"), rows, F.lit("|}")).alias("text"))
    parse = wikitext.column(wikitext.tables, "array<struct<context:string,header:string,row:int,value:string>>")
    return text.select("n_regionkey", F.explode(parse(F.col("text"))).alias("c")).select("n_regionkey", "c.*")


@query("levenshtein_filter", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 3")
def levenshtein_filter(spark, d):
    return mining.near_names(views.table(spark, d, "part"), ["p_brand", "p_size"], "p_partkey", "p_name")


@query("category_miner", "SELECT o_orderkey AS article_id, 'category' AS heuristic, CASE o_orderkey % 3 WHEN 0 THEN 'birthDate' WHEN 1 THEN 'deathDate' ELSE 'isaGenls' END AS relation, CASE o_orderkey % 3 WHEN 2 THEN o_orderpriority ELSE CAST(year(o_orderdate) AS VARCHAR) END AS arg, CAST(1.0 AS DOUBLE) AS weight FROM orders")
def category_miner(spark, d):
    k, y = F.col("o_orderkey") % 3, F.year("o_orderdate").cast("string")
    members = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), F.lit("An order of someone").alias("title"), F.when(k == 0, F.concat(y, F.lit(" births"))).when(k == 1, F.concat(y, F.lit(" deaths"))).otherwise(F.concat("o_orderpriority", F.lit(" stubs"))).alias("category"))
    return mining.categories(members)


@query("birth_year_extract", "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS VARCHAR) AS born FROM orders")
def birth_year_extract(spark, d):
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.regexp_extract(F.concat(F.year("o_orderdate").cast("string"), F.lit(" births")), r"(\d{1,4})s? births?", 1).alias("born"))


@query("numeric_parse", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey * 1000 AS DOUBLE) END AS number FROM orders")
def numeric_parse(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 0, "no number").otherwise(F.format_number(F.col("o_orderkey") * 1000, 0))
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), wikitext.numeric(text).alias("number"))


@query("date_template", "SELECT o_orderkey AS id, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day FROM orders")
def date_template(spark, d):
    text = F.concat(F.lit("{{start date|df=y|"), F.date_format("o_orderdate", "yyyy|M|d"), F.lit("}}"))
    parse = wikitext.column(wikitext.date_template, "struct<year:int,month:int,day:int>")
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parse(text).alias("t")).select("id", "t.*")


@query("interval_parse", "SELECT o_custkey AS source, min(year(o_orderdate))::INT AS start, max(year(o_orderdate))::INT AS \"end\" FROM orders GROUP BY o_custkey")
def interval_parse(spark, d):
    spans = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.concat(F.min(F.year("o_orderdate")).cast("string"), F.lit("-"), F.max(F.year("o_orderdate")).cast("string")).alias("span"))
    return spans.select("source", wikitext.interval(F.col("span")).alias("i")).select("source", "i.*")


@query("list_children", f"WITH {ARTICLES} SELECT c.article_id, 'list' AS heuristic, 'isaGenls' AS relation, CAST(l.article_id AS VARCHAR) AS arg, CAST(1.0 AS DOUBLE) AS weight FROM (SELECT article_id FROM articles WHERE article_id % 10 = 3) l JOIN articles o ON o.article_id = l.article_id + 1 JOIN articles c ON c.title = o.title")
def list_children(spark, d):
    a = views.articles(spark, d).select("article_id", "title")
    nxt = a.select((F.col("article_id") - 1).alias("focus_id"), F.concat(F.lit("* The [["), wikitext.anchored(F.col("title")), F.lit("|x]] one")).alias("markup")).filter("focus_id % 10 = 3")
    return mining.list_children(nxt, a)


@query("property_miner", f"WITH {TRIPLES} SELECT s, p, o FROM triples WHERE p = 'status'")
def property_miner(spark, d):
    return mining.properties(views.triples(spark, d), spark.createDataFrame([("string",)], "uri string"), "stat")


@query("assertions_by_subject", "SELECT l_linenumber AS line, CASE WHEN l_linenumber % 2 = 0 THEN 'isa' ELSE 'likes' END AS relation, CAST(l_orderkey AS VARCHAR) AS subject, l_orderkey AS ok FROM lineitem UNION ALL SELECT l_linenumber, 'likes', CAST(l_partkey AS VARCHAR), l_orderkey FROM lineitem WHERE l_linenumber % 2 = 1")
def assertions_by_subject(spark, d):
    rows = views.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") % 2 == 0, "isa").otherwise("likes").alias("relation"), F.array(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("args"), F.col("l_orderkey").alias("ok"))
    return mining.by_subject(rows).drop("args")


@query("short_names", "SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w : upper(w[1]) || w[2:4]), '') AS short FROM part")
def short_names(spark, d):
    """Short forms of each part's name written in camel case."""
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), wikitext.short_name(name).alias("short"))
