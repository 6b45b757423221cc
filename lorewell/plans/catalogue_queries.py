"""Queries of page types, category trees, topics, cursors, proofs, orders and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue, consistency, graph, lookups, mapping, mining, resolution
from ..sources import views
from .base import ARTICLES, DISJOINT, EDGES, LINKS, SENSES, UP, query, tidy

_REC = f"WITH RECURSIVE {EDGES}, {UP}"
_TREE = "tree AS (SELECT DISTINCT p_brand AS arg1, p_type AS arg2 FROM part UNION SELECT DISTINCT p_type, 'Parts' FROM part)"


def _tree(spark, d):
    """Categories: brands below types below Parts."""
    p = views.table(spark, d, "part")
    return p.select(F.col("p_brand").alias("arg1"), F.col("p_type").alias("arg2")).union(p.select("p_type", F.lit("Parts"))).distinct()


@query("page_type_cascade", "SELECT page_id AS page, CASE WHEN page_id % 6 = 0 THEN 'disambiguation' WHEN page_id % 10 = 0 THEN 'category' WHEN page_id % 15 = 0 THEN 'redirect' ELSE 'article' END AS page_type FROM pages")
def page_type_cascade(spark, d):
    p = views.table(spark, d, "pages").select(F.col("page_id").alias("page"))
    return catalogue.page_types(p, p.filter("page % 6 = 0"), p.filter("page % 10 = 0"), p.filter("page % 15 = 0"))


@query("article_categories", "SELECT DISTINCT p_name AS article, p_brand AS category FROM part")
def article_categories(spark, d):
    return views.table(spark, d, "part").select(F.col("p_name").alias("article"), F.col("p_brand").alias("category")).distinct()


@query("sub_categories", f"WITH {_TREE} SELECT arg2 AS category, count(*) AS subs, string_agg(arg1, ',' ORDER BY arg1) AS names FROM tree GROUP BY arg2")
def sub_categories(spark, d):
    return _tree(spark, d).groupBy(F.col("arg2").alias("category")).agg(F.count(F.lit(1)).alias("subs"), F.array_join(F.array_sort(F.collect_list("arg1")), ",").alias("names"))


@query("parent_categories", f"WITH {_TREE} SELECT arg1 AS category, arg2 AS parent FROM tree")
def parent_categories(spark, d):
    return _tree(spark, d).select(F.col("arg1").alias("category"), F.col("arg2").alias("parent"))


@query("category_tree_members", "SELECT c AS category, count(DISTINCT p_partkey) AS members FROM (SELECT p_partkey, p_brand AS c FROM part UNION ALL SELECT a.p_partkey, b.p_type FROM part a JOIN (SELECT DISTINCT p_brand, p_type FROM part) b ON a.p_brand = b.p_brand UNION ALL SELECT p_partkey, 'Parts' FROM part) GROUP BY c")
def category_tree_members(spark, d):
    members = views.table(spark, d, "part").select(F.col("p_partkey").alias("member"), F.col("p_brand").alias("category"))
    return catalogue.in_categories(members, graph.closure(_tree(spark, d))).groupBy("category").agg(F.count("member").alias("members"))


@query("relevant_sub_categories", f"WITH {_TREE}, one AS (SELECT 'Parts' AS root, arg1 AS category FROM tree WHERE arg2 = 'Parts' AND contains(lower(arg1), 'a')) SELECT root, category FROM one UNION SELECT 'Parts', tree.arg1 FROM one JOIN tree ON tree.arg2 = one.category WHERE contains(lower(tree.arg1), 'a')")
def relevant_sub_categories(spark, d):
    return catalogue.relevant_closure(spark.createDataFrame([("Parts", "A")], "root string, text string"), _tree(spark, d))


@query(
    "title_topics",
    f"""WITH {SENSES}, best AS (SELECT label, target, p FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, target) AS r FROM senses) WHERE r = 1 AND label <> ''),
    t AS (SELECT page_id AS id, string_split_regex(lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))), '\\s+') AS w FROM pages),
    g AS (SELECT id, w, unnest(range(len(w))) AS pos FROM t), h AS (SELECT id, w, pos, unnest(range(1, least(4, len(w) - pos) + 1)) AS size FROM g),
    k AS (SELECT id, array_to_string(w[pos + 1 : pos + size], ' ') AS label FROM h), s AS (SELECT k.id, best.target, sum(best.p) AS w FROM k JOIN best ON k.label = best.label GROUP BY 1, 2)
    SELECT id, target, round(x, 6) AS weight FROM (SELECT id, target, w / max(w) OVER (PARTITION BY id) AS x FROM s) WHERE x >= 0.01""",
)
def title_topics(spark, d):
    best = lookups.most_likely_sense(lookups.senses(views.links(spark, d), views.plain_label("target"))).filter("label <> ''")
    found = lookups.annotate(views.articles(spark, d).select(F.col("article_id").alias("id"), F.col("title").alias("text")), best)
    return tidy(catalogue.topics(found.join(best.select("label", "p"), "label")), "weight")


@query("article_urls", f"WITH {ARTICLES} SELECT article_id, 'http://en.wikipedia.org/wiki/' || replace(title, ' ', '_') AS url FROM articles")
def article_urls(spark, d):
    return views.articles(spark, d).select("article_id", catalogue.page_url(F.col("title"), "http://en.wikipedia.org/wiki/").alias("url"))


@query("useful_bullets", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 2 THEN 'Members' ELSE NULL END AS header, p_name AS item FROM part WHERE p_partkey % 4 >= 2")
def useful_bullets(spark, d):
    k = F.col("p_partkey") % 4
    rows = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(k == 0, "See also").when(k == 1, "Notes and references").when(k == 2, "Members").alias("header"), F.col("p_name").alias("item"))
    return catalogue.useful_bullets(rows)


@query("edge_cursor_back", "SELECT o_orderkey AS edge, o_custkey AS arg1 FROM orders WHERE o_orderkey < 900 ORDER BY o_orderkey DESC LIMIT 20")
def edge_cursor_back(spark, d):
    return catalogue.cursor(views.table(spark, d, "orders").select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("arg1")), "edge", 900, 20, True)


@query("concept_cursor_back", "SELECT n_name AS name FROM nation WHERE n_name < 'NATION_2' ORDER BY n_name DESC LIMIT 5")
def concept_cursor_back(spark, d):
    return catalogue.cursor(views.table(spark, d, "nation").select(F.col("n_name").alias("name")), "name", "NATION_2", 5, True)


@query("collection_list", f"WITH {EDGES} SELECT arg1 AS name FROM edges WHERE pred = 'genls' UNION SELECT arg2 FROM edges WHERE pred IN ('genls', 'isa')")
def collection_list(spark, d):
    e = views.edges(spark, d)
    return e.filter("pred = 'genls'").select(F.col("arg1").alias("name")).union(e.filter("pred in ('genls', 'isa')").select("arg2")).distinct()


_WANT = "w AS (SELECT c_custkey AS pattern, 'isa' AS pred, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS arg1, CASE WHEN c_custkey % 3 = 0 THEN n_name END AS arg2 FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("edge_by_args", f"WITH {EDGES}, {_WANT}, f AS (SELECT pattern, min(e.arg1 || '>' || e.arg2) AS edge FROM w JOIN edges e ON e.pred = w.pred AND (w.arg1 IS NULL OR w.arg1 = e.arg1) AND (w.arg2 IS NULL OR w.arg2 = e.arg2) GROUP BY pattern HAVING count(*) = 1) SELECT w.pattern, edge FROM w LEFT JOIN f ON f.pattern = w.pattern")
def edge_by_args(spark, d):
    return _edges_by_args(spark, d, views.table(spark, d, "customer"))


def _edges_by_args(spark, d, customers):
    c = customers.join(views.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    want = c.select(F.col("c_custkey").alias("pattern"), F.lit("isa").alias("pred"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("arg1"), F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).alias("arg2"))
    return catalogue.edge_by_args(want, views.edges(spark, d).withColumn("edge", F.concat("arg1", F.lit(">"), "arg2")))


@query("three_valued_proof", f"{_REC}, {DISJOINT} SELECT n_name AS a, r_name AS b, CASE WHEN up.node IS NOT NULL THEN true WHEN dis.a IS NOT NULL THEN false END AS holds FROM nation CROSS JOIN (SELECT r_name FROM region UNION ALL SELECT 'PROMO') LEFT JOIN up ON up.node = n_name AND up.ancestor = r_name LEFT JOIN dis ON dis.a = least(n_name, r_name) AND dis.b = greatest(n_name, r_name)")
def three_valued_proof(spark, d):
    e = views.edges(spark, d)
    up = graph.closure(graph.of(e, "genls"))
    others = views.table(spark, d, "region").select(F.col("r_name").alias("b")).union(spark.createDataFrame([("PROMO",)], "b string"))
    pairs = views.table(spark, d, "nation").select(F.col("n_name").alias("a")).crossJoin(F.broadcast(others))
    return catalogue.proved(pairs, up, graph.disjoint_pairs(graph.of(e, "disjointWith"), up))


@query("in_ontology", "SELECT CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN '(' || n_name || ' x)' ELSE n_name || ' y' END AS term, n_nationkey % 3 < 2 AS known FROM nation")
def in_ontology(spark, d):
    n = views.table(spark, d, "nation")
    k = F.col("n_nationkey") % 3
    terms = n.select(F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit("("), "n_name", F.lit(" x)"))).otherwise(F.concat("n_name", F.lit(" y"))).alias("term"))
    return catalogue.in_ontology(terms, n.select(F.col("n_name").alias("name")))


@query("aliases", "SELECT c_custkey AS concept, c_name AS alias FROM customer")
def aliases(spark, d):
    e = views.table(spark, d, "customer").select(F.lit("termStrings").alias("pred"), F.col("c_custkey").alias("concept"), resolution.quoted(F.col("c_name")).alias("arg2"))
    return e.filter("pred = 'termStrings'").select("concept", resolution.unquoted(F.col("arg2")).alias("alias"))


@query("useful_terms", "SELECT p_partkey AS id, p_type AS term FROM part WHERE p_partkey % 4 <> 0")
def useful_terms(spark, d):
    return catalogue.useful_terms(views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, "Collection").otherwise(F.col("p_type")).alias("term")))


@query("no_semantic_filter", f"WITH {EDGES}, a AS (SELECT n_name AS subject, 'label' AS relation FROM nation UNION ALL SELECT n_name, 'likes' FROM nation UNION ALL SELECT c_name, 'likes' FROM customer) SELECT subject, relation FROM a WHERE relation = 'label' OR subject NOT IN (SELECT arg2 FROM edges WHERE pred IN ('isa', 'genls'))")
def no_semantic_filter(spark, d):
    n, c = views.table(spark, d, "nation").select(F.col("n_name").alias("subject")), views.table(spark, d, "customer").select(F.col("c_name").alias("subject"))
    a = n.withColumn("relation", F.lit("label")).union(n.withColumn("relation", F.lit("likes"))).union(c.withColumn("relation", F.lit("likes")))
    kids = graph.with_children(n.union(c).select(F.col("subject").alias("concept")), views.edges(spark, d))
    return catalogue.without_semantics(a, spark.createDataFrame([("label",)], "pred string"), kids).select("subject", "relation")


@query("candidate_priority", "SELECT l_orderkey AS article, concept, state, weight, mining_weight, row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, s DESC, mining_weight DESC, concept NULLS FIRST, l_orderkey)::INT AS place FROM (SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE 'c' || l_linenumber END AS concept, ['MAPPED', 'REVERSE_MAPPED', 'CONSISTENT'][l_linenumber % 3 + 1] AS state, l_linenumber % 3 AS s, CAST(l_linenumber % 2 AS DOUBLE) AS weight, 0.5 AS mining_weight FROM lineitem)")
def candidate_priority(spark, d):
    n = F.col("l_linenumber")
    state = F.element_at(F.array(F.lit("MAPPED"), F.lit("REVERSE_MAPPED"), F.lit("CONSISTENT")), n % 3 + 1)
    rows = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article"), F.when(n != 3, F.concat(F.lit("c"), n)).alias("concept"), state.alias("state"), (n % 2).cast("double").alias("weight"), F.lit(0.5).alias("mining_weight")).distinct()
    return catalogue.by_priority(rows, ["article"])


_SPANS = "s AS (SELECT l_orderkey AS id, l_linenumber * 3 AS \"start\", l_linenumber * 3 + 1 + CAST(l_quantity AS INT) % 7 AS \"end\", l_discount AS weight FROM lineitem)"


@query("overlap_winners", f"WITH {_SPANS} SELECT id, \"start\", \"end\", weight FROM s f WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.id = f.id AND b.\"start\" < f.\"end\" AND f.\"start\" < b.\"end\" AND (b.\"end\" - b.\"start\" > f.\"end\" - f.\"start\" OR (b.\"end\" - b.\"start\" = f.\"end\" - f.\"start\" AND (b.weight < f.weight OR (b.weight = f.weight AND b.\"start\" < f.\"start\")))))")
def overlap_winners(spark, d):
    n = F.col("l_linenumber") * 3
    return catalogue.overlap_winners(views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("start"), (n + 1 + F.col("l_quantity").cast("int") % 7).alias("end"), F.col("l_discount").alias("weight")))


@query("anchor_order", f"WITH {LINKS} SELECT src, string_agg(label, '|' ORDER BY length(label) DESC, label) AS labels FROM (SELECT DISTINCT src, label FROM links) GROUP BY src")
def anchor_order(spark, d):
    return views.links(spark, d).groupBy("src").agg(F.array_join(catalogue.longest_first(F.collect_set("label")), "|").alias("labels"))


@query("set_union", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return views.table(spark, d, "customer").select(F.col("c_nationkey").alias("n")).union(views.table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("set_difference", "SELECT o_custkey AS c FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_difference(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("c"), "o_orderstatus")
    return o.filter("o_orderstatus = 'F'").select("c").subtract(o.filter("o_orderstatus = 'O'").select("c"))


@query("merge_mined", "WITH b AS (SELECT l_orderkey AS article_id, bit_or(1 << (l_linenumber % 5)) AS mined, l_orderkey % 3 AS k FROM lineitem GROUP BY l_orderkey), m AS (SELECT article_id, mined FROM b WHERE k <> 0 UNION ALL SELECT article_id, 3 FROM b WHERE k <> 1) SELECT article_id, bit_and(mined) AS mined FROM m GROUP BY article_id")
def merge_mined(spark, d):
    rows = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.expr("shiftleft(1, l_linenumber % 5)").alias("bits"))
    b = mining.produced(rows)
    return catalogue.merge_mined(b.filter("article_id % 3 <> 0"), b.filter("article_id % 3 <> 1").withColumn("mined", F.lit(3)))


@query(
    "merge_information",
    """WITH l AS (SELECT l_orderkey AS article_id, l_linenumber AS n, CASE WHEN l_linenumber > 2 THEN l_returnflag END AS box, l_partkey AS a FROM lineitem),
    r AS (SELECT article_id, 1 AS run, bit_or(1 << n) AS mined, max(box) AS infobox_type, list(a) AS xs FROM l GROUP BY 1 UNION ALL SELECT article_id, 2, bit_or(1 << (n % 3)), max(box) FILTER (WHERE n > 5), list(a) FROM l WHERE n < 7 AND article_id % 3 <> 0 GROUP BY 1)
    SELECT article_id, bit_and(mined) AS mined, max_by(infobox_type, run) FILTER (WHERE infobox_type IS NOT NULL) AS infobox_type, CAST(list_sum(flatten(list(xs))) AS BIGINT) AS assertion_sum, CAST(len(flatten(list(xs))) AS BIGINT) AS assertions FROM r GROUP BY article_id""",
)
def merge_information(spark, d):
    """Two runs over each article, the second without a third of them."""
    li = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").cast("int").alias("n"), F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("box"), F.col("l_partkey").cast("long").alias("a"))
    run = lambda df, bit, box: df.groupBy("article_id").agg(F.bit_or(F.expr(f"shiftleft(1, {bit})")).alias("mined"), F.max(box).alias("infobox_type"), F.collect_list("a").alias("assertions"))
    one, two = run(li, "n", F.col("box")), run(li.filter("n < 7 and article_id % 3 <> 0"), "n % 3", F.when(F.col("n") > 5, F.col("box")))
    out = catalogue.merge_information(one, two)
    return out.select("article_id", "mined", "infobox_type", F.aggregate("assertions", F.lit(0).cast("long"), lambda x, y: x + y).alias("assertion_sum"), F.size("assertions").cast("long").alias("assertions"))


@query("miner_driver", f"WITH {ARTICLES} SELECT article_id, 'title' AS heuristic, 'synonym' AS relation, title AS arg, CAST(0.5 AS DOUBLE) AS weight FROM articles WHERE NOT regexp_matches(title, '^Lists? of .*$') UNION ALL SELECT article_id, 'category', 'birthDate', CAST(1900 + article_id % 90 AS VARCHAR), CAST(2.0 AS DOUBLE) FROM articles")
def miner_driver(spark, d):
    a = views.articles(spark, d).select("article_id", "title")
    born = mining.categories(a.select("article_id", F.lit("Somebody or other").alias("title"), F.concat((F.lit(1900) + F.col("article_id") % 90).cast("string"), F.lit(" births")).alias("category")))
    return catalogue.mined([(mining.title_synonym(a), 0.5), (born, 2.0)])


@query("anchor_synonyms", f"WITH {LINKS} SELECT target, label AS arg FROM links GROUP BY 1, 2 HAVING count(*) >= 2")
def anchor_synonyms(spark, d):
    return catalogue.anchor_synonyms(lookups.labels_with_counts(views.links(spark, d)), 2)


@query("canonical_match", "SELECT DISTINCT a.n_nationkey AS source, b.n_nationkey AS target, CAST(1.0 AS DOUBLE) AS weight FROM nation a JOIN nation b ON a.n_name = b.n_name")
def canonical_match(spark, d):
    n = views.table(spark, d, "nation")
    # The canonical names are variants of themselves; titles stand as they are.
    return mapping.title_match(n.select(F.col("n_nationkey").alias("source"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name")), n.select(F.replace("n_name", F.lit("_"), F.lit(" ")).alias("title"), F.col("n_nationkey").alias("article_id")))


@query("mining_only_candidates", "SELECT c_custkey AS article, c_name AS concept, 'REVERSE_MAPPED' AS state, CAST(1.0 AS DOUBLE) AS weight FROM customer WHERE c_custkey % 2 = 0")
def mining_only_candidates(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("article"), F.col("c_name").alias("concept"))
    return catalogue.known_candidates(c, c.filter("article % 2 = 0"))


@query("sense_search", f"WITH {SENSES} SELECT page_id AS id, 'concept' AS kind, 'C-' || target AS value, round(sum(p), 6) AS weight FROM (SELECT page_id, lower(trim(regexp_extract(html, '<a href=\"/([^\"]*)\">', 1))) AS label FROM pages) t JOIN senses ON senses.label = t.label GROUP BY 1, 3")
def sense_search(spark, d):
    li = views.links(spark, d)
    senses = lookups.senses(li, views.plain_label("target"))
    texts = views.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", '<a href="/([^"]*)">', 1).alias("text"))
    return tidy(resolution.by_sense(texts, senses, li.select(F.col("target").alias("title"), F.concat(F.lit("C-"), "target").alias("concept")).distinct()), "weight")


@query("priority_expansion", "WITH r(id, relation, rl, wr) AS (SELECT o_orderkey, 'likes', 0, 1.0 FROM orders UNION ALL SELECT o_orderkey, 'knows', 1, 0.5 FROM orders), a AS (SELECT l_orderkey AS id, 'p' || l_linenumber AS arg, l_linenumber % 2 AS al, 0.5 AS wa FROM lineitem), b AS (SELECT r.id, relation, arg, rl, al, wr * wa AS w FROM r JOIN a ON r.id = a.id) SELECT id, rl || '.' || al AS path, relation, arg, CAST(w AS DOUBLE) AS weight, row_number() OVER (PARTITION BY id ORDER BY rl, al, w DESC, relation, arg)::INT AS place FROM b")
def priority_expansion(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    rel = o.select("id", F.lit("likes").alias("relation"), F.lit(0).alias("level"), F.lit(1.0).alias("weight")).union(o.select("id", F.lit("knows"), F.lit(1), F.lit(0.5)))
    n = F.col("l_linenumber")
    arg = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("p"), n).alias("arg"), (n % 2).alias("level"), F.lit(0.5).alias("weight"))
    out = catalogue.flattened(catalogue.expand_levels(o, rel, arg))
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "."))


@query("instantiate_self", "SELECT p_partkey AS id, 'C-' || p_partkey || ',' || p_type AS args FROM part")
def instantiate_self(spark, d):
    rows = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.lit("SELF"), F.col("p_type")).alias("args"))
    return consistency.instantiate(rows, F.concat(F.lit("C-"), F.col("id"))).select("id", F.array_join("args", ",").alias("args"))


@query("ground_truths", f"WITH {EDGES} SELECT DISTINCT c_custkey AS module, pred, arg2 AS assertion FROM customer JOIN edges ON arg1 = c_name AND pred IN ('isa', 'genls') WHERE c_custkey % 2 = 0")
def ground_truths(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("module"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("concept"))
    return catalogue.ground_truths(c, views.edges(spark, d))


@query("gold_lines", "SELECT '(isa ' || c_name || ' ' || CAST(c_custkey AS VARCHAR) || ')' AS line FROM customer WHERE c_custkey % 2 = 0")
def gold_lines(spark, d):
    c = views.table(spark, d, "customer")
    lines = c.select(F.concat(F.lit("(isa mapArt('"), "c_custkey", F.lit("') "), "c_custkey", F.lit(")")).alias("line"))
    return lookups.with_gold(lines, c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("article_id"), F.col("c_name").alias("concept")))


@query("relation_predicates", "SELECT p_partkey AS id, 'C-' || p_type AS value, CAST(1.0 AS DOUBLE) AS weight FROM part WHERE p_type < 'N'")
def relation_predicates(spark, d):
    p = views.table(spark, d, "part")
    names = p.select(F.col("p_type").alias("name"), F.concat(F.lit("C-"), "p_type").alias("concept")).distinct()
    return resolution.relation_predicates(p.select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("text")), names, names.filter("name < 'N'").select(F.col("concept").alias("pred")))


@query("repaired_values", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN '''' || p_size END AS value FROM part")
def repaired_values(spark, d):
    k = F.col("p_partkey") % 3
    p = views.table(spark, d, "part")
    names = F.array(*map(F.lit, ("PROMO", "ECONOMY", "LARGE", "STANDARD", "SMALL", "MEDIUM")))
    return p.select(F.col("p_partkey").alias("id"), consistency.repaired(F.when(k == 0, F.col("p_type")).when(k == 1, F.concat(F.lit('"'), "p_size", F.lit('"'))).otherwise("none such"), names).alias("value"))


@query("released_negatives", "SELECT p_partkey AS id, p_type AS key FROM part WHERE p_size <= 40 AND p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING count(*) >= 20 AND sum(CASE WHEN p_size > 10 THEN 1 ELSE 0 END) >= 0.7 * count(*))")
def released_negatives(spark, d):
    from ..streaming import incremental

    p = views.table(spark, d, "part")
    votes = p.select(F.col("p_type").alias("key"), F.when(F.col("p_size") > 10, "big").otherwise("small").alias("value"))
    best = mining.majority(votes, "key", "value", 20, 0.7).filter("value = 'big'")
    return incremental.released(p.filter("p_size <= 40").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("key")), best, "key").select("id", "key")
