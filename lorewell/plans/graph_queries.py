"""Queries over the ontology graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, mapping
from ..sources import views
from .base import DISJOINT, EDGES, LINKS, UP, query, tidy

_REC = f"WITH RECURSIVE {EDGES}, {UP}"


def _edges(spark, d):
    return views.edges(spark, d)


def _up(spark, d):
    return graph.closure(graph.of(_edges(spark, d), "genls"))


def _disjoint(spark, d):
    e = _edges(spark, d)
    return graph.disjoint_pairs(graph.of(e, "disjointWith"), graph.closure(graph.of(e, "genls")))


@query("genls_closure", f"{_REC} SELECT node, ancestor, depth FROM up")
def genls_closure(spark, d):
    return _up(spark, d)


@query("isa_closure", f"{_REC} SELECT DISTINCT e.arg1 AS instance, ancestor AS collection FROM edges e JOIN up ON e.arg2 = node WHERE pred = 'isa'")
def isa_closure(spark, d):
    e = _edges(spark, d)
    return graph.isa_closure(graph.of(e, "isa"), graph.closure(graph.of(e, "genls")))


@query(
    "minimal_parents",
    f"""{_REC}, m AS (SELECT DISTINCT e.arg1 AS key, ancestor AS member FROM edges e JOIN up ON e.arg2 = node WHERE pred = 'isa')
    SELECT key, member FROM m WHERE NOT EXISTS (SELECT 1 FROM m o JOIN up ON up.node = o.member AND up.ancestor = m.member AND up.depth > 0 WHERE o.key = m.key)""",
)
def minimal_parents(spark, d):
    e = _edges(spark, d)
    up = graph.closure(graph.of(e, "genls"))
    all_ = graph.isa_closure(graph.of(e, "isa"), up).select(F.col("instance").alias("key"), F.col("collection").alias("member"))
    return graph.minimal(all_, up).select("key", "member")


@query("siblings", f"WITH {EDGES} SELECT DISTINCT a.arg1 AS node, b.arg1 AS sibling FROM edges a JOIN edges b ON a.arg2 = b.arg2 AND a.pred = 'genls' AND b.pred = 'genls' WHERE a.arg1 <> b.arg1")
def siblings(spark, d):
    return graph.siblings(graph.of(_edges(spark, d), "genls"))


@query("subtree", f"{_REC} SELECT node, depth FROM up WHERE ancestor = 'ASIA'")
def subtree(spark, d):
    return graph.subtree(_up(spark, d), "ASIA")


@query("find_edges", f"WITH {EDGES} SELECT pred, arg1, arg2 FROM edges WHERE pred = 'isa' AND arg2 = 'NATION_2'")
def find_edges(spark, d):
    return graph.find_edges(_edges(spark, d), {0: "isa", 2: "NATION_2"})


@query("edges_touching", f"WITH {EDGES} SELECT pred, arg1, arg2 FROM edges WHERE (arg1 = 'ASIA' OR arg2 = 'ASIA') AND pred <> 'disjointWith'")
def edges_touching(spark, d):
    return graph.touching(_edges(spark, d), "ASIA", ("disjointWith",))


@query("common_ancestors", f"{_REC} SELECT a.ancestor FROM up a JOIN up b ON a.ancestor = b.ancestor WHERE a.node = 'NATION_2' AND b.node = 'NATION_7'")
def common_ancestors(spark, d):
    return graph.common_ancestors(_up(spark, d), "NATION_2", "NATION_7")


@query("justify", "SELECT 'NATION_2>ASIA>Thing' AS path")
def justify(spark, d):
    return graph.justify(graph.of(_edges(spark, d), "genls"), "NATION_2", "Thing").select(F.array_join("path", ">").alias("path"))


@query("disjoint_closure", f"{_REC}, {DISJOINT} SELECT a, b FROM dis")
def disjoint_closure(spark, d):
    return _disjoint(spark, d)


@query("pairwise_nondisjoint", f"{_REC}, {DISJOINT}, p AS (SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_name < y.n_name EXCEPT SELECT a, b FROM dis) SELECT a, b FROM p UNION ALL SELECT b, a FROM p")
def pairwise_nondisjoint(spark, d):
    return graph.non_disjoint(views.table(spark, d, "nation").select(F.col("n_name").alias("term")), _disjoint(spark, d))


@query("recheck_pairs", f"{_REC}, {DISJOINT}, p AS (SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name) SELECT a, b FROM p EXCEPT SELECT a, b FROM dis")
def recheck_pairs(spark, d):
    n = views.table(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_name").alias("b"))
    return graph.recheck(a.join(b, "n_regionkey").select("a", "b"), _disjoint(spark, d))


@query(
    "disjoint_diff",
    f"""{_REC}, {DISJOINT}, b AS (SELECT a AS key, b AS value FROM dis WHERE length(a) % 2 = 0), a AS (SELECT a AS key, b AS value FROM dis WHERE length(b) % 2 = 0)
    SELECT key, value, '-' AS sign FROM (FROM b EXCEPT FROM a) UNION ALL SELECT key, value, '+' FROM (FROM a EXCEPT FROM b)""",
)
def disjoint_diff(spark, d):
    rows = _disjoint(spark, d).select(F.col("a").alias("key"), F.col("b").alias("value"))
    return graph.cluster_diff(rows.filter("length(key) % 2 = 0"), rows.filter("length(value) % 2 = 0"))


@query(
    "sibling_lift",
    f"""{_REC}, {DISJOINT}, both_ AS (SELECT a AS child, b AS other FROM dis UNION ALL SELECT b, a FROM dis), kids AS (SELECT DISTINCT arg1 AS child, arg2 AS parent FROM edges WHERE pred = 'genls'),
    h AS (SELECT parent, other, count(DISTINCT kids.child) AS hits FROM kids JOIN both_ ON kids.child = both_.child GROUP BY 1, 2), s AS (SELECT parent, count(DISTINCT child) AS n FROM kids GROUP BY 1)
    SELECT h.parent, other, hits + 1 AS disjoint, n + 1 AS children, round((hits + 1) * 1.0 / (n + 1), 6) AS lift FROM h JOIN s ON h.parent = s.parent""",
)
def sibling_lift(spark, d):
    return tidy(graph.sibling_lift(_disjoint(spark, d), graph.of(_edges(spark, d), "genls")), "lift")


_PAIRS = "p AS (SELECT a, r_name AS b FROM (SELECT n_name AS a FROM nation UNION ALL SELECT c_name FROM customer), region UNION ALL SELECT n_name, 'Customer#000000001' FROM nation)"
_BROAD = "broad AS (SELECT node, ancestor FROM up UNION ALL SELECT DISTINCT e.arg1, up.ancestor FROM edges e JOIN up ON up.node = e.arg2 WHERE e.pred = 'isa')"


def _named_pairs(spark, d):
    """Nations and customers with every region, and nations with one customer, which is no collection."""
    nations, regions = views.table(spark, d, "nation").select(F.col("n_name").alias("a")), F.broadcast(views.table(spark, d, "region").select(F.col("r_name").alias("b")))
    return nations.union(views.table(spark, d, "customer").select("c_name")).crossJoin(regions).union(nations.withColumn("b", F.lit("Customer#000000001")))


@query(
    "semantic_distance",
    f"""{_REC}, n AS (SELECT count(DISTINCT node) AS n FROM up), {_PAIRS}, {_BROAD},
    size AS (SELECT node, count(*) AS s FROM broad GROUP BY node), once AS (SELECT DISTINCT node, ancestor FROM broad),
    k AS (SELECT p.a, p.b, count(*) AS shared FROM p JOIN once u ON u.node = p.a JOIN once v ON v.node = p.b AND v.ancestor = u.ancestor GROUP BY 1, 2)
    SELECT p.a, p.b, CASE WHEN p.b NOT IN (SELECT node FROM up) THEN -1.0 ELSE round((greatest(coalesce(sa.s, 0), coalesce(sb.s, 0)) - coalesce(shared, 0)) * 1.0 / (n.n - least(coalesce(sa.s, 0), coalesce(sb.s, 0))), 6) END AS distance
    FROM p LEFT JOIN size sa ON sa.node = p.a LEFT JOIN size sb ON sb.node = p.b LEFT JOIN k ON k.a = p.a AND k.b = p.b, n""",
)
def semantic_distance(spark, d):
    up = _up(spark, d)
    isa = graph.isa_closure(graph.of(_edges(spark, d), "isa"), up)
    return tidy(graph.semantic_distance(_named_pairs(spark, d), up, isa, up.select("node").distinct().count()), "distance")


@query(
    "proof_distance",
    f"""{_REC}, {_PAIRS}, q AS (SELECT node AS a, ancestor AS b, depth AS n FROM up WHERE depth > 0 UNION ALL SELECT e.arg1, ancestor, depth + 1 FROM edges e JOIN up ON node = e.arg2 WHERE pred = 'isa'),
    l AS (SELECT a, b, min(n) AS n FROM q GROUP BY a, b)
    SELECT p.a, p.b, CASE WHEN p.a NOT IN (SELECT node FROM up) THEN -1 ELSE coalesce(n, -1) END AS distance FROM p LEFT JOIN l ON l.a = p.a AND l.b = p.b""",
)
def proof_distance(spark, d):
    return graph.proof_distance(_named_pairs(spark, d), _up(spark, d), graph.of(_edges(spark, d), "isa"))


_CONSTRAINTS = [("buys", 1, "ASIA"), ("buys", 1, "Thing"), ("sells", 1, "EUROPE"), ("knows", 1, "Thing")]
_CONS = "cons(pred, arg_no, collection) AS (VALUES ('buys', 1, 'ASIA'), ('buys', 1, 'Thing'), ('sells', 1, 'EUROPE'), ('knows', 1, 'Thing'))"
_USES = "uses AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'buys' WHEN 1 THEN 'sells' WHEN 2 THEN 'knows' ELSE 'free' END AS pred, 1 AS arg_no, n_name AS arg FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _constraints(spark):
    return spark.createDataFrame(_CONSTRAINTS, "pred string, arg_no int, collection string")


def _uses(spark, d):
    c = views.table(spark, d, "customer").join(views.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    return c.select(F.col("c_custkey").alias("id"), F.when(k == 0, "buys").when(k == 1, "sells").when(k == 2, "knows").otherwise("free").alias("pred"), F.lit(1).alias("arg_no"), F.col("n_name").alias("arg"))


@query("valid_args", f"{_REC}, {_CONS}, {_USES} SELECT u.pred, u.arg_no, u.arg, min(CASE WHEN c.collection IS NULL OR up.node IS NOT NULL THEN 1 ELSE 0 END) = 1 AS valid FROM (SELECT DISTINCT pred, arg_no, arg FROM uses) u LEFT JOIN cons c ON c.pred = u.pred AND c.arg_no = u.arg_no LEFT JOIN up ON up.node = u.arg AND up.ancestor = c.collection GROUP BY 1, 2, 3")
def valid_args(spark, d):
    up = _up(spark, d).select(F.col("node").alias("instance"), F.col("ancestor").alias("collection"))
    return graph.valid_args(_uses(spark, d).select("pred", "arg_no", "arg").distinct(), _constraints(spark), up)


@query("valid_taxonomic_args", """SELECT DISTINCT 'isaGenls' AS pred, 1 + c_custkey % 2 AS arg_no, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN c_name ELSE '"' || c_name || '"' END AS arg, c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_custkey % 2 = 0) AS valid FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT 'unlisted', 1::BIGINT, c_name, false FROM customer""")
def valid_taxonomic_args(spark, d):
    c, n = views.table(spark, d, "customer"), views.table(spark, d, "nation")
    k, quoted = F.col("c_custkey") % 3, F.concat(F.lit('"'), "c_name", F.lit('"'))
    arg = F.when(k == 0, F.col("n_name")).when(k == 1, F.col("c_name")).otherwise(quoted)
    uses = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("isaGenls").alias("pred"), (F.lit(1) + F.col("c_custkey") % 2).alias("arg_no"), arg.alias("arg"))
    uses = uses.union(c.select(F.lit("unlisted"), F.lit(1).cast("long"), "c_name"))
    relations = spark.createDataFrame([("likes",)], "pred string")
    up = _up(spark, d).select(F.col("node").alias("instance"), F.col("ancestor").alias("collection"))
    return graph.valid_uses(uses, _constraints(spark), up, n.select(F.col("n_name").alias("node")), relations)


@query("infoless_predicates", f"WITH {_CONS}, {_USES} SELECT DISTINCT pred FROM uses WHERE pred NOT IN (SELECT pred FROM cons WHERE collection <> 'Thing')")
def infoless_predicates(spark, d):
    return graph.infoless_predicates(_uses(spark, d), _constraints(spark))


@query("assertion_distance", f"{_REC}, {_CONS}, {_USES} SELECT u.id, CAST(coalesce(min(depth), 9.0) AS DOUBLE) AS distance FROM uses u LEFT JOIN cons c ON c.pred = u.pred AND c.arg_no = u.arg_no LEFT JOIN up ON up.node = u.arg AND up.ancestor = c.collection GROUP BY u.id")
def assertion_distance(spark, d):
    return graph.assertion_distance(_uses(spark, d), _constraints(spark), _up(spark, d), 9.0)


@query("useless_concepts", f"WITH {EDGES}, e AS (SELECT arg1 AS node, arg2 AS other FROM edges UNION ALL SELECT arg2, arg1 FROM edges) SELECT node FROM e GROUP BY node HAVING count(*) <= 1 AND min(other) = 'Thing'")
def useless_concepts(spark, d):
    return graph.useless_nodes(_edges(spark, d))


@query("concept_children", f"WITH {EDGES} SELECT concept, concept IN (SELECT arg2 FROM edges WHERE pred IN ('isa', 'genls')) AS has_children FROM (SELECT n_name AS concept FROM nation UNION SELECT c_name FROM customer)")
def concept_children(spark, d):
    concepts = views.table(spark, d, "nation").select(F.col("n_name").alias("concept")).union(views.table(spark, d, "customer").select("c_name")).distinct()
    return graph.with_children(concepts, _edges(spark, d))


@query("assert_remove", f"WITH {EDGES} SELECT pred, arg1, arg2 FROM edges WHERE NOT (pred = 'genls' AND arg2 = 'ASIA') UNION ALL SELECT 'isa', 'Someone', 'NATION_2'")
def assert_remove(spark, d):
    e = _edges(spark, d)
    new = spark.createDataFrame([("isa", "Someone", "NATION_2"), ("isa", "Someone", "NATION_2"), ("genls", "NATION_2", "ASIA")], "pred string, arg1 string, arg2 string")
    return graph.remove_edges(graph.assert_edges(e, new), e.filter("pred = 'genls' and arg2 = 'ASIA'"))


@query("generalised_disjoint", f"{_REC}, {DISJOINT} SELECT arg1 AS a, arg2 AS b FROM edges WHERE pred = 'disjointWith'")
def generalised_disjoint(spark, d):
    return graph.generalise(_disjoint(spark, d), _up(spark, d))


@query(
    "redirect_follow",
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), red AS (SELECT page_id AS src, (page_id * 7 + 14) % n.n AS dst FROM pages, n WHERE page_id % 20 = 1),
    f AS (SELECT page_id % 5 AS source, page_id AS target, 1.0 AS weight FROM pages),
    w(source, pos, weight, k) AS (SELECT source, target, weight, 0 FROM f UNION ALL SELECT source, dst, weight, k + 1 FROM w JOIN red ON pos = src WHERE k < 8)
    SELECT source, pos AS target, CAST(sum(weight) AS DOUBLE) AS weight FROM w WHERE pos NOT IN (SELECT src FROM red) GROUP BY 1, 2""",
)
def redirect_follow(spark, d):
    found = views.table(spark, d, "pages").select((F.col("page_id") % 5).alias("source"), F.col("page_id").alias("target"), F.lit(1.0).alias("weight"))
    return mapping.follow_redirects(found, views.redirects(spark, d))


@query(
    "link_closure",
    f"""WITH RECURSIVE {LINKS}, e AS (SELECT DISTINCT label AS a, lower(target) AS b FROM links WHERE label <> lower(target)),
    w(node, ancestor, depth) AS (SELECT DISTINCT x, x, 0 FROM (SELECT a AS x FROM e UNION SELECT b FROM e) UNION ALL SELECT node, b, depth + 1 FROM w JOIN e ON ancestor = a WHERE depth < 10)
    SELECT node, ancestor, min(depth) AS depth FROM w GROUP BY 1, 2""",
)
def link_closure(spark, d):
    direct = views.links(spark, d).select(F.col("label").alias("arg1"), F.lower("target").alias("arg2")).filter("arg1 <> arg2").distinct()
    return graph.closure(direct)
