"""Registration of queries, and SQL fragments that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) and, where SQL can express it, its DuckDB form."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def tidy(df: DataFrame, *doubles: str) -> DataFrame:
    """Doubles to six places, for comparison."""
    return df.withColumns({c: r6(c) for c in doubles})


LINKS = """links AS (SELECT page_id AS src, unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1)) AS target,
  unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 2)) AS label FROM pages)"""
ARTICLES = """articles AS (SELECT page_id AS article_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE page_id % 20 WHEN 0 THEN 'disambiguation' WHEN 1 THEN 'redirect' WHEN 2 THEN 'category' ELSE 'article' END AS page_type FROM pages)"""
EDGES = """edges AS (
  SELECT 'genls' AS pred, n_name AS arg1, r_name AS arg2 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'genls', r_name, 'Thing' FROM region
  UNION ALL SELECT 'genls', p_type, 'Thing' FROM (SELECT DISTINCT p_type FROM part)
  UNION ALL SELECT 'isa', c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'isa', s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'isa', 'Part#' || p_partkey, p_type FROM part
  UNION ALL SELECT 'disjointWith', a.r_name, b.r_name FROM region a JOIN region b ON a.r_name < b.r_name
  UNION ALL SELECT 'disjointWith', a.p_type, b.p_type FROM (SELECT DISTINCT p_type FROM part) a JOIN (SELECT DISTINCT p_type FROM part) b ON a.p_type < b.p_type)"""
UP = """walk(node, ancestor, depth) AS (
  SELECT DISTINCT n, n, 0 FROM (SELECT arg1 AS n FROM edges WHERE pred = 'genls' UNION SELECT arg2 FROM edges WHERE pred = 'genls')
  UNION ALL SELECT w.node, e.arg2, w.depth + 1 FROM walk w JOIN edges e ON e.pred = 'genls' AND e.arg1 = w.ancestor WHERE w.depth < 10),
up AS (SELECT node, ancestor, min(depth) AS depth FROM walk GROUP BY node, ancestor)"""
DISJOINT = """dis AS (SELECT DISTINCT least(x.node, y.node) AS a, greatest(x.node, y.node) AS b FROM edges d
  JOIN up x ON x.ancestor = d.arg1 JOIN up y ON y.ancestor = d.arg2 WHERE d.pred = 'disjointWith' AND x.node <> y.node)"""
VOTES = """votes AS (SELECT o_custkey AS subject, n_name AS target, count(*)::DOUBLE AS weight FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""
EVIDENCE = VOTES + """,
evidence AS (SELECT subject, 'supplier' AS heuristic, target, weight FROM votes
  UNION ALL SELECT c_custkey, 'own', n_name, 1.0 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
TRIPLES = """triples AS (SELECT 'order/' || o_orderkey AS s, 'status' AS p, o_orderstatus AS o FROM orders
  UNION ALL SELECT 'order/' || o_orderkey, 'priority', o_orderpriority FROM orders
  UNION ALL SELECT 'order/' || o_orderkey, 'customer', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 <> 0)"""
GOLD = """gold AS (SELECT l.doc_id, quality = 1 AS truth, least(1.0, n_chars / 4000.0) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
SENSES = LINKS + """,
senses AS (SELECT label, target, n, n * 1.0 / sum(n) OVER (PARTITION BY label) AS p FROM (
  SELECT lower(translate(target, '.,;', '')) AS label, target, count(*) AS n FROM links GROUP BY 1, 2))"""
