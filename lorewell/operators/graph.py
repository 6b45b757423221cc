"""Ontology graph: patterns, closures, minimal elements, disjointness, constraints, distances, changes.

An edge is (pred, arg1, arg2). Closures are rounds of one equi-join of the newest pairs with the direct edges (or, for all nodes, with all pairs
known, which doubles the reach) and an anti-join with what is known; rounds end when nothing is new, so cycles end as well. Each round is a written table.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import written

ROOT = "Thing"


def of(edges: DataFrame, pred: str) -> DataFrame:
    return edges.filter(F.col("pred") == pred).select("arg1", "arg2")


def find_edges(edges: DataFrame, at: dict[int, str], never: list[str] | None = None) -> DataFrame:
    """Edges by node and place (0 predicate, 1 and 2 arguments); `never` excludes nodes anywhere."""
    cols = ["pred", "arg1", "arg2"]
    for i, node in at.items():
        edges = edges.filter(F.col(cols[i]) == node)
    for node in never or []:
        edges = edges.filter((F.col("pred") != node) & (F.col("arg1") != node) & (F.col("arg2") != node))
    return edges


def touching(edges: DataFrame, concept: str, except_preds: tuple[str, ...] = ()) -> DataFrame:
    df = edges.filter((F.col("arg1") == concept) | (F.col("arg2") == concept))
    return df.filter(~F.col("pred").isin(*except_preds)) if except_preds else df


def closure(direct: DataFrame, nodes: DataFrame | None = None, reflexive: bool = True) -> DataFrame:
    """(node, ancestor, depth): shortest way up over (arg1, arg2); `depth` 0 is the node itself."""
    d = written(direct.select("arg1", "arg2").filter("arg1 <> arg2").distinct(), "edges")
    first = nodes.select("node") if nodes is not None else d.select(F.col("arg1").alias("node")).union(d.select(F.col("arg2").alias("node")))
    known = written(first.distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")), "closure")
    if nodes is None:
        known = _doubled(known, d)
        return known if reflexive else known.filter("depth > 0")
    new = known
    for depth in itertools.count(1):
        step = new.join(d, F.col("ancestor") == F.col("arg1")).select("node", F.col("arg2").alias("ancestor")).distinct()
        new = written(step.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if not new.limit(1).count():
            break
        known = known.unionByName(new)
    return known if reflexive else known.filter("depth > 0")


def _doubled(known: DataFrame, direct: DataFrame) -> DataFrame:
    """The closure of all nodes: a way of up to twice the reach is one of exactly the reach and then one within it."""
    known, reach = known.unionByName(direct.select(F.col("arg1").alias("node"), F.col("arg2").alias("ancestor"), F.lit(1).alias("depth"))), 1
    while True:
        far = known.filter(F.col("depth") == reach).select("node", F.col("ancestor").alias("_at"), F.col("depth").alias("_d"))
        near = known.filter("depth > 0").select(F.col("node").alias("_at"), "ancestor", "depth")
        step = far.join(near, "_at").groupBy("node", "ancestor").agg(F.min(F.col("_d") + F.col("depth")).alias("depth"))
        new = written(step.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti").select("node", "ancestor", "depth"), "closure")
        if new.isEmpty():
            return known
        known, reach = known.unionByName(new), 2 * reach


def isa_closure(isa: DataFrame, up: DataFrame) -> DataFrame:
    """(instance, collection): isa followed by the reflexive genls closure."""
    return isa.join(up.select(F.col("node").alias("arg2"), "ancestor"), "arg2").select(F.col("arg1").alias("instance"), F.col("ancestor").alias("collection")).distinct()


def minimal(members: DataFrame, up: DataFrame, key: str = "key", member: str = "member") -> DataFrame:
    """Members of a key below which no other member of the key lies."""
    below = members.select(key, F.col(member).alias("node")).join(up.filter("depth > 0"), "node").select(key, F.col("ancestor").alias(member)).distinct()
    return members.join(below, [key, member], "left_anti")


def siblings(direct: DataFrame) -> DataFrame:
    """(node, sibling): others under a direct parent; a parent's children join on the parent."""
    a, b = direct.select(F.col("arg1").alias("node"), "arg2"), direct.select(F.col("arg1").alias("sibling"), "arg2")
    return a.join(b, "arg2").filter("node <> sibling").select("node", "sibling").distinct()


def subtree(up: DataFrame, root: str) -> DataFrame:
    return up.filter(F.col("ancestor") == root).select("node", "depth")


def common_ancestors(up: DataFrame, a: str, b: str) -> DataFrame:
    one, two = (up.filter(F.col("node") == x).select("ancestor") for x in (a, b))
    return one.join(two, "ancestor", "left_semi")


def justify(direct: DataFrame, node: str, ancestor: str) -> DataFrame:
    """(path): a shortest proof as an array of nodes, or no row."""
    paths = direct.sparkSession.createDataFrame([([node],)], "path array<string>")
    done = paths.filter(F.element_at("path", -1) == ancestor)
    seen = paths.select(F.element_at("path", -1).alias("arg2"))
    while not done.limit(1).count():
        step = paths.withColumn("arg1", F.element_at("path", -1)).join(direct, "arg1").filter(~F.array_contains("path", F.col("arg2")))
        paths = written(step.join(seen, "arg2", "left_anti").groupBy("arg2").agg(F.min(F.concat("path", F.array("arg2"))).alias("path")).select("path"), "paths")
        seen = seen.union(paths.select(F.element_at("path", -1)))
        if not paths.limit(1).count():
            break
        done = paths.filter(F.element_at("path", -1) == ancestor)
    return done.orderBy("path").limit(1)


def disjoint_pairs(declared: DataFrame, up: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs below a declared pair; being disjoint passes down."""
    down = up.select(F.col("node"), F.col("ancestor"))
    left = declared.join(down.select(F.col("node").alias("x"), F.col("ancestor").alias("arg1")), "arg1")
    both = left.join(down.select(F.col("node").alias("y"), F.col("ancestor").alias("arg2")), "arg2").filter("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def non_disjoint(terms: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(a, b), both orders: pairs of the given terms that aren't disjoint. The terms are a query's own, all pairs are its result."""
    t = terms.select("term").distinct()
    pairs = t.select(F.col("term").alias("a")).join(t.select(F.col("term").alias("b")), F.col("a") < F.col("b"))
    one = pairs.join(disjoint, ["a", "b"], "left_anti")
    return one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b")))


def recheck(previous: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Pairs that weren't disjoint before and still aren't."""
    return previous.filter("a < b").join(disjoint, ["a", "b"], "left_anti")


def cluster_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, value, sign): what left (-) and what came (+) in two multimaps; one full join on both columns."""
    b, a = before.select("key", "value").distinct().withColumn("_b", F.lit(1)), after.select("key", "value").distinct().withColumn("_a", F.lit(1))
    both = b.join(a, ["key", "value"], "full_outer").filter("_a is null or _b is null")
    return both.select("key", "value", F.when(F.col("_a").isNull(), "-").otherwise("+").alias("sign"))


def sibling_lift(disjoint: DataFrame, direct: DataFrame) -> DataFrame:
    """(parent, other, disjoint, children, lift): of a parent's children, how many are disjoint from another node; counts start at 1."""
    both = disjoint.union(disjoint.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("child", "other")
    kids = direct.select(F.col("arg1").alias("child"), F.col("arg2").alias("parent")).distinct()
    hits = kids.join(both, "child").groupBy("parent", "other").agg(F.countDistinct("child").alias("hits"))
    sizes = kids.groupBy("parent").agg(F.countDistinct("child").alias("n"))
    out = hits.join(sizes, "parent").select("parent", "other", (F.col("hits") + 1).alias("disjoint"), (F.col("n") + 1).alias("children"))
    return out.withColumn("lift", F.col("disjoint") / F.col("children"))


def valid_args(uses: DataFrame, constraints: DataFrame, closure_of: DataFrame) -> DataFrame:
    """uses (pred, arg_no, arg) with `valid`: an argument belongs to every collection that its place asks for.

    closure_of is (instance, collection); a place without constraints takes any argument.
    """
    asked = uses.join(constraints.select("pred", "arg_no", "collection"), ["pred", "arg_no"], "left")
    has = closure_of.select(F.col("instance").alias("arg"), "collection", F.lit(1).alias("_ok"))
    found = asked.join(has, ["arg", "collection"], "left")
    fits = F.min(F.when(F.col("collection").isNull(), 1).otherwise(F.coalesce("_ok", F.lit(0)))) == 1
    return found.groupBy("pred", "arg_no", "arg").agg(fits.alias("valid"))


def valid_uses(uses: DataFrame, constraints: DataFrame, closure_of: DataFrame, collections: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """valid_args with the rules of isaGenls: no string, anything first, a collection (node) second; with relations (pred) others are invalid."""
    either = F.col("pred") == "isaGenls"
    known = collections.select(F.col("node").alias("arg"), F.lit(True).alias("_coll")).distinct()
    taxonomic = uses.filter(either).select("pred", "arg_no", "arg").distinct().join(known, "arg", "left")
    fits = ~F.col("arg").startswith('"') & ((F.col("arg_no") == 1) | F.coalesce("_coll", F.lit(False)))
    rest = valid_args(uses.filter(~either), constraints, closure_of)
    if relations is not None:
        listed = relations.select("pred", F.lit(True).alias("_rel")).distinct()
        rest = rest.join(listed, "pred", "left").select("pred", "arg_no", "arg", (F.col("valid") & F.coalesce("_rel", F.lit(False))).alias("valid"))
    return taxonomic.select("pred", "arg_no", "arg", fits.alias("valid")).unionByName(rest)


def infoless_predicates(preds: DataFrame, constraints: DataFrame) -> DataFrame:
    """Predicates none of whose places asks for more than the root."""
    real = constraints.filter(F.col("collection") != ROOT).select("pred")
    return preds.select("pred").distinct().join(real, "pred", "left_anti")


def useless_nodes(edges: DataFrame) -> DataFrame:
    """(node): at most one edge, and that leads to the root."""
    ends = edges.select(F.col("arg1").alias("node"), F.col("arg2").alias("other")).union(edges.select(F.col("arg2").alias("node"), F.col("arg1").alias("other")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("other")).filter(f"n <= 1 and other = '{ROOT}'").select("node")


def with_children(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    objects = edges.filter(F.col("pred").isin("isa", "genls")).select(F.col("arg2").alias("concept"), F.lit(True).alias("_has")).distinct()
    return concepts.join(objects, "concept", "left").select("concept", F.coalesce("_has", F.lit(False)).alias("has_children"))


def assert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones; an edge that is there already isn't added."""
    cols = ["pred", "arg1", "arg2"]
    return edges.unionByName(new.select(cols).distinct().join(edges, cols, "left_anti"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("pred", "arg1", "arg2").distinct(), ["pred", "arg1", "arg2"], "left_anti")


def semantic_distance(pairs: DataFrame, up: DataFrame, isa: DataFrame, n_nodes: int) -> DataFrame:
    """(a, b, distance): (larger - shared) / (nodes - smaller) over what lies above each, genls and isa together.

    A collection that is above by both counts twice in a size and once among the shared. 0 for equal terms; -1 where b is no
    collection. `isa` holds (instance, collection) of the whole isa closure.
    """
    broad = up.select("node", "ancestor").union(isa.select("instance", "collection"))
    size = broad.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    ab = pairs.select("a", "b").distinct()
    kinds = up.select(F.col("node").alias("b")).distinct().withColumn("_kind", F.lit(1))
    sized = ab.join(size.select(F.col("node").alias("a"), F.col("size").alias("sa")), "a", "left").join(size.select(F.col("node").alias("b"), F.col("size").alias("sb")), "b", "left").join(kinds, "b", "left")
    once = broad.distinct()
    one, two = once.select(F.col("node").alias("a"), "ancestor"), once.select(F.col("node").alias("b"), "ancestor")
    shared = ab.join(one, "a").join(two, ["b", "ancestor"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sa, sb = (F.coalesce(c, F.lit(0)) for c in ("sa", "sb"))
    d = (F.greatest(sa, sb) - F.coalesce("shared", F.lit(0))) / (F.lit(n_nodes) - F.least(sa, sb))
    return sized.join(shared, ["a", "b"], "left").select("a", "b", F.when(F.col("_kind").isNull(), -1.0).when(F.col("a") == F.col("b"), 0.0).otherwise(d).alias("distance"))


def proof_distance(pairs: DataFrame, up: DataFrame, isa: DataFrame) -> DataFrame:
    """(a, b, distance): steps of the shorter of two proofs, that a is an instance of b (one isa edge, then genls) or below it.

    0 for equal terms, -1 without a proof or where a is no collection. `isa` holds the direct edges (arg1, arg2).
    """
    ab = pairs.select("a", "b").distinct()
    kinds = up.select(F.col("node").alias("a")).distinct().withColumn("_kind", F.lit(1))
    below = up.filter("depth > 0").select(F.col("node").alias("a"), F.col("ancestor").alias("b"), F.col("depth").alias("n"))
    member = isa.select(F.col("arg1").alias("a"), F.col("arg2").alias("node")).join(up, "node").select("a", F.col("ancestor").alias("b"), (F.col("depth") + 1).alias("n"))
    least = below.union(member).groupBy("a", "b").agg(F.min("n").alias("n"))
    d = F.when(F.col("_kind").isNull(), -1).when(F.col("a") == F.col("b"), 0).otherwise(F.coalesce("n", F.lit(-1)))
    return ab.join(least, ["a", "b"], "left").join(kinds, "a", "left").select("a", "b", d.alias("distance"))


def assertion_distance(uses: DataFrame, constraints: DataFrame, up: DataFrame, default: float) -> DataFrame:
    """(id, distance): mean over arguments of the least distance to one of the place's collections; `default` where none is above."""
    asked = uses.join(constraints, ["pred", "arg_no"], "left")
    near = asked.join(up.select(F.col("node").alias("arg"), F.col("ancestor").alias("collection"), "depth"), ["arg", "collection"], "left")
    each = near.groupBy("id", "arg_no").agg(F.coalesce(F.min("depth").cast("double"), F.lit(default)).alias("d"))
    return each.groupBy("id").agg(F.avg("d").alias("distance"))


def generalise(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """Predicted disjoint pairs (a, b) without those that a predicted pair of ancestors implies."""
    lifted = pairs.join(up.select(F.col("node").alias("a"), F.col("ancestor").alias("pa"), F.col("depth").alias("da")), "a").join(up.select(F.col("node").alias("b"), F.col("ancestor").alias("pb"), F.col("depth").alias("db")), "b").filter("da + db > 0")
    known = pairs.select(F.least("a", "b").alias("pa_"), F.greatest("a", "b").alias("pb_"))
    implied = lifted.join(known, (F.least("pa", "pb") == F.col("pa_")) & (F.greatest("pa", "pb") == F.col("pb_"))).select("a", "b").distinct()
    return pairs.join(implied, ["a", "b"], "left_anti")


def ranked_classes(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n, share, rank): how a key's values are spread."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.rank().over(w.orderBy(F.desc("n"))))
