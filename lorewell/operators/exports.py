"""Properties, samples, command scripts and export lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_property(props: DataFrame, new: DataFrame) -> DataFrame:
    """(node, prop, value): new values replace those of the same node and property."""
    return props.join(new.select("node", "prop").distinct(), ["node", "prop"], "left_anti").unionByName(new.select(*props.columns))


def remove_property(props: DataFrame, gone: DataFrame) -> DataFrame:
    return props.join(gone.select("node", "prop").distinct(), ["node", "prop"], "left_anti")


def search_property(props: DataFrame, prop: str, pattern: str) -> DataFrame:
    return props.filter((F.col("prop") == prop) & F.col("value").rlike(pattern)).select("node")


def known_runs(edges: DataFrame, props: DataFrame) -> DataFrame:
    """(article, concept, run): recorded mappings with the run that made them; the newest of each article."""
    run = props.filter("prop = 'run'").select(F.col("node").alias("edge"), F.col("value").cast("long").alias("run"))
    rows = edges.join(run, "edge", "left").select("article", "concept", F.coalesce("run", F.lit(0)).alias("run"))
    return rows.groupBy("article").agg(F.max(F.struct("run", "concept")).alias("m")).select("article", "m.concept", "m.run")


def replay(commands: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges after a script of `addedge ( pred arg1 arg2 )` and `removeedge ( … )` lines (no, line); the last command on an edge counts."""
    pattern = r"^(addedge|removeedge) \(\s*(\S+)\s+(\"[^\"]*\"|\S+)\s+(\"[^\"]*\"|\S+)\s*\)$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    plain = lambda c: F.regexp_replace(c, r"^[\"']|\"$", "")
    parsed = commands.filter(F.col("line").rlike(pattern)).select("no", part(1).alias("op"), part(2).alias("pred"), plain(part(3)).alias("arg1"), plain(part(4)).alias("arg2"))
    last = parsed.groupBy("pred", "arg1", "arg2").agg(F.max_by("op", "no").alias("op"))
    key = ["pred", "arg1", "arg2"]
    return edges.select(*key).join(last, key, "left_anti").unionByName(last.filter("op = 'addedge'").select(*key))


def random_pairs(terms: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(a, b): n pairs of unlike terms in canonical order, the same for the same seed: term i of one hash order with term i of another.

    Only 2n rows are ordered, by a top-n for each order.
    """
    from pyspark.sql import Window

    def order(k: int, name: str) -> DataFrame:
        top = terms.select("term").distinct().orderBy(F.xxhash64("term", F.lit(seed), F.lit(k)), "term").limit(2 * n)
        return top.select(F.col("term").alias(name), F.row_number().over(Window.orderBy(F.xxhash64("term", F.lit(seed), F.lit(k)), "term")).alias("_i"))

    both = order(1, "x").join(order(2, "y"), "_i").filter("x <> y")
    return both.orderBy("_i").limit(n).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def weighted_draw(items: DataFrame, by: str, weight: str, draws: DataFrame) -> DataFrame:
    """(draw, item): for each draw u in [0, 1) the item whose share of the cumulative weight holds it. Items are a bounded list of relations."""
    from pyspark.sql import Window

    w = Window.orderBy(by)
    total = F.sum(weight).over(Window.partitionBy())
    spans = items.select(F.col(by).alias("item"), (F.sum(weight).over(w) / total).alias("hi"), ((F.sum(weight).over(w) - F.col(weight)) / total).alias("lo"))
    return draws.join(F.broadcast(spans), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "item")


def impact(replies: DataFrame) -> DataFrame:
    """(n, mean, sd) of the number in `… impact: x` replies."""
    x = F.regexp_extract("reply", r"impact[:=]\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return replies.select(x.alias("x")).filter("x is not null").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))


def converted(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(edges, both): how many edges have an article for both arguments."""
    m = mapping.select("concept", F.lit(1).alias("_")).distinct()
    a, b = m.toDF("arg1", "_a"), m.toDF("arg2", "_b")
    return edges.join(a, "arg1", "left").join(b, "arg2", "left").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)).alias("both"))


def salience(links: DataFrame, mapping: DataFrame, least: int) -> DataFrame:
    """(src, concept): mapped out-links of articles with at least `least` out-links."""
    rich = links.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return links.join(rich, "src", "left_semi").join(mapping.select(F.col("title").alias("target"), "concept"), "target").select("src", "concept").distinct()


def relevant_categories(members: DataFrame) -> DataFrame:
    """(article_id, category): categories whose name holds the article's title."""
    return members.filter(F.contains(F.lower("category"), F.lower("title"))).select("article_id", "category")


def to_process(candidates: DataFrame, processed: DataFrame, is_list: Column) -> DataFrame:
    """Candidates that weren't processed in this run and are no list articles."""
    return candidates.filter(~is_list).join(processed.select("article_id").distinct(), "article_id", "left_anti")


def under_all_parents(concepts: DataFrame, parents: DataFrame, up: DataFrame) -> DataFrame:
    """(concept): those below every parent; a concept without edges (new) passes."""
    asked = parents.select(F.col("parent").alias("ancestor")).distinct().withColumn("_asked", F.lit(1))
    n = asked.count()
    has = up.select("node", "ancestor").distinct().join(asked, "ancestor", "left").groupBy(F.col("node").alias("concept")).agg(F.count("_asked").alias("_n"))
    return concepts.join(has, "concept", "left").filter(F.coalesce(F.col("_n"), F.lit(n)) == n).select("concept")


def word_gap(a_at: Column, a_size: Column, b_at: Column, b_size: Column) -> Column:
    """Words between two spans, negative when the second comes first, 0 where they overlap."""
    return F.when(b_at >= a_at + a_size, b_at - (a_at + a_size) + 1).when(a_at >= b_at + b_size, -(a_at - (b_at + b_size) + 1)).otherwise(0)


def fragment_pairs(spans: DataFrame) -> DataFrame:
    """(id, a, b, gap): all pairs of a text's fragments, a before b."""
    a = spans.select("id", F.col("label").alias("a"), F.col("at").alias("xa"), F.col("size").alias("na"))
    b = spans.select("id", F.col("label").alias("b"), F.col("at").alias("xb"), F.col("size").alias("nb"))
    return a.join(b, "id").filter((F.col("xa") < F.col("xb")) | ((F.col("xa") == F.col("xb")) & (F.col("na") < F.col("nb")))).select("id", "a", "b", word_gap(F.col("xa"), F.col("na"), F.col("xb"), F.col("nb")).alias("gap"))


def focus_column(cells: DataFrame, near: int = 3) -> DataFrame:
    """(table, header): of a table's columns the one named like the list's focus: equal, then a shared stem prefix, then little edit distance."""
    from pyspark.sql import Window

    h, f = F.lower("header"), F.lower("focus")
    score = F.when(h == f, 3).when(F.startswith(f, F.regexp_replace(h, "(s|es|ies)$", "")) & (F.length("header") > 3), 2).when(F.levenshtein(h, f, near) != -1, 1).otherwise(0)
    one = cells.select("table", "header", "focus").distinct().withColumn("_s", score).filter("_s > 0")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("table").orderBy(F.desc("_s"), "header"))).filter("_r = 1").select("table", "header")
