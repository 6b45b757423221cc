"""Article and link lookups: scans, titles, labels, senses, link neighbours, categories, triple patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINED_TYPES = ("article", "disambiguation")
LIST_TITLE = r"^Lists? of .*$"


def scan_articles(articles: DataFrame, after: int | None = None, most: int | None = None, types: Sequence[str] | None = MINED_TYPES, descending: bool = False) -> DataFrame:
    """Articles of the given types beyond a start id, at most so many, in order of id."""
    df = articles if types is None else articles.filter(F.col("page_type").isin(*types))
    if after is not None:
        df = df.filter(F.col("article_id") < after if descending else F.col("article_id") > after)
    if most is not None:
        df = df.orderBy(F.desc("article_id") if descending else F.asc("article_id")).limit(most)
    return df


def scan_concepts(concepts: DataFrame, predicates: DataFrame, after: str | None = None) -> DataFrame:
    """Concepts without predicates and ephemeral ones (name starts with a question mark)."""
    df = concepts.filter(~F.col("name").startswith("?"))
    return (df if after is None else df.filter(F.col("name") > after)).join(predicates.select("name"), "name", "left_anti")


def titles_to_ids(titles: DataFrame, articles: DataFrame) -> DataFrame:
    """(title, article_id); null where no article has the title."""
    return titles.join(articles.select("title", "article_id"), "title", "left")


def split_title(title: str) -> tuple[Column, Column]:
    """Short title and context of `Name (context)`."""
    pattern = r"^(.+) \((.+)\)$"
    has = F.col(title).rlike(pattern)
    return F.when(has, F.regexp_extract(title, pattern, 1)).otherwise(F.col(title)), F.when(has, F.regexp_extract(title, pattern, 2))


def is_list_title(title: str) -> Column:
    return F.col(title).rlike(LIST_TITLE)


def labels_with_counts(links: DataFrame) -> DataFrame:
    """(target, label, n)."""
    return links.groupBy("target", "label").agg(F.count(F.lit(1)).alias("n"))


def senses(links: DataFrame, label: Column) -> DataFrame:
    """(label, target, n, p): how often a label leads to each target. One shuffle: the counts of a label meet for the window."""
    counts = links.groupBy(label.alias("label"), "target").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def most_likely_sense(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("label").orderBy(F.desc("n"), "target")
    return found.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def in_links(links: DataFrame) -> DataFrame:
    """(target, inlinks)."""
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("inlinks"))


def out_links(links: DataFrame) -> DataFrame:
    return links.groupBy("src").agg(F.count(F.lit(1)).alias("outlinks"))


def relatedness(links: DataFrame) -> DataFrame:
    """(a, b, relatedness) for pairs of targets with a shared source: shared sources over sources of either.

    Self-join on the source; a source with k targets gives k * (k - 1) / 2 pairs, so k is the page's own link count, not the corpus's.
    """
    one = links.select("src", "target").distinct()
    size = one.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    both = one.select("src", F.col("target").alias("a")).join(one.select("src", F.col("target").alias("b")), "src").filter("a < b")
    shared = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    na, nb = size.select(F.col("target").alias("a"), F.col("n").alias("na")), size.select(F.col("target").alias("b"), F.col("n").alias("nb"))
    return shared.join(na, "a").join(nb, "b").select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("relatedness"))


def annotate(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, at, size, label, target): n-grams of a text that are labels, by an equi-join on the n-gram.

    Only n-grams of as many words as some label has are made.
    """
    sizes = labels.agg(F.collect_set(F.size(F.split("label", " "))).alias("sizes"))
    words = texts.select("id", F.split(F.lower(F.trim("text")), r"\s+").alias("w")).crossJoin(F.broadcast(sizes))
    at = words.select("id", "w", "sizes", F.posexplode("w").alias("at", "_"))
    grams = at.select("id", "at", F.explode(F.filter("sizes", lambda n: n <= F.size("w") - F.col("at"))).alias("size"), "w")
    grams = grams.select("id", "at", "size", F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("label"))
    return grams.join(labels.select("label", "target"), "label")


def longest_annotations(found: DataFrame) -> DataFrame:
    """Of overlapping annotations the longest stays, then the earlier: those that no better one overlaps."""
    b = found.select("id", F.col("at").alias("bat"), F.col("size").alias("bsize"))
    better = (F.col("at") < F.col("bat") + F.col("bsize")) & (F.col("bat") < F.col("at") + F.col("size")) & ((F.col("bsize") > F.col("size")) | ((F.col("bsize") == F.col("size")) & (F.col("bat") < F.col("at"))))
    return found.alias("f").join(b.alias("b"), (F.col("f.id") == F.col("b.id")) & better, "left_anti")


def titled(articles: DataFrame, pattern: str) -> DataFrame:
    return articles.filter(F.col("title").rlike(pattern))


def popular(articles: DataFrame, links: DataFrame, least: int = 1) -> DataFrame:
    """(article_id, title, inlinks) of articles and disambiguations with enough in-links; rank by in-links, then id."""
    return scan_articles(articles).select("article_id", "title").join(in_links(links).filter(F.col("inlinks") >= least), F.col("title") == F.col("target")).drop("target")


def export_text(articles: DataFrame, text: Column) -> DataFrame:
    """(article_id, title, text) of articles to export: no disambiguations, lists, or titles whose last word is in lower case."""
    last = F.element_at(F.split("title", " "), -1)
    return articles.filter((F.col("page_type") == "article") & ~F.lower("title").contains("list of") & ~last.rlike("^[a-z]")).select("article_id", "title", text.alias("text"))


def match(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Bindings of triple patterns such as ('?x', 'status', '?y'): one equi-join for each pattern that shares a variable."""
    out: DataFrame | None = None
    for terms in patterns:
        df, names = triples, {}
        for c, t in zip(("s", "p", "o"), terms):
            if t.startswith("?"):
                if t[1:] in names:
                    df = df.filter(F.col(c) == F.col(names[t[1:]]))
                else:
                    names[t[1:]] = c
            else:
                df = df.filter(F.col(c) == t)
        df = df.select(*[F.col(c).alias(v) for v, c in names.items()])
        if out is None:
            out = df
        else:
            shared = [c for c in out.columns if c in df.columns]
            out = out.join(df, shared) if shared else out.crossJoin(df)
    return out


def match_optional(found: DataFrame, triples: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    more = match(triples, pattern)
    return found.join(more, [c for c in found.columns if c in more.columns], "left")


def ask(found: DataFrame) -> DataFrame:
    """(answer): whether there is a binding; reads until the first."""
    return found.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def without_listed(triples: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Triples whose predicate isn't listed."""
    return triples.join(blacklist.select(F.col("uri").alias("p")).distinct(), "p", "left_anti").select("s", "p", "o")


def with_gold(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """Assertions (line) with mapArt('id') replaced by the article's concept; lines with an unmapped id go."""
    token = r"mapArt\('(\d+)'\)"
    one = lines.withColumn("_ids", F.expr(f"regexp_extract_all(line, r\"{token}\", 1)")).withColumn("_n", F.size("_ids"))
    found = one.select("line", F.explode("_ids").alias("id")).distinct().join(mapping.select(F.col("article_id").cast("string").alias("id"), "concept"), "id")
    names = found.groupBy("line").agg(F.map_from_entries(F.collect_list(F.struct("id", "concept"))).alias("_m"))
    joined = one.join(names, "line", "left").filter((F.col("_n") == 0) | (F.size(F.array_distinct("_ids")) == F.size(F.map_keys("_m"))))
    put = F.aggregate(F.array_distinct("_ids"), F.col("line"), lambda acc, i: F.replace(acc, F.concat(F.lit("mapArt('"), i, F.lit("')")), F.col("_m")[i]))
    return joined.select(put.alias("line"))


def worth_processing(queue: DataFrame, least: float = 0.0, weight: str = "weight") -> DataFrame:
    """Candidates above the weight at which the loop over a queue ends."""
    return queue.filter(F.col(weight) > least)
