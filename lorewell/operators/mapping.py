"""Entity resolution: suites of heuristics, votes over names and senses, redirects, confirmation, one-to-one matching."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weights
from ..sources.stores import written

#: Weight of the candidate that an article is a new concept.
NEW_CONCEPT = 0.1

#: Heuristics by name; each takes what the caller gives and returns (source, target, weight).
HEURISTICS: dict[str, Callable[..., DataFrame]] = {}


def heuristic(name: str):
    """Registers a mapping heuristic under a name that a configuration may list."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        HEURISTICS[name] = f
        return f

    return add


def configured(lines: Sequence[str]) -> list[str]:
    """Names of a configuration: one a line, `%` begins a comment or a disabled line."""
    return [x.strip() for x in lines if x.strip() and not x.strip().startswith("%")]


def suite(parts: Sequence[tuple[DataFrame, float]], mode: str = "additive", posts: Sequence[Callable[[DataFrame], DataFrame]] = (), cutoff: float = weights.CUTOFF) -> DataFrame:
    """(source, target, weight): heuristics' results combined by sum or maximum, post-processed, best of each source made 1."""
    rows = weights.union_scaled(parts)
    out = (weights.combine_sum if mode == "additive" else weights.combine_max)(rows, ["source", "target"])
    for post in posts:
        out = post(out)
    return weights.normalise_max(out, ["source"], cutoff=cutoff)


def weighted(lines: Sequence[str], known: Mapping[str, object]) -> list[tuple[str, float]]:
    """(name, weight) of a configuration's lines `name` or `name<TAB>weight`; an unknown name is an error."""
    out = []
    for line in configured(lines):
        name, _, factor = (x.strip() for x in line.partition("\t"))
        if name not in known:
            raise KeyError(f"{name!r} isn't one of {sorted(known)}")
        out.append((name, float(factor or 1.0)))
    return out


def called(name: str, f: Callable[..., DataFrame], relations: Mapping[str, object]) -> DataFrame:
    """f with its arguments taken by name from relations; `name.argument` comes before `argument`."""
    own = {k: relations.get(f"{name}.{k}", relations.get(k)) for k in inspect.signature(f).parameters}
    return f(**{k: v for k, v in own.items() if v is not None})


def by_heuristic(name: str, relations: Mapping[str, object]) -> DataFrame:
    """(source, target, weight) of one heuristic by its registered name."""
    return called(name, HEURISTICS[name], relations).select("source", "target", "weight")


def configured_suite(lines: Sequence[str], relations: Mapping[str, object], mode: str = "additive", posts: Sequence[Callable[[DataFrame], DataFrame]] = (), cutoff: float = weights.CUTOFF) -> DataFrame:
    """The suite of the heuristics that a configuration lists, with their weights."""
    return suite([(by_heuristic(n, relations), w) for n, w in weighted(lines, HEURISTICS)], mode, posts, cutoff)


def known_targets(found: DataFrame) -> DataFrame:
    """Post-processor: without targets that aren't known, null or -1."""
    return found.filter(F.col("target").isNotNull() & (F.col("target").cast("string") != "-1"))


def capital(name: Column) -> Column:
    """name with its first letter in upper case, as one letter: no `SS` for a sharp s."""
    first = F.substring(name, 1, 1)
    upper, title = F.upper(first), F.initcap(first)
    one = F.when(F.char_length(upper) <= 1, upper).when(first == "ß", "ẞ").when(F.char_length(title) == 1, title).otherwise(first)
    return F.concat(one, F.substr(name, F.lit(2)))


def lower(text: Column) -> Column:
    """Lower case letter for letter, without a form of its own for the last sigma."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def lowered(name: Column) -> Column:
    """Title forms of a name in words: as it is, and with each run of last words in lower case."""
    words = F.split(name, " ")
    low = lambda i: F.array_join(F.concat(F.slice(words, F.lit(1), F.size(words) - i), F.transform(F.slice(words, F.size(words) - i + 1, i), lower)), " ")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words)), lambda i: F.when(i == 0, name).otherwise(low(i))))


def name_variants(name: Column) -> Column:
    """Title forms of a concept name: camel case split, and with each run of last words in lower case."""
    return lowered(F.regexp_replace(F.translate(name, "_", " "), r"(?<=[a-z0-9])(?=[A-Z])", " "))


@heuristic("title match")
def title_match(concepts: DataFrame, articles: DataFrame, variants: Callable[[Column], Column] = name_variants) -> DataFrame:
    """Concepts (source, name) whose name variants are titles; weight 1.

    Names that are titles already aren't camel case: `lowered` keeps their words, `F.array` takes them as they stand.
    """
    v = concepts.select("source", F.explode(variants(F.col("name"))).alias("title")).distinct()
    return v.join(articles.select("title", F.col("article_id").alias("target")), "title").select("source", "target", F.lit(1.0).alias("weight")).distinct()


@heuristic("synonym vote")
def synonym_vote(names: DataFrame, senses: DataFrame) -> DataFrame:
    """Names (source, label) vote for the senses of the label; votes add, the best is 1."""
    votes = names.join(senses.select("label", F.col("target"), F.col("p").alias("weight")), "label")
    return weights.normalise_max(votes.groupBy("source", "target").agg(F.sum("weight").alias("weight")), ["source"])


@heuristic("label vote")
def label_vote(labels: DataFrame, names: DataFrame) -> DataFrame:
    """Article labels (source, label, n): weight of each label is its share of the commonest; concepts (label, target) of the label get it."""
    shares = weights.normalise_max(labels.groupBy("source", F.lower("label").alias("label")).agg(F.sum("n").cast("double").alias("weight")), ["source"], cutoff=0.0)
    return weights.combine_sum(shares.join(names.select(F.lower("label").alias("label"), "target").distinct(), "label"), ["source", "target"])


@heuristic("context vote")
def context_vote(votes: DataFrame, context: DataFrame, related: DataFrame, most: int = 10) -> DataFrame:
    """Votes times the summed relatedness of the target to at most `most` context articles (source, level, article) of the source."""
    order = Window.partitionBy("source").orderBy("level", "article")
    near = context.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).select("source", "article")
    both = related.select(F.col("a").alias("target"), F.col("b").alias("article"), "relatedness").union(related.select("b", "a", "relatedness"))
    score = votes.join(near, "source").join(both, ["target", "article"]).groupBy("source", "target").agg(F.sum("relatedness").alias("_s"))
    out = votes.join(score, ["source", "target"]).select("source", "target", (F.col("weight") * F.col("_s")).alias("weight"))
    return weights.normalise_max(out, ["source"])


def follow_redirects(found: DataFrame, redirects: DataFrame) -> DataFrame:
    """Targets at the end of their redirect chain; weights that meet add; targets in a cycle go.

    A round doubles how far every redirect reaches. A chain has at most as many hops as there are redirects, so what is open beyond that is a cycle.
    """
    ends = written(redirects.select("src", "dst"), "redirects")
    srcs = ends.select(F.col("src").alias("_mid")).distinct()
    hops, most = 1, srcs.count()
    while hops < most:
        more = ends.join(srcs, F.col("dst") == F.col("_mid"), "left_semi")
        if more.isEmpty():
            break
        on = more.select("src", F.col("dst").alias("_mid")).join(ends.select(F.col("src").alias("_mid"), "dst"), "_mid").select("src", "dst")
        ends, hops = written(ends.join(srcs, F.col("dst") == F.col("_mid"), "left_anti").unionByName(on), "redirects"), 2 * hops
    ends = ends.join(srcs, F.col("dst") == F.col("_mid"), "left_anti")
    rows = found.select("source", "target", "weight")
    plain = rows.join(srcs, F.col("target") == F.col("_mid"), "left_anti")
    moved = rows.join(ends, F.col("target") == F.col("src")).select("source", F.col("dst").alias("target"), "weight")
    return plain.unionByName(moved).groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def expand_disambiguations(found: DataFrame, pages: DataFrame, items: DataFrame) -> DataFrame:
    """Disambiguation targets become the first anchor of each of their items (page, article), at the page's weight; larger weights win."""
    is_dis = pages.filter("page_type = 'disambiguation'").select(F.col("article_id").alias("target"))
    plain = found.join(is_dis, "target", "left_anti").select("source", "target", "weight")
    opened = found.join(is_dis, "target").join(items.select(F.col("page").alias("target"), "article"), "target").select("source", F.col("article").alias("target"), "weight")
    return weights.combine_max(plain.unionByName(opened), ["source", "target"])


def drop_disambiguations(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets that are typed and no disambiguation page."""
    good = pages.filter("page_type is not null and page_type <> 'disambiguation'").select(F.col("article_id").alias("target"))
    return found.join(good, "target", "left_semi").select("source", "target", "weight")


def confirm(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """(article, concept, state, weight): forward (concept, article, weight) and reverse (article, concept, weight) candidates; both agree: the product."""
    f = forward.select("article", "concept", F.col("weight").alias("wf"))
    r = reverse.select("article", "concept", F.col("weight").alias("wr"))
    both = f.join(r, ["article", "concept"], "full_outer")
    state = F.when(F.col("wf").isNotNull() & F.col("wr").isNotNull(), "REVERSE_MAPPED").otherwise("MAPPED")
    return both.select("article", "concept", state.alias("state"), (F.coalesce("wf", F.lit(1.0)) * F.coalesce("wr", F.lit(1.0))).alias("weight"))


def with_new_concepts(found: DataFrame) -> DataFrame:
    """Adds to every article the candidate that it is a new concept (null)."""
    new = found.select("article").distinct().select("article", F.lit(None).cast("string").alias("concept"), F.lit("NEW").alias("state"), F.lit(NEW_CONCEPT).alias("weight"))
    return found.unionByName(new)


def mutual_best(found: DataFrame) -> DataFrame:
    """Pairs that are best for their article and for their concept; ties by the other side's name."""
    a = Window.partitionBy("article").orderBy(F.desc("weight"), "concept")
    c = Window.partitionBy("concept").orderBy(F.desc("weight"), "article")
    return found.withColumns({"_a": F.row_number().over(a), "_c": F.row_number().over(c)}).filter("_a = 1 and _c = 1").drop("_a", "_c")


def greedy_one_to_one(found: DataFrame, rounds: int | None = None) -> DataFrame:
    """(article, concept, weight): rounds of mutual bests, each leaving out what is matched, until no pair is left."""
    left, out, k = written(found.select("article", "concept", "weight"), "pairs"), None, 0
    while rounds is None or k < rounds:
        best = written(mutual_best(left), "matched")
        if not best.limit(1).count():
            break
        out, k = best if out is None else out.unionByName(best), k + 1
        left = written(left.join(best.select("article"), "article", "left_anti").join(best.select("concept"), "concept", "left_anti"), "pairs")
    return out if out is not None else left


def fragments(texts: DataFrame, id_col: str = "id", text_col: str = "text", names: DataFrame | None = None) -> DataFrame:
    """(id, level, fragment): all runs of words of a phrase, longer first (level 0 is the whole); runs that repeat are one.

    With `names` only runs of as many words as some name has, which is all that can be found among them.
    """
    w = texts.select(id_col, F.split(F.trim(text_col), r"\s+").alias("w")).filter("w[0] <> ''")
    if names is None:
        w = w.withColumn("sizes", F.sequence(F.lit(1), F.size("w")))
    else:
        w = w.crossJoin(F.broadcast(names.agg(F.collect_set(F.size(F.split("name", " "))).alias("sizes"))))
    at = w.select(id_col, "w", "sizes", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("a"))
    runs = at.select(id_col, "w", "a", F.explode(F.filter("sizes", lambda n: n <= F.size("w") - F.col("a") + 1)).alias("n"))
    return runs.select(id_col, (F.size("w") - F.col("n")).alias("level"), F.array_join(F.slice("w", F.col("a"), F.col("n")), " ").alias("fragment")).distinct()


def fragment_search(texts: DataFrame, names: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, fragment, concept): the concepts (name, concept) named by the longest fragments that name any."""
    found = fragments(texts, id_col, text_col, names).withColumn("_k", F.lower("fragment")).join(names.select(F.lower("name").alias("_k"), "concept").distinct(), "_k")
    return weights.best_level(found, [id_col]).select(id_col, "fragment", "concept")


def later_than(past: DataFrame, future: DataFrame) -> DataFrame:
    """(source, start, end): pairs of a source's dates with the end later than the start."""
    p, f = past.select("source", F.col("date").alias("start")), future.select("source", F.col("date").alias("end"))
    return p.join(f, "source").filter(F.col("end") > F.col("start"))


def in_time(args: DataFrame, contexts: DataFrame) -> DataFrame:
    """(source, value, context, weight): arguments within the time contexts of their source, weights multiplied."""
    return args.join(contexts.select("source", "context", F.col("weight").alias("_w")), "source").select("source", "value", "context", (F.col("weight") * F.col("_w")).alias("weight"))


def known(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Candidates with the recorded concept of their article, null where there is none."""
    return found.join(mapping.select("article", F.col("concept").alias("known")), "article", "left")
