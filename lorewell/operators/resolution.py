"""Text to concepts: name look-up, numbers, dates, intervals, anchors, function terms, and the pre-processing tree around them.

All results are (id, kind, value, weight) rows; `names` is (name, concept), `mapping` is (title, concept).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weights, wikitext
from ..sources.stores import written
from . import mapping as _mapping


def find_concepts(asked: DataFrame, names: DataFrame, case_sensitive: bool = False, aliases: bool = True) -> DataFrame:
    """(name, concept): concepts of the asked names; without aliases only those whose own name it is."""
    key = (lambda c: F.col(c)) if case_sensitive else (lambda c: F.lower(c))
    n = names.withColumn("_k", key("name"))
    if not aliases:
        n = n.filter(key("name") == key("concept"))
    return asked.select("name", key("name").alias("_k")).join(n.select("_k", "concept").distinct(), "_k").select("name", "concept")


def filtered_concepts(found: DataFrame, allowed: DataFrame) -> DataFrame:
    """Found concepts that a graph query (concept) also gives."""
    return found.join(allowed.select("concept").distinct(), "concept", "left_semi")


def title_fallback(titles: DataFrame, names: DataFrame) -> DataFrame:
    """(source, target, weight) from (source, title): the whole title, else `X (The Y)` for `X (Y)`, else the title without its context."""
    short, context = F.regexp_replace("title", r" \(.*\)$", ""), F.regexp_extract("title", r" \((.*)\)$", 1)
    forms = F.array(F.struct(F.lit(0).alias("level"), F.col("title").alias("n")), F.struct(F.lit(1).alias("level"), F.when(context != "", F.concat(short, F.lit(" (The "), context, F.lit(")"))).alias("n")), F.struct(F.lit(2).alias("level"), short.alias("n")))
    one = titles.select("source", F.inline(forms)).filter("n is not null").select("source", "level", F.lower("n").alias("_k"))
    found = one.join(names.select(F.lower("name").alias("_k"), "concept").distinct(), "_k")
    return weights.best_level(found, ["source"]).select("source", F.col("concept").alias("target"), F.lit(1.0).alias("weight")).distinct()


def numbers(texts: DataFrame) -> DataFrame:
    found = texts.select("id", wikitext.numeric(F.col("text")).alias("n")).filter("n is not null")
    return found.select("id", F.lit("number").alias("kind"), F.col("n").cast("string").alias("value"), F.lit(1.0).alias("weight"))


def strings(texts: DataFrame) -> DataFrame:
    """Texts as quoted strings."""
    return texts.select("id", F.lit("string").alias("kind"), quoted(F.col("text")).alias("value"), F.lit(1.0).alias("weight"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))


def unquoted(c: Column) -> Column:
    return F.when(c.rlike('^".*"$'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('\\"'), F.lit('"'))).otherwise(c)


def dates(texts: DataFrame) -> DataFrame:
    parse = wikitext.column(wikitext.date_template, "struct<year:int,month:int,day:int>")
    d = texts.select("id", parse(F.col("text")).alias("d")).filter("d is not null")
    term = F.concat_ws("-", F.col("d.year").cast("string"), F.lpad(F.col("d.month").cast("string"), 2, "0"), F.lpad(F.col("d.day").cast("string"), 2, "0"))
    return d.select("id", F.lit("date").alias("kind"), term.alias("value"), F.lit(1.0).alias("weight"))


def intervals(texts: DataFrame) -> DataFrame:
    i = texts.select("id", wikitext.interval(F.col("text")).alias("i")).filter("i is not null")
    return i.select("id", F.lit("interval").alias("kind"), F.concat_ws("..", F.col("i.start").cast("string"), F.col("i.end").cast("string")).alias("value"), F.lit(1.0).alias("weight"))


def named_dates(texts: DataFrame, names: DataFrame, time_intervals: DataFrame) -> DataFrame:
    """Texts that name, letter for letter, a concept that is a time interval."""
    found = texts.select("id", F.col("text").alias("name")).join(names, "name").join(time_intervals.select("concept").distinct(), "concept", "left_semi")
    return found.select("id", F.lit("date").alias("kind"), F.col("concept").alias("value"), F.lit(1.0).alias("weight"))


def by_name(texts: DataFrame, names: DataFrame) -> DataFrame:
    cleaned = texts.select("id", F.lower(wikitext.clean_markup(F.col("text"))).alias("_k"))
    return cleaned.join(names.select(F.lower("name").alias("_k"), "concept").distinct(), "_k").select("id", F.lit("concept").alias("kind"), F.col("concept").alias("value"), F.lit(1.0).alias("weight"))


def by_anchor(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Texts that are one anchor: the recorded concept of its target."""
    target = F.regexp_extract("text", r"^\s*\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]\s*$", 1)
    found = texts.select("id", target.alias("title")).filter("title <> ''").join(mapping.select("title", "concept"), "title")
    return found.select("id", F.lit("concept").alias("kind"), F.col("concept").alias("value"), F.lit(1.0).alias("weight"))


def by_sense(texts: DataFrame, senses: DataFrame, mapping: DataFrame) -> DataFrame:
    """Recorded concepts of the senses of a text, at the sense's share."""
    found = texts.select("id", F.lower(F.trim("text")).alias("label")).join(senses.select("label", F.col("target").alias("title"), "p"), "label").join(mapping.select("title", "concept"), "title")
    return found.groupBy("id", F.lit("concept").alias("kind"), F.col("concept").alias("value")).agg(F.sum("p").alias("weight"))


def function_terms(texts: DataFrame, functions: DataFrame, names: DataFrame, valid: DataFrame) -> DataFrame:
    """Terms (function argument) of `prefix rest`, where `prefix ______` names a function and the rest a valid first argument."""
    w = texts.select("id", F.split(F.trim("text"), r"\s+").alias("w")).filter(F.size("w") > 1)
    cut = w.select("id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("n"))
    parts = cut.select("id", F.lower(F.concat(F.array_join(F.slice("w", F.lit(1), F.col("n")), " "), F.lit(" ______"))).alias("_f"), F.lower(F.array_join(F.slice("w", F.col("n") + 1, F.size("w")), " ")).alias("_k"))
    f = functions.select(F.lower("name").alias("_f"), F.col("concept").alias("function"))
    found = parts.join(f, "_f").join(names.select(F.lower("name").alias("_k"), F.col("concept").alias("arg")).distinct(), "_k").join(valid.select("function", "arg").distinct(), ["function", "arg"], "left_semi")
    return found.select("id", F.lit("concept").alias("kind"), F.concat(F.lit("("), "function", F.lit(" "), "arg", F.lit(")")).alias("value"), F.lit(1.0).alias("weight"))


# --- pre-processing ------------------------------------------------------------------------------------------------


def _commas(c: Column) -> Column:
    return F.transform(F.split(c, r"\s*[,\n]\s*"), lambda x: F.trim(x))


#: Pre-processors in order: each gives the texts that one text becomes; the first that changes a text is used.
PREPROCESSORS: dict[str, Callable[[Column], Column]] = {
    "comma split": _commas,
    "anchor removal": lambda c: F.array(F.regexp_replace(c, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")),
    "bracket removal": lambda c: F.array(F.trim(F.regexp_replace(c, r"\s*\([^()]*\)", ""))),
    "under score": lambda c: F.array(F.replace(c, F.lit("_"), F.lit(" "))),
    "camel case": lambda c: F.array(F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", " ")),
    "last stop": lambda c: F.array(F.regexp_replace(c, r"[.,;:]+$", "")),
}


def preprocess(texts: DataFrame, names: Sequence[str] = tuple(PREPROCESSORS)) -> DataFrame:
    """(id, level, text): a text and, level by level, what pre-processing makes of it.

    At each level the first pre-processor that changes a text replaces it by its outputs; unchanged texts end there. Every level is
    one projection over the written level above, and levels end when no text changes.
    """
    level = texts.select("id", F.lit(0).alias("level"), F.trim("text").alias("text")).filter("text <> ''")
    out = level
    for n in itertools.count(1):
        changed = F.lit(None).cast("array<string>")
        for name in reversed(list(names)):
            made = PREPROCESSORS[name](F.col("text"))
            changed = F.when(made != F.array("text"), made).otherwise(changed)
        level = level.select("id", F.lit(n).alias("level"), F.explode(changed).alias("text")).filter("trim(text) <> ''")
        level = written(level.distinct(), "level")
        if level.isEmpty():
            return out.distinct()
        out = out.unionByName(level)


def resolve(texts: DataFrame, names: DataFrame, mapping: DataFrame | None = None, allow_strings: bool = False, fragment: bool = False, tree: bool = True) -> DataFrame:
    """(id, kind, value, weight): the whole look-up. Of a text's levels the highest that gives anything counts; within it the larger weight."""
    t = preprocess(texts) if tree else texts.select("id", F.lit(0).alias("level"), "text")
    if fragment:
        parts = _mapping.fragments(t.select(F.struct("id", "level").alias("id"), "text")).filter("level > 0")
        t = t.unionByName(parts.select("id.id", (F.col("id.level") + 100 + F.col("level")).alias("level"), F.col("fragment").alias("text")))
    keyed = t.select(F.struct("id", "level").alias("id"), "text")
    found = [numbers(keyed), dates(keyed), intervals(keyed), by_name(keyed, names)]
    if mapping is not None:
        found.append(by_anchor(keyed, mapping))
    if allow_strings:
        found.append(strings(keyed))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    rows = rows.select("id.id", "id.level", "kind", "value", "weight")
    best = weights.best_level(rows, ["id"]).groupBy("id", "kind", "value").agg(F.max("weight").alias("weight"))
    return weights.normalise_max(best, ["id"])


def relation_predicates(relations: DataFrame, names: DataFrame, predicates: DataFrame) -> DataFrame:
    """(id, value, weight): predicates that a relation's text names."""
    return resolve(relations, names).filter("kind = 'concept'").join(predicates.select(F.col("pred").alias("value")).distinct(), "value", "left_semi").select("id", "value", "weight")


def rdf_nodes(triples: DataFrame, names: DataFrame, mapping: DataFrame) -> DataFrame:
    """(s, relation, kind, value): `type` becomes isaGenls, other predicates their name; objects are resources, numbers or strings."""
    relation = F.when(F.col("p") == "type", "isaGenls").otherwise(F.col("p"))
    n = wikitext.numeric(F.col("o"))
    rows = triples.join(mapping.select(F.col("title").alias("o"), "concept"), "o", "left").join(names.select(F.col("name").alias("o"), F.col("concept").alias("named")).groupBy("o").agg(F.min("named").alias("named")), "o", "left")
    value = F.coalesce("concept", "named")
    return rows.select("s", relation.alias("relation"), F.when(value.isNotNull(), "concept").when(n.isNotNull(), "number").otherwise("string").alias("kind"), F.coalesce(value, n.cast("string"), quoted(F.col("o"))).alias("value"))


def link_text(paragraphs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, text): anchors whose target has a concept become [[concept|label]], others their label; pieces are re-assembled in order."""
    piece = r"\[\[[^\[\]]*\]\]|[^\[]+|\["
    p = paragraphs.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(piece), F.lit(0))).alias("at", "piece"))
    target, label = F.regexp_extract("piece", r"^\[\[([^\[\]|]+)", 1), F.regexp_extract("piece", r"^\[\[(?:[^\[\]|]+\|)?([^\[\]|]*)\]\]$", 1)
    p = p.select("id", "at", "piece", target.alias("title"), label.alias("label")).join(mapping.select("title", "concept").distinct(), "title", "left")
    put = F.when(F.col("title") == "", F.col("piece")).when(F.col("concept").isNotNull(), F.concat(F.lit("[["), "concept", F.lit("|"), "label", F.lit("]]"))).otherwise(F.col("label"))
    return p.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", put.alias("t")))), lambda x: x["t"]), "").alias("text"))


def new_names(titles: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, name) for new concepts: the name made from the title, with _1, _2 … where it is taken or asked for twice."""
    make = wikitext.column(wikitext.concept_name, "string")
    base = titles.select("id", make(F.col("title")).alias("base"))
    used = taken.select(F.regexp_extract("name", r"^(.*?)(?:_(\d+))?$", 1).alias("base"), F.coalesce(F.regexp_extract("name", r"_(\d+)$", 1).try_cast("int"), F.lit(0)).alias("k")).groupBy("base").agg((F.max("k") + 1).alias("from"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("id")) - 1
    both = base.join(used, "base", "left").withColumn("k", F.coalesce("from", F.lit(0)) + nth)
    return both.select("id", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("k").cast("string"))).alias("name"))


def anchor_text_search(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, concept): concepts named like the label or the target of an anchor in (id, text)."""
    one = texts.select("id", F.explode(wikitext.anchors("text")).alias("a"))
    words = one.select("id", F.explode(F.array_distinct(F.array(F.lower("a.label"), F.lower("a.target")))).alias("_k"))
    return words.join(names.select(F.lower("name").alias("_k"), "concept").distinct(), "_k").select("id", "concept").distinct()


def lemmatise(texts: DataFrame, lemmas: DataFrame, every: bool = False) -> DataFrame:
    """(id, text): the last word, or every word, replaced by its lemma in (lemma, form); of several lemmas of a form the first.

    id is unique. Runs of white space become one space, words that aren't listed stay as they are.
    """
    table = lemmas.groupBy(F.lower("form").alias("_k")).agg(F.min("lemma").alias("_lemma"))
    words = texts.select("id", F.split("text", r"\s+").alias("_w"))
    if not every:
        last = words.withColumn("_k", F.lower(F.element_at("_w", -1))).join(table, "_k", "left")
        head = F.slice("_w", F.lit(1), F.size("_w") - 1)
        return last.select("id", F.array_join(F.concat(head, F.array(F.coalesce("_lemma", F.element_at("_w", -1)))), " ").alias("text"))
    one = words.select("id", F.posexplode("_w").alias("_i", "_word")).withColumn("_k", F.lower("_word")).join(table, "_k", "left")
    back = one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_lemma", "_word").alias("t")))).alias("_w"))
    return back.select("id", F.array_join(F.col("_w.t"), " ").alias("text"))
