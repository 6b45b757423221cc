"""Licence scan by diagonal voting, in DataFrame functions only (operator 5).

Words are runs of ASCII digits, letters (A-Z lower-cased) and other than ASCII characters. Every rolling `GRAM`-word hash
of every text joins the templates' hashes and their positions; the templates are a list that the caller gives (by default
about two thousand rows), broadcast up to `BROADCAST` words. A match votes for its diagonal, place in the text less place in the template. Diagonals of one template
that lie at most `SLACK` words apart merge, as words put in or left out shift them. A merged span is verified by the
share of the template's hashes that it has: all of them for phrases, `ENOUGH` for notices and whole texts. A place of a base phrase is one diagonal
with every hash of the phrase.

Null and empty texts have no words, no label and score 0. Repeated rows are scanned each by itself; rows of equal key and
text give equal rows. Spans of equal share tie and give the same score. A text of any length is one row whose words and hashes
are arrays of the task; its votes are rows of their own. Columns beside key and text are left out, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .license_templates import BASE, NOTICES, PHRASES, TEXTS

GRAM, SLACK, ENOUGH, BROADCAST = 3, 8, 0.6, 100_000
#: Template positions are kept as bits, so many in a long.
BITS = 63
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    # lower() is the same for texts of one byte a character, and faster; it would change others.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")


def _grams(w: str) -> Column:
    rolling = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(GRAM)]))
    return F.when(F.size(w) >= GRAM, rolling)


def template_rows(notices=(*NOTICES, *TEXTS)) -> list[tuple]:
    """(template, label, base, need, total, words) of the base phrases, the phrases and the given notices."""
    rows = []
    for i, (label, text) in enumerate([*BASE, *PHRASES, *notices]):
        ws = re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))
        n = len(ws) - GRAM + 1
        rows.append((i, label, i < len(BASE), n if i < len(BASE) + len(PHRASES) else round(n * ENOUGH), n, ws))
    return rows


def templates(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(template, label, base, need, total, t_pos, gram): one row for each rolling hash of each template."""
    df = spark.createDataFrame(rows, "template int, label string, base boolean, need int, total int, ws array<string>")
    return df.select("template", "label", "base", "need", "total", F.posexplode(_grams("ws")).alias("t_pos", "gram"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=(*NOTICES, *TEXTS)) -> DataFrame:
    """One row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kv = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), words(text).alias("w"))
    rolled = kv.select("id", "th", F.posexplode(_grams("w")).alias("pos", "gram"))
    listed = template_rows(notices)
    known = templates(docs.sparkSession, listed)
    votes = rolled.join(F.broadcast(known) if sum(r[4] for r in listed) <= BROADCAST else known, "gram").withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    # Equal rows of one text would vote twice: each template position is one bit, in as many longs as the longest needs.
    seen = [f"seen{i}" for i in range(max(r[4] for r in listed) // BITS + 1)]
    key = ["id", "th", "template", "label", "base", "need", "total"]
    bit = F.expr(f"shiftleft(1L, pmod(t_pos, {BITS}))")
    lines = votes.groupBy(*key, "diagonal").agg(*[F.bit_or(F.when(F.floor(F.col("t_pos") / BITS) == i, bit).otherwise(F.lit(0))).alias(c) for i, c in enumerate(seen)])
    hits = sum((F.bit_count(c) for c in seen), F.lit(0))
    order = Window.partitionBy(*key).orderBy("diagonal")
    lines = lines.withColumn("hits", hits).withColumn("begins", (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int")).withColumn("span", F.sum(F.coalesce("begins", F.lit(1))).over(order))
    spans = lines.groupBy(*key, "span").agg(
        *[F.bit_or(c).alias(c) for c in seen],
        F.sum((F.col("hits") == F.col("total")).cast("long")).alias("whole"),
        F.min(F.when(F.col("hits") == F.col("total"), F.col("diagonal"))).alias("from"),
        F.max(F.when(F.col("hits") == F.col("total"), F.col("diagonal"))).alias("to"),
    )
    spans = spans.withColumn("hits", hits).drop(*seen)
    # A phrase has to stand on one diagonal, a notice may be spread over neighbours.
    found = F.when(F.col("need") == F.col("total"), F.col("whole") > 0).otherwise(F.col("hits") >= F.col("need"))
    base = F.col("base") & (F.col("whole") > 0)
    out = spans.groupBy("id", "th").agg(
        F.sum(F.when(base, F.col("whole")).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.col("from"))).alias("first_word"),
        F.max(F.when(base, F.col("to"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.max(F.when(found, F.col("hits") / F.col("total")).otherwise(F.lit(0.0))).alias("score"),
    )
    none = F.lit(-1 - (1 << 62))
    facts = kv.select("id", "th", F.size("w").cast("long").alias("n_words"), F.coalesce("id", none).alias("key"))
    out = out.withColumn("key", F.coalesce("id", none)).drop("id")
    joined = facts.join(out, ["key", "th"], "left")
    return joined.select("id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_license_scan": op5_license_scan}


def _sql() -> str:
    """The scan on words in place of hashes."""
    lists = ", ".join(f"({t}, '{label}', {base}, {need}, {total}, {ws})" for t, label, base, need, total, ws in template_rows())
    grams = "unnest(list_transform(range(1, len(w) - {0} + 2), lambda i: w[i:i + {0} - 1]))".format(GRAM)
    return f"""
WITH t(template, label, base, need, total, w) AS (VALUES {lists}),
tg AS (SELECT template, label, base, need, total, {grams} AS gram, unnest(range(0, len(w) - {GRAM} + 1)) AS t_pos FROM t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
dg AS (SELECT doc_id, {grams} AS gram, unnest(range(0, len(w) - {GRAM} + 1)) AS pos FROM d WHERE len(w) >= {GRAM}),
l AS (SELECT doc_id, template, label, base, need, total, pos - t_pos AS diagonal, list(t_pos) AS seen, count(*) AS hits FROM dg JOIN tg ON dg.gram = tg.gram GROUP BY ALL),
b AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS begins FROM l),
n AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM b),
s AS (SELECT doc_id, template, label, base, need, total, span, len(list_distinct(flatten(list(seen)))) AS hits,
    count(*) FILTER (WHERE hits = total) AS whole, min(diagonal) FILTER (WHERE hits = total) AS lo, max(diagonal) FILTER (WHERE hits = total) AS hi FROM n GROUP BY doc_id, template, label, base, need, total, span),
f AS (SELECT *, CASE WHEN need = total THEN whole > 0 ELSE hits >= need END AS found FROM s),
o AS (SELECT doc_id, sum(whole) FILTER (WHERE base) AS n_base, min(lo) FILTER (WHERE base) AS first_word, max(hi) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND whole > 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels,
    max(CASE WHEN found THEN hits / total ELSE 0.0 END) AS score FROM f GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN o USING (doc_id)
"""


SQL = {"op5_license_scan": _sql()}
