"""Quality rules with cross-document line frequency (operator 9).

Base figures come from each text alone. The cross-document rule hashes every normalised line (ASCII lower
case, digits alike, white space as one space), counts the documents of its host (the source column) that hold it,
and removes a line that more than max(`least`, `share` x the host's documents) hold, but from the document of the
least key that has it. On a host of few documents `least` falls to `half` of them, but not below `fewest`. A line that
only copies of one text hold is no boilerplate, however many they are; it is left to the near-duplicate operator. A document is
depleted, and rejected, when lines went and fewer than `rest_words` words or `rest_share` of its words are left.

Null texts and texts without words have all figures 0 and fail the base rule. Null hosts are one host. Rows that share a key
are judged each by its own text; repeated rows count as documents. A line that exactly as many documents hold as the limit says
stays. A very long text is one row, of which only word and line hashes are kept. Columns beside the three used ones stay in
quality_filter, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, written
from .textbytes import BASE, BASE_INV, Words, _TABLE, buffer, grams, inside, mix, powers, slices, spans_hash

_BREAK = np.zeros(256, bool)
_BREAK[10] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FACTS = "id long, th long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<int>, line_no array<int>"


def per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of marks[bounds[i]:bounds[i+1]]."""
    total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def text_lines(raw: np.ndarray, off: np.ndarray, w: Words) -> tuple[Words, np.ndarray, np.ndarray]:
    """Runs of bytes between line breaks, and the range of words in each."""
    lines = Words(raw, off, _BREAK)
    return lines, np.searchsorted(w.start, lines.start), np.searchsorted(w.start, lines.end)


def repeated_words(w: Words, k: int) -> np.ndarray:
    """For each text, its words in k-word windows found twice or more in it."""
    h = w.hash
    pos, txt = inside(w.bounds, k, len(h))
    cover = np.zeros(len(h) + 1, np.int64)
    if len(pos):
        key = grams(h, k)[pos] ^ mix(txt.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = pos[order[twice]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + k, -1)
    return per_text(np.cumsum(cover)[:-1] > 0, w.bounds)


def _facts(batches, window: int):
    for batch in batches:
        for b in slices(batch, "text"):
            raw, off = buffer(b.column(1))
            w = Words(raw, off)
            lines, first, last = text_lines(raw, off, w)
            has = last > first
            text_of = np.repeat(np.arange(b.num_rows), lines.counts())
            exact = spans_hash(raw, lines.start, lines.end)[has] ^ mix(text_of[has].astype(np.uint64))
            dup = np.ones(int(has.sum()), bool)
            if len(exact):
                dup[np.unique(exact, return_index=True)[1]] = False
            own = np.zeros(len(has), np.int64)
            own[has] = dup
            folded = spans_hash(raw, w.start, w.end, _TABLE[_FOLD])
            pre = np.concatenate((np.zeros(1, np.uint64), np.cumsum(folded * powers(BASE, len(folded)))))
            norm = mix((pre[last] - pre[first]) * powers(BASE_INV, len(folded) + 1)[np.minimum(first, len(folded))])[has]
            number = (np.arange(len(has)) - np.repeat(lines.bounds[:-1], lines.counts()))[has]
            offs = pa.array(np.concatenate(([0], np.cumsum(per_text(has, lines.bounds)))).astype(np.int32))
            char = (raw & 0xC0) != 0x80
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(2), b.column(3), pa.array(w.counts().astype(np.int64)),
                    pa.array(per_text(char & ~_SPACE(raw), off)), pa.array(per_text(_SYMBOL[raw], off)), pa.array(per_text(own, lines.bounds)), pa.array(repeated_words(w, window)),
                    pa.ListArray.from_arrays(offs, pa.array(norm.view(np.int64))), pa.ListArray.from_arrays(offs, pa.array((last - first)[has].astype(np.int32))), pa.ListArray.from_arrays(offs, pa.array(number.astype(np.int32))),
                ],
                names=[x.split()[0] for x in _FACTS.split(", ")],
            )


def _SPACE(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _verdict(batches, rest_words: int, rest_share: float):
    """(…, line_hash, line_words, line_no, frequent) to (…, n_removed_words, removed_lines, depleted)."""
    for b in batches:
        words, lines, gone = b.column("n_words").to_pylist(), list(zip(b.column("line_hash").to_pylist(), b.column("line_words").to_pylist(), b.column("line_no").to_pylist())), b.column("frequent").to_pylist()
        n_gone, numbers, depleted = [], [], []
        for n, (hs, ws, ls), often in zip(words, lines, gone):
            out, total = [], 0
            if often:
                often = set(often)
                for h, c, no in zip(hs, ws, ls):
                    if h in often:
                        total += c
                        out.append(no)
            left = n - total
            n_gone.append(total)
            numbers.append(out)
            depleted.append(bool(total) and (left < rest_words or left < rest_share * n))
        cols = [b.column(c) for c in ("id", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(n_gone, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(depleted, pa.bool_())], names=["id", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "removed_lines", "depleted"])


def quality_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", window: int = 5, min_words: int = 10, repeat_percent: int = 20, least: int = 5, share: float = 0.01, half: float = 0.5, fewest: int = 2, rest_words: int = 10, rest_share: float = 0.3) -> DataFrame:
    """One row for each row of docs: id, th (text hash), base figures, base_failed, n_removed_words, removed_lines, kept."""
    spark = docs.sparkSession
    host = F.col(f"`{host_col}`").cast("string") if host_col and host_col in docs.columns else F.lit(None).cast("string")
    kv = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(host, F.lit("")).alias("host"))
    kv = kv.select("id", "text", F.xxhash64("text").alias("th"), "host")
    facts, _ = written(kv.mapInArrow(lambda it: _facts(it, window), _FACTS), "quality-facts")
    hosts = facts.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    lines = facts.select("id", "th", "host", F.explode(F.array_distinct("line_hash")).alias("line"))
    # Both steps combine before their shuffle, so one hot line or host spreads.
    texts = lines.groupBy("host", "line", "th").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    often = texts.groupBy("host", "line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).filter((F.col("texts") > 1) & (F.col("n") > min(fewest, least)))
    limit = F.greatest(F.least(F.lit(least), F.greatest(F.lit(fewest), F.col("docs") * half)), F.col("docs") * share)
    often = often.join(hosts, "host").filter(F.col("n") > limit).select("host", "line", "first")
    # (host, line) of the frequent lines: they join the lines table, and only theirs are gathered for a document.
    found = lines.join(often, ["host", "line"]).filter(F.coalesce(F.col("id") > F.col("first"), F.lit(True)))
    found, _ = written(found.groupBy("id", "th").agg(F.collect_set("line").alias("frequent")), "quality-lines")
    facts = facts.withColumn("id_", F.coalesce("id", F.lit(-1 - (1 << 62))))
    found = found.select(F.coalesce("id", F.lit(-1 - (1 << 62))).alias("id_"), "th", "frequent")
    joined = facts.join(found, ["id_", "th"], "left").select("id", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words", "line_no", "frequent")
    out = joined.mapInArrow(lambda it: _verdict(it, rest_words, rest_share), "id long, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_removed_words long, removed_lines array<int>, depleted boolean")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("depleted"))


def _cut_lines(batches):
    for batch in batches:
        for b in slices(batch, "text"):
            texts = b.column(1).to_pylist()
            for i, gone in enumerate(b.column(2).to_pylist()):
                if gone:
                    gone, k, out = set(gone), 0, []
                    for line in texts[i].split("\n"):
                        if not line:
                            out.append(line)
                            continue
                        if k not in gone:
                            out.append(line)
                        k += 1
                    texts[i] = "\n".join(out)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The rows of docs that are kept, all columns, without their boilerplate lines."""
    facts, _ = written(quality_facts(docs, id_col, text_col, **rules).filter("kept").select("id", "th", "removed_lines").distinct(), "quality-kept")
    row, th, nid = fresh(docs, "row", "th", "nid")
    rows = docs.select(F.struct(F.lit(0).alias(fresh(docs, "pad")[0]), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias(row), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-1 - (1 << 62))).alias(nid), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias(th))
    facts = facts.select(F.coalesce("id", F.lit(-1 - (1 << 62))).alias(nid), F.col("th").alias(th), "removed_lines")
    joined = rows.join(facts, [nid, th]).select(F.col(row).alias("row"), "text", "removed_lines")
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("text", T.StringType())])
    done = joined.mapInArrow(_cut_lines, kind)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = quality_facts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return facts.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


QUERIES = {"op9_quality_rules": op9_quality_rules}

#: Lines of documents by host on words; the defaults of quality_facts.
SQL = {
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, host, text, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
      FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM d)),
x AS (SELECT *, regexp_replace(translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l WHERE len(w) > 0),
h AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
f AS (SELECT host, norm, count(DISTINCT doc_id) AS n, count(DISTINCT text) AS texts, min(doc_id) AS lo FROM x GROUP BY host, norm),
o AS (SELECT host, norm, lo FROM f JOIN h USING (host) WHERE texts > 1 AND n > 2 AND n > greatest(least(5, greatest(2, docs * 0.5)), docs * 0.01)),
g AS (SELECT doc_id, sum(CASE WHEN o.lo < doc_id THEN len(w) ELSE 0 END) AS gone, sum((k > 1)::INT) AS dup FROM x LEFT JOIN o ON x.host = o.host AND x.norm = o.norm GROUP BY doc_id),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS win, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM p) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(0, 5) AS t(j) GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_removed_words FROM d LEFT JOIN g USING (doc_id) LEFT JOIN rw USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_words - n_removed_words < 0.3 * n_words)) AS kept FROM v
"""
}
