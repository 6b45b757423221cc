"""Removal of passages that also start in an earlier document (operator 8).

A window is `width` consecutive words, known by two Rabin-Karp hashes of 64 bits, whose word hashes and mixing are independent:
two unlike windows among 1e13 share both with a chance below 1e-12. A word goes if a window over
it also occurs in a document of a smaller key. Repeated windows that touch or overlap merge into
maximal intervals.

Most windows occur once, so only those that can repeat are counted as rows. Of the hashes of the
`anchor`-word runs inside a window, the least depends on the window's words alone; a window can only repeat if
that least hash occurs in two documents. Leaving the others out loses nothing:

1. documents with equal word sequences collapse to the one with the least key; in the others each window
   has an earlier copy, so all their words in windows go;
2. the distinct least hashes of each remaining document are counted (a fourteenth as many as windows);
3. windows with a least hash of two documents or more are counted by hash, and each place whose hash has a smaller first
   key is kept;
4. places join their document, merge into intervals, and the words in them are cut out.

Null texts and texts without words have no windows and lose nothing. Documents with a null key take part as if
theirs were the greatest. Rows of equal key are one document each but never earlier than each other. A text of any length is
one row; only its hashes, a few times its size, are held at once, and a word in several repeated windows goes once.
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, fresh, spread_join, table, written
from .textbytes import Words, buffer, grams, inside, mix, slices, sliding_min, spans_hash

_LAST = (1 << 63) - 1
_OTHER = np.random.Generator(np.random.PCG64(52711)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

def _digests(batches, width: int, anchor: int):
    """(id, d1, d2, n_words, anchors): a digest of the word sequence, and the distinct least hashes."""
    for batch in batches:
        for b in slices(batch, "text"):
            raw, off = buffer(b.column(1))
            w = Words(raw, off)
            h, n = w.hash, w.counts()
            place = np.arange(len(h), dtype=np.uint64) - np.repeat(w.bounds[:-1], n).astype(np.uint64)
            keyed = mix(h + place * np.uint64(0x9E3779B97F4A7C15))
            none = np.zeros(1, np.uint64)
            pre1, pre2 = np.concatenate((none, np.cumsum(keyed))), np.concatenate((none, np.cumsum(mix(keyed ^ np.uint64(0x5851F42D4C957F2D)))))
            d1, d2 = (p[w.bounds[1:]] - p[w.bounds[:-1]] for p in (pre1, pre2))
            pos, txt = inside(w.bounds, width, len(h))
            if len(pos):
                least = sliding_min(grams(h, anchor), width - anchor + 1)[pos]
                order = np.lexsort((least, txt))
                t, v = txt[order], least[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
                t, v = t[new], v[new]
            else:
                t, v = txt, np.zeros(0, np.uint64)
            offs = np.searchsorted(t, np.arange(b.num_rows + 1)).astype(np.int32)
            anchors = pa.ListArray.from_arrays(pa.array(offs), pa.array(v.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(n.astype(np.int64)), anchors], names=["id", "th", "d1", "d2", "n_words", "anchors"])


def second(w: Words) -> np.ndarray:
    """Word hashes from other random values for the bytes than Words.hash has."""
    return mix(spans_hash(w.raw, w.start, w.end, _OTHER) ^ np.uint64(0x5851F42D4C957F2D))


def _windows(batches, width: int, anchor: int):
    """(id, h, at) of the windows whose least hash is among the document's shared ones."""
    for batch in batches:
        for b in slices(batch, "text"):
            raw, off = buffer(b.column(1))
            w = Words(raw, off)
            h = w.hash
            pos, txt = inside(w.bounds, width, len(h))
            if not len(pos):
                continue
            least = sliding_min(grams(h, anchor), width - anchor + 1)[pos]
            shared = b.column(2)
            lens = np.diff(shared.offsets.to_numpy())
            flat = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            salt = mix(np.arange(b.num_rows, dtype=np.uint64))
            keep = np.isin(least ^ salt[txt], flat ^ np.repeat(salt, lens))
            pos, txt = pos[keep], txt[keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(txt)), b.column(3).take(pa.array(txt)), pa.array(grams(h, width)[pos].view(np.int64)), pa.array(grams(second(w), width)[pos].view(np.int64)), pa.array((pos - w.bounds[txt]).astype(np.int32))], names=["id", "th", "h", "g", "at"])


def _intervals(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals that windows at these ascending starts cover."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + width
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1] + width


def _apply(batches, width: int, texts: bool):
    """(row, text, copy, ats) to (row, n_words, n_removed, kept_sha256, text without the removed words)."""
    for batch in batches:
        for b in slices(batch, "text"):
            raw, off = buffer(b.column(1))
            w = Words(raw, off)
            n = w.counts()
            copy, ats, was = b.column(2).to_pylist(), b.column(3), b.column(1)
            removed, kept, digests = np.zeros(len(n), np.int64), [], []
            for i in range(b.num_rows):
                a, z = w.bounds[i], w.bounds[i + 1]
                text = raw[off[i] : off[i + 1]].tobytes()
                kept.append(was[i].as_py() if texts else None)
                if copy[i]:
                    at = np.zeros(1, np.int64) if n[i] >= width else np.zeros(0, np.int64)
                    reach = int(n[i])
                else:
                    at = np.unique(np.asarray(ats[i].values if ats[i].is_valid else [], dtype=np.int64))
                    reach = width
                if len(at):
                    gone = np.zeros(n[i], bool)
                    for x, y in zip(*_intervals(at, reach)):
                        gone[x:y] = True
                    removed[i] = gone.sum()
                    left = np.flatnonzero(~gone)
                    words = [text[s:e] for s, e in zip((w.start[a + left] - off[i]).tolist(), (w.end[a + left] - off[i]).tolist())]
                    if texts:
                        kept[-1] = _cut(text, gone, w.start[a:z] - off[i]).decode()
                else:
                    words = text.split()
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            out = [b.column(0), pa.array(n.astype(np.int64)), pa.array(removed), pa.array(digests, pa.string()), *[pa.array(kept, pa.string())] * texts]
            yield pa.RecordBatch.from_arrays(out, names=["row", "n_words", "n_removed", "kept_sha256", "text"][: len(out)])


def _cut(text: bytes, gone: np.ndarray, start: np.ndarray) -> bytes:
    """The text without the removed words; each goes with the white space up to the next word."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    out, last = [], 0
    for x, y in zip(edge[::2], edge[1::2]):
        out.append(text[last : start[x]])
        last = int(start[y]) if y < len(start) else len(text)
    return b"".join([*out, text[last:]])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, anchor: int = 25, texts: bool = True) -> DataFrame:
    """docs with each text replaced by what is left of it (without `texts`: no text column), and n_words, n_removed, kept_sha256.

    All other columns stay; the three new names get underscores where docs has them already. Beyond the written
    tables in the shared folder nothing is kept; shuffles that need texts: one of those that share a least hash, one of all.
    """
    spark = docs.sparkSession
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("id")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    # A document is known by key and text hash, so that rows that share a key aren't mixed up.
    kv = docs.select(id_, text).withColumn("th", F.xxhash64("text"))
    facts, facts_at = written(kv.mapInArrow(lambda it: _digests(it, width, anchor), "id long, th long, d1 long, d2 long, n_words long, anchors array<long>"), "window-anchors")
    same, long_ = ["d1", "d2", "n_words"], facts.filter(F.col("n_words") >= width)
    firsts = long_.groupBy(*same).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select(*same, "lo", "n")
    n_long = long_.count()
    copies, copies_at = written(spread_join(long_.select("id", "th", *same), firsts, same, n_long).filter("id > lo").select("id", "th", F.lit(True).alias("copy")).distinct(), "window-copies")
    alone = facts.filter(F.size("anchors") > 0).join(copies, ["id", "th"], "left_anti").select("id", "th", F.explode("anchors").alias("a"))
    shared = alone.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("a", "lo", "n")
    n_anchors = facts.agg(F.sum(F.size("anchors"))).first()[0] or 0
    listed, listed_at = written(spread_join(alone, shared, ["a"], n_anchors).filter("lo is not null").groupBy("id", "th").agg(F.collect_set("a").alias("shared")), "window-shared")
    wins, wins_at = written(kv.join(listed, ["id", "th"]).select("id", "text", "shared", "th").mapInArrow(lambda it: _windows(it, width, anchor), "id long, th long, h long, g long, at int"), "windows")
    drop(spark, facts_at, listed_at)
    repeats = wins.groupBy("h", "g").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("h", "g", "lo", "n")
    places, places_at = written(spread_join(wins, repeats, ["h", "g"], wins.count()).filter("id > lo").groupBy("id", "th").agg(F.collect_set("at").alias("ats")), "window-places")
    drop(spark, wins_at)
    marks, _ = written(places.join(copies, ["id", "th"], "full_outer"), "window-marks")
    drop(spark, copies_at, places_at)
    rest = [c for c in docs.columns if c != text_col]
    row = F.struct(F.lit(0).alias(fresh(docs, "pad")[0]), *[F.col(f"`{c}`") for c in rest]).alias("row")
    rows = docs.select(id_, F.col(f"`{text_col}`").cast("string").alias("text"), row).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.join(marks, ["id", "th"], "left").select("row", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "ats")
    kind = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *[T.StructField("text", T.StringType())] * texts])
    done = joined.mapInArrow(lambda it: _apply(it, width, texts), kind)
    new = fresh(docs, "n_words", "n_removed", "kept_sha256")
    cols = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if texts or c != text_col]
    return done.select(*cols, *[F.col(a).alias(b) for a, b in zip(("n_words", "n_removed", "kept_sha256"), new)])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op8_substring_dedup": op8_substring_dedup}

#: Windows as lists of words.
SQL = {
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i + 49], ' '))) AS win, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS lo FROM p) WHERE lo < doc_id),
g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM r, range(0, 50) AS t(j) GROUP BY doc_id),
k AS (SELECT doc_id, w, gone, list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE kept END, ' ')) AS kept_sha256 FROM k
"""
}
