"""Document fingerprints by one-permutation MinHash, in DataFrame functions only (operator 3).

Every five-word shingle of a text (words as runs without ASCII white space; a shorter text is one shingle) is
hashed once. The hash's top bits are its bin, and a bin keeps its least hash. An empty bin borrows from another
by optimal densification: hashes of (bin, attempt) name donors until one is filled; after `ATTEMPTS` attempts, which only
sparse texts need, it takes the least of hash(donor value, bin) over all filled bins, which agrees between two
texts just as often. The fingerprint is one hexadecimal digit, the low `BITS` bits, for each bin. Two unlike values share
their digit with chance 2**-BITS; the likeness is corrected for that.

Null and empty texts have the empty fingerprint: like another empty one 1, like others 0. Repeated rows are fingerprinted
each by itself; rows that share a key stand in order of text, descending; a null key comes last. The only document of a table
is followed by itself. A very long text is one row, whose words and hashes are arrays of its task; other columns stay, and working
columns get names that clash with none. Ranges are of ids, so the rows of one id, null among them, stay together. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table

BINS, BITS, SHINGLE, ATTEMPTS = 256, 4, 5, 24
_SHIFT = 64 - (BINS.bit_length() - 1)
_REST = (1 << _SHIFT) - 1


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, _SHIFT)


def add_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of the string column `text`. Each step is a projection of its own, so none is evaluated twice."""
    w, h, s, e, n = fresh(df, "fp_words", "fp_hashes", "fp_sorted", "fp_bins", "fp_filled")
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*keep, F.filter(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "").alias(w))
    df = df.select(*keep, F.transform(w, lambda x: F.xxhash64(x)).alias(w))
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
    one = F.array(F.xxhash64(F.array_join(F.transform(w, lambda x: x.cast("string")), " ")))
    df = df.select(*keep, F.when(F.size(w) >= SHINGLE, grams).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>")).alias(h))
    # A last value in each bin marks it empty where it is also the first: sorting gives the least of all bins in order.
    marks = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda i: F.shiftleft(i, _SHIFT).bitwiseOR(F.lit(_REST)))
    df = df.select(*keep, F.when(F.size(h) > 0, F.sort_array(F.concat(h, marks))).alias(s))
    df = df.select(*keep, F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))).alias(s))
    df = df.select(*keep, F.transform(s, lambda x: F.when(x.bitwiseAND(F.lit(_REST)) != _REST, x)).alias(e))
    df = df.select(*keep, e, F.filter(e, lambda x: x.isNotNull()).alias(n))

    def fill(x: Column, i: Column) -> Column:
        donors = [F.get(e, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(ATTEMPTS)]
        return F.coalesce(x, *donors, F.array_min(F.transform(n, lambda v: F.xxhash64(v, i))))

    digits = F.transform(e, lambda x, i: F.substring(F.lit("0123456789abcdef"), (fill(x, i).bitwiseAND(F.lit((1 << BITS) - 1)) + 1).cast("int"), F.lit(1)))
    return df.select(*keep, F.coalesce(F.array_join(digits, ""), F.lit("")).alias(name))


def likeness(a: str, b: str) -> Column:
    """Corrected share of equal digits of two fingerprints, 0 to 1."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    real = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(real)


#: Rows in a range of ids, about, and the most ranges there are; bounds are looked up in two levels of WIDE each.
RANGE_ROWS, WIDE = 1024, 256


def _ranges(docs: DataFrame, rows: int) -> Column:
    """The range of each id, ascending; a null id's is -1."""
    blocks = min(-(-docs.count() // rows), WIDE * WIDE)
    if blocks < 2:
        return F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    cuts = docs.agg(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], max(10000, 4 * blocks)).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    parts = [cuts[i : i + WIDE] for i in range(0, len(cuts), WIDE)] or [[]]
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("id")))
    coarse = below(F.lit([p[-1] for p in parts[:-1]]).cast("array<bigint>"))
    fine = F.array(*[F.lit(p).cast("array<bigint>") for p in parts])
    return F.when(F.col("id").isNull(), F.lit(-1)).otherwise(coarse * WIDE + below(F.get(fine, coarse)))


def with_next(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(id, text) with next_text and what else docs holds of the next row (prefixed next_), in descending order of id.

    The rows are dealt into ranges of about `rows` ids by approximate quantiles, and each range gets a copy of the first row of
    the one below; so the order needs one shuffle and no window over the whole table. Only bounds and
    first ids, at most WIDE * WIDE of each, come to the driver and are broadcast.
    """
    others = [c for c in docs.columns if c != "id"]
    block = _ranges(docs.select("id"), rows)
    tops = sorted((r.block, r.top) for r in docs.groupBy(block.alias("block")).agg(F.max("id").alias("top")).collect())
    if not tops:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in others])
    target = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    to = F.broadcast(docs.sparkSession.createDataFrame(target, "top long, to int"))
    copies = docs.join(to, F.col("id").eqNullSafe(F.col("top"))).select(*docs.columns, F.col("to").alias("block"), F.lit(1).alias("copy"))
    rows = docs.select("*", block.alias("block"), F.lit(0).alias("copy")).unionByName(copies)
    order = Window.partitionBy("block").orderBy("copy", F.desc_nulls_last("id"), F.desc("text"))
    return rows.select("id", *others, "copy", *[F.lead(c).over(order).alias(f"next_{c}") for c in others]).filter("copy = 0").drop("copy")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(add_fingerprint(docs, "text", "fingerprint"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.select("id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)).alias("edited"), "fingerprint", "next_fingerprint")
    rows = add_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
