"""Near-duplicate documents by HyperMinHash (operator 1).

A document is the set of its distinct `k`-word shingles. Its sketch has `bands * rows` registers; each holds, for the least
hash of the set under that register's hash function, the count of leading zeros and the next `MANTISSA` bits, so
a register is 16 bits whatever the set's size. Bands of compressed registers make candidates; the share of
equal registers, less what two unlike minima agree by chance (registers are rounded), estimates the Jaccard
similarity; candidates above the threshold less `margin` are verified on the whole sets.

Work follows classes of equal sets, so exact copies of any number are one representative. In a bucket
each member is compared with the least one (a star, not all pairs), the links found make components, and only buckets that
still hold members of several components go on: there the members outside the bucket's commonest component
are compared with those of other components, in small buckets as pairs and in large ones in blocks of whole sets. A pair
left out therefore already lies in one component, and no component is missed that a candidate pair would join. The first links are
a forest, whose roots are found by doubling; all later ones join trees, so only they go through components().

With 40 bands of 5 registers a pair of similarity 0.8 shares no band with a chance of 1.3e-7.

Null and empty texts have an empty set and are linked with nothing; so does a null key, whose component is null. Rows
that share a key are classed each by its own text; equal sets are one component, repeated rows among them. A similarity of just
the threshold is a link; of equally likely centres the least is tried first. A very long text is one row: its hashes and its sorted
set, eight bytes a shingle, are held by one task at a time, and blocks of sets shrink as sets grow. Columns beside key and text
stay in near_filter, whatever their names, and are left out elsewhere. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, fresh, spread_join, table, written
from .textbytes import BASE, Words, buffer, grams, inside, mix, slices

MANTISSA = 10
#: Buckets above SMALL members are compared in blocks of BLOCK sets or BLOCK_WORDS shingles; neither leaves any pair out.
SMALL, BLOCK, BLOCK_WORDS = 32, 128, 1 << 21
#: Two unlike minima share leading zeros and mantissa with this chance over 2**MANTISSA, for sets of equal size.
CHANCE = 0.16991948715


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each text, and where each text's begin (one more)."""
    w = Words(raw, off, fold=fold)
    h, n = w.hash, w.counts()
    pos, txt = inside(w.bounds, k, len(h))
    value = grams(h, k)[pos]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            has = n[few] > j
            short[has] = mix(short[has] * np.uint64(BASE) + h[w.bounds[few[has]] + j])
        value, txt = np.concatenate((value, short)), np.concatenate((txt, few))
    order = np.lexsort((value, txt))
    value, txt = value[order], txt[order]
    new = np.ones(len(value), bool)
    new[1:] = (txt[1:] != txt[:-1]) | (value[1:] != value[:-1])
    value, txt = value[new], txt[new]
    return value, np.searchsorted(txt, np.arange(len(off)))


def _functions(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(7919))
    return r.integers(0, 1 << 32, m, dtype=np.uint32), r.integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def registers(value: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """(texts with shingles, m) registers: leading zeros << MANTISSA | mantissa of each function's least hash."""
    xor, odd = _functions(m)
    low = (value >> np.uint64(32)).astype(np.uint32)
    has = np.flatnonzero(np.diff(begin) > 0)
    least = np.empty((m, len(has)), np.uint32)
    step, at = 1 << 15, 0
    while at < len(has):  # runs of texts whose shingles stay in cache
        stop = max(at + 1, int(np.searchsorted(begin[has], begin[has[at]] + step)))
        a, z = begin[has[at]], begin[has[stop - 1] + 1]
        x, starts = low[a:z], begin[has[at:stop]] - a
        for i in range(m):
            y = x ^ xor[i]
            y *= odd[i]
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x85EBCA6B)
            least[i, at:stop] = np.minimum.reduceat(y, starts)
        at = stop
    # frexp of an integer below 2**32 in double precision is exact.
    part, exp = np.frexp(least.astype(np.float64) + 0.5)
    zeros = (32 - exp).clip(0, 32).astype(np.uint16)
    mantissa = ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return np.ascontiguousarray((zeros << np.uint16(MANTISSA) | mantissa).T)


def _sketches(batches, k: int, m: int):
    for batch in batches:
        for b in slices(batch, "text"):
            raw, off = buffer(b.column(1))
            value, begin = shingle_sets(raw, off, k)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value))))
            more = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(0xA0761D6478BD642F)))))
            d1, d2 = (s[begin[1:]] - s[begin[:-1]] for s in (sums, more))
            n = np.diff(begin)
            sketch = registers(value, begin, m).tobytes()
            sizes = np.where(n > 0, 2 * m, 0)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            col = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(sketch)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), col], names=["id", "th", "n", "d1", "d2", "sketch"])


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (rows of uint16), corrected for chance agreement."""
    same = (a == b).mean(axis=1)
    ratio = 4.0 * na * nb / (na + nb).astype(float) ** 2
    chance = CHANCE * ratio / (1 << MANTISSA)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _estimated(batches, m: int):
    for b in batches:
        if not b.num_rows:
            continue
        sk = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, m) for c in ("sx", "sy")]
        nx, ny = (b.column(c).to_numpy().astype(float) for c in ("nx", "ny"))
        yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(estimate(*sk, nx, ny))], names=["x", "y", "est"])


def _sets(batches, k: int):
    """Rows that end in a text, which becomes the set: its distinct shingle hashes, ascending, as raw 64-bit values."""
    for batch in batches:
        for b in slices(batch, "text"):
            value, begin = shingle_sets(*buffer(b.column(b.num_columns - 1)), k)
            raw = memoryview(value.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([raw[8 * begin[i] : 8 * begin[i + 1]] for i in range(b.num_rows)], pa.binary())], names=[*b.schema.names[:-1], "set"])


def _verified(batches, k: int, percent: int):
    """The pairs (x, y, tx, ty) whose texts' whole sets are alike enough."""
    for batch in batches:
        for b in slices(batch, "ty"):
            (p, pb), (q, qb) = (shingle_sets(*buffer(b.column(c)), k) for c in (2, 3))
            ok = []
            for i in range(b.num_rows):
                both = np.concatenate((p[pb[i] : pb[i + 1]], q[qb[i] : qb[i + 1]]))
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(both) - inter))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["x", "y"])


def _bits(sets: list[np.ndarray], universe: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), -(-len(universe) // 64) * 8), np.uint8)
    for r, s in enumerate(sets):
        at = np.searchsorted(universe, s)
        at = at[universe[np.minimum(at, len(universe) - 1)] == s]
        row = np.zeros(len(universe), bool)
        row[at] = True
        packed = np.packbits(row)
        out[r, : len(packed)] = packed
    return out.view(np.uint64)


def _compared(p: pd.DataFrame, percent: int) -> pd.DataFrame:
    """For each outer set, one link to each other component among the rest, by exact overlaps as bit counts."""
    xs, ys = [], []
    outer, rest = p[p["outer"]], p[~p["outer"]]
    if len(outer) and len(rest):
        a, b = ([np.frombuffer(x, np.uint64) for x in d["set"]] for d in (outer, rest))
        universe = np.unique(np.concatenate(a))
        bits_a, bits_b = _bits(a, universe), _bits(b, universe)
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ids, comps = rest["id"].to_numpy(), rest["c"].to_numpy()
        for row, n, i, c in zip(bits_a, na, outer["id"], outer["c"]):
            both = np.bitwise_count(bits_b & row).sum(axis=1).astype(np.int64)
            hit = np.flatnonzero((100 * both >= percent * (nb + n - both)) & (comps != c))
            for h in hit[np.unique(comps[hit], return_index=True)[1]]:
                xs.append(min(i, ids[h]))
                ys.append(max(i, ids[h]))
    return pd.DataFrame({"x": np.array(xs, np.int64), "y": np.array(ys, np.int64)})


def components(edges: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """(id, component): for each node of the edges (x, y) the least node that it reaches.

    Each round every node goes to its least neighbour, if less than itself, and from there to that one's; edges between two
    groups are all that the next round sees, so the table of edges shrinks, and rounds end when it is empty. The rounds'
    maps are then joined from the last to the first.
    """
    edges, edges_at = written(edges.select("x", "y").filter("x <> y").distinct(), f"{name}-edges")
    if not edges.limit(1).count():
        return edges.select(F.col("x").alias("id"), F.col("y").alias("component"))
    maps: list[tuple[DataFrame, str]] = []
    while True:
        both = edges.union(edges.select("y", "x"))
        up = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p"))
        far = up.select(F.col("x").alias("p"), F.col("p").alias("g"))
        maps.append(written(up.join(far, "p").select(F.col("x").alias("id"), F.col("g").alias("to")), f"{name}-map"))
        own = maps[-1][0]
        moved = edges.join(own.select(F.col("id").alias("x"), F.col("to").alias("a")), "x").join(own.select(F.col("id").alias("y"), F.col("to").alias("b")), "y")
        left, left_at = written(moved.filter("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct(), f"{name}-edges")
        drop(spark, edges_at)
        edges, edges_at = left, left_at
        if not edges.limit(1).count():
            break
    out = maps[-1][0]
    for m, _ in maps[-2::-1]:
        out = m.join(out.select(F.col("id").alias("to"), F.col("to").alias("end")), "to", "left").select("id", F.coalesce("end", "to").alias("to"))
    out, _ = written(out.withColumnRenamed("to", "component"), f"{name}-components")
    drop(spark, edges_at, *[at for _, at in maps])
    return out


def roots(parent: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """(id, component) of a forest (id, p) whose parents are less than their children: each round doubles the step."""
    own, at = written(parent.select("id", F.col("p").alias("component"), F.lit(True).alias("moved")), f"{name}-roots")
    while own.filter("moved").limit(1).count():
        far = own.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new, new_at = written(own.join(far, "component", "left").select("id", F.coalesce("far", "component").alias("component"), F.col("far").isNotNull().alias("moved")), f"{name}-roots")
        drop(spark, at)
        own, at = new, new_at
    return own.drop("moved")


class _Search:
    """Candidates, estimates and comparisons over the class representatives `reps` (id, n, sketch) and `texts` (id, text)."""

    def __init__(self, reps: DataFrame, texts: DataFrame, k: int, bands: int, rows: int, percent: int, margin: float, name: str):
        self.reps, self.texts, self.k, self.m, self.percent, self.margin, self.name = reps, texts, k, bands * rows, percent, margin, name
        self.spark = reps.sparkSession
        keys = F.array(*[F.xxhash64(F.substring("sketch", 2 * rows * i + 1, 2 * rows), F.lit(i)) for i in range(bands)])
        self.total = reps.count() * bands
        keyed = reps.select("id", F.explode(keys).alias("key"))
        shared = keyed.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("x < hi").drop("hi")
        self.buckets, self.at = written(spread_join(keyed, shared, ["key"], self.total).filter("x is not null"), f"{name}-buckets")

    def stars(self) -> DataFrame:
        """Pairs (x, y) of each bucket's least member and another, with the estimate, where it is high enough to verify."""
        return self.estimated(self.buckets.filter("x < id").groupBy("id").agg(F.collect_set("x").alias("xs")))

    def estimated(self, centres: DataFrame) -> DataFrame:
        """Pairs (x, y) that are alike enough to verify, with the estimate; centres holds y as id and every x in xs."""
        pairs = self.reps.join(centres, "id").select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"), F.explode("xs").alias("x"))
        # Rows already hold y's sketch, so a centre of very many pairs is a large partition of this join, which adaptive
        # execution splits. A size ratio below the threshold rules a pair out.
        one = self.reps.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
        sized = pairs.join(one, "x").filter(100 * F.least("nx", "ny") >= self.percent * F.greatest("nx", "ny"))
        low, m = self.percent / 100 - self.margin, self.m
        return sized.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(lambda it: _estimated(it, m), "x long, y long, est double").filter(F.col("est") >= low)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (x, y) that pass on their whole sets. y's text joins first, so a frequent x splits as above.

        Texts are shuffled, not sets: they are smaller, and compress.
        """
        k, percent = self.k, self.percent
        tx, ty = self.texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), self.texts.select(F.col("id").alias("y"), F.col("text").alias("ty"))
        return pairs.join(ty, "y").join(tx, "x").select("x", "y", "tx", "ty").mapInArrow(lambda it: _verified(it, k, percent), "x long, y long")

    def mixed(self, labels: DataFrame) -> DataFrame:
        """(key, id, c, members, main) of the buckets that hold several components; main is the commonest."""
        member = self.buckets.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
        # Both steps combine before their shuffle, so one hot bucket spreads.
        sizes = member.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"))
        split = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("n"), F.max_by("c", F.struct("size", -F.col("c"))).alias("main")).filter("parts > 1")
        split = split.select("key", "n", F.col("n").alias("members"), "main")
        return spread_join(member, split, ["key"], self.total).filter("main is not null")

    def blocks(self, left: DataFrame) -> DataFrame:
        """Links (x, y) between components within the large buckets (key, id, c, main), each bucket a part of its main component's cluster.

        Every member outside the main component is compared with every member of the cluster on whole sets, in blocks of at most
        `BLOCK` by `BLOCK` sets and about `BLOCK_WORDS` shingles, so a task's memory grows neither with the cluster nor, beyond one
        row of blocks, with its texts.
        """
        k, percent = self.k, self.percent
        rows = left.groupBy(F.col("main").alias("cluster"), "id", "c").agg(F.lit(1).alias("_")).drop("_").join(self.reps.select("id", F.col("n").alias("words")), "id")
        rows, at = written(rows, f"{self.name}-clusters")
        if not rows.limit(1).count():
            return rows.select(F.col("id").alias("x"), F.col("id").alias("y"))
        fit = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.lit(float(BLOCK_WORDS)) / F.max("words")))
        size = rows.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / fit).alias("all"), F.ceil(F.sum((F.col("c") != F.col("cluster")).cast("int")) / fit).alias("out"))
        rows = rows.join(size, "cluster")
        i, j = F.pmod(F.xxhash64("id", F.lit(1)), F.col("out")), F.pmod(F.xxhash64("id", F.lit(2)), F.col("all"))
        # Sets are made before the rows are repeated: once for each member of a cluster.
        rows = rows.select("cluster", "id", "c", "all", "out", i.alias("i"), j.alias("j")).join(self.texts, "id")
        rows = rows.select("cluster", "id", "c", "all", "out", "i", "j", "text").mapInArrow(lambda it: _sets(it, k), "cluster long, id long, c long, all long, out long, i long, j long, set binary")
        spots = F.transform(F.sequence(F.lit(0).cast("long"), F.col("out") - 1), lambda v: F.struct(v.alias("i"), F.col("j").alias("j"), F.lit(False).alias("outer")))
        own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda v: F.struct(F.col("i").alias("i"), v.alias("j"), F.lit(True).alias("outer")))
        dealt = rows.select("cluster", "id", "c", "set", F.explode(F.when(F.col("c") != F.col("cluster"), F.concat(spots, own)).otherwise(spots)).alias("s")).select("cluster", "s.*", "id", "c", "set")
        links, _ = written(dealt.groupBy("cluster", "i", "j").applyInPandas(lambda p: _compared(p, percent), "x long, y long").distinct(), f"{self.name}-links")
        drop(self.spark, at)
        return links


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, margin: float = 0.15) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, class_id (the least id with an equal set), th (text hash).

    component_id is the least id that links of similarity percent/100 or more reach.
    """
    spark, m = docs.sparkSession, bands * rows
    kv = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kv = kv.withColumn("th", F.xxhash64("text"))
    name, same = "near", ["n", "d1", "d2"]
    facts, facts_at = written(kv.mapInArrow(lambda it: _sketches(it, k, m), "id long, th long, n long, d1 long, d2 long, sketch binary"), f"{name}-sketches")
    whole = facts.filter("n > 0 and id is not null")
    reps, reps_at = written(whole.groupBy(*same).agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")), f"{name}-classes")
    s = _Search(reps, kv.filter("id is not null").select("id", "text"), k, bands, rows, percent, margin, name)
    found, found_at = written(s.stars(), f"{name}-pairs")
    # First the likest centre of each document: the links that pass are a forest, as a centre's id is less than its documents'.
    best = found.groupBy("y").agg(F.max_by("x", F.struct("est", -F.col("x"))).alias("x")).select("x", "y")
    trees = s.verified(best).select(F.col("y").alias("id"), F.col("x").alias("p"))
    labels = roots(trees, spark, name)
    # After that only pairs that still lie in two components count: a document's other centres, and pairs within buckets
    # that hold several components. In small ones members outside the commonest component meet those of
    # others as pairs; in large ones they are compared in blocks, which give links and no candidate rows.
    left, left_at = written(s.mixed(labels), f"{name}-mixed")
    few = left.filter(F.col("members") <= SMALL)
    minor = few.filter("c <> main").select("key", F.col("id").alias("a"), F.col("c").alias("ca"))
    other = few.select("key", F.col("id").alias("b"), F.col("c").alias("cb"))
    # Small buckets bound how many partners a document has here.
    cross = minor.join(other, "key").filter("ca <> cb").groupBy(F.greatest("a", "b").alias("id")).agg(F.collect_set(F.least("a", "b")).alias("xs"))
    own = [labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "xy"]
    away = found.select("x", "y").join(own[1], "y", "left").join(own[0], "x", "left").filter("coalesce(cx, x) <> coalesce(cy, y)").select("x", "y")
    more, more_at = written(s.verified(s.estimated(cross).select("x", "y").union(away)), f"{name}-links")
    large = s.blocks(left.filter(F.col("members") > SMALL))
    links = more.union(large).join(own[1], "y", "left").join(own[0], "x", "left").select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"))
    up = components(links, spark, name)
    drop(spark, found_at, left_at, more_at, s.at)
    class_of = reps.select(*same, "id", "copies").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    class_of = class_of.join(up.select(F.col("id").alias("component"), F.col("component").alias("end")), "component", "left")
    class_of = class_of.select(*same, F.col("id").alias("rep"), F.coalesce("end", "component").alias("component"), F.col("copies").alias("n_rows"))
    out = spread_join(facts.select("id", "th", *same), class_of, same, reps.agg(F.sum("copies")).first()[0] or 0, "n_rows")
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    return out.select("id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component")).otherwise(F.col("id")).alias("component_id"), F.when(linked, F.col("rep")).otherwise(F.col("id")).alias("class_id"), "th")


def near_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """The rows of docs that stay, all columns: of each component that of the least id; rows of equal id and text are one."""
    found = near_components(docs, id_col, text_col, **search).filter(F.col("id").eqNullSafe(F.col("component_id")))
    key, th = fresh(docs, "key", "th")
    none = F.lit(-1 - (1 << 62))
    # A component's least id may stand on rows of several texts: the least text hash stays, and every text without shingles.
    kept = found.groupBy(F.coalesce("id", none).alias(key), (F.col("n_shingles") == 0).alias("bare"), F.when(F.col("id").isNull(), F.col("th")).alias("own")).agg(F.min("th").alias(th)).select(key, th)
    kept, _ = written(kept, "near-kept")
    rows = docs.withColumns({key: F.coalesce(F.col(f"`{id_col}`").cast("long"), none), th: F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))})
    return rows.join(kept, [key, th]).dropDuplicates([key, th]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"), k=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


QUERIES = {"op1_near_dedup": op1_near_dedup}

#: Exact similarity of whole shingle sets, and components by a recursive query.
SQL = {
    "op1_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM m JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * inter >= 80 * (a.n + b.n - inter)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, c.r FROM c JOIN e ON c.doc_id = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept FROM d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id, n.n
"""
}
