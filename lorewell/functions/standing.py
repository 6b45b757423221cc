"""Standing: how far a thing is a collection or an individual, as weighted tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("INDIVIDUAL", "COLLECTION", "UNKNOWN")


def tally(df: DataFrame, key: Sequence[str], kind: str = "kind", weight: str = "weight") -> DataFrame:
    """(key, ind, coll, unk, total); unknown votes don't count in the total."""
    part = lambda k: F.sum(F.when(F.col(kind) == k, F.col(weight)).otherwise(0.0))
    out = df.groupBy(*key).agg(*[part(k).alias(n) for k, n in zip(KINDS, ("ind", "coll", "unk"))])
    return out.withColumn("total", F.col("ind") + F.col("coll"))


def laplace(weight: Column, total: Column) -> Column:
    return (weight + 1) / (total + 2)


def with_share(df: DataFrame) -> DataFrame:
    """Adds ind_share and coll_share, the smoothed probabilities."""
    return df.withColumns({f"{n}_share": laplace(F.col(n), F.col("total")) for n in ("ind", "coll")})


def against_global(df: DataFrame, overall: DataFrame | None = None) -> DataFrame:
    """Each smoothed share over the overall one, made to sum to 1; total becomes 1.

    Unchanged where the total is 0, where it is 1 and there is no overall row, or where the overall total is 0. `overall` has one
    row, so the join is a broadcast of a few bytes.
    """
    if overall is None:
        gi = gc = F.lit(1.0)
        keep = (F.col("total") == 0) | (F.col("total") == 1)
        joined = df
    else:
        g = overall.select(F.col("ind").alias("_gi"), F.col("coll").alias("_gc"), F.col("total").alias("_gt")).limit(1)
        joined = df.join(F.broadcast(g), how="cross")
        gi, gc = laplace(F.col("_gi"), F.col("_gt")), laplace(F.col("_gc"), F.col("_gt"))
        keep = (F.col("total") == 0) | (F.col("_gt") == 0)
    i, c = laplace(F.col("ind"), F.col("total")) / gi, laplace(F.col("coll"), F.col("total")) / gc
    out = joined.withColumns({"_i": i, "_c": c})
    return out.withColumns(
        {
            "ind": F.when(keep, F.col("ind")).otherwise(F.col("_i") / (F.col("_i") + F.col("_c"))),
            "coll": F.when(keep, F.col("coll")).otherwise(F.col("_c") / (F.col("_i") + F.col("_c"))),
            "total": F.when(keep, F.col("total")).otherwise(1.0),
        }
    ).drop("_i", "_c", "_gi", "_gc", "_gt")


def merge(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Folds tallies of several sources in the order of `order`: an empty left side takes the right one, else both are normalised and added."""
    items = F.array_sort(F.collect_list(F.struct(order, "ind", "coll", "unk", "total")))
    start = F.struct(F.lit(0.0).alias("ind"), F.lit(0.0).alias("coll"), F.lit(0.0).alias("unk"), F.lit(0.0).alias("total"))

    def norm(s: Column, n: str) -> Column:
        i, c = laplace(s["ind"], s["total"]), laplace(s["coll"], s["total"])
        own = {"ind": i, "coll": c}[n] / (i + c)
        return F.when((s["total"] == 0) | (s["total"] == 1), s[n]).otherwise(own)

    def total(s: Column) -> Column:
        return F.when((s["total"] == 0) | (s["total"] == 1), s["total"]).otherwise(1.0)

    def add(a: Column, b: Column) -> Column:
        both = F.struct((norm(a, "ind") + norm(b, "ind")).alias("ind"), (norm(a, "coll") + norm(b, "coll")).alias("coll"), (a["unk"] + b["unk"]).alias("unk"), (total(a) + total(b)).alias("total"))
        return F.when(a["total"] == 0, F.struct(b["ind"].alias("ind"), b["coll"].alias("coll"), (a["unk"] + b["unk"]).alias("unk"), b["total"].alias("total"))).otherwise(both)

    out = df.groupBy(*key).agg(F.aggregate(items, start, add).alias("_s"))
    return out.select(*key, "_s.*")
