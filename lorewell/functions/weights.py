"""Weighted sets in long form: rows (key columns, element columns, weight).

Every function is one aggregate or one window over the key, so a plan of several of them on the same key shuffles
once. Aggregates combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights below this share of the best are dropped.
CUTOFF = 0.01


def combine_sum(df: DataFrame, by: Sequence[str], weight: str = "weight") -> DataFrame:
    """Equal elements add their weights."""
    return df.groupBy(*by).agg(F.sum(weight).alias(weight))


def combine_max(df: DataFrame, by: Sequence[str], weight: str = "weight") -> DataFrame:
    """Equal elements keep the largest weight."""
    return df.groupBy(*by).agg(F.max(weight).alias(weight))


def scale(df: DataFrame, factor: float | Column, weight: str = "weight") -> DataFrame:
    return df.withColumn(weight, F.col(weight) * factor)


def union_scaled(parts: Sequence[tuple[DataFrame, float]], weight: str = "weight") -> DataFrame:
    """All rows of the parts, each part's weights times its factor."""
    return reduce(DataFrame.unionByName, [scale(df, F.lit(float(f)), weight) for df, f in parts])


def normalise_max(df: DataFrame, key: Sequence[str], weight: str = "weight", cutoff: float = CUTOFF) -> DataFrame:
    """Best weight of each key becomes 1; what is then below the cutoff goes."""
    best = F.max(weight).over(Window.partitionBy(*key))
    return df.withColumn(weight, F.col(weight) / best).filter(F.col(weight) >= cutoff)


def normalise_sum(df: DataFrame, key: Sequence[str], weight: str = "weight", cutoff: float = CUTOFF) -> DataFrame:
    """Weights of each key sum to 1; what is then below the cutoff goes."""
    total = F.sum(weight).over(Window.partitionBy(*key))
    return df.withColumn(weight, F.col(weight) / total).filter(F.col(weight) >= cutoff)


def cap_at_one(df: DataFrame, key: Sequence[str], factor: float, weight: str = "weight") -> DataFrame:
    """A heuristic's result: where the best weight of a key exceeds 1 all are divided by it, then all are times `factor`."""
    best = F.max(weight).over(Window.partitionBy(*key))
    return df.withColumn(weight, F.col(weight) / F.greatest(best, F.lit(1.0)) * F.lit(float(factor)))


def most_likely(df: DataFrame, key: Sequence[str], weight: str = "weight") -> DataFrame:
    """All elements of the largest weight of each key; ties stay."""
    order = Window.partitionBy(*key).orderBy(F.desc(weight))
    return df.withColumn("_rank", F.rank().over(order)).filter("_rank = 1").drop("_rank")


def first(df: DataFrame, key: Sequence[str], *ties: Column | str, weight: str = "weight") -> DataFrame:
    """One element of each key, by weight and then the tie-breaking columns."""
    order = Window.partitionBy(*key).orderBy(F.desc(weight), *ties)
    return df.withColumn("_row", F.row_number().over(order)).filter("_row = 1").drop("_row")


def best_level(df: DataFrame, key: Sequence[str], level: str = "level") -> DataFrame:
    """Priority levels: lower levels count only where no higher one has elements."""
    return df.withColumn("_least", F.min(level).over(Window.partitionBy(*key))).filter(F.col(level) == F.col("_least")).drop("_least")


def flatten_levels(df: DataFrame, by: Sequence[str], weight: str = "weight") -> DataFrame:
    """All levels in one set; an element of several levels adds up."""
    return combine_sum(df, by, weight)


def queue_max(df: DataFrame, parent: str, node: str, weight: str = "weight") -> DataFrame:
    """(node, weight): a node's own largest weight, or the mean of its children's largest where it has none itself."""
    own = df.groupBy(parent, node).agg(F.max(weight).alias("own"))
    children = own.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.avg("own").alias("mean"))
    return own.join(children, own[node] == children["_p"], "left").select(F.col(node), F.coalesce("own", "mean").alias(weight))


def moving_average(df: DataFrame, key: str, order: Sequence[str], value: str, alpha: float = 0.1, start: float = 1.0) -> DataFrame:
    """(key, weight): old weight times 1 - alpha plus alpha times the clamped new value, in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    step = lambda acc, x: F.lit(alpha) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["_v"])) + F.lit(1 - alpha) * acc
    return df.groupBy(key).agg(F.aggregate(items, F.lit(float(start)), step).alias("weight"))
