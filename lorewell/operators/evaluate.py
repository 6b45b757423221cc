"""Evaluation, sampling and de-duplication of data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(tp, fp, fn, tn) in one row: four conditional sums, combined before the shuffle."""
    n = lambda t, p: F.sum(F.when((F.col(truth) == t) & (F.col(predicted) == p), 1).otherwise(0))
    return df.agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))


def metrics(c: DataFrame) -> DataFrame:
    return c.select("*", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"), (F.col("tn") / (F.col("tn") + F.col("fp"))).alias("tnr"), ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"))


def midpoint_threshold(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """(threshold): mean of the mean scores of true and of false rows."""
    means = df.groupBy(truth).agg(F.avg(score).alias("m"))
    return means.agg(F.avg("m").alias("threshold"))


def at_threshold(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """Metrics of `score >= threshold` at the midpoint threshold; the threshold is one row and is broadcast."""
    t = midpoint_threshold(df, truth, score)
    both = df.join(F.broadcast(t), how="cross").withColumn("predicted", F.col(score) >= F.col("threshold"))
    return metrics(confusion(both, truth)).join(F.broadcast(t), how="cross")


def matrix(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    return df.groupBy(predicted, actual).agg(F.count(F.lit(1)).alias("n"))


def gold_precision(predicted: DataFrame, true: DataFrame, false: DataFrame, key: Sequence[str], ignored: DataFrame | None = None) -> DataFrame:
    """(correct, incorrect, unknown, precision) of predicted rows against two labelled sets."""
    if ignored is not None:
        predicted = predicted.join(ignored, list(set(ignored.columns) & set(predicted.columns)), "left_anti")
    t, f = true.select(*key, F.lit(1).alias("_t")).distinct(), false.select(*key, F.lit(1).alias("_f")).distinct()
    both = predicted.join(t, list(key), "left").join(f, list(key), "left")
    out = both.agg(F.count("_t").alias("correct"), F.count("_f").alias("incorrect"), F.sum(F.when(F.col("_t").isNull() & F.col("_f").isNull(), 1).otherwise(0)).alias("unknown"))
    return out.withColumn("precision", F.round(F.col("correct") / (F.col("correct") + F.col("incorrect")), 2))


def pair_rates(items: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(kind, consistent, total): of true/true and true/false pairs of a subject's labelled items, how many aren't disjoint."""
    a = items.select("subject", F.col("item").alias("a"), F.col("truth").alias("ta"))
    b = items.select("subject", F.col("item").alias("b"), F.col("truth").alias("tb"))
    pairs = a.join(b, "subject").filter("a < b and (ta or tb)")
    pairs = pairs.join(disjoint.withColumn("_d", F.lit(1)), ["a", "b"], "left")
    kind = F.when(F.col("ta") & F.col("tb"), "true/true").otherwise("true/false")
    return pairs.groupBy(kind.alias("kind")).agg(F.sum(F.when(F.col("_d").isNull(), 1).otherwise(0)).alias("consistent"), F.count(F.lit(1)).alias("total"))


def distinct_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def bags(df: DataFrame, key: str, items: Sequence[str]) -> DataFrame:
    """(key, n, bag): a key's rows nested in order."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*items))).alias("bag"))


def spread(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.var_samp(value).alias("variance"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of the key: the same sample however the rows lie; a top-n of each task, then of those."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def confident(predictions: DataFrame, threshold: float) -> DataFrame:
    """Predictions whose probability and every comma-separated score reach the threshold."""
    scores = F.transform(F.split("scores", ","), lambda v: F.trim(v).try_cast("double"))
    return predictions.filter((F.col("probability") >= threshold) & F.forall(scores, lambda v: v >= threshold))


def without_contradicted(predictions: DataFrame) -> DataFrame:
    """Disjoint predictions (a, b, label) but for pairs that are predicted conjoint anywhere, in either order."""
    key = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    good = predictions.filter("label = 'disjoint'").select(*key).distinct()
    return good.join(predictions.filter("label = 'conjoint'").select(*key).distinct(), ["a", "b"], "left_anti")


def disjoint_model(train: DataFrame, features: Sequence[str], label: str = "label", rounds: int = 20):
    """A gradient-boosted classifier of the training rows (label 0 or 1); give it a bounded labelled sample."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), GBTClassifier(labelCol=label, maxIter=rounds, seed=7)]).fit(train)
