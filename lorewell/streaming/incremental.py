"""Incremental processing: trigger queues, run versions, ripples, learned state, late updates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.stores import changed_rows


def trigger_stream(spark: SparkSession, path: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """Queued triggers as a stream of files; a file is taken once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def drain(stream: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Handles what is queued now in micro-batches and ends; the checkpoint makes a restart go on where it ended."""
    return stream.writeStream.outputMode(mode).foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll(stream: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None], every: str = "30 seconds") -> StreamingQuery:
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_versions(triggers: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Batch form: each trigger with its run number, 1 for a key's first."""
    from pyspark.sql import Window

    return triggers.withColumn("run", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def run_version_stream(triggers: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, runs): the number of runs of each key so far, kept as state."""

    def count(k, batches, state):
        n = state.get[0] if state.exists else 0
        n += sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "runs": [n]})

    kind = triggers.schema[key].dataType.simpleString()
    return triggers.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, runs long", "n long", "update", "NoTimeout")


def learned_standing(stream: DataFrame, key: str) -> DataFrame:
    """Standing tallies of a key over all that came so far; a streaming aggregate for update or complete mode."""
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0))
    return stream.groupBy(key).agg(part("INDIVIDUAL").alias("ind"), part("COLLECTION").alias("coll"), part("UNKNOWN").alias("unk"))


def ripple(changed: DataFrame, links: DataFrame) -> DataFrame:
    """(node): the changed nodes and what they link to; each is processed once more."""
    return changed.select("node").union(links.join(changed.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node"))).distinct()


def upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str], partition: str) -> None:
    """Rewrites only the partitions of a Parquet table that hold changed rows."""
    old = spark.read.parquet(path)
    fresh = changed_rows(new.select(*old.columns), old, key)
    touched = fresh.select(partition).distinct()
    kept = old.join(touched, partition, "left_semi").join(fresh.select(*key), key, "left_anti")
    kept.unionByName(fresh).write.mode("append").parquet(path + ".next")
    done = spark.read.parquet(path + ".next")
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + ".next")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def released(negatives: DataFrame, majorities: DataFrame, key: str) -> DataFrame:
    """Deferred negatives whose key has a majority by now."""
    return negatives.join(majorities.select(key).distinct(), key, "left_semi")
