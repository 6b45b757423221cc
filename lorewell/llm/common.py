"""Shared folder, written intermediate tables and small helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where the setting is missing, a local session gets a temporary folder; on a cluster that would
    lose data, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir")
    root = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` as a Parquet table in the shared folder, and its path: cuts lineage, survives lost executors.

    The shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with _settings(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Shuffle files of a write go when it ends; Arrow batches of texts stay small.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextlib.contextmanager
def _settings(spark: SparkSession):
    was = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes written tables that nothing reads any more."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of df's."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def key_value(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The key as long `id` and the text (null: empty) as string `text`, whatever else df has."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


#: Share of all rows, as one in so many, above which a key counts as hot. Fewer than HOT keys can have more than that.
HOT = 2048


def spread_join(rows: DataFrame, few: DataFrame, key: list[str], total: int, weight: str = "n") -> DataFrame:
    """rows left joined with `few`, which has at most one row a key and says in `weight` how many of all `total` rows have it.

    A key of more than one in `HOT` of all rows would send them to one task. There are fewer than `HOT` such keys, whatever the
    input, so they are broadcast; their rows then go by a key of their own each, spread over all tasks, and the others by key.
    """
    least, first, rest = total // HOT, key[0], key[1:]
    values = [c for c in few.columns if c not in key and c != weight]
    to, mark = fresh(rows, "spread_to", "spread_hot")
    hot = few.filter(F.col(weight) > least).select(*key, F.lit(True).alias(mark), *[F.col(v).alias(f"hot_{v}") for v in values])
    cold = few.filter(F.col(weight) <= least).select(F.col(first).alias(to), *rest, *values)
    marked = rows.join(F.broadcast(hot), key, "left")
    marked = marked.withColumn(to, F.when(F.col(mark).isNull(), F.col(first)).otherwise(F.xxhash64(*rows.columns).cast(rows.schema[first].dataType)))
    return marked.join(cold, [to, *rest], "left").select(*rows.columns, *[F.when(F.col(mark), F.col(f"hot_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """Rows that name a file each, one to a task: adaptive execution would merge them, as it counts the bytes of names."""
    return rows.repartitionByRange(max(rows.count(), 1), key)


def ordered(kv: DataFrame, prefix: int = 24) -> DataFrame:
    """(id, text) in ranges that ascend with the partition, nulls first, then by text; the rows of one key may span ranges.

    Only rows that share their key and the first `prefix` characters stay in one range.
    """
    (head,) = fresh(kv, "head")
    key = F.col("id").asc_nulls_first()
    return kv.withColumn(head, F.substring("text", 1, prefix)).repartitionByRange(key, F.col(head)).drop(head).sortWithinPartitions(key, "text")
