"""Written tables: shared intermediate results, precomputed heuristics, and text sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids in a chunk of the precomputed store.
CHUNK = 8192


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a local session without it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage between rounds of a loop."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_precomputed(df: DataFrame, root: str, key: str = "article_id") -> None:
    """Rows (heuristic, key, …) into a folder for each heuristic and chunk of keys; only chunks that df holds are replaced."""
    chunked = df.withColumn("chunk", F.floor(F.col(key) / CHUNK).cast("long"))
    chunked.repartition("heuristic", "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("heuristic", "chunk").parquet(root)


def read_precomputed(spark: SparkSession, root: str, heuristic: str, keys: DataFrame | None = None, key: str = "article_id") -> DataFrame:
    """A heuristic's stored rows, of the given keys only where keys are given; the folder names prune the scan."""
    df = spark.read.parquet(root).filter(F.col("heuristic") == heuristic)
    return df if keys is None else df.join(keys.select(key).distinct(), key, "left_semi")


def changed_rows(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new that old doesn't hold in the same form: those a late update has to write."""
    rest = [c for c in new.columns if c not in key]
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*key, *rest]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return new.alias("n").join(old.alias("o"), cond, "left_anti")


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("quoteAll", False).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def scan_listed(spark: SparkSession, path: str, table: DataFrame, key: str) -> DataFrame:
    """Rows of table whose key stands in the first column of a TSV file."""
    ids = spark.read.text(path).select(F.split("value", "\t")[0].cast("long").alias(key)).filter(F.col(key).isNotNull())
    return table.join(ids.distinct(), key, "left_semi")


def export_script(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): commands that rebuild the graph; anonymous nodes are left out, numbers get a quote mark in front, strings quotes."""
    arg = lambda c: F.when(F.col(c).rlike(r"^-?\d+(\.\d+)?$"), F.concat(F.lit("'"), F.col(c))).when(F.col(c).rlike(r"\s"), F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))).otherwise(F.col(c))
    made = nodes.filter("name is not null and name <> ''").select(F.concat(F.lit("addnode "), F.col("name")).alias("line"))
    return made.unionByName(edges.select(F.concat_ws(" ", F.lit("addedge ("), arg("pred"), arg("arg1"), arg("arg2"), F.lit(")")).alias("line")))
