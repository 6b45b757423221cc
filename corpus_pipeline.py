"""A cleaning pipeline over documents: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame. run()
writes every stage's rows as Parquet in the folder of spark.checkpoint.dir and reads them again as the next one's docs.
Texts that a stage changes get a new n_chars. Rows with null or empty text fail the quality rules; extra columns pass
through the first three stages, whatever their names; an empty table stays empty. Rows with a null key are judged, are no
near-duplicates of others and come last for repeated passages; rows that repeat both key and text are one after the second stage. A
very long text is one row all the way, and packed over as many sequences as it fills. Ties go to the least key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.common import table, written
from lorewell.llm.near_dedup import near_filter
from lorewell.llm.packing import pack
from lorewell.llm.quality_rules import quality_filter
from lorewell.llm.substring_dedup import substring_dedup


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without boilerplate lines (operator 9)."""
    return _counted(quality_filter(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more (operator 1)."""
    return near_filter(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 50-word windows that an earlier document has (operator 8)."""
    return _counted(substring_dedup(docs).select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences (operator 4)."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("repeated passages", repeated_passages), ("packing", packing)]

#: The stages are not all SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
