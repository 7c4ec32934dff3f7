"""From raw documents to packed sequences: quality, near copies, personal data, mix, packing.

Defined results: null, empty and short texts fail the length rule and go. Rows that repeat
id and text stay once. Of a group of near copies the row of the least id stays; rows without
an id stay only where no near copy has one. Null sources are a source of their own. Further
columns are kept as they are until packing, whose rows are pieces of documents; a document
that the mix repeats is packed as often. Empty tables give an empty result; without labels
the rules decide alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import mixing, near_join, packing, pii, quality
from corpusloom.runtime import Scratch, give_back, read

#: Rows that a Parquet reader holds decoded at once: bounds a batch of long texts.
READ_ROWS = 512


def begin(spark: SparkSession) -> None:
    """Before a stage: readers take few rows at once, a setting that stays, and executors give back free heap."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > READ_ROWS:
        spark.conf.set(key, str(READ_ROWS))
    give_back(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the classifier reject go."""
    begin(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    begin(spark)
    return near_join.keep_one(docs, Scratch(spark, "near"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced."""
    begin(spark)
    return pii.redact(docs, Scratch(spark, "pii"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, as the weights of their sources ask."""
    begin(spark)
    return mixing.mix(docs, Scratch(spark, "mix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are packed into sequences."""
    begin(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs


#: The trained classifier and the tokenizer have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None
