"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import licenses, mixing, near_join, packing, pieces, pii, quality, secrets, token_files, vectors
from corpusloom.runtime import Scratch, read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.assign(docs, Scratch(spark, "op1"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(read(spark, sf_dir, "documents"), Scratch(spark, "op2")).drop("text_key")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    return token_files.documents(token_files.write(read(spark, sf_dir, "documents"), scratch), scratch)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"), Scratch(spark, "op5"))


def op6_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_components(read(spark, sf_dir, "documents"), Scratch(spark, "op6")).drop("text_key")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_counts(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_mixing, op2_pii, op3_token_files, op4_secrets, op5_near_vectors, op6_near_documents, op7_token_counts, op8_quality_rules, op9_licenses, op10_packing)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE, "op4_secrets": secrets.oracle(), "op5_near_vectors": vectors.ORACLE, "op6_near_documents": near_join.ORACLE}
