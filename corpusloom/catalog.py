"""Registry of the queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import search
from corpusloom.plans import code, context, facts, history, index, registry, sources  # noqa: F401  they register their queries
from corpusloom.plans import search as search_plans  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best lines with a word, with the two lines before and after each."""
    files = registry.files(spark, sf_dir)
    best = search.ranked(search.scored(search.hits(files, search.literal("the", whole_word=True)), "the"), 20)
    around = best.select("file_id", F.col("line").alias("hit"), "column", "score", F.explode(F.sequence(F.col("line") - 2, F.col("line") + 2)).alias("line"))
    return search.lines(files).join(around, ["file_id", "line"]).select("file_id", "path", "hit", "column", "score", "line", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
