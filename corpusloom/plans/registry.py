"""Queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Documents as files: the source is a directory, and the number decides the extension.
EXTENSIONS = (".py", ".md", ".json", "_test.go", ".bin")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/file"), F.col("doc_id").cast("string"), ext)
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"))


FILES_SQL = """files as (select doc_id as file_id, 'src/' || source || '/' || lang || '/file' || cast(doc_id as varchar) ||
  case doc_id % 5 when 0 then '.py' when 1 then '.md' when 2 then '.json' when 3 then '_test.go' else '.bin' end as path,
  text as content, cast(strlen(text) as bigint) as size from documents)"""
LINES_SQL = FILES_SQL + """,
lines as (select file_id, path, unnest(string_split(content, chr(10))) as text, cast(generate_subscripts(string_split(content, chr(10)), 1) as bigint) as line from files)"""
CATEGORY_SQL = "case file_id % 5 when 0 then 'code' when 1 then 'documentation' when 2 then 'config' when 3 then 'test' else 'unknown' end"
BOOST_SQL = "(case file_id % 5 when 0 then 50.0 when 1 then -20.0 when 2 then 10.0 when 3 then 40.0 else 0.0 end)::double"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: what follows the scheme is the path."""
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.col("html").alias("content"))


PAGES_SQL = "files as (select page_id as file_id, regexp_replace(url, '^[a-z]+://', '') as path, html as content from pages)"
