"""Relations of symbols against fixed tables."""

import pytest

from corpusloom.operators import relations as R
from corpusloom.runtime import Scratch

SYMBOLS = [
    (1, 1, "Shape", "interface", 1, 5),
    (2, 1, "Base", "class", 7, 20),
    (3, 1, "Square", "class", 22, 150),
    (4, 1, "side", "field", 23, 23),
    (5, 1, "area", "method", 100, 120),
    (6, 1, "total", "variable", 101, 101),
    (7, 1, "scale", "parameter", 100, 100),
    (8, 1, "LIMIT", "constant", 160, 160),
    (9, 1, "main", "function", 170, 180),
    (10, 2, "OrderHandler", "function", 1, 9),
    (11, 2, "helper", "function", 11, 19),
    (12, 2, "lonely", "function", 21, 29),
]
# source, target, file, type, name
REFERENCES = [
    (3, 2, 1, "inheritance", "Base"),
    (3, 2, 1, "inheritance", "Base"),
    (2, 1, 1, "inheritance", "Shape"),
    (2, None, 1, "inheritance", "Elsewhere"),
    (5, 1, 1, "declaration", "Shape"),
    (5, 1, 1, "assignment", "Shape"),
    (5, 8, 1, "usage", "LIMIT"),
    (None, 8, 1, "usage", "LIMIT"),
    (9, None, 1, "import", "os"),
    (5, None, 1, "import", "os"),
    (10, None, 2, "import", None),
]
CALLS = [(9, 5), (5, 11), (11, 5), (10, 11)]


@pytest.fixture(scope="module")
def tables(spark):
    symbols = spark.createDataFrame(SYMBOLS, "symbol_id long, file_id long, name string, type string, line long, end_line long")
    references = spark.createDataFrame(REFERENCES, "source_symbol long, target_symbol long, file_id long, type string, referenced_name string")
    return symbols, references, spark.createDataFrame(CALLS, "src long, dst long")


def rows(df):
    return sorted((r["symbol_id"], r["part"], r["name"], r["detail"]) for r in df.collect())


def test_relations(spark, tables):
    assert rows(R.relations(*tables, Scratch(spark, "t"))) == sorted([
        (2, "parent_class", "Elsewhere", None), (2, "parent_class", "Shape", "1"), (3, "parent_class", "Base", "2"),
        (1, "implementing_type", "Base", "class"), (2, "interface", "Shape", "1"),
        (2, "ancestor", "Shape", "1"), (3, "ancestor", "Base", "1"), (3, "ancestor", "Shape", "2"),
        (5, "used_type", "Shape", "1"),
        (3, "variable", "side", "class"), (5, "variable", "total", "local"), (5, "variable", "scale", "parameter"), (5, "variable", "LIMIT", "used global"),
        (9, "entry_point", "main", "main function"), (5, "entry_point", "main", "main function"), (11, "entry_point", "main", "main function"),
        (10, "entry_point", "OrderHandler", "HTTP endpoint"), (11, "entry_point", "OrderHandler", "HTTP endpoint"), (5, "entry_point", "OrderHandler", "HTTP endpoint"),
    ])


def test_imported_modules_and_marked_entries(tables):
    symbols, references, _ = tables
    assert [tuple(r) for r in R.imported_modules(references).collect()] == [(1, "os")]
    assert {r["name"] for r in R.entry_points(symbols, symbols.where("name = 'lonely'").select("symbol_id")).collect()} == {"main", "OrderHandler", "lonely"}


def test_a_name_saved_twice(spark):
    scratch = Scratch(spark, "t")
    first = scratch.save(spark.range(3), "x")
    second = scratch.save(first.where("id > 0"), "x")
    assert (first.count(), second.count()) == (3, 2)


def test_empty(spark, tables):
    none = [t.limit(0) for t in tables]
    assert R.relations(*none, Scratch(spark, "t")).count() == 0
