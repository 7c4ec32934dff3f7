"""Sinks' rows and incremental updates over the driver's tables."""

from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators import search as S
from corpusloom.plans.code import CALLS_SQL, calls
from corpusloom.plans.registry import LINES_SQL, files, query
from corpusloom.runtime import Scratch
from corpusloom.sources import files as R
from corpusloom.streaming import incremental as I


@query(f"with {LINES_SQL} select path || ':' || line::varchar || ':' || text as row from lines where contains(text, 'edth')")
def a18_grep_rows(spark, sf):
    return R.grep_rows(S.hits(files(spark, sf), S.literal("edth"), None))


@query(f"with {LINES_SQL} select path || ' ' || string_agg(line::varchar, ',' order by line) as row from lines where contains(text, 'edth') group by path")
def a18_compact_rows(spark, sf):
    return R.compact_rows(S.hits(files(spark, sf), S.literal("edth"), None))


@query(f"with recursive {CALLS_SQL}, w as (select 1::bigint as node, 0 as depth union select c.dst, w.depth + 1 from w join calls c on c.src = w.node where w.depth < 3), m as (select node, min(depth) as depth from w group by node) select 1::bigint as root, depth, repeat('  ', depth) || node::varchar as row from m")
def m02_tree_rows(spark, sf, calls=calls):
    return R.tree_rows(G.walk(calls(spark, sf), spark.createDataFrame([(1,)], "node long"), Scratch(spark, "tree"), 3))


@query("select doc_id as file_id, case when doc_id % 5 = 0 then text || ' changed' else text end as content from documents where doc_id % 7 <> 0")
def m09_incremental_update(spark, sf):
    """Base rows, changed ones over them, then deletions taken out."""
    f = files(spark, sf).select("file_id", "path", "content")
    updates = f.where("file_id % 5 = 0").withColumn("content", F.concat("content", F.lit(" changed")))
    return I.merged(f, updates, f.where("file_id % 7 = 0").select("file_id")).select("file_id", "content")
