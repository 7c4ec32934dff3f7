"""Queries for further facts about code."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import facts as X
from corpusloom.operators import search as S
from corpusloom.plans.code import SPARSE_SQL, SYMBOLS_SQL, sparse_calls, symbols
from corpusloom.plans.registry import BOOST_SQL, FILES_SQL, LINES_SQL, files, query
from corpusloom.runtime import Scratch, read


@query(f"with {FILES_SQL} select file_id, 'god-object' as pattern, len(string_split(content, chr(10)))::bigint as value from files where len(string_split(content, chr(10))) >= 1500")
def h27_god_objects(spark, sf):
    return X.anti_patterns(files(spark, sf)).where("pattern = 'god-object'")


@query("with c as (select conv_id as file_id, string_agg(text, chr(10) order by turn) as content from conversations group by conv_id), n as (select file_id, len(regexp_extract_all(content, '[.](AddTool|Register|RegisterHandler|AddRoute|Handle|HandleFunc|Post|Get|Put|Delete)\\(|router[.]|mux[.]|app[.]Use\\(|container[.](Bind\\(|Register)'))::bigint as n from c) select file_id, n >= 10 as registers from n")
def h27_registrations(spark, sf):
    c = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return c.select("file_id", (F.regexp_count("content", F.lit(X.REGISTRATIONS)) >= X.REGISTRATION_CALLS).alias("registers"))


@query(f"with {FILES_SQL} select path from files where not regexp_matches(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'test|spec|mock|fixture|[.]git|[.]svn|[.]hg|node_modules|vendor')")
def h29_production_files(spark, sf):
    return files(spark, sf).where(X.is_production(F.col("path"))).select("path")


KIND_SQL = f"{LINES_SQL}, {SYMBOLS_SQL}, h as (select file_id, line from lines where contains(text, 'tion')), j as (select h.file_id, h.line, s.type, s.symbol_id, row_number() over (partition by h.file_id, h.line order by s.end_line - s.line, s.line, s.symbol_id) as k from h join symbols s on s.file_id = h.file_id and h.line between s.line and s.end_line)"


@query(f"with {KIND_SQL} select file_id, line from j where k = 1 and type = 'method'")
def c17_hits_in_methods(spark, sf):
    return X.hits_in(S.hits(files(spark, sf), S.literal("tion"), None).select("file_id", "line"), symbols(spark, sf), ["method"])


@query(f"with {KIND_SQL} select j.file_id, j.line from j join symbols s on s.symbol_id = j.symbol_id where k = 1 and j.type in ('method', 'class') and contains(lower(s.name), 'red')")
def c28_kind_and_symbol(spark, sf):
    return S.run_query(files(spark, sf), "kind:Method kind:class symbol:RED tion", lambda: symbols(spark, sf)).select("file_id", "line")


@query(f"with {KIND_SQL} select h.file_id, h.line from h where not exists (select 1 from j where j.file_id = h.file_id and j.line = h.line)")
def c30_top_level_hits(spark, sf):
    return X.hits_in(S.hits(files(spark, sf), S.literal("tion"), None).select("file_id", "line"), symbols(spark, sf), ["top-level"])


@query(f"with {LINES_SQL} select path, line, (70.0 + {BOOST_SQL} + 4.0) * 0.7 as score from lines where regexp_matches(text, 'th.*tion')")
def c19_regex_fallback(spark, sf):
    return X.with_fallback(files(spark, sf), "th.*tion")


@query("with n as (select p_name as name, p_brand as path, max(p_size) as complexity from part group by 1, 2), o as (select p_name as name, p_brand as path, max(p_size) as old_complexity from part where p_partkey % 3 <> 0 group by 1, 2) select n.name, n.path, complexity, old_complexity, case when old_complexity is null then 'added' else 'modified' end as status from n left join o on o.name = n.name and o.path = n.path where old_complexity is null or old_complexity <> complexity")
def d10_complexity_growth(spark, sf):
    p = read(spark, sf, "part")
    table = lambda x: x.groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("path")).agg(F.max("p_size").alias("complexity"))
    return X.growth(table(p), table(p.where("p_partkey % 3 <> 0")))


@query(f"with {SPARSE_SQL}, e as (select src, dst, src % 7 as ca, dst % 7 as cb from calls where src <> dst), m as (select node, node % 7 as community from (select src as node from calls union select dst from calls)), x as (select src as node, ca as community, ca = cb as same from e union all select dst, cb, ca = cb from e), d as (select community, node, count(*) as d from x group by 1, 2), h as (select community, node as hub from (select *, row_number() over (partition by community order by d desc, node) as k from d) where k = 1), c as (select community, (count(case when same then 1 end) / 2)::bigint as inside, count(case when not same then 1 end)::bigint as outside from x group by 1), s as (select community, count(*)::bigint as size from m group by 1) select s.community, size, inside, outside, hub from s join c on c.community = s.community join h on h.community = s.community")
def e15_features(spark, sf, calls=sparse_calls):
    edges = calls(spark, sf)
    member = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.col("node") % 7)
    return X.features(edges, member)


@query(f"with recursive {SPARSE_SQL}, t as (select src, dst from calls union select t.src, c.dst from t join calls c on t.dst = c.src), n as (select src as node from calls union select dst from calls) select n.node, count(t.src)::bigint as callers from n left join t on t.dst = n.node group by n.node order by callers desc, n.node limit 10")
def f09_load_bearing(spark, sf, calls=sparse_calls):
    return X.load_bearing(calls(spark, sf), Scratch(spark, "bearing"))


@query(f"with recursive {SPARSE_SQL}, e as (select distinct src, dst from calls where src > dst), n as (select src as node from e union select dst from e), w as (select node, 0 as depth from n where node not in (select dst from e) union select e.dst, w.depth + 1 from w join e on e.src = w.node) select node, max(depth) as depth from w group by node")
def f10_dependency_depth(spark, sf, calls=sparse_calls):
    return X.dependency_depth(calls(spark, sf).where("src > dst"), Scratch(spark, "depth"))


@query(f"with {SYMBOLS_SQL} select symbol_id, case when is_exported then 'exported ' else '' end || type || ' ' || name || ' of complexity ' || complexity::varchar || ' used by ' || fan_in::varchar as summary from symbols")
def h24_summaries(spark, sf):
    return X.summary(symbols(spark, sf))


@query("select case p_size % 4 when 0 then 'global' when 1 then 'class' when 2 then 'parameter' else 'local' end as scope, count(*)::bigint as n, count(distinct p_name)::bigint as names from part group by 1")
def h26_variable_buckets(spark, sf):
    scope = F.element_at(F.array(*map(F.lit, ("global", "class", "parameter", "local"))), F.col("p_size") % 4 + 1)
    return X.variable_buckets(read(spark, sf, "part").select(scope.alias("scope"), F.col("p_name").alias("name")))


@query("select n_regionkey as group_id, n_name as word from nation where n_nationkey % 5 <> 0 union select r_regionkey, r_name from region")
def h10_synonym_edits(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    table = n.select(F.col("n_regionkey").alias("group_id"), F.col("n_name").alias("word"))
    return X.edit_synonyms(table, r.select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("word")), n.where("n_nationkey % 5 = 0").select(F.col("n_regionkey").alias("group_id"), F.col("n_name").alias("word")))
