"""Symbol context, manifests, insight, and ordered sequences."""

from pyspark.sql import functions as F

from corpusloom.operators import context as C
from corpusloom.operators import graph as G
from corpusloom.plans.code import CALLS_SQL, EDGES_SQL, HEALTH, SMELLS, SPARSE_SQL, SYMBOLS_SQL, calls, package_edges, sparse_calls, symbols
from corpusloom.plans.registry import query
from corpusloom.runtime import Scratch, read


@query(f"with {SYMBOLS_SQL}, {CALLS_SQL} select c.dst as symbol_id, 'caller' as part, s.name, min(s.path) as detail from calls c join symbols s on s.symbol_id = c.src group by 1, 2, 3")
def l02_callers(spark, sf, calls=calls):
    return C.context(symbols(spark, sf), calls(spark, sf), ["caller"]).select("symbol_id", "part", "name", "detail")


@query(f"with {SYMBOLS_SQL} select i.symbol_id, o.name, min(o.line::varchar || '-' || o.end_line::varchar) as detail from symbols i join symbols o on i.file_id = o.file_id and i.symbol_id <> o.symbol_id and i.line >= o.line and i.end_line <= o.end_line and (i.line > o.line or i.end_line < o.end_line) group by 1, 2")
def l03_parents(spark, sf):
    return C.context(symbols(spark, sf), calls(spark, sf), ["parent"]).select("symbol_id", "name", "detail")


@query(f"with {SYMBOLS_SQL} select symbol_id, type as name, (count(*) over (partition by file_id, type) - 1)::varchar as detail from symbols")
def l04_siblings(spark, sf):
    return C.context(symbols(spark, sf), calls(spark, sf), ["siblings"]).select("symbol_id", "name", "detail")


@query(f"with {SYMBOLS_SQL}, {CALLS_SQL}, i as (select dst as symbol_id, count(distinct src) as n from calls group by 1), o as (select src as symbol_id, count(distinct dst) as n from calls group by 1), b as (select s.symbol_id, s.complexity, s.name as word, coalesce(i.n, 0) as a, coalesce(o.n, 0) as z from symbols s left join i on i.symbol_id = s.symbol_id left join o on o.symbol_id = s.symbol_id) select symbol_id, a::varchar || '/' || z::varchar as name, least(1 + least(a // 2, 5) + least(z // 2, 3) + case when complexity > 10 then 2 else 0 end + case when regexp_matches(word, '^[A-Z]') then 2 else 0 end, 10)::varchar as detail from b")
def l13_usage(spark, sf, calls=calls):
    return C.context(symbols(spark, sf), calls(spark, sf), ["usage"]).select("symbol_id", "name", "detail")


@query(f"with recursive {SPARSE_SQL}, r as (select min(src) as node from calls), w as (select c.dst as node, 1 as depth from calls c join r on c.src = r.node union select c.dst, w.depth + 1 from w join calls c on c.src = w.node where w.depth < 10) select node, min(depth) as depth from w where node <> (select node from r) group by node")
def d16_type_hierarchy(spark, sf, calls=sparse_calls):
    edges = calls(spark, sf)
    return C.hierarchy(edges, edges.agg(F.min("src")).first()[0], Scratch(spark, "types"))


@query(f"""with {SYMBOLS_SQL}, {CALLS_SQL}, e as (select s_suppkey as entry, s_suppkey as symbol_id from supplier),
a as (select entry, symbol_id, 0 as rank, 'self' as relation from e union all select e.entry, c.dst, 1, 'callee' from e join calls c on c.src = e.symbol_id union all select e.entry, c.src, 2, 'caller' from e join calls c on c.dst = e.symbol_id),
m as (select entry, symbol_id, min(rank) as rank from a group by 1, 2), p as (select m.*, greatest(s.end_line - s.line, 1) * 10 as cost from m join symbols s on s.symbol_id = m.symbol_id),
u as (select *, sum(cost) over (partition by entry order by rank, symbol_id rows unbounded preceding)::bigint as used from p)
select entry, symbol_id, case rank when 0 then 'self' when 1 then 'callee' else 'caller' end as relation, used from u where used <= 3000""")
def f12_manifest_expansion(spark, sf, calls=calls):
    entries = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("entry"), F.col("s_suppkey").alias("symbol_id"))
    return C.expand_manifest(entries, symbols(spark, sf), calls(spark, sf), 3000)


@query(f"with recursive {SPARSE_SQL}, d as (select distinct src as node from calls where src % 40 = 0), s as (select node, 0 as d from d union select c.dst, s.d + 1 from s join calls c on c.src = s.node where s.d < 10), p as (select node, max(pow(0.8, d)) as strength from s where pow(0.8, d) >= 0.1 group by node) select p.node, case when d.node is not null then 1.0::double else p.strength end as strength, case when d.node is not null then 'direct' else 'propagated' end as how from p left join d on d.node = p.node where p.strength >= 0.5")
def m08_annotations_query(spark, sf, calls=sparse_calls):
    edges = calls(spark, sf)
    seeds = edges.where("src % 40 = 0").select(F.col("src").alias("node"), F.lit(1.0).alias("strength")).distinct()
    spread = G.propagate_labels(edges, seeds, Scratch(spark, "labels"))
    return C.annotation_query(seeds.select("node", F.lit("critical").alias("label")), spread, "critical", 0.5)


@query(f"""with {SYMBOLS_SQL}, {HEALTH}, {SMELLS}, {EDGES_SQL}, x as (select distinct src_package, dst_package from edges where src_package <> dst_package),
k as (select p, count(case when src_package = p then 1 end)::double / count(*) as v from (select distinct src_package as p from edges union select dst_package from edges) q join x on p in (src_package, dst_package) group by p)
select 'complexity' as section, 'average' as metric, round(a, 6)::double as value from h union all select 'complexity', 'median', (select median(complexity)::double from symbols where type <> 'class') union all select 'complexity', 'high', x::double from h
union all select 'health', 'score', round(greatest(least(10.0 - 4.0 * x / t - 1.5 * m / t - case when a > 10 then least((round(a, 6) - 10) * 0.15, 3.0) else 0.0 end + case when l / t > 0.8 then 1.0 when l / t > 0.6 then 0.5 else 0.0 end, 10.0), 0.0), 6)::double from h
union all select 'health', 'maintainability', round(greatest(0.0, 100 - 2 * round(a, 6)), 6)::double from h union all select 'smells', smell, count(*)::double from smells group by smell union all select 'coupling', p::varchar, round(v, 6) from k""")
def k_insight_overview(spark, sf):
    return C.insight(symbols(spark, sf), package_edges(spark, sf))


@query("with o as (select user_id as target, string_agg(case when event_type = 'purchase' then 'w' else 'r' end, '' order by event_id) as sequence from events group by user_id) select target, sequence, case when not contains(sequence, 'w') then 'read-only' when not contains(sequence, 'r') then 'write-only' when starts_with(sequence, 'w') then 'write-first' else 'read-modify-write' end as kind from o")
def g04_access_sequences(spark, sf):
    op = F.when(F.col("event_type") == "purchase", "w").otherwise("r")
    return C.access_class(read(spark, sf, "events").select(F.col("user_id").alias("target"), F.col("event_id").alias("seq"), op.alias("op")))
