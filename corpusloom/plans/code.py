"""Names, symbols, joins, metrics and graphs: parts stand in for symbols, line items for references."""

from pyspark.sql import functions as F

from corpusloom.functions import names as N
from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.operators import metrics as M
from corpusloom.operators import similar as D
from corpusloom.operators import symbols as Y
from corpusloom.plans.registry import FILES_SQL, files, query
from corpusloom.runtime import Scratch, read

SYMBOLS_SQL = """symbols as (select p_partkey as symbol_id, cast(p_partkey % 99 as bigint) as file_id, p_name as name, case p_partkey % 4 when 0 then 'class' when 1 then 'method' else 'function' end as type,
 cast((p_partkey * 37) % 900 as bigint) as line, cast((p_partkey * 37) % 900 + p_size * (1 + p_partkey % 5) as bigint) as end_line, p_size as complexity, p_partkey % 2 = 0 as is_exported, p_partkey % 10 = 0 as is_test,
 cast(p_partkey % 30 as bigint) as fan_in, cast(p_partkey % 27 as bigint) as methods, case p_partkey % 3 when 0 then 'go' when 1 then 'python' else 'rust' end as family,
 'src/' || p_brand || '/' || lower(p_type) || '.go' as path from part)"""
REFERENCES_SQL = """refs as (select l_orderkey * 10 + l_linenumber as ref_id, l_partkey as target_symbol, cast(l_orderkey % 100 as bigint) as file_id, cast(l_orderkey % 900 as bigint) as line,
 case l_returnflag when 'A' then 'import' else 'call' end as type, case l_linestatus when 'F' then 'tight' else 'loose' end as strength from lineitem)"""
CALLS_SQL = "calls as (select distinct cast(l_suppkey as bigint) as src, cast(l_partkey % 100 + 1 as bigint) as dst from lineitem)"


def symbols(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    line = (k * 37) % 900
    kind = F.when(k % 4 == 0, "class").when(k % 4 == 1, "method").otherwise("function")
    family = F.when(k % 3 == 0, "go").when(k % 3 == 1, "python").otherwise("rust")
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.lower("p_type"), F.lit(".go"))
    return read(spark, sf, "part").select(
        k.alias("symbol_id"), (k % 99).alias("file_id"), F.col("p_name").alias("name"), kind.alias("type"), line.alias("line"), (line + size * (1 + k % 5)).alias("end_line"), size.alias("complexity"),
        (k % 2 == 0).alias("is_exported"), (k % 10 == 0).alias("is_test"), (k % 30).alias("fan_in"), (k % 27).alias("methods"), family.alias("family"), path.alias("path"),
    )


def references(spark, sf):
    k = F.col("l_orderkey")
    kind, strength = F.when(F.col("l_returnflag") == "A", "import").otherwise("call"), F.when(F.col("l_linestatus") == "F", "tight").otherwise("loose")
    return read(spark, sf, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("ref_id"), F.col("l_partkey").alias("target_symbol"), (k % 100).alias("file_id"), (k % 900).alias("line"), kind.alias("type"), strength.alias("strength"))


def calls(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100 + 1).alias("dst")).distinct()


# Names


SPLIT = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '([A-Za-z])([0-9])', '\1_\2', 'g'), '([0-9])([A-Za-z])', '\1_\2', 'g')), '[_\-./ ]+'), lambda p: p <> '')"
NAMES_SQL = "names as (select c_name || 'XMLParser_v2' as name from customer union all select p_name from part)"


def names(spark, sf):
    return read(spark, sf, "customer").select(F.concat("c_name", F.lit("XMLParser_v2")).alias("name")).unionAll(read(spark, sf, "part").select("p_name"))


@query(f"with {NAMES_SQL}, s as (select name, unnest({SPLIT}) as word from names) select word, count(*)::bigint as n, count(distinct name)::bigint as holders from s group by word")
def h01_split_vocabulary(spark, sf):
    return M.vocabulary(names(spark, sf))


@query(None)
def h02_porter_stems(spark, sf):
    return M.vocabulary(names(spark, sf)).select("word", N.porter2_udf("word").alias("stem"))


@query(f"""with {NAMES_SQL}, w as (select distinct unnest({SPLIT}) as word from names)
select word, case when suffix_ok and word like '%ies' then substr(word, 1, length(word) - 3) || 'y' when word like '%ing' and length(word) >= 6 then substr(word, 1, length(word) - 3) when word like '%ed' and length(word) >= 5 then substr(word, 1, length(word) - 2)
 when word like '%es' and length(word) >= 5 then substr(word, 1, length(word) - 2) when word like '%s' and length(word) >= 4 then substr(word, 1, length(word) - 1) else word end as stem from (select word, length(word) >= 6 as suffix_ok from w)""")
def h03_simple_stems(spark, sf):
    return M.vocabulary(names(spark, sf)).select("word", T.simple_stem(F.col("word")).alias("stem"))


PAIRS_SQL = "pairs as (select a.n_name as a, b.r_name as b from nation a join region b on a.n_regionkey = b.r_regionkey union all select p_name, p_type from (select distinct p_name, p_type from part))"


def pairs(spark, sf):
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    return n.unionAll(read(spark, sf, "part").select("p_name", "p_type").distinct())


@query(f"with {PAIRS_SQL} select a, b, round(jaro_winkler_similarity(a, b), 6) as score from pairs")
def h04_jaro_winkler(spark, sf):
    return pairs(spark, sf).select("a", "b", F.round(N.jaro_winkler_udf("a", "b"), 6).alias("score"))


@query(None)
def h05_indel_ratio(spark, sf):
    return pairs(spark, sf).select("a", "b", N.indel_ratio_udf("a", "b").alias("ratio"), N.token_set_ratio_udf("a", "b").alias("token_set"))


@query(f"with {PAIRS_SQL} select a, b, levenshtein(a, b)::bigint as distance from pairs")
def h07_levenshtein(spark, sf):
    return pairs(spark, sf).select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"))


@query(None)
def h08_semantic_scores(spark, sf):
    # Small rows that take long: a number of parts of its own, as their bytes would make few.
    dealt = names(spark, sf).distinct().repartition(4 * spark.sparkContext.defaultParallelism)
    # Nondeterministic, so that the filter on its result stays above the deal.
    score = N.semantic_score_udf("red widgets", {"red": 1, "crimson": 1}).asNondeterministic()
    scored = dealt.select("name", score("name").alias("s"))
    return scored.select("name", "s.score", "s.detector").where("score >= 0.2").orderBy(F.col("score").desc(), "name").limit(10)


@query("with s as (select distinct c_name || '_x' as name from customer union select distinct p_type from part union select distinct p_name from part) select name, case when regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') then 'snake' when regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$') then 'screaming_snake' when regexp_matches(name, '^[a-z][a-z0-9]*(-[a-z0-9]+)+$') then 'kebab' when regexp_matches(name, '^[A-Z][A-Za-z0-9]*$') and regexp_matches(name, '[a-z]') then 'pascal' when regexp_matches(name, '^[a-z][A-Za-z0-9]*$') and regexp_matches(name, '[A-Z]') then 'camel' when regexp_matches(name, '^[a-z][a-z0-9]*$') then 'lower' else 'other' end as style from s")
def h14_case_styles(spark, sf):
    part = read(spark, sf, "part")
    all_names = read(spark, sf, "customer").select(F.concat("c_name", F.lit("_x")).alias("name")).unionAll(part.select("p_type")).unionAll(part.select("p_name")).distinct()
    return all_names.select("name", T.case_style(F.col("name")).alias("style"))


@query(f"with {FILES_SQL} select file_id, 1 + len(regexp_extract_all(content, '\\b(if|elif|for|while|case|catch|except)\\b')) + len(regexp_extract_all(content, '(&&|\\|\\||\\?[^?.:])')) as complexity from files")
def b09_complexity(spark, sf):
    return files(spark, sf).select("file_id", T.cyclomatic(F.col("content")).alias("complexity"))


# Duplicates


@query(f"""with {FILES_SQL}, n as (select file_id, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda s: regexp_replace(s, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda s: s <> '' and not regexp_matches(s, '^(//|#|\\*|/\\*|--)')), chr(10)) as t from files)
select sha256(t) as digest, count(*)::bigint as copies, min(file_id) as first_id from n where t <> '' group by 1 having count(*) > 1""")
def d11_exact_duplicates(spark, sf):
    return D.exact_duplicates(files(spark, sf))


TOKENS_SQL = "list_distinct(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+'))"


@query(f"""with d as (select doc_id, {TOKENS_SQL.format('text')} as x from documents), b as (select item_id, {TOKENS_SQL.format('text')} as y from benchmark),
p as (select doc_id as left_id, item_id as right_id, len(list_intersect(x, y))::double as i, len(x) as n, len(y) as m from d join b on least(len(x), len(y)) >= 0.3 * greatest(len(x), len(y)))
select left_id, right_id, round(i / greatest(n + m - i, 1), 6) as similarity from p where round(i / greatest(n + m - i, 1), 6) >= 0.3""")
def d12_similar_documents(spark, sf):
    left = D.token_sets(read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")))
    right = D.token_sets(read(spark, sf, "benchmark").select(F.col("item_id").alias("file_id"), F.col("text").alias("content")))
    return D.similar_pairs(left, right, 0.3)


@query("with n as (select distinct p_type as type, p_name as name from part) select a.type, a.name as a, b.name as b, round(jaro_winkler_similarity(a.name, b.name), 6) as score from n a join n b on a.type = b.type and a.name < b.name where jaro_winkler_similarity(a.name, b.name) >= 0.9")
def d13_similar_names(spark, sf):
    return D.similar_names(read(spark, sf, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("name"))).withColumn("score", F.round("score", 6))


@query(f"with {NAMES_SQL}, w as (select unnest({SPLIT}) as word from names), c as (select word, count(*)::bigint as n from w group by word) select v.short, v.long, a.n as n_short, b.n as n_long from (values ('xml', 'widget'), ('v', 'parser'), ('zz', 'customer')) v(short, long) join c a on a.word = v.short join c b on b.word = v.long")
def d14_abbreviations(spark, sf):
    return D.abbreviations(names(spark, sf), {"xml": "widget", "v": "parser", "zz": "customer"})


# Symbols and joins

POINTS_SQL = "points as (select distinct cast(o_orderkey % 100 as bigint) as file_id, cast(o_custkey % 900 as bigint) as at from orders)"


def points(spark, sf):
    return read(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("file_id"), (F.col("o_custkey") % 900).alias("at")).distinct()


INSIDE = f"{SYMBOLS_SQL}, {POINTS_SQL}, j as (select p.file_id, p.at as p_at, s.symbol_id, s.name, s.line, s.end_line from points p join symbols s on p.file_id = s.file_id and p.at between s.line and s.end_line)"


@query(f"with {INSIDE}, r as (select *, row_number() over (partition by file_id, (p_at) order by symbol_id) as k from j) select file_id, p_at as \"at\", symbol_id, name from r where k = 1")
def d03_first_enclosing(spark, sf):
    return Y.enclosing(points(spark, sf), symbols(spark, sf), "first")


@query(f"with {INSIDE}, r as (select *, row_number() over (partition by file_id, (p_at) order by end_line - line, line, symbol_id) as k from j) select file_id, p_at as \"at\", symbol_id, name from r where k = 1")
def d04_smallest_enclosing(spark, sf):
    return Y.enclosing(points(spark, sf), symbols(spark, sf), "smallest")


@query(f"with {SYMBOLS_SQL}, {POINTS_SQL} select p.file_id, p.at, (select s.symbol_id from symbols s where s.file_id = p.file_id and s.line <= p.at order by s.line desc, s.symbol_id desc limit 1) as symbol_id from points p")
def d05_last_start(spark, sf):
    return Y.last_start(points(spark, sf), symbols(spark, sf))


@query(f"with {SYMBOLS_SQL} select c.symbol_id as class_id, count(*)::bigint as n from symbols c join symbols m on c.file_id = m.file_id and c.type = 'class' and m.type = 'method' and m.line >= c.line and m.end_line <= c.end_line group by 1")
def d06_methods_in_classes(spark, sf):
    return Y.members(symbols(spark, sf), "class", "method")


ASKED_SQL = """asked as (select s_suppkey as ref_id, case when s_suppkey % 3 = 0 then 'T' || (s_suppkey % 70) || '.red widget' else 'red widget' end as referenced_name, 'red widget' as bare, case when s_suppkey % 3 = 0 then 'T' || (s_suppkey % 70) end as receiver,
 s_suppkey % 100 as file_id, ['go', 'unknown', 'zig', 'rust'][s_suppkey % 4 + 1] as family, s_suppkey % 100 in (select s_suppkey % 100 from supplier where s_suppkey % 5 = 0) as imported from supplier)"""


@query(f"""with {SYMBOLS_SQL}, {ASKED_SQL}, c as (select a.*, s.symbol_id, coalesce('T' || (s.symbol_id % 50) = a.receiver, false) as typed, a.file_id = s.file_id as near, s.is_exported, s.is_test, s.family as target_family from asked a join symbols s on s.name = a.bare),
r as (select ref_id, symbol_id, row_number() over (partition by ref_id order by not typed, not near, not imported and not is_exported, not imported and not is_exported and is_test, symbol_id) as k from c where typed or near or family = target_family or family = 'unknown')
select ref_id, symbol_id as target_symbol from r where k = 1""")
def d07_resolved_references(spark, sf):
    k, s = F.col("s_suppkey"), symbols(spark, sf)
    receiver = F.when(k % 3 == 0, F.concat(F.lit("T"), (k % 70).cast("string"), F.lit(".")))
    family = F.element_at(F.array(*map(F.lit, ("go", "unknown", "zig", "rust"))), (k % 4 + 1).cast("int"))
    asked = read(spark, sf, "supplier").select(k.alias("ref_id"), F.concat(F.coalesce(receiver, F.lit("")), F.lit("red widget")).alias("referenced_name"), (k % 100).alias("file_id"), family.alias("family"))
    imports = read(spark, sf, "supplier").where("s_suppkey % 5 = 0").select((k % 100).alias("file_id"), F.lit("red widget").alias("imported_name"))
    return Y.resolve(asked, s.withColumn("receiver_type", F.concat(F.lit("T"), (F.col("symbol_id") % 50).cast("string"))), imports)


@query(f"with {REFERENCES_SQL} select target_symbol, count(*)::bigint as uses, count(distinct file_id)::bigint as files, count(case when strength = 'tight' then 1 end)::bigint as tight from refs where type <> 'import' group by target_symbol")
def b17_reference_stats(spark, sf):
    return Y.reference_stats(references(spark, sf))


@query(f"with {SYMBOLS_SQL}, {REFERENCES_SQL} select s.name, r.file_id, count(*)::bigint as n from symbols s join refs r on r.target_symbol = s.symbol_id group by s.name, r.file_id")
def d01_references_by_name(spark, sf):
    s = symbols(spark, sf).select(F.col("symbol_id").alias("target_symbol"), "name")
    return references(spark, sf).join(s, "target_symbol").groupBy("name", "file_id").agg(F.count("*").alias("n"))


@query(f"with {SYMBOLS_SQL} select symbol_id from symbols s where not exists (select 1 from lineitem where l_partkey = s.symbol_id and l_shipdate >= timestamp '2001-01-01') and exists (select 1 from lineitem where l_partkey = s.symbol_id)")
def d08_semi_and_anti(spark, sf):
    l = read(spark, sf, "lineitem").withColumnRenamed("l_partkey", "symbol_id")
    return symbols(spark, sf).select("symbol_id").join(l, "symbol_id", "left_semi").join(l.where("l_shipdate >= timestamp '2001-01-01'"), "symbol_id", "left_anti")


@query(f"with {SYMBOLS_SQL} select symbol_id, name, complexity from symbols where type = 'function' and is_exported and complexity between 10 and 40 and name like '%widget%' order by complexity desc, name, symbol_id limit 20 offset 10")
def c36_listing_page(spark, sf):
    where = (F.col("type") == "function") & F.col("is_exported") & F.col("complexity").between(10, 40) & F.col("name").contains("widget")
    ordered = symbols(spark, sf).where(where).orderBy(F.col("complexity").desc(), "name", "symbol_id")
    return ordered.offset(10).limit(20).select("symbol_id", "name", "complexity")


@query(f"with {SYMBOLS_SQL} select count(*)::bigint as total, count(*) > 30 as has_more from symbols where type = 'class'")
def c36_has_more(spark, sf):
    return Y.has_more(symbols(spark, sf), F.col("type") == "class", 10, 20)


@query(f"with {SYMBOLS_SQL} select symbol_id, name from symbols where file_id = 7 and 300 between line and end_line order by name <> 'red widget', end_line - line, symbol_id limit 1")
def m03_definition(spark, sf):
    return Y.definitions(symbols(spark, sf), 7, 300, "red widget").select("symbol_id", "name")


@query(f"with {SYMBOLS_SQL}, g as (select name, count(*)::bigint as n, min(is_test::int) as t from symbols group by name order by t, n desc, name limit 25) select name || ' x' || n::varchar as label, n from g")
def m01_name_counts(spark, sf):
    return M.name_counts(symbols(spark, sf))


@query(f"with {SYMBOLS_SQL} select file_id, type, count(*)::bigint as n, min(line) as first_line from symbols where file_id = 7 group by file_id, type")
def c38_browse_file(spark, sf):
    return symbols(spark, sf).where("file_id = 7").groupBy("file_id", "type").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


# Metrics

HEALTH = "h as (select avg(greatest(complexity, 1)) as a, count(*)::double as t, count(case when complexity <= 10 then 1 end) as l, count(case when complexity > 10 and complexity <= 20 then 1 end) as m, count(case when complexity > 20 then 1 end) as x from symbols where type <> 'class')"


def functions(spark, sf):
    return symbols(spark, sf).where("type <> 'class'")


@query(f"with {SYMBOLS_SQL} select round(avg(complexity), 6) as average, median(complexity)::double as median, quantile_cont(complexity, 0.75)::double as p75, quantile_cont(complexity, 0.9)::double as p90, round(avg(complexity) * 1.2, 6) as derived_p75, round(avg(complexity) * 1.5, 6) as derived_p90, count(case when complexity <= 10 then 1 end)::bigint as low, count(case when complexity > 10 and complexity <= 20 then 1 end)::bigint as medium, count(case when complexity > 20 then 1 end)::bigint as high from symbols where type <> 'class'")
def e01_complexity(spark, sf):
    return M.complexity(functions(spark, sf))


@query(f"with {SYMBOLS_SQL}, {HEALTH} select round(greatest(least(10.0 - 4.0 * x / t - 1.5 * m / t - case when a > 10 then least((round(a, 6) - 10) * 0.15, 3.0) else 0.0 end + case when l / t > 0.8 then 1.0 when l / t > 0.6 then 0.5 else 0.0 end, 10.0), 0.0), 6)::double as score, round(greatest(0.0, 100 - 2 * round(a, 6)), 6)::double as maintainability from h")
def e02_health(spark, sf):
    return M.health(functions(spark, sf))


@query(f"with {SYMBOLS_SQL}, d as (select count(*)::bigint as symbols, count(case when complexity > 15 or fan_in > 10 then 1 end)::bigint as indebted from symbols) select symbols, indebted, round(indebted::double / symbols, 6) as ratio, case when indebted < 0.05 * symbols then '1 day' when indebted < 0.10 * symbols then '1 week' when indebted < 0.20 * symbols then '2 weeks' when indebted < 0.30 * symbols then '1 month' else '3+ months' end as remediation from d")
def e03_debt(spark, sf):
    return M.debt(symbols(spark, sf))


@query(f"with {SYMBOLS_SQL} select file_id, count(*)::bigint as issues from symbols where complexity > 15 or fan_in > 10 group by file_id having count(*) > 5 order by issues desc, file_id limit 5")
def e03_debt_components(spark, sf):
    return M.debt_components(symbols(spark, sf))


@query(f"with {SYMBOLS_SQL} select symbol_id, name, complexity, greatest(end_line - line, 1) as lines, round(least(0.7 * complexity + 0.03 * greatest(end_line - line, 1), 10.0), 6)::double as risk from symbols where type <> 'class' and (complexity > 10 or end_line - line > 50)")
def e05_hotspots(spark, sf):
    return M.hotspots(functions(spark, sf))


SMELLS = """smells as (select symbol_id, 'long-function' as smell, end_line - line as value, case when end_line - line > 100 then 'high' else 'medium' end as severity from symbols where end_line - line > 50
union all select symbol_id, 'high-complexity', complexity, case when complexity > 20 then 'high' else 'medium' end from symbols where complexity > 10
union all select symbol_id, 'god-class', methods, case when methods > 25 then 'high' else 'medium' end from symbols where methods > 15
union all select symbol_id, 'high-fan-in', fan_in, case when fan_in > 20 then 'high' else 'medium' end from symbols where fan_in > 10)"""


@query(f"with {SYMBOLS_SQL}, {SMELLS} select * from smells")
def e06_smells(spark, sf):
    return M.smells(symbols(spark, sf))


@query(f"with {SYMBOLS_SQL} select symbol_id, round(least(0.7 * complexity + 0.03 * (end_line - line), 10.0), 6)::double as risk, list_filter([case when complexity > 10 then 'complex' end, case when end_line - line > 50 then 'long' end, case when fan_in > 10 then 'central' end], lambda x: x is not null) as tags from symbols where least(0.7 * complexity + 0.03 * (end_line - line), 10.0) >= 5 order by risk desc, symbol_id limit 5")
def e07_problematic(spark, sf):
    return M.problematic(symbols(spark, sf))


@query(f"with {SYMBOLS_SQL}, {SMELLS} select smell, severity, count(*)::bigint as n from smells group by smell, severity")
def e08_smell_counts(spark, sf):
    return M.smells(symbols(spark, sf)).groupBy("smell", "severity").agg(F.count("*").alias("n"))


EDGES_SQL = "edges as (select r.n_regionkey as src_package, c.c_nationkey % 5 as dst_package from orders join customer c on o_custkey = c_custkey join nation r on r.n_nationkey = (o_orderkey % 25))"


def package_edges(spark, sf):
    o, c, n = read(spark, sf, "orders"), read(spark, sf, "customer"), read(spark, sf, "nation")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("n_nationkey") == F.col("o_orderkey") % 25).select(F.col("n_regionkey").alias("src_package"), (F.col("c_nationkey") % 5).alias("dst_package"))


@query(f"with {EDGES_SQL}, x as (select distinct src_package, dst_package from edges where src_package <> dst_package), e as (select src_package as package, count(*)::bigint as efferent from x group by 1), a as (select dst_package as package, count(*)::bigint as afferent from x group by 1), p as (select src_package as package from edges union select dst_package from edges) select p.package, coalesce(afferent, 0)::bigint as afferent, coalesce(efferent, 0)::bigint as efferent, round(case when coalesce(afferent, 0) + coalesce(efferent, 0) > 0 then coalesce(efferent, 0)::double / (coalesce(afferent, 0) + coalesce(efferent, 0)) else 0.0 end, 6) as instability from p left join a on a.package = p.package left join e on e.package = p.package")
def e09_coupling(spark, sf):
    return M.coupling(package_edges(spark, sf))


@query(f"with {EDGES_SQL} select src_package as package, count(case when src_package = dst_package then 1 end)::bigint as inside, count(*)::bigint as total, round(count(case when src_package = dst_package then 1 end)::double / count(*), 6) as cohesion from edges group by 1")
def e09_cohesion(spark, sf):
    return M.cohesion(package_edges(spark, sf))


@query(f"with {EDGES_SQL} select src_package, dst_package, count(*)::bigint as n from edges group by 1, 2")
def d17_dependency_matrix(spark, sf):
    return M.dependency_matrix(package_edges(spark, sf))


@query(f"with {SYMBOLS_SQL}, n as (select split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as module, path, split_part(name, ' ', 1) as prefix from symbols), g as (select module, prefix, count(*) as n from n group by 1, 2), m as (select module, max(n) as most, sum(n)::bigint as functions from g group by 1), f as (select module, count(distinct path)::bigint as files from n group by 1) select m.module, files, functions, round(most::double / functions, 6) as cohesion, round(1 / (1 + functions / 10.0::double), 6) as stability from m join f on m.module = f.module")
def e10_modules(spark, sf):
    return M.modules(symbols(spark, sf))


WORDS = ("OrderService", "user_model", "loadAll", "renderList", "HttpClient", "validateInput", "sqlMapper", "x", "PageView", "computeLog")
LAYERED_SQL = f"layered as (select *, {list(WORDS)!r}[symbol_id % 10 + 1] as word from symbols)"
LAYER_SQL = """case when type in ('class', 'struct', 'interface') and (w like '%service%' or w like '%manager%') then 'Application Layer' when type in ('class', 'struct', 'interface') and (w like '%model%' or w like '%entity%') then 'Domain Layer'
 when type in ('class', 'struct', 'interface') and (w like '%repository%' or w like '%dao%') then 'Data Layer' when type in ('class', 'struct', 'interface') and (w like '%component%' or w like '%view%') then 'Presentation Layer'
 when type in ('function', 'method') and w like '%render%' then 'Presentation Layer' when type in ('function', 'method') and (w like '%save%' or w like '%load%') then 'Data Layer' when type in ('function', 'method') and (w like '%validate%' or w like '%compute%') then 'Domain Layer'
 when regexp_matches(w, 'component|view|page|screen|ui|widget|button|input|modal|dialog|layout|template|render|display') then 'Presentation Layer' when regexp_matches(w, 'service|manager|facade|app|controller|handler|command|interactor|usecase') then 'Application Layer'
 when regexp_matches(w, 'domain|model|entity|aggregate|valueobject|business|logic|rule|constraint|validation') then 'Domain Layer' when regexp_matches(w, 'repository|dao|dataaccess|persistence|storage|database|sql|mapper|orm') then 'Data Layer'
 when regexp_matches(w, 'config|adapter|driver|client|http|api|log|metric|cache|queue|message') then 'Infrastructure Layer' else 'Utility Layer' end"""


@query(f"with {SYMBOLS_SQL}, {LAYERED_SQL} select {LAYER_SQL} as layer, type, count(*)::bigint as symbols from (select *, lower(word) as w from layered) group by 1, 2")
def e11_layers(spark, sf):
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("symbol_id") % 10 + 1).cast("int"))
    return symbols(spark, sf).groupBy(M.layer(word, F.col("type")).alias("layer"), "type").agg(F.count("*").alias("symbols"))


@query(f"with {NAMES_SQL}, w as (select unnest({SPLIT}) as word from names), d as (select v.domain, count(distinct w.word)::bigint as terms, count(*)::bigint as n from w join (values ('paint', 'red'), ('paint', 'blue'), ('text', 'xml'), ('text', 'parser')) v(domain, word) on v.word = w.word group by 1) select *, round(least(1.0, log10(n + 1) / 3), 6) as confidence from d")
def e12_domain_terms(spark, sf):
    return M.domain_terms(names(spark, sf), {"paint": ["red", "blue"], "text": ["xml", "parser"]})


@query(f"with {NAMES_SQL}, w as (select name, unnest({SPLIT}) as word from names) select word, count(*)::bigint as n, count(distinct name)::bigint as holders from w where word not in ('widget', 'customer', 'red') group by word having count(distinct name) >= 2 order by n desc, word limit 15")
def e13_unknown_words(spark, sf):
    return M.unknown_words(names(spark, sf), ["widget", "customer", "red"])


@query(f"with {SYMBOLS_SQL}, {LAYERED_SQL} select symbol_id, round(fan_in::double * case when is_exported then 1.5 else 1.0 end * case when word in ('main', 'Main') then 2.0 else 1.0 end * case when regexp_matches(lower(word), 'handler|controller|service') then 1.3 else 1.0 end * (1 + complexity / 20.0::double), 6) as score from layered order by score desc, symbol_id limit 20")
def e14_critical_functions(spark, sf):
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("symbol_id") % 10 + 1).cast("int"))
    return M.importance(symbols(spark, sf).withColumn("name", word), 20)


@query(f"with {FILES_SQL} select case file_id % 5 when 0 then 'py' when 1 then 'md' when 2 then 'json' when 3 then 'go' else 'bin' end as extension, case file_id % 5 when 0 then 'code' when 1 then 'documentation' when 2 then 'config' when 3 then 'test' else 'unknown' end as category, count(*)::bigint as files, 3::bigint as depth from files group by 1, 2")
def e16_structure(spark, sf):
    return M.structure(files(spark, sf))


@query("with s as (select l_partkey, sum(1)::bigint as n from lineitem group by 1), f as (select p_partkey as symbol_id, case p_size % 4 when 0 then 0 else p_size % 64 end as mask from part) select count(*)::bigint as functions, count(case when mask = 0 then 1 end)::bigint as pure, round(count(case when mask = 0 then 1 end)::double / count(*), 6) as ratio from f")
def e24_purity_summary(spark, sf):
    return M.purity_summary(read(spark, sf, "part").select(F.when(F.col("p_size") % 4 == 0, 0).otherwise(F.col("p_size") % 64).alias("mask")))


@query(f"with {SYMBOLS_SQL} select type, family, count(*)::bigint as symbols, count(distinct file_id)::bigint as files from symbols group by 1, 2")
def e25_index_stats(spark, sf):
    return symbols(spark, sf).groupBy("type", "family").agg(F.count("*").alias("symbols"), F.countDistinct("file_id").alias("files"))


@query("with c as (select conv_id, turn, cast(ceil(strlen(text) / 4.0) as bigint) as cost from conversations), r as (select *, sum(cost) over (partition by conv_id order by turn rows unbounded preceding) as used from c) select conv_id, turn, used::bigint as used from r where used <= 800")
def e26_token_budget(spark, sf):
    c = read(spark, sf, "conversations").withColumn("cost", M.token_estimate(F.col("text")))
    return M.within_budget(c, "cost", 800, ["conv_id"], "turn").select("conv_id", "turn", "used")


@query(f"with {REFERENCES_SQL} select target_symbol, count(*)::bigint as uses from refs where type <> 'import' group by 1 order by uses desc, target_symbol limit 10")
def e27_top_symbols(spark, sf):
    return Y.reference_stats(references(spark, sf)).select("target_symbol", "uses").orderBy(F.col("uses").desc(), "target_symbol").limit(10)


FINDINGS_SQL = """f as (select symbol_id, 'high-complexity' as finding, case when complexity > 20 then 'critical' else 'warning' end as severity from symbols where complexity > 10 and type in ('function', 'method')
union all select symbol_id, 'long-function', case when end_line - line > 200 then 'critical' else 'warning' end from symbols where end_line - line > 100 and type in ('function', 'method')
union all select symbol_id, 'deep-nesting', case when fan_in % 9 > 6 then 'critical' else 'warning' end from symbols where fan_in % 9 > 4 and type in ('function', 'method')
union all select symbol_id, 'complexity-growth', 'warning' from symbols where fan_in > 0 and complexity > fan_in and floor((complexity - fan_in) * 100.0 / fan_in) >= 50 and type in ('function', 'method')
union all select symbol_id, 'purity-lost', 'warning' from symbols where is_exported and is_test and type in ('function', 'method'))"""


@query(f"with {SYMBOLS_SQL}, {FINDINGS_SQL} select * from f")
def m15_change_findings(spark, sf):
    s = symbols(spark, sf)
    return M.change_findings(s.select("*", (F.col("fan_in") % 9).alias("nesting"), F.col("fan_in").alias("old_complexity"), F.col("is_exported").alias("old_pure"), (~F.col("is_test")).alias("pure")))


@query(f"with {SYMBOLS_SQL}, g as (select ['duplicate', 'naming', 'metrics'][symbol_id % 3 + 1] as kind, ['critical', 'warning', 'info'][complexity % 3 + 1] as severity, file_id from symbols), w as (select file_id, case kind when 'duplicate' then case severity when 'critical' then 0.15 when 'warning' then 0.08 else 0.03 end when 'naming' then case severity when 'critical' then 0.10 when 'warning' then 0.05 else 0.02 end else case severity when 'critical' then 0.12 when 'warning' then 0.06 else 0.02 end end::double as weight from g) select file_id, count(*)::bigint as findings, round(least(sum(weight), 1.0), 6) as risk from w group by file_id")
def e23_change_risk(spark, sf):
    pick = lambda words, c: F.element_at(F.array(*map(F.lit, words)), (F.col(c) % 3 + 1).cast("int"))
    found = symbols(spark, sf).select("file_id", pick(("duplicate", "naming", "metrics"), "symbol_id").alias("kind"), pick(("critical", "warning", "info"), "complexity").alias("severity"))
    return M.change_risk(found, ["file_id"])


@query(f"with {SYMBOLS_SQL}, {LAYERED_SQL} select symbol_id, least(1 + least(fan_in // 2, 5) + least(methods // 2, 3) + case when complexity > 10 then 2 else 0 end + case when regexp_matches(word, '^[A-Z]') then 2 else 0 end, 10)::bigint as impact, case when fan_in > 10 or methods > 10 then 'high' when fan_in > 3 or methods > 3 then 'medium' else 'low' end as breaking_risk from layered")
def h23_change_impact(spark, sf):
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("symbol_id") % 10 + 1).cast("int"))
    s = symbols(spark, sf)
    return s.select("symbol_id", M.change_impact(F.col("fan_in"), F.col("methods"), F.col("complexity"), word).cast("long").alias("impact"), M.breaking_risk(F.col("fan_in"), F.col("methods")).alias("breaking_risk"))


@query("with n as (select unnest(['printAll', 'fopen', 'logger', 'sendMail', 'HTTPGet', 'recvFrom', 'queryRows', 'execute', 'exec', 'evalExpr', 'panicNow', 'Raise', 'compute', 'closeAll', 'acceptOne', 'rollback']) as name) select name, case when regexp_matches(lower(name), '^(print|fprint|puts|fputs|printf|fprintf|scanf|fscanf|fopen|fread|fwrite|open|close|log|logger)') then 32 when regexp_matches(lower(name), '^(send|recv|fetch|dial|listen|accept|connect|request|httpget|httppost)') then 128 when regexp_matches(lower(name), '^(query|execute|prepare|transaction|commit|rollback)') then 64 when regexp_matches(lower(name), '^(panic|raise|throw|abort)') then 256 when regexp_matches(lower(name), '^(eval|exec)') then 4096 else 0 end::bigint as mask from n")
def h17_effects_of_names(spark, sf):
    names = ("printAll", "fopen", "logger", "sendMail", "HTTPGet", "recvFrom", "queryRows", "execute", "exec", "evalExpr", "panicNow", "Raise", "compute", "closeAll", "acceptOne", "rollback")
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", M.effect_mask(F.col("name")).alias("mask"))


# Graphs


@query(f"with {CALLS_SQL} select src, dst from calls")
def f01_call_graph(spark, sf, calls=calls):
    return G.edges_of(calls(spark, sf))


@query(f"with recursive {CALLS_SQL}, w as (select 1::bigint as root, 1::bigint as node, 0 as depth union select w.root, c.dst, w.depth + 1 from w join calls c on c.src = w.node where w.depth < 4) select root, node, min(depth) as depth from w group by root, node")
def d15_call_tree(spark, sf, calls=calls):
    seeds = spark.createDataFrame([(1,)], "node long")
    return G.walk(calls(spark, sf), seeds, Scratch(spark, "walk"), 4)


#: Each customer calls one of a quarter of its number: trees of as many nodes that lead to a few cycles.
SPARSE_SQL = "calls as (select distinct c_custkey as src, c_custkey // 4 + c_nationkey % 5 + 1 as dst from customer)"


def sparse_calls(spark, sf):
    return read(spark, sf, "customer").selectExpr("c_custkey as src", "c_custkey div 4 + c_nationkey % 5 + 1 as dst").distinct()


CLOSURE = f"recursive {SPARSE_SQL}, t as (select src, dst from calls union select t.src, c.dst from t join calls c on t.dst = c.src)"


@query(f"with {CLOSURE}, n as (select src as node from calls union select dst from calls) select n.node, count(t.src)::bigint as callers from n left join t on t.dst = n.node group by n.node")
def f03_incoming_reach(spark, sf, calls=sparse_calls):
    return G.reach(calls(spark, sf), Scratch(spark, "reach"))


@query(f"with {CLOSURE}, b as (select a.src as x, a.dst as y from t a join t b on a.src = b.dst and a.dst = b.src), c as (select x, least(x, min(y)) as component from b group by x) select component, count(*)::bigint as size from c group by component")
def f02_cycles(spark, sf, calls=sparse_calls):
    return G.cycles(calls(spark, sf), Scratch(spark, "scc"))


@query(f"with recursive {SPARSE_SQL}, s as (select distinct src as node, 0 as d from calls where src % 40 = 0 union select c.dst, s.d + 1 from s join calls c on c.src = s.node where s.d < 10) select node, max(pow(0.8, d)) as strength from s where pow(0.8, d) >= 0.1 group by node")
def f06_label_propagation(spark, sf, calls=sparse_calls):
    edges = calls(spark, sf)
    seeds = edges.where("src % 40 = 0").select(F.col("src").alias("node"), F.lit(1.0).alias("strength")).distinct()
    return G.propagate_labels(edges, seeds, Scratch(spark, "labels"))


@query(f"with {CLOSURE}, n as (select src as node from calls union select dst from calls), m as (select node, cast(1 << (node % 6) as bigint) as mask from n where node % 5 = 0), x as (select t.src as node, m.mask & 24039 as mask from t join m on m.node = t.dst union all select node, mask from m), k as (select node, bit_or(mask) as mask from x group by node), w as (select node, 0 as d from m where mask & 24039 <> 0 union select c.src, w.d + 1 from w join calls c on c.dst = w.node where w.d < 40), f as (select node, round(greatest(0.3, pow(0.95, min(d))), 6) as confidence from w group by node) select k.node, k.mask, coalesce(f.confidence, 0.0)::double as confidence from k left join f on f.node = k.node where k.mask <> 0")
def f07_transitive_effects(spark, sf, calls=sparse_calls):
    edges = calls(spark, sf)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    direct = nodes.where("node % 5 = 0").select("node", F.expr("shiftleft(1L, cast(node % 6 as int))").alias("mask"))
    return G.transitive_effects(edges, direct, M.PROPAGATED, Scratch(spark, "masks")).withColumn("confidence", F.round("confidence", 6))


@query(f"with {CALLS_SQL}, l as (select ['Presentation Layer', 'Application Layer', 'Domain Layer', 'Data Layer'] as names) select names[src % 4 + 1] as src_layer, names[dst % 4 + 1] as dst_layer, count(*)::bigint as n from calls, l where src % 4 > dst % 4 group by 1, 2 order by n desc, 1, 2 limit 8")
def f08_layer_violations(spark, sf, calls=calls):
    name = lambda c: F.element_at(F.array(*map(F.lit, M.LAYERS_DOWN)), (F.col(c) % 4 + 1).cast("int"))
    return M.layer_violations(calls(spark, sf).select(name("src").alias("src_layer"), name("dst").alias("dst_layer")))


@query(None)
def f04_betweenness(spark, sf, calls=sparse_calls):
    return G.betweenness(calls(spark, sf))


@query(None)
def f05_communities(spark, sf, calls=sparse_calls):
    return G.communities(calls(spark, sf)).select("node", "community")


@query(f"with {SPARSE_SQL}, e as (select src, dst from calls), n as (select src % 7 as ca, dst % 7 as cb from e), d as (select c, count(*) as d from (select ca as c from n union all select cb from n) group by c), i as (select ca as c, count(*) as i from n where ca = cb group by ca), m as (select count(*)::double as m from e) select round(sum(coalesce(i, 0) / m - (d / (2 * m)) * (d / (2 * m))), 9) as modularity from d left join i on i.c = d.c, m")
def f05_modularity(spark, sf, calls=sparse_calls):
    edges = calls(spark, sf)
    member = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.col("node") % 7)
    return G.modularity(edges, member)
