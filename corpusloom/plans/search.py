"""Search and file queries over documents and pages as files."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import search as S
from corpusloom.plans.registry import BOOST_SQL, CATEGORY_SQL, FILES_SQL, LINES_SQL, PAGES_SQL, files, pages, query

# Score of a literal in SQL: base - no symbol + category + half the complexity.
#: Complexity of the patterns asked for: characters, 2 for each camel hump, 1 for each underscore or digit.
COMPLEXITY = {"edth": 4, "the ": 4, "tion": 4}
SCORE = lambda p: f"70.0 + {BOOST_SQL} + {0.5 * COMPLEXITY[p]}"
FOLD = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""with {LINES_SQL}, h as (select *, row_number() over (partition by file_id order by line) as r from lines where contains(text, 'the '))
select file_id, path, line, text, cast(strlen(substr(text, 1, instr(text, 'the ') - 1)) + 1 as bigint) as "column", {SCORE("the ")} as score from h where r <= 100""")
def c01_literal_search(spark, sf):
    return S.scored(S.hits(files(spark, sf), S.literal("the ")), "the ")


@query(f"with {LINES_SQL} select file_id, line, text from lines where contains({FOLD('text')}, 'tion of')")
def c02_ignore_case(spark, sf):
    return S.hits(files(spark, sf), S.literal("TION of", ignore_case=True), None).select("file_id", "line", "text")


@query(f"with {LINES_SQL} select file_id, line, text from lines where regexp_matches(text, 'th[a-z]+ing .*of')")
def c03_regex_search(spark, sf):
    return S.hits(files(spark, sf), S.regex("th[a-z]+ing .*of"), None).select("file_id", "line", "text")


@query(f"with {LINES_SQL} select file_id, line, text from lines where regexp_matches(text, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])')")
def c04_whole_word(spark, sf):
    return S.hits(files(spark, sf), S.literal("the", whole_word=True), None).select("file_id", "line", "text")


@query(f"""with {LINES_SQL}, p as (select * from (values ('tion'), ('edth'), ('x9_Zz')) v(p)),
h as (select file_id, path, line, p, case p when 'tion' then 2.0 when 'edth' then 2.0 else 4.5 end as c from lines join p on contains(text, p))
select file_id, path, line, count(*)::bigint as n_patterns, round((70.0 + {BOOST_SQL} + max(c)) * (1 + least(0.15 * (count(*) - 1), 0.5)), 6) as score from h group by file_id, path, line""")
def c06_multi_pattern(spark, sf):
    return S.multi(files(spark, sf), ["tion", "edth", "x9_Zz"])


@query(f"with {FILES_SQL} select path, {CATEGORY_SQL} as category, {BOOST_SQL} as boost from files")
def c07_categories(spark, sf):
    kind = T.category(F.col("path"))
    return files(spark, sf).select("path", kind.alias("category"), T.category_boost(kind).alias("boost"))


@query(f"""with {LINES_SQL}, h as (select file_id, line, text, instr({FOLD('text')}, 'the') as hit from lines where contains({FOLD('text')}, 'the')),
e as (select *, case when hit > 1 then substr(text, hit - 1, 1) else '' end as b, substr(text, hit + 3, 1) as a, length(text) - length(regexp_replace(text, '^[ \\t]+', '')) as lead from h)
select file_id, line, (100.0 + case when not regexp_matches(b, '^[A-Za-z0-9_]$') and not regexp_matches(a, '^[A-Za-z0-9_]$') then 50.0 else 0.0 end
 + case when hit = lead + 1 then 25.0 else 0.0 end + case when substr(text, hit, 3) = 'The' then 20.0 else 0.0 end)::double as quality from e""")
def c09_match_quality(spark, sf):
    found = S.hits(files(spark, sf), S.literal("The", ignore_case=True), None)
    return found.select("file_id", "line", T.match_quality(F.col("text"), "The").alias("quality"))


@query(f"with {LINES_SQL} select path, line, {SCORE('tion')} as score from lines where contains(text, 'tion') order by score desc, path, line limit 50")
def c10_ranked_top(spark, sf):
    return S.ranked(S.scored(S.hits(files(spark, sf), S.literal("tion"), None), "tion"), 50).select("path", "line", "score")


@query(f"""with {LINES_SQL} select split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as directory, count(distinct path)::bigint as files, count(*)::bigint as matches
from lines where contains(text, 'tion') group by 1""")
def c12_directory_histogram(spark, sf):
    return S.by_directory(S.hits(files(spark, sf), S.literal("tion"), None))


@query(f"with {FILES_SQL} select file_id, path from files where regexp_matches(path, 'src1.*[.]py$') and not regexp_matches(path, '/de/')")
def c14_path_filters(spark, sf):
    path = F.col("path")
    return files(spark, sf).where(path.rlike("src1.*[.]py$") & ~path.rlike("/de/")).select("file_id", "path")


@query(f"with {FILES_SQL} select file_id, path from files where path like 'src/src1/%' or regexp_matches(path, '^src/src2/[^/]*/file[0-9]*5[.]py$')")
def c15_scopes(spark, sf):
    return S.in_scopes(files(spark, sf), ["src/src1", "src/src2/*/file*5.py"]).select("file_id", "path")


@query("select 'nowhere' as scope")
def c15_unmatched_scopes(spark, sf):
    return S.unmatched_scopes(files(spark, sf), ["src/src1", "nowhere"])


@query(f"with {FILES_SQL} select file_id, case file_id % 5 when 0 then 'python' when 3 then 'go' else 'unknown' end as language, case file_id % 5 when 0 then 'python' when 3 then 'go' else 'unknown' end as family from files where file_id % 5 in (0, 3)")
def c16_language_filter(spark, sf):
    made = files(spark, sf).select("file_id", T.language(F.col("path")).alias("language"), T.family(F.col("path")).alias("family"))
    return made.where(F.col("language").isin("python", "go"))


SYNONYMS = [["that", "which", "onen"], ["and", "plus"]]


@query(f"with {LINES_SQL} select file_id, line, text from lines where contains(text, 'that and') or contains({FOLD('text')}, 'which and') or contains({FOLD('text')}, 'onen and') or contains({FOLD('text')}, 'that plus')")
def c18_synonyms(spark, sf):
    return S.synonym_search(files(spark, sf), "that and", SYNONYMS).select("file_id", "line", "text")


@query(f"""with {LINES_SQL}, h as (select file_id, line from lines where contains(text, 'edth'))
select l.file_id, l.line, l.text, contains(l.text, 'edth') as is_match from lines l where exists (select 1 from h where h.file_id = l.file_id and l.line between h.line - 2 and h.line + 2)""")
def c20_context_lines(spark, sf):
    return S.with_context(files(spark, sf), S.literal("edth"), 2, 2).select("file_id", "line", "text", "is_match")


@query(f"with {LINES_SQL}, m as (select distinct file_id from lines where contains(text, 'the ')) select file_id, line, text from lines where not contains(text, 'the ') and file_id in (select file_id from m)")
def c21_inverted(spark, sf):
    return S.inverted(files(spark, sf), S.literal("the ")).select("file_id", "line", "text")


@query(f"with {LINES_SQL} select file_id, line from lines where contains(text, 'a') and not regexp_matches(ltrim(text), '^(//|#|/[*]|[*]|--)') and {CATEGORY_SQL} <> 'test'")
def c22_exclude_comments_and_tests(spark, sf):
    found = S.hits(files(spark, sf), lambda s: s.contains("a") & ~S.is_comment(s), None)
    return found.where(T.category(F.col("path")) != "test").select("file_id", "line")


@query(None)
def c23_lexical_kinds(spark, sf):
    return S.lexical(S.hits(files(spark, sf), S.literal("en"), None), "en").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"with {LINES_SQL} select file_id, path, count(*)::bigint as n from lines where contains(text, 'tion') group by file_id, path")
def c25_count_per_file(spark, sf):
    return S.per_file(files(spark, sf), S.literal("tion"))


@query(f"with {LINES_SQL}, h as (select file_id, line, row_number() over (partition by file_id order by line) as r from lines where contains(text, 'e')) select file_id, line from h where r <= 3")
def c25_max_per_file(spark, sf):
    return S.hits(files(spark, sf), S.literal("e"), 3).select("file_id", "line")


@query(f"with {LINES_SQL} select path, line, case when contains(text, 'tion') then 0 else 1 end as source_no from lines where contains(text, 'tion') or contains(text, 'edth')")
def c26_union_first_wins(spark, sf):
    f = files(spark, sf)
    return S.union_first([S.hits(f, S.literal(p), None).select("path", "line") for p in ("tion", "edth")]).select("path", "line", "source_no")


@query(f"with {LINES_SQL} select file_id, line from lines where regexp_matches(text, 'inter[a-z]* .nd')")
def c27_seeded_regex(spark, sf):
    return S.hits(files(spark, sf), S.regex("inter[a-z]* .nd"), None).select("file_id", "line")


@query(f"with {LINES_SQL} select file_id, line from lines where regexp_matches(text, '((abc)?inter)?[a-z]* that|\\x74hat$')")
def c27_nested_groups(spark, sf):
    return S.hits(files(spark, sf), S.regex(r"((abc)?inter)?[a-z]* that|\x74hat$"), None).select("file_id", "line")


@query(f"with {LINES_SQL} select file_id, line, text from lines where path like '%.py' and contains(text, 'tion') and contains(text, 'that') and not contains(lower(text), 'edth') and not contains(lower(path), 'edth')")
def c28_query_syntax(spark, sf):
    return S.run_query(files(spark, sf), "file:*.py tion that -edth").select("file_id", "line", "text")


@query(f"with {LINES_SQL} select path, line, row_number() over (order by {BOOST_SQL} desc, path, line) as place from lines where contains(text, 'edth')")
def c29_rank_by_file_type(spark, sf):
    from pyspark.sql import Window

    found = S.hits(files(spark, sf), S.literal("edth"), None)
    order = Window.orderBy(T.category_boost(T.category(F.col("path"))).desc(), "path", "line")
    return found.select("path", "line", F.row_number().over(order).alias("place"))


@query(f"""with {LINES_SQL} select path, list_sort(list(line)) as lines, {SCORE('edth').replace('file_id', 'min(file_id)')} as score, count(*)::bigint as n, min(file_id) % 5 = 1 as is_other
from lines where contains(text, 'edth') group by path""")
def c32_grouped_by_file(spark, sf):
    return S.grouped(S.scored(S.hits(files(spark, sf), S.literal("edth"), None), "edth"))


@query(f"""with {PAGES_SQL}, n as (select path, {FOLD("path")} as p, {FOLD("regexp_extract(path, '[^/]*$')")} as base from files),
m as (select path, p, base, regexp_replace(base, '[.][^.]*$', '') as bare, instr(p, '12') - 1 as hit from n),
s as (select path, case when p = '12' then 1.0 when base = '12' then 0.95 when bare = '12' then 0.93 when hit >= 0 then greatest(0.8 - 0.2 * hit::double / length(path), 0.0)
 when 1 - levenshtein(bare, '12')::double / greatest(length(bare), 2) >= 0.7 then (((1 - levenshtein(bare, '12')::double / greatest(length(bare), 2)) * 0.85 + 0.05 - 0.08) * 0.7) else 0.0 end as score,
 case when p = '12' then 'exact' when base = '12' then 'name' when bare = '12' then 'stem' when hit >= 0 then 'substring' when 1 - levenshtein(bare, '12')::double / greatest(length(bare), 2) >= 0.7 then 'fuzzy' else 'none' end as kind from m)
select path, round(score::double, 6) as score, kind from s where round(score, 6) >= 0.2""")
def c33_find_files(spark, sf):
    return S.find_files(pages(spark, sf), "12")


@query(f"""with n as (select distinct c_name as name from customer), s as (select name, case when contains({FOLD('name')}, 'customer#000000123') or contains('customer#000000123', {FOLD('name')}) then 0.9
 else 1 - levenshtein({FOLD('name')}, 'customer#000000123')::double / greatest(length(name), 18) end as score from n)
select name, round(score::double, 6) as score from s where round(score, 6) >= 0.7 order by score desc, name limit 3""")
def c35_similar_names(spark, sf):
    from corpusloom.runtime import read

    return S.suggestions(read(spark, sf, "customer").select(F.col("c_name").alias("name")), "Customer#000000123")


@query(f"""with {LINES_SQL} select file_id, line, cast(sum(strlen(text) + 1) over (partition by file_id order by line rows between unbounded preceding and current row) - strlen(text) - 1 as bigint) as start_offset from lines""")
def b07_line_offsets(spark, sf):
    return S.line_offsets(files(spark, sf)).select("file_id", "line", "start_offset")
