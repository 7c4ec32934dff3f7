"""Index builders and file checks over documents."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import index as X
from corpusloom.operators import search as S
from corpusloom.plans.registry import FILES_SQL, files, query

GRAMS = f"{FILES_SQL}, w as (select distinct file_id, substr(content, i, 3) as gram from (select file_id, content, unnest(range(1, length(content) - 1)) as i from files))"


@query(f"with {GRAMS} select file_id, count(*)::bigint as grams from w where regexp_matches(gram, '^[\\x00-\\x7F]{{3}}$') and regexp_matches(gram, '[A-Za-z0-9]') group by file_id")
def b01_ascii_trigrams(spark, sf):
    return X.ascii_trigrams(files(spark, sf)).groupBy("file_id").agg(F.count("*").alias("grams"))


@query(f"with {GRAMS} select gram, count(*)::bigint as files from w where regexp_matches(gram, '[^\\x00-\\x7F]') group by gram")
def b02_unicode_trigrams(spark, sf):
    return X.unicode_trigrams(files(spark, sf)).groupBy("gram").agg(F.count("*").alias("files"))


@query(f"with {GRAMS} select gram, count(*)::bigint as files from w group by gram")
def b03_all_trigrams(spark, sf):
    return X.all_trigrams(files(spark, sf)).groupBy("gram").agg(F.count("*").alias("files"))


@query(None)
def b04_trigram_buckets(spark, sf):
    return X.with_bucket(X.all_trigrams(files(spark, sf))).groupBy("bucket").agg(F.count("*").alias("rows"), F.countDistinct("gram").alias("grams"))


@query(f"""with {FILES_SQL}, t as (select file_id, content, regexp_extract_all(content, '[A-Za-z0-9_]+') as w from files),
e as (select file_id, content, unnest(w) as word from t),
d as (select distinct file_id, content, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as token from e where length(word) >= 3)
select token, count(*)::bigint as files from d group by token""")
def b06_tokens(spark, sf):
    return X.postings(files(spark, sf)).groupBy("token").agg(F.count("*").alias("files"))


@query(f"""with {FILES_SQL}, f as (select file_id, translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as c from files),
m as (select file_id, c, regexp_extract(c, '(?:^|[^a-z0-9_])(the)(?:$|[^a-z0-9_])', 0) as m from f)
select 'the' as token, file_id, cast(strlen(substr(c, 1, instr(c, m) - 1)) + case when starts_with(m, 'the') then 0 else strlen(substr(m, 1, 1)) end as bigint) as first_offset from m where m <> ''""")
def b06_first_offset(spark, sf):
    return X.postings(files(spark, sf)).where("token = 'the'")


@query(f"with {FILES_SQL} select file_id, path from files where contains(content, 'thereation')")
def c05_trigram_candidates_exact(spark, sf):
    f = files(spark, sf)
    found = X.candidates(X.all_trigrams(f), f, "thereation")
    return found.where(F.col("content").contains("thereation")).select("file_id", "path")


@query(f"""with {GRAMS}, p as (select distinct substr('thereation', i, 3) as gram from range(1, 9) r(i))
select file_id, count(*)::bigint as hits from w where gram in (select gram from p) group by file_id having count(*) >= 4""")
def c05_overlap_candidates(spark, sf):
    return X.overlap_candidates(X.all_trigrams(files(spark, sf)), "thereation")


@query(f"with {FILES_SQL} select path, case file_id % 5 when 0 then 10 when 1 then 5 when 2 then 5 when 3 then 10 else 1 end as priority from files")
def a02_priorities(spark, sf):
    return files(spark, sf).select("path", T.priority(F.col("path")).alias("priority"))


@query(f"with {FILES_SQL} select path from files where regexp_matches(path, '^src/(.*/)?file[0-9][^/]*[.]py$') and not regexp_matches(path, '/de/')")
def a03_globs(spark, sf):
    path = F.col("path")
    return files(spark, sf).where(path.rlike(T.glob_regex("src/**/file*.py")) & ~path.rlike(T.glob_regex("**/de/**"))).select("path")


@query(f"""with {FILES_SQL} select path, case when path like '%7.py' then false when path like 'src/src1/%' then true when regexp_matches(path, '(^|/)de/') then true when path like '%.md' then true else false end as ignored from files""")
def a04_gitignore(spark, sf):
    return X.ignored(files(spark, sf), ["# comment", "*.md", "de/", "/src/src1", "!*7.py"])


@query(f"with {FILES_SQL} select path, file_id % 5 = 4 as is_binary from files")
def a05_binary(spark, sf):
    return files(spark, sf).select("path", X.is_binary(F.col("path"), F.col("content")).alias("is_binary"))


@query(f"with {FILES_SQL} select path, size from files where size <= 2000 order by path limit 100")
def a06_size_caps(spark, sf):
    return files(spark, sf).where("size <= 2000").orderBy("path").limit(100).select("path", "size")


@query(f"with {FILES_SQL} select sha256(content) as content_hash, count(*)::bigint as copies, min(file_id) as first_id from files group by 1")
def a09_content_hash(spark, sf):
    return files(spark, sf).groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("file_id").alias("first_id"))


@query(f"with {FILES_SQL} select case file_id % 5 when 0 then 'python' when 3 then 'go' else 'unknown' end as language, count(*)::bigint as files, sum(size)::bigint as bytes from files group by 1")
def a10_languages(spark, sf):
    return files(spark, sf).groupBy(T.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"with {FILES_SQL} select path, case when file_id % 7 = 0 then 'added' when file_id % 11 = 0 then 'removed' else 'modified' end as change from files where (file_id % 7 = 0) <> (file_id % 11 = 0) or (file_id % 13 = 0 and file_id % 7 <> 0 and file_id % 11 <> 0)")
def a17_snapshot_diff(spark, sf):
    f = files(spark, sf)
    changed = F.when(F.col("file_id") % 13 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return X.snapshot_diff(f.where("file_id % 7 <> 0"), f.where("file_id % 11 <> 0").withColumn("content", changed))


@query(f"with {FILES_SQL} select path from files where file_id % 3 = 0")
def a09_unchanged_skipped(spark, sf):
    f = files(spark, sf)
    return X.unchanged_skipped(f, f.where("file_id % 3 <> 0").withColumn("content_hash", F.sha2("content", 256))).select("path")


@query(f"with {FILES_SQL} select file_id from files where contains(content, 'onthere')")
def c05_equals_scan(spark, sf):
    """Candidates by index then verified lines; the SQL scans everything."""
    f = files(spark, sf)
    return S.hits(X.candidates(X.all_trigrams(f), f, "onthere"), S.literal("onthere"), None).select("file_id").distinct()
