"""Change-history queries: events stand in for commits (user = author, page of type = path)."""

from pyspark.sql import functions as F

from corpusloom.operators import history as H
from corpusloom.plans.registry import query
from corpusloom.runtime import read

CHANGES_SQL = "changes as (select event_id, event_type || '/m' || cast(user_id % 7 as varchar) || '/f' || cast(event_id % 50 as varchar) as path, cast(user_id % 23 as bigint) as author, ts, cast(event_id % 90 as bigint) as added, cast(event_id % 40 as bigint) as deleted from events)"


def changes(spark, sf):
    path = F.concat("event_type", F.lit("/m"), (F.col("user_id") % 7).cast("string"), F.lit("/f"), (F.col("event_id") % 50).cast("string"))
    return read(spark, sf, "events").select("event_id", path.alias("path"), (F.col("user_id") % 23).alias("author"), "ts", (F.col("event_id") % 90).alias("added"), (F.col("event_id") % 40).alias("deleted"))


def now(frame):
    return F.lit(frame.agg(F.max("ts")).first()[0])


VOLATILITY = "0.4 * least((count(*) / 30.0::double) / 1.0, 1.0) + 0.4 * least(((sum(added) + sum(deleted)) / 30.0::double) / 100.0, 1.0) + 0.2 * least(count(distinct author) / 5.0::double, 1.0)"
CHURN = f"churn as (select path, count(*)::bigint as changes, sum(added)::bigint as added, sum(deleted)::bigint as deleted, min(ts) as first_change, max(ts) as last_change, count(distinct author)::bigint as authors, round((count(*) / 30.0)::double, 6) as rate, round(({VOLATILITY})::double, 6) as volatility from changes group by path)"


@query(f"with {CHANGES_SQL}, {CHURN} select * from churn")
def e17_churn(spark, sf):
    return H.churn(changes(spark, sf))


@query(f"with {CHANGES_SQL}, {CHURN} select path, changes, volatility from churn where changes >= 2 order by volatility desc, path limit 10")
def e18_hotspots(spark, sf):
    return H.hotspots(changes(spark, sf)).select("path", "changes", "volatility")


CONTRIBUTORS = "n as (select path, author, count(*)::bigint as n, max(ts) as last_change from changes group by path, author), r as (select *, n::double / sum(n) over (partition by path) as share, row_number() over (partition by path order by n desc, author) as rank from n)"


@query(f"""with {CHANGES_SQL}, {CONTRIBUTORS}, c as (select path, count(*)::bigint as authors, sum(case when last_change > (select max(ts) from events) - interval 7 day then n else 0 end)::bigint as recent_changes,
 max(case when rank = 1 then share end) as a, max(case when rank = 2 then share end) as b from r group by path having count(*) >= 2),
s as (select path, authors, recent_changes, round((least((authors - 1) / 4.0::double, 1.0) * 0.4 + least(recent_changes / 10.0::double, 1.0) * 0.4 + coalesce(b / a, 0.0) * 0.2)::double, 6) as score from c)
select *, case when score >= 0.7 then 'critical' when score >= 0.4 then 'warning' else 'info' end as severity from s""")
def e19_collisions(spark, sf):
    frame = changes(spark, sf)
    return H.collisions(frame, now(frame))


@query(f"""with {CHANGES_SQL}, n as (select split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as module, author, count(*)::bigint as n from changes group by 1, 2),
r as (select *, n::double / sum(n) over (partition by module) as share, row_number() over (partition by module order by n desc, author) as rank from n)
select module, max(case when rank = 1 then author end) as owner, round(max(share), 6) as share, count(case when rank > 1 and share >= 0.1 then 1 end)::bigint as others from r group by module""")
def e20_ownership(spark, sf):
    return H.ownership(changes(spark, sf))


@query(f"with {CHANGES_SQL} select author, count(*)::bigint as n from changes group by author order by n desc, author limit 1")
def e21_most_active(spark, sf):
    return H.most_active(changes(spark, sf))


@query(f"with {CHANGES_SQL}, {CHURN} select path, changes, authors, volatility from churn where path = 'view/m1/f1' or path like 'click/m2/%'")
def e22_single_files(spark, sf):
    frame = changes(spark, sf).where("path = 'view/m1/f1' or path like 'click/m2/%'")
    return H.churn(frame).select("path", "changes", "authors", "volatility")


@query(f"with {CHANGES_SQL} select path, count(*)::bigint as n from changes where ts >= (select max(ts) from events) - interval 7 day group by path")
def h22_time_window(spark, sf):
    frame = changes(spark, sf)
    return H.recent(frame, now(frame), H.window_days("week")).groupBy("path").agg(F.count("*").alias("n"))


@query("select printf('%07x', event_id + 1000000) as hash, cast(user_id as varchar) as author, 'f' || cast(event_id % 10 as varchar) || '.py' as path, cast(event_id % 9 as bigint) as added, cast(0 as bigint) as deleted from events")
def a12_parsed_log(spark, sf):
    """A numstat log made of the events, parsed back."""
    e = read(spark, sf, "events")
    head = F.concat(F.format_string("%07x", F.col("event_id") + 1000000), F.lit("|"), F.col("user_id").cast("string"), F.lit("|a@b|1700000000|subject"))
    body = F.concat((F.col("event_id") % 9).cast("string"), F.lit("\t-\tf{old => "), (F.col("event_id") % 10).cast("string"), F.lit("}.py"))
    lines = e.select((F.col("event_id") % 64).alias("log"), "event_id", F.posexplode(F.array(head, F.lit(""), body)).alias("k", "value"))
    return H.parse_log(lines.withColumn("pos", F.col("event_id") * 3 + F.col("k"))).select("hash", "author", "path", "added", "deleted")
