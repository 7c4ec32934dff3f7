"""Change history: logs, churn, hotspots, collisions, ownership.

`changes` has a row for each (commit, path): hash, path, author, ts, added, deleted. "Now"
is a parameter, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days in each named time window; 30 days for other names.
WINDOW_DAYS = {"7d": 7, "7days": 7, "week": 7, "30d": 30, "30days": 30, "month": 30, "90d": 90, "90days": 90, "quarter": 90, "1y": 365, "1year": 365, "year": 365, "365d": 365}


def window_days(name: str) -> int:
    return WINDOW_DAYS.get(name, 30)


def parse_log(lines: DataFrame) -> DataFrame:
    """Rows (hash, author, email, epoch, path, added, deleted) of a numstat log in `pos`, `value`.

    A commit line is hash|author|email|epoch|subject; its files follow. Each file line takes
    the last commit line above it.
    """
    head = r"^([0-9a-f]{7,64})\|([^|]*)\|([^|]*)\|([0-9]+)\|"
    part = lambda k: F.regexp_extract("value", head, k)
    commit = F.when(F.col("value").rlike(head), F.struct(part(1).alias("hash"), part(2).alias("author"), part(3).alias("email"), part(4).cast("long").alias("epoch")))
    order = Window.partitionBy("log").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("commit", F.last(commit, ignorenulls=True).over(order))
    file = r"^([0-9]+|-)\t([0-9]+|-)\t(.+)$"
    number = lambda k: F.coalesce(F.expr(f"try_cast(regexp_extract(value, r'{file}', {k}) as long)"), F.lit(0).cast("long"))
    rows = filled.where(F.col("value").rlike(file))
    return rows.select("commit.*", renamed_to(F.regexp_extract("value", file, 3)).alias("path"), number(1).alias("added"), number(2).alias("deleted"))


def renamed_to(path: Column) -> Column:
    """The new path of `a/{b => c}/d` or `a => b`."""
    x = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    x = F.regexp_replace(x, r"^.* => ", "")
    return F.regexp_replace(x, "/{2,}", "/")


# Paths that are left out of churn.
EXCLUDED = r"(^|/)(vendor|node_modules|dist|build|target)/|\.lock$|(^|/)(package-lock\.json|go\.sum)$|\.min\.(js|css)$|\.pb\.go$"


def churn_paths(changes: DataFrame) -> DataFrame:
    return changes.where(~F.col("path").rlike(EXCLUDED))


def recent(changes: DataFrame, now: Column, days: int) -> DataFrame:
    return changes.where(F.col("ts") >= now - F.expr(f"interval {days} days"))


def volatility(n: Column, lines: Column, authors: Column, days: int) -> Column:
    part = lambda c, most: F.least(c / most, F.lit(1.0))
    return 0.4 * part(n / F.lit(float(days)), F.lit(1.0)) + 0.4 * part(lines / F.lit(float(days)), F.lit(100.0)) + 0.2 * part(authors, F.lit(5.0))


def churn(changes: DataFrame, days: int = 30) -> DataFrame:
    """A row a path: changes, lines, first and last change, authors, rate, volatility."""
    out = changes.groupBy("path").agg(
        F.count("*").alias("changes"),
        F.sum("added").alias("added"),
        F.sum("deleted").alias("deleted"),
        F.min("ts").alias("first_change"),
        F.max("ts").alias("last_change"),
        F.countDistinct("author").alias("authors"),
    )
    score = volatility(F.col("changes"), F.col("added") + F.col("deleted"), F.col("authors"), days)
    return out.withColumn("rate", F.round(F.col("changes") / F.lit(float(days)), 6)).withColumn("volatility", F.round(score, 6))


def hotspots(changes: DataFrame, days: int = 30, least: int = 2, top: int = 10) -> DataFrame:
    return churn(changes, days).where(F.col("changes") >= least).orderBy(F.col("volatility").desc(), "path").limit(top)


def contributors(changes: DataFrame) -> DataFrame:
    """(path, author, n, last_change, share, rank) within each path, ties by name."""
    n = changes.groupBy("path", "author").agg(F.count("*").alias("n"), F.max("ts").alias("last_change"))
    every, order = Window.partitionBy("path"), Window.partitionBy("path").orderBy(F.col("n").desc(), "author")
    return n.select("*", (F.col("n") / F.sum("n").over(every)).alias("share"), F.row_number().over(order).alias("rank"))


def collisions(changes: DataFrame, now: Column, least: int = 2) -> DataFrame:
    """(path, authors, recent_changes, score, severity) of paths with several authors."""
    ranked = contributors(changes)
    fresh = F.col("last_change") > now - F.expr("interval 7 days")
    out = ranked.groupBy("path").agg(
        F.count("*").alias("authors"),
        F.sum(F.when(fresh, F.col("n")).otherwise(0)).alias("recent_changes"),
        F.max(F.when(F.col("rank") == 1, F.col("share"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("share"))).alias("second"),
    )
    score = F.least((F.col("authors") - 1) / F.lit(4.0), F.lit(1.0)) * 0.4 + F.least(F.col("recent_changes") / F.lit(10.0), F.lit(1.0)) * 0.4 + F.coalesce(F.col("second") / F.col("first"), F.lit(0.0)) * 0.2
    out = out.where(F.col("authors") >= least).withColumn("score", F.round(score, 6))
    severity = F.when(F.col("score") >= 0.7, "critical").when(F.col("score") >= 0.4, "warning").otherwise("info")
    return out.select("path", "authors", "recent_changes", "score", severity.alias("severity"))


def ownership(changes: DataFrame, depth: int = 2) -> DataFrame:
    """(module, owner, share, others): who changes a module most, and who else makes a tenth or more."""
    n = changes.groupBy(F.substring_index("path", "/", depth).alias("module"), "author").agg(F.count("*").alias("n"))
    every, order = Window.partitionBy("module"), Window.partitionBy("module").orderBy(F.col("n").desc(), "author")
    ranked = n.select("*", (F.col("n") / F.sum("n").over(every)).alias("share"), F.row_number().over(order).alias("rank"))
    return ranked.groupBy("module").agg(
        F.max(F.when(F.col("rank") == 1, F.col("author"))).alias("owner"),
        F.round(F.max("share"), 6).alias("share"),
        F.count(F.when((F.col("rank") > 1) & (F.col("share") >= 0.1), 1)).alias("others"),
    )


def most_active(changes: DataFrame) -> DataFrame:
    return changes.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "author").limit(1)
