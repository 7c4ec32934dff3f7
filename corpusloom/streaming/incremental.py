"""Incremental re-indexing: file changes as a stream, merged into versioned tables.

A debounce is the trigger's interval; a deleted file is a tombstone that an anti-join
applies; files whose hash is known are skipped. A table is kept in buckets of files; a
version holds the buckets that it rewrote and a list of where all buckets are, written
last, so readers keep what they opened and a batch that fails leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.runtime import _delete

TABLE_SCHEMA = "file_id long, path string, content string, content_hash string"
EVENT_SCHEMA = "file_id long, path string, content string, deleted boolean, version long"


def merged(base: DataFrame, updates: DataFrame, deleted: DataFrame) -> DataFrame:
    """base with updated files replaced, new ones added and deleted ones left out."""
    return base.join(updates.select("file_id"), "file_id", "left_anti").unionByName(updates).join(deleted.select("file_id"), "file_id", "left_anti")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each file."""
    # Of events of one version the deletion counts, then the larger path and content.
    order = Window.partitionBy("file_id").orderBy(F.col("version").desc(), F.col("deleted").desc(), F.col("path").desc(), F.col("content").desc())
    return events.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


#: Buckets of a table by the hash of file_id: what a batch rewrites.
BUCKETS = 64
_LIST = "bucket int, version string"


def _bucket(c: str = "file_id") -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int").alias("bucket")


def _names(spark: SparkSession, folder: str) -> set[str]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(place)} if fs.exists(place) else set()


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The committed versions, oldest first: those whose list of buckets was written to its end."""
    return sorted(n for n in _names(spark, folder) if "_SUCCESS" in _names(spark, f"{folder}/{n}/list"))


def _listed(spark: SparkSession, folder: str, version: str) -> dict[int, str]:
    return {r["bucket"]: r["version"] for r in spark.read.schema(_LIST).parquet(f"{folder}/{version}/list").collect()}  # BUCKETS rows at most


def _parts(spark: SparkSession, folder: str, listed: dict[int, str]) -> DataFrame | None:
    paths = [f"{folder}/{v}/data/bucket={b}" for b, v in sorted(listed.items())]
    return spark.read.parquet(*paths) if paths else None


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table of the last committed version, or None before the first."""
    done = versions(spark, folder)
    if not done:
        return None
    found = _parts(spark, folder, _listed(spark, folder, done[-1]))
    return found if found is not None else spark.createDataFrame([], TABLE_SCHEMA)


def publish(spark: SparkSession, folder: str, touched: DataFrame, buckets: list[int], version: str) -> None:
    """Write the rewritten buckets, then the list of where each bucket is; the list's end commits the version.

    A version that ended before its list is as if it had never begun.
    """
    done = [v for v in versions(spark, folder) if v < version]
    listed = _listed(spark, folder, done[-1]) if done else {}
    data = f"{folder}/{version}/data"
    touched.withColumn("bucket", _bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(data)
    held = {int(n.removeprefix("bucket=")) for n in _names(spark, data) if n.startswith("bucket=")}
    listed = {b: v for b, v in listed.items() if b not in buckets} | {b: version for b in held}
    spark.createDataFrame(sorted(listed.items()), _LIST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{version}/list")


def apply_batch(spark: SparkSession, folder: str, events: DataFrame, number: int) -> int:
    """One micro-batch: skip known contents, merge the buckets it touches, publish. The number of changed files."""
    last = latest(events).persist()
    try:
        done = versions(spark, folder)
        listed = _listed(spark, folder, done[-1]) if done else {}
        asked = {r[0] for r in last.select(_bucket()).distinct().collect()}  # BUCKETS rows at most
        base = _parts(spark, folder, {b: v for b, v in listed.items() if b in asked})
        if base is None:
            base = spark.createDataFrame([], TABLE_SCHEMA)
        fresh = last.where("not deleted").select("file_id", "path", "content", F.sha2("content", 256).alias("content_hash"))
        gone = last.where("deleted").select("file_id")
        fresh = fresh.join(base.select("file_id", "content_hash"), ["file_id", "content_hash"], "left_anti").select("file_id", "path", "content", "content_hash")
        n = fresh.count() + gone.join(base, "file_id", "left_semi").count()
        if n:
            publish(spark, folder, merged(base, fresh, gone), sorted(asked), f"v{number:08d}")
        return n
    finally:
        last.unpersist()


def watch(spark: SparkSession, incoming: str, folder: str, checkpoint: str, every: str = "300 milliseconds", once: bool = False):
    """A query that merges event files as they come; `once` takes what is there and ends."""
    stream = spark.readStream.schema(EVENT_SCHEMA).json(incoming)
    writer = stream.writeStream.foreachBatch(lambda df, number: apply_batch(df.sparkSession, folder, df, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def forget(spark: SparkSession, folder: str, version: str) -> None:
    """Drop what only a version that nobody reads any more holds: its list, and buckets that the last one doesn't have from it."""
    kept = {b for b, v in _listed(spark, folder, versions(spark, folder)[-1]).items() if v == version}
    old = _listed(spark, folder, version)
    _delete(spark, f"{folder}/{version}/list")
    for bucket in {b for b, v in old.items() if v == version} - kept:
        _delete(spark, f"{folder}/{version}/data/bucket={bucket}")


def churn_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, path, n): changes per window of event time; works on streams, with a watermark."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "path").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "path", "n")


def linked_again(changed: DataFrame, links: DataFrame, depth: int = 10) -> DataFrame:
    """Files to link again: the changed ones and what depends on them, in at most `depth` steps."""
    seen = front = changed.select("file_id").distinct()
    for _ in range(depth):
        step = front.join(links.select(F.col("target_file").alias("file_id"), F.col("file_id").alias("next")), "file_id").select(F.col("next").alias("file_id")).distinct()
        front = step.join(seen, "file_id", "left_anti").checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen
