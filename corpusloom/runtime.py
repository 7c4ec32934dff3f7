"""Session helpers: reading the driver tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a local one for a local master (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage and return free heap to the system; for when no other job runs.

    A heap grows with what a query allocates and keeps that size, so over many queries every
    executor comes to its limit, whatever the one at hand needs. One task an executor.
    """
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is among them
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')").collect()


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    Nothing is kept on executors: each table is a Parquet folder below the checkpoint
    directory and is read again. Folders go when the driver ends, or on drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
        self.used: dict[str, int] = {}
        atexit.register(self._quietly_drop, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        # A name that comes again gets a folder of its own: earlier tables may still be read.
        self.used[name] = self.used.get(name, 0) + 1
        path = f"{self.root}/{name}" + (f"~{self.used[name]}" if self.used[name] > 1 else "")
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes the tables saved under a name, or all."""
        if not name:
            return _delete(self.spark, self.root)
        for turn in range(1, self.used.get(name, 1) + 1):
            _delete(self.spark, f"{self.root}/{name}" + (f"~{turn}" if turn > 1 else ""))

    def _quietly_drop(self, path: str) -> None:
        try:
            _delete(self.spark, path)
        except Exception:  # the session may be gone at exit
            pass


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
