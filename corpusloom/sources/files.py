"""File sources: directories, git, manifests, configuration; and sinks for reports."""

from __future__ import annotations

import json
import re
import subprocess
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.index import is_binary

#: Globs that are left out by default.
EXCLUDED = ("**/.git/**", "**/node_modules/**", "**/vendor/**", "**/dist/**", "**/build/**", "**/target/**", "**/__pycache__/**", "**/*.min.js", "**/*.lock")


@dataclass(frozen=True)
class Config:
    """Limits and search settings, with the reference's names for keys in a settings file."""

    max_file_size: int = 10 * 1024 * 1024
    max_parse_size: int = 2 * 1024 * 1024
    max_file_count: int = 10_000
    max_total_size: int = 500 * 1024 * 1024
    max_results: int = 15
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = EXCLUDED
    synonyms: tuple[tuple[str, ...], ...] = field(default=())


def parse_config(text: str) -> Config:
    """Settings from KDL lines: `key value`, nested in blocks, lists as several values."""
    known, found, groups = {f.name for f in fields(Config)}, {}, []
    for line in re.sub(r"/\*.*?\*/", "", text, flags=re.S).split("\n"):
        parts = re.findall(r'"(?:[^"\\]|\\.)*"|[^\s{}=]+', re.sub(r"//.*", "", line))
        if not parts:
            continue
        key, values = parts[0].replace("-", "_"), [p.strip('"') for p in parts[1:]]
        if key in ("group", "synonym"):
            groups.append(tuple(values))
        elif key in ("include", "exclude"):
            found[key] = (*found.get(key, ()), *values)
        elif key in known and values:
            if not re.fullmatch(r"\d+", values[0]):
                raise ValueError(f"{key} must be a whole number, not {values[0]!r}")
            found[key] = int(values[0])
    return Config(**found, synonyms=tuple(groups))


def scan(spark: SparkSession, root: str, config: Config = Config()) -> DataFrame:
    """Text files below a folder: Spark lists and reads them; dot folders and binaries are left out.

    (file_id, path, content, size, mtime, priority) in the order of priority, then path.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = re.sub(r"^file:/+", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(prefix) + "/", "")
    listed = raw.select(path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    keep = (F.col("size") <= config.max_file_size) & ~F.col("path").rlike(r"(^|/)\.[^/]+/")
    for glob in config.exclude:
        keep &= ~F.col("path").rlike(T.glob_regex(glob))
    if config.include:
        keep &= F.greatest(*(F.col("path").rlike(T.glob_regex(g)) for g in config.include), F.lit(False))
    chosen = listed.where(keep).where(~is_binary(F.col("path"), F.col("content")))
    texts = chosen.withColumn("content", F.decode("content", "UTF-8")).withColumn("priority", T.priority(F.col("path")))
    # The places are ordered without the contents, which join those that are taken: at most max_file_count, of max_total_size in all.
    first = Window.orderBy(F.col("priority").desc(), "path").rowsBetween(Window.unboundedPreceding, 0)
    taken = texts.select("path", "priority", "size").orderBy(F.col("priority").desc(), "path").limit(config.max_file_count)
    taken = taken.withColumn("total", F.sum("size").over(first)).where(F.col("total") <= config.max_total_size).select("path")
    return texts.join(taken, "path", "left_semi").orderBy(F.col("priority").desc(), "path").select(F.xxhash64("path").alias("file_id"), "path", "content", "size", "mtime", "priority")


def git_log(spark: SparkSession, repository: str, since: str = "90 days ago") -> DataFrame:
    """Lines (log, pos, value) of a numstat log, for history.parse_log."""
    done = subprocess.run(["git", "-C", repository, "log", "--numstat", "--no-merges", f"--since={since}", "--format=%H|%an|%ae|%at|%s"], capture_output=True, text=True, check=True)
    rows = [(0, k, line) for k, line in enumerate(done.stdout.splitlines())]
    return spark.createDataFrame(rows, "log int, pos long, value string")


def git_changes(spark: SparkSession, repository: str, base: str | None = None, target: str | None = None, staged: bool = False) -> DataFrame:
    """(status, path, old_path): changes in a range, of a commit, staged, or of the work tree."""
    ends = [*(["--cached"] if staged else []), *[x for x in (base, target) if x]]
    done = subprocess.run(["git", "-C", repository, "diff", "--name-status", "-M", *ends], capture_output=True, text=True, check=True)
    rows = []
    for line in done.stdout.splitlines():
        status, *paths = line.split("\t")
        rows.append((status[:1], paths[-1], paths[0] if len(paths) > 1 else None))
    return spark.createDataFrame(rows, "status string, path string, old_path string")


def git_content(repository: str, ref: str, path: str) -> str:
    """A file's text at a commit."""
    return subprocess.run(["git", "-C", repository, "show", f"{ref}:{path}"], capture_output=True, text=True, check=True).stdout


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Annotation or context manifests: JSON documents with an `entries` list."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("entries").alias("e")).select("e.*")


#: Most entries of a manifest, which is one document.
MOST_ENTRIES = 100_000


def write_manifest(entries: DataFrame, path: str) -> None:
    """One JSON document with all entries; longer tables are refused, export_json writes them."""
    rows = [r.asDict(recursive=True) for r in entries.limit(MOST_ENTRIES + 1).collect()]
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a manifest holds at most {MOST_ENTRIES} entries; use export_json")
    spark = entries.sparkSession
    spark.createDataFrame([(json.dumps({"entries": rows}, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def export_graph(edges: DataFrame, path: str) -> None:
    """The dependency graph as lines of DOT."""
    line = F.format_string('"%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string"))
    edges.select(line.alias("value")).write.mode("overwrite").text(path)


def grep_rows(found: DataFrame) -> DataFrame:
    """Hits as path:line:text."""
    return found.select(F.concat_ws(":", "path", F.col("line").cast("string"), "text").alias("row"))


def compact_rows(found: DataFrame) -> DataFrame:
    """Hits as one row a file: path, then its lines."""
    return found.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("line")).cast("array<string>"), ",").alias("lines")).select(F.concat_ws(" ", "path", "lines").alias("row"))


def tree_rows(walked: DataFrame) -> DataFrame:
    """A walk as indented rows in the order of depth."""
    return walked.select("root", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("node").cast("string")).alias("row"))
