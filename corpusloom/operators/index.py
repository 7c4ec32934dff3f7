"""Inverted indexes as tables, and candidate search that agrees with a full scan.

Grams and tokens of a file are made within its row and made distinct there, so the index
has one row a file and gram. Stored indexes are partitioned by a bucket of the gram's hash,
so a lookup reads a few buckets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.search import line_offsets

BUCKETS = 256


def windows_of(c: Column) -> Column:
    """All substrings of three characters, in order, in one pass of the text."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(...))."), F.lit(1))


def ascii_trigrams(files: DataFrame) -> DataFrame:
    """(gram, file_id): distinct windows of ASCII characters with a letter or digit."""
    grams = F.filter(F.array_distinct(windows_of(F.col("content"))), lambda g: g.rlike(r"^[\x00-\x7F]{3}$") & g.rlike("[A-Za-z0-9]"))
    return files.select(F.explode(grams).alias("gram"), "file_id")


def unicode_trigrams(files: DataFrame) -> DataFrame:
    """(gram, file_id): distinct windows of code points, one of them outside ASCII."""
    grams = F.filter(F.array_distinct(windows_of(F.col("content"))), lambda g: g.rlike(r"[^\x00-\x7F]"))
    return files.select(F.explode(grams).alias("gram"), "file_id")


def all_trigrams(files: DataFrame) -> DataFrame:
    """(gram, file_id): every distinct window."""
    return files.select(F.explode(F.array_distinct(windows_of(F.col("content")))).alias("gram"), "file_id")


def with_bucket(grams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return grams.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))


def write_grams(grams: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The bucketed index: one folder a bucket, its rows in the order of the gram."""
    bucketed = with_bucket(grams, buckets)
    bucketed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, pattern: str, buckets: int = BUCKETS) -> DataFrame:
    """(file_id) of files with all grams of the pattern; reads only the buckets of these grams."""
    grams = sorted({pattern[k : k + 3] for k in range(len(pattern) - 2)})
    asked = with_bucket(spark.createDataFrame([(g,) for g in grams], "gram string"), buckets)
    numbers = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most the grams of one pattern
    index = spark.read.parquet(path).where(F.col("bucket").isin(numbers) & F.col("gram").isin(grams))
    return index.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("file_id")


def candidates(grams: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """Files that can hold the pattern: all its distinct grams, or all files if it is too short."""
    asked = sorted({pattern[k : k + 3] for k in range(len(pattern) - 2)})
    if not asked:
        return files
    found = grams.where(F.col("gram").isin(asked)).groupBy("file_id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(asked))
    return files.join(found, "file_id", "left_semi")


def overlap_candidates(grams: DataFrame, pattern: str) -> DataFrame:
    """(file_id, hits): the looser rule: 1 hit up to 3 grams, 3 up to 6, half of them beyond."""
    asked = [pattern[k : k + 3] for k in range(len(pattern) - 2)]
    need = 1 if len(asked) <= 3 else 3 if len(asked) <= 6 else len(asked) // 2
    return grams.where(F.col("gram").isin(asked)).groupBy("file_id").agg(F.countDistinct("gram").alias("hits")).where(F.col("hits") >= need)


_WORD = re.compile(rb"[a-z0-9_]{3,}")


#: Postings that are given on together: bounds what a worker holds.
_GIVEN = 1 << 16


def _first_places(text: bytes | None) -> dict[bytes, int]:
    """Folded words of a text with their first byte; bytes above ASCII are in no word."""
    found: dict[bytes, int] = {}
    for m in _WORD.finditer((text or b"").lower()):
        found.setdefault(m[0], m.start())
    return found


def postings(files: DataFrame) -> DataFrame:
    """(token, file_id, first_offset): folded runs of three or more word characters, with the first byte offset.

    Each text is scanned once as bytes; a file whose id comes again gives a token once.
    """
    kind = files.schema["file_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens, places, rows = batch.column("file_id"), [], [], []
            for row, text in enumerate(batch.column("content").cast(pa.large_binary())):
                found = _first_places(text.as_py())
                tokens += found
                places += found.values()
                rows += [row] * len(found)
                if len(rows) >= _GIVEN or row == len(ids) - 1:
                    words = pa.array(tokens, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([words, ids.take(pa.array(rows, pa.int64())), pa.array(places, pa.int64())], names=["token", "file_id", "first_offset"])
                    tokens, places, rows = [], [], []

    words = files.select("file_id", "content").mapInArrow(run, f"token string, file_id {kind.simpleString()}, first_offset long")
    return words.groupBy("token", "file_id").agg(F.min("first_offset").alias("first_offset"))


# Extensions that are binary.
BINARY = "ttf otf eot woff woff2 png jpg jpeg gif bmp ico webp tiff tif zip tar gz bz2 xz 7z rar jar war ear exe dll so dylib a o obj bin mp3 mp4 avi mov wmv flv wav flac ogg pdf doc docx xls xlsx ppt pptx db sqlite sqlite3 pyc pyo class pickle pkl".split()
# Leading bytes of binary formats, in hex.
MAGIC = ("1F8B", "504B0304", "504B0506", "89504E47", "FFD8FF", "47494638", "25504446", "7F454C46", "4D5A", "CAFEBABE", "774F4646", "774F4632")


def is_binary(path: Column, content: Column) -> Column:
    """By extension (minified scripts are text), leading bytes, or the share of odd bytes in the first 512."""
    by_name = T.extension(path).isin(BINARY) & ~path.endswith(".min.js") & ~path.endswith(".min.css")
    # The head as one character a byte, so that a pattern counts bytes.
    head = F.decode(F.substring(content, 1, 512).cast("binary").substr(1, 512), "ISO-8859-1")
    by_magic = F.hex(F.substring(content, 1, 8).cast("binary")).rlike(f"^(?:{'|'.join(MAGIC)})")
    size = F.length(head)
    nulls, odd = F.regexp_count(head, F.lit(r"\x00")), F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    by_share = (size > 0) & ((nulls > F.floor(size / 100)) | (odd > F.floor(size * 30 / 100)))
    return by_name | F.coalesce(by_magic | by_share, F.lit(False))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified, by content hash."""
    a = old.select("path", F.sha2(F.col("content"), 256).alias("a"))
    b = new.select("path", F.sha2(F.col("content"), 256).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def unchanged_skipped(new: DataFrame, known: DataFrame) -> DataFrame:
    """Files of `new` whose (path, hash) isn't known yet."""
    return new.withColumn("content_hash", F.sha2(F.col("content"), 256)).join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def ignored(paths: DataFrame, rules: list[str]) -> DataFrame:
    """(path, ignored): the last rule that fits decides; `!` takes back, `/` anchors, a final `/` is for folders."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        keep, body = rule.startswith("!"), rule.removeprefix("!")
        folder, body = body.endswith("/"), body.rstrip("/")
        anchored = "/" in body
        pattern = T.glob_regex(body.removeprefix("/")).strip("^$")
        head = "^" if anchored else "(^|/)"
        fits = F.col("path").rlike(f"{head}{pattern}/" if folder else f"{head}{pattern}(/|$)")
        out = F.when(fits, F.lit(not keep)).otherwise(out)
    return paths.select("path", out.alias("ignored"))
