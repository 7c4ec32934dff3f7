"""Duplicate and similar code: normalised text, token sets, similar names.

Similarity joins block on shared tokens or letters, rarest first, and verify each pair
once, so nothing is compared with everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions import text as T
from corpusloom.functions.names import jaro_winkler_udf


def normalised(text: Column) -> Column:
    """Trimmed lines without blank and comment lines."""
    kept = F.filter(F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"^[ \t\r]+|[ \t\r]+$", "")), lambda s: (s != "") & ~s.rlike(r"^(//|#|\*|/\*|--)"))
    return F.array_join(kept, "\n")


def exact_duplicates(files: DataFrame) -> DataFrame:
    """(digest, copies, first_id) of normalised texts that occur more than once."""
    digest = F.sha2(normalised(F.col("content")), 256)
    return files.where(normalised(F.col("content")) != "").groupBy(digest.alias("digest")).agg(F.count("*").alias("copies"), F.min("file_id").alias("first_id")).where("copies > 1")


def token_sets(files: DataFrame) -> DataFrame:
    """(file_id, tokens): distinct folded words."""
    return files.select("file_id", F.array_distinct(F.regexp_extract_all(T.fold(F.col("content")), F.lit("[a-z0-9_]+"), F.lit(0))).alias("tokens"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


#: Sets of the right side that a worker holds at once; more of them go by prefixes.
MOST_HELD = 1 << 13


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, similarity) over two token-set tables.

    Up to `MOST_HELD` sets on the right are held as an index of their tokens, and each set on
    the left counts what it shares with all of them, without a shuffle; beyond, by prefixes.
    """
    few = right.limit(MOST_HELD + 1).count() <= MOST_HELD
    return _pairs_by_index(left, right, least) if few and least > 0 else _pairs_by_prefixes(left, right, least)


def _pairs_by_index(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    held = right.where("size(tokens) > 0").toPandas()
    places: dict[str, list[int]] = {}
    for k, tokens in enumerate(held["tokens"]):
        for token in tokens:
            places.setdefault(token, []).append(k)
    index = {token: np.array(at, dtype=np.int32) for token, at in places.items()}
    sizes = np.array([len(x) for x in held["tokens"]], dtype=np.int64)
    shared = left.sparkSession.sparkContext.broadcast((held["file_id"].tolist(), sizes, index))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, index = shared.value
        for batch in frames:
            rows, found, both_sizes = [], [], []
            for row, tokens in enumerate(batch.column("tokens")):
                if not tokens.is_valid:
                    continue
                known = [at for t in tokens.as_py() if (at := index.get(t)) is not None]
                if not known:
                    continue
                n, both = len(tokens), np.bincount(np.concatenate(known), minlength=len(sizes))
                # With room for rounding: the exact test follows.
                for k in np.flatnonzero(both >= (least - 1e-5) * (n + sizes - both)).tolist():
                    rows.append(row)
                    found.append(k)
                    both_sizes.append((int(both[k]), n + int(sizes[k]) - int(both[k])))
            chosen = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("left_id").take(chosen), pa.array([ids[k] for k in found], right_kind), pa.array([x for x, _ in both_sizes], pa.int64()), pa.array([y for _, y in both_sizes], pa.int64())], names=["left_id", "right_id", "both", "either"])

    kinds = [x.schema["file_id"].dataType for x in (left, right)]
    right_kind = to_arrow_type(kinds[1])
    made = left.select(F.col("file_id").alias("left_id"), "tokens").mapInArrow(run, f"left_id {kinds[0].simpleString()}, right_id {kinds[1].simpleString()}, both long, either long")
    similarity = F.round(F.col("both") / F.greatest("either", F.lit(1)), 6)
    return made.select("left_id", "right_id", similarity.alias("similarity")).where(F.col("similarity") >= least)


def _pairs_by_prefixes(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """A pair at the threshold shares one of the rarest n - ceil(t n) + 1 tokens of each side,
    so candidates join on these prefixes, with the length filter.
    """
    counts = left.select(F.explode("tokens").alias("token")).unionAll(right.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("df"))

    def prefix(sets: DataFrame, name: str) -> DataFrame:
        each = sets.select(F.col("file_id").alias(name), F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(counts, "token")
        rank = F.row_number().over(Window.partitionBy(name).orderBy("df", "token"))
        return each.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(name, F.col("n").alias(f"{name}_n"), "token")

    a, b = prefix(left, "left_id"), prefix(right, "right_id")
    fits = F.least("left_id_n", "right_id_n") >= F.greatest("left_id_n", "right_id_n") * least - 1e-9
    pairs = a.join(b, "token").where(fits).select("left_id", "right_id").distinct()
    full = pairs.join(left.select(F.col("file_id").alias("left_id"), F.col("tokens").alias("x")), "left_id").join(right.select(F.col("file_id").alias("right_id"), F.col("tokens").alias("y")), "right_id")
    return full.select("left_id", "right_id", F.round(jaccard(F.col("x"), F.col("y")), 6).alias("similarity")).where(F.col("similarity") >= least)


def similar_names(names: DataFrame, least: float = 0.9) -> DataFrame:
    """(type, a, b, score): distinct names of one type that are alike by Jaro-Winkler.

    With k letters of common prefix (k <= 4), a pair at the threshold has a Jaro score of
    (least - k / 10) / (1 - k / 10) or more, so for m common letters m / |a| + m / |b| >=
    `share`, and m >= (share - 1) n for either length n. Names that agree in type and k
    letters therefore share one of the rarest n - m + 1 letters of each side, where a letter
    is counted with its occurrence. No pair at the threshold is lost.
    """
    chars = F.split("name", "")
    letters = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == c)).cast("string")))
    each = names.select("type", "name").where("name <> ''").distinct().withColumn("letters", letters).withColumn("n", F.size("letters"))
    counts = each.select(F.explode("letters").alias("letter")).groupBy("letter").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("type", "name").orderBy("df", "letter"))
    ranked = each.select("type", "name", "n", F.explode("letters").alias("letter")).join(counts, "letter").withColumn("r", rank)
    shares = {k: 3 * max(0.0, (least - k / 10) / (1 - k / 10)) - 1 for k in range(5)}
    classes = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(share).alias("share")) for k, share in shares.items()))
    keyed = ranked.withColumn("c", F.explode(classes)).select("type", "name", "n", "letter", "r", "c.k", "c.share").where(F.col("n") >= F.col("k"))
    common = F.greatest(F.ceil((F.col("share") - 1) * F.col("n") - 1e-9), F.lit(1))
    keyed = keyed.where(F.col("r") <= F.col("n") - common + 1).withColumn("prefix", F.substring("name", F.lit(1), F.col("k")))
    keys = ["type", "k", "prefix", "letter", "share"]
    a, b = keyed.select(*keys, F.col("name").alias("a"), F.col("n").alias("n_a")), keyed.select(*keys, F.col("name").alias("b"), F.col("n").alias("n_b"))
    fewer, more = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    pairs = a.join(b, keys).where((F.col("a") < F.col("b")) & (1 + fewer / more >= F.col("share") - 1e-9)).select("type", "a", "b").distinct()
    return pairs.withColumn("score", jaro_winkler_udf("a", "b")).where(F.col("score") >= least)


def abbreviations(names: DataFrame, table: dict[str, str]) -> DataFrame:
    """(short, long, n_short, n_long): words of names used both in short and in full."""
    words = names.select(F.explode(T.split_identifier(F.col("name"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    dim = names.sparkSession.createDataFrame(list(table.items()), "short string, long string")
    one, two = words.select(F.col("word").alias("short"), F.col("n").alias("n_short")), words.select(F.col("word").alias("long"), F.col("n").alias("n_long"))
    return dim.join(one, "short").join(two, "long").select("short", "long", "n_short", "n_long")
