"""Joins whose left side may hold one key in a large share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the key's hash; those that hold over 1 / _HOT of the left rows are dealt out. At most _HOT slots do.
_SLOTS, _HOT, _DEALT = 4096, 512, 64


def join_hot(left: DataFrame, right: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """left join right, right with one row a key at most; rows of hot keys are dealt over several tasks.

    The left rows are counted by slot of the key's hash. In the hot slots a left row gets a
    salt from the columns `spread`, and a right row stands once for each salt. left is read
    twice, so it should be a written table.
    """
    slot = F.pmod(F.xxhash64(*on), F.lit(_SLOTS))
    counts = left.groupBy(slot.alias("slot")).count()
    total = left.count()
    hot = [r[0] for r in counts.where(F.col("count") * _HOT > total).collect()]
    if not hot or total < _SLOTS:
        return left.join(right, on, "left")
    is_hot = slot.isin(hot)
    salted = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(_DEALT)).cast("int")).otherwise(0))
    copies = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(_DEALT - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [*on, "__salt"], "left").drop("__salt")
