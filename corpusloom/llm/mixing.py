"""Mixing sources to target weights by repeating documents.

Tokens are summed per source. Targets share the total by weight, but stop at `most` times a
source's size; the excess is shared again by weight until none is above. In closed form:
with sources in the order of size over weight, a source is capped while its cap is at most
its share of what is left after the caps before it. A document comes floor(rate) times, and
once more if its hash falls below the fraction of the rate.

Only the sums per source are joined back, from a written table, so Spark knows their size
before it chooses to broadcast them.

Defined results: a null text has size 0; null is a source of its own, last in the order; a
source without tokens has target 0 and rate 0; without documents nothing comes out. Rows that
repeat an id are drawn alike. A null id is drawn as one id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import Scratch

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    #: Weights of the sources in the order of their names, repeating.
    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, params: MixParams) -> DataFrame:
    """(source, source_size, target) from rows of (source, size). One row a source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, params.weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(params.weights))) + 1).cast("int")).cast("long")
    every = Window.partitionBy()
    weighed = sums.withColumn("w", weight).withColumn("ratio", F.col("source_size") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.select(
        "*",
        F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last())).alias("turn"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * params.most).over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"),
    )
    open_ = F.col("source_size") * params.most * F.col("left_w") > F.col("left") * F.col("w")
    first = left.withColumn("first", F.min(F.when(open_, F.struct("turn", "left", "left_w"))).over(every))
    capped = F.col("first").isNull() | (F.col("turn") < F.col("first.turn"))
    share = (F.col("w") * F.col("first.left")).cast("double") / F.col("first.left_w").cast("double")
    return first.select("source", "source_size", F.when(capped, (F.col("source_size") * params.most).cast("double")).otherwise(share).alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def assign(docs: DataFrame, scratch: Scratch, params: MixParams = MixParams()) -> DataFrame:
    """docs with size, source_size, target and copies; columns of docs with these names give way."""
    sized = docs.drop("size", "source_size", "target", "copies", "rate", "__source").withColumn("size", word_count(F.col("text")))
    sums = scratch.save(targets(sized.select("source", "size"), params).coalesce(1), "targets").select(F.col("source").alias("__source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    copies = whole + F.when(draw(F.col("doc_id"), params.seed) < F.col("rate") - whole, 1).otherwise(0)
    return sized.join(sums, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("rate", rate).withColumn("copies", copies.cast("long")).drop("rate")


def mix(docs: DataFrame, scratch: Scratch, params: MixParams = MixParams()) -> DataFrame:
    """The mix: the rows of docs, each as often as it is drawn, with its columns."""
    plain = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", "source")
    taken = assign(plain, scratch, params).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")


#: DuckDB SQL for the query: rows of doc_id, size, source_size, target, taken.
ORACLE = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT as size from documents),
sums as (select source, sum(size)::BIGINT as source_size from sized group by source),
weighed as (select source, source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::BIGINT as w from sums),
ranked as (select *, source_size::DOUBLE / w as ratio from weighed),
lefts as (select *, row_number() over (order by ratio, source nulls last) as turn,
  sum(source_size) over () - coalesce(sum(source_size * 3) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as lft,
  sum(w) over () - coalesce(sum(w) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as left_w from ranked),
opened as (select min(turn) as turn from lefts where source_size * 3 * left_w > lft * w),
frm as (select l.turn, l.lft, l.left_w from lefts l join opened o on l.turn = o.turn),
targets as (select l.source, l.source_size, case when f.turn is null or l.turn < f.turn then (l.source_size * 3)::DOUBLE else (l.w * f.lft)::DOUBLE / f.left_w::DOUBLE end as target
  from lefts l left join frm f on true),
rated as (select s.doc_id, s.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
  ('0x' || substr(md5('17:' || coalesce(cast(s.doc_id as varchar), '')), 1, 13))::BIGINT / 4503599627370496.0 as u
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::BIGINT as taken from rated
"""
