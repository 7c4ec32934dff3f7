"""Jaccard self-join on word shingles, by rare-first prefixes.

Two texts link when intersection / union of their shingle sets is at least the threshold.
The method: order all shingles by rarity, the number of sets that hold them, then the hash;
only the first (1 - t) n + 1 shingles of a set of n can be the first common one of a link.
Candidates share such a shingle and pass the length filter and the positional filter there,
then the suffix filter: shingles counted in slices of the hash range bound the overlap
before the sets are fetched. What is left is verified once per pair on the sets.

Rarity is exact. One pass over the texts deals each set's shingles to buckets of the hash
range, as packed blocks; a bucket sorts its shingles and returns those that more than one
set holds to their sets. A shingle that no other set holds comes first in the order and
can't be common, so it is counted and left out from then on: prefixes, filters and
verification need only the shared shingles. Sets that hold too few of these are done.

What is asked for are components, so a group of near copies need not give all its pairs.
In pivot rounds each shingle compares its sets with one pivot, the one that has it earliest;
components follow. After these, a last join compares every remaining pair that shares a
prefix shingle and isn't yet in one component, so no link between different components is lost.

Equal texts are cut once: they are known by 128 bits of hashes. A bitmap of fixed size says
which rows to cut; where it says so for more than one row of a text, the copies are sets that
link with each other, as equal sets of different texts are.

Defined results: a null, empty or wordless text has no set and links with nothing; its
component is its own id. Repeated ids are one document with several texts: each row gets
the least component of its own set. Null ids get a null component unless their set has
another id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernel
from corpusloom.llm.components import components
from corpusloom.llm.shingles import shingle_sets
from corpusloom.llm.skew import join_hot
from corpusloom.runtime import Scratch


@dataclass(frozen=True)
class NearParams:
    width: int = 5
    percent: int = 80
    #: Size of the bitmap of rows to cut.
    bitmap_bits: int = 24
    #: Slices of the suffix filter.
    slices: int = 64
    #: Shingles of a bucket, which is what a task holds at once, and of the texts that are dealt together.
    bucket_tokens: int = 1 << 20
    dealt_tokens: int = 1 << 18
    #: Most sets that are sent to all tasks, to be looked up where the shingles lie; beyond these they are joined.
    sent_nodes: int = 1 << 19
    #: Rarity is told apart up to so many sets: from there on, only the hash orders.
    most_rarity: int = 1 << 10
    #: Most rounds with pivots; the last join of all remaining pairs follows in any case.
    pivot_rounds: int = 4


_ROWS = "bucket int, base long, tokens binary, owners binary, node long, k1 long, k2 long, n int"


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any other set that a set of n needs: all of percent n."""
    return -(-percent * n // 100)


def _dealt(docs: DataFrame, keys: DataFrame, buckets: int, params: NearParams) -> DataFrame:
    """Shingles as packed blocks by bucket, and a row (node, k1, k2, n) for each text that was cut."""
    bits, width = params.bitmap_bits, params.width
    slot = F.pmod(F.xxhash64("doc_id", "k1"), F.lit(1 << bits))
    table = kernel.bitmap(keys.select(slot.alias("s")), bits)
    held = docs.sparkSession.sparkContext.broadcast(table)  # fixed size
    names = [x.split()[0] for x in _ROWS.split(", ")]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def block(**columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[n], t) if n in columns else pa.nulls(rows, t) for n, t in zip(names, types, strict=True)], names=names)

    def packed(base: int, tokens: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, token, owner = bucket[order], token[order], owner[order]
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = [*at[1:].tolist(), len(bucket)]
        cut = list(zip(at.tolist(), ends, strict=True))
        return block(bucket=bucket[at].astype(np.int32), base=[base] * len(at), tokens=[token[a:b].tobytes() for a, b in cut], owners=[owner[a:b].tobytes() for a, b in cut])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 32, 0
        tokens, owners, size = [], [], 0
        for batch in batches:
            hit = kernel.in_bitmap(held.value, batch.column(0).to_numpy())
            if not hit.any():
                continue
            batch = batch.filter(pa.array(hit))
            rows, sizes, first = [], [], count
            for row, found in shingle_sets(batch.column(3), width):
                if len(found):
                    rows.append(row)
                    sizes.append(len(found))
                    tokens.append(found)
                    owners.append(np.full(len(found), count, np.uint32))
                    size, count = size + len(found), count + 1
                if size >= params.dealt_tokens:
                    yield packed(base, tokens, owners)
                    tokens, owners, size = [], [], 0
            if rows:
                node, at = np.arange(first, count) + base, pa.array(rows)
                yield block(bucket=(node % buckets).astype(np.int32), node=node, k1=batch.column(1).take(at), k2=batch.column(2).take(at), n=sizes)
        if size:
            yield packed(base, tokens, owners)

    return docs.select(slot.alias("slot"), "k1", "k2", "text").mapInArrow(kernel.tidy(run), _ROWS)


_SHARED = "node long, token long, rarity int, k1 long, k2 long, n int"


def _shared(dealt: DataFrame, params: NearParams) -> DataFrame:
    """(node, token, rarity) of the shingles that more than one set holds; rows of nodes go through.

    dealt is sorted by bucket within partitions. A bucket that grows gives out the sets of
    shingles that reached the most rarity, so a shingle of many sets is not held.
    """
    most = params.most_rarity

    def counted(token: np.ndarray, node: np.ndarray, final: bool):
        """What is complete, as (node, token, rarity), and what is kept."""
        order = np.argsort(token, kind="stable")
        token, node = token[order], node[order]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        times = np.diff(np.append(first, len(token)))
        each = np.repeat(np.minimum(times, most), times)
        out = each >= (2 if final else most)
        return (node[out], token[out], each[out]), (token[~out], node[~out])

    def rows(node, token, rarity) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(node), 1 << 16):
            n = len(node[a : a + (1 << 16)])
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[a : a + n]), pa.array(token[a : a + n].view(np.int64)), pa.array(rarity[a : a + n].astype(np.int32)), none, none, pa.nulls(n, pa.int32())], names=names)

    names = [x.split()[0] for x in _SHARED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tokens, nodes, size, hot = None, [], [], 0, np.zeros(0, np.uint64)
        for batch in batches:
            passed = batch.column(4).is_valid()
            through = batch.filter(passed)
            if through.num_rows:
                none = pa.nulls(through.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([through.column(4), none, pa.nulls(through.num_rows, pa.int32()), *through.columns[5:]], names=names)
            blocks = batch.filter(pa.compute.invert(passed))
            for bucket, base, token, owner in zip(blocks.column(0).to_pylist(), blocks.column(1).to_pylist(), blocks.column(2), blocks.column(3), strict=True):
                if bucket != current:
                    if tokens:
                        yield from rows(*counted(np.concatenate(tokens), np.concatenate(nodes), True)[0])
                    current, tokens, nodes, size, hot = bucket, [], [], 0, np.zeros(0, np.uint64)
                token = np.frombuffer(token.as_buffer(), np.uint64)
                node = np.frombuffer(owner.as_buffer(), np.uint32).astype(np.int64) + base
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                    known = hot[at] == token
                    if known.any():
                        yield from rows(node[known], token[known], np.full(int(known.sum()), most))
                        token, node = token[~known], node[~known]
                tokens.append(token)
                nodes.append(node)
                size += len(token)
                if size > 4 * params.bucket_tokens:
                    out, (token, node) = counted(np.concatenate(tokens), np.concatenate(nodes), False)
                    yield from rows(*out)
                    hot = np.union1d(hot, out[1])
                    tokens, nodes, size = [token], [node], len(token)
                    # What stays is held at most `most` times each; wait until as much again has come.
                    if size > 2 * params.bucket_tokens:
                        size = 0
        if tokens:
            yield from rows(*counted(np.concatenate(tokens), np.concatenate(nodes), True)[0])

    return dealt.mapInArrow(kernel.tidy(run), _SHARED)


_NODES = "node long, n int, grams binary, prefix array<long>, first int, parts array<int>"


def _nodes(listed: DataFrame, params: NearParams) -> DataFrame:
    """From (node, n, shared): the shared shingles in the order of their hashes, those in the prefix, and the slices' sizes.

    `first` is the place of the prefix's first shared shingle: so many stand before it that no other set holds.
    """
    percent, slices = params.percent, params.slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2)
            bounds, values = held.offsets.to_numpy(), held.values
            rarity, token = values.field("rarity").to_numpy(), values.field("token").to_numpy().view(np.uint64)
            grams, prefix, first, parts = [], [], [], []
            for n, a, b in zip(batch.column(1).to_numpy().tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                mine, rare = token[a:b], rarity[a:b]
                alone = n - (b - a)
                order = np.lexsort((mine, rare))[: max(0, n - int(_least(n, percent)) + 1 - alone)]
                prefix.append(mine[order].view(np.int64))
                first.append(alone)
                mine = np.sort(mine)
                grams.append(mine.tobytes())
                parts.append(np.bincount((mine >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32), minlength=slices))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(grams, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(first, pa.int32()), pa.array(parts, pa.list_(pa.int32()))],
                names=[x.split()[0] for x in _NODES.split(", ")],
            )

    return listed.mapInArrow(kernel.tidy(run), _NODES)


def _passes(a: str, b: str, percent: int) -> str:
    """Length and positional filter at a shared shingle; exact in whole numbers."""
    most = f"least({a}.n - {a}.at, {b}.n - {b}.at)"
    return f"100L * least({a}.n, {b}.n) >= {percent}L * greatest({a}.n, {b}.n) and {100 + percent}L * {most} >= {percent}L * ({a}.n + {b}.n)"


def _suffix(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: in each slice of the hashes no more than the smaller part is common."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("parts").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("y"))
    bound = F.aggregate(F.zip_with("x", "y", lambda p, q: F.least(p, q)), F.lit(0), lambda acc, v: acc + v)
    return pairs.join(left, "a").join(right, "b").where((100 + percent) * bound >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _verify(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; shingles that one set alone holds aren't common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for total, x, y in zip(batch.column(2).to_numpy().tolist(), batch.column(3), batch.column(4), strict=True):
                both = np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
                both.sort()
                keep.append(bool((100 + percent) * int((both[1:] == both[:-1]).sum()) >= percent * total))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("grams").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("na").cast("long") + F.col("nb")).alias("total"), "x", "y")
    return both.mapInArrow(kernel.tidy(run), "a long, b long")


def _linked(nodes: DataFrame, scratch: Scratch, params: NearParams) -> DataFrame | None:
    """(node, component) of the nodes with links; none where there are none."""
    percent = params.percent
    entries = nodes.select("node", "n", "first", F.posexplode("prefix").alias("place", "token"))
    live = entries.select("token", "node", "n", (F.col("first") + F.col("place")).alias("at"))
    links = labels = tested = None
    linked, last = 0, False
    for turn in range(params.pivot_rounds + 1):
        last = last or turn == params.pivot_rounds
        if labels is None:
            live = live.withColumn("label", F.col("node"))
        else:
            live = live.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        live = scratch.save(live, f"live-{turn}")
        if not last:
            # The earlier place in a set, the fewer shingles it has for itself; later rounds deal another pivot.
            tie = F.xxhash64("label", F.lit(turn)) if turn else F.lit(0)
            pivot = live.groupBy("token").agg(F.min(F.struct("at", tie.alias("tie"), "node", "n", "label")).alias("p"), F.count("*").alias("df")).where("df > 1").select("token", "df", F.col("p.node").alias("p_node"), F.col("p.n").alias("p_n"), F.col("p.at").alias("p_at"), F.col("p.label").alias("p_label"))
            met = scratch.save(join_hot(live, pivot, ["token"], ["node"]).where("node <> p_node"), f"met-{turn}")
            fits = _passes("l", "r", percent).replace("l.", "").replace("r.", "p_")
            pairs = met.where(f"label <> p_label and {fits}").select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
            # A pivot has met its whole bucket and leaves; buckets of one node have nothing left to compare.
            live = met.where("df >= 3").select("token", "node", "n", "at")
        else:
            pairs = live.alias("l").join(live.alias("r"), F.expr(f"l.token = r.token and l.label <> r.label and l.node < r.node and {_passes('l', 'r', percent)}"))
            pairs = pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"pairs-{turn}")
        tested = pairs if tested is None else tested.unionAll(pairs)
        near = scratch.save(_suffix(pairs, nodes, percent), f"near-{turn}")
        found = scratch.save(_verify(near, nodes, percent), f"links-{turn}")
        scratch.drop(f"near-{turn}")
        links = found if links is None else links.unionAll(found)
        fresh = found.count()
        linked += fresh
        if fresh:
            labels = components(links, scratch, f"nodes-{turn}")
        scratch.drop(f"live-{turn}")
        if turn:
            scratch.drop(f"met-{turn - 1}")
        if last:
            break
        # Pivots are for large groups: once they find little, the last join does the rest.
        last = 20 * fresh <= linked
    return labels


def near_components(docs: DataFrame, scratch: Scratch, params: NearParams = NearParams()) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of each row of docs."""
    spark = docs.sparkSession
    kernel.tuned(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), "text")
    rows = scratch.save(keyed.select("doc_id", "k1", "k2", F.octet_length(text).alias("bytes")), "rows")
    keys = scratch.save(rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.max("bytes").alias("bytes")), "keys")

    # Texts have a word in six bytes, or less; what a bucket holds is bounded by this alone.
    total = (keys.agg(F.sum("bytes")).first()[0] or 0) // 6
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * max(2, -(-total // (parts * params.bucket_tokens)))
    dealt = _dealt(keyed, keys, buckets, params).repartition(parts, "bucket").sortWithinPartitions("bucket")
    shared = scratch.save(_shared(dealt, params), "shared")
    cut = shared.where("token is null").select("node", "k1", "k2", "n")

    # Only sets that hold enough shared shingles can link; the shingles of the others go.
    tokens = shared.where("token is not null").select("node", "token", "rarity")
    able = tokens.groupBy("node").agg(F.count("*").alias("held")).join(cut.select("node", "n"), "node").where(f"100L * held >= {params.percent}L * n").select("node", "n")
    able = scratch.save(able, "able")
    listed = tokens.join(F.broadcast(able) if able.count() <= params.sent_nodes else able, "node").groupBy("node", "n").agg(F.collect_list(F.struct("rarity", "token")).alias("shared"))
    nodes = scratch.save(_nodes(listed, params), "nodes")
    labels = _linked(nodes, scratch, params)

    # A text's set, its component, and the component's least document.
    sets = cut.groupBy("k1", "k2").agg(F.min("node").alias("node"), F.min("n").alias("n"))
    named = keys.drop("bytes").join(sets, ["k1", "k2"], "left")
    if labels is None:
        named = named.withColumn("component_id", F.lit(None).cast("long"))
    else:
        named = scratch.save(named.join(labels, "node", "left"), "named")
        least = scratch.save(named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
        named = join_hot(named, least, ["component"], ["k1"])
    named = scratch.save(named.select("k1", "k2", F.when(F.col("n").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles")), "texts")
    out = join_hot(rows, named, ["k1", "k2"], ["doc_id"])
    return out.select("doc_id", F.col("k1").alias("text_key"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch, params: NearParams = NearParams()) -> DataFrame:
    """docs with one row of each component, that of the least id; texts without words all stay once.

    Texts that surely stay don't move: a bitmap of fixed size parts them from those that an
    exact join then decides on. A row that repeats id and text stays once.
    """
    found = near_components(docs, scratch, params)
    each = found.groupBy(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")).agg(F.count("*").alias("__n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("__kept"))
    asked = scratch.save(each.where("__n > 1 or not __kept"), "asked")
    plain = kernel.shielded(docs, ("doc_id", "text"))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    bits = params.bitmap_bits
    rest, open_ = kernel.parted(plain, F.pmod(F.xxhash64("doc_id", key), F.lit(1 << bits)), asked.select(F.pmod(F.xxhash64("__d", "__k"), F.lit(1 << bits)).alias("s")), bits)
    joined = open_.join(asked, F.col("doc_id").eqNullSafe(F.col("__d")) & (key == F.col("__k")), "left")
    out = rest.unionAll(joined.where("__n is null").select(plain.columns))
    if not asked.where("__kept").isEmpty():
        out = out.unionAll(joined.where("__kept").dropDuplicates(["__d", "__k"]).select(plain.columns))
    return out.toDF(*docs.columns)


#: DuckDB SQL for the query: rows of doc_id, n_shingles, component_id.
ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from i),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as node, doc_id as reached from documents union select r.node, e.y from r join e on r.reached = e.x)
select r.node as doc_id, coalesce(max(n.n), 0)::BIGINT as n_shingles, min(r.reached) as component_id from r left join n on n.doc_id = r.node group by r.node
"""
