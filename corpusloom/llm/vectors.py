"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

Vectors are unit-scaled in double precision and rotated by three rounds of random signs
and the fast Hadamard transform; a hash is the nearest of the 2 d signed axes. A table
joins `width` hashes. Each vector is kept under its own bucket of a table and looks into
further buckets (multiprobe): those where the nearest axes are traded for the next nearest,
by falling score. Vectors that meet are compared in double precision, once per pair: in the
first table where they meet.

A vector is compared only with those of the same label. Equal vectors are one node that
carries its number of copies. Buckets are dealt in blocks: a bucket of m vectors makes
pairs of blocks of at most `block` vectors, so a hot bucket is many tasks' worth of groups.
A group gives its counts and least link per vector, not its pairs.

Defined results: null vectors, zero vectors and those with null, non-finite or no
components, and vectors without a label, link with nothing. Vectors of different lengths
never link. Rows that repeat an id each keep their own links; a null id is a copy without a
name, and its component is the least id among the others, or null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernel
from corpusloom.llm.components import components
from corpusloom.runtime import Scratch


@dataclass(frozen=True)
class VectorParams:
    cosine: float = 0.98
    tables: int = 6
    width: int = 2
    probes: int = 3
    block: int = 256
    seed: int = 11


def _signs(tables: int, width: int, size: int, seed: int) -> np.ndarray:
    bits = kernel.mix(np.arange(tables * width * 3 * size, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    return np.where(bits >> np.uint64(63), 1.0, -1.0).reshape(tables * width, 3, size)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def codes(x: np.ndarray, params: VectorParams) -> np.ndarray:
    """Buckets of unit rows: (rows, tables, probes); the first of each table is the row's own."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    signs = _signs(params.tables, params.width, size, params.seed)
    axes, scores = [], []
    ranks = min(3, size)
    for k in range(params.tables * params.width):
        y = x
        for turn in range(3):
            y = hadamard(y * signs[k, turn]) / np.sqrt(size)
        best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :ranks]
        value = np.take_along_axis(y, best, 1)
        axes.append(best * 2 + (value < 0))
        scores.append(np.abs(value))
    axes = np.stack(axes, 1).reshape(len(x), params.tables, params.width, ranks)
    scores = np.stack(scores, 1).reshape(len(x), params.tables, params.width, ranks)
    # All trades of ranks among the joined hashes, the least loss first.
    trades = np.stack(np.meshgrid(*[np.arange(ranks)] * params.width, indexing="ij"), -1).reshape(-1, params.width)
    loss = sum((scores[:, :, j, :1] - scores[:, :, j, :])[:, :, trades[:, j]] for j in range(params.width))
    order = np.argsort(loss, axis=2, kind="stable")[:, :, : params.probes]
    code = np.zeros((len(x), params.tables, len(trades)), np.int64)
    for j in range(params.width):
        code = code * (2 * size) + axes[:, :, j, :][:, :, trades[:, j]]
    return np.take_along_axis(code, order, 2)


def _is_usable() -> Column:
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    number = F.col("embedding").cast("array<double>")
    fine &= ~F.exists(number, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(number, lambda v: v != 0)
    return F.coalesce(fine, F.lit(False))


def _usable(vectors: DataFrame) -> DataFrame:
    # The components keep their own type (floats are half as wide); -0.0 and 0.0 are one value.
    value = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0).cast("float")).otherwise(v))
    return vectors.where(_is_usable()).select("vec_id", F.col("label").cast("string").alias("label"), value.alias("v"))


def _unit(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a column of doubles, padded to one width, and their lengths."""
    column = batch.column(batch.schema.get_field_index(name))
    where = column.offsets.to_numpy()
    flat, size = column.values.to_numpy().astype(np.float64), np.diff(where)
    out = np.zeros((len(column), size.max(initial=1)))
    out[np.arange(out.shape[1]) < size[:, None]] = flat[where[0] : where[-1]]
    out /= np.abs(out).max(axis=1, initial=1e-300)[:, None]  # no overflow in the squares
    return out / np.sqrt((out * out).sum(axis=1))[:, None], size


def _entries(nodes: DataFrame, params: VectorParams) -> DataFrame:
    """A row for each bucket that a node is kept in or looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, size = _unit(batch, "v")
            node = batch.column(batch.schema.get_field_index("node")).to_numpy()
            for d in np.unique(size):
                of = np.flatnonzero(size == d)
                made = codes(unit[of, :d], params)
                tables, probes = made.shape[1:]
                row = np.repeat(of, tables * probes)
                table = np.tile(np.repeat(np.arange(tables), probes), len(of))
                home = np.tile(np.arange(probes) == 0, len(of) * tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[row]), batch.column(batch.schema.get_field_index("label")).take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(table.astype(np.int32)), pa.array(made.reshape(-1)), pa.array(home)],
                    names=["node", "label", "d", "tab", "code", "home"],
                )

    return nodes.select("node", "label", "v").mapInArrow(kernel.tidy(run), "node long, label string, d int, tab int, code long, home boolean")


def near_vectors(vectors: DataFrame, scratch: Scratch, params: VectorParams = VectorParams()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    kernel.tuned(vectors.sparkSession)
    usable = _usable(vectors)
    nodes = scratch.save(usable.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("label", "v")), "nodes")
    entries = scratch.save(_entries(nodes, params), "entries")

    # Blocks of a bucket: keepers and lookers are dealt by hash into parts of about `block`.
    key = ["label", "d", "tab", "code"]
    sizes = entries.groupBy(*key).agg(F.sum(F.col("home").cast("long")).alias("kept"), F.count("*").alias("all")).where("kept > 0 and all > 1")
    blocks = lambda c: F.ceil(F.col(c) / params.block).cast("int")
    dealt = entries.join(sizes, key).withColumn("kb", blocks("kept")).withColumn("lb", blocks("all"))
    mine = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    keepers = dealt.where("home").select("node", *key, mine("kb", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("lb") - 1)).alias("j"), F.lit(True).alias("keeper"))
    lookers = dealt.select("node", *key, F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("i"), mine("lb", 2).alias("j"), F.lit(False).alias("keeper"))
    groups = keepers.unionAll(lookers).withColumn("group", F.xxhash64(*key, "i", "j"))
    full = groups.join(nodes.select("node", "copies", "v"), "node").select("group", "node", "keeper", "tab", "copies", "v")

    found = scratch.save(full.groupBy("group").applyInArrow(_compare(params), "node long, n long, other long"), "links")
    links = found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    labels = components(links, scratch, "component")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))

    by_node = nodes.join(counts, "node", "left").join(labels, "node", "left").select("label", "v", "first", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("component"))
    least = by_node.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = by_node.join(least, "component").select("label", "v", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    usable_rows = usable.join(by_node, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~_is_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable_rows.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compare(params: VectorParams):
    """Counts per node, and one link of each, over the keepers and lookers of a group."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        unit, size = _unit(batch, "v")
        get = lambda k: batch.column(batch.schema.get_field_index(k))
        node, copies, tab = get("node").to_numpy(), get("copies").to_numpy(), int(get("tab")[0].as_py())
        keeper = get("keeper").to_numpy(zero_copy_only=False)
        k, q = np.flatnonzero(keeper), np.flatnonzero(~keeper)
        empty = pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if not len(k) or not len(q):
            return empty
        close = np.einsum("id,jd->ij", unit[q], unit[k]) >= params.cosine
        close &= node[q][:, None] != node[k][None, :]
        a, b = np.nonzero(close)
        if not len(a):
            return empty
        # Only vectors with something close are hashed again.
        near, place = np.unique(np.concatenate((q[a], k[b]))), np.zeros(len(node), np.int64)
        place[near] = np.arange(len(near))
        made = codes(unit[near, : size[0]], params)
        # A pair counts where it first meets: no earlier table, and the looker with the larger
        # node only if the other doesn't look into its bucket here.
        qa, kb = q[a], k[b]
        first = np.ones(len(a), dtype=bool)
        for t in range(tab + 1):
            forth = (made[place[qa], t, :] == made[place[kb], t, :1]).any(axis=1)
            back = (made[place[kb], t, :] == made[place[qa], t, :1]).any(axis=1)
            if t < tab:
                first &= ~(forth | back)
            else:
                first &= ~(back & (node[qa] > node[kb]))
        qa, kb = qa[first], kb[first]
        if not len(qa):
            return empty
        ends, others = np.concatenate((qa, kb)), np.concatenate((kb, qa))
        times = np.bincount(ends, weights=copies[others], minlength=len(node)).astype(np.int64)
        # Enough links for the components of this group: each end with the least one it meets.
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, ends, node[others])
        seen = np.flatnonzero(times)
        return _spanning(node, seen, times, qa, kb)

    return run


def _spanning(node: np.ndarray, seen: np.ndarray, times: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """A row for each node seen: its count, and the least node of its component within the group."""
    root = node.copy()
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    return pa.table({"node": pa.array(node[seen]), "n": pa.array(times[seen]), "other": pa.array(root[seen])})


#: DuckDB SQL for the query: rows of vec_id, n_links, component_id, kept.
ORACLE = """
with recursive v as (select vec_id, label, embedding::DOUBLE[] as e from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
n as (select x, count(*) as n from l group by x),
r as (select vec_id as node, vec_id as reached from embeddings union select r.node, l.y from r join l on r.reached = l.x)
select r.node as vec_id, coalesce(max(n.n), 0)::BIGINT as n_links, min(r.reached) as component_id, r.node = min(r.reached) as kept from r left join n on n.x = r.node group by r.node
"""
