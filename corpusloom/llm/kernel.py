"""Vectorised text kernel over Arrow string columns.

Works on the UTF-8 bytes of whole texts, a bounded slice of documents at a time. Word
breaks are the six ASCII spaces, so byte positions are safe to cut at. Span hashes are
polynomial over 64 bits, read from prefix sums, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer document is a slice of its own.
SLICE_BYTES = 1 << 19
#: Rows in an Arrow batch sent to Python: bounds a batch of very long texts.
BATCH_ROWS = 256

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each; those beyond a slice aren't kept."""
    if _tables and len(_tables[0]) > n:
        return _tables[0], _tables[1]
    made = []
    for factor in (_BASE, _INVERSE):
        row = np.full(max(n, SLICE_BYTES) + 2, factor, dtype=np.uint64)
        row[0] = 1
        made.append(np.multiply.accumulate(row, out=row))
    if n <= SLICE_BYTES + 1:
        _tables[:] = made
    return made[0], made[1]


def tuned(spark) -> None:
    """Arrow batches small enough for very long texts; shuffle files go when their query ends.

    Both are settings of the session, as Spark reads them when a plan runs, and stay set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


#: What operators keep in a worker from task to task, by name.
CACHES: dict[str, dict] = {}


def cache(name: str) -> dict:
    return CACHES.setdefault(name, {})


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = ""):
    """run for mapInArrow, in a worker that Spark keeps for later tasks.

    Before it starts the caches of other operators go; at its end what was freed is given back.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held in CACHES.items():
            if name != keeps:
                held.clear()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)

    return whole


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of documents; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes within a document: starts, ends, and each document's first run."""
    n = len(inside)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = inside & ~np.concatenate(([False], inside[:-1])) | inside & edge[:n]
    finishes = inside & ~np.concatenate((inside[1:], [False])) | inside & edge[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * _powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words in one document, and each document's first run."""
    count = np.diff(first)
    each = np.maximum(count - width + 1, 0)
    begin = np.concatenate(([0], np.cumsum(each)))
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], each) + np.arange(begin[-1])
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + hashes[at + k]
    return mix(out + np.uint64(width)), begin


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i."""
    if values.dtype.kind == "f":  # each segment by itself, so that a sum doesn't depend on its neighbours
        sums = np.add.reduceat(np.append(values, 0.0), first[:-1]) if len(first) > 1 else np.zeros(0)
        return np.where(first[1:] > first[:-1], sums, 0.0)
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return sums[first[1:]] - sums[first[:-1]]


def shielded(docs, needed: tuple[str, ...]):
    """docs with other columns than the needed ones renamed, so that they clash with nothing."""
    return docs.toDF(*(c if c in needed else f"__c{i}" for i, c in enumerate(docs.columns)))


def bitmap(slots, bits: int) -> np.ndarray:
    """Bits set for the values of the one column `s` of slots, below 2^bits; its size is fixed.

    At most 2^(bits - 6) rows come to the driver.
    """
    from pyspark.sql import functions as F

    words = slots.selectExpr("shiftrightunsigned(s, 6) as word", "shiftleft(1L, cast(s & 63 as int)) as bit")
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got["word"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)
    return table


def in_bitmap(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = slots.astype(np.uint64)
    return (table[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def parted(docs, slot, slots, bits: int):
    """(rest, asked): the rows of docs whose slot isn't among the values of the one column `s` of slots, and those whose is."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(slots, bits))  # fixed size
    slotted, schema = docs.withColumn("__slot", slot), docs.schema

    def part(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_bitmap(held.value, batch.column(batch.num_columns - 1).to_numpy()) == asked
                if hit.any():
                    yield batch.filter(pa.array(hit)).select(list(range(batch.num_columns - 1)))

        return slotted.mapInArrow(tidy(run), schema)

    return part(False), part(True)
