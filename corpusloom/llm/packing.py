"""Cost-balanced packing of token ids into sequences of fixed capacity.

A piece of n tokens costs n + n*n/capacity (linear layers and attention). Per shard,
pieces go in descending order to the lowest-cost sequence that has room; a piece that fits
nowhere whole is cut at the roomiest sequence. The shard's last tokens fill sequences of
powers of two, so nothing is padded.

Shards are runs of documents within an input partition, of a bounded number of tokens:
a task holds one shard's ids. Nothing is shuffled. Sequence ids are the partition number
in the high bits and a running number below.

Defined results: a null or empty text is one piece that holds the end id alone; repeated
rows are packed each time; ties go in the order of the rows and to the lowest sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import kernel, tokens


@dataclass(frozen=True)
class PackingParams:
    tokenizer: str | None = None
    end_id: int = 1
    capacity: int = 2048
    shard_tokens: int = 1 << 20


def plan(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (document, start, length, sequence, offset) of documents of such lengths."""
    whole = lengths // capacity
    doc = np.repeat(np.arange(len(lengths)), whole)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    pieces = [(doc, within * capacity, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64))]

    rest = lengths - whole * capacity
    total = int(rest.sum())
    room = [capacity] * (total // capacity)
    room += [1 << k for k in range(total.bit_length(), -1, -1) if total % capacity & (1 << k)]
    room = np.array(room, dtype=np.int64)
    filled, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    out = []
    for d in np.argsort(-rest, kind="stable"):
        start, left = int(whole[d] * capacity), int(rest[d])
        while left:
            fits = room >= left
            if fits.any():
                b, n = int(np.argmin(np.where(fits, cost, np.inf))), left
            else:
                b = int(np.argmax(room))
                n = int(room[b])
            out.append((d, start, n, len(doc) + b, filled[b]))
            cost[b] += n + n * n / capacity
            filled[b] += n
            room[b] -= n
            start, left = start + n, left - n
    if out:
        pieces.append(tuple(np.array(x, dtype=np.int64) for x in zip(*out, strict=True)))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*pieces, strict=True))


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, params: PackingParams = PackingParams(), with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its ids if asked for."""
    kernel.tuned(docs.sparkSession)
    path = params.tokenizer or tokens.default_tokenizer()

    def emit(ids: list[int | None], held: list[np.ndarray], base: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(x) for x in held], dtype=np.int64)
        d, start, length, sequence, offset = plan(lengths, params.capacity)
        cut = [held[i][a : a + n] for i, a, n in zip(d.tolist(), start.tolist(), length.tolist(), strict=True)]
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in cut]
        columns = [pa.array(ids, pa.int64()).take(pa.array(d)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(lengths[d]), pa.array(sequence + base), pa.array(offset)]
        if with_ids:
            columns.append(pa.array(cut, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names), int(sequence.max(initial=-1)) + 1

    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", ")), *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, ids, held, size = TaskContext.get().partitionId() << 40, [], [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, found in tokens.encode_column(batch.column(1), path, params.end_id):
                ids.append(keys[row])
                held.append(found)
                size += len(found)
                if size >= params.shard_tokens:
                    made, used = emit(ids, held, base)
                    yield made
                    base, ids, held, size = base + used, [], [], 0
        if ids:
            yield emit(ids, held, base)[0]

    return docs.select("doc_id", "text").mapInArrow(kernel.tidy(run, "tokens"), "doc_id long, " + SCHEMA + ", ids array<int>" * with_ids)
