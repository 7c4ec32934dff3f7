"""Token ids in ascending document order, kept per shard as a Re-Pair grammar.

A shard file holds rules (pairs of symbols), the expansion length of each rule, and the
sequence of symbols. Symbols below the vocabulary's size are ids, the others rules. With
the expansion lengths, a range of ids is decoded without expanding the rest.

Compression works in rounds on a shard of bounded size: the most frequent pairs of those
that occur `min_count` times (a rule costs as much as four symbols) become rules and are
replaced from left to right without overlap, until no pair is so frequent or the symbols are
used up: 2^16, for a larger vocabulary the next power of two. The first `rounds` rounds
share the symbols out among them, further ones take what is left.

The files are Parquet rows in the shared folder (one blob per shard with its documents),
so any store that Spark reads can hold them. Range partitions by doc_id give the order.

Defined results: a null or empty text holds the end id alone; null ids come first; rows
that repeat an id follow each other in the order of their texts' hashes, then of the texts.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import kernel, tokens
from corpusloom.runtime import Scratch

MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIQ")


@dataclass(frozen=True)
class TokenFileParams:
    tokenizer: str | None = None
    end_id: int = 2
    vocabulary: int = 50257
    shard_tokens: int = 1 << 20
    rounds: int = 5
    min_count: int = 8


_SLOTS = 20


def _frequent_pairs(pair: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that occur often enough, ascending, and their counts."""
    ordered, more = np.sort(pair), max(min_count, 1) - 1
    # Where as many equal ones follow as are needed: in the run of a frequent pair, all but its last ones.
    often = np.flatnonzero(ordered[more:] == ordered[: max(len(ordered) - more, 0)])
    found = ordered[often]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(found), 1), bool), found[1:] != found[:-1])))
    return found[first], np.diff(first, append=len(found)) + more


def _pairs_near(seq: np.ndarray, where: np.ndarray, reach: int, wide: type, half: int) -> np.ndarray:
    """The pairs that begin one before each place and `reach` places on, each place once."""
    near = np.zeros(len(seq) + 1 + reach, bool)
    for k in range(reach):
        near[where + k] = True
    at = np.flatnonzero(near[1 : len(seq)])
    return seq[at].astype(wide) << wide(half) | seq[at + 1]


def compress(ids: np.ndarray, vocabulary: int, rounds: int = 5, min_count: int = 8) -> bytes:
    # Two bytes a symbol where the vocabulary leaves room for rules, else four.
    limit = 1 << max(16, vocabulary.bit_length())
    half = 16 if limit == 1 << 16 else 32
    word, wide = (np.uint16, np.uint32) if half == 16 else (np.uint32, np.uint64)
    spread, shift = (wide(0x9E3779B1), wide(32 - _SLOTS)) if half == 16 else (wide(0x9E3779B97F4A7C15), wide(64 - _SLOTS))
    seq = ids.astype(word)
    rules, lengths = np.zeros((0, 2), word), np.zeros(0, np.uint32)
    counted = None
    for turn in itertools.count():
        share = -(-(limit - vocabulary - len(rules)) // max(1, rounds - turn))
        if len(seq) < 2 or share < 1:
            break
        if counted is None:
            pair = seq[:-1].astype(wide)
            pair <<= wide(half)
            pair |= seq[1:]
            counted = _frequent_pairs(pair, min_count)
        found, count = counted
        if not len(found):
            break
        # By falling count, then pair.
        pairs = found[np.argsort(-count, kind="stable")[:share]]
        # A table from slot to pair finds occurrences without a search; of pairs that share
        # a slot the most frequent one is taken, the others wait for the next round.
        # Symbols that begin or end no such pair are passed over first.
        side = np.zeros(limit, np.uint8)
        side[pairs >> wide(half)] = 1
        side[pairs & wide((1 << half) - 1)] |= 2
        side = side.take(seq)
        where = np.flatnonzero(side[:-1] & (side[1:] >> 1))
        number = np.int16 if len(pairs) < 1 << 15 else np.int32
        table = np.full(1 << _SLOTS, -1, number)
        table[(pairs[::-1] * spread) >> shift] = np.arange(len(pairs), dtype=number)[::-1]
        pair = seq[where].astype(wide) << wide(half) | seq[where + 1]
        rule = table[(pair * spread) >> shift]
        same = (rule >= 0) & (pairs[rule] == pair)
        where, rule = where[same], rule[same]
        # Overlapping occurrences: in each run of neighbours take every second, from the left.
        place = np.arange(len(where))
        run = np.maximum.accumulate(np.where(np.diff(where, prepend=-2) != 1, place, 0))
        every = (place - run) % 2 == 0
        where, rule = where[every], rule[every]
        taken = np.zeros(len(pairs), dtype=bool)
        taken[rule] = True
        used = pairs[taken]
        fresh = np.column_stack((used >> wide(half), used & wide((1 << half) - 1))).astype(word)
        # Where few places change, only the pairs there are counted anew: those made hold a new symbol.
        few = 64 * len(where) < len(seq)
        gone = _pairs_near(seq, where, 3, wide, half) if few else None
        seq[where] = (vocabulary + len(rules) + np.cumsum(taken) - 1)[rule]
        keep = np.ones(len(seq), dtype=bool)
        keep[where + 1] = False
        seq = seq[keep]
        counted = None
        if few:
            at = np.searchsorted(found, gone)
            at = at[found[np.minimum(at, len(found) - 1)] == gone]
            count = count - np.bincount(at, minlength=len(found))
            made, times = _frequent_pairs(_pairs_near(seq, where - np.arange(len(where)), 2, wide, half), min_count)
            found, count = np.concatenate((found[count >= min_count], made)), np.concatenate((count[count >= min_count], times))
            order = np.argsort(found)
            counted = found[order], count[order]
        size = np.concatenate((np.ones(vocabulary, np.uint32), lengths))
        rules, lengths = np.concatenate((rules, fresh)), np.concatenate((lengths, size[fresh[:, 0]] + size[fresh[:, 1]]))
    kind = f"<u{half // 8}"
    head = _HEAD.pack(MAGIC, vocabulary, len(rules), half // 8, len(seq))
    return b"".join((head, rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), seq.astype(kind).tobytes()))


def _parts(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    magic, vocabulary, n_rules, width, n = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at, kind = _HEAD.size, f"<u{width}"
    rules = np.frombuffer(blob, kind, 2 * n_rules, at).reshape(-1, 2).astype(np.uint32)
    at += 2 * n_rules * width
    lengths = np.frombuffer(blob, "<u4", n_rules, at)
    return vocabulary, rules, lengths, np.frombuffer(blob, kind, n, at + 4 * n_rules).astype(np.uint32)


def _expand(seq: np.ndarray, vocabulary: int, rules: np.ndarray) -> np.ndarray:
    while len(where := np.flatnonzero(seq >= vocabulary)):
        pair = rules[seq[where] - vocabulary]
        wide = np.ones(len(seq), np.int64)
        wide[where] = 2
        seq = np.repeat(seq, wide)
        first = where + np.arange(len(where))
        seq[first], seq[first + 1] = pair[:, 0], pair[:, 1]
    return seq


class Shard:
    """Random access to a shard: a range of ids expands only the symbols that hold it."""

    def __init__(self, blob: bytes):
        self.vocabulary, self.rules, lengths, self.seq = _parts(blob)
        size = np.ones(len(self.seq), np.int64)
        rule = self.seq >= self.vocabulary
        size[rule] = lengths[self.seq[rule] - self.vocabulary]
        self.end = np.cumsum(size)

    def ids(self, start: int, length: int) -> np.ndarray:
        """The ids at start:start+length."""
        if length <= 0 or not len(self.end):
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.end, start, "right"), np.searchsorted(self.end, start + length, "left")
        base = int(self.end[a - 1]) if a else 0
        return _expand(self.seq[a : b + 1], self.vocabulary, self.rules)[start - base : start - base + length]


def decompress(blob: bytes) -> np.ndarray:
    vocabulary, rules, _, seq = _parts(blob)
    return _expand(seq, vocabulary, rules)


def decode_range(blob: bytes, start: int, length: int) -> np.ndarray:
    return Shard(blob).ids(start, length)


#: Ids that are expanded at once when documents are read.
RANGE_IDS = 1 << 17
SHARD_SCHEMA = "partition int, shard int, n_ids long, doc_ids array<long>, lengths array<long>, grammar binary"


def write(docs: DataFrame, scratch: Scratch, params: TokenFileParams = TokenFileParams()) -> DataFrame:
    """Write the shards; the table of them, read back."""
    kernel.tuned(docs.sparkSession)
    path = params.tokenizer or tokens.default_tokenizer()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, shard, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def done() -> pa.RecordBatch:
            blob = compress(np.concatenate(held), params.vocabulary, params.rounds, params.min_count)
            return pa.RecordBatch.from_arrays(
                [pa.array([partition], pa.int32()), pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                names=["partition", "shard", "n_ids", "doc_ids", "lengths", "grammar"],
            )

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, found in tokens.encode_column(batch.column(1), path, params.end_id):
                ids.append(keys[row])
                held.append(found)
                size += len(found)
                if size >= params.shard_tokens:
                    yield done()
                    shard, ids, held, size = shard + 1, [], [], 0
        if ids:
            yield done()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The hash of the text deals the rows of one id, or of none, over several ranges.
    order = (F.col("doc_id").asc_nulls_first(), F.col("text_key"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return scratch.save(ordered.mapInArrow(kernel.tidy(shards, "tokens"), SHARD_SCHEMA), "tokens")


def documents(files: DataFrame, scratch: Scratch) -> DataFrame:
    """Each document's place and checksum, decoded from the shards a range of ids at a time."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["base", "doc_ids", "lengths", "grammar"]).to_pylist():
                shard, lengths, crc = Shard(row["grammar"]), np.array(row["lengths"], np.int64), []
                end = np.cumsum(lengths)
                start, first = end - lengths, 0
                while first < len(lengths):
                    # So many documents as fill a range, one at least.
                    base = int(start[first])
                    last = max(first + 1, int(np.searchsorted(end, base + RANGE_IDS, "right")))
                    ids = shard.ids(base, int(end[last - 1]) - base).astype("<u4")
                    crc += [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip((start[first:last] - base).tolist(), lengths[first:last].tolist(), strict=True)]
                    first = last
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start + row["base"]), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # Two levels: a window over partitions (one row each), another within each partition.
    sizes = files.select("partition", "shard", "n_ids")
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.groupBy("partition").agg(F.sum("n_ids").alias("n")).select("partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("partition_base"))
    within = Window.partitionBy("partition").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("shard_base", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(base, "partition").select("partition", "shard", (F.col("partition_base") + F.col("shard_base")).alias("base"))
    # Written, so that Spark knows its size before it chooses how to join: the shards stay where they are.
    return files.join(scratch.save(bases, "bases"), ["partition", "shard"]).mapInArrow(kernel.tidy(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")
