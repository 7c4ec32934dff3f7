"""Word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that start a word and pieces inside one.
Each node has a failure link, where matching goes on when no child fits, and the number of
pieces that are finished by taking it. A word's greedy longest-match length is then a sum
over one pass of its bytes; no piece is built. Each distinct short word is run once per worker.

The vocabulary comes from a byte-level tokenizer file: tokens with the mark for a leading
space start words, the others go on; every single byte can do either, so a word always
has a length.

Defined results: a null, empty or blank text has 0 words and 0 pieces. Words are runs of
other than the six ASCII spaces. Each row stands alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernel
from corpusloom.llm.tokens import LONGEST_CACHED, MOST_CACHED, _Table, default_tokenizer


class Automaton:
    START, INSIDE, NONE = 0, 1, -1

    def __init__(self, starts: Iterable[bytes], insides: Iterable[bytes]):
        self.next: dict[int, int] = {}
        known: list[bool] = [False, False]
        edges: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
        for root, pieces in ((self.START, starts), (self.INSIDE, insides)):
            for piece in pieces:
                node = root
                for c in piece:
                    key = node << 8 | c
                    if key not in self.next:
                        self.next[key] = len(known)
                        known.append(False)
                        edges.append((node, c))
                    node = self.next[key]
                known[node] = node > 1
        self.fail, self.pops = [self.NONE] * len(known), [0] * len(known)
        depth = [0, 0] + [0] * (len(known) - 2)
        for v in range(2, len(known)):
            depth[v] = depth[edges[v][0]] + 1
        for v in sorted(range(2, len(known)), key=depth.__getitem__):
            parent, c = edges[v]
            if known[v]:
                self.fail[v], self.pops[v] = self.INSIDE, 1
                continue
            at, popped = self.fail[parent], self.pops[parent]
            while at != self.NONE and at << 8 | c not in self.next:
                popped, at = popped + self.pops[at], self.fail[at]
            if at != self.NONE:
                self.fail[v], self.pops[v] = self.next[at << 8 | c], popped

    def length(self, word: bytes) -> int:
        """Number of greedy pieces; 1 (the unknown piece) for a word that can't be split."""
        follow, fail, pops = self.next, self.fail, self.pops
        node, count = self.START, 0
        for c in word:
            while (step := follow.get(node << 8 | c, -1)) < 0:
                count += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = step
        while node != self.INSIDE:
            count += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return count


def byte_level_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that start words and pieces inside them, from a byte-level tokenizer file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    decode = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    with open(path, encoding="utf-8") as f:
        words = [bytes(decode[c] for c in w) for w in json.load(f)["model"]["vocab"] if all(c in decode for c in w)]
    single = [bytes([b]) for b in range(256)]
    return [w[1:] for w in words if w[:1] == b" " and len(w) > 1] + single, [w for w in words if w[:1] != b" "] + single


class Counter:
    """Piece counts of distinct words, kept by hash up to a bound."""

    def __init__(self, path: str):
        self.automaton = Automaton(*byte_level_vocabulary(path))
        self.main, self.recent = _Table(), _Table()

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.int64)
        raw, length = data.tobytes(), self.automaton.length
        long = ends - starts > LONGEST_CACHED
        for k in np.flatnonzero(long):
            out[k] = length(raw[starts[k] : ends[k]])
        short = np.flatnonzero(~long)
        keys, first, inverse = np.unique(kernel.span_hashes(kernel.prefix_sums(data), starts[short], ends[short]), return_index=True, return_inverse=True)
        made = np.zeros(len(keys), np.int64)
        if len(self.main.keys) > MOST_CACHED:
            self.main, self.recent = _Table(), _Table()
        missing = np.ones(len(keys), dtype=bool)
        for table in (self.main, self.recent):
            at = table.find(keys)
            hit = (at >= 0) & missing
            made[hit] = table.counts[at[hit]]
            missing &= ~hit
        new = np.flatnonzero(missing)
        a, b = starts[short][first[new]].tolist(), ends[short][first[new]].tolist()
        made[new] = [length(raw[i:j]) for i, j in zip(a, b, strict=True)]
        self.recent.add(keys[new], new, made[new], np.zeros(len(new), bool))
        if len(self.recent.keys) > max(100_000, len(self.main.keys) // 4):
            self.main.add(self.recent.keys, self.recent.starts, self.recent.counts, self.recent.again)
            self.recent = _Table()
        out[short] = made[inverse]
        return out


_counters: dict[str, Counter] = kernel.cache("pieces")


def piece_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_pieces, longest_word_pieces) of each row."""
    kernel.tuned(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            parts = []
            for _, _, data, offsets in kernel.slices(batch.column(1)):
                starts, ends, first = kernel.runs(~kernel.IS_SPACE[data], offsets)
                counts = counter.counts(data, starts, ends)
                most = [int(counts[a:b].max(initial=0)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                parts.append((np.diff(first), kernel.segment_sums(counts, first), most))
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True))], names=["doc_id", "n_words", "n_pieces", "longest_word_pieces"])

    return docs.select("doc_id", F.col("text")).mapInArrow(kernel.tidy(run, "pieces"), "doc_id long, n_words long, n_pieces long, longest_word_pieces long")
