"""Token ids of whole texts by the tokenizers library, encoding each distinct chunk once.

The byte-level pre-tokenizer never joins a non-space to a following space, so a text may
be cut before each run of white space and the ids of its chunks joined. Its pattern also
ends a token where letters, digits and other signs meet, so there a text is cut as well:
"once." and "once," share a chunk. Distinct chunks go through the library once per worker;
a bounded cache keeps their ids by 64-bit hash, and when full those it met again.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
import pyarrow as pa

from corpusloom.llm import kernel

#: Chunks longer than this many bytes are encoded at each occurrence, not cached.
LONGEST_CACHED = 64
#: Beyond so many chunks the cache drops those it didn't meet again.
MOST_CACHED = 1_000_000

#: The leading bytes of UTF-8 sequences that can be Unicode white space, and
#: ASCII control characters some engines count as white space. No cut is made after these.
_SPACE_LEADS_3 = ((0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))
_SPACE_PAIRS = ((0xC2, 0x85), (0xC2, 0xA0))

#: Bytes that may be, or begin, white space of any kind.
_ODD_BYTE = np.isin(np.arange(256), [*range(33), 127, 0xC2, 0xE1, 0xE2, 0xE3])

#: ASCII letters 1, digits 2, other signs 3; 0 for anything else.
_KIND = np.array([(1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3) if 32 < c < 127 else 0 for c in range(256)], np.uint8)
#: The leading bytes of U+00C0 to U+027F, which are letters but for two signs.
_LETTER_LEADS, _NO_LETTERS = (0xC3, 0xC9), ((0xC3, 0x97), (0xC3, 0xB7))
_APOSTROPHE = 39


def _pair_facts() -> np.ndarray:
    """What two neighbouring bytes tell, a bit each, by first byte * 256 + second byte."""
    a, b = np.divmod(np.arange(1 << 16), 256)
    facts = np.zeros(1 << 16, np.uint8)
    one = kernel.IS_SPACE[b] | (b >= 0x1C) & (b <= 0x1F)
    facts[one | np.logical_or.reduce([(a == x) & (b == y) for x, y in _SPACE_PAIRS])] |= _ODD
    facts[np.logical_or.reduce([(a == x) & (b == y) for x, y in _SPACE_LEADS_3])] |= _ODD_NEXT
    facts[kernel.IS_SPACE[b]] |= _SPACE
    # Nothing is said after an apostrophe, which takes the letters of 's and the like.
    facts[(_KIND[a] > 0) & (_KIND[b] > 0) & (_KIND[a] != _KIND[b]) & (a != _APOSTROPHE)] |= _CHANGE
    facts[(a >= _LETTER_LEADS[0]) & (a <= _LETTER_LEADS[1]) & ~np.logical_or.reduce([(a == x) & (b == y) for x, y in _NO_LETTERS])] |= _LETTER
    facts[_KIND[b] > 1] |= _AFTER_LETTER
    return facts


#: The second byte may end white space of any kind; the byte after it does; it is ASCII white
#: space; an ASCII letter, digit or other sign that follows one of another kind; it ends a
#: letter that isn't ASCII; it is an ASCII digit or other sign.
_ODD, _ODD_NEXT, _SPACE, _CHANGE, _LETTER, _AFTER_LETTER = (1 << k for k in range(6))
_FACTS = _pair_facts()


def cut_points(data: np.ndarray, offsets: np.ndarray, by_kind: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chunks, and the bytes that may end white space of any kind.

    Chunks start where documents do, at white space after what can't be white space, and
    where by_kind a letter, digit or other sign follows one of another kind.
    """
    n = len(data)
    pair = np.zeros(n, np.uint16)
    pair[1:] = data[:-1]
    pair <<= np.uint16(8)
    pair |= data
    facts = _FACTS.take(pair)
    odd = facts & _ODD > 0
    odd[1:] |= facts[:-1] & _ODD_NEXT > 0
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:n] = (facts[1:] & _SPACE > 0) & ~odd[:-1]
    if by_kind:
        cut[1:n] |= (facts[1:] & _CHANGE > 0) | (facts[:-1] & _LETTER > 0) & (facts[1:] & _AFTER_LETTER > 0)
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut), odd


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i] : starts[i] + counts[i], joined."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Table:
    """Sorted chunk hashes with the place and number of their ids, and which were met again."""

    def __init__(self):
        self.keys, self.starts, self.counts, self.again = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, again: np.ndarray) -> None:
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.counts, self.again = keys[order], np.concatenate((self.starts, starts))[order], np.concatenate((self.counts, counts))[order], np.concatenate((self.again, again))[order]


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        before = told.get("pre_tokenizer") or {}
        # The kinds are those of this pre-tokenizer's own pattern.
        self.by_kind = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not told.get("normalizer") and all(x["special"] for x in told.get("added_tokens") or [])
        vocabulary = self.tokenizer.get_vocab()
        # A byte-level token has a character for each of its bytes.
        self.size = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))
        self._clear()

    def _clear(self) -> None:
        self.main, self.recent = _Table(), _Table()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _merge(self) -> None:
        self.main.add(self.recent.keys, self.recent.starts, self.recent.counts, self.recent.again)
        self.recent = _Table()

    def _shrink(self) -> None:
        """Only chunks met again since the last time stay; none, if that is most of them."""
        self._merge()
        old, ids = self.main, self.ids
        stay = np.flatnonzero(old.again)
        self._clear()
        counts = old.counts[stay]
        if len(stay) <= MOST_CACHED // 2 and int(counts.sum()) <= 4 * MOST_CACHED:
            starts = self._keep(ids[_spans(old.starts[stay], counts)]) + np.cumsum(counts) - counts
            self.main.add(old.keys[stay], starts, counts, np.zeros(len(stay), bool))

    def _keep(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _joined(self, cut: list[bytes], bare: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the chunks encoded as one text, and their numbers, by the bytes of each token; None if these don't tell."""
        text = b"".join([b"\n" + x if b else x for x, b in zip(cut, bare.tolist(), strict=True)]).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        ends, at = np.cumsum(sizes + bare), np.concatenate(([0], np.cumsum(self.size[ids])))
        first, last = np.searchsorted(at, ends - sizes), np.searchsorted(at, ends)
        # Each newline put in is a token by itself, and each chunk ends with a token.
        if last[-1] != len(ids) or (at[last] != ends).any() or (np.diff(last, prepend=0) != last - first + bare).any() or (at[first] != ends - sizes).any() or (last - first < 1).any():
            return None
        if bare.any():
            ids = np.delete(ids, first[bare] - 1)
        return ids, last - first

    def _encode(self, data: np.ndarray, odd: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chunks in an order of their own, their numbers, and which chunks these are.

        A chunk whose end can't be white space may be followed by ASCII white space, so such
        chunks go through the library as one text. A newline stands before those that begin
        with something else.
        """
        raw = data.tobytes()
        cut = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        bare = ~kernel.IS_SPACE[data[starts]]
        plain = ~odd[ends - 1] & ~(bare & _ODD_BYTE[data[starts]])
        joined, single = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids = counts = np.zeros(0, np.int64)
        if len(joined):
            if (made := self._joined([cut[k] for k in joined.tolist()], bare[joined])) is None:
                joined, single = joined[:0], np.arange(len(cut))
            else:
                ids, counts = made
        found = [x.ids for x in self.tokenizer.encode_batch_fast([cut[k].decode() for k in single.tolist()], add_special_tokens=False)] if len(single) else []
        rest = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.concatenate((ids, np.fromiter((i for x in found for i in x), np.int64, int(rest.sum()))))
        return ids.astype(np.uint32), np.concatenate((counts, rest)), np.concatenate((joined, single))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents joined, and where each document's ids start (one more at the end)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, odd = cut_points(data, offsets, self.by_kind)
        ends = np.append(starts[1:], len(data))
        keys = kernel.span_hashes(kernel.prefix_sums(data), starts, ends)
        long = np.flatnonzero(ends - starts > LONGEST_CACHED)
        if len(long):  # each its own key: hashes of long spans aren't relied on
            keys[long] = np.arange(len(long), dtype=np.uint64)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.main.keys) + len(self.recent.keys) > MOST_CACHED or self.used > 8 * MOST_CACHED:
            self._shrink()
        keep = ends[first] - starts[first] <= LONGEST_CACHED
        place, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        missing = np.ones(len(distinct), dtype=bool)
        for table in (self.main, self.recent):
            at = table.find(distinct)
            hit = (at >= 0) & missing & keep
            found = at[hit]
            place[hit], count[hit], table.again[found] = table.starts[found], table.counts[found], True
            missing &= ~hit
        new = np.flatnonzero(missing)
        if len(new):
            ids, counts, order = self._encode(data, odd, starts[first[new]], ends[first[new]])
            new = new[order]
            place[new] = self._keep(ids) + np.concatenate(([0], np.cumsum(counts)[:-1]))
            count[new] = counts
            add = new[keep[new]]
            self.recent.add(distinct[add], place[add], count[add], np.zeros(len(add), bool))
            if len(self.recent.keys) > max(100_000, len(self.main.keys) // 4):
                self._merge()
        lengths = count[inverse]
        bounds = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, offsets)]
        return self.ids[_spans(place[inverse], lengths)], bounds


_encoders: dict[str, ChunkEncoder] = kernel.cache("tokens")


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_column(column: pa.Array, path: str, end_id: int):
    """(row, ids with the end id) of each text of an Arrow column; null is empty."""
    coder = encoder(path)
    for first, last, data, offsets in kernel.slices(column):
        ids, bounds = coder.encode(data, offsets)
        ends = bounds[1:] + np.arange(last - first)
        whole, own = np.empty(len(ids) + last - first, np.uint32), np.ones(len(ids) + last - first, bool)
        own[ends] = False
        whole[own], whole[ends] = ids, end_id
        begin = 0
        for row, end in enumerate(ends.tolist(), first):
            yield row, whole[begin : end + 1].copy()  # of its own, so that one text doesn't hold the slice
            begin = end + 1
