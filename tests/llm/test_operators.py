"""Each operator against a brute-force version, on the smallest tables and on odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import kernel, licenses, mixing, near_join, packing, pieces, pii, quality, queries, secrets, token_files, tokens, vectors
from corpusloom.runtime import Scratch, read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, " \n\t ", "a"),
    (4, "one two three four five six seven", "b"),
    (5, "ONE two  three\nfour five six seven", "b"),
    (6, "one two three four five six seven", "b"),
    (6, "one two three four five six seven", "b"),
    (7, "naïve café 日本 語   x y \U0001f600  \U0001f600 z", None),
    (8, "a" * 3000 + " " + "b@" * 50 + "c.d 1.2.3.4.5.6.7.8 +1 (234) 555-6789 4111 1111 1111 1111", "c"),
    (9, "token: secret: abcdefghijklmnop AKIA" + "A" * 14 + " token='0123456789abcdef0' x@y@z.com", "c"),
    (10, "lorem ipsum dolor " * 3000, "d"),
    (None, "no id here at all, but five words", "d"),
    (11, "key Zx9Qw3Er7Ty1Ui5Op2As8Df4Gh6Jk0L and 123e4567-e89b-12d3-a456-426614174000 some-long-slug-of-words-2024", "d"),
]


def documents(spark, rows=ODD):
    # Further columns have names that operators use themselves.
    full = [(*r, 1, "kept", 2.5) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, n long, kept string, size double")


@pytest.fixture(scope="module")
def both(spark, small):
    """Odd rows, and rows of the smallest table."""
    some = read(spark, small, "documents").select("doc_id", "text", "source")
    rows = [tuple(r) for r in some.collect()]
    return ODD + [(i + 100, t, s) for i, t, s in rows]


def test_mixing(spark, both):
    docs = documents(spark, both)
    got = mixing.assign(docs.select("doc_id", "text", "source"), Scratch(spark, "t")).collect()
    size = defaultdict(int)
    for _, t, s in both:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(x for x in size if x is not None) + [None] * (None in size)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s] - 1e-9}
        target |= {s: 3.0 * size[s] for s in full} or share
        left -= sum(3 * size[s] for s in full)
        open_ = open_ - full if full else set()
    assert len(got) == len(both)
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == size[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-12)
        assert r["target"] / max(1, r["source_size"]) - 1 < r["copies"] <= 3
    out = mixing.mix(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)


def brute_secrets(text):
    kinds = (("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", r"[0-9a-f]+"))
    base = []
    for order, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            if len(m[2]) >= 12 if kind == "assign" else m.end() - m.start() >= (18 if kind == "access" else 16):
                base.append((m.start(), order, m.end(), kind))
    extra, p = [], secrets.SecretParams()
    for m in re.finditer(secrets.CANDIDATE, text):
        s = m.group()
        if any(re.search(x, s) for x in secrets.ALLOWED[:-1]) or any(a <= m.start() and m.end() <= b for a, _, b, _ in base):
            continue
        bits = p.hex_bits if re.fullmatch("[0-9a-fA-F]+", s) else p.letter_bits if re.fullmatch("[a-zA-Z]+", s) else p.alnum_bits if re.fullmatch("[0-9A-Za-z]+", s) else p.base64_bits
        taken = {k for w in secrets.PLACEHOLDERS for at in range(len(s)) if s[at : at + len(w)].lower() == w for k in range(at, at + len(w))}
        high = []
        for i in range(len(s) - p.window + 1):
            c = Counter(s[i : i + p.window])
            if not taken & set(range(i, i + p.window)) and -sum(n / p.window * math.log2(n / p.window) for n in c.values()) >= bits - 1e-9:
                high.append(i)
        if high:
            extra.append((m.start() + high[0], 3, m.start() + high[-1] + p.window, "entropy"))
    join = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(x))
    return [sum(x[3] == k for x in base) for k, _ in kinds], hashlib.sha256(join(base).encode()).hexdigest(), join(base + extra)


def test_secrets(spark, both):
    got = secrets.scan(documents(spark, both), carry=("doc_id", "text")).collect()
    assert len(got) == len(both)
    for r in got:
        counts, digest, spans = brute_secrets(r["text"] or "")
        assert ([r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"], r["spans"]) == (counts, digest, spans)
    assert any("entropy" in r["spans"] for r in got)
    plan = secrets.scan(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_secrets_of_letters_and_near_placeholders(spark):
    letters, key = "QwZrTyUkOpAsDfGhJmLzXcVb", "Zx9Qw3Er7Ty1Ui5Op2As8Df4"
    rows = [
        (1, f"a {letters} b", "s"),
        (2, f"a {key}0000{key[::-1]} b", "s"),
        (3, "a Zx9Qw3Er7Ty0000Ui5Op2As8Df4 b", "s"),  # each window overlaps the placeholder
        (4, "a internationalizationservice getUserAccountInformation b", "s"),
        (5, f"a {key}xxxxxx b", "s"),
        (6, f"a {letters}Example b", "s"),
        (7, f"a {key}examplexample{key} b", "s"),
        (8, "a some-long-slug-of-words-2024 123e4567-e89b-12d3-a456-426614174000 b", "s"),
    ]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(documents(spark, rows)).collect()}
    assert got == {1: "entropy:2:26", 2: "entropy:2:54", 3: "", 4: "", 5: "entropy:2:26", 6: "entropy:2:26", 7: "entropy:2:63", 8: ""}


def test_secrets_of_many_matches(spark):
    """Work in a text is linear in its matches, and random strings agree with brute force."""
    rng = random.Random(4)
    signs = ["abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFabcdef0123456789+/_=-", "xX0example "]
    rows = [(k, " ".join("".join(rng.choices(rng.choice(signs), k=rng.randrange(1, 60))) + rng.choice(["", "0000", "ExAmple", "token=", "AKIA"]) for _ in range(40)), "s") for k in range(150)]
    for r in secrets.scan(documents(spark, rows), carry=("doc_id", "text")).collect():
        counts, digest, spans = brute_secrets(r["text"])
        assert ([r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"], r["spans"]) == (counts, digest, spans)
    text = " ".join(f"{rng.getrandbits(64):016x}" for _ in range(120_000))
    began = time.monotonic()
    got = secrets.scan(documents(spark, [(1, text, "s")])).first()
    assert got["n_hex"] == 120_000 and time.monotonic() - began < 60


def brute_pii(text):
    out = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = kind == 0 or kind == 1 and all(int(x) <= 255 for x in m.group().split(".")) or kind == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits) or kind == 3 and 9 <= len(digits) <= 15
            if fine:
                out.append((kind, *m.span()))
    return out


def test_pii_base(spark, both):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    got = {}
    rows = pii.spans(documents(spark, both), Scratch(spark, "t")).collect()
    assert len(rows) == len(both)
    for r in rows:
        got[r["doc_id"]] = r
    for i, t, _ in both:
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in brute_pii(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert got[i]["spans"].startswith(listed)


def test_pii_terms(spark):
    fill = [f"w{k}" for k in range(40)]
    rng, rows = random.Random(3), []
    for k in range(60):
        rows.append((k, " ".join(rng.choices(fill, k=30)), "s"))
    for k in range(60, 64):  # the nickname occurs only with the address
        a = " ".join(rng.choices(fill, k=3))
        rows.append((k, f"{a} Zorblax wrote from zo.rb@mail.example.com {a} {k}", "s"))
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in pii.spans(docs, Scratch(spark, "t")).collect()}
    for k in range(60, 64):
        start = rows[k][1].index("Zorblax")
        assert f"remove:{start}:{start + 7}" in got[k]["spans"].split(",")
    assert all(not got[k]["spans"] for k in range(60))
    # Scores by brute force.
    found = pii.find(docs)
    marked = {(r["entity"], r["term"]): r["action"] for r in pii.disclosures(docs, found).collect()}
    term = {}
    for _, t, _ in rows:
        for w in re.findall("[a-z0-9\x80-\U0010ffff]+", t.lower()):
            raw = np.frombuffer(w.encode(), np.uint8)
            term[int(pii._terms(raw, np.array([0, len(raw)]))[3].view(np.int64)[0])] = w
    holds = defaultdict(set)
    for _, t, _ in rows:
        for w in set(re.findall("[a-z0-9\x80-\U0010ffff]+", t.lower())):
            holds[w].add(t)
    near = defaultdict(set)
    for r in found.collect():
        for c in r["contexts"]:
            near[c["entity"], c["term"]].add(r["text_key"])
    for (e, t), texts in near.items():
        score = 1 + math.log2(len(texts) / len(holds[term[t]])) / math.log2(64 / 4)
        want = None if len(texts) < 2 else "remove" if score >= 0.95 else "generalise" if score >= 0.85 else None
        assert marked.get((e, t)) == want, (term[t], score)
    out = pii.redact(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all("Zorblax" not in t and "@" not in t for t in texts.values()) and texts[3] == rows[3][1]


def test_pii_terms_far_away(spark):
    fill = [f"w{k}" for k in range(40)]
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(fill, k=30)), "s") for k in range(60)]
    for k in range(60, 64):  # the name stands far from the address, and near it
        a = " ".join(rng.choices(fill, k=30))
        rows.append((k, f"Zorblax {a} Quuxley {a} zo.rb@mail.example.com Zorblax {a} Zorblax {k}", "s"))
    rows.append((64, "Quuxley far from it", "s"))  # in 4 of 5 documents with the address
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in pii.spans(docs, Scratch(spark, "t")).collect()}
    for k in range(60, 64):
        want = [m.start() for m in re.finditer("Zorblax", rows[k][1])]
        assert len(want) == 3 and all(f"remove:{a}:{a + 7}" in got[k]["spans"].split(",") for a in want)
        assert f"generalise:{rows[k][1].index('Quuxley')}" in got[k]["spans"]
    assert all(not got[k]["spans"] for k in [*range(60), 64])
    texts = [r["text"] for r in pii.redact(docs, Scratch(spark, "t")).where("doc_id between 60 and 63").collect()]
    assert len(texts) == 4 and all("Zorblax" not in t and "Quuxley" not in t for t in texts)


@pytest.fixture(scope="module")
def coder():
    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fresh.encode_special_tokens = True  # their strings in a text are ordinary text
    return fresh


def encoded(coder, text, end):
    return np.array([*coder.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, both, coder):
    rows = sorted(both, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    scratch = Scratch(spark, "t")
    files = token_files.write(documents(spark, both), scratch, token_files.TokenFileParams(shard_tokens=20_000))
    got = sorted(token_files.documents(files, scratch).collect(), key=lambda r: r["start"])
    at = 0
    for r, (i, t, _) in zip(got, rows, strict=True):
        ids = encoded(coder, t, 2)
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_ids_of_odd_texts(coder):
    """Chunks through the encoder give the ids of whole texts, whatever white space stands between them."""
    rng = random.Random(9)
    signs = [" ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u1680", "a", "b", "Z", "'s", "'", ".", "7", "é", "日", "\u0301", "\U0001f600", "<|endoftext|>", "\x7f", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 25))) for _ in range(4000)] + ["<|endoftext|>", "a <|endoftext|> b", "\n", " ", ""]
    for part in (texts, texts[::-1]):  # the second time from the cache, too
        got = [ids for _, ids in tokens.encode_column(pa.array(part), tokens.default_tokenizer(), 2)]
        for t, ids in zip(part, got, strict=True):
            assert ids.tolist() == encoded(coder, t, 2).tolist(), repr(t)


class Counting:
    """A tokenizer that counts the bytes it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, 0

    def encode_batch_fast(self, texts, **more):
        self.given += sum(len(t.encode()) for t in texts)
        return self.inner.encode_batch_fast(texts, **more)


def column_ids(coder, texts):
    (_, _, data, offsets), = kernel.slices(pa.array(texts))
    ids, bounds = coder.encode(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_token_ids_where_kinds_of_signs_meet(coder):
    rng = random.Random(10)
    signs = ["a", "b", "Z", "'", "'s", "'re", "'ll", "'T", "1", "23", ".", ",", "-", "!", " ", " ", "\n", "é", "ß", "À", "ɿ", "×", "÷", "ʰ", "²", "½", "٣", "日", "\u0301", "\xa0", "\u2003", "\x1c", "…"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 30))) for _ in range(4000)]
    fresh = tokens.ChunkEncoder(tokens.default_tokenizer())
    assert fresh.by_kind
    for part in (texts, texts[::-1]):
        for t, ids in zip(part, column_ids(fresh, part), strict=True):
            assert ids == coder.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunks_meet_the_tokenizer_once():
    """A word goes through the library once, whatever sign or line break stands beside it."""
    fresh = tokens.ChunkEncoder(tokens.default_tokenizer())
    fresh.tokenizer = Counting(fresh.tokenizer)
    words = [f"word{'abcdefghij'[k % 10] * (1 + k // 10)}" for k in range(100)]
    column_ids(fresh, [" " + " ".join(words)])
    before = fresh.tokenizer.given
    column_ids(fresh, [" " + " ".join(w + sign for w in words) for sign in ".,;:!?"])
    assert fresh.tokenizer.given - before < 100


def test_a_full_cache_keeps_what_was_met_again(monkeypatch, coder):
    monkeypatch.setattr(tokens, "MOST_CACHED", 2000)
    fresh = tokens.ChunkEncoder(tokens.default_tokenizer())
    fresh.tokenizer = Counting(fresh.tokenizer)
    common = " " + " ".join("common" + "abcdefghij"[k % 10] * (1 + k // 10) for k in range(100))
    rare = 0
    for k in range(40):
        text = common + "".join(f" {x:x}z".translate(str.maketrans("0123456789", "ghijklmnop")) for x in range(500 * k, 500 * k + 500))
        rare += len(text) - len(common)
        assert column_ids(fresh, [text])[0] == coder.encode(text, add_special_tokens=False).ids
        assert len(fresh.main.keys) + len(fresh.recent.keys) <= 2000 + 700
    assert fresh.tokenizer.given - rare < 2 * len(common)


def test_token_files_of_one_id(spark, coder):
    """Rows of one id, or of none, are dealt over the ranges; each keeps its place."""
    rows = [(7 if k % 3 else None, f"text number {k}", "s") for k in range(100_000)]
    scratch = Scratch(spark, "t")
    files = token_files.write(documents(spark, rows).repartition(8), scratch, token_files.TokenFileParams(shard_tokens=50_000))
    per = [r["n"] for r in files.groupBy("partition").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(per) == 8 and max(per) < 2 * min(per)
    got = sorted(token_files.documents(files, scratch).collect(), key=lambda r: r["start"])
    ends = np.cumsum([r["n_tokens"] for r in got])
    assert len(got) == len(rows) and [r["start"] for r in got[1:]] == ends[:-1].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert Counter(r["ids_crc32"] for r in got) == Counter(zlib.crc32(encoded(coder, t, 2).tobytes()) for _, t, _ in rows)


def test_grammar():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), np.zeros(5000, np.uint32), rng.integers(0, 30, 20_000).astype(np.uint32), np.tile(rng.integers(0, 50_000, 97), 60).astype(np.uint32)):
        blob = token_files.compress(ids, 50257)
        assert (token_files.decompress(blob) == ids).all()
        for _ in range(20):
            a = int(rng.integers(0, len(ids) + 1))
            n = int(rng.integers(0, 50))
            assert (token_files.decode_range(blob, a, min(n, len(ids) - a)) == ids[a : a + n]).all()
    assert len(token_files.compress(np.tile(np.arange(64), 200).astype(np.uint32), 50257)) < 4096


def test_packing(spark, both, coder):
    docs = documents(spark, both)
    got = packing.pack(docs).orderBy("doc_id", "sequence_id", "start").collect()
    whole, used = defaultdict(list), defaultdict(list)
    for r in got:
        whole[r["doc_id"]].append(r)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    text = {}
    for i, t, _ in both:
        text[i] = t
    for i, t in text.items():
        ids, copies = encoded(coder, t, 1), sum(x[0] == i for x in both)
        assert sum(r["length"] for r in whole[i]) == copies * len(ids)
        for r in whole[i]:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_packing_balances():
    lengths = np.random.default_rng(1).integers(1, 3000, 400)
    doc, start, length, sequence, offset = packing.plan(lengths, 2048)
    assert (np.bincount(doc, weights=length) == lengths).all() and np.bincount(sequence, weights=length).max() <= 2048
    cost = np.bincount(sequence, weights=length + length.astype(float) ** 2 / 2048)
    full = cost[np.bincount(sequence, weights=length) == 2048]
    assert np.median(full) < 4000 and full.min() >= 2048


def brute_links(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in ids}


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_rows(seed=0, groups=6, copies=25):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    rows, i = [], 0
    passage = rng.choices(vocabulary, k=60)
    for g in range(groups):
        text = rng.choices(vocabulary, k=rng.choice([6, 30, 120, 300]))
        for _ in range(copies):
            w = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                w = w[: -rng.randrange(1, 1 + len(w) // 6)]
            rows.append((i * 7 % 1009, " ".join(w), "s"))
            i += 1
    for _ in range(40):
        rows.append((i * 7 % 1009, " ".join(passage + rng.choices(vocabulary, k=rng.choice([3, 8, 12, 20]))), "s"))
        i += 1
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_near_documents(spark, seed):
    rows = near_rows(seed)
    got = {r["doc_id"]: r for r in near_join.near_components(documents(spark, rows), Scratch(spark, "t")).collect()}
    sets = {i: shingles(t) for i, t, _ in rows}
    want = brute_links(sets)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert 10 < len(set(want.values())) < len(rows)


def test_near_documents_odd(spark, both):
    got = near_join.near_components(documents(spark, both), Scratch(spark, "t")).collect()
    want = brute_links({i: shingles(t) for i, t, _ in both if i is not None})
    assert len(got) == len(both)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
    kept = near_join.keep_one(documents(spark, both), Scratch(spark, "t"))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in want if want[i] == i) and ids.count(None) == 1


def test_quality(spark, small, both):
    rows = quality.assess(documents(spark, both), read(spark, small, "labels"), carry=("doc_id", "text")).collect()
    assert len(rows) == len(both)
    for r in rows:
        text = r["text"] or ""
        w, seen, again = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        c, cover = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(cover))
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_learns(spark, large):
    """Held-out accuracy: labels of odd ids train, those of even ids are asked."""
    docs, labels = read(spark, large, "documents"), read(spark, large, "labels")
    got = quality.assess(docs, labels.where("doc_id % 2 = 1")).join(labels.where("doc_id % 2 = 0"), "doc_id").where("not base_failed").select("kept", "quality").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert len(got) > 1000 and sum(good) / len(good) > 0.98 and sum(bad) / max(1, len(bad)) < 0.35
    one = quality.assess(docs, labels.where("quality = 1")).where("not base_failed").agg(F.min("kept")).first()[0]
    assert one is True


def test_pieces(spark, both):
    starts, insides = pieces.byte_level_vocabulary(tokens.default_tokenizer())
    starts, insides = set(starts), set(insides)
    machine = pieces.Automaton([b"a", b"abc", b"x"], [b"d", b"bc", b"c"])
    assert [machine.length(w) for w in (b"abcd", b"abc", b"ab", b"xbcd", b"q")] == [2, 1, 1, 3, 1]

    def greedy(word):
        n, at = 0, 0
        while at < len(word):
            known = insides if at else starts
            end = next(e for e in range(min(len(word), at + 130), at, -1) if word[at:e] in known)
            n, at = n + 1, end
        return n

    for r in pieces.piece_counts(documents(spark, both)).join(documents(spark, both).select("doc_id", "text"), "doc_id").distinct().collect():
        words = [w.encode() for w in WORD.findall(r["text"] or "")]
        each = [greedy(w) for w in words]
        assert (r["n_words"], r["n_pieces"], r["longest_word_pieces"]) == (len(words), sum(each), max(each, default=0))


def test_piece_counts_are_kept_from_batch_to_batch(monkeypatch):
    """New words, words met again, tables that merge and a cache past its bound give the automaton's own counts."""
    counter = pieces.Counter(tokens.default_tokenizer())
    # As many distinct words as make the recent table join the main one.
    words = [b"w%dq" % k for k in range(100_001)]
    for most, batch, kept in ((200_000, words[:10], (0, 10)), (200_000, words, (100_001, 0)), (200_000, [b"more", *words[:10], b"y" * 99, b"more"], (100_001, 1)), (100_000, words[5:20], (0, 15))):
        monkeypatch.setattr(pieces, "MOST_CACHED", most)
        data = np.frombuffer(b" ".join(batch), np.uint8)
        starts, ends, _ = kernel.runs(~kernel.IS_SPACE[data], np.array([0, len(data)]))
        assert counter.counts(data, starts, ends).tolist() == [counter.automaton.length(w) for w in batch]
        assert (len(counter.main.keys), len(counter.recent.keys)) == kept


def test_licenses(spark, both):
    filler = "lorem ipsum dolor sit amet consectetur " * 20
    mit = licenses.TEMPLATES["mit-grant"]
    near = mit.replace("any person obtaining", "every single person obtaining").replace("furnished to do so", "furnished")
    rows = [(1, "é " + filler + mit + filler, "s"), (2, filler + near, "s"), (3, filler, "s"), (4, None, "s"), (5, "x RELEASED under the mit-license! y", "s"), (5, "x RELEASED under the mit-license! y", "s")]
    got = licenses.scan(documents(spark, rows)).collect()
    by = {(r["doc_id"], r["license"]): r for r in got}
    assert set(by) == {(1, "mit-grant"), (2, "mit-grant"), (5, "mit-line")} and len(got) == 4
    assert by[1, "mit-grant"]["coverage"] == 1.0 and rows[0][1][by[1, "mit-grant"]["start"] : by[1, "mit-grant"]["end"]] == mit[:-1]
    assert 0.85 < by[2, "mit-grant"]["coverage"] < 1
    assert rows[4][1][by[5, "mit-line"]["start"] : by[5, "mit-line"]["end"]] == "RELEASED under the mit-license"
    # Odd rows hold no license; of the small table, those that hold a statement's words in full are all found.
    lines = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("-line")}
    words = lambda s: " ".join(re.findall("[a-z0-9\\x80-\\U0010ffff]+", s.lower()))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(documents(spark, both)).collect()}
    want = {(i, n) for i, t, _ in both for n, line in lines.items() if f" {words(line)} " in f" {words(t or '')} "}
    assert want and want <= got and not {i for i, _ in got} & {i for i, _, _ in ODD}


def test_alignment_against_all_cells():
    """The banded alignment equals one over all cells where the match lies within the band."""

    def whole(text, template):
        cells, best = {}, (0, 0)
        for j, want in enumerate(template):
            for i, have in enumerate(text):
                before = cells.get((i - 1, j - 1), (0, 0))
                ways = [(before[0] + 2, before[1] + 1) if have == want else (before[0] - 1, before[1])]
                ways += [(cells[c][0] - 1, cells[c][1]) for c in ((i - 1, j), (i, j - 1)) if c in cells]
                top = max(ways)
                if top[0] > 0:
                    cells[i, j] = top
                    best = max(best, top)
        return best[1]

    rng = random.Random(3)
    for _ in range(60):
        template = [rng.randrange(40) for _ in range(rng.randrange(4, 40))]
        copy = [x for x in template for x in ([x], [], [x, 99])[rng.choices(range(3), [18, 1, 1])[0]]]
        front = [rng.randrange(50, 90) for _ in range(rng.randrange(20))]
        text = front + copy + [rng.randrange(50, 90) for _ in range(rng.randrange(20))]
        matched, s, e = licenses.align(text, template, len(front), 16)
        assert matched == whole(text, template)
        assert len(front) <= s < e <= len(front) + len(copy) or not matched


def test_licenses_overlapping_repeated_and_long(spark):
    """A license holds its grant; both come out, for each row, also deep in a very long text."""
    mit, filler = licenses.TEMPLATES["mit"], "word soup of no license " * 20_000
    rows = [(1, mit, "s"), (1, mit, "s"), (2, filler + mit + filler, "s"), (3, filler, "s")]
    got = Counter((r["doc_id"], r["license"]) for r in licenses.scan(documents(spark, rows)).collect())
    assert got == {(1, "mit"): 2, (1, "mit-grant"): 2, (2, "mit"): 1, (2, "mit-grant"): 1}
    twice = licenses.LicenseParams(templates={"a": mit, "b": mit})  # equal templates match alike
    found = licenses.scan(documents(spark, rows[:1]), twice).collect()
    assert {r["license"] for r in found} == {"a", "b"} and len({(r["start"], r["end"]) for r in found}) == 1


def test_licenses_close_together(spark):
    lines = [licenses.TEMPLATES[n] for n in ("mit-line", "apache-2.0-line", "cc-by-nc-4.0-line")]
    rows, want = [], {}
    for line in lines:
        for copies in (2, 5):
            for gap in range(12):
                text, at = "intro words ", []
                for _ in range(copies):
                    at.append((len(text), len(text) + len(line) - 1))
                    text += line + " " + "filler " * gap
                want[len(rows)] = at
                rows.append((len(rows), text, "s"))
    part = "Released under the MIT License. Published under the MIT License. Released under the MIT License."
    rows.append((len(rows), part, "s"))
    got = defaultdict(list)
    for r in licenses.scan(documents(spark, rows)).collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["matched"]))
    for k, at in want.items():
        assert sorted(x[:2] for x in got[k]) == at, rows[k][1]
    assert sorted(x[2] for x in got[len(rows) - 1]) == [4, 5, 5]


def test_token_files_pair_until_nothing_is_frequent():
    rng = np.random.default_rng(8)
    for ids in (np.tile(rng.integers(0, 50257, 1000), 1000), rng.integers(0, 60, 50_000), np.zeros(5000, np.int64)):
        ids = ids.astype(np.uint32)
        blob = token_files.compress(ids, 50257)
        _, rules, _, seq = token_files._parts(blob)
        assert (token_files.decompress(blob) == ids).all()
        assert len(rules) == (1 << 16) - 50257 or max(Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)).values(), default=0) < 8
    blob = token_files.compress(np.tile(np.arange(1000, dtype=np.uint32), 1000), 50257)
    _, rules, _, seq = token_files._parts(blob)
    assert len(rules) + len(seq) < 3000


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(200):
        grams = rng.integers(0, 50, rng.integers(1, 30)).astype(np.uint64)
        at = licenses.winnow(grams, 3)
        assert all(any(a <= p < a + 3 for p in at) for a in range(len(grams) - 2)) and len(at)


def brute_vectors(rows):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            unit[k] = x / np.linalg.norm(x)
    links = defaultdict(set)
    for a in unit:
        for b in unit:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a].add(b)
                links[b].add(a)
    return links


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows, i = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0, None] * 8, 1), (1003, [float("nan")] * 16, 1), (1004, [], 1), (1005, [1.0] * 16, None), (1006, [float("inf")] * 16, 0)], 0
    for label in (0, 1):
        for _ in range(12):
            center = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 30))):
                v = center if rng.random() < 0.3 else center + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.15])
                rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1.0, 2.0])], label))
                i += 1
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, Scratch(spark, "t"), vectors.VectorParams(block=16)).collect()}
    odd = spark.createDataFrame([(None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (5, None, 1), (None, None, 1)], "vec_id long, embedding array<float>, label int")
    again = sorted(map(tuple, vectors.near_vectors(odd, Scratch(spark, "t")).collect()), key=str)
    assert again == [(5, 0, 5, True), (5, 1, 5, True), (None, 0, None, True), (None, 1, 5, False)]
    links = brute_vectors(rows)
    assert len(got) == len(rows)
    parent = {k: {k} | links[k] for k in range(len(rows))}
    for k, (vec, _, _) in enumerate(rows):
        assert got[vec]["n_links"] == len(links[k]), (vec, got[vec]["n_links"], len(links[k]))
        seen, todo = {k}, [k]
        while todo:
            for x in parent[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[vec]["component_id"] == min(rows[x][0] for x in seen) and got[vec]["kept"] == (vec == got[vec]["component_id"])


@pytest.mark.parametrize("size", [16, 64, 384, 768])
def test_vector_recall_at_the_threshold(size):
    """Pairs of cosine 0.98, the hardest to find, meet in some table at least 99 times of 100."""
    rng, params, n = np.random.default_rng(size), vectors.VectorParams(), 600
    x = rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=(n, size))
    away -= (away * x).sum(axis=1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * away
    a, b = vectors.codes(x, params), vectors.codes(y, params)
    met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=(1, 2))
    print(size, met.mean())
    assert met.mean() >= 0.99


def test_quality_probability(spark, small, both):
    """The score of each text against one worked out from its words and characters."""
    docs, labels = documents(spark, both), read(spark, small, "labels")
    params = quality.QualityParams()
    model = quality.fit(docs, labels, params)
    got = quality.assess(docs, labels, params, carry=("text",)).collect()
    assert model is not None

    def spans(data, words):
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = kernel.runs(~kernel.IS_SPACE[raw], np.array([0, len(raw)]))
        return kernel.span_hashes(kernel.prefix_sums(raw), starts, ends).tolist()

    bits, mask = params.bits, (1 << 64) - 1
    for r in got:
        text, total = r["text"] or "", 0.0
        hashes = spans(text, WORD.findall(text)) if WORD.search(text) else []
        base = 0x9E3779B97F4A7C15
        mixed = lambda h: int(kernel.mix(np.array([h & mask], np.uint64))[0])
        pairs = [mixed(a * base + b + 2) for a, b in zip(hashes, hashes[1:], strict=False)]
        first, second = (int(x) for x in quality._MULTIPLIERS)
        low = (1 << 32) - 1
        chars = [ord(c) for c in text]
        triples = [(((((a * first & low) ^ b) * second & low) ^ c) * first) & low for a, b, c in zip(chars, chars[1:], chars[2:], strict=False)]
        for group, (found, width) in enumerate(((hashes, 64), (pairs, 64), (triples, 32))):
            if found:
                total += sum(float(model.weights[(h >> (width - bits)) + (group << bits)]) for h in found) / len(found)
        want = 1 / (1 + math.exp(-max(-50, min(50, model.slope * total + model.shift))))
        assert abs(r["quality_probability"] - want) < 1e-6
        assert r["kept"] == (not r["base_failed"] and r["quality_probability"] >= params.min_probability)


def test_mixing_with_clashing_names(spark, both):
    clash = documents(spark, both).selectExpr("doc_id", "text", "source", "1 as rate", "2 as copies", "'x' as target", "3 as source_size")
    want = sorted((r["doc_id"] or 0, r["copies"]) for r in mixing.assign(documents(spark, both).select("doc_id", "text", "source"), Scratch(spark, "t")).collect())
    assert sorted((r["doc_id"] or 0, r["copies"]) for r in mixing.assign(clash, Scratch(spark, "t")).collect()) == want
    assert mixing.mix(clash, Scratch(spark, "t")).columns == clash.columns


def test_empty_tables(spark, small, tmp_path):
    for name in ("documents", "labels", "embeddings"):
        read(spark, small, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_kernel_slices_cover_all():
    import pyarrow as pa

    texts = ["ab c", None, "", "d" * 50, "é é"]
    for limit in (1, 7, 1000):
        seen = []
        for _, _, data, offsets in kernel.slices(pa.chunked_array([texts[:2], texts[2:]], pa.string()), limit):
            seen += [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert seen == [t or "" for t in texts]
