"""Personal data: pattern spans, and terms that reveal them by co-occurrence.

Patterns give the base spans. Each distinct value is a protected entity e. Any term of the
documents that hold it may reveal it: with document counts over the whole corpus, the
pointwise mutual information of t and e as a part of the information of e is

    disclosure = 1 + log2(n(t, e) / n(t)) / log2(N / n(e)),

1 if every document with t has e. Terms at or over `remove_at` are removed, at or over
`generalise_at` generalised to their class, wherever they occur in the documents that hold
e. A pair counts only if at least `support` different texts have it, so only entities of
that many texts are paired; each text is paired once, with the number of its copies.

n(t) is counted over all documents for terms of such pairs. A bitmap of fixed size tells
tasks which terms may be asked for; an exact join follows.

Defined results: a null or empty text has no spans. Copies count as documents, but are one
text for the support. Rows that repeat id and text get the same spans; an entity that all
documents hold has no information and reveals nothing. Spans are listed by kind (the base
kinds, then generalise and remove), then start. Offsets count code points, ends are
exclusive. Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernel
from corpusloom.runtime import Scratch

KINDS = ("email", "ip", "card", "phone")
_BYTES = np.arange(256)
IS_TERM = (_BYTES >= 128) | np.isin(_BYTES, [ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
IS_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)

# The patterns as asked for, in forms that take linear time: an address is found from its
# sign, and runs of digits are not entered in the middle after they failed from their start.
_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@dataclass(frozen=True)
class PiiParams:
    support: int = 2
    remove_at: float = 0.95
    generalise_at: float = 0.85
    bitmap_bits: int = 24


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and text[start - 1] in _LOCAL_CHAR:
            start -= 1
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            yield start, domain.end()
        # What failed can't be part of a later address: signs end a local part.
        done = domain.end() if domain else sign + 1
        sign = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(n := p.lstrip("0") or "0") <= 3 and int(n) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def _entity(kind: int, value: str) -> int:
    value = value.lower() if kind == 0 else value if kind == 1 else _digits(value)
    return int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


_TERM = "array<struct<term:long,start:int,end:int,free:boolean>>"
FOUND = f"n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, entities array<long>, terms {_TERM}"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lowered = kernel.LOWER[data]
    starts, ends, first = kernel.runs(IS_TERM[lowered], offsets)
    return starts, ends, first, kernel.span_hashes(kernel.prefix_sums(lowered), starts, ends)


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key) and FOUND of each row: base spans, their entities, and all terms of a text with spans.

    Terms that touch a span are not free: they count, but are not marked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, parts = [], [], []
            for first, last, data, offsets in kernel.slices(batch.column(2)):
                asked = kernel.segment_sums(IS_DIGIT[data] | (data == 64), offsets) > 0
                terms = None
                for k in range(last - first):
                    spans, entities, size = [], [], 0
                    if asked[k]:
                        text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                        spans = base_spans(text)
                    if spans:
                        if terms is None:
                            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                            terms = _terms(data, offsets)
                        a, b, of, keys = (x[terms[2][k] : terms[2][k + 1]] if i != 2 else None for i, x in enumerate(terms))
                        a, b, size = points[a] - points[offsets[k]], points[b] - points[offsets[k]], len(keys)
                        free = np.ones(size, dtype=bool)
                        for _, s, e in spans:
                            free[np.searchsorted(b, s, "right") : np.searchsorted(a, e, "left")] = False
                        parts.append((keys.view(np.int64), a.astype(np.int32), b.astype(np.int32), free))
                        entities = sorted({_entity(i, text[s:e]) for i, s, e in spans})
                    sizes.append(size)
                    listed = ",".join(f"{KINDS[i]}:{s}:{e}" for i, s, e in spans)
                    count = [sum(x[0] == i for x in spans) for i in range(4)]
                    rows.append((*count, hashlib.sha256(listed.encode()).hexdigest(), listed, entities))
            if rows:
                made = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), shape, strict=True)]
                fields = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)] if parts else [pa.array([], f.type) for f in inner]
                terms = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.StructArray.from_arrays(fields, fields=inner))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, terms], names=["doc_id", "text_key", *(f.name for f in shape), "terms"])

    inner = [pa.field("term", pa.int64()), pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("free", pa.bool_())]
    shape = [pa.field(f"n_{k}", pa.int64()) for k in KINDS] + [pa.field("base_sha256", pa.string()), pa.field("base", pa.string()), pa.field("entities", pa.list_(pa.int64()))]
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(kernel.tidy(run), "doc_id long, text_key long, " + FOUND)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key), FOUND, and `contexts`: each entity with each free term of its text."""
    free = F.filter("terms", lambda t: t["free"])
    pair = lambda e, t: F.struct(e.alias("entity"), t["term"].alias("term"), t["start"].alias("start"), t["end"].alias("end"))
    return _found(docs).withColumn("contexts", F.flatten(F.transform("entities", lambda e: F.transform(free, lambda t: pair(e, t)))))


def _term_counts(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(term, n_t): documents with each wanted term, and some others."""
    table = kernel.bitmap(wanted.select(F.shiftrightunsigned("term", 64 - bits).alias("s")), bits)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums for the task; they are merged, and sent on if still many, at a fixed size.
        bitmap, parts, size = held.value, [], 0
        for batch in batches:
            for _, _, data, offsets in kernel.slices(batch.column(0)):
                _, _, first, keys = _terms(data, offsets)
                where = np.flatnonzero(kernel.in_bitmap(bitmap, keys >> np.uint64(64 - bits)))
                doc = np.searchsorted(first, where, "right") - 1
                order = np.lexsort((doc, keys[where]))
                term, doc = keys[where][order], doc[order]
                new = np.ones(len(term), dtype=bool)
                new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
                parts.append(np.unique(term[new], return_counts=True))
                size += len(parts[-1][0])
                if size > 1 << 20:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], names=["term", "n"])
                        parts, size = [], 0
        if parts:
            term, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

    return docs.select("text").mapInArrow(kernel.tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def _holders(found: DataFrame) -> DataFrame:
    """(entity, text_key, copies): the texts that hold each entity."""
    return found.select("text_key", F.explode("entities").alias("entity")).groupBy("entity", "text_key").agg(F.count("*").alias("copies"))


def _asked(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(text_key, asked, copies) of texts that hold some of the entities: which ones."""
    return _holders(found).join(entities.select("entity").distinct(), "entity", "left_semi").groupBy("text_key").agg(F.collect_list("entity").alias("asked"), F.max("copies").alias("copies"))


def disclosures(docs: DataFrame, found: DataFrame, params: PiiParams = PiiParams(), scratch: Scratch | None = None) -> DataFrame:
    """(entity, term, action) for the pairs at or over a threshold."""
    total = found.count()
    holders = _holders(found).groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")).where((F.col("texts") >= params.support) & (F.col("n_e") < total)).drop("texts")
    held = found.where(F.size("entities") > 0).select("text_key", F.array_distinct(F.transform("terms", lambda t: t["term"])).alias("held"))
    within = held.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("n_within"))
    texts = held.join(_asked(found, holders), "text_key").groupBy("text_key").agg(F.first("held").alias("held"), F.first("asked").alias("asked"), F.first("copies").alias("copies"))
    each = texts.select("copies", "held", F.explode("asked").alias("entity")).select("copies", "entity", F.explode("held").alias("term"))
    pairs = each.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("texts")).where(F.col("texts") >= params.support)
    # n_t is at least what the texts with spans hold: pairs that this alone puts under the threshold need no count.
    most = F.col("n_te") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1 - params.generalise_at)) * (1 + 1e-9)
    pairs = pairs.join(holders, "entity").join(within, "term").where(F.col("n_within") <= most).drop("texts", "n_within")
    pairs = scratch.save(pairs, "pairs") if scratch else pairs
    counts = _term_counts(docs, pairs.select("term").distinct(), params.bitmap_bits)
    known = pairs.join(counts, "term")
    score = 1 + F.log2(F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0))) / F.log2(F.lit(float(total)) / F.col("n_e"))
    return known.where(score >= params.generalise_at).select("entity", "term", F.when(score >= params.remove_at, "remove").otherwise("generalise").alias("action"))


def spans(docs: DataFrame, scratch: Scratch, params: PiiParams = PiiParams()) -> DataFrame:
    """(doc_id, text_key), counts, base_sha256, n_terms and spans of each row."""
    kernel.tuned(docs.sparkSession)
    found = scratch.save(_found(docs), "found")
    marked = scratch.save(disclosures(docs, found, params, scratch), "disclosures")
    free = found.where(F.size("entities") > 0).select("doc_id", "text_key", F.filter("terms", lambda t: t["free"]).alias("free"))
    held = free.join(_asked(found, marked), "text_key").select("doc_id", "text_key", "free", F.explode("asked").alias("entity"))
    near = held.select("doc_id", "text_key", "entity", F.explode("free").alias("t")).select("doc_id", "text_key", "entity", "t.term", "t.start", "t.end")
    each = near.join(marked, ["entity", "term"]).groupBy("doc_id", "text_key", "start", "end").agg(F.max("action").alias("action"))
    text = F.concat_ws(":", "action", F.col("start").cast("string"), F.col("end").cast("string"))
    added = each.groupBy("doc_id", "text_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("action", "start", text.alias("t")))), lambda x: x["t"]), ",").alias("added"), F.count("*").alias("n_terms"))
    added = added.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), "added", "n_terms")
    both = found.join(added, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__k")), "left")
    listed = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "added")
    return both.select("doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base_sha256", F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"), listed.alias("spans"))


#: The classes that terms are generalised to, the narrowest first that fits.
_CLASSES = (
    ("YEAR", re.compile(r"(?:19|20)[0-9]{2}")),
    ("NUMBER", re.compile(r"[0-9]+")),
    ("CODE", re.compile(r"(?=.*[0-9]).+")),
    ("ACRONYM", re.compile(r"[A-Z]{2,6}")),
    ("NAME", re.compile(r"[A-Z].*")),
    ("WORD", re.compile(r".*")),
)


def _class(term: str) -> str:
    return next(name for name, form in _CLASSES if form.fullmatch(term) or name == "NAME" and term[:1].isupper() or name == "WORD")


def _cover(text: str, listed: str) -> str:
    """The text with each span replaced by its kind; spans that touch are replaced as one."""
    if not listed:
        return text
    parts = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in listed.split(",")))
    merged = []
    for s, e, k in parts:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    out, at = [], 0
    for s, e, k in merged:
        term = text[s:e]
        kind = _class(term) if k == "generalise" else "REMOVED" if k == "remove" else k.upper()
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, scratch: Scratch, params: PiiParams = PiiParams()) -> DataFrame:
    """docs, its texts sanitised; other columns and null texts stay as they are."""
    found = spans(docs, scratch, params).where("spans <> ''").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.col("spans").alias("__spans"))
    once = scratch.save(found.groupBy("__d", "__k").agg(F.min("__spans").alias("__spans")), "asked")
    # Texts that can't be asked for don't move: a bitmap of fixed size parts them from the rest.
    plain, bits = kernel.shielded(docs, ("doc_id", "text")), 23
    rest, asked = kernel.parted(plain, F.pmod(F.xxhash64("text"), F.lit(1 << bits)), once.select(F.pmod("__k", F.lit(1 << bits)).alias("s")), bits)
    # Written first: where the join is a broadcast, a task would else hold two Python workers.
    asked = scratch.save(asked, "open")
    joined = asked.join(once, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__k")), "left").drop("__d", "__k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, last = batch.schema.get_field_index("text"), batch.num_columns - 1
            asked = batch.column(last)
            if asked.null_count < len(asked):
                texts = [t if s is None else _cover(t, s) for t, s in zip(batch.column(at).to_pylist(), asked.to_pylist(), strict=True)]
                batch = batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))
            yield batch.select(list(range(last)))

    return joined.mapInArrow(kernel.tidy(run), plain.schema).unionAll(rest).toDF(*docs.columns)
