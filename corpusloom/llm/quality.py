"""Quality rules: fixed repetition and length rules, then a calibrated linear classifier.

The classifier is a logistic regression on hashed words, word pairs and character triples, fitted on a
bounded sample of labelled rows and scored in Arrow batches. Counts are of the whole text.

Defined results: a null or empty text has no words and fails the length rule. With fewer
than two classes among the labels nothing can be learned and the rules alone decide.
Labels that are null, or other than 0 and 1, are not used; a document labelled more than
once counts once with its lowest label. Repeated document rows each get their own result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernel

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_MULTIPLIERS = np.array([2654435761, 2246822519], np.uint32)
_GROUPS = 3


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_probability: float = 0.5
    #: Bound on the labelled rows that are used for fitting, half of them of each class.
    training_rows: int = 2000
    bits: int = 15
    steps: int = 80
    holdout: int = 5


@dataclass(frozen=True)
class Classifier:
    """weights: words, word pairs, character triples; probability of good = sigmoid(slope * score + shift)."""

    bits: int
    weights: np.ndarray = field(repr=False)
    slope: float = 1.0
    shift: float = 0.0


def ngram_slots(data: np.ndarray, words: np.ndarray, word_of: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature slots of words, word pairs and character triples, each with every document's first one."""
    pairs, pair_of = kernel.windows(words, word_of, 2)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    point_of = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    count = np.maximum(np.diff(point_of) - 2, 0)
    first = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(first[-1]) + np.repeat(point_of[:-1] - first[:-1], count)
    triples = ((points[at] * _MULTIPLIERS[0] ^ points[at + 1]) * _MULTIPLIERS[1] ^ points[at + 2]) * _MULTIPLIERS[0]
    slot = lambda x, group, width: (x >> x.dtype.type(width - bits)).astype(np.int32) + (group << bits)
    return [(slot(words, 0, 64), word_of), (slot(pairs, 1, 64), pair_of), (slot(triples, 2, 32), first)]


def _features(column: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, last, data, offsets in kernel.slices(column):
        starts, ends, word_of = kernel.runs(~kernel.IS_SPACE[data], offsets)
        words = kernel.span_hashes(kernel.prefix_sums(data), starts, ends)
        groups = ngram_slots(data, words, word_of, offsets, bits)
        for k in range(last - first):
            slots, values = [], []
            for found, at in groups:
                seen, times = np.unique(found[at[k] : at[k + 1]], return_counts=True)
                slots.append(seen)
                values.append(times / max(1, at[k + 1] - at[k]))
            yield first + k, np.concatenate(slots), np.concatenate(values).astype(np.float32)


def sample_labels(labels: DataFrame, rows: int) -> DataFrame:
    """At most rows/2 document ids of each class, the same ones at each run."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"))
    ranked = [one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows // 2) for k in (0, 1)]
    return ranked[0].unionByName(ranked[1])


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams) -> Classifier | None:
    """Fit on the bounded sample; None if it holds fewer than two classes."""
    wanted = sample_labels(labels.select("doc_id", "quality"), params.training_rows)
    bits = params.bits

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_features(batch.column(2), bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s for _, s, _ in found], pa.list_(pa.int32())), pa.array([v for _, _, v in found], pa.list_(pa.float32()))],
                names=["doc_id", "label", "slots", "amounts"],
            )

    # The sample has a fixed bound of rows, so it may be broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = chosen.mapInArrow(kernel.tidy(vectors), "doc_id long, label int, slots array<int>, amounts array<float>").toArrow()
    got = got.take(np.argsort(got["doc_id"].to_numpy(), kind="stable"))
    label = got["label"].to_numpy().astype(np.float64)
    if not 0 < label.sum() < len(label):
        return None
    slots = got["slots"].combine_chunks()
    ptr = slots.offsets.to_numpy().astype(np.int64)
    index, amount = slots.flatten().to_numpy(), got["amounts"].combine_chunks().flatten().to_numpy().astype(np.float64)
    rows = np.repeat(np.arange(len(label)), np.diff(ptr))
    held = np.arange(len(label)) % params.holdout == 0
    size = _GROUPS << bits

    # Scale each feature by the root of its mean, as common and rare n-grams differ by decades.
    mean = np.bincount(index, weights=amount, minlength=size) / len(label)
    scale = 1 / np.sqrt(mean + 1e-5)
    x = amount * scale[index]
    share = np.where(label == 1, 0.5 / max(1, label[~held].sum()), 0.5 / max(1, (1 - label[~held]).sum())) * ~held
    w, bias, moment, second, m_bias = np.zeros(size), 0.0, np.zeros(size), np.zeros(size), 0.0
    for step in range(1, params.steps + 1):
        score = np.bincount(rows, weights=x * w[index], minlength=len(label)) + bias
        error = (1 / (1 + np.exp(-score)) - label) * share
        grad = np.bincount(index, weights=x * error[rows], minlength=size) + 1e-6 * w
        moment, second = 0.9 * moment + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        m_bias = 0.9 * m_bias + error.sum()
        bias -= 0.5 * m_bias
    score = np.bincount(rows, weights=x * w[index], minlength=len(label)) + bias
    slope, shift = _platt(score[held], label[held])
    return Classifier(bits, (w * scale).astype(np.float32), slope, shift + slope * bias)


def _platt(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrating sigmoid, by Newton steps with smoothed targets."""
    good, bad = label.sum(), (1 - label).sum()
    if not good or not bad:
        return 1.0, 0.0
    spread = score.std() or 1.0
    z, target = score / spread, np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, q = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(d * z).sum(), d.sum()]))
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3) / spread), float(b)


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts of each document, the word hashes and each document's first word."""
    inside = ~kernel.IS_SPACE[data]
    starts, ends, word_of = kernel.runs(inside, offsets)
    sums = kernel.prefix_sums(data)
    words = kernel.span_hashes(sums, starts, ends)
    n_words = np.diff(word_of)
    chars = kernel.segment_sums(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = kernel.segment_sums(SYMBOLS[data], offsets)

    # Lines run from a document's start or a newline to the next newline or the document's end.
    newline = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate((offsets[:-1], newline + 1)), kind="stable")
    line_ends = np.sort(np.concatenate((offsets[1:], newline)), kind="stable")
    # A newline that ends a document makes one last empty line, which has no word.
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    repeated = _repeats(line_doc, kernel.span_hashes(sums, line_starts, line_ends))[0]
    dup_lines = np.bincount(line_doc[repeated], minlength=len(n_words))

    triples, of = kernel.windows(words, word_of, 3)
    doc = np.repeat(np.arange(len(n_words)), np.diff(of))
    again = _repeats(doc, triples)[1]
    covered = np.zeros(len(words) + 2, dtype=bool)
    at = np.flatnonzero(again) - of[doc[again]] + word_of[doc[again]]
    for k in range(3):
        covered[at + k] = True
    repeat_words = kernel.segment_sums(covered[: len(words)], word_of)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words}, words, word_of


def _repeats(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of items equal to an earlier one of their group, and of items with any equal."""
    salted = kernel.mix(key ^ kernel.mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(salted, kind="stable")
    ranked = salted[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = ranked[1:] == ranked[:-1]
    later, shared = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    later[order] = same
    shared[order] = same | np.concatenate((same[1:], [False]))[: len(key)]
    return later, shared


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_probability double, kept boolean"


def assess(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of each document with the columns of SCHEMA."""
    spark = docs.sparkSession
    kernel.tuned(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, params))  # its size is fixed by `bits`

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_score_slice(data, offsets, model.value, params) for _, _, data, offsets in kernel.slices(batch.column(0))]
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))], names=names)

    kept = docs.select(F.col("text").alias("__text"), *carry)
    fields = [f for f in docs.select(*carry).schema]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), SCHEMA])
    names = [f.name for f in fields] + [part.split()[0] for part in SCHEMA.split(", ")]
    return kept.mapInArrow(kernel.tidy(score), schema)


def _score_slice(data: np.ndarray, offsets: np.ndarray, model: Classifier | None, params: QualityParams) -> list[np.ndarray]:
    counts, words, word_of = rule_counts(data, offsets)
    n = counts["n_words"]
    failed = (n < params.min_words) | (100 * counts["n_repeat_words"] > params.max_repeat_percent * n)
    probability = np.ones(len(n))
    if model is not None:
        score = np.zeros(len(n))
        for slots, at in ngram_slots(data, words, word_of, offsets, model.bits):
            score += kernel.segment_sums(model.weights[slots].astype(np.float64), at) / np.maximum(np.diff(at), 1)
        probability = 1 / (1 + np.exp(-np.clip(model.slope * score + model.shift, -50, 50)))
    return [*(counts[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, probability, ~failed & (probability >= params.min_probability)]


def keep_good(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    plain = kernel.shielded(docs, ("doc_id", "text"))
    return assess(plain, labels, params, tuple(plain.columns)).where("kept").select(plain.columns).toDF(*docs.columns)
