"""Similarity and stemming of names: published algorithms as plain functions and pandas UDFs.

Spark has no Jaro-Winkler, insert-delete ratio, token-set ratio or Porter stemmer; each runs
on Arrow batches and, where many rows repeat a pair, should be asked for distinct pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * scale * (1 - jaro)


def common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            row[j], diagonal = (diagonal + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def indel_ratio(a: str, b: str) -> float:
    """1 less the insertions and deletions between two strings, over their length together."""
    return 1.0 if not a and not b else 2 * common_subsequence(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words and these with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 1.0
    base = " ".join(both)
    one, two = (" ".join(filter(None, (base, " ".join(rest)))) for rest in (left, right))
    pairs = [(one, two)] + ([(base, one), (base, two)] if both else [])
    return max(indel_ratio(p, q) for p, q in pairs)


# Fixed values of the English Snowball stemmer (Porter2): words with a stem of their own,
# words that stay, and the suffixes of steps 2 to 4.
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_STAY = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_STAY_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP_2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_VOWEL = "aeiouy"


def _region(word: str, start: int) -> int:
    m = re.compile(f"[{_VOWEL}][^{_VOWEL}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(f"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$", word) or re.fullmatch(f"[{_VOWEL}][^{_VOWEL}]", word))


def porter2(word: str) -> str:
    """Stem of a lower-case English word; words with other characters, or of two letters, stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in _EXCEPTIONS or word in _STAY:
        return _EXCEPTIONS.get(word, word)
    w = word.removeprefix("'")
    w = re.sub(f"(^|[{_VOWEL}])y", lambda m: m[1] + "Y", w)
    special = re.match("gener|commun|arsen", w)
    r1 = special.end() if special else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWEL}]", w[:-2]):
        w = w[:-1]
    if w in _STAY_1A:
        return w
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{_VOWEL}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if re.search(f".[^{_VOWEL}][yY]$", w):
        w = w[:-1] + "i"
    for suffix, instead in _STEP_2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1 and not (suffix == "ogi" and w[-4:-3] != "l") and not (suffix == "li" and w[-3:-2] not in "cdeghkmnrt"):
                w = w[: -len(suffix)] + instead
            break
    for suffix, instead in _STEP_3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= (r2 if suffix == "ative" else r1):
                w = w[: -len(suffix)] + instead
            break
    for suffix in _STEP_4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2 and not (suffix == "ion" and w[-4:-3] not in ("s", "t")):
                w = w[: -len(suffix)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# Abbreviations of programming words.
ABBREVIATIONS = {"auth": "authenticate", "cfg": "config", "ctx": "context", "db": "database", "err": "error", "fn": "function", "idx": "index", "init": "initialize", "msg": "message", "num": "number", "param": "parameter", "pkg": "package", "req": "request", "res": "response", "srv": "server", "str": "string", "tmp": "temporary", "usr": "user", "val": "value"}


_HUMPS = [re.compile(p) for p in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])")]
_BORDERS = re.compile(r"[_\-./ ]+")


def _split(name: str) -> list[str]:
    for pattern in _HUMPS:
        name = pattern.sub(r"\1_\2", name)
    return [p for p in _BORDERS.split(name.lower()) if p]


def _can_reach(a: str, b: str, least: float) -> bool:
    """Whether two strings of such lengths and common start can be as alike, whatever follows."""
    few, many = sorted((len(a), len(b)))
    best = (2 + few / max(many, 1)) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, few))
    return best + prefix * 0.1 * (1 - best) >= least - 1e-9


def scorer(query: str, synonyms: dict[str, int] | None = None) -> Callable[[str], tuple[float, str]]:
    """The best of eight detectors for a name: (score, detector). What the query needs is made once; detectors go from the best down."""
    q, asked, groups = query.lower().strip(), _split(query), synonyms or {}
    words, phrase, stems = set(asked), " ".join(asked), {porter2(a) for a in asked}
    related = {groups[a] for a in asked if groups.get(a) is not None}
    short = {ABBREVIATIONS[a] for a in asked if a in ABBREVIATIONS} | {b for b, a in ABBREVIATIONS.items() if a in words}
    stem = lru_cache(1 << 14)(porter2)

    def score(name: str) -> tuple[float, str]:
        n = name.lower()
        if not q or not n:
            return 0.0, "none"
        if q == n:
            return 1.0, "exact"
        if q in n:
            return 0.9, "substring"
        parts = _split(name)
        if len(asked) > 1 and phrase in " ".join(parts):
            return 0.88, "phrase"
        if _can_reach(q, n, 0.85) and jaro_winkler(q, n) >= 0.85:
            return 0.7, "fuzzy"
        if related and any(groups.get(b) in related for b in parts):
            return 0.6, "synonym"
        if any(stem(b) in stems for b in parts):
            return 0.55, "stem"
        if not words.isdisjoint(parts):
            return 0.4, "split"
        return (0.25, "abbreviation") if not short.isdisjoint(parts) else (0.0, "none")

    return score


def semantic_score(query: str, name: str, synonyms: dict[str, int] | None = None) -> tuple[float, str]:
    """The best of eight detectors for a name: (score, detector)."""
    return scorer(query, synonyms)(name)


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"


def encode_id(number: int) -> str:
    """An object id in base 63: letters, digits and the underscore."""
    out = ""
    while True:
        number, rest = divmod(number, 63)
        out = _DIGITS[rest] + out
        if not number:
            return out


def decode_id(text: str) -> int:
    out = 0
    for c in text:
        out = out * 63 + _DIGITS.index(c)
    return out


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def porter2_udf(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else porter2(w))


def semantic_score_udf(query: str, synonyms: dict[str, int] | None = None):
    @F.pandas_udf("score double, detector string")
    def run(names: pd.Series) -> pd.DataFrame:
        score = scorer(query, synonyms)
        return pd.DataFrame([score(n or "") for n in names], columns=["score", "detector"])

    return run
