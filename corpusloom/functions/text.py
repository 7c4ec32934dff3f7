"""Scalar text expressions, all built-in Spark functions.

Semantics are bytewise where the data model says so: case folding touches A-Z only, word
characters are [A-Za-z0-9_], columns and offsets count bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Score parts of a match, and boosts by file category.
BASE_SCORE, NON_SYMBOL, WORD_BONUS, LINE_START_BONUS, EXACT_CASE_BONUS = 100.0, -30.0, 50.0, 25.0, 20.0
CATEGORY_BOOST = {"code": 50.0, "test": 40.0, "config": 10.0, "documentation": -20.0, "unknown": 0.0}

# Extensions by language, and each language's family.
LANGUAGES = {
    "go": ("go", ["go"]),
    "python": ("python", ["py", "pyw", "pyi", "pyx", "pxd"]),
    "javascript": ("js_ts", ["js", "jsx", "mjs", "cjs"]),
    "typescript": ("js_ts", ["ts", "tsx", "mts", "cts"]),
    "rust": ("rust", ["rs"]),
    "c": ("c_family", ["c"]),
    "cpp": ("c_family", ["cpp", "cc", "cxx", "h", "hpp", "hh", "hxx", "h++"]),
    "java": ("java", ["java"]),
    "csharp": ("csharp", ["cs"]),
    "php": ("php", ["php", "phtml"]),
    "kotlin": ("kotlin", ["kt", "kts"]),
    "zig": ("zig", ["zig"]),
    "ruby": ("ruby", ["rb"]),
    "swift": ("unknown", ["swift"]),
    "scala": ("unknown", ["scala", "sc"]),
}
# Source extensions without a language of their own (cu is C-like).
OTHER_CODE = ["cu", "lua", "pl", "pm", "r", "jl", "ex", "exs", "erl", "hrl", "hs", "clj", "cljs", "elm", "vue", "svelte", "nim", "v", "d", "m", "mm"]
DOC_EXTENSIONS = ["md", "markdown", "rst", "txt", "adoc", "asciidoc", "org"]
CONFIG_EXTENSIONS = ["json", "yaml", "yml", "toml", "ini", "cfg", "conf", "xml", "env", "properties", "kdl"]
# Load priority by extension.
PRIORITIES = {10: ["go", "rs", "py", "js", "ts"], 8: ["java", "cpp", "c", "h"], 5: ["md", "txt", "yaml", "yml", "json"]}

CODE_EXTENSIONS = [e for _, exts in LANGUAGES.values() for e in exts] + OTHER_CODE


#: Items of an array that a running value goes over at once.
_RUN = 256


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """out(state, value) for each item of an array, the state going on by step(state, value); linear in the array.

    Appending to an array copies it, so items are appended within runs, and runs to the result.
    """
    first = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  binds c once

    def run(state: Column, part: Column) -> Column:
        start = F.struct(state.alias("s"), F.array().cast(f"array<{kind}>").alias("o"))
        return F.aggregate(part, start, lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.concat(acc["o"], F.array(out(acc["s"], x))).alias("o")))

    def whole(held: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / _RUN).cast("int")), lambda b: F.slice(held, b * _RUN + 1, _RUN))
        start = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o"))
        joined = F.aggregate(parts, start, lambda acc, part: first(run(acc["s"], part), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o"))))
        return F.when(F.size(held) > 0, F.flatten(joined["o"])).otherwise(F.array().cast(f"array<{kind}>"))

    return first(values, whole)


def fold(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Without the dot, folded; empty if the last part has none."""
    base = base_name(path)
    return F.when(base.contains("."), fold(F.substring_index(base, ".", -1))).otherwise("")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def top_directory(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def priority(path: Column) -> Column:
    ext = extension(path)
    out = F.lit(1)
    for value, exts in PRIORITIES.items():
        out = F.when(ext.isin(exts), value).otherwise(out)
    return out


def language(path: Column) -> Column:
    ext, out = extension(path), F.lit("unknown")
    for name, (_, exts) in LANGUAGES.items():
        out = F.when(ext.isin(exts), name).otherwise(out)
    return out


def family(path: Column) -> Column:
    ext, out = extension(path), F.lit("unknown")
    for fam, exts in LANGUAGES.values():
        if fam != "unknown":
            out = F.when(ext.isin(exts), fam).otherwise(out)
    return F.when(ext == "cu", "c_family").otherwise(out)


def category(path: Column) -> Column:
    base, ext = fold(base_name(path)), extension(path)
    test = base.contains("_test.") | base.contains(".test.") | base.contains(".spec.") | base.startswith("test_")
    return F.when(test, "test").when(ext.isin(CODE_EXTENSIONS), "code").when(ext.isin(DOC_EXTENSIONS), "documentation").when(ext.isin(CONFIG_EXTENSIONS), "config").otherwise("unknown")


def category_boost(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, value in CATEGORY_BOOST.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def pattern_complexity(pattern: str) -> int:
    humps = len(re.findall("(?<=[a-z])[A-Z]", pattern))
    return len(pattern.encode()) + 2 * humps + len(re.findall("[_0-9]", pattern))


def flat_score(path: Column, pattern: str) -> Column:
    """Score of a match: base, category, no symbol, half the pattern's complexity."""
    return BASE_SCORE + category_boost(category(path)) + NON_SYMBOL + 0.5 * pattern_complexity(pattern)


def byte_column(line: Column, needle: str) -> Column:
    """1-based byte place of the first occurrence; 0 if there is none."""
    at = F.locate(needle, line)
    return F.when(at > 0, F.octet_length(F.substring(line, F.lit(1), at - 1)) + 1).otherwise(0)


def quoted(literal: str) -> str:
    """The literal as a pattern that Java and RE2 read alike."""
    return re.sub(r"([^A-Za-z0-9_ ])", lambda m: "\\" + m[1] if ord(m[1]) < 128 else m[1], literal)


def has_word(line: Column, word: str) -> Column:
    """The literal with no word character on either side, by a portable pattern."""
    return line.rlike(f"(^|[^A-Za-z0-9_]){quoted(word)}($|[^A-Za-z0-9_])")


def match_quality(line: Column, needle: str) -> Column:
    """Quality of the first hit, ASCII case ignored: whole word, start of the line, exact case."""
    at = F.locate(needle.translate(str.maketrans(UPPER, LOWER)), fold(line))
    n = len(needle)
    edge = lambda c: (c == "") | ~c.rlike("^[A-Za-z0-9_]$")
    before, after = F.when(at > 1, F.substring(line, at - 1, F.lit(1))).otherwise(""), F.substring(line, at + n, F.lit(1))
    word = F.when(edge(before) & edge(after), WORD_BONUS).otherwise(0.0)
    lead = F.length(line) - F.length(F.regexp_replace(line, "^[ \t]+", ""))
    start = F.when(at == lead + 1, LINE_START_BONUS).otherwise(0.0)
    exact = F.when(F.substring(line, at, F.lit(n)) == needle, EXACT_CASE_BONUS).otherwise(0.0)
    return F.when(at > 0, BASE_SCORE + word + start + exact).otherwise(0.0)


def split_identifier(name: Column) -> Column:
    """Lower-case parts at separators, camel humps, acronym ends, and letter-digit borders."""
    x = F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")
    x = F.regexp_replace(x, "([A-Z])([A-Z][a-z])", "$1_$2")
    x = F.regexp_replace(x, "([A-Za-z])([0-9])", "$1_$2")
    x = F.regexp_replace(x, "([0-9])([A-Za-z])", "$1_$2")
    return F.filter(F.split(fold(x), r"[_\-./ ]+"), lambda p: p != "")


def case_style(name: Column) -> Column:
    return (
        F.when(name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), "snake")
        .when(name.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), "screaming_snake")
        .when(name.rlike("^[a-z][a-z0-9]*(-[a-z0-9]+)+$"), "kebab")
        .when(name.rlike("^[A-Z][A-Za-z0-9]*$") & name.rlike("[a-z]"), "pascal")
        .when(name.rlike("^[a-z][A-Za-z0-9]*$") & name.rlike("[A-Z]"), "camel")
        .when(name.rlike("^[a-z][a-z0-9]*$"), "lower")
        .otherwise("other")
    )


# Suffixes of the simple stemmer with what replaces them, tried in this order.
SIMPLE_SUFFIXES = (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""))


def simple_stem(word: Column) -> Column:
    """The word without its first fitting suffix, if at least three letters stay."""
    out = word
    for suffix, instead in reversed(SIMPLE_SUFFIXES):
        fits = word.endswith(suffix) & (F.length(word) - len(suffix) >= 3)
        out = F.when(fits, F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(instead))).otherwise(out)
    return out


def nesting_depth(text: Column) -> Column:
    """Deepest nesting of braces, less the outermost; never below zero."""
    marks = F.split(F.regexp_replace(text, "[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "{", 1).when((c == "}") & (acc["now"] > 0), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.greatest(F.aggregate(marks, start, step, lambda a: a["most"]) - 1, F.lit(0))


def cyclomatic(text: Column) -> Column:
    """1 + branches: keywords, ternaries and boolean operators."""
    words = F.regexp_count(text, F.lit(r"\b(if|elif|for|while|case|catch|except)\b"))
    marks = F.regexp_count(text, F.lit(r"(&&|\|\||\?[^?.:])"))
    return (F.lit(1) + words + marks).cast("int")


def glob_regex(glob: str, star_crosses: bool = False) -> str:
    """Anchored pattern of a glob: ** crosses /, * and ? don't unless told; **/ starts at a component."""
    out, k = "^", 0
    inner = "." if star_crosses else "[^/]"
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out, k = out + (f"{inner}*" if c == "*" else inner if c == "?" else re.escape(c) if not c.isalnum() and ord(c) < 128 else c), k + 1
    return out + "$"
