"""Search over files: hits per line, ranking, context, and the filters around them.

A file's lines are an array, so hits, caps and context are found within its row: no shuffle
until a global order. Lines count from 1; columns are 1-based bytes. Every ranking has a
total order. Predicates come before limits, so no row is lost to an early cap.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

PER_FILE_CAP = 100


def lines(files: DataFrame) -> DataFrame:
    """(file_id, path, line, text): one row a line."""
    return files.select("file_id", "path", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("long"))


def line_offsets(files: DataFrame) -> DataFrame:
    """(file_id, line, start_offset, text): byte offset of each line's start."""
    parts = F.split("content", "\n")
    starts = T.running(parts, F.lit(0).cast("long"), lambda at, s: (at + F.octet_length(s) + 1).cast("long"), lambda at, s: at, "bigint")
    zipped = files.select("file_id", parts.alias("text"), starts.alias("start_offset"))
    made = zipped.select("file_id", F.posexplode(F.arrays_zip("text", "start_offset")).alias("line", "x"))
    return made.select("file_id", (F.col("line") + 1).cast("long").alias("line"), F.col("x.start_offset").alias("start_offset"), F.col("x.text").alias("text"))


def hits(files: DataFrame, matches: Callable[[Column], Column], cap: int | None = PER_FILE_CAP) -> DataFrame:
    """(file_id, path, line, text) of matching lines, at most `cap` a file, the first ones."""
    each = F.transform(F.split("content", "\n"), lambda s, i: F.struct((i + 1).cast("long").alias("line"), s.alias("text")))
    found = F.filter(each, lambda x: matches(x["text"]))
    found = F.slice(found, 1, cap) if cap else found
    return files.select("file_id", "path", F.explode(found).alias("h")).select("file_id", "path", "h.line", "h.text")


def literal(pattern: str, ignore_case: bool = False, whole_word: bool = False) -> Callable[[Column], Column]:
    """Predicate of a line that holds the literal; the plain containment comes first, as it is cheap."""

    def test(line: Column) -> Column:
        c, p = (T.fold(line), pattern.translate(str.maketrans(T.UPPER, T.LOWER))) if ignore_case else (line, pattern)
        return c.contains(p) & T.has_word(c, p) if whole_word else c.contains(p)

    return test


_UNPORTABLE = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<|[*+?}]\+|\(\?>|\[\^?\]|\[[^\]]*(?:\[|&&)")


def checked_regex(pattern: str) -> str | None:
    """The pattern if it is in the common subset of Java and RE2, else None (it matches nothing)."""
    if _UNPORTABLE.search(pattern):
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def literal_seed(pattern: str) -> str:
    """The longest literal run of three or more characters that each match must hold, or ''.

    Only literals at the top of the parsed pattern count: what stands in a group, a class, an
    alternative or a repetition ends a run.
    """
    tree = re._parser.parse(pattern)
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ""
    runs = [""]
    for kind, value in tree:
        if kind is re._constants.LITERAL:
            runs[-1] += chr(value)
        else:
            runs.append("")
    return max((r for r in runs if len(r) >= 3), key=len, default="")


def regex(pattern: str) -> Callable[[Column], Column]:
    """Predicate of a line with a match; the literal seed is tested first."""
    good = checked_regex(pattern)

    def test(line: Column) -> Column:
        if good is None:
            return F.lit(False)
        seed = literal_seed(pattern)
        return line.contains(seed) & line.rlike(pattern) if seed else line.rlike(pattern)

    return test


def looks_like_regex(pattern: str) -> bool:
    return bool(re.search(r"\\[A-Za-z]|\.\*|\.\+|\[[^\]]+\]|\(.*\)|[|^$]", pattern))


def scored(found: DataFrame, pattern: str) -> DataFrame:
    return found.withColumn("column", T.byte_column(F.col("text"), pattern).cast("long")).withColumn("score", T.flat_score(F.col("path"), pattern))


def ranked(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy(F.col("score").desc(), "path", "line").limit(limit)


def multi(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Lines with any pattern, one row each: best score, raised by the number of patterns in it."""
    found = hits(files, lambda s: F.exists(F.array(*map(F.lit, patterns)), lambda p: s.contains(p)), None)
    each = F.filter(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(0.5 * T.pattern_complexity(p)).alias("c")) for p in patterns)), lambda x: F.col("text").contains(x["p"]))
    best = T.BASE_SCORE + T.NON_SYMBOL + T.category_boost(T.category(F.col("path"))) + F.array_max(F.transform(each, lambda x: x["c"]))
    more = 1 + F.least(F.lit(0.15) * (F.size(each) - 1), F.lit(0.5))
    return found.select("file_id", "path", "line", F.size(each).cast("long").alias("n_patterns"), F.round(best * more, 6).alias("score"))


def expand_synonyms(query: str, groups: list[list[str]], cap: int = 16) -> list[str]:
    """The query, and it with one word exchanged for a synonym, at most `cap` in all."""
    out = [query]
    for word in re.findall(r"[A-Za-z]{3,}", query):
        for group in groups:
            if word.lower() in group:
                out += [query.replace(word, other) for other in group if other != word.lower()]
    return list(dict.fromkeys(out))[:cap]


def synonym_search(files: DataFrame, query: str, groups: list[list[str]]) -> DataFrame:
    """Lines with the query, or, whatever the case, with it in a synonym's words."""
    first, *rest = expand_synonyms(query, groups)
    tests = [literal(first)] + [literal(p, ignore_case=True) for p in rest]
    return hits(files, lambda s: F.greatest(*(t(s) for t in tests)) if len(tests) > 1 else tests[0](s), None)


def with_context(files: DataFrame, matches: Callable[[Column], Column], before: int, after: int) -> DataFrame:
    """(file_id, path, line, text, is_match): matching lines and those around them, each once."""
    each = F.transform(F.split("content", "\n"), lambda s, i: F.struct((i + 1).alias("line"), s.alias("text"), matches(s).alias("is_match")))
    held = files.select("file_id", "path", each.alias("all"))
    places = F.transform(F.filter("all", lambda x: x["is_match"]), lambda x: x["line"])
    wanted = F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(F.greatest(i - before, F.lit(1)), F.least(i + after, F.size("all"))))))
    picked = held.where(F.size(places) > 0).select("file_id", "path", F.explode(F.transform(wanted, lambda i: F.get(F.col("all"), i - 1))).alias("x"))
    return picked.select("file_id", "path", F.col("x.line").cast("long").alias("line"), "x.text", "x.is_match")


def inverted(files: DataFrame, matches: Callable[[Column], Column]) -> DataFrame:
    """Lines that don't match, of the files that have a line that does."""
    some = files.where(F.exists(F.split("content", "\n"), matches))
    return hits(some, lambda s: ~matches(s), None)


def per_file(files: DataFrame, matches: Callable[[Column], Column]) -> DataFrame:
    """(file_id, path, n): matching lines a file, of files with any."""
    n = F.size(F.filter(F.split("content", "\n"), matches)).cast("long")
    return files.select("file_id", "path", n.alias("n")).where("n > 0")


def by_directory(found: DataFrame, depth: int = 2) -> DataFrame:
    """(directory, files, matches) of hits, by the first parts of the path."""
    return found.groupBy(F.substring_index("path", "/", depth).alias("directory")).agg(F.countDistinct("path").alias("files"), F.count("*").alias("matches"))


def grouped(found: DataFrame) -> DataFrame:
    """One row a file: its lines in order and its best score; documentation last."""
    out = found.groupBy("path").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.max("score").alias("score"), F.count("*").alias("n"))
    return out.withColumn("is_other", T.category(F.col("path")) == "documentation")


def union_first(parts: list[DataFrame]) -> DataFrame:
    """Hits of several searches, for each (path, line) those of the first that has it."""
    every = None
    for k, part in enumerate(parts):
        part = part.withColumn("source_no", F.lit(k))
        every = part if every is None else every.unionByName(part)
    order = Window.partitionBy("path", "line").orderBy("source_no")
    return every.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def is_comment(line: Column) -> Column:
    return F.ltrim(line).rlike("^(//|#|/\\*|\\*|--)")


_QUOTE = {'"', "'", "`"}


def lexical_kind(line: str, start: int) -> str:
    """Whether a place in a line is code, comment or string, by a scan from its start."""
    quote, k = "", 0
    while k < start and k < len(line):
        c = line[k]
        if quote:
            k += c == "\\"
            quote = "" if c == quote else quote
        elif c in _QUOTE:
            quote = c
        elif line.startswith("//", k) or c == "#":
            return "comment"
        elif line.startswith("/*", k):
            end = line.find("*/", k + 2)
            if end < 0 or end >= start:
                return "comment"
            k = end + 1
        k += 1
    return "string" if quote else "code"


def lexical(found: DataFrame, pattern: str) -> DataFrame:
    """Hits with the kind of place where the pattern first stands."""
    @F.pandas_udf("string")
    def kind(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: lexical_kind(s, s.find(pattern)))

    return found.withColumn("kind", kind("text"))


_TOKEN = re.compile(r'(-?)(?:(file|kind|symbol|path|lang):)?("[^"]*"|\S+)')


def parse_query(text: str) -> dict[str, list[str]]:
    """Directives and terms of a query: `file:*.py kind:function symbol:x word -not "a phrase"`."""
    out: dict[str, list[str]] = {"terms": [], "excluded": []}
    for minus, key, value in _TOKEN.findall(text):
        value = value.strip('"')
        if minus:
            out["excluded"].append(value)
        else:
            out.setdefault(key or "terms", []).append(value)
    return out


def run_query(files: DataFrame, text: str, symbols: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Lines for a parsed query: every term, in files that fit a `file:` glob.

    `kind:` and `symbol:` ask for the smallest symbol around the line: its type, and a part of
    its name, whatever the case. What is excluded stands neither in the line nor in the path.
    """
    asked = parse_query(text)
    if globs := asked.get("file", []) + asked.get("path", []):
        base = T.base_name(F.col("path"))
        files = files.where(F.greatest(*(F.col("path").rlike(T.glob_regex(g)) | base.rlike(T.glob_regex(g)) for g in globs), F.lit(False)))
    if langs := asked.get("lang"):
        files = files.where(T.language(F.col("path")).isin(langs))
    excluded = [x.translate(str.maketrans(T.UPPER, T.LOWER)) for x in asked["excluded"]]
    for term in excluded:
        files = files.where(~T.fold(F.col("path")).contains(term))

    def test(s: Column) -> Column:
        out = F.lit(True)
        for term in asked["terms"]:
            out &= s.contains(term)
        for term in excluded:
            out &= ~T.fold(s).contains(term)
        return out

    found = hits(files, test, None)
    kinds, names = ([x.lower() for x in asked.get(k, []) if x] for k in ("kind", "symbol"))
    if not kinds and not names:
        return found
    if symbols is None:
        raise ValueError("kind: and symbol: need the table of symbols")
    from corpusloom.operators.symbols import enclosing

    known = symbols()
    around = enclosing(found.select("file_id", F.col("line").alias("at")).distinct(), known).join(known.select("symbol_id", T.fold(F.col("type")).alias("kind"), T.fold(F.col("name")).alias("symbol")), "symbol_id")
    if kinds:
        around = around.where(F.col("kind").isin(kinds))
    if names:
        around = around.where(F.greatest(*(F.col("symbol").contains(x) for x in names), F.lit(False)))
    return found.join(around.select("file_id", F.col("at").alias("line")).distinct(), ["file_id", "line"], "left_semi")


def in_scopes(files: DataFrame, scopes: list[str]) -> DataFrame:
    """Files under any of the scopes: a prefix of components, or a glob."""
    tests = [F.col("path").rlike(T.glob_regex(s)) if re.search(r"[*?]", s) else (F.col("path") == s) | F.col("path").startswith(s.rstrip("/") + "/") for s in scopes]
    return files.where(F.greatest(*tests, F.lit(False)))


def unmatched_scopes(files: DataFrame, scopes: list[str]) -> DataFrame:
    """(scope) of those under which there is no file: one pass, one row."""
    one = files.agg(*(F.max((F.col("path") == s) | F.col("path").startswith(s.rstrip("/") + "/")).alias(f"s{k}") for k, s in enumerate(scopes)))
    each = F.array(*(F.when(~F.coalesce(F.col(f"s{k}"), F.lit(False)), F.lit(s)) for k, s in enumerate(scopes)))
    return one.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("scope"))


def rank_by(found: DataFrame, strategy: str) -> DataFrame:
    """Hits in the order of a strategy: relevance, recency (mtime) or file type."""
    keys = {
        "relevance": [F.col("score").desc()],
        "recency": [F.col("mtime").desc()] if "mtime" in found.columns else [],
        "file-type": [T.category_boost(T.category(F.col("path"))).desc()],
    }
    return found.orderBy(*keys[strategy], "path", "line")


def find_files(files: DataFrame, query: str, floor: float = 0.2) -> DataFrame:
    """(path, score, kind): the best of exact, file name, name without extension, substring, fuzzy."""
    path, name = F.col("path"), T.base_name(F.col("path"))
    q = query.lower()
    plain, bare = T.fold(name), F.regexp_replace(T.fold(name), r"\.[^.]*$", "")
    at = F.locate(q, T.fold(path)) - 1
    part = F.greatest(F.lit(0.8) - 0.2 * at / F.length(path), F.lit(0.0))
    far = F.levenshtein(bare, F.lit(q)) / F.greatest(F.length(bare), F.lit(len(q)))
    fuzzy = ((1 - far) * 0.85 + 0.05 - 0.08) * 0.7
    found = lambda score, kind: F.struct(score.alias("score"), F.lit(kind).alias("kind"))
    pick = (
        F.when(T.fold(path) == q, found(F.lit(1.0), "exact"))
        .when(plain == q, found(F.lit(0.95), "name"))
        .when(bare == q, found(F.lit(0.93), "stem"))
        .when(at >= 0, found(part, "substring"))
        .when(1 - far >= 0.7, found(fuzzy, "fuzzy"))
        .otherwise(found(F.lit(0.0), "none"))
    )
    out = files.select("path", pick.alias("x")).select("path", F.round("x.score", 6).alias("score"), "x.kind")
    return out.where(F.col("score") >= floor)


def suggestions(names: DataFrame, wanted: str, top: int = 3, floor: float = 0.7) -> DataFrame:
    """Names like the wanted one: substring .9, else by edit distance."""
    a, n = T.fold(F.col("name")), len(wanted)
    score = F.when(a.contains(wanted.lower()) | F.lit(wanted.lower()).contains(a), 0.9).otherwise(1 - F.levenshtein(a, F.lit(wanted.lower())) / F.greatest(F.length(a), F.lit(n)))
    return names.select("name", F.round(score, 6).alias("score")).where(F.col("score") >= floor).distinct().orderBy(F.col("score").desc(), "name").limit(top)
