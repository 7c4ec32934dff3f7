"""Further facts about code: type relations, loops, anti-patterns, file depth, name hygiene, search variants."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.operators import search as S
from corpusloom.operators import symbols as Y
from corpusloom.runtime import Scratch

# Calls that register something, and thresholds of the anti-patterns.
REGISTRATIONS = r"\.(AddTool|Register|RegisterHandler|AddRoute|Handle|HandleFunc|Post|Get|Put|Delete)\(|router\.|mux\.|app\.Use\(|container\.(Bind\(|Register)"
REGISTRATION_CALLS, ENUM_VALUES, GOD_LINES, SWITCH_CASES, CONFIG_FIELDS, BARREL_SHARE = 10, 10, 1500, 10, 10, 0.5


def anti_patterns(files: DataFrame) -> DataFrame:
    """(file_id, pattern, value): files over a threshold, a row for each pattern."""
    c = F.col("content")
    count = lambda p: F.regexp_count(c, F.lit(p)).cast("long")
    lines = F.size(F.split(c, "\n")).cast("long")
    exports = count(r"(?m)^\s*export\s+(\*|\{).*from")
    rule = lambda name, value, at: F.when(value >= at, F.struct(F.lit(name).alias("pattern"), value.alias("value")))
    found = F.array(
        rule("registration-function", count(REGISTRATIONS), REGISTRATION_CALLS),
        rule("enum-aggregation", count(r"(?m)^\s*[A-Z][A-Za-z0-9_]*\s*(=\s*(iota|[0-9]+)\s*)?,?\s*$"), ENUM_VALUES),
        rule("god-object", lines, GOD_LINES),
        rule("switch-factory", count(r"(?m)^\s*case\b.*:"), SWITCH_CASES),
        rule("config-aggregation", count(r"(?m)^\s*\w*([Cc]onfig|[Oo]ption|[Ss]etting)\w*\s*[:=]"), CONFIG_FIELDS),
        F.when((exports >= 3) & (exports >= BARREL_SHARE * lines), F.struct(F.lit("barrel-file").alias("pattern"), exports.alias("value"))),
    )
    return files.select("file_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select("file_id", "a.*")


# Parts of paths that are no production code.
NOT_PRODUCTION = "test|spec|mock|fixture|\\.git|\\.svn|\\.hg|node_modules|vendor"


def is_production(path: Column) -> Column:
    return ~T.fold(path).rlike(NOT_PRODUCTION)


# What states a type relation, by family: (pattern, kind); groups are type, then super types.
TYPE_RELATIONS = {
    "python": ((r"^\s*class\s+(\w+)\s*\(([^)]*)\)", "extends"),),
    "js_ts": ((r"\bclass\s+(\w+)[^{]*?\bextends\s+([\w.]+)", "extends"), (r"\bclass\s+(\w+)[^{]*?\bimplements\s+([\w.,\s]+)", "implements"), (r"\binterface\s+(\w+)\s+extends\s+([\w.,\s]+)", "extends")),
    "go": ((r"^var\s+_\s+\w+\s*=\s*\(?\*?(\w+)\)?.*//\s*implements\s+(\w+)", "implements"),),
    "java": ((r"\bclass\s+(\w+)[^{]*?\bextends\s+([\w.]+)", "extends"), (r"\bclass\s+(\w+)[^{]*?\bimplements\s+([\w.,\s]+)", "implements")),
    "rust": ((r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)\s+for\s+(\w+)", "implemented-by"),),
}


def type_relations(lines: DataFrame) -> DataFrame:
    """(file_id, line, type, super, kind): a row for each super type that a line names."""
    fam, parts = T.family(F.col("path")), []
    for family, rules in TYPE_RELATIONS.items():
        for pattern, kind in rules:
            hit = lines.where((fam == family) & F.col("text").rlike(pattern))
            a, b = F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2)
            one, many = (b, a) if kind == "implemented-by" else (a, b)
            kind = "implements" if kind == "implemented-by" else kind
            parts.append(hit.select("file_id", "line", one.alias("type"), F.explode(F.split(F.trim(many), r"\s*,\s*")).alias("super"), F.lit(kind).alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("super <> '' and super <> 'object'")


def loops(files: DataFrame) -> DataFrame:
    """(file_id, line, awaits, calls): loops with the awaits and calls in their body, by indentation."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, text in zip(f["file_id"], f["content"], strict=True):
                rows = (text or "").split("\n")
                indents = [len(r) - len(r.lstrip()) if r.strip() else None for r in rows]
                for k, row in enumerate(rows):
                    if not re.match(r"\s*(?:async\s+)?(?:for|while)\b", row):
                        continue
                    awaits = calls = 0
                    for j in range(k + 1, len(rows)):
                        if indents[j] is not None and indents[j] <= indents[k]:
                            break
                        awaits += len(re.findall(r"\bawait\b", rows[j]))
                        calls += len(re.findall(r"\b[A-Za-z_]\w*\s*\(", rows[j]))
                    out.append((i, k + 1, awaits, calls))
            yield pd.DataFrame(out, columns=["file_id", "line", "awaits", "calls"])

    return files.select("file_id", "content").mapInPandas(run, "file_id long, line long, awaits long, calls long")


def hits_in(found: DataFrame, symbols: DataFrame, kinds: list[str]) -> DataFrame:
    """Hits whose smallest enclosing symbol is of one of the kinds; `top-level` are those in none."""
    points = found.select("file_id", F.col("line").alias("at")).distinct()
    around = Y.enclosing(points, symbols).join(symbols.select("symbol_id", F.col("type").alias("kind")), "symbol_id").select("file_id", F.col("at").alias("line"), "kind")
    kind = F.coalesce("kind", F.lit("top-level"))
    return found.join(around, ["file_id", "line"], "left").where(kind.isin(kinds)).drop("kind")


def with_fallback(files: DataFrame, pattern: str) -> DataFrame:
    """Literal hits, and, if the pattern looks like one, hits as a regular expression at 0.7 of the score."""
    exact = S.scored(S.hits(files, S.literal(pattern), None), pattern).select("path", "line", "score")
    if not S.looks_like_regex(pattern):
        return exact
    loose = S.scored(S.hits(files, S.regex(pattern), None), pattern).select("path", "line", (F.col("score") * 0.7).alias("score"))
    return exact.unionByName(loose).groupBy("path", "line").agg(F.max("score").alias("score"))


def growth(new: DataFrame, old: DataFrame) -> DataFrame:
    """(name, path, complexity, old_complexity, status) of symbols added or changed, by name and path."""
    before = old.select("name", "path", F.col("complexity").alias("old_complexity"))
    status = F.when(F.col("old_complexity").isNull(), "added").otherwise("modified")
    out = new.join(before, ["name", "path"], "left").select("name", "path", "complexity", "old_complexity", status.alias("status"))
    return out.where("old_complexity is null or old_complexity <> complexity")


def features(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(community, size, inside, outside, hub): communities with their edges and their best connected node."""
    a, b = member.select(F.col("node").alias("src"), F.col("community").alias("ca")), member.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    named = G.edges_of(edges).where("src <> dst").join(a, "src").join(b, "dst")
    ends = named.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("ca").alias("community"), (F.col("ca") == F.col("cb")).alias("same")), F.struct(F.col("dst").alias("node"), F.col("cb").alias("community"), (F.col("ca") == F.col("cb")).alias("same")))).alias("e")).select("e.*")
    degree = ends.groupBy("community", "node").agg(F.count("*").alias("d"))
    hub = degree.groupBy("community").agg(F.max(F.struct("d", (-F.col("node")).alias("m"))).alias("k")).select("community", (-F.col("k.m")).alias("hub"))
    counts = ends.groupBy("community").agg((F.count(F.when(F.col("same"), 1)) / 2).cast("long").alias("inside"), F.count(F.when(~F.col("same"), 1)).alias("outside"))
    size = member.groupBy("community").agg(F.count("*").alias("size"))
    return size.join(counts, "community").join(hub, "community").select("community", "size", "inside", "outside", "hub")


def load_bearing(edges: DataFrame, scratch: Scratch, top: int = 10) -> DataFrame:
    """(node, callers): the nodes that most others reach."""
    return G.reach(edges, scratch).orderBy(F.col("callers").desc(), "node").limit(top)


def dependency_depth(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, depth): steps of the longest way from a root; nodes on or behind cycles are left out."""
    edges = G.edges_of(edges)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    left, done, turn = scratch.save(edges, "depth-edges"), None, 0
    rest = scratch.save(nodes, "depth-nodes")
    while True:
        free = scratch.save(rest.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("depth", F.lit(turn)), f"depth-{turn}")
        if free.isEmpty():
            break
        done = free if done is None else done.unionAll(free)
        if turn % 16 == 15:
            done = scratch.save(done, f"depth-done-{turn}")
        gone = free.select("node")
        rest = scratch.save(rest.join(gone, "node", "left_anti"), f"depth-n{turn}")
        left = scratch.save(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti"), f"depth-e{turn}")
        turn += 1
    return done if done is not None else nodes.limit(0).withColumn("depth", F.lit(0))


def nesting(files: DataFrame) -> DataFrame:
    return files.select("file_id", T.nesting_depth(F.col("content")).alias("nesting"))


def docstring_lines(lines: DataFrame) -> DataFrame:
    """(file_id, line) within triple-quoted strings: between odd and even marks of a file."""
    from pyspark.sql import Window

    marks = F.regexp_count("text", F.lit('"""'))
    before = F.coalesce(F.sum(marks).over(Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("m", marks).withColumn("b", before).where("b % 2 = 1 or m > 0").select("file_id", "line")


def summary(symbols: DataFrame) -> DataFrame:
    """(symbol_id, summary): one sentence on a symbol."""
    return symbols.select("symbol_id", F.concat_ws(" ", F.when(F.col("is_exported"), "exported"), "type", "name", F.concat(F.lit("of complexity "), F.col("complexity").cast("string")), F.concat(F.lit("used by "), F.col("fan_in").cast("string"))).alias("summary"))


def variable_buckets(variables: DataFrame) -> DataFrame:
    """(scope, n, names): variables by scope: global, class, parameter or local."""
    return variables.groupBy("scope").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def edit_synonyms(synonyms: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(group_id, word): the table with a user's additions and without the removals."""
    return synonyms.unionByName(added).distinct().join(removed, ["group_id", "word"], "left_anti")


def check_request(request: dict, known: dict[str, type], required: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with a request: unknown or missing names, wrong types, values out of range."""
    out = [f"unknown parameter {k}" for k in sorted(set(request) - set(known))] + [f"missing parameter {k}" for k in required if k not in request]
    for k, v in request.items():
        if k in known and not (isinstance(v, known[k]) and not (known[k] is int and isinstance(v, bool))):
            out.append(f"{k} must be {known[k].__name__}")
        elif k in ("max", "limit", "offset", "depth") and isinstance(v, int) and v < 0:
            out.append(f"{k} must not be negative")
    return out
