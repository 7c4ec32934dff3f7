"""Symbols and references: extraction, lookups, interval joins, resolution, listing.

Tables: symbols (symbol_id, file_id, name, type, line, end_line, ...) and references
(ref_id, source_symbol, target_symbol, file_id, line, type, referenced_name). Interval
joins go by (file, band of lines), so a file is not compared with all of itself.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

BAND = 64


def spans_by_band(symbols: DataFrame, band: int = BAND) -> DataFrame:
    """Symbols once for each band of lines that they touch."""
    return symbols.withColumn("band", F.explode(F.sequence(F.floor(F.col("line") / band), F.floor(F.col("end_line") / band))))


def enclosing(points: DataFrame, symbols: DataFrame, rule: str = "smallest", band: int = BAND) -> DataFrame:
    """points (file_id, at) with the symbol around each: the smallest span, or the first by id."""
    s = spans_by_band(symbols, band).select(F.col("file_id").alias("f"), F.col("band").alias("b"), "symbol_id", "name", "line", "end_line")
    p = points.withColumn("b", F.floor(F.col("at") / band))
    joined = p.join(s, (p["file_id"] == s["f"]) & (p["b"] == s["b"]) & F.col("at").between(F.col("line"), F.col("end_line")))
    key = F.struct((F.col("end_line") - F.col("line")).alias("width"), "line", "symbol_id", "name") if rule == "smallest" else F.struct("symbol_id", "name")
    return joined.groupBy("file_id", "at").agg(F.min(key).alias("k")).select("file_id", "at", "k.symbol_id", "k.name")


def last_start(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """As-of probe: for each point the symbol that starts last at or before it, in one sort of both."""
    both = points.select("file_id", F.col("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("symbol_id")).unionAll(symbols.select("file_id", F.col("line").alias("at"), F.lit(0).alias("side"), F.col("symbol_id").cast("long")))
    order = Window.partitionBy("file_id").orderBy("at", "side", "symbol_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("symbol_id", ignorenulls=True).over(order)).where("side = 1").select("file_id", "at", F.col("found").alias("symbol_id"))


def members(symbols: DataFrame, outer: str, inner: str) -> DataFrame:
    """(class_id, n): inner symbols within the span of each outer one, by file and band of their first line."""
    o = spans_by_band(symbols.where(F.col("type") == outer)).select("file_id", "band", F.col("symbol_id").alias("class_id"), F.col("line").alias("a"), F.col("end_line").alias("z"))
    i = symbols.where(F.col("type") == inner).withColumn("band", F.floor(F.col("line") / BAND))
    return i.join(o, ["file_id", "band"]).where("line >= a and end_line <= z").groupBy("class_id").agg(F.count("*").alias("n"))


def resolve(references: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(ref_id, target_symbol): the best candidate of a reference's name.

    `Type.name` means the symbol of that name whose receiver_type is Type; where there is none,
    the name alone counts. A symbol of the same file comes next, then those of the same language
    family (or of an unknown one): if the file imports the name the first, else the first
    exported one, else the first outside tests, else the first. Other families never link.
    """
    dot = F.col("referenced_name").rlike("[.]")
    asked = references.select("ref_id", "file_id", "family", F.substring_index("referenced_name", ".", -1).alias("name"), F.when(dot, F.regexp_replace("referenced_name", "[.][^.]*$", "")).alias("receiver"))
    if imports is not None:
        known = imports.select("file_id", F.col("imported_name").alias("name"), F.lit(True).alias("imported")).distinct()
        asked = asked.join(known, ["file_id", "name"], "left")
    else:
        asked = asked.withColumn("imported", F.lit(None).cast("boolean"))
    receiver = F.col("receiver_type") if "receiver_type" in symbols.columns else F.lit(None).cast("string")
    c = symbols.select("name", "symbol_id", F.col("file_id").alias("target_file"), F.coalesce("family", F.lit("unknown")).alias("target_family"), "is_exported", "is_test", receiver.alias("receiver_type"))
    asked = asked.withColumn("known", F.when(F.coalesce("family", F.lit("unknown")) != "unknown", F.col("family")))

    def best(kind: str, keys: dict[str, str]) -> DataFrame:
        """The first candidate of each key, where the file imports the name and where it doesn't."""
        hidden = ~F.col("is_exported")
        plain = F.struct(hidden.alias("hidden"), (hidden & F.col("is_test")).alias("test"), "symbol_id")
        chosen = c.where(" and ".join(f"{k} is not null" for k in ("name", *keys)))
        named = [F.col(k).alias(v) for k, v in keys.items()]
        return chosen.groupBy("name", *named).agg(F.min("symbol_id").alias(f"{kind}_first"), F.min(plain).alias(f"{kind}_plain"))

    # From the closest kind of candidate to the farthest, each by equal keys: no reference meets all symbols of its name.
    kinds = {
        "typed_near": {"receiver_type": "receiver", "target_file": "file_id"},
        "typed": {"receiver_type": "receiver"},
        "near": {"target_file": "file_id"},
        "family": {"target_family": "known"},
        "every": {},
    }
    for kind, keys in kinds.items():
        asked = asked.join(best(kind, keys), ["name", *keys.values()], "left")
    nobody = best("nobody", {"target_family": "of"}).where("of = 'unknown'").drop("of")
    asked = asked.join(nobody, "name", "left")
    found = {}
    for kind in (*kinds, "nobody"):
        # An imported name makes none hidden, so the first counts.
        imported = F.when(F.col(f"{kind}_first").isNotNull(), F.struct(F.lit(False).alias("hidden"), F.lit(False).alias("test"), F.col(f"{kind}_first").alias("symbol_id")))
        found[kind] = F.when(F.col("imported").isNotNull(), imported).otherwise(F.col(f"{kind}_plain"))
    far = F.when(F.col("known").isNull(), found["every"]).otherwise(F.least(found["family"], found["nobody"]))
    rank = lambda n, k: F.when(k.isNotNull(), F.struct(F.lit(n).alias("rank"), k.alias("k")))
    order = F.coalesce(rank(0, found["typed_near"]), rank(1, found["typed"]), rank(2, found["near"]), rank(3, far))
    return asked.select("ref_id", order.alias("k")).where("k is not null").groupBy("ref_id").agg(F.min("k").alias("k")).select("ref_id", F.col("k.k.symbol_id").alias("target_symbol"))


def reference_stats(references: DataFrame) -> DataFrame:
    """(target_symbol, uses, files, tight): use counts; imports are no uses."""
    uses = references.where(F.col("type") != "import")
    return uses.groupBy("target_symbol").agg(F.count("*").alias("uses"), F.countDistinct("file_id").alias("files"), F.count(F.when(F.col("strength") == "tight", 1)).alias("tight"))


def listing(symbols: DataFrame, where: Column | None = None, order: tuple[str, ...] = ("name", "symbol_id"), offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of symbols in a total order."""
    chosen = symbols if where is None else symbols.where(where)
    return chosen.orderBy(*order).offset(offset).limit(limit)


def has_more(symbols: DataFrame, where: Column, offset: int, limit: int) -> DataFrame:
    return symbols.where(where).agg(F.count("*").alias("total")).select("total", (F.col("total") > offset + limit).alias("has_more"))


def definitions(symbols: DataFrame, file_id: int, line: int, name: str) -> DataFrame:
    """The symbol around a line, those with the exact name first."""
    inside = symbols.where((F.col("file_id") == file_id) & F.lit(line).between(F.col("line"), F.col("end_line")))
    return inside.orderBy((F.col("name") != name), F.col("end_line") - F.col("line"), "symbol_id").limit(1)


# Patterns by language for what begins a symbol; the name is the first group. Bodies end by
# indentation or braces. These are heuristics: strings and comments aren't parsed.
PATTERNS = {
    "go": (("function", r"^func\s+(\w+)\s*\("), ("method", r"^func\s+\([^)]*\)\s*(\w+)\s*\("), ("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("variable", r"^(?:var|const)\s+(\w+)")),
    "rust": (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:]+\s+for\s+)?(\w+)"), ("module", r"^\s*(?:pub\s+)?mod\s+(\w+)")),
    "js_ts": (("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("enum", r"^\s*(?:export\s+)?enum\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("variable", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)")),
    "braces": (("class", r"^\s*(?:[\w@]+\s+)*class\s+(\w+)"), ("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)"), ("interface", r"^\s*(?:\w+\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:\w+\s+)*enum\s+(?:class\s+)?(\w+)"), ("namespace", r"^\s*namespace\s+(\w+)"), ("function", r"^\s*(?:fun|function|def|func)\s+(\w+)\s*\("), ("method", r"^\s*(?!(?:if|for|while|switch|return|else|catch|new|throw)\b)(?:[\w:<>,*&\[\]~@]+\s+)+[*&]*([\w:~]+)\s*\([^;]*$")),
    "ruby": (("method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")),
}
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|elif|except)\b|&&|\|\||\?(?=[^?.:])")
SYMBOL_SCHEMA = "file_id long, name string, type string, line long, end_line long, complexity int, parameter_count int, is_exported boolean, signature string, doc_comment string"
SYMBOL_COLUMNS = [x.split()[0] for x in SYMBOL_SCHEMA.split(", ")]


def _python_symbols(source: str) -> Iterator[tuple]:
    branching = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.comprehension, ast.match_case)

    def visit(node: ast.AST, inside_class: bool) -> Iterator[tuple]:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                cc = 1 + sum(isinstance(y, branching) for y in ast.walk(x)) + sum(len(y.values) - 1 for y in ast.walk(x) if isinstance(y, ast.BoolOp))
                a = x.args
                n = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                yield x.name, "method" if inside_class else "function", x.lineno, x.end_lineno, cc, n, not x.name.startswith("_"), f"def {x.name}({ast.unparse(a)})", ast.get_docstring(x) or ""
                yield from visit(x, False)
            elif isinstance(x, ast.ClassDef):
                yield x.name, "class", x.lineno, x.end_lineno, 1, 0, not x.name.startswith("_"), f"class {x.name}", ast.get_docstring(x) or ""
                yield from visit(x, True)
            elif isinstance(x, ast.Assign) and isinstance(node, ast.Module):
                for t in x.targets:
                    if isinstance(t, ast.Name):
                        yield t.id, "variable", x.lineno, x.end_lineno, 1, 0, not t.id.startswith("_"), t.id, ""
            elif not isinstance(x, ast.expr):
                yield from visit(x, inside_class)

    yield from visit(ast.parse(source), False)


def _block_end(lines: list[str], start: int, braces: bool) -> int:
    if not braces:  # to the `end` or the last deeper line
        indent = len(lines[start]) - len(lines[start].lstrip())
        for k in range(start + 1, len(lines)):
            if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= indent:
                return k if lines[k].strip() == "end" else k - 1
        return len(lines) - 1
    depth, opened = 0, False
    for k in range(start, len(lines)):
        for c in lines[k]:
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
        if opened and depth <= 0:
            return k
        if not opened and (";" in lines[k] or k > start + 5):
            return start
    return len(lines) - 1


def extract(source: str, family: str) -> list[tuple]:
    """Symbols of one file: (name, type, line, end_line, complexity, parameters, exported, signature, doc)."""
    if family == "python":
        try:
            return list(_python_symbols(source))
        except (SyntaxError, ValueError, RecursionError):
            return []
    rules = [(kind, re.compile(p)) for kind, p in PATTERNS.get(family, PATTERNS["braces"])]
    lines, out = source.split("\n"), []
    for k, line in enumerate(lines):
        for kind, pattern in rules:
            if not (m := pattern.match(line)):
                continue
            end = k if kind == "variable" else _block_end(lines, k, family != "ruby")
            body = "\n".join(lines[k : end + 1])
            inner = re.search(r"\(([^()]*)\)", line[m.end(1) :])
            n = len([p for p in inner[1].split(",") if p.strip()]) if inner else 0
            shown = m[1][:1].isupper() if family == "go" else bool(re.search(r"\b(?:pub|export|public)\b", line)) if family in ("rust", "js_ts", "java", "csharp") else True
            doc, j = [], k - 1
            while j >= 0 and re.match(r"\s*(?:///?|#|\*|/\*)", lines[j]):
                doc.insert(0, lines[j].strip().lstrip("/#* "))
                j -= 1
            out.append((m[1], kind, k + 1, end + 1, 1 + len(_BRANCH.findall(body)) if kind in ("function", "method") else 1, n, shown, line.strip().rstrip("{ "), "\n".join(doc)))
            break
    return out


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of all files with a known language."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, *s) for i, fam, text in zip(f["file_id"], f["family"], f["content"], strict=True) for s in extract(text or "", fam)], columns=SYMBOL_COLUMNS)

    known = files.select("file_id", T.family(F.col("path")).alias("family"), "content").where("family <> 'unknown'")
    return known.mapInPandas(run, SYMBOL_SCHEMA)


_CALL = re.compile(r"(?:\b([A-Za-z_]\w*)\.)?\b([A-Za-z_]\w*)\s*\(")
_NO_CALL = {"if", "for", "while", "switch", "return", "func", "fn", "def", "function", "catch", "class", "elif", "match", "print"}


def extract_references(files: DataFrame) -> DataFrame:
    """(file_id, line, receiver, referenced_name, type): calls by a scan of each line, definitions left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, text in zip(f["file_id"], f["content"], strict=True):
                for k, line in enumerate((text or "").split("\n"), 1):
                    if re.match(r"\s*(?://|#|\*)", line):
                        continue
                    for m in _CALL.finditer(line):
                        before = line[: m.start()].rstrip()
                        if m[2] not in _NO_CALL and not re.search(r"\b(?:def|func|fn|function|class)$|^func\s+\([^)]*\)$", before):
                            out.append((i, k, m[1] or "", m[2], "call"))
            yield pd.DataFrame(out, columns=["file_id", "line", "receiver", "referenced_name", "type"])

    return files.select("file_id", "content").mapInPandas(run, "file_id long, line long, receiver string, referenced_name string, type string")


# An import line by language family; the groups are path, then names.
IMPORTS = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import\s+(.+)|import\s+([\w.]+))",
    "js_ts": r"""^\s*(?:import|export)\s+(?:.*?\s+from\s+)?['"]([^'"]+)['"]""",
    "go": r"""^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"$""",
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    "c_family": r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]""",
    "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;",
    "php": r"^\s*(?:use|require_once|require|include)\s+['\"]?([\w\\./]+)",
}


def imports(lines: DataFrame) -> DataFrame:
    """(file_id, line, import_path) by the pattern of each file's family."""
    fam, out = T.family(F.col("path")), F.lit("")
    for name, pattern in IMPORTS.items():
        groups = (1, 3) if name == "python" else (1,)
        found = F.concat(*(F.regexp_extract("text", pattern, g) for g in groups))
        out = F.when(fam == name, found).otherwise(out)
    return lines.select("file_id", "line", out.alias("import_path")).where("import_path <> ''")


def import_links(imported: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, target_file): imports whose path, as folders, ends a file's path without its extension."""
    bare = F.regexp_replace("path", r"\.[^./]+$", "")
    # A file answers to each suffix of its folders, so the join is by equality.
    parts = F.split(bare, "/")
    named = files.select(F.col("file_id").alias("target_file"), "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))).alias("key"))
    asked = imported.select("file_id", "import_path", F.regexp_replace(F.regexp_replace("import_path", r"^(\./|\.\./)+", ""), r"[.:\\]+", "/").alias("key"))
    found = asked.join(named, "key").where("file_id <> target_file")
    return found.groupBy("file_id", "import_path").agg(F.min(F.struct(F.length("path").alias("n"), "path", "target_file")).alias("k")).select("file_id", "import_path", F.col("k.target_file").alias("target_file"))


def annotations(lines: DataFrame) -> DataFrame:
    """(file_id, line, key, values) of `@tool:key[a,b]` or `@tool:key value` marks in comments, whatever the tool."""
    mark = r"@[a-z]+:([a-z-]+)(?:\[([^\]]*)\]|[ \t:]+([^\s@]+))?"
    hit = lines.where(F.col("text").rlike("@[a-z]+:[a-z]"))
    found = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(mark), F.lit(k)).alias(n) for k, n in ((1, "key"), (2, "listed"), (3, "single"))))
    each = hit.select("file_id", "line", F.explode(found).alias("m"))
    return each.select("file_id", "line", "m.key", F.filter(F.split(F.concat("m.listed", "m.single"), r"\s*,\s*"), lambda v: v != "").alias("values"))


def doc_comments(lines: DataFrame) -> DataFrame:
    """(file_id, line, n): runs of comment lines, by the line after them."""
    c = lines.withColumn("is_comment", F.ltrim("text").rlike(r"^(///?|#|\*|/\*)"))
    order = Window.partitionBy("file_id").orderBy("line")
    c = c.withColumn("run", F.sum((~F.col("is_comment")).cast("long")).over(order))
    runs = c.where("is_comment").groupBy("file_id", "run").agg(F.count("*").alias("n"), F.max("line").alias("last"))
    return runs.select("file_id", (F.col("last") + 1).alias("line"), "n")
