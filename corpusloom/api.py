"""One object for a corpus: the tools of the front end as methods that return DataFrames.

    corpus = Corpus.from_folder(spark, "file:///code")
    corpus.search("handler", max=20).show()

Tables are made once, on first use, and kept in the shared folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import context as C
from corpusloom.operators import facts as X
from corpusloom.operators import graph as G
from corpusloom.operators import history as H
from corpusloom.operators import index as I
from corpusloom.operators import metrics as M
from corpusloom.operators import relations as R
from corpusloom.operators import search as S
from corpusloom.operators import symbols as Y
from corpusloom.runtime import Scratch
from corpusloom.sources.files import Config, git_log, scan

#: Tools and what they do, as the front end lists them.
TOOLS = {
    "info": "what tools there are",
    "search": "ranked lines for a pattern or query",
    "get_context": "what surrounds a symbol",
    "find_files": "files by name",
    "list_symbols": "a page of symbols",
    "inspect_symbol": "one symbol with all its parts",
    "browse_file": "the symbols of a file, and their statistics",
    "semantic_annotations": "symbols by label, their own or by propagation",
    "side_effects": "effects of functions, their own and by their calls",
    "code_insight": "health, coupling, structure, vocabulary, graphs",
    "context": "a manifest expanded within a budget",
    "index_stats": "counts of files, lines and symbols",
    "debug_info": "sizes and checks of the tables",
    "git_analysis": "churn, hotspots, collisions, ownership",
}


class Corpus:
    def __init__(self, spark: SparkSession, files: DataFrame, config: Config = Config()):
        """files: file_id, path, content, and mtime if there is one."""
        self.spark, self.config, self.scratch = spark, config, Scratch(spark, "corpus")
        self.files = self.scratch.save(files, "files")

    @classmethod
    def from_folder(cls, spark: SparkSession, root: str, config: Config = Config()) -> Corpus:
        return cls(spark, scan(spark, root, config), config)

    # Tables

    @cached_property
    def lines(self) -> DataFrame:
        return S.lines(self.files)

    @cached_property
    def symbols(self) -> DataFrame:
        made = Y.extract_symbols(self.files).join(self.files.select("file_id", "path"), "file_id")
        out = made.withColumn("symbol_id", F.xxhash64("file_id", "name", "type", "line"))
        return self.scratch.save(out.withColumn("family", T.family(F.col("path"))).withColumn("is_test", T.category(F.col("path")) == "test"), "symbols")

    @cached_property
    def references(self) -> DataFrame:
        """Calls with the symbol they stand in and the one they name."""
        raw = Y.extract_references(self.files).join(self.files.select("file_id", T.family(F.col("path")).alias("family")), "file_id")
        raw = raw.withColumn("ref_id", F.xxhash64("file_id", "line", "receiver", "referenced_name")).dropDuplicates(["ref_id"])
        target = Y.resolve(raw, self.symbols)
        inside = Y.enclosing(raw.select("file_id", F.col("line").alias("at")).distinct(), self.symbols.where("type in ('function', 'method')"))
        source = inside.select("file_id", F.col("at").alias("line"), F.col("symbol_id").alias("source_symbol"))
        out = raw.join(target, "ref_id", "left").join(source, ["file_id", "line"], "left")
        strength = F.when(F.col("target_symbol").isNotNull(), "tight").otherwise("loose")
        return self.scratch.save(out.withColumn("strength", strength), "references")

    @cached_property
    def calls(self) -> DataFrame:
        return self.references.where("source_symbol is not null and target_symbol is not null").select(F.col("source_symbol").alias("src"), F.col("target_symbol").alias("dst")).distinct()

    @cached_property
    def imports(self) -> DataFrame:
        return self.scratch.save(Y.imports(self.lines), "imports")

    @cached_property
    def links(self) -> DataFrame:
        """Calls, inheritance and imports as references of one shape; imports stand in no symbol."""
        columns = ["source_symbol", "target_symbol", "file_id", "type", "referenced_name"]
        types = self.symbols.where("type in ('class', 'struct', 'interface', 'enum', 'trait')")
        named = X.type_relations(self.lines).select("file_id", "type", F.col("super").alias("referenced_name")).distinct().join(self.files.select("file_id", T.family(F.col("path")).alias("family")), "file_id")
        named = named.withColumn("ref_id", F.xxhash64("file_id", "type", "referenced_name"))
        source = types.groupBy("file_id", F.col("name").alias("type")).agg(F.min("symbol_id").alias("source_symbol"))
        above = named.join(source, ["file_id", "type"]).join(Y.resolve(named, types), "ref_id", "left").withColumn("type", F.lit("inheritance"))
        imported = self.imports.select(F.lit(None).cast("long").alias("source_symbol"), F.lit(None).cast("long").alias("target_symbol"), "file_id", F.lit("import").alias("type"), F.col("import_path").alias("referenced_name"))
        return self.scratch.save(self.references.select(columns).unionByName(above.select(columns)).unionByName(imported), "links")

    @cached_property
    def relations(self) -> DataFrame:
        return self.scratch.save(R.relations(self.symbols, self.links, self.calls, self.scratch), "relations")

    @cached_property
    def grams(self) -> DataFrame:
        return self.scratch.save(I.all_trigrams(self.files), "grams")

    @cached_property
    def counted(self) -> DataFrame:
        """Symbols with fan_in and methods, as the metrics ask for them."""
        inward = self.calls.groupBy(F.col("dst").alias("symbol_id")).agg(F.countDistinct("src").alias("fan_in"))
        held = Y.members(self.symbols, "class", "method").select(F.col("class_id").alias("symbol_id"), F.col("n").alias("methods"))
        return self.symbols.join(inward, "symbol_id", "left").join(held, "symbol_id", "left").na.fill(0, ["fan_in", "methods"])

    # Tools

    def info(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(TOOLS.items()), "tool string, description string")

    def search(self, pattern: str, max: int | None = None, regex: bool = False, ignore_case: bool = False, whole_word: bool = False, scopes: list[str] | None = None, languages: list[str] | None = None, kinds: list[str] | None = None, synonyms: bool = False, indexed: bool = False) -> DataFrame:
        """(path, line, column, score, text), best first."""
        wrong = X.check_request({"pattern": pattern, "max": max or 0}, {"pattern": str, "max": int}, ("pattern",))
        if wrong or not pattern:
            raise ValueError("; ".join(wrong) or "the pattern is empty")
        files = self.files
        if scopes:
            files = S.in_scopes(files, scopes)
        if languages:
            files = files.where(T.language(F.col("path")).isin(languages))
        if indexed and not (regex or ignore_case):
            files = I.candidates(self.grams, files, pattern)
        if synonyms and self.config.synonyms:
            found = S.synonym_search(files, pattern, [list(g) for g in self.config.synonyms])
        else:
            # Kinds are chosen before the cap of a file.
            found = S.hits(files, S.regex(pattern) if regex else S.literal(pattern, ignore_case, whole_word), None if kinds else S.PER_FILE_CAP)
        if kinds:
            found = X.hits_in(found, self.symbols, kinds)
        return S.ranked(S.scored(found, pattern), max or self.config.max_results).select("path", "line", "column", "score", "text")

    def query(self, text: str, max: int | None = None) -> DataFrame:
        """Search by query syntax: `file:*.py word -other`."""
        return S.ranked(S.scored(S.run_query(self.files, text, lambda: self.symbols), " ".join(S.parse_query(text)["terms"])), max or self.config.max_results)

    def grep(self, pattern: str, before: int = 0, after: int = 0, invert: bool = False) -> DataFrame:
        test = S.literal(pattern)
        return S.inverted(self.files, test) if invert else S.with_context(self.files, test, before, after)

    def find_files(self, query: str, max: int = 20) -> DataFrame:
        return S.find_files(self.files, query).orderBy(F.col("score").desc(), "path").limit(max)

    def list_symbols(self, kind: str = "all", name: str = "", exported: bool | None = None, min_complexity: int = 0, offset: int = 0, limit: int = 50) -> DataFrame:
        where = F.col("complexity") >= min_complexity
        if kind != "all":
            where &= F.col("type") == kind
        if name:
            where &= T.fold(F.col("name")).contains(name.lower())
        if exported is not None:
            where &= F.col("is_exported") == exported
        return Y.listing(self.symbols, where, ("name", "path", "line"), offset, limit)

    def definition(self, name: str) -> DataFrame:
        return self.symbols.where(F.col("name") == name).orderBy("is_test", F.col("is_exported").desc(), "path", "line").select("path", "line", "type", "signature")

    def usages(self, name: str) -> DataFrame:
        return self.references.where(F.col("referenced_name") == name).join(self.files.select("file_id", "path"), "file_id").orderBy("path", "line").select("path", "line", "strength")

    def tree(self, name: str, depth: int = 5) -> DataFrame:
        """What a function calls, and what these call."""
        seeds = self.symbols.where(F.col("name") == name).select(F.col("symbol_id").alias("node"))
        walked = G.walk(self.calls, seeds, self.scratch, depth)
        return walked.join(self.symbols.select(F.col("symbol_id").alias("node"), "name", "path"), "node").select("root", "depth", "name", "path")

    def get_context(self, name: str, sections: list[str] | None = None, least: float = 0.0) -> DataFrame:
        asked = self.symbols.where(F.col("name") == name).select("symbol_id")
        return C.context(self.symbols, self.calls, sections, least).join(asked, "symbol_id", "left_semi")

    def inspect_symbol(self, name: str) -> DataFrame:
        """The context of the symbols of a name, with their types, ancestors, variables and entry points."""
        asked = self.symbols.where(F.col("name") == name).select("symbol_id")
        return self.get_context(name).unionByName(self.relations.join(asked, "symbol_id", "left_semi"))

    def imported_modules(self, path: str) -> DataFrame:
        """The modules that a file imports."""
        return R.imported_modules(self.links).join(self.files.where(F.col("path") == path).select("file_id"), "file_id", "left_semi").select("module")

    def browse_file(self, path: str) -> DataFrame:
        return self.symbols.where(F.col("path") == path).orderBy("line", "name").select("name", "type", "line", "end_line", "complexity", "is_exported")

    def semantic_annotations(self, label: str, least: float = 0.5) -> DataFrame:
        """Symbols with a label in an annotation right above or within them, or by their calls."""
        marks = Y.annotations(self.lines).where("key in ('labels', 'label')").select("file_id", (F.col("line") + 1).alias("at"), F.explode("values").alias("label"))
        direct = Y.enclosing(marks.select("file_id", "at").distinct(), self.symbols).join(marks, ["file_id", "at"]).select(F.col("symbol_id").alias("node"), "label").distinct()
        spread = G.propagate_labels(self.calls, direct.where(F.col("label") == label).select("node", F.lit(1.0).alias("strength")), self.scratch)
        return C.annotation_query(direct, spread, label, least).join(self.symbols.select(F.col("symbol_id").alias("node"), "name", "path"), "node")

    def side_effects(self) -> DataFrame:
        """(name, path, own, mask, is_pure): effect bits of functions from what they call, and by calls of calls."""
        own = self.references.where("source_symbol is not null").groupBy(F.col("source_symbol").alias("node")).agg(F.bit_or(M.effect_mask(F.col("referenced_name"))).alias("own"))
        functions = self.symbols.where("type in ('function', 'method')").select(F.col("symbol_id").alias("node"), "name", "path").join(own, "node", "left").na.fill(0, ["own"])
        far = G.transitive_effects(self.calls, functions.select("node", F.col("own").alias("mask")), M.PROPAGATED, self.scratch)
        return functions.join(far, "node").select("name", "path", "own", "mask", "confidence", (F.col("mask") == 0).alias("is_pure"))

    def code_insight(self, mode: str = "overview") -> DataFrame:
        package = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
        s = self.symbols.select("symbol_id", package("path").alias("package"))
        edges = self.calls.join(s.select(F.col("symbol_id").alias("src"), F.col("package").alias("src_package")), "src").join(s.select(F.col("symbol_id").alias("dst"), F.col("package").alias("dst_package")), "dst")
        modes = {
            "overview": lambda: C.insight(self.counted, edges),
            "statistics": lambda: M.complexity(self.symbols.where("type in ('function', 'method')")),
            "structure": lambda: M.structure(self.files),
            "modules": lambda: M.modules(self.symbols),
            "coupling": lambda: M.coupling(edges),
            "smells": lambda: M.smells(self.counted),
            "hotspots": lambda: M.hotspots(self.symbols.where("type in ('function', 'method')")),
            "vocabulary": lambda: M.vocabulary(self.symbols),
            "cycles": lambda: G.cycles(self.calls, self.scratch),
            "load-bearing": lambda: X.load_bearing(self.calls, self.scratch),
            "anti-patterns": lambda: X.anti_patterns(self.files),
        }
        if mode not in modes:
            raise ValueError(f"mode must be one of {', '.join(modes)}")
        return modes[mode]()

    def context(self, names: list[str], budget: int = 4000) -> DataFrame:
        entries = self.symbols.where(F.col("name").isin(names)).select(F.col("name").alias("entry"), "symbol_id")
        return C.expand_manifest(entries, self.symbols, self.calls, budget)

    def index_stats(self) -> DataFrame:
        by_language = self.files.groupBy(T.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines"))
        named = self.symbols.groupBy(T.language(F.col("path")).alias("language")).agg(F.count("*").alias("symbols"))
        return by_language.join(named, "language", "left").na.fill(0, ["symbols"])

    def debug_info(self) -> DataFrame:
        """(table, rows) of the tables, and references without a target."""
        parts = [("files", self.files), ("symbols", self.symbols), ("references", self.references), ("unresolved", self.references.where("target_symbol is null")), ("imports", self.imports)]
        out = None
        for name, table in parts:
            one = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
            out = one if out is None else out.unionAll(one)
        return out

    def git_analysis(self, repository: str, report: str = "churn", window: str = "month") -> DataFrame:
        """A report on a repository's log; "now" is its last commit."""
        days = H.window_days(window)
        log = self.scratch.save(H.parse_log(git_log(self.spark, repository, f"{days} days ago")), f"log-{days}")
        changes = H.churn_paths(log.withColumn("ts", F.timestamp_seconds("epoch")))
        now = F.lit(changes.agg(F.max("ts")).first()[0])
        reports = {"churn": lambda: H.churn(changes, days), "hotspots": lambda: H.hotspots(changes, days), "collisions": lambda: H.collisions(changes, now), "ownership": lambda: H.ownership(changes), "active": lambda: H.most_active(changes)}
        return reports[report]()
