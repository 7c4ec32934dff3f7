"""Health, coupling, modules, layers, vocabulary and index statistics over symbol tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Thresholds of the health analysis.
LOW, HIGH = 10, 20
HOT_LINES, RISK_MAX = 50, 10.0
LONG_FUNCTION, LONG_SEVERE, COMPLEX, COMPLEX_SEVERE, GOD_CLASS, GOD_SEVERE, FAN_IN, FAN_IN_SEVERE = 50, 100, 10, 20, 15, 25, 10, 20


def _count(when: Column) -> Column:
    return F.count(F.when(when, 1))


def complexity(functions: DataFrame) -> DataFrame:
    """One row: average, median, real percentiles, the derived p75 and p90, and the histogram."""
    cc = F.greatest("complexity", F.lit(1))
    return functions.agg(
        F.round(F.avg(cc), 6).alias("average"),
        F.median(cc).alias("median"),
        F.expr("percentile_cont(0.75) within group (order by greatest(complexity, 1))").alias("p75"),
        F.expr("percentile_cont(0.9) within group (order by greatest(complexity, 1))").alias("p90"),
        F.round(F.avg(cc) * 1.2, 6).alias("derived_p75"),
        F.round(F.avg(cc) * 1.5, 6).alias("derived_p90"),
        _count(cc <= LOW).alias("low"),
        _count((cc > LOW) & (cc <= HIGH)).alias("medium"),
        _count(cc > HIGH).alias("high"),
    )


def health(functions: DataFrame) -> DataFrame:
    """(score, maintainability): 0 to 10 from the shares of complex functions, and 100 less twice the average."""
    c = complexity(functions)
    total = F.greatest(F.col("low") + F.col("medium") + F.col("high"), F.lit(1))
    share = lambda k: F.col(k) / total
    over = F.when(F.col("average") > LOW, F.least((F.col("average") - LOW) * 0.15, F.lit(3.0))).otherwise(0.0)
    bonus = F.when(share("low") > 0.8, 1.0).when(share("low") > 0.6, 0.5).otherwise(0.0)
    score = F.lit(10.0) - 4.0 * share("high") - 1.5 * share("medium") - over + bonus
    return c.select(F.round(F.greatest(F.least(score, F.lit(RISK_MAX)), F.lit(0.0)), 6).alias("score"), F.round(F.greatest(F.lit(0.0), 100 - 2 * F.col("average")), 6).alias("maintainability"))


def risk(cc: Column, lines: Column) -> Column:
    return F.round(F.least(0.7 * cc + 0.03 * lines, F.lit(RISK_MAX)), 6)


def hotspots(functions: DataFrame) -> DataFrame:
    """Functions over a threshold of complexity or length, by falling risk."""
    cc, n = F.greatest("complexity", F.lit(1)), F.greatest(F.col("end_line") - F.col("line"), F.lit(1))
    out = functions.select("symbol_id", "name", cc.alias("complexity"), n.alias("lines"), risk(cc, n).alias("risk"))
    return out.where((F.col("complexity") > LOW) | (F.col("lines") > HOT_LINES)).orderBy(F.col("risk").desc(), "symbol_id")


def smells(functions: DataFrame) -> DataFrame:
    """(symbol_id, smell, value, severity): a row for each smell of a symbol."""
    n = F.col("end_line") - F.col("line")
    rule = lambda name, value, at, severe: F.when(value > at, F.struct(F.lit(name).alias("smell"), value.cast("long").alias("value"), F.when(value > severe, "high").otherwise("medium").alias("severity")))
    found = F.array(
        rule("long-function", n, LONG_FUNCTION, LONG_SEVERE),
        rule("high-complexity", F.col("complexity"), COMPLEX, COMPLEX_SEVERE),
        rule("god-class", F.col("methods"), GOD_CLASS, GOD_SEVERE),
        rule("high-fan-in", F.col("fan_in"), FAN_IN, FAN_IN_SEVERE),
    )
    return functions.select("symbol_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s")).select("symbol_id", "s.*")


def problematic(functions: DataFrame, top: int = 5) -> DataFrame:
    """(symbol_id, risk, tags) of the riskiest symbols at 5 or more."""
    n = F.col("end_line") - F.col("line")
    tags = F.filter(F.array(F.when(F.col("complexity") > COMPLEX, "complex"), F.when(n > LONG_FUNCTION, "long"), F.when(F.col("fan_in") > FAN_IN, "central")), lambda x: x.isNotNull())
    out = functions.select("symbol_id", risk(F.col("complexity"), n).alias("risk"), tags.alias("tags"))
    return out.where("risk >= 5").orderBy(F.col("risk").desc(), "symbol_id").limit(top)


# Debt is complexity or uses above these; files count with more such symbols than the third.
DEBT_COMPLEXITY, DEBT_USES, DEBT_FILE = 15, 10, 5
# Working time by the share of symbols with debt.
REMEDIATION = ((0.05, "1 day"), (0.10, "1 week"), (0.20, "2 weeks"), (0.30, "1 month"))


def _indebted() -> Column:
    return (F.col("complexity") > DEBT_COMPLEXITY) | (F.col("fan_in") > DEBT_USES)


def debt(symbols: DataFrame) -> DataFrame:
    """(symbols, indebted, ratio, remediation) of all symbols: the share with debt, and the time it takes."""
    out = symbols.agg(F.count("*").alias("symbols"), _count(_indebted()).alias("indebted"))
    time = F.lit("3+ months")
    for share, name in reversed(REMEDIATION):
        time = F.when(F.col("indebted") < share * F.greatest("symbols", F.lit(1)), name).otherwise(time)
    return out.select("symbols", "indebted", F.round(F.col("indebted") / F.greatest("symbols", F.lit(1)), 6).alias("ratio"), time.alias("remediation"))


def debt_components(symbols: DataFrame, top: int = 5) -> DataFrame:
    """(file_id, issues) of the files with the most symbols with debt."""
    out = symbols.where(_indebted()).groupBy("file_id").agg(F.count("*").alias("issues")).where(F.col("issues") > DEBT_FILE)
    return out.orderBy(F.col("issues").desc(), "file_id").limit(top)


def coupling(edges: DataFrame) -> DataFrame:
    """(package, afferent, efferent, instability) of edges (src_package, dst_package) between packages."""
    cross = edges.where("src_package <> dst_package").select("src_package", "dst_package").distinct()
    out = cross.groupBy(F.col("src_package").alias("package")).agg(F.count("*").alias("efferent"))
    into = cross.groupBy(F.col("dst_package").alias("package")).agg(F.count("*").alias("afferent"))
    every = edges.select(F.col("src_package").alias("package")).unionAll(edges.select("dst_package")).distinct()
    both = every.join(into, "package", "left").join(out, "package", "left").select("package", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("afferent", "efferent")))
    total = F.col("afferent") + F.col("efferent")
    return both.withColumn("instability", F.round(F.when(total > 0, F.col("efferent") / total).otherwise(0.0), 6))


def cohesion(edges: DataFrame) -> DataFrame:
    """(package, inside, total, cohesion): the share of a package's edges that stay within it."""
    out = edges.groupBy(F.col("src_package").alias("package")).agg(_count(F.col("src_package") == F.col("dst_package")).alias("inside"), F.count("*").alias("total"))
    return out.withColumn("cohesion", F.round(F.col("inside") / F.col("total"), 6))


def dependency_matrix(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_package", "dst_package").agg(F.count("*").alias("n"))


def modules(symbols: DataFrame, depth: int = 2) -> DataFrame:
    """(module, files, functions, cohesion, stability): prefix groups of names within folders."""
    named = symbols.select(F.substring_index("path", "/", depth).alias("module"), "path", F.get(T.split_identifier(F.col("name")), F.lit(0)).alias("prefix"))
    groups = named.groupBy("module", "prefix").agg(F.count("*").alias("n"))
    most = groups.groupBy("module").agg(F.max("n").alias("most"), F.sum("n").alias("functions"))
    files = named.groupBy("module").agg(F.countDistinct("path").alias("files"))
    return most.join(files, "module").select("module", "files", "functions", F.round(F.col("most") / F.col("functions"), 6).alias("cohesion"), F.round(1 / (1 + F.col("functions") / 10), 6).alias("stability"))


# Layers by words in a symbol's name; what classes and functions say comes first.
CLASS_LAYERS = (("Application Layer", "service|manager"), ("Domain Layer", "model|entity"), ("Data Layer", "repository|dao"), ("Presentation Layer", "component|view"))
FUNCTION_LAYERS = (("Presentation Layer", "render"), ("Data Layer", "save|load"), ("Domain Layer", "validate|compute"))
LAYERS = (
    ("Presentation Layer", "component|view|page|screen|ui|widget|button|input|modal|dialog|layout|template|render|display"),
    ("Application Layer", "service|manager|facade|application|app|controller|handler|command|interactor|usecase"),
    ("Domain Layer", "domain|model|entity|aggregate|valueobject|business|logic|rule|constraint|validation"),
    ("Data Layer", "repository|dao|dataaccess|persistence|storage|database|sql|mapper|orm"),
    ("Infrastructure Layer", "config|adapter|driver|client|http|https|api|logger|log|metric|cache|queue|message"),
    ("Utility Layer", "util|helper|tool|common|shared|core|base"),
)
# The layers that calls should go down; the others have no place among them.
LAYERS_DOWN = ("Presentation Layer", "Application Layer", "Domain Layer", "Data Layer")


def layer(name: Column, kind: Column) -> Column:
    out, low = F.lit("Utility Layer"), T.fold(name)
    for label, words in reversed(LAYERS):
        out = F.when(low.rlike(words), label).otherwise(out)
    for kinds, rules in ((("function", "method"), FUNCTION_LAYERS), (("class", "struct", "interface"), CLASS_LAYERS)):
        for label, words in reversed(rules):
            out = F.when(kind.isin(*kinds) & low.rlike(words), label).otherwise(out)
    return out


def layer_violations(edges: DataFrame, top: int = 8) -> DataFrame:
    """(src_layer, dst_layer, n): calls from a lower layer up to a higher one."""
    depth = lambda c: F.array_position(F.array(*map(F.lit, LAYERS_DOWN)), F.col(c))
    up = edges.where((depth("src_layer") > depth("dst_layer")) & (depth("dst_layer") > 0))
    return up.groupBy("src_layer", "dst_layer").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "src_layer", "dst_layer").limit(top)


def domain_terms(names: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """(domain, terms, n, confidence): words of names by domain; confidence grows with the log of the count."""
    dim = names.sparkSession.createDataFrame([(d, w) for d, ws in domains.items() for w in ws], "domain string, word string")
    words = names.select(F.explode(T.split_identifier(F.col("name"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    out = words.join(dim, "word").groupBy("domain").agg(F.count("*").alias("terms"), F.sum("n").alias("n"))
    return out.withColumn("confidence", F.round(F.least(F.lit(1.0), F.log10(F.col("n") + 1) / 3), 6))


def vocabulary(names: DataFrame) -> DataFrame:
    """(word, n, holders): how often words occur in names, and in how many of them."""
    # Each distinct name is split once, and its words carry how often it comes.
    once = names.groupBy("name").agg(F.count("*").alias("times"))
    words = once.select("times", T.split_identifier(F.col("name")).alias("words"))
    each = words.select("times", "words", F.posexplode("words").alias("at", "word"))
    first = F.array_position("words", F.col("word")) == F.col("at") + 1
    return each.select("word", "times", first.cast("long").alias("first")).groupBy("word").agg(F.sum("times").alias("n"), F.sum("first").alias("holders"))


def unknown_words(names: DataFrame, known: list[str], least: int = 2, top: int = 15) -> DataFrame:
    dim = names.sparkSession.createDataFrame([(w,) for w in known], "word string")
    return vocabulary(names).join(dim, "word", "left_anti").where(F.col("holders") >= least).orderBy(F.col("n").desc(), "word").limit(top)


def importance(symbols: DataFrame, top: int) -> DataFrame:
    """(symbol_id, score): uses, raised for exports, entry points, handlers and complexity."""
    score = F.col("fan_in").cast("double") * F.when(F.col("is_exported"), 1.5).otherwise(1.0) * F.when(F.col("name").isin("main", "Main"), 2.0).otherwise(1.0)
    score = score * F.when(T.fold(F.col("name")).rlike("handler|controller|service"), 1.3).otherwise(1.0) * (1 + F.greatest("complexity", F.lit(0)) / 20)
    return symbols.select("symbol_id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "symbol_id").limit(top)


def structure(files: DataFrame) -> DataFrame:
    """(extension, category, files, depth): files by extension, with the deepest path."""
    return files.groupBy(T.extension(F.col("path")).alias("extension"), T.category(F.col("path")).alias("category")).agg(F.count("*").alias("files"), F.max(F.size(F.split("path", "/")) - 1).cast("long").alias("depth"))


def within_budget(rows: DataFrame, cost: str, budget: int, group: list[str], *order) -> DataFrame:
    """Rows while the running cost stays within the budget, per group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def token_estimate(text: Column) -> Column:
    """About four bytes a token."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def purity_summary(effects: DataFrame) -> DataFrame:
    pure = F.col("mask") == 0
    return effects.agg(F.count("*").alias("functions"), _count(pure).alias("pure"), F.round(_count(pure) / F.greatest(F.count("*"), F.lit(1)), 6).alias("ratio"))


# Effect bits.
EFFECTS = {
    "param-write": 1 << 0, "receiver-write": 1 << 1, "global-write": 1 << 2, "closure-write": 1 << 3, "field-write": 1 << 4, "io": 1 << 5, "database": 1 << 6, "network": 1 << 7,
    "throw": 1 << 8, "channel": 1 << 9, "async": 1 << 10, "external-call": 1 << 11, "dynamic-call": 1 << 12, "reflection": 1 << 13, "uncertain": 1 << 14, "indirect-write": 1 << 15,
}
# The effects that a caller has from what it calls.
PROPAGATED = sum(EFFECTS[k] for k in ("param-write", "receiver-write", "io", "network", "database", "channel", "throw", "global-write", "uncertain", "external-call", "dynamic-call"))
# Effects by what a callee's name starts with; the first that fits.
EFFECT_NAMES = (
    ("io", "print|fprint|puts|fputs|printf|fprintf|scanf|fscanf|fopen|fread|fwrite|open|close|log|logger"),
    ("network", "send|recv|fetch|dial|listen|accept|connect|request|httpget|httppost"),
    ("database", "query|execute|prepare|transaction|commit|rollback"),
    ("throw", "panic|raise|throw|abort"),
    ("dynamic-call", "eval|exec"),
)


def effect_mask(callee: Column) -> Column:
    """The bit for what a callee's name starts with."""
    out = F.lit(0)
    for kind, words in reversed(EFFECT_NAMES):
        out = F.when(T.fold(callee).rlike(f"^({words})"), EFFECTS[kind]).otherwise(out)
    return out.cast("long")


def breaking_risk(fan_in: Column, fan_out: Column) -> Column:
    most = F.greatest(fan_in, fan_out)
    return F.when(most > 10, "high").when(most > 3, "medium").otherwise("low")


def change_impact(fan_in: Column, fan_out: Column, complexity: Column, name: Column) -> Column:
    """1 to 10: from the symbols that use it and that it uses, its complexity, and whether its name is public."""
    half = lambda c, most: F.least(F.floor(c / 2), F.lit(most))
    score = 1 + half(fan_in, 5) + half(fan_out, 3) + F.when(complexity > 10, 2).otherwise(0) + F.when(name.rlike("^[A-Z]"), 2).otherwise(0)
    return F.least(score, F.lit(10)).cast("int")


def change_findings(changed: DataFrame) -> DataFrame:
    """(symbol_id, finding, severity): complexity, length, nesting, growth and lost purity of changed functions."""
    n = F.col("end_line") - F.col("line")
    growth = F.floor((F.col("complexity") - F.col("old_complexity")) * 100 / F.col("old_complexity"))
    mark = lambda when, name, severe: F.when(when, F.struct(F.lit(name).alias("finding"), F.when(severe, "critical").otherwise("warning").alias("severity")))
    never = F.lit(False)
    found = F.array(
        mark(F.col("complexity") > 10, "high-complexity", F.col("complexity") > 20),
        mark(n > 100, "long-function", n > 200),
        mark(F.col("nesting") > 4, "deep-nesting", F.col("nesting") > 6),
        mark((F.col("old_complexity") > 0) & (F.col("complexity") > F.col("old_complexity")) & (growth >= 50), "complexity-growth", never),
        mark(F.coalesce(F.col("old_pure") & ~F.col("pure"), never), "purity-lost", never),
    )
    made = changed.where(F.col("type").isin("function", "method")).select("symbol_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    return made.select("symbol_id", "f.*")


# Weight of a finding by its kind and severity.
FINDING_WEIGHT = {
    "duplicate": {"critical": 0.15, "warning": 0.08, "info": 0.03},
    "naming": {"critical": 0.10, "warning": 0.05, "info": 0.02},
    "metrics": {"critical": 0.12, "warning": 0.06, "info": 0.02},
}


def change_risk(findings: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(findings, risk), per group or in all, of rows (kind, severity): the sum of weights, at most 1."""
    weight = F.lit(0.0)
    for kind, weights in FINDING_WEIGHT.items():
        for severity, value in weights.items():
            weight = F.when((F.col("kind") == kind) & (F.col("severity") == severity), value).otherwise(weight)
    return findings.groupBy(*(group or [])).agg(F.count("*").alias("findings"), F.round(F.least(F.coalesce(F.sum(weight), F.lit(0.0)), F.lit(1.0)), 6).alias("risk"))


def name_counts(symbols: DataFrame, top: int = 25) -> DataFrame:
    """(label, n): names with how often they occur, those outside tests first."""
    out = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min(F.col("is_test").cast("int")).alias("only_tests"))
    return out.orderBy("only_tests", F.col("n").desc(), "name").limit(top).select(F.concat_ws(" x", "name", F.col("n").cast("string")).alias("label"), "n")
