"""Relations of symbols: type hierarchies, used types, imports, variables, entry points.

Parts have the shape of `context`. Symbols need symbol_id, file_id, name, type, line and
end_line; references need source_symbol, target_symbol, file_id, type and referenced_name.
Null names and references outside any symbol give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators.context import COLUMNS, part
from corpusloom.operators.symbols import BAND, spans_by_band
from corpusloom.runtime import Scratch


def _outgoing(symbols: DataFrame, references: DataFrame, kinds: list[str], sources: list[str] | None = None) -> DataFrame:
    """(symbol_id, referenced_name, target): references of such types that leave symbols of such types."""
    chosen = symbols if sources is None else symbols.where(F.col("type").isin(sources))
    asked = references.where(F.col("type").isin(kinds) & (F.col("referenced_name") != ""))
    named = asked.groupBy(F.col("source_symbol").alias("symbol_id"), "referenced_name").agg(F.min("target_symbol").alias("target"))
    return named.join(chosen.select("symbol_id"), "symbol_id", "left_semi")


def parent_classes(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """What classes and structs inherit from, resolved or not."""
    return part(_outgoing(symbols, references, ["inheritance"], ["class", "struct"]), "parent_class", F.col("referenced_name"), F.col("target"), 0.95)


def implementing_types(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Types that inherit from each interface."""
    inward = references.where("type = 'inheritance'").select("source_symbol", F.col("target_symbol").alias("symbol_id")).distinct()
    inward = inward.join(symbols.where("type = 'interface'").select("symbol_id"), "symbol_id", "left_semi")
    named = inward.join(symbols.select(F.col("symbol_id").alias("source_symbol"), "name", F.col("type").alias("kind")), "source_symbol")
    return part(named, "implementing_type", F.col("name"), F.col("kind"), 0.95)


def interfaces(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Interfaces that classes name among what they inherit from."""
    known = symbols.where("type = 'interface'").select(F.col("symbol_id").alias("target"))
    return part(_outgoing(symbols, references, ["inheritance"], ["class"]).join(known, "target", "left_semi"), "interface", F.col("referenced_name"), F.col("target"))


def inheritance_chain(symbols: DataFrame, references: DataFrame, scratch: Scratch) -> DataFrame:
    """All ancestors of each class with their distance; a class on a cycle isn't its own ancestor."""
    edges = references.where("type = 'inheritance' and source_symbol is not null and target_symbol is not null").select(F.col("source_symbol").alias("src"), F.col("target_symbol").alias("dst"))
    seeds = symbols.where("type = 'class'").select(F.col("symbol_id").alias("node"))
    far = G.walk(edges, seeds, scratch, _no_limit(symbols)).where("depth > 0")
    named = far.join(symbols.select(F.col("symbol_id").alias("node"), "name"), "node")
    return part(named.withColumn("symbol_id", F.col("root")), "ancestor", F.col("name"), F.col("depth"), 0.9)


def used_types(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Types that a symbol declares or assigns, each name once."""
    return part(_outgoing(symbols, references, ["declaration", "assignment"]), "used_type", F.col("referenced_name"), F.col("target"), 0.8)


def imported_modules(references: DataFrame) -> DataFrame:
    """(file_id, module) once each: a file's symbols share these, so they are rows of the file."""
    return references.where("type = 'import' and referenced_name <> ''").select("file_id", F.col("referenced_name").alias("module")).distinct()


def variable_scopes(symbols: DataFrame) -> DataFrame:
    """(symbol_id, scope, owner): global, class, local or parameter, by the smallest symbol around each variable.

    Symbols of a file meet only within a band of lines. A `parameter` is one by its own type;
    packages, modules and namespaces leave a variable global; a constant in a function is none of these.
    """
    variables = symbols.where("type in ('variable', 'constant', 'field', 'parameter')").select("symbol_id", "file_id", F.col("line").alias("at"), "end_line", F.col("type").alias("kind"))
    holders = symbols.where("type in ('class', 'struct', 'function', 'method')")
    around = spans_by_band(holders).select("file_id", "band", F.col("symbol_id").alias("owner"), F.col("type").alias("holder"), F.col("line").alias("a"), F.col("end_line").alias("z"))
    placed = variables.withColumn("band", F.floor(F.col("at") / BAND)).join(around, ["file_id", "band"]).where("a <= at and end_line <= z")
    least = placed.groupBy("symbol_id").agg(F.min(F.struct((F.col("z") - F.col("a")).alias("width"), "owner", "holder")).alias("k")).select("symbol_id", "k.owner", "k.holder")
    in_class, in_function = F.col("holder").isin("class", "struct"), F.col("holder").isin("function", "method")
    scope = (
        F.when(F.col("holder").isNull() & F.col("kind").isin("variable", "constant"), "global")
        .when(in_class & F.col("kind").isin("variable", "field"), "class")
        .when(in_function & (F.col("kind") == "variable"), "local")
        .when(in_function & (F.col("kind") == "parameter"), "parameter")
    )
    return variables.join(least, "symbol_id", "left").select("symbol_id", scope.alias("scope"), "owner").where("scope is not null")


def variables(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Class, local and parameter variables of their owners, and the globals of its file that a symbol names."""
    placed = variable_scopes(symbols).join(symbols.select("symbol_id", "file_id", "name"), "symbol_id")
    own = part(placed.where("scope <> 'global'").withColumn("symbol_id", F.col("owner")), "variable", F.col("name"), F.col("scope"))
    known = placed.where("scope = 'global'").select("file_id", F.col("name").alias("referenced_name")).distinct()
    named = references.join(known, ["file_id", "referenced_name"]).where("source_symbol is not null").select(F.col("source_symbol").alias("symbol_id"), "referenced_name").distinct()
    return own.unionAll(part(named, "variable", F.col("referenced_name"), F.lit("used global")))


# What a name says about the kind of an entry point, the first that fits.
ENTRY_TYPES = (
    ("^_?main$", "main function"),
    ("handler|serve", "HTTP endpoint"),
    ("cmd|command", "CLI command"),
    ("test", "test entry point"),
)


def entry_type(name: Column) -> Column:
    out = F.lit("unknown entry point")
    for pattern, kind in reversed(ENTRY_TYPES):
        out = F.when(F.lower(name).rlike(pattern), kind).otherwise(out)
    return out


def entry_points(symbols: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(symbol_id, name): functions named main, handlers and endpoints, and those in `marked`."""
    named = symbols.where("type in ('function', 'method')").where((F.col("name") == "main") | F.lower("name").rlike("handler|endpoint")).select("symbol_id", "name")
    if marked is None:
        return named
    return named.unionAll(symbols.join(marked.select("symbol_id").distinct(), "symbol_id", "left_semi").select("symbol_id", "name")).distinct()


def reaching_entry_points(symbols: DataFrame, calls: DataFrame, scratch: Scratch, marked: DataFrame | None = None) -> DataFrame:
    """Entry points from whose calls each symbol is reached, at any depth; each reaches itself.

    The frontier of all entry points moves at once, so rounds are the longest shortest path.
    """
    starts = entry_points(symbols, marked)
    far = G.walk(calls, starts.select(F.col("symbol_id").alias("node")), scratch, _no_limit(symbols))
    named = far.join(starts.select(F.col("symbol_id").alias("root"), "name"), "root").withColumn("symbol_id", F.col("node"))
    return part(named, "entry_point", F.col("name"), entry_type(F.col("name")), 0.8)


def _no_limit(symbols: DataFrame) -> int:
    """More rounds than a walk over these symbols can take: it ends when its frontier is empty."""
    return symbols.count() + 1


def relations(symbols: DataFrame, references: DataFrame, calls: DataFrame, scratch: Scratch) -> DataFrame:
    """All parts that a symbol has of its own."""
    parts = [parent_classes(symbols, references), implementing_types(symbols, references), interfaces(symbols, references), inheritance_chain(symbols, references, scratch), used_types(symbols, references), variables(symbols, references), reaching_entry_points(symbols, calls, scratch)]
    every = parts[0]
    for rows in parts[1:]:
        every = every.unionByName(rows)
    return every.select(*COLUMNS)
