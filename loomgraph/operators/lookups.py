"""Lookups of facts by key. Keys come as a table, so that any number of them is one join; a single key is a table of one row.

Each gives the fact rows themselves, all columns kept; a key that is asked twice gives its rows once, a null key none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_by(facts: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The facts whose ``column`` is one of the keys (the first column of ``keys``)."""
    asked = keys.select(F.col(keys.columns[0]).alias("_asked")).distinct()
    return facts.join(asked, facts[column] == F.col("_asked"), "left_semi")


def symbols_by_id(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    return rows_by(symbols, "id", ids)


def symbols_in_file(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return rows_by(symbols, "file", files)


def symbols_by_name(symbols: DataFrame, names: DataFrame) -> DataFrame:
    return rows_by(symbols, "name", names)


def symbols_in_scope(symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """Symbols declared directly in a scope."""
    return rows_by(symbols, "scope_id", scopes)


def references_to(references: DataFrame, ids: DataFrame) -> DataFrame:
    return rows_by(references, "symbol_id", ids)


def references_in_file(references: DataFrame, scopes: DataFrame, files: DataFrame) -> DataFrame:
    """References whose scope lies in a file."""
    inside = rows_by(scopes, "file", files).select(F.col("id").alias("scope_id")).distinct()
    return references.join(inside, "scope_id", "left_semi")


def scopes_by_id(scopes: DataFrame, ids: DataFrame) -> DataFrame:
    return rows_by(scopes, "id", ids)


def scopes_in_file(scopes: DataFrame, files: DataFrame) -> DataFrame:
    return rows_by(scopes, "file", files)


def bindings_in_file(bindings: DataFrame, files: DataFrame) -> DataFrame:
    return rows_by(bindings, "file", files)


def binding_of_symbol(bindings: DataFrame, ids: DataFrame) -> DataFrame:
    return rows_by(bindings, "local_symbol_id", ids)


def exports_of_file(exports: DataFrame, files: DataFrame) -> DataFrame:
    return rows_by(exports, "file", files)


def export_locations(exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """``file, exported_name``: where the exported symbols are declared; exports of unknown symbols are left out."""
    return exports.select("exported_name", F.col("symbol_id").alias("id")).join(symbols.select("id", "file"), "id").select("file", "exported_name").distinct()


def exporters_of_name(exports: DataFrame, names: DataFrame) -> DataFrame:
    """``exported_name, file, symbol_id``: one export a name and file, of several the last by symbol."""
    return rows_by(exports, "exported_name", names).groupBy("exported_name", "file").agg(F.max("symbol_id").alias("symbol_id"))


def resolve_imports(asked: DataFrame, bindings: DataFrame) -> DataFrame:
    """``file, spec, name, export_id`` of asked imports: the first binding (by start) of the specifier that is the default one for the name
    ``default`` or imports the name; namespaces never do. Without one ``export_id`` is null."""
    b = bindings.filter(~F.col("is_namespace")).select(
        "file", "spec", F.when(F.col("is_default"), F.lit("default")).otherwise(F.col("imported_name")).alias("name"), "export_id", "start", "local_symbol_id"
    )
    first = b.groupBy("file", "spec", "name").agg(F.min_by(F.struct("export_id"), F.struct("start", "local_symbol_id")).alias("b"))
    return asked.select("file", "spec", "name").distinct().join(first, ["file", "spec", "name"], "left").select("file", "spec", "name", F.col("b.export_id").alias("export_id"))


def type_relations(relations: DataFrame, ids: DataFrame, every: bool = False) -> DataFrame:
    """Relations of types by their child: declared ones, or all."""
    found = rows_by(relations, "symbol_id", ids)
    return found if every else found.filter(F.coalesce("confidence", F.lit("declared")) == "declared")


def shapes_of(shapes: DataFrame, owners: DataFrame) -> DataFrame:
    return rows_by(shapes, "owner", owners)


def flows_of(flows: DataFrame, ids: DataFrame, side: str = "symbol_id") -> DataFrame:
    """Flows by the flowing symbol, or by another ``side`` such as the receiver or file."""
    return rows_by(flows, side, ids)


def graphs_of(cfgs: DataFrame, scopes: DataFrame) -> DataFrame:
    return rows_by(cfgs, "scope_id", scopes)


def relations_of_kind(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """The fact table of a relation kind."""
    if kind not in tables:
        raise KeyError(kind)
    return tables[kind]


def flow_owners(flows: DataFrame, scopes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``flow_id, owner``: the smallest function or method whose range holds the scope of each flow ``flow_id, scope_id``."""
    s = scopes.select(F.col("id").alias("scope_id"), "file", F.col("range.start").alias("a"), F.col("range.end").alias("b"))
    f = symbols.filter(F.col("kind").isin("function", "method")).select(F.col("id").alias("owner"), F.col("file").alias("f"), F.col("range.start").alias("start"), F.col("range.end").alias("end"))
    hit = flows.select("flow_id", "scope_id").join(s, "scope_id").join(f, (F.col("file") == F.col("f")) & (F.col("start") <= F.col("a")) & (F.col("b") <= F.col("end")))
    return hit.groupBy("flow_id").agg(F.min_by("owner", F.struct(F.col("end") - F.col("start"), "start", "owner")).alias("owner"))


def importing_files(bindings: DataFrame, canonical: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, file``: the files with a binding whose export has the same canonical id (``id, canonical``; itself without one) as each asked symbol."""
    end = lambda df, c: df.join(canonical.select(F.col("id").alias(c), "canonical"), c, "left").withColumn("end", F.coalesce("canonical", c)).drop("canonical")
    b = end(bindings.filter(F.col("export_id").isNotNull()).select("file", "export_id"), "export_id").select("file", "end").distinct()
    return end(ids.select("id").distinct(), "id").join(b, "end").select("id", "file").distinct()
