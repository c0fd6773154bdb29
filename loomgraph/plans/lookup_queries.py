"""Lookups of facts by keys that come from other tables, so each covers whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import lookups, relations, resolve
from loomgraph.plans.fact_queries import _S, _SC, call_edges, scopes, symbols
from loomgraph.sources.tables import load


def files_in(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    return load(spark, sf_dir, "check_contexts").filter(F.col("target_language") == language).select(F.col("file_path").alias("file")).distinct()


def lib_ids(spark, sf_dir, column: str = "id") -> DataFrame:
    return load(spark, sf_dir, "lib_symbols").select(column)


def references(spark, sf_dir) -> DataFrame:
    """Calls as references: ``ref_id, symbol_id``."""
    return call_edges(spark, sf_dir).select(F.col("src").alias("ref_id"), F.col("dst").alias("symbol_id"))


def exports(spark, sf_dir) -> DataFrame:
    """``file, exported_name, symbol_id`` of the exported symbols."""
    return relations.exported(symbols(spark, sf_dir)).filter("name is not null").select("file", F.col("name").alias("exported_name"), F.col("id").alias("symbol_id"))


def bound(spark, sf_dir) -> DataFrame:
    """``local_symbol_id, export_id, file, spec, imported_name, is_default, is_namespace, start``: each binding once."""
    one = load(spark, sf_dir, "import_bindings").groupBy("local_symbol_id").agg(
        F.max("resolved_export_id").alias("export_id"), F.max("module_spec").alias("spec"), F.max("imported_name").alias("imported_name"), F.bool_or("is_default").alias("is_default"), F.bool_or("is_namespace").alias("is_namespace"), F.min("range.start").alias("start")
    )
    return one.join(symbols(spark, sf_dir).select(F.col("id").alias("local_symbol_id"), "file"), "local_symbol_id")


def type_relations(spark, sf_dir) -> DataFrame:
    """A relation from each class to the first import of its file: declared if the class is exported, else structural."""
    s = symbols(spark, sf_dir)
    first = s.filter("binding.binding_kind = 'import'").groupBy("file").agg(F.min_by(F.struct("id", "name"), F.struct("range.start", "id")).alias("t"))
    c = s.filter("kind = 'class'").join(first, "file")
    confidence = F.when(F.col("flags").bitwiseAND(1) != 0, "declared").otherwise("structural")
    return c.select(F.col("id").alias("symbol_id"), F.col("t.name").alias("target_name"), F.col("t.id").alias("target_id"), confidence.alias("confidence"))


def shapes(spark, sf_dir) -> DataFrame:
    """``owner, kind, truncated, members``: the methods of each scope by the first word of their name; scopes with one kind of word count as interfaces."""
    from loomgraph.functions.text import words_of

    kept = relations.latest(load(spark, sf_dir, "symbols").select("id", "ingested_at", "kind", "name", "scope_id"), ["id"], [F.col("ingested_at")])
    m = kept.filter("kind = 'method' and name is not null and scope_id is not null").select(F.col("scope_id").alias("owner"), F.get(words_of(F.col("name")), F.lit(0)).alias("word")).filter("word is not null").distinct()
    member = F.struct(F.col("word").alias("name"), F.lit("method").alias("member_kind"), F.lit(0).alias("param_arity"), F.lit(False).alias("is_optional"), F.lit(False).alias("is_static"))
    by = m.groupBy("owner").agg(F.array_sort(F.collect_list(member)).alias("members"))
    own = F.struct("owner", F.lit("class").alias("kind"))
    both = F.array(own, F.struct(F.concat(F.lit("I"), "owner").alias("owner"), F.lit("interface").alias("kind")))
    return by.select(F.explode(F.when(F.size("members") <= 2, both).otherwise(F.array(own))).alias("o"), "members").select("o.owner", "o.kind", F.lit(False).alias("truncated"), "members")


def flows(spark, sf_dir) -> DataFrame:
    """``flow_id, scope_id, file`` of the parameters, each flowing in its scope."""
    return symbols(spark, sf_dir).filter("kind = 'parameter'").select(F.col("id").alias("flow_id"), "scope_id", "file")


def sub_types(spark, sf_dir) -> DataFrame:
    """Types below the first target by name, declared ones or bound to it."""
    r = type_relations(spark, sf_dir)
    target = r.agg(F.min(F.struct("target_name", "target_id")).alias("t")).first()["t"]
    return resolve.sub_types(r, target["target_name"], target["target_id"], True).select("symbol_id", "target_name")


def imports_resolved(spark, sf_dir) -> DataFrame:
    """Every import asked again by its file, specifier and name."""
    b = bound(spark, sf_dir).filter("spec is not null")
    asked = b.select("file", "spec", F.when(F.col("is_default"), F.lit("default")).otherwise(F.col("imported_name")).alias("name")).filter("name is not null")
    return lookups.resolve_imports(asked, b)


def importing(spark, sf_dir) -> DataFrame:
    """The files that bind each third-party symbol, links of symbols of one name leading to the least of them."""
    lib = load(spark, sf_dir, "lib_symbols").select("id", "name")
    canonical = lib.join(lib.groupBy("name").agg(F.min("id").alias("canonical")), "name").select("id", "canonical")
    return lookups.importing_files(bound(spark, sf_dir), canonical, lib)


QUERIES = {
    "lk_symbols_by_id": lambda s, d: lookups.symbols_by_id(symbols(s, d), load(s, d, "structural_edges").select("to_id")).select("id", "name", "file", "kind"),
    "lk_symbols_in_file": lambda s, d: lookups.symbols_in_file(symbols(s, d), files_in(s, d, "tsx")).select("id", "file", "kind"),
    "lk_symbols_by_name": lambda s, d: lookups.symbols_by_name(symbols(s, d), lib_ids(s, d, "name")).select("id", "name"),
    "lk_symbols_in_scope": lambda s, d: lookups.symbols_in_scope(symbols(s, d), scopes(s, d).filter("kind = 'class'").select("id")).select("id", "scope_id"),
    "lk_references_to": lambda s, d: lookups.references_to(references(s, d), lib_ids(s, d)),
    "lk_references_in_file": lambda s, d: lookups.references_in_file(symbols(s, d).select(F.col("id").alias("ref_id"), "scope_id"), scopes(s, d), files_in(s, d, "python")).select("ref_id"),
    "lk_scopes_by_id": lambda s, d: lookups.scopes_by_id(scopes(s, d), symbols(s, d).filter("kind = 'method'").select("scope_id")).select("id", "kind", "file"),
    "lk_scopes_in_file": lambda s, d: lookups.scopes_in_file(scopes(s, d), files_in(s, d, "javascript")).select("id", "kind", "file"),
    "lk_bindings_in_file": lambda s, d: lookups.bindings_in_file(bound(s, d), files_in(s, d, "python")).select("local_symbol_id", "spec"),
    "lk_binding_of_symbol": lambda s, d: lookups.binding_of_symbol(bound(s, d), symbols(s, d).filter("kind = 'const'").select("id")).select("local_symbol_id", "spec", "imported_name"),
    "lk_exports_of_file": lambda s, d: lookups.exports_of_file(exports(s, d), files_in(s, d, "typescript")),
    "lk_export_locations": lambda s, d: lookups.export_locations(exports(s, d), symbols(s, d)),
    "lk_exporters_of_name": lambda s, d: lookups.exporters_of_name(exports(s, d), bound(s, d).select("imported_name")),
    "lk_import_resolve": imports_resolved,
    "lk_type_relations": lambda s, d: lookups.type_relations(type_relations(s, d), symbols(s, d).select("id")),
    "lk_sub_types": sub_types,
    "lk_shapes": lambda s, d: lookups.shapes_of(shapes(s, d), scopes(s, d).filter("kind = 'class'").select("id")).select("owner", F.size("members").alias("n_members")),
    "lk_flows": lambda s, d: lookups.flows_of(flows(s, d), files_in(s, d, "python"), "file").select("flow_id"),
    "jn_flow_owners": lambda s, d: lookups.flow_owners(flows(s, d), scopes(s, d), symbols(s, d)),
    "jn_symbol_importers": importing,
}

_LANG = "SELECT file_path FROM check_contexts WHERE target_language = '{}'"
_BOUND = f"{_S}, b AS (SELECT x.*, sy.file FROM (SELECT local_symbol_id, max(resolved_export_id) AS export_id, max(module_spec) AS spec, max(imported_name) AS imported_name, bool_or(is_default) AS is_default, bool_or(is_namespace) AS is_namespace, min(\"range\".\"start\") AS \"start\" FROM import_bindings GROUP BY 1) x JOIN sy ON sy.id = local_symbol_id)"
_EXPORTS = f"{_S}, ex AS (SELECT file, name AS exported_name, id AS symbol_id FROM sy WHERE flags & 1 <> 0 AND name IS NOT NULL)"
_TYPES = f"{_S}, t AS (SELECT file, id, name FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY \"range\".\"start\", id) AS n FROM sy WHERE binding.binding_kind = 'import') WHERE n = 1), r AS (SELECT sy.id AS symbol_id, t.name AS target_name, t.id AS target_id, CASE WHEN flags & 1 <> 0 THEN 'declared' ELSE 'structural' END AS confidence FROM sy JOIN t ON t.file = sy.file WHERE kind = 'class')"
_FIRST_WORD = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z\d])([A-Z])', '\1_\2', 'g')), '[_\-]+'), lambda w: w <> '')[1]"
_SHAPES = f"{_S}, m AS (SELECT DISTINCT scope_id AS owner, {_FIRST_WORD} AS word FROM sy WHERE kind = 'method' AND name IS NOT NULL AND scope_id IS NOT NULL AND {_FIRST_WORD} IS NOT NULL)"
SQL = {
    "lk_symbols_by_id": f"WITH {_S} SELECT id, name, file, kind FROM sy WHERE id IN (SELECT to_id FROM structural_edges)",
    "lk_symbols_in_file": f"WITH {_S} SELECT id, file, kind FROM sy WHERE file IN ({_LANG.format('tsx')})",
    "lk_symbols_by_name": f"WITH {_S} SELECT id, name FROM sy WHERE name IN (SELECT name FROM lib_symbols)",
    "lk_symbols_in_scope": f"WITH {_S}, {_SC} SELECT id, scope_id FROM sy WHERE scope_id IN (SELECT id FROM sc WHERE kind = 'class')",
    "lk_references_to": "SELECT DISTINCT from_id AS ref_id, to_id AS symbol_id FROM structural_edges WHERE from_id <> to_id AND to_id IN (SELECT id FROM lib_symbols)",
    "lk_references_in_file": f"WITH {_S}, {_SC} SELECT id AS ref_id FROM sy WHERE scope_id IN (SELECT id FROM sc WHERE file IN ({_LANG.format('python')}))",
    "lk_scopes_by_id": f"WITH {_S}, {_SC} SELECT id, kind, file FROM sc WHERE id IN (SELECT scope_id FROM sy WHERE kind = 'method')",
    "lk_scopes_in_file": f"WITH {_SC} SELECT id, kind, file FROM sc WHERE file IN ({_LANG.format('javascript')})",
    "lk_bindings_in_file": f"WITH {_BOUND} SELECT local_symbol_id, spec FROM b WHERE file IN ({_LANG.format('python')})",
    "lk_binding_of_symbol": f"WITH {_BOUND} SELECT local_symbol_id, spec, imported_name FROM b WHERE local_symbol_id IN (SELECT id FROM sy WHERE kind = 'const')",
    "lk_exports_of_file": f"WITH {_EXPORTS} SELECT * FROM ex WHERE file IN ({_LANG.format('typescript')})",
    "lk_export_locations": f"WITH {_EXPORTS} SELECT DISTINCT file, exported_name FROM ex",
    "lk_exporters_of_name": f"WITH {_EXPORTS} SELECT exported_name, file, max(symbol_id) AS symbol_id FROM ex WHERE exported_name IN (SELECT max(imported_name) FROM import_bindings JOIN sy ON sy.id = local_symbol_id GROUP BY local_symbol_id) GROUP BY 1, 2",
    "lk_import_resolve": f"WITH {_BOUND}, k AS (SELECT *, CASE WHEN is_default THEN 'default' ELSE imported_name END AS nm FROM b WHERE spec IS NOT NULL), a AS (SELECT DISTINCT file, spec, nm FROM k WHERE nm IS NOT NULL), f AS (SELECT file, spec, nm, export_id, row_number() OVER (PARTITION BY file, spec, nm ORDER BY \"start\", local_symbol_id) AS n FROM k WHERE NOT is_namespace) SELECT a.file, a.spec, a.nm AS name, f.export_id FROM a LEFT JOIN f ON f.file = a.file AND f.spec = a.spec AND f.nm = a.nm AND n = 1",
    "lk_type_relations": f"WITH {_TYPES} SELECT * FROM r WHERE confidence = 'declared'",
    "lk_sub_types": f"WITH {_TYPES}, w AS (SELECT target_name AS tn, target_id AS ti FROM r ORDER BY 1, 2 LIMIT 1) SELECT symbol_id, target_name FROM r, w WHERE (confidence = 'declared' AND target_name = tn AND target_id = ti) OR (confidence <> 'declared' AND target_id = ti)",
    "lk_shapes": f"WITH {_SHAPES}, {_SC} SELECT owner, count(*)::INT AS n_members FROM m WHERE owner IN (SELECT id FROM sc WHERE kind = 'class') GROUP BY owner",
    "lk_flows": f"WITH {_S} SELECT id AS flow_id FROM sy WHERE kind = 'parameter' AND file IN ({_LANG.format('python')})",
    "jn_flow_owners": f"WITH {_S}, {_SC} SELECT flow_id, owner FROM (SELECT v.id AS flow_id, g.id AS owner, row_number() OVER (PARTITION BY v.id ORDER BY g.\"range\".\"end\" - g.\"range\".\"start\", g.\"range\".\"start\", g.id) AS n FROM sy v JOIN sc ON sc.id = v.scope_id JOIN sy g ON g.file = sc.file AND g.kind IN ('function', 'method') AND g.\"range\".\"start\" <= sc.\"range\".\"start\" AND sc.\"range\".\"end\" <= g.\"range\".\"end\" WHERE v.kind = 'parameter') WHERE n = 1",
    "jn_symbol_importers": f"WITH {_BOUND}, c AS (SELECT id, min(id) OVER (PARTITION BY name) AS canonical FROM lib_symbols), x AS (SELECT DISTINCT b.file, coalesce(c.canonical, b.export_id) AS e FROM b LEFT JOIN c ON c.id = b.export_id WHERE b.export_id IS NOT NULL) SELECT DISTINCT c.id, x.file FROM c JOIN x ON x.e = c.canonical",
}
