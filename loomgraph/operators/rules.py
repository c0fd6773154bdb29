"""The policy rules: each gives rows of ``rule_id, file, message, line, col`` (line and column where known)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph

# How identifiers are declared on a line, by language family.
SCRIPT_NAMES = [r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)", r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)", r"\b(?:class|interface|type|enum)\s+([A-Za-z_$][\w$]*)"]
PYTHON_NAMES = [r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", r"^\s*class\s+([A-Za-z_]\w*)", r"^\s*([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)"]


def violations(df: DataFrame, rule: str, message: Column, line: Column | None = None, col: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("int")
    return df.select(F.lit(rule).alias("rule_id"), "file", message.alias("message"), (none if line is None else line.cast("int")).alias("line"), (none if col is None else col.cast("int")).alias("col"))


def forbidden_words(sources: DataFrame, words: list[str]) -> DataFrame:
    """Declared identifiers with a forbidden word, by ``file, source``; line and column are where the name begins."""
    names: Column = F.when(F.col("file").endswith(".py"), F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in PYTHON_NAMES])).otherwise(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in SCRIPT_NAMES]))
    lines = sources.select("file", F.posexplode(F.split("source", r"\r?\n")).alias("at", "text"))
    found = lines.select("file", "at", "text", F.explode(F.array_distinct(F.flatten(names))).alias("name"))
    hit = found.withColumn("word", T.first_forbidden(F.col("name"), words)).filter(F.col("word").isNotNull())
    return violations(hit, "forbidden-words", F.concat(F.lit("identifier '"), "name", F.lit("' has the forbidden word '"), "word", F.lit("'")), F.col("at") + 1, F.instr("text", F.col("name")))


def forbidden_path_words(files: DataFrame, words: list[str], root: str = "", directories: bool = True, names: bool = True) -> DataFrame:
    segments = files.select("file", F.posexplode(T.path_segments(F.col("file"), root)).alias("at", "segment"), F.size(T.path_segments(F.col("file"), root)).alias("n"))
    is_name = F.col("at") == F.col("n") - 1
    asked = segments.filter((is_name & F.lit(names)) | (~is_name & F.lit(directories)))
    bare = F.when(is_name, F.regexp_replace("segment", r"\.[^.]*$", "")).otherwise(F.col("segment"))
    hit = asked.withColumn("word", T.first_forbidden(bare, words)).filter(F.col("word").isNotNull())
    return violations(hit, "forbidden-path-words", F.concat(F.lit("path segment '"), "segment", F.lit("' has the forbidden word '"), "word", F.lit("'")))


def no_verb_names(symbols: DataFrame, verbs: list[str]) -> DataFrame:
    """Functions whose name begins with a verb; dunder names of Python are left out."""
    named = symbols.filter((F.col("kind") == "function") & ~(F.col("file").endswith(".py") & F.col("name").rlike("^__.*__$")))
    hit = named.withColumn("verb", T.leading_verb(F.col("name"), verbs)).filter(F.col("verb").isNotNull())
    return violations(hit, "no-verb-function-name", F.concat(F.lit("function '"), "name", F.lit("' begins with the verb '"), "verb", F.lit("'")))


def no_interface(symbols: DataFrame) -> DataFrame:
    return violations(symbols.filter(F.col("kind") == "interface"), "no-interface", F.concat(F.lit("interface '"), "name", F.lit("' should be a type")))


def forbidden_declarations(symbols: DataFrame, kinds: list[str], bindings: list[str], names: str | None = None) -> DataFrame:
    """Declarations of a forbidden binding, else of a forbidden kind; one row each; constructors are skipped."""
    asked = symbols.filter(F.col("name") != "constructor")
    if names is not None:
        asked = asked.filter(F.col("name").rlike(names))
    what = F.when(F.col("binding.binding_kind").isin(bindings), F.col("binding.binding_kind")).when(F.col("kind").isin(kinds), F.col("kind"))
    hit = asked.withColumn("what", what).filter(F.col("what").isNotNull())
    return violations(hit, "forbidden-declarations", F.concat(F.lit("forbidden "), "what", F.lit(" '"), "name", F.lit("'")))


def enforce_casing(symbols: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Symbols whose name has none of the styles of their kind."""
    fits = F.lit(True)
    for kind, styles in allowed.items():
        fits = F.when(F.col("kind") == kind, T.matches_casing(F.col("name"), styles)).otherwise(fits)
    hit = symbols.filter(F.col("kind").isin(list(allowed)) & ~fits)
    return violations(hit, "enforce-casing", F.concat("kind", F.lit(" '"), "name", F.lit("' has no allowed casing")))


def no_duplicate_exports(exports: DataFrame) -> DataFrame:
    """Exported names in more than one file: each but the first file, with the first named."""
    w = Window.partitionBy("exported_name").orderBy("file")
    numbered = exports.select("exported_name", "file").distinct().withColumn("first", F.first("file").over(w)).withColumn("n", F.row_number().over(w))
    return violations(numbered.filter("n > 1"), "no-duplicate-exports", F.concat(F.lit("'"), "exported_name", F.lit("' is exported by "), "first", F.lit(" already")))


def no_mixed_exports(exports: DataFrame, preferred: str | None = None) -> DataFrame:
    """Modules with default and named exports; with ``preferred`` (default or named) those with any export of the other style."""
    by = exports.groupBy("file").agg(F.bool_or(F.col("is_default")).alias("d"), F.bool_or(~F.col("is_default")).alias("n"))
    if preferred is not None:
        other = F.col("n") if preferred == "default" else F.col("d")
        return violations(by.filter(other), "no-mixed-exports", F.lit(f"exports should be {preferred}"))
    return violations(by.filter("d and n"), "no-mixed-exports", F.lit("default and named exports in one module"))


def star_reach(exports: DataFrame, stars: DataFrame) -> DataFrame:
    """``file, exported_name, source``: names that a file re-exports by stars, with the star they come through; ``default`` never does."""
    own = exports.filter(F.col("exported_name") != "default").select("file", "exported_name").distinct()
    links = stars.select("file", F.col("target").alias("via")).distinct()
    names = new = graph.cut(links.join(own.withColumnRenamed("file", "via"), "via").select("file", "exported_name", F.col("via").alias("source")).distinct())
    while not new.isEmpty():
        seen = new.select(F.col("file").alias("via"), "exported_name").distinct()
        more = links.join(seen, "via").select("file", "exported_name", F.col("via").alias("source")).distinct()
        new = graph.cut(more.join(names, ["file", "exported_name", "source"], "left_anti"))
        names = graph.cut(names.unionByName(new))
    return names


def no_star_collisions(exports: DataFrame, stars: DataFrame) -> DataFrame:
    by = star_reach(exports, stars).groupBy("file", "exported_name").agg(F.count_distinct("source").alias("n")).filter("n >= 2")
    return violations(by, "no-star-export-collisions", F.concat(F.lit("'"), "exported_name", F.lit("' comes from "), F.col("n").cast("string"), F.lit(" star exports")))


def no_unused_exports(exports: DataFrame, imported: DataFrame, stars: DataFrame) -> DataFrame:
    """Exports that no other file imports by ``target, name``; files that are star re-exported are exempt."""
    used = imported.filter(F.col("file") != F.col("target")).select(F.col("target").alias("file"), F.col("name").alias("exported_name")).distinct()
    left = exports.join(used, ["file", "exported_name"], "left_anti").join(stars.select(F.col("target").alias("file")), "file", "left_anti")
    return violations(left, "no-unused-exports", F.concat(F.lit("'"), "exported_name", F.lit("' is not imported")))


def not_exported(imported: DataFrame, symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """The converse: top-level symbols ``file, name`` that another file imports by ``target, name`` and that are not exported."""
    asked = imported.filter(F.col("file") != F.col("target")).select(F.col("target").alias("file"), "name").distinct()
    hit = symbols.select("file", "name").distinct().join(asked, ["file", "name"], "left_semi").join(exports.select("file", F.col("exported_name").alias("name")), ["file", "name"], "left_anti")
    return violations(hit, "no-unused-exports", F.concat(F.lit("'"), "name", F.lit("' is imported but not exported")))


def logger_enter_exit(functions: DataFrame, enter: str = "enter", leave: str = "exit", logger: str = "logger") -> DataFrame:
    """Functions ``file, name, body`` that don't begin with a call of ``logger.enter`` or have none of ``logger.exit`` in the ``finally`` of their first try.

    The body is the text between the function's braces, or below its header in Python; null for functions that are one expression, which always fail.
    """
    call = lambda name: rf"\b{re.escape(logger)}\s*\.\s*{re.escape(name)}\s*\("
    first = r"(?s)^\s*(?:(?://[^\n]*\n|#[^\n]*\n|/\*.*?\*/|\x22{3}.*?\x22{3}|\x27{3}.*?\x27{3})\s*)*(?:await\s+)?"
    begins = F.coalesce(F.col("body").rlike(first + call(enter)[2:]), F.lit(False))
    after_try = F.regexp_extract("body", r"(?s)\btry\b.*?\bfinally\b(.*)", 1)
    ends = F.coalesce(after_try.rlike(call(leave)), F.lit(False))
    what = F.when(F.col("body").isNull(), "is one expression").when(~begins, f"does not begin with {logger}.{enter}").when(~ends, f"does not end with {logger}.{leave} in a finally")
    hit = functions.withColumn("what", what).filter(F.col("what").isNotNull())
    return violations(hit, "require-logger-enter-exit", F.concat(F.lit("function '"), "name", F.lit("' "), "what"))


def no_unused_symbols(symbols: DataFrame, used: DataFrame, kinds: list[str], ignore: str = "^_") -> DataFrame:
    """Declarations of the kinds that nothing uses (``id``) and that are neither exported nor named to be ignored."""
    asked = symbols.filter(F.col("kind").isin(kinds) & (F.col("flags").bitwiseAND(1) == 0) & ~F.col("name").rlike(ignore))
    return violations(asked.join(used.select("id"), "id", "left_anti"), "no-unused-vars", F.concat("kind", F.lit(" '"), "name", F.lit("' is not used")))


def no_cycles(members: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """The largest cycles, then by members; one row each at its first member. If there are more than ``most``, a row without a file tells how many are left out."""
    every = graph.cut(graph.cycles(members).filter(F.col("size") >= least))
    found = every.orderBy(F.desc("size"), "members").limit(most)
    rows = violations(found.withColumn("file", F.element_at("members", 1).cast("string")), "no-cycles", F.concat(F.lit("cycle of "), F.col("size").cast("string")))
    n = every.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).withColumn("file", F.lit(None).cast("string"))
    return rows.unionByName(violations(n, "no-cycles", F.concat((F.col("n") - most).cast("string"), F.lit(" more cycles"))))


def max_cycle_size(members: DataFrame, most: int, ignored: Column | None = None) -> DataFrame:
    kept = members if ignored is None else members.filter(~ignored)
    by = kept.groupBy("cycle").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("file")).filter((F.col("size") >= 2) & (F.col("size") > max(2, most)))
    return violations(by.withColumn("file", F.col("file").cast("string")), "max-cycle-size", F.concat(F.lit("cycle of "), F.col("size").cast("string")))


def max_fan(edges: DataFrame, incoming: bool, most: int) -> DataFrame:
    side = "dst" if incoming else "src"
    by = edges.groupBy(F.col(side).cast("string").alias("file")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return violations(by, "max-fan-in" if incoming else "max-fan-out", F.concat(F.col("n").cast("string"), F.lit(" of at most "), F.lit(str(most))))


def entry_point_allowlist(nodes: DataFrame, edges: DataFrame, allowed: Column) -> DataFrame:
    hit = graph.entry_points(nodes, edges).filter(~allowed)
    return violations(hit.withColumn("file", F.col("id").cast("string")), "entry-point-allowlist", F.lit("not an allowed entry point"))


def dead_module(nodes: DataFrame, edges: DataFrame, entries: DataFrame | None = None, entry_globs: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """Modules that no entry reaches, but for those ignored. Entry globs that match nothing give no violations."""
    if entry_globs:
        entries = nodes.filter(T.matches_any(F.col("id").cast("string"), entry_globs)).select("id")
        if entries.isEmpty():
            nodes = nodes.limit(0)
    hit = graph.dead_modules(nodes, edges, entries)
    if ignore:
        hit = hit.filter(~T.matches_any(F.col("id").cast("string"), ignore))
    return violations(hit.withColumn("file", F.col("id").cast("string")), "dead-module", F.lit("no entry point reaches it"))


def layer_of(files: DataFrame, layers: dict[str, list[str]]) -> DataFrame:
    """``file, layer, ambiguous``: the layer with the longest matching glob; ties between layers are ambiguous; no match leaves null."""
    best = F.greatest(F.lit(-1), *[F.when(F.col("file").rlike(T.glob_regex(g)), F.lit(len(g))).otherwise(F.lit(-1)) for gs in layers.values() for g in gs])
    named = F.array(*[F.when(F.greatest(F.lit(-1), *[F.when(F.col("file").rlike(T.glob_regex(g)), F.lit(len(g))).otherwise(F.lit(-1)) for g in gs]) == best, F.lit(n)) for n, gs in layers.items()])
    hits = F.when(best >= 0, F.array_compact(named)).otherwise(F.array())
    return files.select("file", F.try_element_at(hits, F.lit(1)).alias("layer"), (F.size(hits) > 1).alias("ambiguous"))


def no_layer_violation(edges: DataFrame, layer: DataFrame, deny: list[tuple[str, str]], allow: list[tuple[str, str]] | None = None) -> DataFrame:
    """Edges between layers that are denied, or not among those allowed. ``layer`` has ``id, layer``; unclassified ends are ignored."""
    a, b = layer.select(F.col("id").alias("src"), F.col("layer").alias("from")), layer.select(F.col("id").alias("dst"), F.col("layer").alias("to"))
    crossed = edges.join(a, "src").join(b, "dst").filter(F.col("from").isNotNull() & F.col("to").isNotNull() & (F.col("from") != F.col("to")))
    pair = F.struct(F.col("from"), F.col("to"))
    is_one = lambda ps: F.coalesce(*[F.when((F.col("from") == x) & (F.col("to") == y), F.lit(True)) for x, y in ps], F.lit(False)) if ps else F.lit(False)
    bad = is_one(deny) if allow is None else is_one(deny) | ~is_one(allow)
    return violations(crossed.filter(bad).withColumn("file", F.col("src").cast("string")), "no-layer-violation", F.concat("from", F.lit(" -> "), "to", F.lit(": "), F.col("dst").cast("string")))


def ambiguous_layers(layered: DataFrame) -> DataFrame:
    """A row for each file that two layers claim by globs of the same length (``layer_of``)."""
    return violations(layered.filter(F.col("ambiguous")), "no-layer-violation", F.lit("more than one layer claims it"))


def no_cross_package_internal(edges: DataFrame, package: DataFrame, entries: DataFrame) -> DataFrame:
    """Edges into another package at a module that isn't its entry. ``package`` has ``id, package``, ``entries`` has ``id``."""
    a, b = package.select(F.col("id").alias("src"), F.col("package").alias("from")), package.select(F.col("id").alias("dst"), F.col("package").alias("to"))
    bad = edges.join(a, "src").join(b, "dst").filter(F.col("from") != F.col("to")).join(entries.select(F.col("id").alias("dst")), "dst", "left_anti")
    return violations(bad.withColumn("file", F.col("src").cast("string")), "no-cross-package-internal-import", F.concat("to", F.lit(": "), F.col("dst").cast("string")))


def no_undeclared_implementer(matches: DataFrame, kinds: DataFrame, ignore_classes: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Classes that have an interface's members without declaring it. ``matches``: owner, target; ``kinds``: id, kind. ``only`` are globs of interfaces to ask for, ``ignore_classes`` of classes left out."""
    if only:
        matches = matches.filter(T.matches_any(F.col("target").cast("string"), only))
    if ignore_classes:
        matches = matches.filter(~T.matches_any(F.col("owner").cast("string"), ignore_classes))
    hit = matches.join(kinds.filter(F.col("kind") == "interface").select(F.col("id").alias("target")), "target", "left_semi")
    return violations(hit.withColumn("file", F.col("owner").cast("string")), "no-undeclared-implementer", F.concat(F.lit("implements "), F.col("target").cast("string")))
