"""Resolution across files: re-export closure, rewrites of references, calls and types, callers and callees, type edges.

Passes are left joins that keep what is resolved already; names that several rows could give are settled by an
explicit order, never by the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.tables import cut

FUNCTIONS = ("function", "method")


def export_map(exports: DataFrame, rounds: int = 10) -> DataFrame:
    """``file, exported_name, symbol_id, ns_path``: what each file exports, re-exports followed.

    ``exports``: file, exported_name, symbol_id, source_file, source_name. A row without a source file exports its own
    symbol; one with it re-exports a name; ``source_name`` ``*`` under the name ``*`` re-exports all but ``default``, under
    another name it makes a namespace (``ns_path``). Own names win over re-exported ones, and those over starred ones;
    among stars the least source file wins. At most ``rounds`` re-exports are followed.
    """
    own = exports.filter(F.col("source_file").isNull()).select("file", "exported_name", "symbol_id", F.lit(None).cast("string").alias("ns_path"), F.lit(0).alias("rank"), F.lit("").alias("via"))
    spaces = exports.filter((F.col("source_name") == "*") & (F.col("exported_name") != "*")).select("file", "exported_name", F.lit(None).cast("string").alias("symbol_id"), F.col("source_file").alias("ns_path"), F.lit(1).alias("rank"), F.col("source_file").alias("via"))
    named = exports.filter(F.col("source_file").isNotNull() & (F.col("source_name") != "*")).select("file", "exported_name", F.col("source_file").alias("from"), F.col("source_name").alias("name"))
    stars = exports.filter((F.col("source_name") == "*") & (F.col("exported_name") == "*")).select("file", F.col("source_file").alias("from"))
    best = lambda df: df.groupBy("file", "exported_name").agg(F.min_by(F.struct("symbol_id", "ns_path", "rank", "via"), F.struct("rank", "via", "symbol_id")).alias("b")).select("file", "exported_name", "b.*")
    known = cut(best(own.unionByName(spaces)))
    base, size = known, known.count()
    for _ in range(rounds):
        have = known.select(F.col("file").alias("from"), F.col("exported_name").alias("name"), "symbol_id", "ns_path")
        by_name = named.join(have, ["from", "name"]).select("file", "exported_name", "symbol_id", "ns_path", F.lit(1).alias("rank"), F.col("from").alias("via"))
        by_star = stars.join(have.filter("name <> 'default'"), "from").select("file", F.col("name").alias("exported_name"), "symbol_id", "ns_path", F.lit(2).alias("rank"), F.col("from").alias("via"))
        known = cut(best(base.unionByName(by_name).unionByName(by_star)))
        n = known.count()
        if n == size:
            break
        size = n
    return known.select("file", "exported_name", "symbol_id", "ns_path")


def resolve_bindings(bindings: DataFrame, exported: DataFrame) -> DataFrame:
    """``local_symbol_id, export_id, ns_path`` of bindings ``local_symbol_id, imported_name, path, is_default, is_namespace``."""
    name = F.when(F.col("is_default"), F.lit("default")).otherwise(F.col("imported_name"))
    e = exported.select(F.col("file").alias("path"), F.col("exported_name").alias("asked"), F.col("symbol_id").alias("export_id"), "ns_path")
    b = bindings.withColumn("asked", F.when(~F.col("is_namespace"), name))
    out = b.join(e, ["path", "asked"], "left")
    return out.select("local_symbol_id", "export_id", F.when(F.col("is_namespace"), F.col("path")).otherwise(F.col("ns_path")).alias("ns_path"))


def rewrite_references(references: DataFrame, bound: DataFrame, exported: DataFrame) -> DataFrame:
    """References with ``symbol_id`` replaced by what their binding imports; ``ns.member`` by the member of the namespace's file."""
    b = bound.select(F.col("local_symbol_id").alias("symbol_id"), "export_id", "ns_path")
    member = F.regexp_extract("name", r"^[^.]+\.([^.]+)", 1)
    e = exported.select(F.col("file").alias("ns_path"), F.col("exported_name").alias("member"), F.col("symbol_id").alias("member_id"))
    rows = references.join(b, "symbol_id", "left").withColumn("member", F.nullif(member, F.lit(""))).join(e, ["ns_path", "member"], "left")
    kept = [c for c in references.columns if c != "symbol_id"]
    return rows.select(*kept, F.col("symbol_id").alias("local_symbol_id"), F.coalesce("member_id", "export_id", "symbol_id").alias("symbol_id"))


def rewrite_calls(calls: DataFrame, bindings: DataFrame, bound: DataFrame) -> DataFrame:
    """Calls ``file, callee_name, symbol_id`` that resolve to nothing, by the first binding of the name in their file (by start).

    ``bindings``: file, local_name, start, local_symbol_id. Dotted names stay.
    """
    first = bindings.join(bound, "local_symbol_id").groupBy("file", F.col("local_name").alias("callee_name")).agg(F.min_by("export_id", F.struct("start", "local_symbol_id")).alias("bound_id"))
    out = calls.join(first, ["file", "callee_name"], "left")
    return out.withColumn("symbol_id", F.coalesce("symbol_id", F.when(~F.col("callee_name").contains("."), F.col("bound_id")))).drop("bound_id")


def rewrite_types(relations: DataFrame, bound: DataFrame) -> DataFrame:
    """Type relations with ``target_id`` replaced by what its binding imports."""
    b = bound.select(F.col("local_symbol_id").alias("target_id"), "export_id")
    return relations.join(b, "target_id", "left").withColumn("target_id", F.coalesce("export_id", "target_id")).drop("export_id")


def sub_types(relations: DataFrame, target_name: str, target_id: str | None, every: bool = False) -> DataFrame:
    """Types that extend or implement a target: declared ones by name, if their target is it or unresolved; structural ones by id only."""
    declared = F.coalesce("confidence", F.lit("declared")) == "declared"
    same = F.col("target_id").isNull() if target_id is None else F.col("target_id").isNull() | (F.col("target_id") == target_id)
    hit = declared & (F.col("target_name") == target_name) & same
    if every and target_id is not None:
        hit = hit | (~declared & (F.col("target_id") == target_id))
    return relations.filter(hit).orderBy("symbol_id", "target_name")


def callers(calls: DataFrame, symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """``caller_id, symbol_id``: the smallest function or method whose range holds each resolved call ``file, range, symbol_id``."""
    f = symbols.filter(F.col("kind").isin(*FUNCTIONS)).select(F.col("id").alias("caller_id"), F.col("file").alias("f"), F.col("range.start").alias("start"), F.col("range.end").alias("end"))
    c = calls.filter(F.col("symbol_id").isNotNull()).select("file", "symbol_id", F.col("range.start").alias("a"), F.col("range.end").alias("b"))
    hit = c.join(f, (F.col("file") == F.col("f")) & (F.col("start") <= F.col("a")) & (F.col("b") <= F.col("end")))
    return hit.groupBy("file", "a", "b", "symbol_id").agg(F.min_by("caller_id", F.struct(F.col("end") - F.col("start"), "caller_id")).alias("caller_id")).select("caller_id", "symbol_id").distinct()


def callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``id, symbol_id``: every resolved call inside a function's range, inner functions included."""
    f = symbols.filter(F.col("kind").isin(*FUNCTIONS)).select("id", F.col("file").alias("f"), F.col("range.start").alias("start"), F.col("range.end").alias("end"))
    c = calls.filter(F.col("symbol_id").isNotNull()).select("file", "symbol_id", F.col("range.start").alias("a"), F.col("range.end").alias("b"))
    return c.join(f, (F.col("file") == F.col("f")) & (F.col("start") <= F.col("a")) & (F.col("b") <= F.col("end"))).select("id", "symbol_id").distinct()


def type_edges(edges: DataFrame, least: str | None = None) -> DataFrame:
    """One edge a pair of ``src, dst, confidence``: type-aware before declared before structural.

    ``least`` keeps edges by another order, in which declared is below structural and that below type-aware.
    """
    pick = F.when(F.col("confidence") == "type-aware", 2).when(F.col("confidence") == "declared", 1).otherwise(0)
    one = edges.withColumn("confidence", F.coalesce("confidence", F.lit("declared"))).groupBy("src", "dst").agg(F.max_by("confidence", pick).alias("confidence"))
    if least is None:
        return one
    level = {"declared": 0, "structural": 1, "type-aware": 2}
    return one.filter(F.when(F.col("confidence") == "type-aware", 2).when(F.col("confidence") == "structural", 1).otherwise(0) >= level[least])


def usage_facts(references: DataFrame) -> DataFrame:
    """Per symbol: whether it is assigned, read at run time, read as a type, or used in effect (read other than to update itself)."""
    bit = lambda n: F.col("usage").bitwiseAND(n) != 0
    return references.filter(F.col("symbol_id").isNotNull()).groupBy("symbol_id").agg(
        F.bool_or(bit(2)).alias("assigned"), F.bool_or(bit(1)).alias("read"), F.bool_or(bit(4)).alias("type_read"), F.bool_or((bit(1) & ~bit(8)) | bit(4)).alias("used")
    )


def unused_symbols(symbols: DataFrame, usage: DataFrame, args: str = "after-used", ignore: str = "^_") -> DataFrame:
    """Variables, functions, classes and parameters without use in effect.

    ``args``: ``all`` parameters, ``none``, or those ``after-used``: after the last used parameter of their file.
    """
    from pyspark.sql import Window

    u = usage.select(F.col("symbol_id").alias("id"), "used")
    s = symbols.join(u, "id", "left").withColumn("used", F.coalesce("used", F.lit(False)))
    last = F.max(F.when((F.col("kind") == "parameter") & F.col("used"), F.col("binding.parameter_index"))).over(Window.partitionBy("file"))
    s = s.withColumn("last_used", F.coalesce(last, F.lit(-1)))
    is_parameter = F.col("kind") == "parameter"
    asked = {"all": F.lit(True), "none": ~is_parameter, "after-used": ~is_parameter | (F.col("binding.parameter_index") > F.col("last_used"))}[args]
    return s.filter(~F.col("used") & (F.col("flags").bitwiseAND(1) == 0) & F.col("kind").isin("variable", "function", "class", "parameter") & ~F.col("name").rlike(ignore) & asked).select("id", "kind", "name", "file")
