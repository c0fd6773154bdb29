"""Lookups, joins, aggregations and windows over the fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.tables import cut

EXPORTED = 1
#: Owners and targets of a piece of the pairs that structural matching makes; each is repeated for the pieces across.
SIDE = 1024


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order (last wins); state is one row a key and task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r"))
    return picked.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ``order`` must be total for a defined result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def exported(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("flags").bitwiseAND(EXPORTED) != 0)


def symbol_lookup(symbols: DataFrame, name: str, kind: str | None = None, file: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols of a name in order of file, start and id; the limit is taken before the kind is asked."""
    found = symbols.filter(F.col("name") == name)
    if file is not None:
        found = found.filter(F.col("file") == file)
    found = found.orderBy("file", F.col("range.start"), "id").limit(limit)
    return found if kind is None else found.filter(F.col("kind") == kind)


def at_position(symbols: DataFrame, positions: DataFrame) -> DataFrame:
    """For each ``file, offset`` the smallest symbol with start <= offset < end; ties go to the first start, then id."""
    s = symbols.select("id", F.col("file").alias("f"), F.col("range.start").alias("start"), F.col("range.end").alias("end"))
    hit = positions.join(s, (F.col("file") == F.col("f")) & (F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("end")))
    return hit.groupBy("file", "offset").agg(F.min_by("id", F.struct(F.col("end") - F.col("start"), "start", "id")).alias("id"))


def enclosing_scope(items: DataFrame, scopes: DataFrame) -> DataFrame:
    """``id, scope_id``: the smallest scope of the same file that contains each item's range (an equi-join by file with a range residual)."""
    i = items.select("id", F.col("file").alias("f"), F.col("range.start").alias("a"), F.col("range.end").alias("b"))
    s = scopes.select(F.col("id").alias("scope_id"), "file", F.col("range.start").alias("start"), F.col("range.end").alias("end"))
    hit = i.join(s, (F.col("f") == F.col("file")) & (F.col("start") <= F.col("a")) & (F.col("b") <= F.col("end")))
    return hit.groupBy("id").agg(F.min_by("scope_id", F.struct(F.col("end") - F.col("start"), "start", "scope_id")).alias("scope_id"))


def scope_ancestors(scopes: DataFrame) -> DataFrame:
    """``id, ancestor, depth`` up the parent chains, each scope its own ancestor at 0. A chain that comes back to its own scope ends there.

    Known stretches are joined to their continuations, so rounds grow with the logarithm of the depth.
    """
    links = cut(scopes.select("id", "parent").distinct())
    out = cut(links.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).distinct())
    # reach: what lies exactly ``size`` levels up
    reach, size = links.filter(F.col("parent").isNotNull()).select("id", F.col("parent").alias("ancestor")), 1
    while True:
        up = reach.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
        more = out.join(up, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("depth") + size).alias("depth"))
        more = cut(more.join(out.select("id", "ancestor"), ["id", "ancestor"], "left_anti").join(links.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi"))
        if more.isEmpty():
            return out.select("id", "ancestor", "depth")
        out = cut(out.unionByName(more).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        reach, size = cut(reach.join(up, "ancestor").select("id", F.col("next").alias("ancestor"))), size * 2


def resolve_lexically(references: DataFrame, symbols: DataFrame, ancestors: DataFrame) -> DataFrame:
    """``ref_id, symbol_id``: the declaration that a reference ``ref_id, scope_id, name, start`` sees.

    A declaration of the name in the scope or an ancestor is visible if hoisted or begun at the reference's start
    or before; the nearest scope wins, in it the latest start, then the least id.
    """
    s = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("n"), F.col("scope_id").alias("ancestor"), F.col("range.start").alias("at"), F.coalesce(F.col("binding.hoisted"), F.lit(False)).alias("hoisted"))
    seen = references.join(ancestors.withColumnRenamed("id", "scope_id"), "scope_id").join(s, "ancestor").filter((F.col("n") == F.col("name")) & (F.col("hoisted") | (F.col("at") <= F.col("start"))))
    return seen.groupBy("ref_id").agg(F.min_by("symbol_id", F.struct("depth", -F.col("at"), "symbol_id")).alias("symbol_id"))


def resolve_specs(specs: DataFrame, files: DataFrame, extensions: tuple[str, ...] = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")) -> DataFrame:
    """``from_file, spec, target`` of relative specifiers: candidate paths are exploded with their rank and joined to the known files.

    The exact path comes first, then each extension, then the index file of a directory with each extension;
    a ``.js`` specifier may stand for its ``.ts`` source. Others than relative ones stay null.
    """
    base = F.regexp_replace("from_file", "/[^/]*$", "")
    parts = F.concat(F.split(base, "/"), F.split("spec", "/"))
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when((p == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p))),
    )
    path = F.array_join(walked, "/")
    swapped = F.regexp_replace(path, r"\.(?:m|c)?jsx?$", "")
    tried = F.array(path, *[F.concat(path, F.lit(e)) for e in extensions], *[F.concat(swapped, F.lit(e)) for e in extensions], *[F.concat(path, F.lit("/index" + e)) for e in extensions])
    asked = specs.filter(F.col("spec").rlike(r"^\.\.?/")).select("from_file", "spec").distinct()
    ranked = asked.select("from_file", "spec", F.posexplode(tried).alias("rank", "target"))
    found = ranked.join(files.select(F.col("file").alias("target")).distinct(), "target", "left_semi")
    best = found.groupBy("from_file", "spec").agg(F.min_by("target", "rank").alias("target"))
    return specs.select("from_file", "spec").distinct().join(best, ["from_file", "spec"], "left")


def resolve_modules(specs: DataFrame, files: DataFrame, packages: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``from_file, spec, target, how`` of script specifiers: a workspace package, a relative path, an alias or an absolute path; others are external (null).

    ``packages``: name, dir, entry. ``name`` gives the package's entry, ``name/path`` a file below its folder, then below its ``src``. The longest package name
    wins, as does the longest alias (a prefix and the folder it stands for). Paths are tried as in ``resolve_specs``.
    """
    asked = specs.select("from_file", "spec").distinct()
    parts = F.split("spec", "/")
    prefixes = asked.select("from_file", "spec", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("name")))).alias("p")).select("from_file", "spec", "p.n", "p.name")
    owned = prefixes.join(packages.select("name", "dir", "entry"), "name").groupBy("from_file", "spec").agg(F.max_by(F.struct("name", "dir", "entry"), "n").alias("k")).select("from_file", "spec", "k.*")
    whole = owned.filter(F.col("spec") == F.col("name")).select("from_file", "spec", F.col("entry").alias("target"), F.lit("package").alias("how"))
    below = owned.filter(F.col("spec") != F.col("name"))
    path = F.substring("spec", F.length("name") + 1, F.length("spec"))
    tries = below.select("from_file", "spec", F.lit("package").alias("how"), F.posexplode(F.array(F.concat("dir", path), F.concat("dir", F.lit("/src"), path))).alias("rank", "path"))
    rest = asked.join(owned.select("from_file", "spec"), ["from_file", "spec"], "left_anti")
    relative = F.col("spec").rlike(r"^\.\.?(?:/|$)")
    stands = F.lit(None).cast("string")
    for prefix, folder in sorted((aliases or {}).items(), key=lambda x: len(x[0])):
        stands = F.when(F.col("spec").startswith(prefix), F.concat(F.lit(folder), F.substring("spec", len(prefix) + 1, 1 << 30))).otherwise(stands)
    base = F.regexp_replace("from_file", "/[^/]*$", "")
    how = F.when(relative, "relative").when(stands.isNotNull(), "alias").when(F.col("spec").startswith("/"), "absolute")
    at = F.when(relative, F.concat(base, F.lit("/"), "spec")).when(stands.isNotNull(), stands).when(F.col("spec").startswith("/"), F.col("spec"))
    more = rest.select("from_file", "spec", how.alias("how"), F.lit(0).alias("rank"), at.alias("path")).filter(F.col("path").isNotNull())
    every = tries.unionByName(more)
    # a path from the root is a relative one of a file at the root
    found = resolve_specs(every.select(F.lit("").alias("from_file"), F.concat(F.lit("./"), F.ltrim("path", F.lit("/"))).alias("spec")).distinct(), files)
    hits = every.withColumn("_spec", F.concat(F.lit("./"), F.ltrim("path", F.lit("/")))).join(found.select(F.col("spec").alias("_spec"), "target"), "_spec").filter(F.col("target").isNotNull())
    best = whole.unionByName(hits.groupBy("from_file", "spec").agg(F.min_by(F.struct("target", "how"), "rank").alias("b")).select("from_file", "spec", "b.target", "b.how"))
    return asked.join(best, ["from_file", "spec"], "left")


def with_submodules(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """``resolved`` (from_file, spec, name, target, export_id) with ``submodule``: for a name that a package's ``__init__.py`` doesn't export, the module of that name beside it."""
    init = F.col("target").endswith("/__init__.py") & F.col("export_id").isNull() & F.col("name").isNotNull()
    folder = F.regexp_replace("target", "__init__\\.py$", "")
    tried = resolved.filter(init).select("target", "name", F.posexplode(F.array(F.concat(folder, "name", F.lit(".py")), F.concat(folder, "name", F.lit("/__init__.py")))).alias("rank", "submodule")).distinct()
    best = tried.join(files.select(F.col("file").alias("submodule")).distinct(), "submodule", "left_semi").groupBy("target", "name").agg(F.min_by("submodule", "rank").alias("submodule"))
    return resolved.join(best, ["target", "name"], "left").withColumn("submodule", F.when(init, F.col("submodule")))


def resolve_python(specs: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """``from_file, spec, target`` of Python modules: leading dots climb packages, else from ``root``; a module file before a package."""
    dots = F.length(F.regexp_extract("spec", r"^\.*", 0))
    name = F.replace(F.regexp_replace("spec", r"^\.+", ""), F.lit("."), F.lit("/"))
    base = F.split("from_file", "/")
    up = F.array_join(F.slice(base, 1, F.greatest(F.size(base) - dots, F.lit(0))), "/")
    path = F.when(dots > 0, F.concat_ws("/", up, F.when(name != "", name))).otherwise(F.concat(F.lit(root), name))
    tried = F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")))
    ranked = specs.select("from_file", "spec").distinct().select("from_file", "spec", F.posexplode(tried).alias("rank", "target"))
    best = ranked.join(files.select(F.col("file").alias("target")).distinct(), "target", "left_semi").groupBy("from_file", "spec").agg(F.min_by("target", "rank").alias("target"))
    return specs.select("from_file", "spec").distinct().join(best, ["from_file", "spec"], "left")


def bind_exports(bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """``bindings`` with ``export_symbol``: by (resolved path, imported name, default's own name for default bindings); namespaces bind no symbol."""
    name = F.when(F.col("is_default"), F.lit("default")).otherwise(F.col("imported_name"))
    e = exports.select(F.col("file").alias("e_file"), F.col("exported_name").alias("e_name"), F.col("symbol_id").alias("export_symbol"))
    return bindings.withColumn("_name", F.when(~F.col("is_namespace"), name)).join(e, (F.col("resolved_module_path") == F.col("e_file")) & (F.col("_name") == F.col("e_name")), "left").drop("e_file", "e_name", "_name")


def structural_matches(shapes: DataFrame, declared: DataFrame) -> DataFrame:
    """``owner, target``: classes whose members satisfy an interface (relational division).

    ``shapes``: owner, kind (class or interface), truncated, members of name, member_kind, param_arity, is_optional,
    is_static. Required members must be there by name, kind and staticness with at least the arity; a target with
    members that are all optional matches every class. Truncated shapes, owners themselves and ``declared`` pairs are out.

    Owners of the same members and targets of the same needs are matched once. Pairs are made by the last join, in pieces of
    at most ``SIDE`` owners and targets, and aren't shuffled; what is asked of ``owner`` or ``target`` after is asked before it.
    """
    by = ["name", "member_kind", "is_static"]
    member = F.struct(*by, F.col("param_arity").alias("arity"))
    whole = cut(shapes.filter(~F.col("truncated")).select("owner", "kind", (F.size("members") > 0).alias("some"), F.explode_outer("members").alias("m")).select("owner", "kind", "some", "m.*"))

    def gathered(rows: DataFrame, counts: Column, key: str) -> DataFrame:
        """``owner, members`` of the rows that count, and a digest of them: many share one."""
        one = rows.groupBy("owner", *by, counts.alias("counts")).agg(F.max(F.coalesce("param_arity", F.lit(0))).alias("param_arity"))
        out = one.groupBy("owner").agg(F.array_sort(F.collect_list(F.when(F.col("counts"), member))).alias("members"))
        return cut(out.withColumn(key, F.unhex(F.sha2(F.to_json("members"), 256))))

    owners = gathered(whole.filter(F.col("kind") == "class"), F.col("name").isNotNull(), "shape")
    targets = gathered(whole.filter("some"), F.coalesce(~F.col("is_optional"), F.lit(False)), "need")
    of = owners.groupBy("shape").agg(F.first("members").alias("has"), F.count(F.lit(1)).alias("n_owners"))
    to = targets.groupBy("need").agg(F.first("members").alias("asks"), F.count(F.lit(1)).alias("n_targets"))
    has = of.select("shape", "has", F.explode("has").alias("m")).select("shape", "has", "m.*")
    asks = to.select("need", "asks", F.explode("asks").alias("m")).select("need", "asks", "m.*")
    # only shapes with a need's rarest member can meet it, so a member that most have pairs nothing
    common = has.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rarest = asks.join(common, by, "left").groupBy("need").agg(F.min_by(F.struct(*by, "asks"), F.struct(F.coalesce("n", F.lit(0)), *by)).alias("r")).select("need", "r.*")
    met = F.forall("asks", lambda a: F.exists("has", lambda h: (h["name"] == a["name"]) & (h["member_kind"] == a["member_kind"]) & (h["is_static"] == a["is_static"]) & (h["arity"] >= a["arity"])))
    free = to.filter(F.size("asks") == 0).select("need")
    full = cut(rarest.join(has, by).filter(met).select("shape", "need").unionByName(of.select("shape").crossJoin(free)))

    pieces = full.join(of.select("shape", "n_owners"), "shape").groupBy("need").agg(F.sum("n_owners").alias("n_owners")).join(to.select("need", "n_targets"), "need")
    pieces = cut(pieces.select("need", F.monotonically_increasing_id().alias("k"), F.ceil(F.col("n_owners") / SIDE).alias("n_o"), F.ceil(F.col("n_targets") / SIDE).alias("n_t")))
    piece = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    able = owners.select("owner", "shape").join(full.join(pieces, "need"), "shape").select("owner", "k", "n_o", "n_t")
    asked = targets.select(F.col("owner").alias("target"), "need").join(pieces, "need").select("target", "k", "n_o", "n_t")
    out = declared.select("owner", "target").distinct().join(asked.select("target", "k"), "target").groupBy("owner", "k").agg(F.collect_set("target").alias("out"))
    able = able.join(out, ["owner", "k"], "left").select("owner", "out", "k", piece("owner", "n_o").alias("o"), every("n_t").alias("t"))
    asked = asked.select("target", "k", every("n_o").alias("o"), piece("target", "n_t").alias("t"))
    # so many tasks however little they read, for what they make is far more
    tasks = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    able, asked = (side.repartition(tasks, "k", "o", "t") for side in (able, asked))
    pairs = able.join(asked, ["k", "o", "t"])
    return pairs.filter((F.col("owner") != F.col("target")) & ~F.coalesce(F.array_contains("out", F.col("target")), F.lit(False))).select("owner", "target")


def merge_edges(structural: DataFrame, typed: DataFrame) -> DataFrame:
    """Full outer merge by ``src, dst``: the type-aware edge overrides the structural one's confidence."""
    t = typed.select("src", "dst", F.lit("type-aware").alias("t"))
    s = structural.select("src", "dst", F.lit("structural").alias("s")).distinct()
    return s.join(t.distinct(), ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("t", "s").alias("confidence"))


def group_to_nearest(bindings: DataFrame, statements: DataFrame) -> DataFrame:
    """Bindings attached to the import statement of the same file and spec whose start is nearest; without one, to their own start."""
    s = statements.select(F.col("file").alias("s_file"), F.col("spec").alias("s_spec"), F.col("start").alias("s_start"))
    hit = bindings.join(s, (F.col("file") == F.col("s_file")) & (F.col("spec") == F.col("s_spec")), "left")
    near = hit.groupBy("id", "file", "spec", "start").agg(F.min_by("s_start", F.struct(F.abs(F.col("s_start") - F.col("start")), "s_start")).alias("s_start"))
    return near.groupBy("file", "spec", F.coalesce("s_start", "start").alias("statement")).agg(F.count(F.lit(1)).alias("n_bindings"), F.min("start").alias("first"), F.max("start").alias("last"))


def package_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``file, package``: the longest package directory above each file. Directories of a path are exploded, so this is an equi-join."""
    parts = F.split("file", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))
    up = files.select("file", F.explode(ups).alias("u")).select("file", "u.n", "u.dir")
    best = up.join(packages.select("dir", "package"), "dir").groupBy("file").agg(F.max_by("package", "n").alias("package"))
    return files.select("file").join(best, "file", "left")


def file_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file, change`` by ``file, revision``: added, removed, changed or unchanged."""
    both = old.select("file", F.col("revision").alias("was")).join(new.select("file", F.col("revision").alias("now")), "file", "full_outer")
    return both.select("file", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed").alias("change"))


def affordable(delta: DataFrame, most_share: float = 0.25) -> DataFrame:
    """One row: whether (added + removed) / current is at most ``most_share``; nothing current is affordable."""
    n = delta.agg(F.count_if(F.col("change").isin("added", "removed")).alias("moved"), F.count_if(F.col("change") != "removed").alias("current"))
    return n.select("moved", "current", ((F.col("current") == 0) | (F.col("moved") / F.greatest("current", F.lit(1)) <= most_share)).alias("affordable"))


def cache_split(files: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files whose cached result is valid, and those to analyse anew."""
    return files.join(cache, keys, "left_semi"), files.join(cache, keys, "left_anti")


def top_related(edges: DataFrame, key: str, other: str, most: int, shown: int = 5) -> DataFrame:
    """Keys with more than ``most`` neighbours, the first ``shown`` of them in order and how many are left out."""
    w = Window.partitionBy(key).orderBy(other)
    numbered = edges.select(key, other).distinct().withColumn("n", F.row_number().over(w))
    out = numbered.groupBy(key).agg(F.max("n").alias("fan"), F.array_sort(F.collect_list(F.when(F.col("n") <= shown, F.col(other)))).alias("related"))
    return out.filter(F.col("fan") > most).select(F.col(key).alias("id"), "fan", F.array_join("related", ",").alias("related"), F.greatest(F.col("fan") - shown, F.lit(0)).alias("left_out"))


def budget(rows: DataFrame, group: str, order: list[Column], per_group: int, overall: int, groups: list[str]) -> DataFrame:
    """At most ``per_group`` rows of each group and ``overall`` in all, groups in the given order."""
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(group))
    kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= per_group)
    # at most per_group x groups rows are left here, so one task may number them
    return kept.withColumn("_all", F.row_number().over(Window.orderBy(place, "_n"))).filter(F.col("_all") <= overall).drop("_n", "_all")
