from pyspark.sql import functions as F

from loomgraph.operators import edits, export, relations, rules

R = "struct<start:int,end:int>"


def test_enclosing_scope_is_the_smallest(spark):
    scopes = spark.createDataFrame([("f", "a", (0, 100)), ("g", "a", (10, 50)), ("h", "b", (0, 9))], f"id string, file string, range {R}")
    items = spark.createDataFrame([("x", "a", (20, 30)), ("y", "a", (60, 70)), ("z", "c", (0, 1))], f"id string, file string, range {R}")
    assert {r["id"]: r["scope_id"] for r in relations.enclosing_scope(items, scopes).collect()} == {"x": "g", "y": "f"}


def test_lexical_resolution(spark):
    scopes = spark.createDataFrame([("root", None), ("inner", "root"), ("leaf", "inner")], "id string, parent string")
    b = "struct<hoisted:boolean>"
    symbols = spark.createDataFrame([("s1", "x", "root", (0, 1), None), ("s2", "x", "inner", (50, 51), None), ("s3", "x", "inner", (90, 91), None), ("s4", "y", "root", (99, 100), (True,))], f"id string, name string, scope_id string, range {R}, binding {b}")
    refs = spark.createDataFrame([("r1", "leaf", "x", 60), ("r2", "leaf", "x", 20), ("r3", "leaf", "x", 95), ("r4", "leaf", "y", 5), ("r5", "leaf", "q", 5)], "ref_id string, scope_id string, name string, start int")
    got = {r["ref_id"]: r["symbol_id"] for r in relations.resolve_lexically(refs, symbols, relations.scope_ancestors(scopes)).collect()}
    assert got == {"r1": "s2", "r2": "s1", "r3": "s3", "r4": "s4"}


def test_relative_specifiers(spark):
    files = spark.createDataFrame([("/w/a/x.ts",), ("/w/b/index.ts",), ("/w/a/y.js",), ("/w/a/z.ts",)], "file string")
    specs = spark.createDataFrame([("/w/a/m.ts", s) for s in ("./x", "../b", "./y.js", "./z.js", "./none", "react", "../a/./x")], "from_file string, spec string")
    got = {r["spec"]: r["target"] for r in relations.resolve_specs(specs, files).collect()}
    assert got == {"./x": "/w/a/x.ts", "../b": "/w/b/index.ts", "./y.js": "/w/a/y.js", "./z.js": "/w/a/z.ts", "./none": None, "react": None, "../a/./x": "/w/a/x.ts"}


def test_python_modules(spark):
    files = spark.createDataFrame([("/w/p/a.py",), ("/w/p/q/__init__.py",), ("/w/top.py",)], "file string")
    specs = spark.createDataFrame([("/w/p/m.py", s) for s in (".a", ".q", "..top", "p.a", ".gone")], "from_file string, spec string")
    got = {r["spec"]: r["target"] for r in relations.resolve_python(specs, files, "/w/").collect()}
    assert got == {".a": "/w/p/a.py", ".q": "/w/p/q/__init__.py", "..top": "/w/top.py", "p.a": "/w/p/a.py", ".gone": None}


def test_structural_matches(spark):
    m = "array<struct<name:string,member_kind:string,param_arity:int,is_optional:boolean,is_static:boolean>>"
    run, opt = ("run", "method", 1, False, False), ("x", "property", None, True, False)
    rows = [("C", "class", False, [run, ("extra", "method", 0, False, False)]), ("D", "class", False, [("run", "method", 0, False, False)]), ("I", "interface", False, [run]), ("O", "interface", False, [opt]), ("T", "interface", True, [run])]
    shapes = spark.createDataFrame(rows, f"owner string, kind string, truncated boolean, members {m}")
    none = spark.createDataFrame([], "owner string, target string")
    got = lambda d: sorted((r["owner"], r["target"]) for r in relations.structural_matches(shapes, d).collect() if r["target"] in "IO")
    assert got(none) == [("C", "I"), ("C", "O"), ("D", "O")]
    assert got(spark.createDataFrame([("C", "I")], "owner string, target string")) == [("C", "O"), ("D", "O")]


def shuffled_rows(spark, run) -> int:
    """Rows that the stages of ``run`` write to shuffles."""
    sc = spark.sparkContext
    store, bus, quantiles = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus(), sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        bus.waitUntilEmpty()
        return {s.stageId(): s.shuffleWriteRecords() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, quantiles, None))}

    # as for tables that are too large to broadcast
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {key: spark.conf.get(key) for key in plain}
    before = max(written(), default=-1)
    try:
        for key, value in plain.items():
            spark.conf.set(key, value)
        run()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    return sum(n for stage, n in written().items() if stage > before)


SHAPES = "owner string, kind string, truncated boolean, members array<struct<name:string,member_kind:string,param_arity:int,is_optional:boolean,is_static:boolean>>"


def test_structural_matches_are_made_without_shuffling_them(spark):
    run = [("run", "method", 0, False, False)]
    shapes = spark.createDataFrame([(f"c{k}", "class", False, run) for k in range(300)] + [(f"i{k}", "interface", False, run) for k in range(300)], SHAPES)
    none, got = spark.createDataFrame([], "owner string, target string"), []
    assert shuffled_rows(spark, lambda: got.append(relations.structural_matches(shapes, none).count())) < 300 * 599 / 10
    assert got == [300 * 599]


def test_undeclared_implementers_are_told_without_shuffling_matches(spark, tmp_path):
    from loomgraph.plans.resolve_queries import QUERIES

    # 200 scopes with a method of one word each: classes and interfaces of one member, read once
    rows = [(f"s{k}", "method", "runIt", f"c{k}", "2024-01-01") for k in range(200)]
    spark.createDataFrame(rows, "id string, kind string, name string, scope_id string, ingested_at string").write.parquet(f"{tmp_path}/symbols.parquet")
    got = []
    assert shuffled_rows(spark, lambda: got.append(QUERIES["ru_undeclared_implementer"](spark, str(tmp_path)).select("message").collect())) < 200 * 200 / 2
    assert len(got[0]) == 200 * 200 and got[0][0]["message"].startswith("implements Ic")


def test_structural_matches_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(relations, "SIDE", 3)
    a, b, option = ("a", "method", 1, False, False), ("b", "method", None, False, True), ("z", "method", 0, True, False)
    kinds = {"A": [a], "B": [b], "AB": [b, a], "O": [option], "N": []}
    shapes = [(f"{n}{k}", "class", False, kinds[n]) for n in kinds for k in range(10)] + [(f"I{n}{k}", "interface", False, kinds[n]) for n in kinds for k in range(8)] + [("A0", "interface", False, [a])]
    needs = {"A": {"a"}, "B": {"b"}, "AB": {"a", "b"}, "O": set()}
    have = {"A": {"a"}, "B": {"b"}, "AB": {"a", "b"}, "O": set(), "N": set()}
    of = lambda o: o.rstrip("0123456789").lstrip("I")
    owners, targets = [s[0] for s in shapes if s[1] == "class"], {s[0] for s in shapes if s[3]}
    declared = [(o, t) for o in owners for t in targets if (len(o) + int(o[-1]) + int(t[-1])) % 4 == 0] + [("A0", "none"), ("none", "A0")]
    wanted = sorted((o, t) for o in owners for t in targets if o != t and needs[of(t)] <= have[of(o)] and (o, t) not in set(declared))
    got = relations.structural_matches(spark.createDataFrame(shapes, SHAPES), spark.createDataFrame(declared * 2, "owner string, target string"))
    assert sorted((r["owner"], r["target"]) for r in got.collect()) == wanted


def test_package_of_takes_the_longest_folder(spark):
    files = spark.createDataFrame([("/w/p/q/a.ts",), ("/w/p/b.ts",), ("/z/c.ts",)], "file string")
    packs = spark.createDataFrame([("/w/p", "p"), ("/w/p/q", "q")], "dir string, package string")
    assert {r["file"]: r["package"] for r in relations.package_of(files, packs).collect()} == {"/w/p/q/a.ts": "q", "/w/p/b.ts": "p", "/z/c.ts": None}


def test_file_delta_and_affordable(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file string, revision string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file string, revision string")
    delta = relations.file_delta(old, new)
    assert {r["file"]: r["change"] for r in delta.collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    assert relations.affordable(delta).first()["affordable"] is False
    assert relations.affordable(delta.limit(0)).first()["affordable"] is True


def test_export_binding(spark):
    b = spark.createDataFrame([("x", "/m.ts", "run", False, False), ("y", "/m.ts", None, True, False), ("z", "/m.ts", None, False, True)], "id string, resolved_module_path string, imported_name string, is_default boolean, is_namespace boolean")
    e = spark.createDataFrame([("/m.ts", "run", "s1"), ("/m.ts", "default", "s2")], "file string, exported_name string, symbol_id string")
    assert {r["id"]: r["export_symbol"] for r in relations.bind_exports(b, e).collect()} == {"x": "s1", "y": "s2", "z": None}


def test_edits(spark):
    sources = spark.createDataFrame([("a", "0123456789"), ("b", "zü→x")], "file string, source string")
    e = spark.createDataFrame([("a", 2, 4, "AB"), ("a", 2, 4, "AB"), ("a", 3, 6, "no"), ("a", 6, 6, "+"), ("b", 1, 3, "")], edits.EDITS)
    assert {r["file"]: r["source"] for r in edits.apply(sources, e).collect()} == {"a": "01AB45+6789", "b": "zx"}
    assert [(r["start"], r["conflict"]) for r in edits.plan(e.filter("file = 'a'")).orderBy("start").collect()] == [(2, False), (3, True), (6, False)]
    assert edits.plan_id(e).count() == 2


def test_export_drops_dangling_edges(spark):
    n = spark.createDataFrame([("b",), ('a"<',)], "id string")
    e = spark.createDataFrame([("b", 'a"<'), ("b", "gone")], "src string, dst string")
    assert {r["line"] for r in export.lines(n, e, "dot").collect()} == {'  n0 [label="a\\"<"];', '  n1 [label="b"];', "  n1 -> n0;"}
    assert any("&quot;&lt;" in r["line"] for r in export.lines(n, e, "graphml").collect())


def test_snapshots(spark, tmp_path):
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert export.read_snapshot(spark, str(tmp_path / "none"), "x") is None
    export.write_snapshot({"edges": e}, str(tmp_path), "x")
    export.write_snapshot({"edges": e.limit(0)}, str(tmp_path), "y")
    assert export.read_snapshot(spark, str(tmp_path), "x")["edges"].count() == 1
    assert export.read_snapshot(spark, str(tmp_path), "z") is None


def test_star_collisions(spark):
    exports = spark.createDataFrame([("b", "x"), ("c", "x"), ("c", "default"), ("b", "default")], "file string, exported_name string")
    stars = spark.createDataFrame([("a", "b"), ("a", "c"), ("top", "a")], "file string, target string")
    got = sorted((r["file"], r["message"].split("'")[1]) for r in rules.no_star_collisions(exports, stars).collect())
    assert got == [("a", "x")]
    assert {(r["file"], r["exported_name"]) for r in rules.star_reach(exports, stars).collect()} == {("a", "x"), ("top", "x")}


def test_layers(spark):
    f = spark.createDataFrame([("src/ui/a.ts",), ("src/core/b.ts",), ("x.ts",), ("src/ui/z.ts",)], "file string")
    got = {r["file"]: (r["layer"], r["ambiguous"]) for r in rules.layer_of(f, {"ui": ["src/ui/**"], "core": ["src/core/**"], "twin": ["src/ui/z*"]}).collect()}
    assert got["src/ui/a.ts"] == ("ui", False) and got["x.ts"] == (None, False) and got["src/ui/z.ts"][1] is True


def test_mixed_exports_and_unused(spark):
    e = spark.createDataFrame([("a", "x", False), ("a", "default", True), ("b", "y", False), ("c", "z", False)], "file string, exported_name string, is_default boolean")
    assert [r["file"] for r in rules.no_mixed_exports(e).collect()] == ["a"]
    used = spark.createDataFrame([("b", "a", "x"), ("a", "a", "default")], "file string, target string, name string")
    stars = spark.createDataFrame([("q", "c")], "file string, target string")
    assert sorted(r["message"] for r in rules.no_unused_exports(e, used, stars).collect()) == ["'default' is not imported", "'y' is not imported"]


def test_budget(spark):
    rows = spark.createDataFrame([(g, i) for g in "ab" for i in range(5)], "g string, i int")
    got = [(r["g"], r["i"]) for r in relations.budget(rows, "g", [F.col("i")], 3, 4, ["b", "a"]).orderBy("g", "i").collect()]
    assert got == [("a", 0), ("b", 0), ("b", 1), ("b", 2)]


def test_nearest_grouping_and_lookup(spark):
    b = spark.createDataFrame([("1", "f", "m", 10), ("2", "f", "m", 52), ("3", "f", "n", 5)], "id string, file string, spec string, start int")
    s = spark.createDataFrame([("f", "m", 8), ("f", "m", 50)], "file string, spec string, start int")
    assert {(r["spec"], r["statement"]) for r in relations.group_to_nearest(b, s).collect()} == {("m", 8), ("m", 50), ("n", 5)}
    sy = spark.createDataFrame([("1", "x", "const", "a", (0, 1)), ("2", "x", "function", "b", (0, 1))], f"id string, name string, kind string, file string, range {R}")
    assert relations.symbol_lookup(sy, "x", "function", limit=1).count() == 0  # the limit comes first
