from pyspark.sql import functions as F

from loomgraph.operators import edits, fixes
from loomgraph.sources import cache

SOURCE = "export interface A<T> { a: T }\ninterface B extends A<1> { b: 1 }\nexport const f = 1, g = 2;\nexport async function h() {}\nexport default class K {}\n"


def symbols(spark, *names):
    words = {"A": "interface", "B": "interface", "h": "function", "K": "class", "f": "f"}
    rows = []
    for n in names:
        a = SOURCE.index(f"{words[n]} {n}" if words[n] != n else f"{n} =")
        rows.append(("a.ts", n, (a, SOURCE.index("\n", a))))
    return spark.createDataFrame(rows, "file string, name string, range struct<start:int,end:int>")


def test_fixes(spark):
    src = spark.createDataFrame([("a.ts", SOURCE), ("b.ts", None)], "file string, source string")
    done = lambda e: edits.apply(src, e).filter("file = 'a.ts'").first()["source"]
    assert done(fixes.interfaces_to_types(symbols(spark, "A", "B"), src)) == SOURCE.replace("interface A<T> {", "type A<T> = {")
    got = done(fixes.without_export(symbols(spark, "A", "h", "K", "f"), src))
    assert got == SOURCE.replace("export interface", "interface").replace("export async", "async").replace("export const f", "const f")


def test_fix_modes(spark):
    modes = fixes.fix_modes([("a", "error", "auto"), ("a", "off", "auto"), ("b", "warn", None), ("c", "warn", "auto"), ("d", "error", "none")])
    assert modes == {"a": "never", "b": "manual", "c": "auto", "d": "never"}
    v = spark.createDataFrame([(r,) for r in "abcdx"], "rule_id string")
    assert sorted(r[0] for r in fixes.fixable(v, modes, "manual").collect()) == ["b", "x"] and fixes.fixable(v, modes, "auto").count() == 1


def test_edits_with_repeats_and_gaps(spark):
    rows = [("a", 0, 3, "x"), ("a", 0, 3, "x"), ("a", 2, 4, "y"), ("a", 3, 3, "i"), ("a", 3, 3, "j"), ("a", 4, None, "z"), (None, 1, 2, "n"), ("b", 1, 2, "n")]
    e = spark.createDataFrame(rows, "file string, start int, end int, text string")
    got = [(r["file"], r["start"], r["text"], r["conflict"]) for r in edits.plan(e).orderBy(F.col("file").asc_nulls_first(), "start", "end", "text").collect()]
    assert got == [(None, 1, "n", False), ("a", 0, "x", False), ("a", 2, "y", True), ("a", 3, "i", False), ("a", 3, "j", True), ("b", 1, "n", False)]
    assert edits.plan(e.limit(0)).count() == 0


def test_warm_cache(spark, tmp_path):
    facts = {"symbols": spark.createDataFrame([("a", 1), ("b", 2)], "file string, x int")}
    files = spark.createDataFrame([("a", "r1"), ("b", "r1")], "file string, revision string")
    env, path = cache.environment(tool="x", level=1), str(tmp_path / "c")
    assert cache.restore(spark, files, path, env, ["symbols"])[1].count() == 2
    cache.persist(facts, files, path, env)
    now = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("c", "r1")], files.schema)
    kept, left = cache.restore(spark, now, path, env, ["symbols"])
    assert [r["file"] for r in kept["symbols"].collect()] == ["a"] and sorted(r["file"] for r in left.collect()) == ["b", "c"]
    assert cache.restore(spark, now, path, cache.environment(tool="y", level=1), ["symbols"])[0] == {}


def test_baselines(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text('{"nodes": [{"path": "x"}, {"path": "y"}], "edges": [{"from": "x", "to": "y"}, {"from": "x", "to": "y"}]}')
    b.write_text('{"schemaVersion": 1, "graph": {"nodes": ["x"], "edges": []}}')
    nodes, edges = cache.baseline(spark, str(a))
    assert sorted(r["id"] for r in nodes.collect()) == ["x", "y"] and [tuple(r) for r in edges.select("src", "dst").collect()] == [("x", "y")]
    nodes, edges = cache.baseline(spark, str(b))
    assert [r["id"] for r in nodes.collect()] == ["x"] and edges.count() == 0
