import json

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import rules
from loomgraph.sources import reports, workspace
from loomgraph.streaming import versions


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_words_and_casing(spark):
    assert one(spark, T.words_of(F.col("a")), a="XMLParser") == ["xml", "parser"]
    assert one(spark, T.words_of(F.col("a")), a="user_dataStore") == ["user", "data", "store"]
    assert one(spark, T.matches_casing(F.col("a"), ["camelCase"]), a="__runIt") is True
    assert one(spark, T.matches_casing(F.col("a"), ["camelCase"]), a="___") is False
    assert one(spark, T.matches_casing(F.col("a"), []), a="-") is True
    assert one(spark, T.to_casing(F.col("a"), "SCREAMING_SNAKE_CASE"), a="_maxSize") == "_MAX_SIZE"
    assert one(spark, T.to_casing(F.col("a"), "camelCase"), a="max-size") == "maxSize"
    assert one(spark, T.to_casing(F.col("a"), "camelCase"), a="__") is None


def test_lines_and_columns(spark):
    src = "ab\ncdé\n→x"
    assert one(spark, T.loc(F.col("a")), a=src) == 3 and one(spark, T.loc(F.col("a")), a="") == 0 and one(spark, T.loc(F.col("a")), a="x\n") == 1
    assert one(spark, T.line_of(F.col("a"), F.lit(8)), a=src) == 3 and one(spark, T.column_of(F.col("a"), F.lit(8)), a=src) == 2


def test_search_scores(spark):
    s = lambda q, *c: one(spark, T.search_score([F.lit(x) for x in c], q), a=1)
    assert s("run", "run") == 120 and s("run", "runner") == 90 and s("run", "a.run") == 80 and s("run", "a.runner") == 70 and s("run", "overrun") == 60
    assert s("run zzz", "run") is None and s("", "x") == 1 and s("run a", "run", "a/b") == 210


def test_globs():
    import re

    ok = lambda g, p: bool(re.fullmatch(T.glob_regex(g), p))
    assert ok("src/**/*.ts", "src/a/b/c.ts") and ok("src/**/*.ts", "src/c.ts") and not ok("src/*.ts", "src/a/c.ts")
    assert ok("**/{a,b}?.js", "x/b1.js") and ok("[!a].py", "b.py") and not ok("[!a].py", "a.py") and ok("**", ".hidden/x")


def test_small_functions(spark):
    assert one(spark, T.dist_to_source(F.col("a")), a="./dist/x.d.ts") == "./src/x.ts"
    assert one(spark, T.label(F.col("a")), a="  a b/c ") == "a_b_c" and one(spark, T.label(F.col("a")), a="..") is None
    assert one(spark, T.escape_regex(F.col("a")), a="a.b*") == "a\\.b\\*"
    assert one(spark, T.language_of(F.col("a")), a="x.jsx") == "tsx" and one(spark, T.language_of(F.col("a")), a="x.md") is None
    assert one(spark, T.symbol_uri("sym", F.col("a")), a="a b") == "sym:a%20b"
    assert one(spark, T.name_matches(F.col("a"), "run"), a="x.run") is True


def test_forbidden_words(spark):
    f = spark.createDataFrame([("a.ts", "const userData = 1;\n  function dataStore() {}\n// data\nlet database;"), ("b.py", "def load_data():\n    x = 1\n"), ("c.ts", "")], "file string, source string")
    got = sorted((r["file"], r["line"], r["col"]) for r in rules.forbidden_words(f, ["data"]).collect())
    assert got == [("a.ts", 1, 7), ("a.ts", 2, 12), ("b.py", 1, 5)]


def test_rule_targets_and_check(spark):
    f = spark.createDataFrame([("src/a.ts",), ("src/a.tsx",), ("src/gen/b.ts",), ("x.py",)], "file string")
    rule = [{"id": "r", "targets": [{"include": ["src/**"], "language": "typescript"}, {"include": ["**/*"], "language": "tsx"}], "exclude": ["**/gen/**"]}]
    assert sorted((r["target"], r["file"]) for r in workspace.rule_targets(f, rule).collect()) == [(0, "src/a.ts"), (0, "src/a.tsx"), (1, "src/a.tsx")]
    s = spark.createDataFrame([("a", "x"), ("b", "")], "file string, source string")
    assert workspace.rule_check(s, lambda file, source: [("empty", file, "is empty", 1, 1)] if not source else []).count() == 1


def test_packages(spark):
    m = lambda d: json.dumps(d)
    manifests = spark.createDataFrame([("/w/a/package.json", m({"name": "a", "main": "./dist/main.js"})), ("/w/b/package.json", m({"name": "b", "exports": {".": {"import": "./dist/gone.js"}}})), ("/w/c/package.json", m({"main": "x"})), ("/w/d/package.json", m({"name": "a", "main": "dist/main.js"}))], "file string, source string")
    files = spark.createDataFrame([("/w/a/src/main.ts",), ("/w/b/src/index.ts",), ("/w/d/src/main.ts",)], "file string")
    assert {r["name"]: r["entry"] for r in workspace.packages(manifests, files).collect()} == {"a": "/w/d/src/main.ts", "b": "/w/b/src/index.ts"}


def test_source_files_and_overlays(spark, tmp_path):
    (tmp_path / "a.ts").write_text("one")
    got = workspace.read_sources(spark, str(tmp_path))
    o = spark.createDataFrame([(str(tmp_path / "a.ts"), "two")], "file string, source string")
    assert [r["source"] for r in workspace.with_overlays(got, o).collect()] == ["two"]
    assert versions.to_extract(got, got).count() == 0
    (tmp_path / "loomgraph.toml").write_text("[rules]\nmax = 3\n")
    assert workspace.read_config(str(tmp_path))["rules"]["max"] == 3


def test_reports(spark):
    text = lambda v: spark.createDataFrame([(v,)], "value string")
    e = reports.eslint(text(json.dumps([{"filePath": "a.js", "messages": [{"ruleId": "no-x", "severity": 2, "message": "m", "line": 3, "column": 1}]}]))).first()
    assert (e["rule_id"], e["file"], e["line"], e["severity"], e["end_line"]) == ("no-x", "a.js", 3, "error", None)
    r = reports.ruff(text(json.dumps([{"code": "F401", "message": "m", "filename": "a.py", "location": {"row": 1, "column": 2}, "end_location": {"row": 1, "column": 4}}]))).first()
    assert (r["rule_id"], r["line"], r["end_col"]) == ("F401", 1, 4)
    v = reports.vulture(spark.createDataFrame([("a.py:3: unused function 'f' (60% confidence)",), ("noise",)], "value string"), 50).collect()
    assert [(x["rule_id"], x["file"], x["line"]) for x in v] == [("unused-function", "a.py", 3)]
    b = reports.biome(text(json.dumps({"diagnostics": [{"category": "lint/x", "severity": "error", "description": "d", "location": {"path": {"file": "a.ts"}, "span": [3, 5]}}]})), spark.createDataFrame([("a.ts", "ab\ncd")], "file string, source string")).first()
    assert (b["line"], b["col"]) == (2, 1)


def test_streams_keep_the_newest(spark, tmp_path):
    rows = [("a", 2, "y"), ("a", 1, "late"), ("b", 1, "z")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "file string, version int, text string").write.parquet(str(tmp_path / f"in/part{k}"))
    schema = "file string, version int, text string"
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = versions.keep_newest(s, ["file"], [F.col("version")])
    assert {r["file"]: r["text"] for r in got.collect()} == {"a": "y", "b": "z"}


def test_upserts_and_supersession(spark):
    store = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "file string, x int")
    got = versions.upsert_by_file(store, spark.createDataFrame([("a", 9)], "file string, x int"))
    assert sorted((r["file"], r["x"]) for r in got.collect()) == [("a", 9), ("b", 3)]
    q = spark.createDataFrame([(1, "k"), (2, "k"), (3, "m")], "request_id int, key string")
    assert {r["request_id"]: r["superseded"] for r in versions.superseded(q).collect()} == {1: True, 2: False, 3: False}
    asked = spark.createDataFrame([("a", 1), ("b", 1), ("c", 7)], "file string, asked int")
    opened = spark.createDataFrame([("a", 1), ("b", 2)], "file string, version int")
    assert {r["file"]: r["current"] for r in versions.overlay_is_current(asked, opened).collect()} == {"a": True, "b": False, "c": True}


def test_queries_have_sql_or_say_why(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names
    without = {n for n in names - set(e.oracle_sql()) if not n.startswith("p")}
    # queries over all edges go deeper than recursive SQL can follow
    assert {n for n in without if "_all_" not in n and not n.startswith("ex_")} <= {"ru_forbidden_words", "jn_python_modules", "jn_script_modules"}
