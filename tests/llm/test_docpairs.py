from loomgraph.llm.docpairs import deep_tokens, documentation, pairs, tokens

PY = '''# Counts what the reader has seen so far.
@cached
@traced(
    "x",
)
def above(a):
    return a

def inside(a: dict[str, int],
           b=")"):
    # a comment first
    r"""Tells whether anything is left."""
    return a

def run_all():
    """Runs all."""

def todo():
    """TODO: write this"""

def later():
    _ = 1
    """Not documentation, as it comes second."""

def formatted():
    f"""Not a constant {1}, so no documentation."""

# Broken off by a blank line.

def broken():
    return 1

class K:
    # noqa: C901
    def method(self):
        """
        :param x: the number to use
        """

    # return method(self)
    def code(self): pass
x = 1  # behind code, not above
def behind(): pass
'''
TS = '''/**
 * Keeps the newest of both.
 */
export const keep = (a) => { return `}${a ? '{' : "}"}`; };

/** @deprecated */
function old() {}
class A {
  /**
   * @param a
   * @returns
   */
  tags(a) { return /[({]/.test(a); }

  // eslint-disable-next-line complexity
  // Only the nearest is kept.
  @checked private both(a) {}
  /** openRecord */
  openRecord() {}
}
// ----------------
function ruler() {}
'''


def run(spark, files, extra=()):
    contexts, symbols = [], []
    for path, source, names in files:
        contexts.append((path, 1, source, 5))
        for kind, name, mark in names:
            at = source.index(mark)
            symbols.append((f"{path}:{name}", kind, name, path, (at, at + len(mark)), 7))
    c = spark.createDataFrame(contexts + list(extra), "file_path string, version int, source string, place int")
    s = spark.createDataFrame(symbols * 2 + [(None, "function", "x", "a.py", (0, 1), 7), ("n", None, "x", "a.py", (0, 1), 7), ("gone", "method", "x", "none.ts", (0, 1), 7), ("nofile", "method", "x", None, (0, 1), 7), ("norange", "method", "x", "a.py", None, 7)], "id string, kind string, name string, file string, range struct<start:int,end:int>, begin int")
    return c, s


def found(spark, files, extra=()):
    return {r["symbol_id"].split(":")[1]: r["documentation"] for r in documentation(*run(spark, files, extra)).collect()}


PY_NAMES = [("function", n, f"def {n}") for n in ("above", "inside", "run_all", "todo", "later", "formatted", "broken", "behind")] + [("method", n, f"def {n}") for n in ("method", "code")]
TS_NAMES = [("function", "keep", "keep ="), ("function", "old", "function old"), ("method", "tags", "tags(a)"), ("method", "both", "private both"), ("method", "openRecord", "openRecord() {"), ("function", "ruler", "function ruler")]


def test_python(spark):
    got = found(spark, [("a.py", PY, PY_NAMES)])
    assert set(got) == {"above", "inside", "method"}
    assert got["above"] == "Counts what the reader has seen so far." and got["method"] == "the number to use"


def test_scripts(spark):
    got = found(spark, [("a.ts", TS, TS_NAMES)])
    assert set(got) == {"keep", "both"} and got["both"] == "Only the nearest is kept."


def test_newest_version_and_line_ends(spark):
    old = [("b.py", 0, PY.replace("Counts", "Drops"), 5), ("c.py", 2, None, 5), (None, 1, "x", 5), ("d.ts", 1, "", 5)]
    got = found(spark, [("b.py", PY.replace("\n", "\r\n"), PY_NAMES)], old)
    assert set(got) == {"above", "inside", "method"} and got["above"].startswith("Counts")


def test_pairs_hold_the_code(spark):
    got = {r["symbol_id"]: r for r in pairs(*run(spark, [("a.ts", TS, TS_NAMES)])).collect()}
    assert got["a.ts:keep"]["code"] == "keep =" and got["a.ts:keep"]["documentation"] == "Keeps the newest of both."


def test_tokens_add_up_to_the_source(spark):
    sources = [("a.py", PY), ("a.ts", TS), ("e.ts", "x = 'open\n`never closed ${a"), ("f.py", '"""open'), ("g.ts", "é→" * 3 + "/* open"), ("h.ts", "a" * 200000 + "\"" + "b" * 100000)]
    df = spark.createDataFrame(sources, "file_path string, source string")
    by = {}
    for r in tokens(df).union(deep_tokens(df)).orderBy("file_path", "place").collect():
        by[r["file_path"]] = by.get(r["file_path"], "") + r["token"]
    assert by == dict(sources)


def test_empty_tables(spark):
    c, s = run(spark, [("a.py", PY, PY_NAMES)])
    assert documentation(c.limit(0), s).count() == 0 and documentation(c, s.limit(0)).count() == 0


DEEP = [
    "const x = `a${f({b: {c: 1}})}d`;\n", "const x = `a${f({b: {c: {d: `e${{f: {g: `h${`i${j}`}`}}}`}}})}d`;\n", "const x = `a${f({b: {c: '}`'}})}d`;\n", "const x = `a${/* it's ` */ b}d`;\n",
    "const x = `a${b.map((q) => { if (q) { return `c${{d: {e: 1}}}`; } })}d`, y = `\\`${`$`}`;\n",
]


def test_templates_of_any_depth_keep_what_follows(spark):
    after = "/** Keeps the newest of both. */\nfunction keep(a) { return a; }\n"
    files = [(k, f"d{k}.ts", 1, text + after) for k, text in enumerate(DEEP)]
    c = spark.createDataFrame(files, "context_id long, file_path string, version int, source string")
    s = spark.createDataFrame([(f"s{k}", "function", "keep", f"d{k}.ts", (len(text) + after.index("function"), len(text + after) - 1)) for k, text in enumerate(DEEP)], "id string, kind string, name string, file string, range struct<start:int,end:int>")
    assert {r["symbol_id"]: r["documentation"] for r in documentation(c, s).collect()} == {f"s{k}": "Keeps the newest of both." for k in range(len(DEEP))}
    f = c.select("file_path", "source")
    lexed = tokens(f).union(deep_tokens(f)).orderBy("file_path", "place").collect()
    for _, path, _, source in files:
        assert "".join(r["token"] for r in lexed if r["file_path"] == path) == source


def test_both_lexers_agree(spark):
    from loomgraph.llm.docpairs import lexed_by_stack

    c = spark.createDataFrame([("a.ts", TS), ("b.ts", "const a = `b${c}` / 2, d = /[`]/;\n// it's `x\nf('`');\n"), ("c.js", "")], "file_path string, source string")
    rows = tokens(c).orderBy("file_path", "place").collect()
    for path, source in (("a.ts", TS), ("b.ts", c.filter("file_path = 'b.ts'").first()["source"]), ("c.js", "")):
        assert [r["token"] for r in rows if r["file_path"] == path] == lexed_by_stack(source)
