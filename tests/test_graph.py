import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgraph.operators import graph

E = "src string, dst string"
TOPOLOGIES = {
    "chain": ["ab", "bc"], "diamond": ["ab", "ac", "bd", "cd"], "cycle2": ["ab", "ba"],
    "tail": ["ca", "ab", "ba"], "two": ["ab", "ba", "cd", "de", "ec"],
}


def edges(spark, name):
    return spark.createDataFrame([tuple(e) for e in (TOPOLOGIES[name] if isinstance(name, str) else name)], E)


def nodes(spark, text):
    return spark.createDataFrame([(c,) for c in text], "id string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("name, all_, entries, dead", [("chain", "abc", ["a"], []), ("diamond", "abcd", ["a"], []), ("cycle2", "ab", [], ["a", "b"]), ("tail", "abc", ["c"], [])])
def test_entries_and_dead_modules(spark, name, all_, entries, dead):
    assert ids(graph.entry_points(nodes(spark, all_), edges(spark, name))) == entries
    assert ids(graph.dead_modules(nodes(spark, all_), edges(spark, name))) == dead


def test_unknown_entries_are_ignored(spark):
    e, n = edges(spark, "chain"), nodes(spark, "abc")
    assert ids(graph.dead_modules(n, e, nodes(spark, "bx"))) == ["a"]
    assert ids(graph.dead_modules(n, e, nodes(spark, ""))) == []


def test_reach_depth_and_direction(spark):
    e = edges(spark, "diamond")
    of = lambda d, k=None: {r["id"]: r["depth"] for r in graph.reach(e, nodes(spark, "d" if d == "up" else "a"), d, k).collect()}
    assert of("down") == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert of("down", 1) == {"a": 0, "b": 1, "c": 1}
    assert of("down", 0) == of("down", -3) == {"a": 0}
    assert of("up") == {"d": 0, "b": 1, "c": 1, "a": 2}
    assert {r["id"] for r in graph.reach(edges(spark, "tail"), nodes(spark, "b"), "both").collect()} == set("abc")


def test_layers_put_the_unreached_last(spark):
    got = {r["id"]: r["layer"] for r in graph.layers(nodes(spark, "abcxy"), edges(spark, ["ab", "bc", "xy", "yx"])).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": 3, "y": 3}


@pytest.mark.parametrize("small", [True, False])
def test_components(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(graph, "SMALL_EDGES", 0)
    got = sorted((r["size"], r["members"]) for r in graph.cycles(graph.components(edges(spark, "two"))).collect())
    assert got == [(2, ["a", "b"]), (3, ["c", "d", "e"])]
    assert {r["size"]: r["n_cycles"] for r in graph.size_histogram(graph.components(edges(spark, "two"))).collect()} == {2: 1, 3: 1}
    assert graph.components(edges(spark, "chain")).count() == 0
    assert graph.components(edges(spark, [])).count() == 0


def brute_components(pairs):
    ns = sorted({x for p in pairs for x in p})
    to = {n: {n} for n in ns}
    for _ in ns:
        for a, b in pairs:
            for n in ns:
                if a in to[n]:
                    to[n].add(b)
    return {n: min(m for m in ns if m in to[n] and n in to[m]) for n in ns if any(m != n and m in to[n] and n in to[m] for m in ns)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=18))
def test_components_are_mutual_reachability(spark, pairs):
    df = spark.createDataFrame([p for p in pairs], "src int, dst int")
    assert {r["id"]: r["cycle"] for r in graph.components(df).collect()} == brute_components({p for p in pairs if p[0] != p[1]})


def test_coloured_components_at_random(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_EDGES", 0)
    rng = random.Random(5)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(20)}
    df = spark.createDataFrame(list(pairs), "src int, dst int")
    assert {r["id"]: r["cycle"] for r in graph.components(df).collect()} == brute_components({p for p in pairs if p[0] != p[1]})


def test_topological_levels_leave_cycles_without(spark):
    got = {r["id"]: r["level"] for r in graph.topological_levels(edges(spark, ["ab", "bc", "xy", "yx", "zx"]), nodes(spark, "abcxyz")).collect()}
    assert got == {"c": 0, "b": 1, "a": 2, "x": None, "y": None, "z": None}


def test_longest_chain(spark):
    assert {r["id"]: r["length"] for r in graph.longest_from(edges(spark, ["ab", "bc", "ac", "cd"])).collect()} == {"a": 3, "b": 2, "c": 1, "d": 0}
    tail = edges(spark, "tail")
    assert {r["id"]: r["length"] for r in graph.longest_from(graph.condensed(tail, graph.components(tail))).collect()} == {"c": 1, "a": 0}


def test_paths(spark):
    e = edges(spark, ["ab", "bd", "ac", "cd", "ad", "de"])
    pair = spark.createDataFrame([("a", "d"), ("a", "a"), ("e", "a")], E)
    got = [(r["src"], r["dst"], "".join(r["path"]), r["place"]) for r in graph.simple_paths(e, pair, 3, 2).orderBy("src", "dst", "place").collect()]
    assert got == [("a", "a", "a", 1), ("a", "d", "ad", 1), ("a", "d", "abd", 2)]
    assert {(r["src"], r["dst"]): r["length"] for r in graph.shortest_lengths(e, pair, 3).collect()} == {("a", "d"): 1, ("a", "a"): 0}


def test_diff_of_a_graph_with_itself_is_empty(spark):
    e = edges(spark, "two")
    assert graph.diff(e, e, ["src", "dst"]).count() == 0
    got = sorted((r["src"] + r["dst"], r["change"]) for r in graph.diff(edges(spark, "chain"), edges(spark, "cycle2"), ["src", "dst"]).collect())
    assert got == [("ba", "added"), ("bc", "removed")]


def test_canonical_ids(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("n", None)], "id string, next string")
    got = {r["id"]: r["canonical"] for r in graph.canonical_ids(links, 6).collect()}
    assert (got["a"], got["b"], got["c"]) == ("d", "d", "d")
    assert got["x"] == got["y"] == "x" and "s" not in got and "n" not in got


def test_module_graph_and_edge_info(spark):
    b = spark.createDataFrame([("a", "b", "static"), ("a", "b", "dynamic"), ("a", "a", None), ("a", "gone", None), ("a", None, None)], "src string, dst string, style string")
    i = spark.createDataFrame([("b", "c")], E)
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    assert sorted((r["src"], r["dst"]) for r in graph.module_graph(b, i, files).collect()) == [("a", "b"), ("b", "c")]
    got = {(r["src"], r["dst"]): (r["binding_count"], r["kind"]) for r in graph.edge_info(b.filter("dst = 'b'"), i).collect()}
    assert got == {("a", "b"): (2, "dynamic"), ("b", "c"): (0, "side_effect")}


def test_instability_leaves_out_isolated_nodes(spark):
    assert {r["id"]: r["instability"] for r in graph.instability(edges(spark, "chain")).collect()} == {"a": 1.0, "b": 0.5, "c": 0.0}
