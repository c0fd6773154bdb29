import datetime
import random

import pytest

import __spark_entry__
from loomgraph.operators import graph
from loomgraph.plans import whole_queries as W

Q = __spark_entry__.queries()


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders of small quantities over 14 parts: edges among 1..9 at random, a chain 10 to 13 without importers of 10, a part 14 alone."""
    at, rng = str(tmp_path_factory.mktemp("orders")), random.Random(4)
    lists = [[rng.randrange(1, 10) for _ in range(3)] for _ in range(7)] + [[10, 11, 12, 13]]
    rows = [(o, k, p, 1.0 + k, datetime.datetime(1998, 1, 1)) for o, ps in enumerate(lists) for k, p in enumerate(ps)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_shipdate timestamp_ntz").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 15)], "p_partkey long").write.parquet(f"{at}/part.parquet")
    return at, {(a, b) for ps in lists for a, b in zip(ps, ps[1:]) if a != b}


def lengths(pairs, start):
    """Distance of all that ``start`` reaches."""
    seen, level, k = {start: 0}, {start}, 0
    while level:
        k += 1
        level = {b for a, b in pairs if a in level and b not in seen}
        seen |= dict.fromkeys(level, k)
    return seen


def test_whole_order_graph(spark, orders):
    at, pairs = orders
    rows = lambda name: Q[name](spark, at).collect()
    far = {n: lengths(pairs, n) for n in range(1, 15)}
    group = {n: sorted(m for m in far if m in far[n] and n in far[m]) for n in far}
    assert {(r["src"], r["dst"]) for r in rows("gr_edges_all_parts")} == pairs
    assert {r["members"] for r in rows("gr_cycles_all_parts")} == {",".join(map(str, g)) for g in group.values() if len(g) > 1}
    assert {r["id"]: r["cycle"] for r in rows("gr_cycle_members_coloured_all_parts")} == {n: g[0] for n, g in group.items() if len(g) > 1}
    entries = [n for n in far if n not in {b for _, b in pairs}]
    depth = {n: min((far[e][n] for e in entries if n in far[e]), default=None) for n in far}
    assert {r["id"] for r in rows("gr_dead_modules_all_parts")} == {n for n, d in depth.items() if d is None}
    last = max(d for d in depth.values() if d is not None) + 1
    assert {r["id"]: r["layer"] for r in rows("gr_layering_all_parts")} == {n: last if d is None else d for n, d in depth.items()}
    ends = sorted({b for _, b in pairs}, key=lambda n: (-sum(b == n for _, b in pairs), n))[:2]
    assert {(r["src"], r["dst"]): r["length"] for r in rows("gr_shortest_lengths_all_parts")} == {(n, e): far[n][e] for n in far for e in ends if e in far[n] and any(n in p for p in pairs)}
    assert {r["id"]: r["depth"] for r in rows("gr_impact_up_all_parts")} == {n: min(far[n][e] for e in ends if e in far[n]) for n in far if any(e in far[n] for e in ends)}


def test_depth_is_not_bounded(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(99, 20)], "src int, dst int")
    up = {r["id"]: r["depth"] for r in W.OPERATORS["gr_impact_up"](None, chain).collect()}
    assert up[2] == 18 and max(r["length"] for r in W.OPERATORS["gr_shortest_lengths"](None, chain).collect()) == 20
    assert {r["id"]: r["length"] for r in W.OPERATORS["gr_longest_chain"](None, chain).collect()}[0] == 20
    assert graph.components(chain, 0).count() == 0
