import random
from collections import Counter, defaultdict

from loomgraph.operators.skew import hot_keys, key_profiles, weighted_values

SCHEMA = "k string, v string, key_value int, weight int"


def profile(spark, rows, percentiles=()):
    df = spark.createDataFrame([(k, v, 0, 0) for k, v in rows], SCHEMA)  # the last columns clash with the operator's names
    return {r["key_value"]: r for r in key_profiles(weighted_values(df, "k", "v"), percentiles).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else rng.choice("abcdef"), rng.choice(["x", "y", "z", None, ""])) for _ in range(2000)]
    rows += [(None, "x")] * 50 + [("", "q")] * 7
    by = defaultdict(list)
    for k, v in rows:
        if k is not None:
            by[k].append(v)
    got = profile(spark, rows, (0.5,))
    assert set(got) == set(by)
    for k, vs in by.items():
        n = Counter(v for v in vs if v is not None)
        mode = min(n, key=lambda v: (-n[v], v)) if n else None
        assert (got[k]["n_rows"], got[k]["n_distinct"], got[k]["mode_value"], got[k]["mode_rows"]) == (len(vs), len(n), mode, n[mode] if n else None)


def test_null_values_only(spark):
    got = profile(spark, [("a", None), ("a", None)], (0.5,))
    assert (got["a"]["n_rows"], got["a"]["n_distinct"], got["a"]["mode_value"], got["a"]["weight_percentiles"]) == (2, 0, None, None)


def test_empty(spark):
    assert profile(spark, [], (0.5,)) == {}
    assert hot_keys(key_profiles(weighted_values(spark.createDataFrame([], SCHEMA), "k", "v"))).count() == 0


def test_hot_keys_count_repeated_rows(spark):
    rows = [("hot", "x")] * 2 + [(f"k{i}", "x") for i in range(98)] + [(None, "x")] * 100
    df = spark.createDataFrame([(k, v, 0, 0) for k, v in rows], SCHEMA)
    assert [r["key_value"] for r in hot_keys(key_profiles(weighted_values(df, "k", "v")), 0.02).collect()] == ["hot"]


def test_second_grouping_moves_one_row_a_key_and_task(spark):
    df = spark.range(100000).selectExpr("'hot' as k", "cast(id as string) as v")
    plan = key_profiles(weighted_values(df, "k", "v"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect" not in plan
