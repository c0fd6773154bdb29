import hashlib
import random

from pyspark.sql import functions as F

from loomgraph.llm.sampling import merge_state, sample_ids, sample_rows, select

SCHEMA = "id string, w double, max_weight int"


def data(spark, rows):
    return spark.createDataFrame([(i, w, 0) for i, w in rows], SCHEMA)


def chosen(spark, rows, constant=0.3, seed=1, parts=3):
    return {r["id"]: r["max_weight"] for r in sample_ids(data(spark, rows).repartition(parts), "id", F.col("w"), constant, seed).collect()}


def brute(rows, constant, seed):
    best = {}
    for i, w in rows:
        if i is not None:
            w = w if w is not None and w == w and w > 0 else 1.0
            best[i] = max(best.get(i, 0.0), w)
    return {i: w for i, w in best.items() if int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) / 2**52 < w * constant}


def test_brute_force_reruns_partitionings_and_growth(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "", *(f"i{k}" for k in range(300))]), rng.choice([None, float("nan"), -1.0, 0.0, 0.5, 2.0])) for _ in range(800)]
    first, all_ = chosen(spark, rows[:400]), chosen(spark, rows, parts=7)
    assert first == brute(rows[:400], 0.3, 1) and all_ == brute(rows, 0.3, 1) == chosen(spark, rows[::-1], parts=1)
    assert set(first) <= set(all_)
    assert chosen(spark, rows, seed=2) != all_


def test_state_keeps_the_largest_weight(spark):
    a, b = data(spark, [("x", 5.0), ("y", 0.1)]), data(spark, [("x", 0.1), ("z", 9.0)])
    state = merge_state(merge_state(None, a, "id", F.col("w")), b, "id", F.col("w"))
    assert {r["id"]: r["max_weight"] for r in state.collect()} == {"x": 5.0, "y": 0.1, "z": 9.0}
    direct = sample_ids(b, "id", F.col("w"), 0.2, 1, state=merge_state(None, a, "id", F.col("w")))
    assert {r["id"] for r in select(state, 0.2, 1).collect()} == {r["id"] for r in direct.collect()}


def test_all_rows_of_an_id_or_none(spark):
    rows = [("a", 9.0), ("a", 0.0001), ("b", 0.0001), ("b", 0.0001)]
    got = [r["id"] for r in sample_rows(data(spark, rows), "id", F.col("w"), 0.5).collect()]
    assert got.count("a") == 2 and got.count("b") in (0, 2)


def test_edges(spark):
    assert chosen(spark, []) == {}
    assert set(chosen(spark, [("a", 1.0), (None, 1.0)], constant=1.0)) == {"a"}
    assert chosen(spark, [("a", 1.0)], constant=0.0) == {}
