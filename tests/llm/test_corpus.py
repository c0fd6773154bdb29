import random

import pytest

from loomgraph.llm.mixing import Leaf, budgets, divide, largest_total, mix, shares
from loomgraph.llm.packing import fill, fill_documents, pack, summary
from loomgraph.llm.tokens import count, encoding
from loomgraph.llm.reading import BANDS, levels

LIMITS = [("s", 8), ("m", 32), ("l", 64)]


def test_tokens_round_trip():
    text = "Don't split   naïve 漢字 <|endoftext|> x = 1\n\n"
    assert encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").decode(encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary(text)) == text
    assert count(None) is None and count("") == 0


def test_pack_is_near_the_bound_and_respects_room():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    placed = pack(sizes, [8, 32, 64])
    used = {}
    for (k, c), s in zip(placed, sizes):
        used.setdefault((k, c), 0)
        used[k, c] += s
    assert all(u <= c for (_, c), u in used.items()) and sum(used.values()) / sum(c for _, c in used) > 0.97
    assert all(c == min(x for x in (8, 32, 64) if x >= u) for (_, c), u in used.items())  # downsized
    assert pack([], [8]) == [] and pack([3], [8, 32]) == [(0, 8)]


def test_capacities_are_chosen_by_cost():
    placed = pack([30] * 4, [32, 64])
    assert {c for _, c in placed} == {32} or sum({k: c for k, c in placed}.values()) == 128
    dear = pack([8] * 8, [8, 64], {8: 1.0, 64: 100.0})
    assert {c for _, c in dear} == {8}


def test_fill(spark):
    rows = [(1, 5, 0), (2, 200, 0), (3, 0, 0), (4, None, 0), (5, 64, 0), (6, 20, 0), (6, 20, 0), (None, 3, 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, piece int")
    got = fill(df.select("doc_id", "n_tokens"), LIMITS, block_items=4).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
    assert sorted(by[2]) == [(0, 64), (64, 64), (128, 64), (192, 8)] and 3 not in by and 4 not in by and len(by[6]) == 2 and by[None] == [(0, 3)]
    rooms = {}
    for r in got:
        rooms.setdefault((r["container_id"], r["capacity_tokens"]), 0)
        rooms[r["container_id"], r["capacity_tokens"]] += r["n_tokens"]
    assert all(u <= c for (_, c), u in rooms.items())
    assert fill(df.select("doc_id", "n_tokens").limit(0), LIMITS).count() == 0
    with pytest.raises(ValueError):
        fill(df, [("x", None), ("y", 0)])


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_tokens int")


def test_fill_documents(spark):
    limits = spark.createDataFrame(LIMITS, "container_kind string, capacity_tokens int")
    d = documents(spark, [(1, "one two three", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "word " * 500, "de", "b")])
    total = summary(fill_documents(d, limits)).groupBy().sum("n_tokens").first()[0]
    assert total == count("one two three") + count("word " * 500)


def test_divide():
    assert divide(10, [1, 1], [100, 100]) == [5, 5]
    assert divide(10, [1, 1], [2, 100]) == [2, 8]
    assert divide(10, [1, 0], [4, 3]) == [4, 3]
    assert divide(10, [0, 0], [4, 4]) == [4, 4] and divide(0, [1], [5]) == [0] and divide(5, [], []) == []


def test_shortage_goes_to_siblings_first():
    a, b, c = Leaf("d", "en", "a", 0.25, 10, 1), Leaf("d", "en", "b", 0.25, 1000, 1), Leaf("e", "en", "c", 0.5, 1000, 1)
    got = budgets([a, b, c], 100)
    assert got == {a: 10, b: 40, c: 50}
    assert budgets([a, b, c], 3000)[c] == 1000
    assert largest_total([a, b, c]) == 40


def test_mix_reaches_its_shares_whatever_the_ranges(spark):
    from loomgraph.llm import mixing

    rng = random.Random(3)
    rows = [(k, "word " * rng.randint(1, 30), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b"])) for k in range(600)]
    rows += [(9001, None, "en", "a"), (9002, "", "en", "b"), (9003, "other source", "en", "z"), (None, "no id", "en", "a"), (9004, "null source", "en", None)]
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.5, 3), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    domains = {"a": "x", "b": "y", "absent": "y"}
    d = documents(spark, rows)
    first = mix(d, targets, domains=domains)
    got = {r["source"]: r for r in shares(first, targets.filter("source is not null")).collect()}
    assert abs(got["a"]["reached_share"] - 0.4) < 0.02 and abs(got["b"]["reached_share"] - 0.6) < 0.02 and got["absent"]["n_tokens"] == 0
    assert got["a"]["most_uses"] == 1 and got["b"]["most_uses"] <= 3
    key = lambda df: sorted((r["doc_id"], r["uses"]) for r in df.collect())
    sizes = mixing.sized(d, ["a", "b", "absent"])
    leaves = mixing.leaves_of(sizes, mixing.targets_of(targets), domains)
    plan = budgets(leaves, largest_total(leaves))
    assert key(first) == key(mixing.chosen(sizes, plan, range_rows=7)) == key(mixing.chosen(sizes.repartition(5), plan, range_rows=100000))
    assert mix(d.limit(0), targets).count() == 0


def reading_tables(spark):
    easy = ["the cat can run.", "a dog is red.", "we see the cat.", "you can see it run."]
    hard = ["notwithstanding epistemological considerations, the counterfactual commensurability of heterogeneous taxonomies remains indeterminate.", "an exhaustive enumeration of phenomenological preconditions circumscribes interprocedural accountability."]
    samples = spark.createDataFrame([(k, 1, " ".join(easy)) for k in range(8)] + [(50 + k, 4, " ".join(hard)) for k in range(8)] + [(99, None, "x y z")], "sample_id int, band int, text string")
    rows = [(k, " ".join(easy), "en") for k in range(40)] + [(100 + k, " ".join(hard), "en") for k in range(6)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "```\ncode only here\n```\n| a | b |", "en"), (203, hard[0] + " " + easy[0] + " " + hard[1], None), (204, (easy[0] + " ") * 3000, "de"), (None, "no id at all here", "en"), (205, hard[0], "en"), (205, hard[0], "en")]
    return spark.createDataFrame([(i, t, lang, 0) for i, t, lang in rows], "doc_id long, text string, lang string, band int"), samples


def test_levels(spark):
    d, s = reading_tables(spark)
    got = {r["doc_id"]: r for r in levels(d, s).collect()}
    assert got[3]["band"] == 1 and got[103]["band"] == 4 and got[203]["band"] == 4 and got[204]["band"] == 1 and got[205]["band"] == 4
    assert got[200]["band"] is None and got[201]["band"] is None and got[202]["band"] is None and None not in got
    assert got[103]["coverage_rank"] > got[3]["coverage_rank"] and abs(sum(got[203][f"share_{b}"] for b in BANDS) - 1) < 1e-3
    assert levels(d.limit(0), s).count() == 0
    assert len(got) == 40 + 6 + 6


def test_each_language_has_its_list(spark, monkeypatch):
    d, s = reading_tables(spark)
    easy, hard = "der hund ist rot. die katze kann laufen.", "unbeschadet erkenntnistheoretischer erwägungen verbleibt gegenständliche vergleichbarkeit unbestimmt."
    more = [(300 + k, easy, "de", 0) for k in range(30)] + [(400, hard, "de", 0), (401, easy, None, 0)]
    d = d.union(spark.createDataFrame(more, d.schema))
    got = {r["doc_id"]: r for r in levels(d, s).collect()}
    assert got[300]["coverage_rank"] < got[400]["coverage_rank"] < 100 and got[401]["coverage_rank"] < 100
    monkeypatch.setattr("loomgraph.llm.reading.RANKED", 4)
    assert {r["doc_id"]: r for r in levels(d, s).collect()} == got


def test_the_container_to_open_is_chosen_by_cost_for_each():
    sizes = sorted([60, 8, 7, 8, 40, 30, 5], reverse=True)
    costs = {8: 9.0, 32: 50.0, 64: 70.0}
    placed = pack(sizes, [8, 32, 64], costs)
    total = sum(costs[c] for c in dict(placed).values())
    assert {8, 64} <= set(dict(placed).values()) and total <= 70 * 3  # no packing into the largest alone is cheaper
    room = {}
    for (k, c), s in zip(placed, sizes):
        room[k] = room.get(k, c) - s
    assert min(room.values()) >= 0


def test_shortages_go_to_siblings_before_others():
    from loomgraph.llm.mixing import Leaf, budgets, largest_total

    leaves = [Leaf("a", "en", "x", 0.25, 10, 1), Leaf("a", "en", "y", 0.25, 1000, 1), Leaf("b", "en", "z", 0.5, 1000, 1)]
    assert largest_total(leaves) == 40
    got = {leaf.source: b for leaf, b in budgets(leaves, 400).items()}
    assert got == {"x": 10, "y": 190, "z": 200}
    got = {leaf.source: b for leaf, b in budgets([leaves[0], Leaf("a", "en", "y", 0.25, 100, 1), leaves[2]], 400).items()}
    assert got == {"x": 10, "y": 100, "z": 290}
