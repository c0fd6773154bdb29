"""Mixing sources to target weights (problem 7) by hierarchical budgets.

Sources are the leaves of a tree of domain, language and source. A source's weight is its target share; a
leaf's is the part of it that its language holds of the source's tokens; an inner node's is the sum below it.
A total is handed down the tree: each node divides its budget among its children by weight, up to what they can
give (their tokens times the permitted repeats); what a child can't take goes to its siblings, and what all
siblings can't take goes to those of their parent. Every leaf then uses its documents in seeded epochs: whole
epochs first, then the prefix of the last one's order that comes nearest to the budget.

The default total is the largest at which no source with documents is short, so only shares of sources
without documents are handed on; with a larger ``scale`` short sources give what they have, and what they can't take is handed on.

The order of an epoch is that of a hash, so a leaf is never sorted in one task: tokens are summed by ranges of
the hash, ranges within the budget are taken whole, and only the range at its end is put in order. Ranges
are as many as keep them near ``RANGE_ROWS`` rows.

Cases: documents with a null id, a null or empty text or a source that isn't listed are left out; a null language
is a language of its own. Targets that repeat a source count once with the larger share; null or negative
shares count 0, a null repeat 1. Shares are scaled to sum to 1. Ties of the hash go by id. No documents: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.tokens import DEFAULT_PATH, token_count
from loomgraph.sources.tables import cut

SEED = 11
RANGE_ROWS = 5000
#: mix_targets is read to the driver; a longer table is refused.
MOST_TARGETS = 10_000
#: Pairs of source and language are read to the driver; more are refused.
MOST_LEAVES = 100_000


@dataclass(frozen=True)
class Leaf:
    domain: str
    lang: str
    source: str
    weight: float
    tokens: int
    repeats: int

    @property
    def most(self) -> float:
        return float(self.tokens * self.repeats)


def divide(total: float, weights: list[float], most: list[float]) -> list[float]:
    """``total`` by weight, none above its ``most``; what one can't take goes to the others by weight."""
    out, open_ = [0.0] * len(weights), set(range(len(weights)))
    left = min(total, sum(most))
    while open_ and left > 1e-9:
        # with no weight left, what remains is divided by what can still be taken
        w = {k: weights[k] for k in open_}
        if sum(w.values()) <= 0:
            w = {k: most[k] - out[k] for k in open_}
        whole = sum(w.values())
        if whole <= 0:
            break
        full = {k for k in open_ if out[k] + left * w[k] / whole >= most[k] - 1e-9}
        if not full:
            for k in open_:
                out[k] += left * w[k] / whole
            break
        for k in full:
            left -= most[k] - out[k]
            out[k] = most[k]
        open_ -= full
    return out


def budgets(leaves: list[Leaf], total: float, levels: tuple[str, ...] = ("domain", "lang", "source"), most=lambda leaf: leaf.most) -> dict[Leaf, float]:
    """The budget of each leaf."""
    if not levels:
        return {leaf: part for leaf, part in zip(leaves, divide(total, [x.weight for x in leaves], [most(x) for x in leaves]))}
    groups: dict[str, list[Leaf]] = {}
    for leaf in sorted(leaves, key=lambda x: (x.domain, x.lang, x.source)):
        groups.setdefault(getattr(leaf, levels[0]), []).append(leaf)
    parts = divide(total, [sum(x.weight for x in g) for g in groups.values()], [sum(map(most, g)) for g in groups.values()])
    return {leaf: b for g, part in zip(groups.values(), parts) for leaf, b in budgets(g, part, levels[1:], most).items()}


def largest_total(leaves: list[Leaf]) -> float:
    """The largest total at which no leaf with documents is short."""
    shares = budgets(leaves, 1.0, most=lambda x: 1e18 if x.tokens else 0.0)
    return min((x.most / s for x, s in shares.items() if s > 1e-12), default=0.0)


def targets_of(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = mix_targets.filter(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError("too many targets")
    out: dict[str, tuple[float, int]] = {}
    for r in sorted(rows, key=lambda r: (r["target_share"] or 0.0, r["max_repeats"] or 1)):
        out[r["source"]] = (max(0.0, r["target_share"] or 0.0), max(1, r["max_repeats"] or 1))
    whole = sum(s for s, _ in out.values()) or 1.0
    return {k: (s / whole, n) for k, (s, n) in out.items()}


def sized(documents: DataFrame, sources: list[str], path: str = DEFAULT_PATH) -> DataFrame:
    """``doc_id, source, lang, n_tokens`` of the usable documents, cut from their lineage so that texts are tokenised once."""
    usable = documents.filter(F.col("doc_id").isNotNull() & F.col("source").isin(sources) & (F.length("text") > 0))
    return cut(usable.select("doc_id", "source", F.coalesce("lang", F.lit("?")).alias("lang"), token_count(F.col("text"), path).alias("n_tokens")))


def leaves_of(sizes: DataFrame, targets: dict[str, tuple[float, int]], domains: dict[str, str]) -> list[Leaf]:
    rows = sizes.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens")).limit(MOST_LEAVES + 1).collect()
    if len(rows) > MOST_LEAVES:
        raise ValueError("too many pairs of source and language")
    held = {(r["source"], r["lang"]): r["tokens"] for r in rows}
    whole: dict[str, int] = {}
    for (source, _), n in held.items():
        whole[source] = whole.get(source, 0) + n
    out = [Leaf(domains.get(s, s), lang, s, targets[s][0] * n / whole[s], n, targets[s][1]) for (s, lang), n in held.items() if whole[s]]
    # a source without documents has the languages of its domain, or of all documents, so its share is handed on evenly
    by_lang: dict[str | None, dict[str, int]] = {}
    for x in out:
        for node in (x.domain, None):
            by_lang.setdefault(node, {}).setdefault(x.lang, 0)
            by_lang[node][x.lang] += x.tokens
    for s, (share, n) in targets.items():
        if not whole.get(s):
            langs = by_lang.get(domains.get(s, s)) or by_lang.get(None) or {"?": 1}
            out += [Leaf(domains.get(s, s), lang, s, share * k / sum(langs.values()), 0, n) for lang, k in langs.items()]
    return out


def chosen(sizes: DataFrame, budget: dict[Leaf, float], seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, source, lang, n_tokens, uses`` of the documents used."""
    spark = sizes.sparkSession
    rows = [(x.source, x.lang, int(b // x.tokens), b - (b // x.tokens) * x.tokens) for x, b in budget.items() if x.tokens]
    # one row a leaf, at most MOST_LEAVES
    plan = spark.createDataFrame(rows, "source string, lang string, epochs int, rest double")
    ranges = max(1, -(-sizes.count() // range_rows))
    # an epoch's order is that of its own hash
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    placed = sizes.join(F.broadcast(plan), ["source", "lang"]).withColumn("at", order).withColumn("range", F.floor((F.col("at").cast("double") / 2.0**64 + 0.5) * ranges))
    sums = placed.groupBy("source", "lang", "range").agg(F.sum("n_tokens").alias("in_range"))
    before = Window.partitionBy("source", "lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    joined = placed.join(starts, ["source", "lang", "range"])
    whole = F.col("before") + F.col("in_range") <= F.col("rest")
    none = F.col("before") >= F.col("rest")
    within = Window.partitionBy("source", "lang", "range").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["doc_id", "source", "lang", "n_tokens"]
    sure = joined.filter(whole | none).select(*columns, (F.col("epochs") + F.when(whole, 1).otherwise(0)).alias("uses"))
    edge = joined.filter(~whole & ~none).withColumn("so_far", F.col("before") + F.sum("n_tokens").over(within))
    last = edge.select(*columns, (F.col("epochs") + F.when(F.col("so_far") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)).alias("uses"))
    return sure.unionByName(last).filter(F.col("uses") > 0)


def mix(documents: DataFrame, mix_targets: DataFrame, path: str = DEFAULT_PATH, total: float | None = None, seed: int = SEED, domains: dict[str, str] | None = None, scale: float = 1.0) -> DataFrame:
    """``domains`` names the domain of a source; others are domains of their own. The default total is ``scale`` times the largest at which no source is short."""
    targets = targets_of(mix_targets)
    sizes = sized(documents, list(targets), path)
    leaves = leaves_of(sizes, targets, domains or {})
    return chosen(sizes, budgets(leaves, scale * largest_total(leaves) if total is None else total), seed)


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Target and reached share of each listed source, with its documents, tokens and most uses of a document."""
    by = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.max("uses").alias("most_uses"))
    whole = by.agg(F.sum("n_tokens").alias("all_tokens"))
    listed = mix_targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = listed.join(by, "source", "left").crossJoin(F.broadcast(whole))  # one row: the total
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("source", "target_share", "max_repeats", zero("n_documents").alias("n_documents"), zero("n_tokens").alias("n_tokens"), zero("most_uses").alias("most_uses"), F.round(zero("n_tokens") / F.col("all_tokens"), 6).alias("reached_share"))
