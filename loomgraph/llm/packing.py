"""Filling containers of several capacities with texts (problem 6).

Variable-capacity best-fit decreasing: items go, longest first, to the open container that they fill best;
if none has room, a container is opened. All permitted capacities are optimised together: which one is opened is chosen
for each container, by the least cost of its room or the least cost for the item at hand, or it is the same for the whole
block; every container is then downsized to the least capacity that holds its contents, and the cheapest of these
packings stays.

Items are spread over blocks of about ``BLOCK_ITEMS`` by the hash of their id, whatever their source, so each
block has the whole mixture of lengths and is packed in one task by itself; only ids and sizes are moved.
The room lost at block borders is a few containers a block.

Cases: a text longer than the largest capacity is split into pieces of that capacity and a rest; no other
text is split. A null or empty text has no tokens and needs no container. Ties go by id. Rows that repeat
an id are items of their own. Capacities that are null or not positive are ignored; without any, an error is
raised. Other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tokens import DEFAULT_PATH, token_count
from loomgraph.sources.tables import cut

BLOCK_ITEMS = 20_000
#: pack_limits is read to the driver; a longer table is refused.
MOST_LIMITS = 1000


def pack(sizes: list[int], capacities: list[int], costs: dict[int, float] | None = None) -> list[tuple[int, int]]:
    """(container, capacity) of each item of a block; ``sizes`` must come longest first and fit the largest capacity.

    The cost of a container is its capacity unless ``costs`` says otherwise.
    """
    price = (lambda c: costs[c]) if costs else float
    best: tuple[float, int, list[int], list[int]] | None = None
    by_room = {s: min((c for c in capacities if c >= s), key=lambda c: (price(c) / c, -c)) for s in set(sizes)}
    by_item = {s: min((c for c in capacities if c >= s), key=lambda c: (price(c), c)) for s in set(sizes)}
    fixed = [{s: max(opened, next(c for c in capacities if c >= s)) for s in by_room} for opened in capacities]
    for opening in [by_room, by_item, *fixed]:
        room_at: dict[int, list[int]] = {}
        rooms = 0  # bit r is set if a container with room r is open
        used: list[int] = []
        where: list[int] = []
        for size in sizes:
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                stack = room_at[room]
                k = stack.pop()
                if not stack:
                    rooms &= ~(1 << room)
            else:
                room = opening[size]
                k = len(used)
                used.append(0)
            used[k] += size
            where.append(k)
            left = room - size
            if left:
                room_at.setdefault(left, []).append(k)
                rooms |= 1 << left
        fitted = [min((c for c in capacities if c >= u), key=lambda c: (price(c), c)) for u in used]
        total = sum(map(price, fitted))
        if best is None or (total, len(used)) < best[:2]:
            best = (total, len(used), where, fitted)
    return [(k, best[3][k]) for k in best[2]] if best else []


def item_sizes(documents: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """``doc_id, n_tokens``, cut from its lineage so that texts are tokenised once."""
    return cut(documents.select("doc_id", token_count(F.col("text"), path).alias("n_tokens")))


def fill(sizes: DataFrame, limits: list[tuple[str, int]], block_items: int = BLOCK_ITEMS, costs: dict[int, float] | None = None) -> DataFrame:
    """``container_id, container_kind, capacity_tokens, doc_id, piece, first_token, n_tokens`` of each placed piece."""
    kinds = {c: k for k, c in sorted(limits, reverse=True) if c and c > 0}
    if not kinds:
        raise ValueError("no capacity to fill")
    capacities = sorted(kinds)
    largest = capacities[-1]
    pieces = (
        sizes.filter(F.col("n_tokens") > 0)
        .select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / largest).cast("int"))).alias("piece"))
        .select("doc_id", "piece", (F.col("piece").cast("long") * largest).alias("first_token"), F.least(F.lit(largest), F.col("n_tokens") - F.col("piece").cast("long") * largest).alias("n_tokens"))
    )
    n = pieces.count()
    blocks = max(1, -(-n // block_items))
    spread = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        placed = pack(rows.n_tokens.tolist(), capacities, costs)
        block = rows.block.iloc[0]
        return pd.DataFrame({
            "container_id": [f"{block}-{k}" for k, _ in placed], "container_kind": [kinds[c] for _, c in placed], "capacity_tokens": [c for _, c in placed],
            "doc_id": rows.doc_id.to_numpy(), "piece": rows.piece.to_numpy(), "first_token": rows.first_token.to_numpy(), "n_tokens": rows.n_tokens.to_numpy(),
        })

    return spread.groupBy("block").applyInPandas(run, "container_id string, container_kind string, capacity_tokens int, doc_id bigint, piece int, first_token bigint, n_tokens bigint")


def limits_of(pack_limits: DataFrame) -> list[tuple[str, int]]:
    rows = pack_limits.select("container_kind", "capacity_tokens").limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError("too many capacities")
    return [(r[0], r[1]) for r in rows]


def fill_documents(documents: DataFrame, pack_limits: DataFrame, path: str = DEFAULT_PATH, block_items: int = BLOCK_ITEMS, cost=None) -> DataFrame:
    """``cost`` gives the cost of a container of a capacity; it is the capacity by default."""
    limits = limits_of(pack_limits)
    return fill(item_sizes(documents, path), limits, block_items, {c: float(cost(c)) for _, c in limits if c and c > 0} if cost else None)


def summary(filled: DataFrame) -> DataFrame:
    """Containers, items, tokens and the share of the room that is used, by kind."""
    bins = filled.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n_items"))
    return bins.groupBy("container_kind", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("used").alias("n_tokens"),
        F.round(F.sum("used") / F.sum("capacity_tokens"), 6).alias("filled_share"), F.max("used").alias("most_tokens"),
    )
