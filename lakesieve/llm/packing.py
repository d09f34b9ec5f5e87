"""Problem 7: filling containers of fixed capacity with items of varying length.

Method. Karmarkar-Karp multiway differencing: every item starts as a partial partition of k windows, the two
partitions with the largest imbalance are merged so that full windows of one meet empty windows of the other,
until one partition with near-equal windows is left. If a window exceeds the capacity, k rises and the
differencing is repeated.

Items are spread over blocks by hash, so that a block is packed by one task whatever the size of the corpus;
a block is a few hundred windows, which keeps the loss at its last windows below one window in that many.
"""

from __future__ import annotations

import heapq
from bisect import insort
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesieve.session import materialize

#: Windows of a block, and items that a block has at most on average.
BLOCK_WINDOWS, BLOCK_ITEMS = 256, 8192
#: Container sizes that one call may have.
MOST_SPECS = 1000


def difference(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp: ``sizes`` in k windows of near-equal sums, as (sum, indices of the items).

    A partial partition is its list of non-empty windows, fullest first; a window holds its sum and a tree of
    item indices. Merging lays one partition's fullest windows on the other's emptiest.
    """
    if not sizes:
        return []
    heap: list[tuple[int, int, list[tuple[int, int, object]]]] = []
    tick = 0
    for i, s in enumerate(sizes):
        heap.append((-s, tick, [(-s, tick, i)]))
        tick += 1
    if k == 1:
        return [(sum(sizes), list(range(len(sizes))))]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if over <= 0:
            if len(b) == 1:
                insort(a, b[0])
                merged = a
            else:
                merged = list(heapq.merge(a, b))
        else:
            # b's j-th fullest window meets a's j-th emptiest; the first of them are a's empty ones.
            free = k - len(a)
            merged = a[: len(a) - over] + b[:free]
            for j in range(over):
                x, y = a[len(a) - 1 - j], b[free + j]
                merged.append((x[0] + y[0], tick, (x[2], y[2])))
                tick += 1
            merged.sort(key=lambda w: w[:2])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (merged[0][0] - least, tick, merged))
        tick += 1
    out = []
    for total, _, tree in heap[0][2]:
        items, todo = [], [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node)
            else:
                items.append(node)
        out.append((-total, items))
    return out


def least_windows(sizes: list[int], capacity: int) -> int:
    """A lower bound of the windows needed: the sum, and the items that no window holds two of."""
    big = sum(1 for s in sizes if 2 * s > capacity)
    return max(1, ceil(sum(sizes) / capacity), big)


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows (lists of item indices) of at most ``capacity``; every item must fit.

    Their number is the least, from the lower bound on, whose differencing fits: none is skipped.
    """
    if not sizes:
        return []
    k = least_windows(sizes, capacity)
    while True:
        windows = difference(sizes, k)
        if all(total <= capacity for total, _ in windows):
            return [items for _, items in windows]
        k += 1


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["tokens", "item_id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
    windows = pack(pdf["tokens"].tolist(), capacity)
    window = pd.Series(-1, index=pdf.index)
    for w, items in enumerate(windows):
        window.iloc[items] = w
    pdf["container_id"] = pdf["block"].astype("int64") * (1 << 24) + window
    return pdf[["spec_id", "container_id", "item_id", "piece", "start", "tokens"]]


def containers(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, container_id, item_id, piece, start, tokens): where every item lies.

    sizes: (item_id long, tokens long); specs: (spec_id, capacity_tokens), a small reference table. An item
    above the capacity is divided into pieces: full containers, and a remainder that is packed like an item;
    ``start`` is the piece's first token. No other item is divided. Items with a null id, or with no tokens
    (null and empty texts), take no room and are left out; repeated item rows are packed as often as they are;
    a spec with a null or non-positive capacity has no containers.
    """
    base = sizes.where("item_id is not null and tokens > 0").select(F.col("item_id").cast("long"), F.col("tokens").cast("long"))
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "sizes")  # repeated rows are items of their own
    caps = specs.where("spec_id is not null and capacity_tokens > 0").select(F.col("spec_id").cast("int"), F.col("capacity_tokens").cast("long")).dropDuplicates(["spec_id"]).limit(MOST_SPECS + 1).collect()
    if len(caps) > MOST_SPECS:
        raise ValueError("too many container sizes: each is a pass over all items")
    each = F.array(*(F.struct(F.lit(c[0]).alias("spec_id"), F.lit(c[1]).cast("long").alias("capacity")) for c in sorted(caps))) if caps else F.expr("cast(array() as array<struct<spec_id int, capacity bigint>>)")
    pieces = (
        base.select("item_id", "tokens", "row", F.explode(each).alias("spec"))
        .select("item_id", "tokens", "row", "spec.spec_id", "spec.capacity")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / F.col("capacity")))))
        .withColumn("start", F.col("piece") * F.col("capacity"))
        .withColumn("tokens", F.least(F.col("capacity"), F.col("tokens") - F.col("start")))
    )
    totals = pieces.where("tokens < capacity").groupBy("spec_id").agg(F.sum("tokens").alias("total"), F.count("*").alias("items"), F.first("capacity").alias("cap"))
    blocks = totals.select("spec_id", F.greatest(F.lit(1), F.ceil(F.greatest(F.col("total") / (F.col("cap") * BLOCK_WINDOWS), F.col("items") / BLOCK_ITEMS))).alias("blocks"))
    full = pieces.where("tokens = capacity").select("spec_id", (-1 - F.monotonically_increasing_id()).alias("container_id"), "item_id", "piece", "start", "tokens")
    rest = pieces.where("tokens < capacity").join(F.broadcast(blocks), "spec_id").withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.col("blocks")))
    packed = rest.select("spec_id", "capacity", "block", "item_id", "piece", "start", "tokens").groupBy("spec_id", "block").applyInPandas(_pack_block, full.schema)
    return full.unionByName(packed)


def usage(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the fewest containers that could hold the tokens, and the share of room used."""
    per = placed.groupBy("spec_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    caps = specs.select("spec_id", F.col("capacity_tokens").alias("capacity")).dropDuplicates(["spec_id"])
    return per.join(caps, "spec_id").select("spec_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("used"))
