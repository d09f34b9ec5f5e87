"""Connected components of accepted pairs (M9) and banded candidate pairs of 64-bit hashes."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesieve.session import materialize

BANDS = 4


def hamming(a: Column, b: Column) -> Column:
    """G1: differing bits of two BIGINT hashes; 64 where one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def most_distance(percent: float) -> int:
    """Bits that may differ at a similarity of ``percent`` (75 to 100)."""
    p = max(75.0, min(100.0, percent))
    return 0 if p >= 100 else max(1, floor((100 - p) / 100 * 64))


def band_pairs(items: DataFrame, id_col: str, hashes: list[str]) -> DataFrame:
    """M7: (a, b), a < b, of items that share a 16-bit band at the same place in any of their hashes."""
    bands = F.array(*(F.concat_ws(":", F.lit(str(i)), F.shiftrightunsigned(F.col(h), 16 * i).bitwiseAND(F.lit(65535)).cast("string")) for h in hashes for i in range(BANDS)))
    keys = items.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.filter(bands, lambda x: x.isNotNull()))).alias("band"))
    a, b = keys.select(F.col("id").alias("a"), "band"), keys.select(F.col("id").alias("b"), "band")
    return a.join(b, "band").where("a < b").select("a", "b").distinct()


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that a chain of pairs leads to, of every id in a pair.

    Each round takes the smallest label of an id's neighbours and then the label of that label, so long chains
    halve; the labels are written each round. Ids in no pair are left out, null ids are ignored.
    """
    edges = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = materialize(edges.union(edges.select("y", "x")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("n")).select("id", F.least("id", "n").alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), "component")
        jump = step.alias("s").join(labels.select(F.col("id").alias("to"), F.col("component").alias("far")), "to", "left")
        after = materialize(jump.select("id", F.least("to", F.coalesce("far", F.col("to"))).alias("component"), F.col("component").alias("before")), "labels")
        labels = after.select("id", "component")
        if after.where("component <> before").isEmpty():
            return labels
