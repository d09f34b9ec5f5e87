"""Operators on media signatures (G1-G18, W3-W5, M10): gates, scores, bursts, canonical picks.

Input is a table of signatures: 64-bit hashes as BIGINT, sizes, hue histograms as arrays of 12 doubles. Hashes
of raw grey-scale pixels are computed by a vectorised UDF; decoding of image files needs a decoder that is not
part of the environment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesieve.operators.components import band_pairs, connected_components, hamming, most_distance


def difference_hash(pixels: Column, width: Column, height: Column) -> Column:
    """dHash of a row-major grey-scale image: is each pixel darker than its right neighbour (last row ignored)."""

    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([_bits((g := np.asarray(a, float).reshape(int(y), int(x)))[:-1, :-1] < g[:-1, 1:]) for a, x, y in zip(p, w, h, strict=True)])

    return F.pandas_udf(run, "long")(pixels, width, height)


def average_hash(pixels: Column) -> Column:
    """aHash: is each pixel at least the mean."""

    def run(p: pd.Series) -> pd.Series:
        return pd.Series([_bits((a := np.asarray(x, float)) >= a.mean()) for x in p])

    return F.pandas_udf(run, "long")(pixels)


def _bits(flags: np.ndarray) -> int:
    """The first 64 flags, missing ones as 0, as a signed 64-bit number."""
    bits = np.zeros(64, dtype=bool)
    flat = flags.ravel()[:64]
    bits[: len(flat)] = flat
    return int(np.packbits(bits).view(">i8")[0])


def sign_hash(values: Column) -> Column:
    """A 64-bit hash of a vector: bit i is set where value i is not negative (first 64 values)."""
    return F.aggregate(F.slice(values, 1, 64), F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x >= 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def hue_similarity(a: Column, b: Column) -> Column:
    """0.65 Bhattacharyya coefficient + 0.35 / (1 + chi square)."""
    pair = lambda fn: F.aggregate(F.zip_with(a, b, fn), F.lit(0.0), lambda s, x: s + x)
    chi = pair(lambda x, y: (x - y) * (x - y) / (x + y + F.lit(1e-6)))
    return 0.65 * pair(lambda x, y: F.sqrt(x * y)) + 0.35 / (1 + chi)


def hue_total(histograms: Column) -> Column:
    """A10: element-wise sum of histograms of 12 bins, scaled to sum 1 (zeros stay zeros)."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.aggregate(histograms, F.lit(0.0), lambda s, h: s + F.coalesce(F.get(h, i), F.lit(0.0))))
    total = F.aggregate(sums, F.lit(0.0), lambda s, x: s + x)
    return F.transform(sums, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def dimension_gate(w1: Column, h1: Column, w2: Column, h2: Column, allow_resize: bool = True) -> Column:
    """Whether two sizes can be the same picture; unknown sizes pass."""
    unknown = F.coalesce(w1 * h1 * w2 * h2, F.lit(0)) <= 0
    r1, r2 = w1 / h1, w2 / h2
    aspect = F.greatest(r1, r2) / F.least(r1, r2)
    if allow_resize:
        return unknown | (aspect <= 3)
    area = F.greatest(w1 * h1, w2 * h2) / F.least(w1 * h1, w2 * h2)
    return unknown | ((aspect <= 1.2) & (area <= 1.08))


def image_score(distances: list[Column]) -> Column:
    """1 - mean of the two largest distances / 64."""
    ranked = F.sort_array(F.array(*distances), asc=False)
    return 1 - (F.get(ranked, F.lit(0)) + F.coalesce(F.get(ranked, F.lit(1)), F.get(ranked, F.lit(0)))) / 2 / 64


def similar_media(items: DataFrame, percent: float = 92, id_col: str = "item", hashes: tuple[str, ...] = ("dhash",)) -> DataFrame:
    """(a, b, distance) of items that share a band and whose hashes all differ in few enough bits."""
    most = most_distance(percent)
    pairs = band_pairs(items, id_col, list(hashes))
    left = items.select(F.col(id_col).alias("a"), *(F.col(h).alias(f"a_{h}") for h in hashes))
    right = items.select(F.col(id_col).alias("b"), *(F.col(h).alias(f"b_{h}") for h in hashes))
    full = pairs.join(left, "a").join(right, "b")
    worst = F.greatest(*(hamming(F.col(f"a_{h}"), F.col(f"b_{h}")) for h in hashes), F.lit(0))
    return full.select("a", "b", worst.alias("distance")).where(F.col("distance") <= most)


def media_clusters(items: DataFrame, percent: float = 92, id_col: str = "item", hashes: tuple[str, ...] = ("dhash",)) -> DataFrame:
    """M9: (item, component) of items that are linked by chains of similar pairs."""
    return connected_components(similar_media(items, percent, id_col, hashes)).withColumnRenamed("id", id_col)


def canonical_media(clusters: DataFrame, items: DataFrame, id_col: str = "item", strategy: str = "largest") -> DataFrame:
    """(component, kept, members): the largest bytes, then pixels, then first path; or the first path only."""
    rows = clusters.join(items, id_col)
    order = F.struct(-F.col("bytes"), -F.col("pixels"), F.col("path")) if strategy == "largest" else F.struct(F.col("path"))
    return rows.groupBy("component").agg(F.min_by(id_col, order).alias("kept"), F.count("*").alias("members"))


def runs(df: DataFrame, group: str, order: list[str], same_as_before: Column) -> DataFrame:
    """``df`` with ``run``, counted from 1: rows of a group, in order, until ``same_as_before`` is false."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = df.withColumn("_new", F.when(F.coalesce(same_as_before, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def burst_representatives(df: DataFrame, group: str, order: list[str], keep: int = 2) -> DataFrame:
    """``df`` (with ``run``) with run length and whether a row stays.

    Runs of one row stay. Of longer runs the first, the last and (from three rows on) the middle one are
    representatives; the first ``keep`` of them stay.
    """
    w = Window.partitionBy(group, "run")
    r = df.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("size", F.count("*").over(w))
    middle = F.floor(F.col("size") / 2) + 1
    is_rep = (F.col("rn") == 1) | (F.col("rn") == F.col("size")) | ((F.col("size") >= 3) & (F.col("rn") == middle))
    before = F.when(F.col("rn") == 1, 0).when(F.col("rn") == F.col("size"), F.when((F.col("size") >= 3) & (middle < F.col("size")), 2).otherwise(1)).otherwise(1)
    return r.withColumn("stays", (F.col("size") == 1) | (is_rep & (before < keep)))


def frame_compare(d: Column, c: Column, detail: Column, hue: Column, luma: Column, contrast: Column, most: int) -> Column:
    """Score of two frames from their distances (bits) and differences; 0 beyond the gates."""
    score = 0.42 * (1 - d / 64) + 0.38 * hue + 0.08 * (1 - c / 64) + 0.07 * (1 - detail / 64) + 0.05 * (1 - F.least(F.lit(1.0), luma + contrast))
    return F.when((F.greatest(d, c) > most + 1) | (hue < 0.45), 0.0).otherwise(score)


def warped_similarity(costs: np.ndarray, band: float = 0.22) -> float:
    """1 - cheapest banded alignment / (n + m) of two frame sequences; ``costs`` are 1 - similarity, n x m."""
    n, m = costs.shape
    width = max(1, int(max(n, m) * band))
    best = np.full((n + 1, m + 1), np.inf)
    best[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - width), min(m, i + width) + 1):
            best[i, j] = costs[i - 1, j - 1] + min(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1])
    return 0.0 if not np.isfinite(best[n, m]) else float(1 - best[n, m] / (n + m))


def distinct_frames(hashes: Column) -> Column:
    """A list of frame hashes without those within one bit of the last one kept."""
    return F.aggregate(hashes, F.array().cast("array<bigint>"), lambda kept, h: F.when((F.size(kept) > 0) & (F.bit_count(F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(0)).bitwiseXOR(h)) <= 1), kept).otherwise(F.concat(kept, F.array(h))))


def matches_of_target(items: DataFrame, target: dict[str, int], percent: float = 92) -> DataFrame:
    """``items`` whose hashes all differ from the target's in few enough bits, with the worst ``distance``.

    ``target`` names hash columns and their values; the target is a literal, so this is a filter of one scan.
    """
    worst = F.greatest(*(hamming(F.col(h), F.lit(v).cast("long")) for h, v in target.items()), F.lit(0))
    return items.withColumn("distance", worst).where(F.col("distance") <= most_distance(percent))


def video_score(hue: Column, luma: Column, saturation: Column, frames: Column, shorter: Column, longer: Column) -> Column:
    """Score of two clips from hue similarity, differences of means, frame similarity (G10) and durations."""
    ratio = shorter / longer
    scale = F.when(ratio < 0.45, 0.5 + ratio).otherwise(1.0)
    return F.when((hue < 0.42) | (luma > 0.28) | (saturation > 0.35), 0.0).otherwise(frames * scale)
