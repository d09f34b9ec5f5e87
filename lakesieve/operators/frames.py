"""Pixels and frames (G2, G4, G6, G7, G9-G11, G13-G15, A10, A11): numpy in Arrow batches, gates as Columns.

Images enter as raw bytes (red, green, blue, alpha for each pixel, row by row) with width and height.
"""

from __future__ import annotations

from math import floor, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesieve.operators.components import hamming, most_distance
from lakesieve.operators.media import _bits, dimension_gate, frame_compare, hue_similarity, warped_similarity

#: Hue bins of a histogram and cells of a side of a colour layout.
BINS, GRID = 12, 8


def _image(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(bytes(data), dtype=np.uint8).reshape(height, width, 4).astype(float)


def grey(image: np.ndarray) -> np.ndarray:
    """G4."""
    return image[..., 0] * 0.299 + image[..., 1] * 0.587 + image[..., 2] * 0.114


def subsampled(g: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest pixels of a grey image."""
    h, w = g.shape
    rows = np.minimum(h - 1, np.arange(height) * h // height)
    cols = np.minimum(w - 1, np.arange(width) * w // width)
    return g[np.ix_(rows, cols)]


def layout_hash(g: np.ndarray) -> int:
    """Whether each of 8 x 8 cells is at least as bright as the mean of the cells; empty cells are dark."""
    h, w = g.shape
    cells = np.zeros(GRID * GRID)
    for y in range(GRID):
        for x in range(GRID):
            cell = g[floor(y * h / GRID) : floor((y + 1) * h / GRID), floor(x * w / GRID) : floor((x + 1) * w / GRID)]
            cells[y * GRID + x] = cell.mean() if cell.size else 0.0
    return _bits(cells >= cells.mean())


def _hsv(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hue, saturation, value) of the pixels that statistics look at: every step-th row and column."""
    h, w = image.shape[:2]
    step = max(1, floor(sqrt(w * h) / 72))
    rgb = image[::step, ::step, :3].reshape(-1, 3) / 255
    high, low = rgb.max(1), rgb.min(1)
    d = high - low
    safe = np.where(d > 0, d, 1)
    r, g, b = rgb.T
    hue = np.where(high == r, ((g - b) / safe) % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    return np.where(d > 0, hue, 0.0), np.where(high > 0, d / np.where(high > 0, high, 1), 0.0), high


def hue_histogram(image: np.ndarray) -> list[float]:
    """Shares of twelve hues, weighted by saturation; greyish pixels are left out."""
    hue, saturation, _ = _hsv(image)
    seen = saturation >= 0.08
    bins = np.minimum(BINS - 1, np.floor(hue[seen] * BINS).astype(int))
    sums = np.bincount(bins, weights=saturation[seen], minlength=BINS)
    return (sums / sums.sum()).tolist() if sums.sum() > 0 else sums.tolist()


def frame_stats(image: np.ndarray) -> tuple[float, float, float]:
    """(luma, contrast, saturation): mean and deviation of the values, mean saturation."""
    _, saturation, value = _hsv(image)
    return (float(value.mean()), float(value.std()), float(saturation.mean())) if len(value) else (0.0, 0.0, 0.0)


def profiles(data: Column, width: Column, height: Column) -> Column:
    """The profile of every image: (dhash, ahash, color_hash, hue, luma, contrast, saturation); null where something is missing."""

    def run(d: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for a, x, y in zip(d, w, h, strict=True):
            if a is None or not x or not y or x != x or y != y:
                out.append((None,) * 7)
                continue
            image = _image(a, int(x), int(y))
            g = grey(image)
            out.append((_bits(g[:-1, :-1] < g[:-1, 1:]), _bits(g >= g.mean()), layout_hash(g), hue_histogram(image), *frame_stats(image)))
        return pd.DataFrame(out, columns=["dhash", "ahash", "color_hash", "hue", "luma", "contrast", "saturation"]).astype({"dhash": "Int64", "ahash": "Int64", "color_hash": "Int64"})

    return F.pandas_udf(run, "dhash long, ahash long, color_hash long, hue array<double>, luma double, contrast double, saturation double")(data, width, height)


def least_distance(a: Column, b: Column) -> Column:
    """The smallest distance between any two hashes of two lists; 64 where one is empty or missing."""
    each = F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.bit_count(x.bitwiseXOR(y)))))
    return F.coalesce(F.array_min(each), F.lit(64))


def distinct_profiles(frames: Column, most: int) -> Column:
    """Frame profiles (dhash, hue, ...) without those like an earlier kept one: few differing bits and hue alike."""
    like = lambda kept, f: F.exists(kept, lambda k: (F.bit_count(k["dhash"].bitwiseXOR(f["dhash"])) <= most) & (hue_similarity(k["hue"], f["hue"]) > 0.88))
    none = F.filter(frames, lambda f: F.lit(False))
    return F.aggregate(frames, none, lambda kept, f: F.when(like(kept, f), kept).otherwise(F.concat(kept, F.array(f))))


def mean_stats(frames: Column) -> Column:
    """Struct (luma, contrast, saturation): means over frame profiles; null for no frames."""
    mean = lambda name: F.aggregate(frames, F.lit(0.0), lambda s, f: s + f[name]) / F.nullif(F.size(frames), F.lit(0))
    return F.struct(*(mean(n).alias(n) for n in ("luma", "contrast", "saturation")))


def image_gate(a: Column, b: Column, most: int) -> Column:
    """Whether two image signatures (structs with dhash, ahash, detail_hash, color_hash) pass the strict gate.

    Both need dhash and ahash; detail and colour count where both have them, colour with two bits more.
    """
    far = lambda h: F.bit_count(a[h].bitwiseXOR(b[h]))
    has = a["dhash"].isNotNull() & b["dhash"].isNotNull() & a["ahash"].isNotNull() & b["ahash"].isNotNull()
    return has & (F.greatest(far("dhash"), far("ahash")) <= most) & (F.coalesce(far("detail_hash"), F.lit(0)) <= most) & (F.coalesce(far("color_hash"), F.lit(0)) <= most + 2)


def image_similarity(a: Column, b: Column, percent: float = 92, allow_resize: bool = True) -> Column:
    """The score of two images, 0 where a gate fails; at 100 % only equal bytes match.

    Equal bytes score 1, after the gate. Else 1 - mean of the two largest distances of the hashes that both have / 64.
    """
    same = F.coalesce(a["exact_hash"] == b["exact_hash"], F.lit(False))
    if percent >= 100:
        return F.when(same, 1.0).otherwise(0.0)
    hashes = ("dhash", "ahash", "block_hash", "detail_hash", "color_hash")
    ranked = F.sort_array(F.filter(F.array(*(F.bit_count(a[h].bitwiseXOR(b[h])) for h in hashes)), lambda d: d.isNotNull()), asc=False)
    worst = F.when(F.size(ranked) == 0, 64.0).when(F.size(ranked) == 1, F.get(ranked, F.lit(0)).cast("double")).otherwise((F.get(ranked, F.lit(0)) + F.get(ranked, F.lit(1))) / 2)
    sized = dimension_gate(a["width"], a["height"], b["width"], b["height"], allow_resize)
    return F.when(~image_gate(a, b, most_distance(percent)), 0.0).when(same, 1.0).when(~sized, 0.0).otherwise(1 - worst / 64)


def _frame_score(x: dict, y: dict, most: int) -> float:
    bits = lambda n: bin((x[n] ^ y[n]) & (2**64 - 1)).count("1")
    p, q = np.asarray(x["hue"]), np.asarray(y["hue"])
    chi = ((p - q) ** 2 / (p + q + 1e-6)).sum()
    hue = 0.65 * np.sqrt(p * q).sum() + 0.35 / (1 + chi)
    d, c, detail = bits("dhash"), bits("color_hash"), bits("detail_hash")
    if max(d, c) > most + 1 or hue < 0.45:
        return 0.0
    return 0.42 * (1 - d / 64) + 0.38 * hue + 0.08 * (1 - c / 64) + 0.07 * (1 - detail / 64) + 0.05 * (1 - min(1.0, abs(x["luma"] - y["luma"]) + abs(x["contrast"] - y["contrast"])))


def warped(a: Column, b: Column, percent: float = 92) -> Column:
    """Similarity of two sequences of frame profiles under a banded alignment; 0 where one is empty."""
    most = most_distance(percent)

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            if x is None or y is None or not len(x) or not len(y):
                out.append(0.0)
            else:
                out.append(warped_similarity(np.array([[1 - _frame_score(f, g, most) for g in y] for f in x])))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def video_gate(a: Column, b: Column) -> Column:
    """Whether hue, luma and saturation of two clips are close; what one lacks passes."""
    hue = F.coalesce(hue_similarity(a["hue"], b["hue"]) >= 0.42, F.lit(True))
    return hue & F.coalesce(F.abs(a["luma"] - b["luma"]) <= 0.28, F.lit(True)) & F.coalesce(F.abs(a["saturation"] - b["saturation"]) <= 0.35, F.lit(True))


def frame_coverage(a: Column, b: Column, most: int) -> Column:
    """G14, without profiles: the share of frames of a (hash lists) that are near one of b."""
    near = F.size(F.filter(a, lambda x: F.exists(b, lambda y: F.bit_count(x.bitwiseXOR(y)) <= most)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), near / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def video_similarity(a: Column, b: Column, percent: float = 92, allow_resize: bool = True) -> Column:
    """The score of two clips (structs with hue, luma, saturation, frames, frame_hashes, dhash, duration, width,
    height, exact_hash): equal bytes 1; else the alignment of the frames, less where durations differ much."""
    same = F.coalesce(a["exact_hash"] == b["exact_hash"], F.lit(False))
    if percent >= 100:
        return F.when(same, 1.0).otherwise(0.0)
    da, db = F.coalesce(F.nullif(a["duration"], F.lit(0.0)), F.lit(1.0)), F.coalesce(F.nullif(b["duration"], F.lit(0.0)), F.lit(1.0))
    ratio = F.least(da, db) / F.greatest(da, db)
    scale = F.when(ratio < 0.45, 0.5 + ratio).otherwise(1.0)
    covered = frame_coverage(a["frame_hashes"], b["frame_hashes"], most_distance(percent))
    legacy = F.greatest(covered * 0.85 + (1 - hamming(a["dhash"], b["dhash"]) / 64) * 0.15, covered)
    profiled = (F.size(a["frames"]) > 0) & (F.size(b["frames"]) > 0)
    score = F.when(profiled, warped(a["frames"], b["frames"], percent) * scale).when(covered > 0, legacy).otherwise(0.0)
    sized = dimension_gate(a["width"], a["height"], b["width"], b["height"], allow_resize)
    return F.when(~video_gate(a, b), 0.0).when(same, 1.0).when(~sized, 0.0).otherwise(score)


__all__ = ["distinct_profiles", "frame_compare", "frame_coverage", "image_gate", "image_similarity", "least_distance", "mean_stats", "profiles", "video_gate", "video_similarity", "warped"]
