"""Whole runs over media signatures (G16-G18, G20, O3): kinds, paths, clusters of similar items, matches of a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesieve.functions import text as T
from lakesieve.operators import frames as R
from lakesieve.operators.components import BANDS, connected_components, most_distance
from lakesieve.session import materialize

# Extensions of images and videos with their types, folders of previews.
IMAGES = {".jpg": "jpeg", ".jpeg": "jpeg", ".png": "png", ".gif": "gif", ".webp": "webp", ".bmp": "bmp", ".avif": "avif", ".tif": "tiff", ".tiff": "tiff", ".heic": "heic", ".heif": "heif"}
VIDEOS = {".mp4": "mp4", ".webm": "webm", ".mov": "quicktime", ".m4v": "mp4", ".avi": "x-msvideo", ".mkv": "x-matroska", ".mpeg": "mpeg", ".mpg": "mpeg", ".3gp": "3gpp", ".wmv": "x-ms-wmv"}
PREVIEWS = ("thumb", "thumbs", "thumbnails", ".thumbnails", "preview", "previews", "cache")
HASHES = ("dhash", "ahash", "block_hash", "detail_hash", "color_hash")


def media_extension(path: Column) -> Column:
    """From the last dot of the whole path on, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(path, "(\\.[^.]*)\\z", 1))


def media_kind(path: Column) -> Column:
    """Image, video, or null."""
    ext = media_extension(path)
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*VIDEOS), "video")


def mime_type(path: Column) -> Column:
    """G20."""
    ext, out = media_extension(path), None
    for kind, types in (("image", IMAGES), ("video", VIDEOS)):
        for e, t in types.items():
            out = F.when(ext == e, f"{kind}/{t}") if out is None else out.when(ext == e, f"{kind}/{t}")
    return out.otherwise("application/octet-stream")


def media_ignored(path: Column, thumbs: bool = True, system: bool = True) -> Column:
    """Whether a part of the path is a folder of previews or a system file."""
    names = [*(PREVIEWS if thumbs else ()), *((".ds_store", "__macosx") if system else ())]
    return F.exists(F.split(F.lower(T.path_normalize(path)), "/"), lambda p: p.isin(*names)) if names else F.lit(False)


def natural_key(path: Column) -> Column:
    """O3: sort key of paths with numbers in order of their value, without regard to case and accents."""
    parts = F.regexp_extract_all(path, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    padded = F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 24, "0")).otherwise(x))
    return F.collate(F.array_join(padded, ""), "UNICODE_CI_AI")


def candidate_pairs(items: DataFrame) -> DataFrame:
    """M7: (a, b), a < b, of items of one kind that share the exact hash or a 16-bit band of any hash at any of them.

    Bands are shared by all kinds of hashes, frame hashes included.
    """
    every = F.filter(F.concat(F.array(*(F.col(h) for h in HASHES)), F.coalesce("frame_hashes", F.array().cast("array<bigint>"))), lambda h: h.isNotNull())
    bands = F.flatten(F.transform(every, lambda h: F.array(*(F.concat(F.lit(f"{i}:"), F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(65535)).cast("string")) for i in range(BANDS)))))
    keys = F.array_distinct(F.concat(bands, F.filter(F.array(F.concat(F.lit("exact:"), F.col("exact_hash"))), lambda x: x.isNotNull())))
    rows = items.where("path is not null and kind is not null").select("path", "kind", F.explode(keys).alias("key"))
    a, b = rows.select("key", "kind", F.col("path").alias("a")), rows.select("key", "kind", F.col("path").alias("b"))
    return a.join(b, ["key", "kind"]).where("a < b").select("a", "b").distinct()


def _scored(pairs: DataFrame, items: DataFrame, percent: float, allow_resize: bool) -> DataFrame:
    sig = F.struct(*(F.col(c) for c in items.columns))
    both = pairs.join(items.select(F.col("path").alias("a"), sig.alias("x")), "a").join(items.select(F.col("path").alias("b"), sig.alias("y")), "b")
    stills = both.where("x.kind = 'image'").withColumn("score", R.image_similarity(F.col("x"), F.col("y"), percent, allow_resize))
    clips = both.where("x.kind = 'video'").withColumn("score", R.video_similarity(F.col("x"), F.col("y"), percent, allow_resize))
    least = 1 - most_distance(percent) / 64
    return stills.unionByName(clips).where(F.col("score") >= least).select("a", "b", "score")


def dedupe_media(items: DataFrame, percent: float = 92, strategy: str = "largest", allow_resize: bool = True) -> DataFrame:
    """(path, component, kept) of the items that are linked by chains of similar pairs; one of each component is kept.

    items: (path, kind, exact_hash, the HASHES, frame_hashes, width, height, bytes, hue, luma, saturation, frames,
    duration), missing values null. Kept is the largest in bytes, then in pixels, then the first path in natural
    order; or the first path (``strategy`` other than ``largest``). Items without a similar one are not listed.
    """
    pairs = items.select("path", "exact_hash", "kind").where("exact_hash is not null") if percent >= 100 else None
    if pairs is not None:
        found = pairs.groupBy("kind", "exact_hash").agg(F.min("path").alias("a"), F.count("*").alias("n")).where("n > 1")
        links = pairs.join(found, ["kind", "exact_hash"]).where("path <> a").select("a", F.col("path").alias("b"))
    else:
        links = _scored(candidate_pairs(items), items, percent, allow_resize).select("a", "b")
    clusters = materialize(connected_components(links).withColumnRenamed("id", "path"), "clusters")
    rows = clusters.join(items.select("path", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), (F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))).alias("pixels")), "path")
    order = [natural_key(F.col("path")).alias("p"), F.col("path").alias("q")]
    if strategy == "largest":
        order = [(-F.col("bytes")).alias("b"), (-F.col("pixels")).alias("x"), *order]
    best = rows.groupBy("component").agg(F.min_by("path", F.struct(*order)).alias("keeper"))
    return rows.join(best, "component").select("path", "component", (F.col("path") == F.col("keeper")).alias("kept"))


def matches_of(items: DataFrame, target: DataFrame, percent: float = 92, allow_resize: bool = True) -> DataFrame:
    """(path, score) of the items of the target's kind that are similar to it, without the target itself.

    ``target`` is one row like those of ``items``; it may be one of them or come from elsewhere. No target gives no rows.
    """
    one = target.limit(1).select(F.col("path").alias("a"), F.struct(*(F.col(c) for c in items.columns)).alias("x"))
    pairs = items.withColumnRenamed("kind", "k").join(F.broadcast(one.select("a", F.col("x.kind").alias("k"))), "k").where("path <> a").select("a", F.col("path").alias("b"))
    return _scored(pairs, items.unionByName(target.limit(1).join(items.select("path"), "path", "left_anti")), percent, allow_resize).select(F.col("b").alias("path"), "score")
