"""Pixels, frames, media runs, and the checks of runs."""

import numpy as np
from pyspark.sql import functions as F

from lakesieve.operators import frames as R
from lakesieve.operators import mediarun as V
from lakesieve.operators import verify as C


def test_pixels(spark):
    image = np.zeros((8, 9, 4), np.uint8)
    image[:, :, 0] = 255  # red
    h = R.hue_histogram(image.astype(float))
    assert h[0] == 1 and sum(h) == 1 and R.frame_stats(image.astype(float)) == (1.0, 0.0, 1.0)
    g = np.arange(64, dtype=float).reshape(8, 8)
    assert R.subsampled(g, 4, 2).tolist() == [[0, 2, 4, 6], [32, 34, 36, 38]] and bin(R.layout_hash(g) & (2**64 - 1)).count("1") == 32
    df = spark.createDataFrame([(bytearray(image.tobytes()), 9, 8), (None, 9, 8)], "d binary, w int, h int")
    a, b = df.select(R.profiles(F.col("d"), F.col("w"), F.col("h")).alias("p")).select("p.*").collect()
    assert a.dhash == 0 and a.ahash == -1 and a.luma == 1.0 and b.hue is None


def test_lists_and_frames(spark):
    one, two = [1.0] + [0.0] * 11, [0.0] * 11 + [1.0]
    frames = [(0, one, 0.1), (1, one, 0.3), (0, two, 0.5)]
    df = spark.createDataFrame([([1, 7], [7, 255], frames), ([], [1], [])], "a array<bigint>, b array<bigint>, f array<struct<dhash:bigint,hue:array<double>,luma:double>>")
    assert [r[0] for r in df.select(R.least_distance(F.col("a"), F.col("b"))).collect()] == [0, 64]
    assert [[x.luma for x in r[0]] for r in df.select(R.distinct_profiles(F.col("f"), 2)).collect()] == [[0.1, 0.5], []]


SCHEMA = """path string, kind string, exact_hash string, dhash long, ahash long, block_hash long, detail_hash long, color_hash long, frame_hashes array<bigint>, width int, height int, bytes long,
  hue array<double>, luma double, saturation double, frames array<struct<dhash:bigint,color_hash:bigint,detail_hash:bigint,hue:array<double>,luma:double,contrast:double>>, duration double"""


def item(path, kind="image", exact=None, d=None, a=None, detail=None, color=None, bytes_=1, frames=None, hue=None, duration=None):
    return (path, kind, exact, d, a, None, detail, color, None, 10, 10, bytes_, hue, None, None, frames, duration)


def test_media_runs(spark):
    flat = [1 / 12] * 12
    clip = [(3, 5, 9, flat, 0.5, 0.1), (1 << 40, 5, 9, flat, 0.5, 0.1)]
    rows = [
        item("a/img10.jpg", d=0, a=0), item("a/img9.jpg", d=1, a=0), item("b.jpg", d=0, a=0, detail=0, bytes_=0), item("far.jpg", d=0, a=(1 << 20) - 1),
        item("no.jpg", exact="e"), item("no2.jpg", exact="e"), item("v1.mp4", "video", d=3, frames=clip, hue=flat, duration=4.0, bytes_=5), item("v2.mp4", "video", d=3, frames=clip, hue=flat, duration=5.0), item("v3.mp4", "video", d=3, hue=[1.0] + [0.0] * 11),
    ]
    items = spark.createDataFrame(rows, SCHEMA)
    out = V.dedupe_media(items)
    got = {r.path: r.kept for r in out.collect()}
    assert got == {"a/img10.jpg": False, "a/img9.jpg": True, "b.jpg": False, "v1.mp4": True, "v2.mp4": False}
    assert all(r.ok for r in C.media_checks(items, out).collect())
    assert {r.path for r in V.dedupe_media(items, 100).collect()} == {"no.jpg", "no2.jpg"}
    target = spark.createDataFrame([item("elsewhere.jpg", d=0, a=0)], SCHEMA)
    assert {r.path for r in V.matches_of(items, target).collect()} == {"a/img10.jpg", "a/img9.jpg", "b.jpg"}
    assert V.dedupe_media(items.limit(0)).count() == 0


def test_checks_and_ladder(spark):
    from lakesieve.operators.project import process_project

    files = spark.createDataFrame([("a.txt", "x\nx"), ("b.txt", "y")], "path string, content string")
    after, stats = process_project(files)
    assert all(r.ok for r in C.folder_checks(files, after, stats).collect())
    runs = spark.createDataFrame([(1000, 489, 4), (25000, 12196, 69)], "total long, removed long, ms long")
    assert tuple(C.benchmark_summary(runs).first()) == (48.8, 362319, 25000)
    tried = []
    n, _ = C.ladder(lambda f, s, k: tried.append((f, s, k)) or files, "json", 1.0, lambda df: len(tried) == 3)
    assert n == 3 and tried == [("json", 1.0, False), ("txt", 1.0, False), ("json", 0.92, True)]
    assert C.ladder(lambda f, s, k: files, "json", 1.0, lambda df: False, fast=True)[0] == 1


def test_decided(spark):
    from lakesieve.streaming.events import decided

    rows = [("t", i, e, f, n, at, 60_000, True, s, w) for i, (e, f, n, at, s, w) in enumerate([("a", "f1", "one two three", 0, 0.0, []), ("a", "f2", "x y", 30, 0.0, []), (None, "f1", "zz", 40, 0.5, ["mixed_script"]), (None, "f9", "", 50, 0.0, ["empty"])])]
    df = spark.createDataFrame(rows, "tenant string, delivery_id long, event_id string, fingerprint string, normalized string, at long, window_ms long, remember boolean, score double, reasons array<string>").withColumn("at", F.timestamp_seconds("at"))
    got = {r.delivery_id: (r.duplicate, r.decision, r.score, r.reasons) for r in decided(df).collect()}
    assert got[0] == (False, "allow", 0.0, []) and got[1] == (True, "soft_reject", 0.0, ["duplicate_event"])
    assert got[2] == (True, "block", 0.9, ["mixed_script", "burst", "duplicate_event"]) and got[3][1] == "soft_reject"
    spam = {r.delivery_id: r.reasons for r in decided(df, "spam").collect()}
    assert spam[1] == [] and spam[2] == ["mixed_script", "burst"]
