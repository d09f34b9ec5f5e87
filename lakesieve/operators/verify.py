"""Invariant checks and the retry ladder (V1-V6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesieve.session import materialize


def line_checks(stats: DataFrame) -> DataFrame:
    """V1: (check, ok) of a one-row result (total, removed, remaining)."""
    checks = {
        "non_negative": (F.col("removed") >= 0) & (F.col("remaining") >= 0),
        "remaining_at_most_total": F.col("remaining") <= F.col("total"),
        "something_remains": (F.col("total") == 0) | (F.col("remaining") > 0),
        "sums_up": F.col("removed") + F.col("remaining") == F.col("total"),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks.items()))
    return stats.select(F.explode(rows).alias("x")).select("x.check", "x.ok")


def _checked(stats: DataFrame, checks: dict[str, Column]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks.items()))
    return stats.select(F.explode(rows).alias("x")).select("x.check", "x.ok")


def folder_checks(before: DataFrame, after: DataFrame, stats: DataFrame) -> DataFrame:
    """V2: (check, ok) of a folder run: ``before`` and ``after`` are files (path, content, ...), stats its counts."""
    filled = lambda df: df.select(F.coalesce(F.sum(F.size(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != ""))), F.lit(0)).alias("n"), F.count("*").alias("f"))
    old, new = filled(before), filled(after.where("not deleted")).withColumnRenamed("n", "m").drop("f")
    return _checked(
        stats.crossJoin(old).crossJoin(new),  # one row each
        {
            "files_accounted": F.col("files_kept") >= 0, "no_negative": (F.col("files_removed") >= 0) & (F.col("lines_removed") >= 0),
            "kept_plus_removed": F.col("files_kept") + F.col("files_removed") <= F.col("f"), "lines_not_increased": F.col("m") <= F.col("n"),
        },
    )


def media_checks(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """V3: (check, ok) of a media run: every component keeps one item, and no item is new."""
    per = clusters.groupBy("component").agg(F.count_if("kept").alias("kept")).agg(F.coalesce(F.bool_and(F.col("kept") == 1), F.lit(True)).alias("ok"))
    new = clusters.join(items, "path", "left_anti").agg((F.count("*") == 0).alias("ok"))
    return per.select(F.lit("one_kept").alias("check"), "ok").union(new.select(F.lit("none_new").alias("check"), "ok"))


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """One row of runs (total, removed, ms): mean share removed in percent, best lines a second, largest total."""
    return runs.agg(F.round(F.avg(F.col("removed") / F.col("total")) * 100, 1).alias("average_reduction"), F.max(F.round(F.col("total") * 1000 / F.col("ms"))).cast("long").alias("peak_throughput"), F.max("total").alias("largest"))


def ladder(run: Callable[[str, float, bool], DataFrame], fmt: str, similarity: float, accept: Callable[[DataFrame], bool], fast: bool = False) -> tuple[int, DataFrame]:
    """V4, V6: ``run(format, similarity, normalised)`` as asked, then as plain text, then with relaxed matching.

    The first accepted result counts, else the last one. ``fast`` skips the checks and takes the first result.
    """
    steps = [lambda: run(fmt, similarity, False), lambda: run("txt", similarity, False), lambda: run(fmt, relaxed(similarity, 2), True)]
    return first_passing(steps[:1] if fast else steps, (lambda df: True) if fast else accept)


def key_checks(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """V1: (check, ok): every key is left, none is new, and none is left twice."""
    b, a = before.select(key).distinct(), after.select(key)
    lost = b.join(a, key, "left_anti").agg((F.count("*") == 0).alias("ok")).select(F.lit("no_key_lost").alias("check"), "ok")
    new = a.join(b, key, "left_anti").agg((F.count("*") == 0).alias("ok")).select(F.lit("no_key_new").alias("check"), "ok")
    twice = a.groupBy(key).count().where("count > 1").agg((F.count("*") == 0).alias("ok")).select(F.lit("no_key_twice").alias("check"), "ok")
    return lost.union(new).union(twice)


def first_passing(attempts: list[Callable[[], DataFrame]], accept: Callable[[DataFrame], bool]) -> tuple[int, DataFrame]:
    """V4: the first attempt whose result is accepted, as (number from 1, result); the last one if none is."""
    result = None
    for i, attempt in enumerate(attempts, 1):
        result = attempt()
        if accept(result):
            return i, result
    if result is None:
        raise ValueError("no attempts")
    return len(attempts), result


def relaxed(similarity: float, attempt: int) -> float:
    """V4: the similarity of attempt 1, 2, ...: from exact to 0.92, then 0.08 less each time, 0.5 at least."""
    for _ in range(attempt - 1):
        similarity = 0.92 if similarity >= 1 else max(0.5, similarity - 0.08)
    return similarity


class Checkpoints:
    """V5: the last ``most`` stored states of a run, newest first out."""

    def __init__(self, most: int = 12) -> None:
        self.most, self.states = most, []

    def push(self, label: str, df: DataFrame) -> None:
        self.states = [*self.states, (label, materialize(df, "state"))][-self.most :]

    def revert(self) -> tuple[str, DataFrame]:
        return self.states.pop()
