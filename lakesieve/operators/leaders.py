"""Greedy leader matching (M4-M6): order-dependent, not transitive, so it runs within one document.

A document's lines arrive in one row, so the pass is a vectorised map without a shuffle; its memory is the
document's. Matching across documents is a set-similarity join and not done here.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[A-Za-z0-9_]+")


def word_set(s: str) -> frozenset[str]:
    return frozenset(_WORDS.findall(s.lower()))


def similarity(a: str, b: str, x: frozenset[str], y: frozenset[str]) -> float:
    """M2."""
    if a == b:
        return 1.0
    if not x or not y:
        return 0.0
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def best_leaders(keys: list[str], threshold: float) -> list[tuple[int, int]]:
    """M4: (index of the leader's line, lines) of the leaders of ``keys`` in order.

    A key equal to a leader's joins it; else it joins the most similar leader (the earliest of equals) whose
    length differs by at most 0.6 of the key's length, if the similarity reaches ``threshold``; else it leads.
    """
    exact: dict[str, int] = {}
    leaders: list[list] = []
    for i, key in enumerate(keys):
        at = exact.get(key)
        if at is None and threshold < 1:
            words, best = word_set(key), -1.0
            for j, (_, other, other_words, _) in enumerate(leaders):
                if abs(len(other) - len(key)) > 0.6 * len(key):
                    continue
                n, m = len(words), len(other_words)
                if min(n, m) < max(threshold, best) * max(n, m):
                    continue
                s = similarity(key, other, words, other_words)
                if s > best:
                    best, at = s, j
            if at is not None and best < threshold:
                at = None
        if at is None:
            exact.setdefault(key, len(leaders))
            leaders.append([i, key, word_set(key), 1])
        else:
            leaders[at][3] += 1
    return [(x[0], x[3]) for x in leaders]


def any_match(keys: list[str], threshold: float) -> list[bool]:
    """M5: whether each key is similar to an earlier kept one; no length filter."""
    kept: list[tuple[str, frozenset[str]]] = []
    seen: set[str] = set()
    out = []
    for key in keys:
        words = word_set(key)
        hit = key in seen or (threshold < 1 and any(similarity(key, k, words, w) >= threshold for k, w in kept))
        out.append(hit)
        if not hit:
            kept.append((key, words))
            seen.add(key)
    return out


def _udf(fn: Callable[[list[str]], list], kind: str, c: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fn(list(v)))

    return F.pandas_udf(run, kind)(c)


def leader_lines(docs: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, n, line_no) of every document's leaders among its lines that are not blank.

    Null texts have none. ``line_no`` counts the lines that are not blank, from 0.
    """
    from lakesieve.functions.text import eol, raw_line

    lines = F.filter(F.transform(F.split(eol(F.col(text_col)), "\n"), lambda x: raw_line(x)), lambda x: x != "")
    found = docs.where(F.col(text_col).isNotNull()).select(id_col, lines.alias("lines"))
    marked = found.withColumn("leader", F.explode(_udf(lambda k: [{"at": i, "n": n} for i, n in best_leaders(k, threshold)], "array<struct<at:int,n:int>>", F.col("lines"))))
    return marked.select(id_col, F.get("lines", F.col("leader.at")).alias("line"), F.col("leader.n").alias("n"), F.col("leader.at").alias("line_no"))
