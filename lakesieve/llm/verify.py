"""Exact verification of candidate pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesieve.llm.signatures import words_of


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        p, q = words_of(x), words_of(y)
        both = len(p & q)
        union = len(p) + len(q) - both
        out.append(both / union if union else 0.0)
    return pd.Series(out, dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two text columns; null if either is null, 0 if both are empty."""
    return F.pandas_udf(_jaccard, "double")(a, b)


def with_texts(pairs: DataFrame, texts: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """``pairs`` plus ``text_a`` and ``text_b``, looked up in ``texts(key, text)`` by equi-joins.

    Only the keys that occur in a pair are looked up.
    """
    a = texts.select(F.col(key).alias(left), F.col("text").alias("text_a"))
    b = texts.select(F.col(key).alias(right), F.col("text").alias("text_b"))
    return pairs.join(a, left).join(b, right)
