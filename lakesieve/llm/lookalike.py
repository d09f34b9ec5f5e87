"""Problem 4: one consistent form for text that looks the same but is stored with different characters.

Method. Compatibility normalisation in composed form, removal of default-ignorable characters, every blank
mapped to a space, look-alike letters mapped to the plain one, and (unless switched off) full case folding;
done once per distinct value of a batch, with a fast path for plain ASCII. ``p4_found`` switches case folding
off, because there a letter's case counts.

The look-alikes are a short table of the frequent ones and, in operators on tables, those of the Unicode confusables,
taken from the ICU library that comes with Spark (``confusables``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.session import materialize

# Letters and signs and the plain ones that they look like, in the same order.
CYRILLIC = ("аеорсухѕіјһӏԁԛԝѵүАВЕКМНОРСТУХЅІЈӀԌԚԜѴҮ", "aeopcyxsijhldqwvyABEKMHOPCTYXSIJIGQWVY")
GREEK = ("αορνιυϲγκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳͿ", "aopviucykABEZHIKMNOPTYXCjJ")
ARMENIAN = ("ոսօցհԼՕՍ", "nuoghLOU")
LATIN = ("ɑɡıɩʟʀᴄᴏᴠᴡᴢꜱƖǃ", "agiiLRcovwzsl!")
SIGNS = ("‐‑‒−⁃∕⁄∶ː‚٫․∗", "-----//::,,.*")
# The ranges of default-ignorable characters.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


#: Last code point that confusables are asked of: the basic plane and the supplementary letters and digits.
LAST_CODE = 0x1FFFF


def confusables(spark: SparkSession) -> dict[int, str]:
    """Letter or digit beyond ASCII -> the one ASCII letter or digit that looks like it, as Unicode lists it.

    Two characters look alike if they have one skeleton. Of several plain characters with one skeleton (l, I, 1 and
    O, 0) a capital letter stands for the capital, a digit for the digit, any other letter for the small letter.
    Characters that decompose to others are left to normalisation.
    """
    codes = [c for c in range(128, LAST_CODE + 1) if unicodedata.category(chr(c))[0] in "LN" and unicodedata.normalize("NFKD", chr(c)) == chr(c)]
    plain = [c for c in range(33, 127) if chr(c).isalnum()]
    # One call: a skeleton is made character by character, and a line feed stays one.
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join(chr(c) for c in (*plain, *codes))).split("\n")
    if len(skeletons) != len(plain) + len(codes):
        return {}
    of: dict[str, list[str]] = {}
    for c, k in zip(plain, skeletons, strict=False):
        of.setdefault(k, []).append(chr(c))
    out = {}
    for c, k in zip(codes, skeletons[len(plain) :], strict=True):
        kind = unicodedata.category(chr(c))
        like = [p for p in of.get(k, []) if kind[0] == "L" or p.isdigit()]
        best = [p for p in like if (p.isupper() if kind == "Lu" else p.isdigit() if kind[0] == "N" else p.islower())]
        if best or len(like) == 1:
            out[c] = (best or like)[0]
    return out


class _Plain(dict):
    """Code point -> the plain character(s) it stands for, filled as characters are met."""

    def __init__(self) -> None:
        super().__init__()
        for look, plain in (CYRILLIC, GREEK, ARMENIAN, LATIN, SIGNS):
            self.update({ord(a): b for a, b in zip(look, plain, strict=True)})

    def __missing__(self, code: int) -> str | int:
        c = chr(code)
        if c.isspace() or code == 0x2800:
            plain: str | int = " "
        elif any(a <= code <= b for a, b in IGNORABLE) or unicodedata.category(c) == "Cc":
            plain = ""
        else:
            plain = code
        self[code] = plain
        return plain


_PLAIN = _Plain()
_BLANKS = {c: " " for c in range(0x1C, 0x20)} | {c: " " for c in range(9, 14)} | {c: "" for c in (*range(9), *range(14, 0x1C), 0x7F)}


def plain_form(text: str | None, fold_case: bool = True) -> str | None:
    """The form that all texts looking like ``text`` share; null for null.

    Applying it again changes nothing. With ``fold_case`` texts that differ in case only share a form too.
    """
    if text is None:
        return None
    if text.isascii():
        plain = text if text.isprintable() else text.translate(_BLANKS)
    else:
        plain = unicodedata.normalize("NFC", unicodedata.normalize("NFKD", text.translate(_PLAIN)).translate(_PLAIN))
    if not fold_case:
        return plain
    folded = plain.casefold()
    return folded if folded.isascii() else unicodedata.normalize("NFC", folded)


class _OneByOne(dict):
    """Code point -> its plain character(s) without composition; ``several`` has those that aren't exactly one."""

    def __init__(self) -> None:
        super().__init__({c: chr(c) for c in range(128)} | {c: " " for c in range(0x1C, 0x20)} | {c: " " for c in range(9, 14)})
        self.several: set[str] = set()

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = unicodedata.normalize("NFC", unicodedata.normalize("NFKD", c.translate(_PLAIN)).translate(_PLAIN))
        if 0x370 <= code < 0x590 and not plain.isascii():
            plain = c
        if len(plain) != 1:
            self.several.add(c)
        self[code] = plain
        return plain


_ONE = _OneByOne()


def plain_with_offsets(text: str) -> tuple[str, list[int] | None]:
    """(form of ``text`` without composition, for each of its characters the offset it comes from).

    The offsets are None where every character stands for exactly one.
    """
    if text.isascii() and text.isprintable():
        return text, None
    plain = text.translate(_ONE)
    if _ONE.several.isdisjoint(text):
        return plain, None
    at: list[int] = []
    for i, c in enumerate(text):
        at.extend([i] * len(_ONE[ord(c)]))
    return plain, at


def _forms(values: pd.Series, fold: bool) -> pd.Series:
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    forms = np.array([plain_form(v, fold) for v in distinct] + [None], dtype=object)
    return pd.Series(forms[codes])


def know(more: dict[int, str]) -> None:
    """Add look-alikes to those that this process knows; the frequent ones and what was met before stay."""
    for code, c in more.items():
        if _PLAIN.get(code, code) == code:
            _PLAIN[code] = c


def plain(c: Column, fold_case: bool = True, more: dict[int, str] | None = None) -> Column:
    """Column form of ``plain_form``, computed once per distinct value of a batch; ``more`` look-alikes are known too."""

    def run(values: pd.Series) -> pd.Series:
        know(more or {})
        return _forms(values, fold_case)

    return F.pandas_udf(run, "string")(c)


def _looks(more: dict[int, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know(more)
        digest, long = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest
        for batch in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in batch.columns), strict=True) if r[0] is not None and (r[1] is not None or r[2] is not None)]
            distinct = {r[1] for r in rows if r[1] is not None} | {v for r in rows if r[1] is None for _, v in r[2] if v is not None}
            form = {v: plain_form(v, False) for v in distinct}
            ids, high, low, stored = [], [], [], []
            for i, text, fields in rows:
                if text is not None:
                    as_is, look = "t" + text, "t" + form[text]
                else:
                    pairs = sorted(dict(fields).items())
                    as_is = "f" + "\x1e".join(k + ("\x1f=" + v if v is not None else "\x1f-") for k, v in pairs)
                    look = "f" + "\x1e".join(k + ("\x1f=" + form[v] if v is not None else "\x1f-") for k, v in pairs)
                h = long(look)
                ids.append(i)
                high.append(h >> 64)
                low.append(h & 0xFFFFFFFFFFFFFFFF)
                stored.append(digest(as_is))
            columns = [pa.array(ids, pa.int64()), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (high, low, stored))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "high", "low", "stored"])

    return run


def looks(requests: DataFrame) -> DataFrame:
    """(id, high, low, stored) of every request with a text or fields: hashes of its look and of what is stored, materialised."""
    more = confusables(requests.sparkSession)
    rows = requests.select(F.col("request_id").cast("long"), "text", "fields").mapInArrow(_looks(more), "id long, high long, low long, stored long")
    return materialize(rows.distinct(), "looks")


def look_classes(requests: DataFrame) -> DataFrame:
    """One row per request with a text or fields: (request_id, class_id, links).

    ``class_id`` is the smallest id of the requests that look the same, ``links`` the number of those that are stored
    differently. Nothing is expanded into pairs. Rows as in ``same_look_pairs``; a request that repeats its id with
    different contents has a row for each.
    """
    rows, look = looks(requests), ["high", "low"]
    kinds = rows.groupBy(*look, "stored").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    whole = kinds.groupBy(*look).agg(F.sum("n").alias("all"), F.min("first").alias("class_id"))
    each = kinds.join(whole, look).select(*look, "stored", "class_id", (F.col("all") - F.col("n")).alias("links"))
    return rows.join(each, [*look, "stored"]).select(F.col("id").alias("request_id"), "class_id", "links")


def same_look_pairs(requests: DataFrame) -> DataFrame:
    """(request_a, request_b), a < b, of requests that look the same but are not stored the same.

    Both have ``text``, or both have no text and ``fields`` with equal keys. A request with neither is left
    out; an empty text looks like one of invisible characters only; a null value looks like null only; requests
    stored alike are no pair, however many there are. Repeated rows of a request count once; requests that
    repeat an id with different contents count with each content.
    """
    rows = looks(requests)
    look = ["high", "low"]
    variants = rows.select(*look, "stored").distinct()
    several = variants.groupBy(*look).agg(F.count("*").alias("n")).where("n > 1").select(*look)
    few = materialize(rows.join(several, look), "variants")
    kinds = few.select(*look, "stored").distinct()
    a, b = (few.select(*look, F.col("stored").alias(s), F.col("id").alias(i)) for s, i in (("sa", "a"), ("sb", "b")))
    pairs = kinds.withColumnRenamed("stored", "sa").join(kinds.withColumnRenamed("stored", "sb"), look).where("sa < sb")
    full = pairs.join(a, [*look, "sa"]).join(b, [*look, "sb"])
    return full.where("a <> b").select(F.least("a", "b").alias("request_a"), F.greatest("a", "b").alias("request_b")).distinct()
