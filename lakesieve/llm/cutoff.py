"""Problem 8: text cut off by field limits or in transfer.

Method. A self-join by prefix, on whole values and on the units that texts are made of. A value or unit that is a
strict prefix of a longer one elsewhere, which goes on in the same line, is unfinished:

* whole documents, joined on hashes of fixed-length prefixes, doubling (``prefix_values``);
* the last sentence or line of every text whose end is open, joined with all sentences and lines on the hash of its
  whole length (``longer_sentences``);
* its last word, joined with all longer words (``extended``);
* its last word as the beginning of what is left of a sentence: how often it goes on there, and how often it closes
  one (``closing_units``); the same for the last cells of rows, ends of log lines, and last lines of forms and mails.

The first of these that tells something decides (``evidence`` names it). Ends that show by themselves (a terminated
sentence, JSON that parses, an unfinished character, a short row) are settled before the join.

Length limits are learned per source from all documents: a limit is the source's largest length, in characters
or bytes, if several documents share it. At a limit also a text that a trailing "..." was put on is cut.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesieve.session import materialize

#: Bits of the screens that tell which prefixes are asked for; their size is fixed, a full screen only lets more pass.
SCREEN_BITS = 1 << 22
#: Documents that must share a source's largest length for it to be a limit.
LIMIT_DOCS = 3
#: Keys a task counts before it hands them on.
MOST_KEYS = 200_000
#: Blanks of a text for Spark, and how a longer copy goes on after an unfinished word, sentence or row.
_BLANK = r"[\s\u0085   -     　]"
_GOES_ON = r"^(?:[^ \n\p{So}\p{Cf}]| [\p{L}\p{N}])"
_GOES_ON_PY = r"\w| \w"
_END = ".!?。！？…।؟"
_CLOSERS = "\"'»”’)]}›」』*_`"
_WORD = re.compile(r"[^\W\d_]+")
_FINAL = re.compile(rf"([^\W\d_]+)[{_END}]")
_STAMP = re.compile(r"^\s*(?:\[\d{4}-\d\d-\d\d|\d{4}-\d\d-\d\d[T ]\d\d:)")
_FORM_LINE = re.compile(r"^\s*[A-Za-z_][\w\- ]{0,30}[=:]")
_CODE_LINE = re.compile(r"^\s*(?:def |class |function |import |from \w+ import|#!|//|/\*|async |const |let |var |public |package )")
_TODO_LINE = re.compile(r"^\s*(?:[-*] \[.\] |(?:TODO|DONE|WAITING|PENDING|CANCELLED|COMPLETED):)")
_GREETING = re.compile(r"^\s*(?:hi|hello|dear|hey)\b[^\n]{0,40},\s*$", re.I)


def clean(text: str) -> str:
    """``text`` in composed form without byte order marks, line ends as one line feed."""
    return unicodedata.normalize("NFC", text.replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n"))


def _first_lines(text: str, n: int) -> list[str]:
    """The first ``n`` lines that are not blank."""
    out, at = [], 0
    while len(out) < n and at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if (line := text[at:end]).strip():
            out.append(line)
        at = end + 1
    return out


_SENTENCE = re.compile(r"(?<=[.!?。！？؟])[\"'»”’)\]]*\s+")


def pieces(body: str, kind: str) -> list[str]:
    """The sentences of prose and mails, the lines of all else, in lower case and with single blanks."""
    out = []
    for line in body.split("\n"):
        parts = _SENTENCE.split(line) if kind in ("prose", "mail") else (line,)
        out += [" ".join(p.split()).lower() for p in parts if p and not p.isspace()]
    return out


def kind_of(text: str, declared: str | None) -> str:
    """What a text is made of: json, csv, log, code, form, mail or prose (also lists and Markdown)."""
    head = text.lstrip()[:1]
    lines = _first_lines(text, 5)
    first = lines[0] if lines else ""
    if head in ("{", "[") and not _STAMP.match(first) and not _TODO_LINE.match(first) and declared in (None, "json"):
        return "json"
    if (declared in (None, "log")) and _STAMP.match(first):
        return "log"
    rows = len(lines) > 1 and any(first.count(d) == lines[1].count(d) >= 2 for d in ";,\t") and not first.rstrip().endswith(tuple(_END + ",")) and len(first) < 200
    if declared == "csv" or (declared is None and rows):
        return "csv"
    if declared == "code" or (declared is None and any(_CODE_LINE.match(x) for x in lines[:5])):
        return "code"
    if (declared in (None, "form")) and len(lines) > 1 and all(_FORM_LINE.match(x) for x in lines[:2]) and not _TODO_LINE.match(first):
        return "form"
    if (declared in (None, "mail")) and (_GREETING.match(first) or declared == "mail"):
        return "mail"
    return "prose"


def _json_complete(text: str) -> bool:
    plain = "".join(" " if c.isspace() else c for c in text).strip()
    try:
        json.loads(plain, strict=False)
        return True
    except ValueError:
        pass
    for line in text.split("\n"):
        line = "".join(" " if c.isspace() else c for c in line).strip()
        if line:
            try:
                json.loads(line, strict=False)
            except ValueError:
                return False
    return True


def _cells(line: str, delimiter: str) -> list[str] | None:
    """Cells of one row; None if a quote stays open."""
    out, cell, quoted = [], [], False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            out.append("".join(cell).strip())
            cell = []
        else:
            cell.append(c)
    return None if quoted else [*out, "".join(cell).strip()]


def _delimiter(line: str) -> str:
    return max(",;\t|", key=line.count)


def _cell_key(cell: str) -> str:
    return re.sub(r"\d+(?=[.,]\d)", "0", re.sub(r"^-?\d+$", "0", cell)) if cell[:1].isdigit() or cell[:1] == "-" else cell.lower()


def _cell_shape(cell: str) -> str:
    key = _cell_key(cell)
    return re.sub(r"\d", "0", key)


def _line_end(line: str) -> str:
    """The end of a log line: its last token, numbers and hexadecimal runs masked."""
    token = line.split()[-1] if line.split() else ""
    return re.sub(r"[0-9a-f]{6,}", "#", re.sub(r"\d+", "0", token)) if not re.search(r"[0-9a-f]{6,}", token) else re.sub(r"[0-9a-f]{6,}", "#", token)


def end_of(text: str, declared: str | None) -> tuple[str, str, str]:
    """(kind, state, key) of a text's end. state is complete, cut, dots or open; key is what an open end is looked up by.

    Blank texts are complete.
    """
    t = clean(text)
    kind = kind_of(t, declared)
    body = t.rstrip()
    if not body:
        return kind, "complete", ""
    if body.endswith("�"):
        return kind, "cut", ""
    lines = body.split("\n")
    last = " ".join(lines[-1].split())
    if kind == "json":
        return kind, "complete" if _json_complete(t) else "cut", ""
    if kind == "csv":
        d = _delimiter(lines[0])
        header, row = _cells(lines[0], d), _cells(last, d)
        if row is None or header is None or (len(lines) > 1 and len(row) < len(header)):
            return kind, "cut", ""
        if t.endswith("\n") or len(lines) == 1:
            return kind, "complete", ""
        return kind, "open", _cell_shape(row[-1])
    if kind == "log" and _STAMP.match(last) is None and len(lines) > 1 and not last.endswith(tuple(_END)):
        return kind, "cut", ""
    if kind == "log":
        return kind, "complete" if t.endswith("\n") else "open", _line_end(last)
    if kind == "code":
        return kind, "open", last
    if kind == "form":
        return kind, "open", last.lower()
    before = next((x.strip() for x in reversed(lines[:-1]) if x.strip()), "")
    if before.endswith(",") and len(before) < 40 and 0 < len(last.split()) <= 4 and not last.endswith(","):
        return "mail", "open", last.lower()
    stripped = body
    while stripped and (stripped[-1] in _CLOSERS or unicodedata.category(stripped[-1]) in ("So", "Sk", "Mn", "Cf", "Me") or stripped[-1].isspace()):
        stripped = stripped[:-1]
    if body.endswith(("...", "…")):
        return kind, "dots", ""
    if not stripped or stripped[-1] in _END:
        return kind, "complete", ""
    if stripped != body and unicodedata.category(body[-1]) == "So":
        return kind, "complete", ""
    if last.startswith("#") and kind == "prose" and len(lines) > 1:
        word = _WORD.findall(last)
        return "heading", "open", word[-1].lower() if word else last
    word = re.search(r"[^\W\d_]+$", stripped)
    return "prose", "open" if word and t[-1:] not in " \t " else "cut", word.group().lower() if word else ""


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for batch in batches:
        rows: list[tuple] = []
        for i, text, source, declared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if i is None or text is None or not text.strip():
                continue
            kind, state, key = end_of(text, declared)
            value = " ".join(clean(text).split())
            prefixes, p = [], 1
            while p <= len(value):
                prefixes.append(signed(digest(f"{p}:{value[:p]}")))
                p *= 2
            whole = text.rstrip("�")
            tail = None
            if state == "open":
                last = pieces(clean(text).rstrip().rsplit("\n", 1)[-1], "prose" if kind in ("prose", "heading") else kind)
                tail = last[-1] if last else None
            near, at_all = (signed(digest(tail[: 1 << (len(tail).bit_length() - 1)])), signed(digest(tail))) if tail else (None, None)
            rows.append((i, source, len(text), len(whole.encode()), kind, state, key, signed(digest(value)), len(value), prefixes, near, at_all, len(tail or "")))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 13
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32())
        names = ["doc_id", "source", "chars", "bytes", "kind", "state", "key", "value", "length", "prefixes", "near", "tail", "tail_length"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def facts(docs: DataFrame) -> DataFrame:
    """What is known of every document that is not blank, materialised."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text", "source", F.lower(F.trim("format")).alias("format"))
    schema = "doc_id long, source string, chars int, bytes int, kind string, state string, key string, value long, length int, prefixes array<long>, near long, tail long, tail_length int"
    return materialize(narrow.mapInArrow(_facts, schema), "facts")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()
    closing: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(n.keys() | closing.keys())
        out = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([closing[k] for k in keys], pa.int64())]
        n.clear()
        closing.clear()
        return pa.RecordBatch.from_arrays(out, ["kind", "key", "uses", "closing"])

    for batch in batches:
        for text, declared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text is None or not text.strip():
                continue
            t = clean(text)
            kind = kind_of(t, declared)
            body = t.rstrip()
            if kind == "csv":
                d = _delimiter(body.split("\n", 1)[0])
                ends = [_cell_shape(row[-1]) for x in body.split("\n")[1:-1] if x and (row := _cells(x, d))]
                closing.update(("csv", e) for e in ends)
            elif kind == "log":
                closing.update(("log", _line_end(x)) for x in body.split("\n")[:-1] if x.strip())
            elif kind in ("code", "form", "mail"):
                last = " ".join(body.rsplit("\n", 1)[-1].split())
                closing[(kind, last if kind == "code" else last.lower())] += 1
            if kind in ("prose", "mail"):
                low = t.lower()
                n.update(("prose", w) for w in _WORD.findall(low))
                closing.update(("prose", w) for w in _FINAL.findall(low))
                if "#" in t:
                    heads = [_WORD.findall(x) for x in low.split("\n")[:-1] if x.startswith("#")]
                    closing.update(("heading", w[-1]) for w in heads if w)
            if len(n) + len(closing) > MOST_KEYS:
                yield flush()
    yield flush()


def closing_units(docs: DataFrame) -> DataFrame:
    """(kind, key, uses, closing): how often every unit occurs, and how often it closes a complete one.

    Counted over all documents. Units are words of prose, last cells of rows, ends of log lines and last lines;
    the last row and line of a document are left out where others tell how one ends.
    """
    narrow = docs.select("text", F.lower(F.trim("format")).alias("format"))
    return narrow.mapInArrow(_units, "kind string, key string, uses long, closing long").groupBy("kind", "key").agg(F.sum("uses").alias("uses"), F.sum("closing").alias("closing"))


def extended(keys: DataFrame, units: DataFrame) -> DataFrame:
    """(kind, key, longer, longer_uses): the uses of units that ``key`` is a strict prefix of.

    The self-join by prefix: a unit's prefix of every length that a key of its kind has is joined with the keys.
    """
    short = keys.select("kind", "key").distinct()
    lengths = short.select("kind", F.length("key").alias("n")).where("n > 0").distinct()
    longer = units.select("kind", F.col("key").alias("long"), F.greatest("uses", "closing").alias("uses"))
    each = longer.join(lengths, "kind").where(F.col("n") < F.length("long")).select("kind", F.expr("substring(long, 1, n)").alias("key"), "uses")
    return each.join(short, ["kind", "key"], "left_semi").groupBy("kind", "key").agg(F.count("*").alias("longer"), F.sum("uses").alias("longer_uses"))


def _screen(known: DataFrame, column: str) -> bytes:
    """A bit for every value of a hash column, in SCREEN_BITS bits."""
    words = known.where(F.col(column).isNotNull()).select(F.pmod(F.col(column), F.lit(SCREEN_BITS)).alias("b"))
    folded = words.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    out = np.zeros(SCREEN_BITS // 64, dtype=np.int64)
    for w, bits in folded.collect():  # SCREEN_BITS / 64 rows at most
        out[w] = bits
    return out.tobytes()


def longer_sentences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(tail, going_on, whole): of the last sentences or lines of open ends, how many others elsewhere begin with them
    and go on, and how many are just them and closed by a line end or a further sentence.

    Every sentence and line of every document is compared by the hashes of its prefixes, of those lengths only that
    the screens know; counts are combined within a task.
    """
    near, whole = _screen(known, "near"), _screen(known, "tail")
    step = re.compile(_GOES_ON_PY)
    # The lengths that occur, at most as many as the longest line has characters, by the power of two below them.
    lengths = sorted(r[0] for r in known.where("tail_length > 0").select("tail_length").distinct().collect())
    spans = [(1 << k, [m for m in lengths if m.bit_length() - 1 == k]) for k in sorted({m.bit_length() - 1 for m in lengths})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        near_bits, all_bits = memoryview(near), memoryview(whole)
        mask = SCREEN_BITS - 1
        going: Counter = Counter()
        equal: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(going.keys() | equal.keys())
            signed = [h - (1 << 64) if h >> 63 else h for h in keys]
            out = pa.RecordBatch.from_arrays([pa.array(signed, pa.int64()), pa.array([going[k] for k in keys], pa.int64()), pa.array([equal[k] for k in keys], pa.int64())], ["tail", "going_on", "whole"])
            going.clear()
            equal.clear()
            return out

        for batch in batches:
            for text, declared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None or not text.strip():
                    continue
                t = clean(text)
                parts = pieces(t.rstrip(), kind_of(t, declared))
                for i, u in enumerate(parts):
                    n = len(u)
                    if i < len(parts) - 1:  # the last one may be cut itself
                        h = digest(u)
                        if all_bits[(h & mask) >> 3] >> (h & 7) & 1:
                            equal[h] += 1
                    for p, lengths in spans:
                        if p >= n:
                            break
                        h = digest(u[:p])
                        if near_bits[(h & mask) >> 3] >> (h & 7) & 1:
                            for m in lengths:
                                if m >= n:
                                    break
                                h = digest(u[:m])
                                if all_bits[(h & mask) >> 3] >> (h & 7) & 1 and step.match(u, m):
                                    going[h] += 1
                if len(going) + len(equal) > MOST_KEYS:
                    yield flush()
        yield flush()

    narrow = docs.select("text", F.lower(F.trim("format")).alias("format"))
    return narrow.mapInArrow(run, "tail long, going_on long, whole long").groupBy("tail").agg(F.sum("going_on").alias("going_on"), F.sum("whole").alias("whole"))


def prefix_values(known: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, unfinished) of documents whose value is a strict prefix of a longer document.

    ``unfinished``: a longer copy goes on in the same line, so the last word, sentence or row is not whole.

    Distinct values are joined on the hash of the longest doubled prefix that fits the shorter one; the text
    decides. Copies of a value count once, so a hot group costs one row per different value.
    """
    values = known.where("size(prefixes) > 0").groupBy("value").agg(F.max("length").alias("length"), F.max("prefixes").alias("prefixes"), F.min("doc_id").alias("head"))
    values = materialize(values, "values")
    probe = values.select("head", "length", F.element_at("prefixes", -1).alias("h"))
    index = values.select(F.col("head").alias("other"), F.col("length").alias("longer"), F.explode("prefixes").alias("h"))
    pairs = materialize(probe.join(index, "h").where("longer > length").select("head", "other").distinct(), "prefix-pairs")
    wanted = pairs.select(F.col("head").alias("doc_id")).union(pairs.select(F.col("other").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    lined = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "﻿", ""), rf"(?:(?![\n\r]){_BLANK})+", " "), r" ?[\n\r][\n\r ]*", "\n")
    flat = texts.select("doc_id", F.btrim(lined, F.lit(" \n")).alias("lined"), F.endswith(lined, F.lit("\n")).alias("ended")).withColumn("text", F.translate("lined", "\n", " "))
    both = pairs.join(flat.select(F.col("doc_id").alias("head"), F.col("text").alias("a"), "ended"), "head").join(flat.select(F.col("doc_id").alias("other"), F.col("text").alias("b"), "lined"), "other")
    unfinished = ~F.col("ended") & F.expr("substring(lined, length(a) + 1, 2)").rlike(_GOES_ON)
    heads = both.where("startswith(b, a) and length(b) > length(a)").groupBy("head").agg(F.max(unfinished).alias("unfinished"))
    cut_values = values.join(heads, "head").select("value", "unfinished")
    return known.join(cut_values, "value").groupBy("doc_id").agg(F.max("unfinished").alias("unfinished"))


def limits(known: DataFrame) -> DataFrame:
    """(source, unit, size): the length limit of every source that has one.

    A source's largest length is its limit if LIMIT_DOCS documents or more have it (for bytes: or up to three
    bytes less, where a character did not fit). The unit with more documents at it wins.
    """
    per = known.where("source is not null").select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")))).alias("x")).select("source", "x.*")
    counts = per.groupBy("source", "unit", "n").count()
    most = counts.groupBy("source", "unit").agg(F.max("n").alias("size"))
    slack = F.when(F.col("unit") == "bytes", 3).otherwise(0)
    at = counts.join(most, ["source", "unit"]).where((F.col("n") >= F.col("size") - slack) & (F.col("size") > 0)).groupBy("source", "unit", "size").agg(F.sum("count").alias("docs"))
    best = at.where(F.col("docs") >= LIMIT_DOCS).groupBy("source").agg(F.max(F.struct("docs", F.col("unit") == "chars", "unit", "size")).alias("b"))
    return best.select("source", "b.unit", "b.size", "b.docs")


def evidence(docs: DataFrame) -> DataFrame:
    """(doc_id, source, kind, state, at_limit, evidence, cut) of every document that is not blank.

    ``evidence`` tells what decided: itself (the end), document, sentence, word, going_on (the prefix joins), or limit.
    """
    known = facts(docs)
    open_ = known.where("state = 'open'")
    units = materialize(closing_units(docs), "units")
    keys = open_.groupBy("kind", "key").agg(F.count("*").alias("ends"))
    total = known.groupBy("kind").agg(F.count("*").alias("of_kind"))
    judged = keys.join(units, ["kind", "key"], "left").join(extended(keys, units), ["kind", "key"], "left").join(total, "kind", "left").na.fill(0, ["uses", "closing", "longer", "longer_uses", "of_kind"])
    line_end = F.col("kind").isin("code", "form")
    whole = (
        F.when(line_end, (F.col("closing") >= 2) & (F.col("closing") >= 0.01 * F.col("of_kind")))
        .when(F.col("kind") == "mail", ~((F.col("longer") > 0) & (F.col("longer_uses") >= F.col("closing"))))
        .when(F.col("kind").isin("csv", "log"), (F.col("closing") >= 2) & ~((F.col("longer_uses") > 20 * F.col("closing")) & (F.col("kind") == "csv") & F.col("key").rlike("^[^\\d]")))
        .when(F.col("kind") == "heading", (F.col("closing") >= 1) | (F.col("longer") == 0))
        .otherwise((F.col("uses") > 0) & (F.col("closing") >= 0.6 * F.col("uses")))
    )
    word = (F.col("kind") == "prose") & (F.col("longer") > 0) & (F.col("uses") <= F.col("ends"))  # it occurs at open ends only
    judged = judged.select("kind", "key", whole.alias("whole_key"), word.alias("word"))
    sentences = longer_sentences(docs, open_).where("going_on > whole").select("tail", F.lit(True).alias("sentence"))
    limit = limits(known)
    near = F.when(F.col("unit") == "chars", F.col("chars") == F.col("size")).when(F.col("unit") == "bytes", F.col("bytes").between(F.col("size") - 3, F.col("size")))
    sizes = limit.select(F.col("size").alias("any_size"), F.col("unit").alias("any_unit")).distinct()
    nowhere = known.where("source is null").select("doc_id", F.explode(F.array(F.struct(F.lit("chars").alias("any_unit"), F.col("chars").alias("any_size")), F.struct(F.lit("bytes").alias("any_unit"), F.col("bytes").alias("any_size")))).alias("x")).select("doc_id", "x.*")
    elsewhere = nowhere.join(sizes, ["any_unit", "any_size"], "left_semi").select("doc_id", F.lit(True).alias("elsewhere")).distinct()
    prefixed = prefix_values(known, docs).withColumn("prefix", F.lit(True))
    all_ = known.join(judged, ["kind", "key"], "left").join(sentences, "tail", "left").join(limit, "source", "left").join(elsewhere, "doc_id", "left").join(prefixed, "doc_id", "left")
    at_limit = F.coalesce(near, F.col("elsewhere"), F.lit(False))
    is_open = F.col("state") == "open"
    told = (
        F.when(is_open & F.col("unfinished"), "document").when(is_open & F.col("sentence"), "sentence").when(is_open & F.col("word"), "word").when(is_open, "going_on")
        .when((F.col("state") == "dots") & at_limit, "limit").when((F.col("state") == "dots") & F.coalesce("prefix", F.lit(False)), "document").otherwise("itself")
    )
    cut = F.when(F.col("told") == "going_on", ~F.coalesce("whole_key", F.lit(False))).when(F.col("told") == "itself", F.col("state") == "cut").otherwise(F.lit(True))
    return all_.withColumn("told", told).select("doc_id", "source", "kind", "key", "state", at_limit.alias("at_limit"), F.col("told").alias("evidence"), cut.alias("cut"))


def cut_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` of every document whose text was cut.

    Null, empty and blank texts are no cases, nor are complete texts, whatever they end with; a null source or
    format is inferred from the text or goes without; rows that repeat a document come out once.
    """
    return evidence(docs).where("cut").select("doc_id").distinct()


def cut_evidence(docs: DataFrame) -> DataFrame:
    """(evidence, documents): how many cut documents each kind of evidence decided."""
    return evidence(docs).where("cut").groupBy("evidence").agg(F.count_distinct("doc_id").alias("documents"))


def cut_shares(docs: DataFrame) -> DataFrame:
    """(source, documents, cut, share) of every source, also of the null one; all documents count."""
    cut = cut_documents(docs).withColumn("is_cut", F.lit(1))
    all_ = docs.select(F.col("doc_id").cast("long"), "source").where("doc_id is not null").dropDuplicates(["doc_id"]).join(cut, "doc_id", "left")
    return all_.groupBy("source").agg(F.count("*").alias("documents"), F.count("is_cut").alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("documents"), 4))
