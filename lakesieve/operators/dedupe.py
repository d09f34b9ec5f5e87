"""Exact deduplication of records with counts (A1-A6), filters, order and rendering.

Positions are single BIGINTs (document * 2^24 + line), so that "keep the first" is a hash aggregate of a long
and not a sort aggregate of a struct; the kept raw line is looked up by its position afterwards, and not at all
where the key is the line. Counts are combined before the shuffle, so a hot key costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesieve.functions import text as T
from lakesieve.functions.detect import detect_language
from lakesieve.functions.jsonx import valid_json

#: Lines that a document can have in a position.
LINES = 1 << 24


def positioned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pos, line): every line of every text. Null ids and null texts have none; line ends may be of any kind."""
    rows = T.lines_of(docs.where(F.col(id_col).isNotNull()), text_col, id_col)
    return rows.select((F.col(id_col).cast("long") * LINES + F.col("line_no")).alias("pos"), "line")


def keyed_lines(lines: DataFrame, **options) -> DataFrame:
    """(pos, line, key) of the lines that are not blank: ``line`` is the raw line, ``key`` what it is compared by."""
    raw = lines.select("pos", T.raw_line(F.col("line")).alias("line")).where("line <> ''")
    return raw.withColumn("key", T.comparison_key(F.col("line"), **options) if options else F.col("line"))


def unique_lines(keyed: DataFrame, key_is_line: bool = False) -> DataFrame:
    """A1-A3: (line, n, pos) of every key: its first line, its number of lines, its first position."""
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    if key_is_line:
        return groups.select(F.col("key").alias("line"), "n", "pos")
    return groups.select("n", "pos").join(keyed.select("pos", "line"), "pos").select("line", "n", "pos")


def unique_todos(keyed: DataFrame) -> DataFrame:
    """A4: like ``unique_lines``, but the last done line of a key replaces its first line."""
    done = F.contains(F.lower("line"), F.lit("[x]")) | F.contains(F.upper("line"), F.lit("DONE:"))
    groups = keyed.withColumn("done", done).groupBy("key").agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(F.col("done"), F.col("pos"))), F.min("pos")).alias("pos"))
    return groups.select("n", "pos").join(keyed.select("pos", "line"), "pos").select("line", "n", "pos")


def filtered(uniques: DataFrame, mode: str = "all") -> DataFrame:
    """``all``, only ``duplicates``, or only ``singletons``."""
    return {"all": uniques, "duplicates": uniques.where("n > 1"), "singletons": uniques.where("n = 1")}[mode]


def ordered(uniques: DataFrame, order: str = "original") -> DataFrame:
    """O1: ``original``, ``alpha-asc``, ``alpha-desc`` or ``freq-desc``; ties keep the input's order."""
    by: dict[str, list[Column]] = {"original": [], "alpha-asc": [F.upper("line").asc()], "alpha-desc": [F.upper("line").desc()], "freq-desc": [F.col("n").desc()]}
    return uniques.orderBy(*by[order], F.col("pos").asc())


def imports_first(uniques: DataFrame, order: str = "original") -> DataFrame:
    """O2: import-like lines first, by upper case; the others in ``order``."""
    is_import = F.col("line").rlike(f"(?i)^[{T.WS}]*(?:import|from|require|use|#include){T.RB}")
    marked = uniques.withColumn("is_import", is_import)
    head = F.when(F.col("is_import"), F.upper("line"))
    tail = {"original": F.col("pos").asc(), "alpha-asc": F.upper("line").asc(), "alpha-desc": F.upper("line").desc(), "freq-desc": F.col("n").desc()}[order]
    return marked.orderBy(F.col("is_import").desc(), head.asc(), tail, F.col("pos").asc()).drop("is_import")


def stacked(uniques: DataFrame) -> DataFrame:
    """``xN line``."""
    return uniques.withColumn("line", F.concat(F.lit("x"), F.col("n").cast("string"), F.lit(" "), F.col("line")))


def stats(lines: DataFrame, uniques: DataFrame, count_blank: bool = False) -> DataFrame:
    """One row (total, removed, remaining). ``count_blank``: blank lines count, as for logs, code and lists."""
    total = lines.agg(F.count("*").alias("total")) if count_blank else lines.where(T.js_trim(F.col("line")) != "").agg(F.count("*").alias("total"))
    left = uniques.agg(F.count("*").alias("remaining"))
    both = total.select("total", F.lit(0).cast("long").alias("remaining")).unionByName(left.select(F.lit(0).cast("long").alias("total"), "remaining"))
    return both.agg(F.sum("total").alias("total"), F.sum("remaining").alias("remaining")).select("total", (F.col("total") - F.col("remaining")).alias("removed"), "remaining")


def code_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", strings: bool = False, numbers: bool = False, **filters) -> DataFrame:
    """A3: (pos, id, line_no, line, key) of the lines of programs, also of blank ones, without block comments.

    The language is that of the whole text; ``strings`` and ``numbers`` blank literals in the keys (N10). Null ids and
    null texts have none.
    """
    text = T.eol(F.col(text_col))
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text.alias("text"), detect_language(F.col(path_col), text).alias("language"))
    bare = rows.select(id_col, "language", T.strip_blocks(F.col("text"), F.col("language")).alias("text"))
    lines = T.lines_of(bare, "text", id_col, "language").select(id_col, "language", "line_no", T.raw_line(F.col("line")).alias("line"))
    key = T.compare_filter(T.code_edges(T.code_metadata(T.strip_line_comments(F.col("line"), F.col("language")), strings, numbers)), **filters)
    return lines.select((F.col(id_col).cast("long") * LINES + F.col("line_no")).alias("pos"), id_col, "line_no", "line", key.alias("key"))


def csv_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A5 within every document: (id, pos, row, n, is_header).

    A line feed within quotes does not end a row. The first row that is not blank is the header and always stays; blank rows and rows before it are dropped;
    equal rows after it count once.
    """
    lines = T.lines_of(docs.where(F.col(id_col).isNotNull()), text_col, id_col)
    # A row goes on in the next line while a quote is open: the quotes before a line are odd in number.
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    before = F.coalesce(F.sum(quotes).over(Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head_no = F.max(F.when(F.col("before") % 2 == 0, F.col("line_no"))).over(Window.partitionBy(id_col).orderBy("line_no"))
    whole = lines.withColumn("before", before).withColumn("row_no", head_no).groupBy(id_col, "row_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    raw = whole.select(id_col, F.col("row_no").alias("line_no"), F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line")).where(T.js_trim(F.col("line")) != "")
    groups = raw.groupBy(id_col, "line").agg(F.count("*").alias("n"), F.min("line_no").alias("pos"))
    head = raw.groupBy(id_col).agg(F.min("line_no").alias("head"))
    marked = groups.join(head, id_col).withColumn("is_header", F.col("pos") == F.col("head"))
    return marked.select(id_col, "pos", F.col("line").alias("row"), "n", "is_header")


def canonical_json(c: Column) -> Column:
    """An object's members by name, without white space; a text that isn't JSON stays as it is.

    Numbers keep the engine's rendering: exponents, long integers and repeated keys may print differently from
    ECMAScript; such texts go through ``lakesieve.functions.jsonx`` instead.
    """
    parsed = F.try_parse_json(c)
    is_text = F.schema_of_variant(parsed) == "STRING"  # a text prints without quotes
    return F.coalesce(F.when(valid_json(c), F.when(is_text, F.try_variant_get(parsed, "$", "string")).otherwise(F.to_json(parsed))), c)


def unique_json(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, n, first, item) of JSON items: canonical form, number of items, smallest id and the item with that id."""
    keyed = items.where(F.col(text_col).isNotNull()).select(canonical_json(F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("item"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    texts = keyed.groupBy(F.col("id").alias("first")).agg(F.min("item").alias("item"))
    return groups.join(texts, "first").select("key", "n", "first", "item")
