"""Operators on trees of files: skip rules, duplicate files, lines across files, code blocks.

Files are rows (path, content, ...); flags are columns and nothing is changed in place. Identity of contents is
SHA-256 and not a 32-bit hash, which could merge different files. A file counts as its content only if it has
one: a missing content is an error row, never an empty file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesieve.functions import text as T
from lakesieve.functions.hashing import content_hash

# Folders that are left out by switch, names of entry points, how tests are named.
IGNORED = {
    "node_modules": ("node_modules",), "git": (".git", ".svn", ".hg"), "dist": ("dist", "build", ".next", "coverage", "out"), "vendor": ("vendor", "__pycache__", ".cache"),
}
ENTRY_NAMES = ("index", "main", "app", "__init__", "mod")
TEST = "(?i)\\.test\\.|\\.spec\\.|^test_|/tests?/"

DATA_FORMATS = ("txt", "csv", "json", "log", "todo", "excel")


def ignored(path: Column, switches: tuple[str, ...] = ("node_modules", "git", "dist", "vendor")) -> Column:
    """Whether a folder on the path is left out."""
    names = [n for s in switches for n in IGNORED[s]]
    return F.exists(F.split(F.lower(T.path_normalize(path)), "/"), lambda p: p.isin(*names))


def skip_rules(text: str) -> list[str]:
    """Rules of a list: one a line, without comments, lower case, each once."""
    lines = (x.split("#", 1)[0].strip().lower().replace("\\", "/") for x in text.splitlines())
    return list(dict.fromkeys(x for x in lines if x))


def skipped(path: Column, rules: list[str]) -> Column:
    """Whether a rule matches: a folder or file name anywhere, a path (exact, at the start, end or inside), or a glob."""
    p = F.lower(T.path_normalize(path))
    hit = F.lit(False)
    for rule in rules:
        if "*" in rule:
            pattern = "^" + ".*".join(re.escape(x) for x in rule.split("*")) + "\\z"
            hit = hit | p.rlike(pattern) | T.basename(p).rlike(pattern)
        elif "/" in rule.strip("/"):
            r = rule.strip("/")
            hit = hit | (p == r) | p.startswith(r + "/") | p.endswith("/" + r) | p.contains(f"/{r}/")
        else:
            hit = hit | F.array_contains(F.split(p, "/"), rule.strip("/"))
    return hit


def entry_point(path: Column) -> Column:
    """Whether a file's name up to its first dot is that of an entry point."""
    return F.substring_index(T.basename(path), ".", 1).isin(*ENTRY_NAMES)


def locale_key(path: Column) -> Column:
    """Sort key of paths in the root locale's order."""
    return F.collate(path, "UNICODE")


def duplicate_files(files: DataFrame, path: str = "path", content: str = "content", strategy: str = "shortest", preserve_entries: bool = True) -> DataFrame:
    """(path, hash, copies, kept, canonical) of every file whose content occurs several times.

    All copies stay if a file name occurs in several folders of the group, or if fewer than two copies are no
    entry points; else the canonical copy and the entry points stay: the shortest path (strategy ``shortest``),
    then the first in locale order. Null paths and contents are left out; empty files are equal to each other; of
    several contents of one path the one with the smallest hash counts.
    """
    rows = files.where(F.col(path).isNotNull() & F.col(content).isNotNull()).select(F.col(path).alias("path"), content_hash(F.col(content)).alias("hash"))
    rows = rows.groupBy("path").agg(F.min("hash").alias("hash")).withColumn("entry", entry_point(F.col("path")) if preserve_entries else F.lit(False))
    groups = rows.groupBy("hash").agg(F.count("*").alias("copies"), F.sum(F.when(~F.col("entry"), 1).otherwise(0)).alias("eligible")).where("copies > 1")
    rank = (F.length("path"), locale_key(F.col("path"))) if strategy == "shortest" else (locale_key(F.col("path")),)
    first = rows.where("not entry").groupBy("hash").agg(F.min_by("path", F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)), F.col("path"))).alias("canonical"))
    inside = rows.join(groups, "hash")
    spread = inside.groupBy("hash", T.basename(F.col("path")).alias("base")).agg(F.count_distinct(T.parent(F.col("path"))).alias("folders")).groupBy("hash").agg(F.max("folders").alias("folders"))
    full = inside.join(first, "hash", "left").join(spread, "hash")
    keep_all = (F.col("folders") > 1) | (F.col("eligible") < 2)
    return full.select("path", "hash", "copies", (keep_all | F.col("entry") | (F.col("path") == F.col("canonical"))).alias("kept"), F.when(~keep_all, F.col("canonical")).alias("canonical"))


def cross_file_lines(files: DataFrame, path: str = "path", content: str = "content", ignore_case: bool = False) -> DataFrame:
    """P7, exact: (path, line_no, line, kept) of all lines, where the first file in locale order keeps a line.

    Blank lines are kept and not compared. Repeats within a file go too.
    """
    lines = T.lines_of(files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("content")), "content", "path")
    keyed = lines.withColumn("key", T.comparison_key(F.col("line"), ignore_case=ignore_case))
    first = keyed.where("key <> ''").groupBy("key").agg(F.min(F.struct(locale_key(F.col("path")).alias("p"), F.col("line_no").alias("n"), F.col("path").alias("path"))).alias("f"))
    joined = keyed.join(first.select("key", F.col("f.path").alias("fp"), F.col("f.n").alias("fn")), "key", "left")
    return joined.select("path", "line_no", "line", (F.col("fp").isNull() | ((F.col("fp") == F.col("path")) & (F.col("fn") == F.col("line_no")))).alias("kept"))


_PY = re.compile(r"^(\s*)(?:async\s+def|def|class)\s+(\w+)")
_BRACE = re.compile(r"\b(?:function|class)\s+(\w+)")


def blocks_of(path: str, content: str) -> list[tuple[str, int, int, str]]:
    """(name, first line, last line, norm) of the functions and classes of a program.

    Python blocks end where the indentation returns, others where the braces are balanced. Blocks of fewer than
    16 characters on one line are ignored.
    """
    lines, out = content.split("\n"), []
    python = path.lower().endswith((".py", ".pyw", ".pyi"))
    for i, line in enumerate(lines):
        if python:
            m = _PY.match(line)
            if not m:
                continue
            depth, end = len(m.group(1)), i + 1
            while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > depth):
                end += 1
            name = m.group(2)
        else:
            m = _BRACE.search(line)
            if not m:
                continue
            open_, seen, end = 0, False, i
            while end < len(lines):
                open_ += lines[end].count("{") - lines[end].count("}")
                seen = seen or "{" in lines[end]
                end += 1
                if seen and open_ <= 0:
                    break
            if not seen:
                continue
            name = m.group(1)
        norm = " ".join("\n".join(lines[i:end]).split())
        if len(norm) >= 16:
            out.append((name, i, end - 1, norm))
    return out


def code_blocks(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, name, first, last, norm) of all blocks; null paths and contents have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *b) for p, c in zip(pdf["path"], pdf["content"], strict=True) for b in blocks_of(p, c)]
            yield pd.DataFrame(rows, columns=["path", "name", "first", "last", "norm"])

    narrow = files.where(F.col(path).isNotNull() & F.col(content).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("content"))
    return narrow.mapInPandas(run, "path string, name string, first int, last int, norm string")


def duplicate_blocks(blocks: DataFrame, preserve_entries: bool = True) -> DataFrame:
    """(hash, copies, intentional, keeper) of blocks that occur several times.

    A group is intentional, and stays, if its blocks differ in name or folder or if one is in a test or entry file.
    """
    b = blocks.withColumn("hash", F.sha2("norm", 256)).withColumn("test", F.col("path").rlike(TEST) | T.basename(F.col("path")).rlike(TEST)).withColumn("entry", entry_point(F.col("path")) if preserve_entries else F.lit(False))
    g = b.groupBy("hash").agg(
        F.count("*").alias("copies"), ((F.count_distinct("name") > 1) | F.bool_or("test") | F.bool_or("entry") | (F.count_distinct(T.parent(F.col("path"))) > 1)).alias("intentional"),
        F.min(F.struct("path", "first")).alias("k"),
    )
    return g.where("copies > 1").select("hash", "copies", "intentional", F.col("k.path").alias("keeper"))


def remove_blocks(files: DataFrame, blocks: DataFrame, path: str = "path", content: str = "content", preserve_entries: bool = True) -> DataFrame:
    """P10: (path, content) without the repeated blocks of groups that are not intentional; the first block stays.

    Works on sets of lines, so several blocks may leave one file. Files without such blocks stay as they are; null
    paths and contents are left out.
    """
    groups = duplicate_blocks(blocks, preserve_entries).where("not intentional").select("hash")
    b = blocks.withColumn("hash", F.sha2("norm", 256)).join(groups, "hash")
    keeper = b.groupBy("hash").agg(F.min(F.struct("path", "first")).alias("k"))
    gone = b.join(keeper, "hash").where((F.col("path") != F.col("k.path")) | (F.col("first") != F.col("k.first")))
    cut = gone.select("path", F.explode(F.sequence("first", "last")).alias("line_no")).groupBy("path").agg(F.collect_set("line_no").alias("cut"))
    narrow = files.where(F.col(path).isNotNull() & F.col(content).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("content"))
    left = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains("cut", i))
    return narrow.join(cut, "path", "left").select("path", F.when(F.col("cut").isNull(), F.col("content")).otherwise(F.array_join(left, "\n")).alias("content"))


def within_file_lines(files: DataFrame, path: str = "path", content: str = "content", marker: str | None = None, ignore_case: bool = False) -> DataFrame:
    """(path, content, removed): every file without the repeats of its own lines, which keep their order.

    A file that contains ``marker`` (a regular expression) stays as it is, as does a file without repeats. Blank lines
    of a rewritten file go. The work is within a row, so nothing is shuffled.
    """
    narrow = files.where(F.col(path).isNotNull() & F.col(content).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("content"))
    lines = F.filter(F.transform(F.split(T.eol(F.col("content")), "\n"), lambda x: T.raw_line(x)), lambda x: x != "")
    rows = narrow.withColumn("lines", lines).withColumn("keys", F.transform("lines", lambda x: T.comparison_key(x, ignore_case=ignore_case)))
    kept = rows.withColumn("kept", F.filter("lines", lambda x, i: F.array_position("keys", F.get("keys", i)) == i + 1)).withColumn("removed", F.size("lines") - F.size("kept"))
    stays = (F.col("removed") == 0) if marker is None else (F.col("removed") == 0) | F.col("content").rlike(marker)
    return kept.select("path", F.when(stays, F.col("content")).otherwise(F.array_join("kept", "\n")).alias("content"), F.when(stays, 0).otherwise(F.col("removed")).alias("removed"))


def folder_stats(files: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row (files, groups, removed, kept)."""
    total = files.where("path is not null").agg(F.count_distinct("path").alias("files"))
    gone = duplicates.agg(F.count_distinct("hash").alias("groups"), F.sum(F.when(~F.col("kept"), 1).otherwise(0)).alias("removed"))
    zero = F.lit(0).cast("long")
    both = total.select("files", zero.alias("groups"), zero.alias("removed")).unionByName(gone.select(zero.alias("files"), "groups", F.coalesce("removed", zero).alias("removed")))
    return both.agg(*(F.sum(c).alias(c) for c in ("files", "groups", "removed"))).withColumn("kept", F.col("files") - F.col("removed"))
