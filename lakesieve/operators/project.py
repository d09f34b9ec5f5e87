"""A whole folder run (P12): excludes, duplicate files, repeated lines within and across files, code blocks, counts.

Every pass takes and returns a table of files (path, content, format, skip, deleted, modified, removed_lines); the
tables between passes are written, as later passes read them several times.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesieve.functions import detect as X
from lakesieve.functions import text as T
from lakesieve.functions.jsonx import parsed_items, render, strict_canonical
from lakesieve.operators import folder as P
from lakesieve.options import PRESETS, FolderScope
from lakesieve.session import materialize


def csv_lines(content: str) -> list[str]:
    """The rows of a text of comma-separated values: a line feed within quotes does not end one."""
    rows: list[str] = []
    open_ = False
    for line in content.split("\n"):
        if open_:
            rows[-1] += "\n" + line
        else:
            rows.append(line)
        open_ ^= line.count('"') % 2 == 1
    return rows


def kept_lines(fmt: str, content: str, lines: list[str], keys: list[str]) -> tuple[list[str], int]:
    """(lines that stay, number of lines removed) of one file. ``lines`` are its raw lines, ``keys`` their keys.

    Rows of a table keep their header; items of JSON are printed anew; of to-do lines the last done one stays.
    """
    if fmt == "json":
        items, _ = parsed_items(content)
        return (render(content), len(items) - len(render(content, True))) if items else ([], 0)
    if fmt == "csv":
        rows = csv_lines(content)
        head = next((i for i, r in enumerate(rows) if r.strip()), None)
        if head is None:
            return [], 0
        data = list(dict.fromkeys(r for r in rows[head + 1 :] if r.strip()))
        return [rows[head], *data], len(rows) - len(data) - 1
    first: dict[str, int] = {}
    for i, (line, key) in enumerate(zip(lines, keys, strict=True)):
        if line == "":
            continue
        done = fmt == "todo" and ("[x]" in line.lower() or "DONE:" in line.upper())
        if key not in first:
            first[key] = i
        elif done:
            lines = [*lines]
            lines[first[key]] = line
    total = sum(1 for x in lines if x != "") if fmt == "txt" else len(lines)
    return [lines[i] for i in first.values()], total - len(first)


def _line_key(line: Column, fmt: Column, language: Column, scope: FolderScope) -> Column:
    key = F.when(fmt == "log", T.strip_log(line)).when(fmt == "todo", T.strip_todo(line)).when(fmt == "code", T.code_edges(T.strip_line_comments(line, language))).otherwise(line)
    return T.case_key(T.compare_filter(key, scope.ignore_punct, scope.collapse_ws), scope.ignore_case)


def prepared(files: DataFrame, scope: FolderScope, path: str = "path", content: str = "content", fmt: str | None = None) -> DataFrame:
    """The files that take part, with their format: without excluded folders (P1) and binary extensions.

    Files that a manual rule matches (P3) pass through. Null paths and contents are left out; of several rows with
    one path the one with the smallest content counts.
    """
    narrow = files.where(F.col(path).isNotNull() & F.col(content).isNotNull()).select(T.path_normalize(F.col(path)).alias("path"), F.col(content).alias("content"), (F.col(fmt) if fmt else F.lit(None).cast("string")).alias("format"))
    one = narrow.groupBy("path").agg(F.min(F.struct("content", "format")).alias("f")).select("path", "f.content", "f.format")
    sniffed = X.sniff_format(F.col("path"), T.eol(F.col("content")))["mode"]
    taken = one.where(~P.ignored(F.col("path"), scope.ignore) & ~T.extension(F.col("path")).isin(*X.SKIP))
    known = taken.withColumn("format", F.coalesce("format", sniffed))
    return known.select("path", "content", "format", P.skipped(F.col("path"), P.skip_rules(scope.manual_skips)).alias("skip"), F.lit(False).alias("deleted"), F.lit(0).alias("modified"), F.lit(0).cast("long").alias("removed_lines"))


def within_files(files: DataFrame, scope: FolderScope) -> DataFrame:
    """P6 on the table of files: a file with the keep marker is skipped from now on, one without repeats stays as it is."""
    formats = [*P.DATA_FORMATS, *(["code"] if scope.within_code else [])]
    body, language = T.eol(F.col("content")), F.when(F.col("format") == "code", X.detect_language(F.col("path"), F.col("content")))
    active = ~F.col("skip") & ~F.col("deleted") & (F.col("content") != "")
    marked = files.withColumn("language", language).withColumn("skip", F.col("skip") | (active & F.col("content").rlike(scope.keep_file)))
    takes = ~F.col("skip") & ~F.col("deleted") & (F.col("content") != "") & F.col("format").isin(*formats)
    text = F.when(F.col("format") == "code", T.strip_blocks(body, F.col("language"))).otherwise(body)
    lines = marked.withColumn("lines", F.when(takes, F.transform(F.split(text, "\n"), lambda x: T.raw_line(x))))
    keyed = lines.withColumn("keys", F.transform("lines", lambda x: _line_key(x, F.col("format"), F.col("language"), scope)))

    def run(fmt: pd.Series, content: pd.Series, raw: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for f, c, r, k in zip(fmt, content, raw, keys, strict=True):
            kept, gone = kept_lines(f, c.replace("\r\n", "\n").replace("\r", "\n"), list(r), list(k)) if r is not None else ([], 0)
            out.append(("\n".join(kept), gone) if gone > 0 else (None, 0))
        return pd.DataFrame(out, columns=["content", "gone"])

    done = keyed.withColumn("r", F.pandas_udf(run, "content string, gone long")("format", "content", "lines", "keys"))
    return done.select("path", F.coalesce("r.content", "content").alias("content"), "format", "skip", "deleted", (F.col("modified") + (F.col("r.gone") > 0).cast("int")).alias("modified"), (F.col("removed_lines") + F.col("r.gone")).alias("removed_lines"))


def across_files(files: DataFrame, scope: FolderScope) -> DataFrame:
    """P7 on the table of files, exact: of equal keys in data files the first file in locale order keeps its line.

    Blank lines and lines with an empty key stay, as do lines with the keep marker on them or on the line before;
    these are not compared. Only the lines that are compared are shuffled by key.
    """
    takes = ~F.col("skip") & ~F.col("deleted") & (F.col("content") != "") & F.col("format").isin(*P.DATA_FORMATS)
    split = files.where(takes).select("path", "format", F.split("content", "\n").alias("lines"))
    marker = scope.keep_line
    flagged = F.transform("lines", lambda x, i: F.struct(i.alias("no"), x.alias("line"), (x.rlike(marker) | F.coalesce((i > 0) & F.get("lines", i - 1).rlike(marker), F.lit(False))).alias("stays")))
    lines = split.select("path", "format", F.explode(flagged).alias("l")).select("path", "format", "l.*")
    raw = T.raw_line(F.col("line"))
    key = F.when((F.col("format") == "json") & (raw.startswith("{") | raw.startswith("[")), strict_canonical(raw)).otherwise(_line_key(raw, F.col("format"), F.lit("generic"), scope))
    keyed = lines.withColumn("key", key)
    compared = keyed.where("not stays and key <> ''")
    first = compared.groupBy("key").agg(F.min(F.struct(P.locale_key(F.col("path")).alias("p"), F.col("no"), F.col("path").alias("path"))).alias("f"))
    gone = compared.select("path", "no", "key").join(first.select("key", F.col("f.path").alias("fp"), F.col("f.no").alias("fn")), "key").where("path <> fp or no <> fn")
    cut = gone.groupBy("path").agg(F.collect_set("no").alias("cut"))  # of one file
    joined = files.join(cut, "path", "left")

    def run(content: pd.Series, cut_: pd.Series) -> pd.Series:
        out = []
        for c, k in zip(content, cut_, strict=True):
            drop = set() if k is None else set(k)
            out.append("\n".join(x for i, x in enumerate(c.split("\n")) if i not in drop) if drop else c)
        return pd.Series(out)

    n = F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut"))
    return joined.select("path", F.pandas_udf(run, "string")("content", "cut").alias("content"), "format", "skip", "deleted", (F.col("modified") + (n > 0).cast("int")).alias("modified"), (F.col("removed_lines") + n).alias("removed_lines"))


def process_project(files: DataFrame, preset: str | FolderScope = "safe", path: str = "path", content: str = "content", fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, stats) of a folder run.

    files: (path, content, format, skip, deleted, modified, removed_lines) of every file that took part; deleted ones
    are duplicates of another, ``modified`` counts the passes that changed one. stats: one row of counts. An empty
    folder has no files and zero counts.
    """
    scope = PRESETS[preset] if isinstance(preset, str) else preset
    now = materialize(prepared(files, scope, path, content, fmt), "files")
    groups = None
    if scope.remove_files:
        dup = materialize(P.duplicate_files(now.where("not skip"), strategy=scope.strategy, preserve_entries=scope.preserve_entries).select("path", "hash", "kept"), "duplicates")
        groups = dup
        now = now.join(dup.where("not kept").select("path", F.lit(True).alias("gone")), "path", "left").withColumn("deleted", F.coalesce("gone", F.lit(False))).drop("gone")
    if scope.within_lines:
        now = materialize(within_files(now, scope), "files")
    if scope.across_lines:
        now = materialize(across_files(now, scope), "files")
    blocks = None
    if scope.code_blocks:
        active = now.where("not skip and not deleted and format = 'code'")
        found = materialize(P.code_blocks(active), "blocks")
        blocks = P.duplicate_blocks(found, scope.preserve_entries)
        if scope.remove_blocks:
            left = P.remove_blocks(active, found, preserve_entries=scope.preserve_entries).select("path", F.col("content").alias("left"))
            now = materialize(now.join(left, "path", "left").withColumn("content", F.coalesce("left", "content")).drop("left"), "files")
    zero = F.lit(0).cast("long")
    names = ("files", "files_removed", "files_modified", "lines_removed", "passed_through", "duplicate_groups", "block_groups", "intentional_blocks")
    own = now.agg(F.count("*").alias("files"), F.count_if("deleted").alias("files_removed"), F.sum("modified").cast("long").alias("files_modified"), F.sum("removed_lines").alias("lines_removed"), F.count_if("skip").alias("passed_through"))
    parts = [own]
    if groups is not None:
        parts.append(groups.agg(F.count_distinct("hash").alias("duplicate_groups")))
    if blocks is not None:
        parts.append(blocks.agg(F.count("*").alias("block_groups"), F.count_if("intentional").alias("intentional_blocks")))
    rows = [p.select(*(F.coalesce(F.col(n), zero).alias(n) if n in p.columns else zero.alias(n) for n in names)) for p in parts]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    stats = whole.agg(*(F.sum(n).alias(n) for n in names)).withColumn("files_kept", F.col("files") - F.col("files_removed"))
    return now, stats
