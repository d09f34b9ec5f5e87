"""Readers and writers (S1-S7, K1-K5): files as (path, content) rows, archives, lines, and their sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below ``path``, as text."""
    return binary_files(spark, path).select("path", F.decode("content", "UTF-8").alias("content"))


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content) of all files below ``path``, as bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def csv_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Rows of strings, without header and type inference."""
    return spark.read.csv(path, sep=delimiter, header=False, inferSchema=False, multiLine=True)


def zip_entries(files: DataFrame) -> DataFrame:
    """(archive, path, content) of the files in ZIP archives given as (path, content) rows.

    Folders are left out; an archive that can't be read is one row with a null path.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(archive, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    rows = [(archive, None, None)]
                yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return files.select("path", "content").mapInPandas(run, "archive string, path string, content binary")


def excel_rows(files: DataFrame) -> DataFrame:
    """S3: (path, row_no, cells) of the first sheet of workbooks given as (path, content) rows. Needs openpyxl."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import openpyxl

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                sheet = openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True).worksheets[0]
                rows = [(path, i, ["" if v is None else str(v) for v in r]) for i, r in enumerate(sheet.iter_rows(values_only=True))]
                yield pd.DataFrame(rows, columns=["path", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, row_no int, cells array<string>")


def write_lines(lines: DataFrame, path: str) -> None:
    """K1: a text sink of one column ``line``."""
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def zip_parts(files: DataFrame, parts: int = 1) -> DataFrame:
    """K3: (part, content): the kept files (path, content) packed into ZIP archives, one a part, by path hash."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in sorted(zip(pdf["path"], pdf["content"], strict=True)):
                z.writestr(path, content or "")
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "content": [out.getvalue()]})

    return files.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts))).groupBy("part").applyInPandas(run, "part long, content binary")


def report(duplicates: DataFrame, most_groups: int = 40, most_files: int = 8) -> DataFrame:
    """K4: (line) of a report on duplicate files: the largest groups with their first removed files."""
    gone = duplicates.where("not kept").groupBy("hash").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("paths"))
    return gone.orderBy(F.col("n").desc(), "hash").limit(most_groups).select(F.concat(F.substring("hash", 1, 12), F.lit(": "), F.col("n"), F.lit(" removed: "), F.array_join(F.slice("paths", 1, most_files), ", ")).alias("line"))


def manifest(files: DataFrame) -> DataFrame:
    """K5: one row (files, megabytes)."""
    return files.agg(F.count("*").alias("files"), F.round(F.sum(F.octet_length("content")) / 1e6, 1).alias("megabytes"))
