"""Reports: CSV that spreadsheets cannot run, JSON lines, a small HTML page, and a manifest of inputs with their hashes."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.text import csv_safe


def safe(df: DataFrame) -> DataFrame:
    return df.select(*[csv_safe(F.array_join(c, ",") if k.startswith("array") else F.col(c)).alias(c) for c, k in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    safe(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def html_table(df: DataFrame, most: int = 400) -> str:
    """The first rows as an escaped HTML table: a report's excerpt, not an export."""
    rows = df.limit(most).collect()
    cell = lambda v: html.escape("" if v is None else str(v))
    head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


def write_html(spark: SparkSession, title: str, sections: dict[str, DataFrame], path: str) -> None:
    page = f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "".join(f"<h2>{html.escape(k)}</h2>{html_table(v)}" for k, v in sections.items())
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: Bytes of a file that is read into one cell for its hash, at most.
WHOLE = 512 << 20


def input_hashes(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(file, size, sha256) of each file below a path, by its place below it.

    A file is hashed in the task that reads it.  Files over ``whole`` bytes do not
    fit a cell: their hash is that of name, size and time of change.
    """
    base = path.rstrip("/").rpartition("/")[2]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.when(F.contains("path", F.lit(f"/{base}/")), F.element_at(F.split("path", f"/{re.escape(base)}/"), -1)).otherwise(F.element_at(F.split("path", "/"), -1))
    small = files.where(F.col("length") <= whole).select(name.alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select(name.alias("file"), F.col("length").alias("size"), F.sha2(F.concat_ws(" ", name, F.col("length").cast("string"), F.col("modificationTime").cast("string")), 256).alias("sha256"))
    return small.unionByName(large)


def input_hash(files: DataFrame) -> DataFrame:
    """(files, bytes, sha256): one hash over all files in name order; of each folder first, so that no cell holds more than a folder's lines."""
    line = F.concat_ws(" ", "file", F.col("size").cast("string"), "sha256")
    over = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    folders = files.groupBy(F.regexp_extract("file", "^(.*/)?", 1).alias("folder")).agg(F.count("*").alias("n"), F.sum("size").alias("b"), over(line).alias("h"))
    return folders.agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), over(F.concat_ws(" ", "folder", "h")).alias("sha256"))
