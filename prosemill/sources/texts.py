"""Texts in and out: files of a folder, tables, and the sinks of rewritten texts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A row for each file: name (its path) and text. strict: a file that is not UTF-8 fails the read; else its text is null."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.decode("content", "UTF-8")
    if strict:
        return files.select("name", F.when(good, text).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "name")).cast("string")).alias("text"))
    return files.select("name", F.when(good, text).alias("text"))


def read_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text_col of a Parquet table; no other column is read."""
    return spark.read.parquet(path).select(id_col, text_col)


def write_texts(rewritten: DataFrame, path: str, mode: str = "error") -> None:
    rewritten.write.mode(mode).option("compression", "zstd").parquet(path)


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line, nulls left out."""
    rows.write.mode(mode).json(path)
