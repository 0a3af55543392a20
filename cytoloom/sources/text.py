"""Line scans shared by the tabular formats, and checks that turn bad rows into errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InputError


def placed(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, block, id, text): records with the file block they were read from and ids that rise within
    it, so (block, id) is the file's order however its blocks were dealt to tasks."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of plain or gzip text; ``line`` counts from 0 within a file.

    Files are read in parallel blocks. A first pass counts each block's lines; their running sums, one
    row a block, then place every line.
    """
    raw = placed(spark, path)
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("id").alias("_first"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return raw.join(F.broadcast(blocks), ["file", "block"]).select("file", (F.col("_before") + F.col("id") - F.col("_first")).alias("line"), "text")


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, fields) of lines that are neither empty nor comments, split at tabs."""
    rows = lines(spark, path).where((F.col("text") != "") & ~F.col("text").startswith("#"))
    return rows.select("file", F.col("line").cast("bigint").alias("line"), F.split("text", "\t", -1).alias("fields"))


def whole_number(text: Column) -> Column:
    """A decimal natural number, else null."""
    return F.when(text.rlike("^[0-9]{1,18}$"), text.cast("bigint"))


def reject(rows: DataFrame, bad: Column, what: str) -> DataFrame:
    """``rows`` where a row that is bad raises when it is read."""
    text = F.concat_ws(" ", F.lit(what), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("line",) if c in rows.columns])
    return rows.where(F.when(F.coalesce(bad, F.lit(True)), F.raise_error(text).cast("boolean")).otherwise(True))


def first_bad(rows: DataFrame, bad: Column, what: str) -> None:
    row = rows.where(F.coalesce(bad, F.lit(True))).head(1)
    if row:
        raise InputError(f"{what}: {row[0].asDict()}")
