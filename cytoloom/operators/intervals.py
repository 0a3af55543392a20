"""Interval set algebra on (contig, start, end)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bases a bin when intervals are met with positions.
BIN = 16_384


def invalid(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """Intervals that are empty, off their contig, or on none; ``contigs`` has contig and length."""
    known = contigs.select("contig", F.col("length").alias("_length"))
    bad = F.col("_length").isNull() | (F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.col("_length"))
    return intervals.join(known, "contig", "left").where(bad).drop("_length")


def merged(intervals: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Overlapping or touching intervals (or those at most ``gap`` apart) as one.

    Exact duplicates meet before the window, so a hot interval costs one row a task.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.select(*keys, "start", "end").distinct()
    rows = rows.withColumn("_reach", F.max("end").over(before))
    rows = rows.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def chunked(intervals: DataFrame, size: int) -> DataFrame:
    """Pieces of at most ``size`` bases."""
    pieces = intervals.withColumn("start", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(size).cast("bigint")))).withColumn("_end", F.col("end"))
    return pieces.withColumn("end", F.least(F.col("start") + size, F.col("_end"))).drop("_end")


def clip(rows: DataFrame, islands: DataFrame, position: str = "position", bin_size: int = BIN) -> DataFrame:
    """Rows whose position lies in one of the disjoint ``islands``: an equi-join on contig and bin with
    the range as residual, never a nested loop."""
    first, last = (F.floor(x / bin_size) for x in (F.col("start"), F.col("end") - 1))
    binned = islands.select("contig", "start", "end", F.explode(F.sequence(first, last)).alias("_bin"))
    out = rows.withColumn("_bin", F.floor(F.col(position) / bin_size)).join(binned, ["contig", "_bin"])
    return out.where((F.col("start") <= F.col(position)) & (F.col(position) < F.col("end"))).drop("_bin", "start", "end")


def anchored_clusters(rows: DataFrame, keys: list[str], value: str, radius: int) -> DataFrame:
    """Greedy clusters: a value more than ``radius`` past its cluster's first value opens the next.

    Depends on the cluster's anchor, not the previous row, so it is a fold over each group's distinct
    sorted values (a read's few origins).
    """
    start = F.struct(F.array().cast("array<struct<v:bigint,cluster:int>>").alias("out"), F.lit(None).cast("bigint").alias("anchor"), F.lit(-1).alias("cluster"))

    def step(acc, v):
        fresh = acc["anchor"].isNull() | (v - acc["anchor"] > radius)
        cluster = F.when(fresh, acc["cluster"] + 1).otherwise(acc["cluster"])
        return F.struct(F.concat(acc["out"], F.array(F.struct(v.alias("v"), cluster.alias("cluster")))).alias("out"), F.when(fresh, v).otherwise(acc["anchor"]).alias("anchor"), cluster.alias("cluster"))

    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(value).cast("bigint"))).alias("_v"))
    folded = grouped.select(*keys, F.explode(F.aggregate("_v", start, step)["out"]).alias("_o"))
    return folded.select(*keys, F.col("_o.v").alias(value), F.col("_o.cluster").alias("cluster"))
