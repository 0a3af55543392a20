"""Truth-based evaluation: precision-recall over mapping quality, operating points, tolerances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def curve(ledger: DataFrame, correct: str = "correct", selected: str = "mapq", total: int | None = None) -> DataFrame:
    """Points of the precision-recall curve, one a distinct quality, best first.

    Recall counts all rows of the ledger, also those without a quality (null). The running sums go over
    the few distinct qualities, after aggregation.
    """
    n = total if total is not None else ledger.count()
    per = ledger.where(F.col(selected).isNotNull()).groupBy(F.col(selected).alias("mapq")).agg(F.count("*").alias("chosen"), F.sum(F.col(correct).cast("bigint")).alias("right"))
    w = Window.orderBy(F.desc("mapq")).rowsBetween(Window.unboundedPreceding, 0)
    out = per.withColumn("chosen", F.sum("chosen").over(w)).withColumn("right", F.sum("right").over(w))
    return out.withColumn("precision", F.col("right") / F.col("chosen")).withColumn("recall", F.col("right") / F.lit(n)).withColumn("f1", 2 * F.col("right") / (F.lit(n) + F.col("chosen")))


def average_precision(points: DataFrame) -> DataFrame:
    w = Window.orderBy(F.desc("mapq"))
    gain = F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0))
    return points.withColumn("_g", gain).agg(F.sum(F.col("_g") * F.col("precision")).alias("average_precision"))


def operating_points(ledger: DataFrame, cuts: tuple[int, ...] = (10, 20, 30, 40), correct: str = "correct") -> DataFrame:
    """Precision, recall and F1 of rows at or over each cut; one pass."""
    n = F.count("*").alias("truth")
    per = [x for q in cuts for x in (F.sum((F.col("mapq") >= q).cast("bigint")).alias(f"s{q}"), F.sum(((F.col("mapq") >= q) & F.col(correct)).cast("bigint")).alias(f"c{q}"))]
    row = ledger.agg(n, *per)
    points = F.array(*[F.struct(F.lit(q).alias("q"), F.coalesce(f"s{q}", F.lit(0)).alias("chosen"), F.coalesce(f"c{q}", F.lit(0)).alias("right")) for q in cuts])
    out = row.select("truth", F.explode(points).alias("p")).select("truth", "p.*")
    return out.select("q", "chosen", "right", F.when(F.col("chosen") > 0, F.col("right") / F.col("chosen")).alias("precision"), (F.col("right") / F.col("truth")).alias("recall"), (2 * F.col("right") / (F.col("truth") + F.col("chosen"))).alias("f1"))


def tolerance_counts(truth: DataFrame, candidates: DataFrame, tolerances: tuple[int, ...] = (0, 1, 5, 10)) -> DataFrame:
    """One row: reads, reads placed, on the right contig, in the right orientation, and within each
    tolerance. Reads without a candidate count as truth only."""
    rows = truth.alias("t").join(candidates.alias("c"), "name", "left")
    same = (F.col("t.contig") == F.col("c.contig")) & (F.col("t.reverse") == F.col("c.reverse"))
    off = F.abs(F.col("t.five_prime") - F.col("c.five_prime"))
    one = lambda cond, name: F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("bigint")), F.lit(0)).alias(name)
    return rows.agg(F.count("*").alias("truth"), one(F.col("c.contig").isNotNull(), "placed"), one(F.col("t.contig") == F.col("c.contig"), "contig"), one(same, "orientation"), *[one(same & (off <= k), f"within_{k}") for k in tolerances])
