"""Methylation tables: BED intervals, CGmap, bedMethyl, and the choice between the last two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from .text import data_lines, lines, whole_number


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end) of BED3+; blank, comment, track and browser lines are skipped."""
    return bed_rows(lines(spark, path))


def bed_rows(rows: DataFrame) -> DataFrame:
    rows = rows.where(~F.trim("text").rlike("^(|#.*|track([ \t].*)?|browser([ \t].*)?)$"))
    f = F.split("text", "\t", -1)
    number = lambda k: whole_number(F.try_element_at(f, F.lit(k)))
    out = rows.select(f[0].alias("contig"), number(2).alias("start"), number(3).alias("end"), "text")
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end")) | (F.col("contig") == "")
    return out.where(F.when(bad, F.raise_error(F.concat(F.lit("not a BED interval: "), F.col("text"))).cast("boolean")).otherwise(True)).select("contig", "start", "end")


def cgmap_problem(f: Column) -> Column:
    """What is wrong with the eight fields of a CGmap row, or null."""
    at = lambda k: F.try_element_at(f, F.lit(k))
    meth, total, level = whole_number(at(7)), whole_number(at(8)), at(6)
    cg = at(4) == "CG"
    fits = F.when(cg, at(5) == "CG").when(at(4) == "CHG", at(5).isin("CA", "CC", "CT")).when(at(4) == "CHH", at(5).isin("CA", "CC", "CT")).otherwise(False)
    return (
        F.when(F.size(f) != 8, "not eight fields")
        .when(~at(2).isin("C", "G"), "the nucleotide is neither C nor G")
        .when(whole_number(at(3)).isNull() | (whole_number(at(3)) < 1), "the position is not 1 or more")
        .when(~fits, "context and dinucleotide disagree")
        .when(meth.isNull() | total.isNull() | (meth > total), "more methylated than total")
        .when((level == "na") != (total == 0), "the level is na exactly without coverage")
        .when((level != "na") & ~level.rlike(r"^(0(\.[0-9]+)?|1(\.0+)?)$"), "the level is outside 0 to 1")
    )


def bedmethyl_problem(f: Column) -> Column:
    at = lambda k: F.try_element_at(f, F.lit(k))
    n = lambda k: whole_number(at(k))
    counts = [n(k) for k in (2, 3, 5, 7, 8, 10, 12, 13, 14, 15, 16, 17, 18)]
    missing = counts[0].isNull()
    for c in counts[1:]:
        missing = missing | c.isNull()
    return (
        F.when(F.size(f) != 18, "not eighteen fields")
        .when(missing, "a count is not a number")
        .when((n(3) != n(2) + 1) | (n(7) != n(2)) | (n(8) != n(3)), "the site is not one base")
        .when(~at(6).isin("+", "-"), "no strand")
        .when((n(5) != n(10)) | (n(10) != n(12) + n(13)), "coverage is not methylated plus unmethylated")
        .when(~at(11).rlike(r"^[0-9]+(\.[0-9]+)?$"), "the percentage is not a number")
    )


def sites(rows: DataFrame) -> DataFrame:
    """(line, contig, start, end, modification, strand, meth, total) from ``fields`` of either format."""
    f = F.col("fields")
    at = lambda k: F.try_element_at(f, F.lit(k))
    eight = F.size(f) == 8
    problem = F.when(eight, cgmap_problem(f)).when(F.size(f) == 18, bedmethyl_problem(f)).otherwise("neither eight nor eighteen fields")
    rows = rows.where(F.when(problem.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("line"), (F.col("line") + 1).cast("string"), problem)).cast("boolean")).otherwise(True))
    start = F.when(eight, whole_number(at(3)) - 1).otherwise(whole_number(at(2)))
    return rows.select(
        "line",
        f[0].alias("contig"),
        start.alias("start"),
        (start + 1).alias("end"),
        F.when(eight, F.concat(F.lit("m,"), at(4), F.lit(",0"))).otherwise(at(4)).alias("modification"),
        F.when(eight, F.when(at(2) == "C", "+").otherwise("-")).otherwise(at(6)).alias("strand"),
        F.when(eight, whole_number(at(7))).otherwise(whole_number(at(12))).alias("meth"),
        F.when(eight, whole_number(at(8))).otherwise(whole_number(at(10))).alias("total"),
    )


def read_samples(spark: SparkSession, inputs: list[tuple[str, str]]) -> DataFrame:
    """Sites of several (sample, path) inputs; the format of each row follows from its fields."""
    if not inputs:
        raise InputError("no sample is given")
    out = None
    for sample, path in inputs:
        one = sites(data_lines(spark, path)).withColumn("sample", F.lit(sample))
        out = one if out is None else out.unionByName(one)
    return out
