"""FASTQ: strict four-line records, and pairs of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from .text import lines

#: Lengths of reads that can be aligned.
LEAST, MOST = 3, 192


def records(rows: DataFrame) -> DataFrame:
    """(file, ordinal, header, seq, plus, qual) from numbered lines; the end of the file may be empty."""
    last = rows.groupBy("file").agg(F.max(F.when(F.col("text") != "", F.col("line"))).alias("_last"))
    kept = rows.join(F.broadcast(last), "file").where("line <= _last")  # a row a file
    four = kept.groupBy("file", F.call_function("div", F.col("line").cast("bigint"), F.lit(4).cast("bigint")).alias("ordinal"))
    pick = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("text")))
    return four.agg(pick(0).alias("header"), pick(1).alias("seq"), pick(2).alias("plus"), pick(3).alias("qual"))


def problem(header: Column, seq: Column, plus: Column, qual: Column) -> Column:
    """What is wrong with a record, or null."""
    return (
        F.when(header.isNull() | seq.isNull() | plus.isNull() | qual.isNull(), "the record has fewer than four lines")
        .when(~header.rlike("^@[^ \t]"), "no name after @")
        .when(~plus.startswith("+"), "the third line does not begin with +")
        .when((plus != "+") & (F.substring(plus, 2, 1 << 20) != F.substring(header, 2, 1 << 20)), "the third line names another read")
        .when(F.length(seq) == 0, "the read is empty")
        .when(F.length(seq) != F.length(qual), "bases and qualities differ in number")
        .when(~F.upper(seq).rlike("^[ACGTN]+$"), "a base other than A, C, G, T, N")
        .when(~qual.rlike("^[!-~]+$"), "a quality outside the printable range")
    )


def parsed(rows: DataFrame) -> DataFrame:
    name = F.split(F.substring("header", 2, 1 << 20), "[ \t]", 2)
    return rows.select("ordinal", name[0].alias("name"), F.coalesce(F.try_element_at(name, F.lit(2)), F.lit("")).alias("description"), F.upper("seq").alias("seq"), "qual")


def read(spark: SparkSession, path: str, alignable: bool = False) -> DataFrame:
    """(ordinal, name, description, seq, qual) of one FASTQ file; any bad record is an error."""
    rows = records(lines(spark, path))
    bad = problem(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual"))
    if alignable:
        bad = F.coalesce(bad, F.when(~F.length("seq").between(LEAST, MOST), "the read's length can't be aligned"))
    rows = rows.withColumn("bad", bad)
    first = rows.where("bad is not null").orderBy("ordinal").head(1)
    if first:
        raise InputError(f"{path}, record {first[0].ordinal + 1}: {first[0].bad}")
    return parsed(rows)


def shared_name(first: Column, second: Column) -> Column:
    """The name two mates share: equal names, or one stem with /1 and /2; else null."""
    stem = lambda n, k: F.when(n.endswith(f"/{k}"), F.regexp_replace(n, "/[12]$", ""))
    return F.when(first == second, first).when(stem(first, 1) == stem(second, 2), stem(first, 1))


def pair(first: DataFrame, second: DataFrame) -> DataFrame:
    """(ordinal, shared_name, seq1, qual1, seq2, qual2); unequal numbers or names are errors."""
    a = first.select("ordinal", F.col("name").alias("n1"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    b = second.select("ordinal", F.col("name").alias("n2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    both = a.join(b, "ordinal", "full_outer").withColumn("shared_name", shared_name(F.col("n1"), F.col("n2")))
    bad = both.where("n1 is null or n2 is null or shared_name is null").orderBy("ordinal").head(1)
    if bad:
        raise InputError(f"pair {bad[0].ordinal + 1}: {bad[0].n1!r} and {bad[0].n2!r} are no mates")
    return both.select("ordinal", "shared_name", "seq1", "qual1", "seq2", "qual2")
