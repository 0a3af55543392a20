"""FASTA: contigs with digest, ranges, and the checks that bind them to alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InputError
from .text import placed


def read(spark: SparkSession, path: str) -> DataFrame:
    """(contig, ordinal, seq, length, md5). Names are the header's first word, unique and not empty;
    sequences are upper-cased A, C, G, T, N over any number of lines; a blank line is an error."""
    # a record is what stands between two line beginnings with >, so a genome is read record by record
    text = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "[\r\n]$", "")
    raw = placed(spark, path, "\n>").select("file", "block", "id", text.alias("record"))
    # only the keys are numbered in one place; sequences are not moved there
    order = Window.partitionBy("file").orderBy("block", "id")
    keys = raw.select("file", "block", "id", F.substring("record", 1, 1).alias("begins")).withColumn("ordinal", F.row_number().over(order) - 1).persist()
    if not keys.where("ordinal = 0 and begins != '>'").isEmpty():
        raise InputError("the file does not begin with a header")
    rows = raw.join(keys.drop("begins"), ["file", "block", "id"])
    rows = rows.withColumn("record", F.when(F.col("ordinal") == 0, F.substring("record", 2, 1 << 30)).otherwise(F.col("record")))
    rows = rows.select("file", "ordinal", F.split("record", "\n", 2).alias("p"))
    header = F.col("p")[0]
    text = F.coalesce(F.try_element_at("p", F.lit(2)), F.lit(""))
    out = rows.select("file", F.split(header, r"\s")[0].alias("contig"), "ordinal", text.alias("text"), F.upper(F.replace(text, F.lit("\n"), F.lit(""))).alias("seq"))
    blank = out.where((F.col("text") == "") | F.col("text").contains("\n\n") | F.col("text").startswith("\n")).head(1)
    if blank:
        raise InputError(f"a blank line or an empty sequence: {blank[0].contig}")
    bad = out.where((F.col("contig") == "") | ~F.col("seq").rlike("^[ACGTN]+$")).head(1)
    if bad:
        raise InputError(f"an unnamed contig or a letter other than A, C, G, T, N: {bad[0].contig}")
    twice = out.groupBy("contig").count().where("count > 1").head(1)
    if twice:
        raise InputError(f"a contig is named twice: {twice[0].contig}")
    return out.select("contig", "ordinal", "seq", F.length("seq").cast("bigint").alias("length"), F.md5(F.col("seq").cast("binary")).alias("md5"))


def bases(contigs: DataFrame) -> DataFrame:
    """(contig, position, base): one row a base."""
    return contigs.select("contig", F.posexplode(F.split("seq", "")).alias("position", "base")).where("base != ''").select("contig", F.col("position").cast("bigint").alias("position"), "base")


def digest(contigs: DataFrame) -> str:
    """Digest of the whole reference, of names, lengths and contig digests in order."""
    rows = contigs.select("ordinal", "contig", "length", "md5").orderBy("ordinal")
    text = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "contig", "length", "md5"))), lambda r: F.concat_ws("\t", r["contig"], r["length"].cast("string"), r["md5"])), "\n").alias("t")).select(F.sha2(F.col("t").cast("binary"), 256)).first()[0]
    return text


def check_identity(contigs: DataFrame, header: DataFrame) -> None:
    """Stop unless every contig of ``header`` (contig, length, m5) is in the FASTA with that digest."""
    named = header.select("contig", F.col("length").alias("hl"), F.col("m5").alias("hm"))
    bad = named.join(contigs.select("contig", "length", "md5"), "contig", "left").where("md5 is null or md5 != hm or length != hl").head(1)
    if bad:
        raise InputError(f"the reference differs from the alignments' for {bad[0].contig}")


def catalogue_errors(contigs: DataFrame, most: int = 1_000_000) -> None:
    """Names must be fit for SAM and the dictionary bounded."""
    bad = contigs.where(~F.col("contig").rlike(r"^[0-9A-Za-z!#$%&+./:;?@^_|~-][0-9A-Za-z!#$%&*+./:;=?@^_|~-]*$")).head(1)
    if bad:
        raise InputError(f"not a SAM contig name: {bad[0].contig}")
    if contigs.limit(most + 1).count() > most:
        raise InputError("too many contigs")
