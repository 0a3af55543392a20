"""SAM text: header dictionary, records, region scans."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from ..operators.evidence import cigar_runs, reference_span


def header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, tags) of header lines."""
    return header_of(spark.read.text(path))


def header_of(lines: DataFrame) -> DataFrame:
    """(kind, tags) of those of ``lines`` (value) that are a header's.

    Tags are guarded row by row, as the optimiser may judge them before the filter on the line's kind.
    """
    rows = lines.where(F.col("value").startswith("@"))
    fields = F.split("value", "\t")
    tags = F.map_from_entries(F.transform(F.slice(fields, 2, F.size(fields)), lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, 4, 1 << 20))))
    return rows.where(~F.col("value").startswith("@CO")).select(F.substring("value", 2, 2).alias("kind"), F.when(F.col("value").startswith("@"), tags).alias("tags"))


def dictionary(head: DataFrame) -> DataFrame:
    """(contig, length, m5)."""
    return head.where("kind = 'SQ'").select(F.col("tags")["SN"].alias("contig"), F.col("tags")["LN"].cast("bigint").alias("length"), F.try_element_at("tags", F.lit("M5")).alias("m5"))


def check_header(head: DataFrame) -> None:
    order = head.where("kind = 'HD'").select(F.try_element_at("tags", F.lit("SO"))).head(1)
    if not order or order[0][0] != "coordinate":
        raise InputError("the alignments are not sorted by coordinate")
    bad = dictionary(head).where("m5 is null or length is null or length >= 4294967296").head(1)
    if bad:
        raise InputError(f"contig {bad[0].contig} has no digest or no usable length")


def sample_name(head: DataFrame, path: str, explicit: str | None = None) -> str:
    """As given, else the one name of the read groups, else the file's stem."""
    if explicit:
        return explicit
    names = [r[0] for r in head.where("kind = 'RG'").select(F.try_element_at("tags", F.lit("SM")).alias("s")).where("s is not null").distinct().limit(2).collect()]
    if len(names) > 1:
        raise InputError("the read groups name several samples")
    return names[0] if names else PurePosixPath(path).stem


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records with 0-based positions, ``tags`` as a map, ``rg`` and ``xg``; splits read in parallel."""
    # Spark may judge conditions on fields before the one on the line's kind, so fields are read leniently
    # and a bad record raises by itself
    is_record = ~F.col("value").startswith("@") & (F.col("value") != "")
    f = F.split("value", "\t", -1)
    whole = lambda k: F.get(f, F.lit(k)).try_cast("bigint")
    numbers = whole(1)
    for k in (3, 4, 7, 8):
        numbers = numbers + whole(k)
    bad = is_record & ((F.size(f) < 11) | numbers.isNull())
    rows = spark.read.text(path).where(is_record)
    rows = rows.where(F.when(bad, F.raise_error(F.concat(F.lit("not a SAM record: "), F.substring("value", 1, 80))).cast("boolean")).otherwise(True))
    tags = F.map_from_entries(F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, 6, 1 << 20))))
    text = lambda k, name: F.get(f, F.lit(k)).alias(name)
    out = rows.select(
        text(0, "qname"), whole(1).cast("int").alias("flag"), text(2, "rname"), (whole(3) - 1).alias("pos"), whole(4).cast("int").alias("mapq"), text(5, "cigar"), text(6, "rnext"), (whole(7) - 1).alias("pnext"), whole(8).alias("tlen"), text(9, "seq"), text(10, "qual"), F.when(is_record, tags).alias("tags")
    )
    return out.withColumn("rg", F.try_element_at("tags", F.lit("RG"))).withColumn("xg", F.try_element_at("tags", F.lit("XG")))


def overlapping(rows: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Records that reach into a region; contig and position are plain predicates for pruning."""
    near = rows.where((F.col("rname") == contig) & (F.col("pos") < end))
    return near.where(F.col("pos") + reference_span(cigar_runs(F.col("cigar"))) > start)


def write_parquet(rows: DataFrame, path: str, bin_size: int = 1 << 20) -> None:
    """Partitioned by contig and position bin, sorted within files, so that region scans prune."""
    binned = rows.withColumn("pos_bin", F.floor(F.col("pos") / bin_size))
    binned.repartition("rname", "pos_bin").sortWithinPartitions("rname", "pos").write.partitionBy("rname", "pos_bin").parquet(path)
