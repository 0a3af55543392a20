"""Methylation calling: conditional counts a site, context, and the two text renderings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.chem import complement, context_class, methylation_class
from ..functions.numeric import fixed_point, scaled_ratio
from .evidence import passes


@dataclass(frozen=True)
class MethylationOptions:
    min_base_quality: int = 20
    min_mapping_quality: int = 20
    min_depth: int = 10
    cg_only: bool = False
    ignore_orphans: bool = False

    def __post_init__(self):
        if not 0 <= self.min_base_quality <= 93:
            raise ConfigurationError("the least base quality is 0 to 93")
        if not 0 <= self.min_mapping_quality <= 254:
            raise ConfigurationError("the least mapping quality is 0 to 254")
        if self.min_depth < 1:
            raise ConfigurationError("the least depth is at least 1")


#: Bases a window partition of the reference, so that no task has to hold a chromosome.
SPAN = 1 << 16


def with_context(ref: DataFrame, contig: str = "contig", position: str = "position", base: str = "base", span: int = SPAN) -> DataFrame:
    """Reference bases with ``context`` (class) and ``second`` (next base on the cytosine's strand) for
    both strands' cytosines; others have none. Positions of a contig must be without gaps.

    Windows run over spans of the contig; the two bases beside a border are lent to the next span.
    """
    at = lambda k: F.floor((F.col(position) + k) / span)
    lent = ref.withColumn("_span", F.explode(F.array_distinct(F.array(at(-2), at(0), at(2)))))
    w = Window.partitionBy(contig, "_span").orderBy(position)
    left = [F.lag(base, k).over(w) for k in (1, 2)]
    right = [F.lead(base, k).over(w) for k in (1, 2)]
    out = lent.withColumns({"_l1": left[0], "_l2": left[1], "_r1": right[0], "_r2": right[1]}).where(F.col("_span") == at(0))
    top = context_class(F.col("_r1"), F.col("_r2"))
    bottom = context_class(complement(F.col("_l1")), complement(F.col("_l2")))
    is_c, is_g = F.col(base) == "C", F.col(base) == "G"
    out = out.withColumn("context", F.when(is_c, top).when(is_g, bottom)).withColumn("second", F.when(is_c, F.col("_r1")).when(is_g, complement(F.col("_l1"))))
    return out.drop("_l1", "_l2", "_r1", "_r2", "_span")


def context_of(seq: Column, position: Column) -> tuple[Column, Column]:
    """Context and second base straight from a contig's text, without a window."""
    at = lambda k: F.when((position + k >= 0) & (position + k < F.length(seq)), F.substring(seq, (position + k + 1).cast("int"), F.lit(1)))
    top, bottom = context_class(at(1), at(2)), context_class(complement(at(-1)), complement(at(-2)))
    return F.when(at(0) == "C", top).when(at(0) == "G", bottom), F.when(at(0) == "C", at(1)).when(at(0) == "G", complement(at(-1)))


def site_counts(observations: DataFrame, options: MethylationOptions = MethylationOptions()) -> DataFrame:
    """Counts by class of every cytosine observed; contexts that disagree on a site are an error. Partial sums
    are made before the one shuffle."""
    kind = methylation_class(F.col("reference_base"), F.col("query_base"), F.col("strand"))
    rows = observations.where(passes(options.min_base_quality, options.min_mapping_quality, True)).withColumn("_k", kind).where("_k is not null")
    count = lambda k: F.sum((F.col("_k") == k).cast("bigint")).alias(k)
    one = lambda c: F.when(F.min(c) != F.max(c), F.raise_error(F.lit(f"observations of one site differ in {c}"))).otherwise(F.max(c)).alias(c)
    return rows.groupBy("contig", "position", "strand").agg(one("context"), one("second"), *[count(k) for k in ("methylated", "unmethylated", "deleted", "different")])


def called_sites(sites: DataFrame, options: MethylationOptions = MethylationOptions()) -> DataFrame:
    out = sites.where((F.col("methylated") + F.col("unmethylated") >= options.min_depth) & F.col("context").isNotNull())
    return out.where("context = 'CG'") if options.cg_only else out


def unresolved(sites: DataFrame, options: MethylationOptions = MethylationOptions()) -> DataFrame:
    """One row: sites deep enough whose context does not resolve, and their observations."""
    deep = sites.where((F.col("methylated") + F.col("unmethylated") >= options.min_depth) & F.col("context").isNull())
    return deep.agg(F.count("*").alias("sites"), F.coalesce(F.sum(F.col("methylated") + F.col("unmethylated")), F.lit(0)).alias("observations"))


def cgmap_columns(sites: DataFrame) -> DataFrame:
    total = F.col("methylated") + F.col("unmethylated")
    return sites.select(
        "contig",
        F.when(F.col("strand") == "T", "C").otherwise("G").alias("nucleotide"),
        (F.col("position") + 1).alias("pos1"),
        "context",
        F.concat(F.lit("C"), F.col("second")).alias("dinucleotide"),
        F.when(total == 0, "na").otherwise(fixed_point(scaled_ratio(F.col("methylated"), F.greatest(total, F.lit(1)), 1_000_000), 6)).alias("level"),
        F.col("methylated").alias("meth"),
        total.alias("total"),
    )


def bedmethyl_columns(sites: DataFrame) -> DataFrame:
    m, u = F.col("methylated"), F.col("unmethylated")
    total, zero, end = m + u, F.lit(0).cast("bigint"), F.col("position") + 1
    return sites.select(
        "contig",
        F.col("position").alias("start"),
        end.alias("end"),
        F.concat_ws(",", F.lit("m"), F.col("context"), F.lit("0")).alias("modification"),
        total.alias("score"),
        F.when(F.col("strand") == "T", "+").otherwise("-").alias("strand"),
        F.col("position").alias("thick_start"),
        end.alias("thick_end"),
        F.lit("255,0,0").alias("color"),
        total.alias("coverage"),
        F.when(total == 0, "0.00").otherwise(fixed_point(scaled_ratio(m, F.greatest(total, F.lit(1)), 10_000), 2)).alias("percent"),
        m.alias("meth"),
        u.alias("unmeth"),
        zero.alias("other_mod"),
        F.col("deleted"),
        zero.alias("failed"),
        F.col("different"),
        zero.alias("no_call"),
    )
