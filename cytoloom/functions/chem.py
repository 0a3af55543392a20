"""Bisulfite chemistry as column expressions.

Strands of a fragment: OT, OB, CTOT, CTOB. Cytosine strands: T (top) and B (bottom). A converted
cytosine reads as T on the top strand; on the bottom strand the reference shows G and the read A.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Strand, orientation, cytosine strand, search conversion, XG tag, XR tag.
STRANDS = (
    ("OT", "forward", "T", "C>T", "CT", "CT"),
    ("OB", "reverse", "B", "G>A", "GA", "CT"),
    ("CTOT", "reverse", "T", "C>T", "CT", "GA"),
    ("CTOB", "forward", "B", "G>A", "GA", "GA"),
)


def strand_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRANDS, "strand string, orientation string, cytosine_strand string, conversion string, xg string, xr string")


def complementary_strand(strand: Column) -> Column:
    """The label a strand takes in the complementary pass of a non-directional library."""
    return F.when(strand == "OT", "CTOT").when(strand == "OB", "CTOB")


def strand_is_valid(strand: Column, orientation: Column, cytosine_strand: Column) -> Column:
    ok = F.lit(False)
    for s, o, c, *_ in STRANDS:
        ok = ok | ((strand == s) & (orientation == o) & (cytosine_strand == c))
    return ok


def normalised(seq: Column) -> Column:
    return F.upper(seq)


def first_bad_base(seq: Column) -> Column:
    """1-based place of the first letter other than A, C, G, T, N after upper-casing; 0 if there is none."""
    good = F.length(F.regexp_extract(F.upper(seq), "^([ACGTN]*)", 1))
    return F.when(good == F.length(seq), F.lit(0)).otherwise(good + 1)


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTN", "TGCAN")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def converted(seq: Column, conversion: str) -> Column:
    """Three-letter projection; ``conversion`` is ``C>T`` or ``G>A``."""
    return F.translate(seq, conversion[0], conversion[2])


def base_relation(ref: Column, query: Column, cytosine_strand: Column) -> Column:
    """literal, compatible (explained by conversion), mismatch, or unknown (any N)."""
    known = ref.isin("A", "C", "G", "T") & query.isin("A", "C", "G", "T")
    by_conversion = ((cytosine_strand == "T") & (ref == "C") & (query == "T")) | ((cytosine_strand == "B") & (ref == "G") & (query == "A"))
    return F.when(~known, "unknown").when(ref == query, "literal").when(by_conversion, "compatible").otherwise("mismatch")


def base_cost(ref: Column, query: Column, cytosine_strand: Column) -> Column:
    return F.when(base_relation(ref, query, cytosine_strand).isin("literal", "compatible"), 0).otherwise(1)


def methylation_class(ref: Column, query: Column, cytosine_strand: Column) -> Column:
    """methylated, unmethylated, deleted (no base), different; null where the site is no cytosine."""
    top, bottom = (cytosine_strand == "T") & (ref == "C"), (cytosine_strand == "B") & (ref == "G")
    return (
        F.when(~(top | bottom), F.lit(None))
        .when(query.isNull(), "deleted")
        .when((top & (query == "C")) | (bottom & (query == "G")), "methylated")
        .when((top & (query == "T")) | (bottom & (query == "A")), "unmethylated")
        .otherwise("different")
    )


def context_class(next1: Column, next2: Column) -> Column:
    """CG, CHG or CHH from the next bases on the cytosine's strand; null where they do not tell.

    CG needs one canonical neighbour, the others two.
    """
    canonical = lambda c: F.coalesce(c.isin("A", "C", "G", "T"), F.lit(False))
    return F.when(~canonical(next1), F.lit(None)).when(next1 == "G", "CG").when(~canonical(next2), F.lit(None)).when(next2 == "G", "CHG").otherwise("CHH")


def confounded(ref: Column, query: Column, cytosine_strand: Column) -> Column:
    """A base that conversion alone explains and that therefore says nothing of a variant."""
    return ((ref == "C") & (query == "T") & (cytosine_strand == "T")) | ((ref == "G") & (query == "A") & (cytosine_strand == "B"))
