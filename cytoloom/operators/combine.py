"""Cohort matrices: a k-way full outer merge of samples on site keys, as one grouped pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError, InputError
from ..functions.numeric import fixed_point, required_samples, scaled_ratio

KEY = ["contig", "start", "end", "strand"]


@dataclass(frozen=True)
class CombineOptions:
    min_count: int = 1
    min_prop_ppb: int = 0
    cg_only: bool = False

    def __post_init__(self):
        if self.min_count < 1:
            raise ConfigurationError("the least count is at least 1")
        if not 0 <= self.min_prop_ppb <= 1_000_000_000:
            raise ConfigurationError("the least proportion is 0 to 1")


#: Lines whose order one task looks at.
LINES = 1 << 20


def unordered(sites: DataFrame, lines: int = LINES) -> DataFrame:
    """Rows of a sample that do not come strictly after the one before in their contig; ``line`` gives
    the input's order. Stretches of lines are looked at apart, each after the last row of the one before."""
    now = F.struct("start", "end", "strand")
    rows = sites.withColumn("_part", F.floor(F.col("line") / lines))
    ends = rows.groupBy("sample", "contig", "_part").agg(F.max_by(now, "line").alias("_last"))
    before = ends.select("sample", "contig", "_part", F.lag("_last").over(Window.partitionBy("sample", "contig").orderBy("_part")).alias("_earlier"))
    w = Window.partitionBy("sample", "contig", "_part").orderBy("line")
    rows = rows.withColumn("_before", F.lag(now).over(w)).join(before, ["sample", "contig", "_part"]).withColumn("_before", F.coalesce("_before", "_earlier"))
    return rows.where(F.col("_before").isNotNull() & (F.col("_before") >= now)).select(*sites.columns)


def split_contigs(sites: DataFrame) -> DataFrame:
    """(sample, contig) whose rows lie among another contig's, or have another's among them. Only the first
    and last line of each contig are put in order."""
    ends = sites.groupBy("sample", "contig").agg(F.min("line").alias("_first"), F.max("line").alias("_last"))
    w = Window.partitionBy("sample").orderBy("_first")
    reach, follows = F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lead("_first").over(w)
    return ends.withColumn("_bad", (reach > F.col("_first")) | (follows < F.col("_last"))).where("_bad").select("sample", "contig")


def contig_order(sites: DataFrame) -> list[str]:
    """One order that agrees with every sample's; ties go to the contig seen first.

    Works on the distinct neighbouring pairs of contigs, a table as small as the genome's dictionary.
    """
    first = sites.groupBy("sample", "contig").agg(F.min("line").alias("line"))
    rows = first.orderBy("sample", "line").collect()
    after: dict[str, set[str]] = {}
    seen: list[str] = []
    last: dict[str, str] = {}
    for r in rows:
        if r.contig not in after:
            after[r.contig] = set()
            seen.append(r.contig)
        if r.sample in last:
            after[last[r.sample]].add(r.contig)
        last[r.sample] = r.contig
    waits = {c: sum(c in later for later in after.values()) for c in seen}
    order: list[str] = []
    while len(order) < len(seen):
        ready = next((c for c in seen if c not in order and waits[c] == 0), None)
        if ready is None:
            raise InputError("the samples' contigs come in orders that contradict each other")
        order.append(ready)
        for c in after[ready]:
            waits[c] -= 1
    return order


def cells(sites: DataFrame, options: CombineOptions = CombineOptions()) -> DataFrame:
    """Sites with ``valid``: whether the sample's cell may be shown."""
    return sites.withColumn("valid", (F.col("total") != 0) & (F.col("total") >= options.min_count))


def mixed_modifications(sites: DataFrame) -> DataFrame:
    return sites.groupBy(*KEY).agg(F.min("modification").alias("a"), F.max("modification").alias("b")).where("a != b")


def matrix(sites: DataFrame, samples: list[str], kind: str = "level", options: CombineOptions = CombineOptions()) -> DataFrame:
    """One row a retained site; columns of each sample are ``<sample>`` (level) or ``<sample>_meth`` and
    ``<sample>_total`` (count), null where absent or not valid. One shuffle, with partial sums."""
    if kind not in ("level", "count"):
        raise ConfigurationError(f"no such matrix: {kind}")
    if len(set(samples)) != len(samples) or not samples:
        raise ConfigurationError("sample names must be given and distinct")
    valid = cells(sites, options)
    of = lambda s, c: F.max(F.when((F.col("sample") == s) & F.col("valid"), F.col(c)))
    aggs = [x for i, s in enumerate(samples) for x in (of(s, "meth").alias(f"_m{i}"), of(s, "total").alias(f"_t{i}"))]
    wide = valid.groupBy(*KEY, "modification").agg(F.sum(F.col("valid").cast("int")).alias("_valid"), *aggs)
    wide = wide.where(F.col("_valid") >= required_samples(len(samples), options.min_prop_ppb))
    if options.cg_only:
        wide = wide.where("modification = 'm,CG,0'")
    if kind == "level":
        level = lambda i: F.when(F.col(f"_t{i}").isNotNull(), fixed_point(scaled_ratio(F.col(f"_m{i}"), F.col(f"_t{i}"), 1_000_000), 6))
        values = [level(i).alias(s) for i, s in enumerate(samples)]
    else:
        values = [x for i, s in enumerate(samples) for x in (F.col(f"_m{i}").alias(f"{s}_meth"), F.col(f"_t{i}").alias(f"{s}_total"))]
    return wide.select("contig", "start", "end", "modification", F.lit(0).alias("score"), "strand", *values)


def report(sites: DataFrame, n_samples: int, options: CombineOptions = CombineOptions()) -> DataFrame:
    """One row: sites seen, sites written."""
    per = cells(sites, options).groupBy(*KEY, "modification").agg(F.sum(F.col("valid").cast("int")).alias("v"))
    keep = F.col("v") >= required_samples(n_samples, options.min_prop_ppb)
    if options.cg_only:
        keep = keep & (F.col("modification") == "m,CG,0")
    return per.agg(F.count("*").alias("sites_seen"), F.coalesce(F.sum(keep.cast("bigint")), F.lit(0)).alias("sites_written"))
