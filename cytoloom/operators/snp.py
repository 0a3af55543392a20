"""Bayesian diploid variant calling under bisulfite conversion.

Two passes over the same observations: cheap conditional counts choose candidate sites, and only their
observations, folded into a histogram of (base, strand, qualities), reach the likelihood. The posterior
integrates over the unknown methylation level of each site for genotypes whose evidence depends on it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.chem import confounded
from ..functions.numeric import observation_error

BASES = "ACGT"
GENOTYPES = tuple(a + b for i, a in enumerate(BASES) for b in BASES[i:])
SITE = ["contig", "position"]


@dataclass(frozen=True)
class SnpOptions:
    min_base_quality: int = 20
    min_mapping_quality: int = 20
    min_depth: int = 10
    min_alt_count: int = 2
    min_alt_fraction_ppb: int = 100_000_000
    min_genotype_quality: int = 0
    min_allele_quality: int = 30
    heterozygosity: float = 1e-3
    underconversion: float = 2.5e-3
    overconversion: float = 0.0
    sample_name: str | None = None

    def __post_init__(self):
        for name, most in (("min_base_quality", 93), ("min_mapping_quality", 254), ("min_genotype_quality", 99), ("min_allele_quality", 99), ("min_alt_fraction_ppb", 1_000_000_000)):
            if not 0 <= getattr(self, name) <= most:
                raise ConfigurationError(f"{name} is 0 to {most}")
        if self.min_depth < 1 or self.min_alt_count < 1:
            raise ConfigurationError("depth and alternate count are at least 1")
        if not 0 < self.heterozygosity < 1:
            raise ConfigurationError("heterozygosity lies between 0 and 1")
        if self.underconversion < 0 or self.overconversion < 0 or self.underconversion + self.overconversion >= 1:
            raise ConfigurationError("conversion errors are not negative and sum to less than 1")


def usable(observations: DataFrame, options: SnpOptions = SnpOptions()) -> DataFrame:
    known = lambda c: F.col(c).isin(*BASES)
    quality = (F.col("base_quality") >= options.min_base_quality) & (F.col("mapping_quality") != 255) & (F.col("mapping_quality") >= options.min_mapping_quality)
    return observations.where(known("reference_base") & known("query_base") & quality)


def candidates(observations: DataFrame, options: SnpOptions = SnpOptions()) -> DataFrame:
    """Sites with enough unconfounded depth and alternates. Depth here leaves out what conversion
    explains; products are exact integers."""
    rows = observations.where(~confounded(F.col("reference_base"), F.col("query_base"), F.col("strand")))
    one = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(name)
    alt = lambda b: one((F.col("query_base") == b) & (F.col("reference_base") != b), f"alt_{b.lower()}")
    out = rows.groupBy(*SITE, "reference_base").agg(one(F.col("query_base") == F.col("reference_base"), "ref_count"), *map(alt, BASES))
    alts = [F.col(f"alt_{b.lower()}") for b in BASES]
    out = out.withColumn("depth", F.col("ref_count") + alts[0] + alts[1] + alts[2] + alts[3]).withColumn("max_alt", F.greatest(*alts))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    return out.where((F.col("depth") >= options.min_depth) & (F.col("max_alt") >= options.min_alt_count) & (big("max_alt") * F.lit(1_000_000_000) >= big("depth") * F.lit(options.min_alt_fraction_ppb)))


def at_candidates(observations: DataFrame, sites: DataFrame) -> DataFrame:
    """Observations of chosen sites only: a semi-join, left to AQE to broadcast when small."""
    return observations.join(sites.select(*SITE), SITE, "left_semi")


def strand_counts(observations: DataFrame, sites: DataFrame) -> DataFrame:
    one = lambda s, b, n: F.sum(F.when((F.col("strand") == s) & (F.col("query_base") == b), 1).otherwise(0)).cast("bigint").alias(f"{n}_{b.lower()}")
    aggs = [one(s, b, n) for s, n in (("T", "top"), ("B", "bottom")) for b in BASES]
    return at_candidates(observations, sites).groupBy(*SITE, "reference_base").agg(F.count("*").alias("depth"), *aggs)


def informative_depth(allele: str, others: Column) -> Column:
    """Depth that conversion can't have made: T beside a C counts on the bottom strand only, A beside a
    G on the top strand only. ``others`` is an array of the site's selected alleles."""
    top, bottom = F.col(f"top_{allele.lower()}"), F.col(f"bottom_{allele.lower()}")
    if allele == "T":
        return F.when(F.array_contains(others, "C"), bottom).otherwise(top + bottom)
    if allele == "A":
        return F.when(F.array_contains(others, "G"), top).otherwise(top + bottom)
    return top + bottom


def allele_depths(counts: DataFrame) -> DataFrame:
    """(contig, position, allele, ad, iad) where every allele seen at the site counts as selected."""
    seen = F.filter(F.array(*[F.when(F.col(f"top_{b.lower()}") + F.col(f"bottom_{b.lower()}") > 0, b) for b in BASES]), lambda x: x.isNotNull())
    per = F.array(*[F.struct(F.lit(b).alias("allele"), (F.col(f"top_{b.lower()}") + F.col(f"bottom_{b.lower()}")).alias("ad"), informative_depth(b, seen).alias("iad")) for b in BASES])
    return counts.select(*SITE, F.explode(per).alias("x")).select(*SITE, "x.*")


def priors(spark: SparkSession, heterozygosity: float) -> DataFrame:
    """(reference_base, genotype, log_prior): 40 rows."""
    rows = [(r, g, float(p)) for r in BASES for g, p in zip(GENOTYPES, log_priors(r, heterozygosity))]
    return spark.createDataFrame(rows, "reference_base string, genotype string, log_prior double")


def log_priors(reference: str, heterozygosity: float) -> np.ndarray:
    keep = np.sqrt(1 - heterozygosity)
    freq = {b: keep if b == reference else (1 - keep) / 3 for b in BASES}
    return np.log([freq[g[0]] * freq[g[1]] * (1 if g[0] == g[1] else 2) for g in GENOTYPES])


def constant_log_likelihoods(observations: DataFrame, sites: DataFrame) -> DataFrame:
    """(contig, position, genotype, log_likelihood) of the evidence that conversion does not touch: sums
    over observations on strands where the genotype is not sensitive."""
    e = observation_error(F.col("base_quality"), F.col("mapping_quality"))
    rows = at_candidates(observations, sites).select(*SITE, "query_base", "strand", e.alias("e"))
    p = lambda allele: F.when(F.col("query_base") == allele, 1 - F.col("e")).otherwise(F.col("e") / 3)
    aggs = []
    for g in GENOTYPES:
        touched = F.lit(False)
        if "C" in g:
            touched = touched | (F.col("strand") == "T")
        if "G" in g:
            touched = touched | (F.col("strand") == "B")
        aggs.append(F.sum(F.when(touched, 0.0).otherwise(F.ln((p(g[0]) + p(g[1])) / 2))).alias(g))
    wide = rows.groupBy(*SITE).agg(*aggs)
    return wide.select(*SITE, F.explode(F.array(*[F.struct(F.lit(g).alias("genotype"), F.col(g).alias("log_likelihood")) for g in GENOTYPES])).alias("x")).select(*SITE, "x.*")


def histogram(observations: DataFrame, sites: DataFrame) -> DataFrame:
    """Observations of a site with equal base, strand and (capped) qualities as one row with a count;
    bounded by 4 * 2 * 61 * 61 rows a site whatever its depth."""
    cap = lambda c: F.least(F.col(c), F.lit(60)).alias(c)
    return at_candidates(observations, sites).groupBy(*SITE, "reference_base", "query_base", "strand", cap("base_quality"), cap("mapping_quality")).agg(F.count("*").alias("n"))


def emission(genotype: str, base: np.ndarray, top: np.ndarray, error: np.ndarray, retention: float) -> np.ndarray:
    """Chance of each observation; a C on top (G on bottom) is kept with ``retention`` and else read as
    T (A)."""
    out = np.zeros(len(base))
    for allele in genotype:
        kept = np.where(base == allele, 1 - error, error / 3)
        turned = {"C": "T", "G": "A"}.get(allele)
        if turned:
            here = top if allele == "C" else ~top
            lost = np.where(base == turned, 1 - error, error / 3)
            kept = np.where(here, retention * kept + (1 - retention) * lost, kept)
        out += np.maximum(kept, np.finfo(float).tiny) / 2
    return np.maximum(out, np.finfo(float).tiny)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)
#: Parts each side of the mode is cut in; widths shrink towards the mode, where the mass is.
_CUTS = np.concatenate([[0.0], 2.0 ** np.arange(-24, 1)])


def log_integral(intercept: np.ndarray, slope: np.ndarray, n: np.ndarray) -> float:
    """log of the integral over m in 0..1 of the product of (intercept + slope m) ** n.

    The integrand is log-concave. Gauss-Legendre rules run over intervals that halve towards the mode,
    so a peak of any sharpness is resolved; values are scaled by the mode's.
    """
    if not len(n):
        return 0.0
    rate = lambda m: float(np.sum(n * slope / (intercept + slope * m)))
    if rate(0.0) <= 0:
        mode = 0.0
    elif rate(1.0) >= 0:
        mode = 1.0
    else:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if rate(mid) > 0 else (lo, mid)
        mode = (lo + hi) / 2
    height = float(np.sum(n * np.log(intercept + slope * mode)))
    edges = np.unique(np.concatenate([mode - mode * _CUTS, mode + (1 - mode) * _CUTS]))
    a, b = edges[:-1, None], edges[1:, None]
    m = ((b - a) * _NODES + (a + b)) / 2
    value = np.exp(np.tensordot(n, np.log(intercept[:, None, None] + slope[:, None, None] * m), 1) - height)
    return height + float(np.log(np.sum((b - a) / 2 * value * _WEIGHTS)))


def _phred(p: float, most: float) -> float:
    return most if p <= 0 else min(max(-10 * np.log10(p), 0.0), most)


def _whole(x: float, most: int) -> int:
    return int(min(max(np.floor(x + 0.5), 0), most))


def call_site(reference: str, base, strand, bq, mq, n, options: SnpOptions) -> dict | None:
    """The call at one site from its histogram; None where the best genotype is the reference's."""
    base, top = np.asarray(base), np.asarray(strand) == "T"
    n = np.asarray(n, float)
    wrong = lambda q: 10.0 ** (-np.minimum(np.asarray(q, float), 60) / 10)
    error = np.minimum(0.75, 1 - (1 - wrong(bq)) * (1 - wrong(mq)))
    counts = {(s, b): int(n[(base == b) & (top == (s == "T"))].sum()) for s in "TB" for b in BASES}
    depth = int(n.sum())
    if depth < options.min_depth:
        return None
    ll = np.zeros(len(GENOTYPES))
    for i, g in enumerate(GENOTYPES):
        touched = (top & ("C" in g)) | (~top & ("G" in g))
        ll[i] = float(np.sum(n[~touched] * np.log(emission(g, base[~touched], top[~touched], error[~touched], 0.5))))
        if touched.any():
            at0 = emission(g, base[touched], top[touched], error[touched], options.underconversion)
            at1 = emission(g, base[touched], top[touched], error[touched], 1 - options.overconversion)
            ll[i] += log_integral(at0, at1 - at0, n[touched])
    joint = ll + log_priors(reference, options.heterozygosity)
    posterior = np.exp(joint - joint.max())
    posterior /= posterior.sum()
    best = GENOTYPES[int(np.argmax(posterior))]
    if best == reference * 2:
        return None
    alternates = sorted(set(best) - {reference})
    index = lambda a, b: GENOTYPES.index("".join(sorted((a, b))))
    if len(alternates) == 1:
        alt = alternates[0]
        het, hom = ll[index(reference, alt)], ll[index(alt, alt)]
        p_hom = 1 / (1 + np.exp(np.clip(het - hom, -700, 700)))
        genotype, sure = (alt * 2, p_hom) if hom > het else ("".join(sorted((reference, alt))), 1 - p_hom)
        freq = [0.5 * (1 - p_hom) + p_hom]
    else:
        genotype, sure, freq = best, 1.0, [0.5, 0.5]
    same_set = sum(p for g, p in zip(GENOTYPES, posterior) if sorted(set(g) - {reference}) == alternates)
    gq = _whole(_phred(1 - same_set * sure, 99), 99)
    aq = [_whole(_phred(sum(p for g, p in zip(GENOTYPES, posterior) if a not in g), 99), 99) for a in alternates]
    alleles = [reference, *alternates]
    pairs = [ll[index(alleles[i], alleles[j])] for j in range(len(alleles)) for i in range(j + 1)]
    pl = [_whole((max(pairs) - x) * 10 / np.log(10), 999) for x in pairs]
    raw = [counts["T", a] + counts["B", a] for a in alleles]
    told = [counts["B", a] if a == "T" and "C" in alleles else counts["T", a] if a == "A" and "G" in alleles else counts["T", a] + counts["B", a] for a in alleles]
    low = [name for name, bad in (("LowAD", any(x < options.min_alt_count for x in told[1:])), ("LowGQ", gq < options.min_genotype_quality), ("LowAQ", any(x < options.min_allele_quality for x in aq))) if bad]
    places = sorted(alleles.index(x) for x in genotype)
    one_strand = ("C" in alleles and "T" in alleles) or ("G" in alleles and "A" in alleles)
    return {
        "alt": ",".join(alternates),
        "qual": float(_phred(float(posterior[index(reference, reference)]), 999)),
        "filter": ";".join(low) or "PASS",
        "depth": depth,
        "genotype": "/".join(map(str, places)),
        "gq": gq,
        "aq": aq,
        "af": [float(x) for x in freq],
        "ad": raw,
        "iad": told,
        "pl": pl,
        "bs8": [counts[s, b] for s in "TB" for b in BASES],
        "bsi": "ONE" if one_strand else "BOTH",
    }


CALL_DDL = "position bigint, ref string, alt string, qual double, filter string, depth bigint, genotype string, gq int, aq array<int>, af array<double>, ad array<bigint>, iad array<bigint>, pl array<int>, bs8 array<bigint>, bsi string"


def call(observations: DataFrame, options: SnpOptions = SnpOptions()) -> DataFrame:
    """Variant calls at candidate sites; a group handed to Python is one site's bounded histogram."""
    bins = histogram(observations, candidates(observations, options))
    packed = bins.groupBy(*SITE, "reference_base").agg(F.collect_list(F.struct("query_base", "strand", "base_quality", "mapping_quality", "n")).alias("bins"))
    contig = observations.schema["contig"].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = []
            for c, p, ref, site in zip(f["contig"], f["position"], f["reference_base"], f["bins"]):
                # in a fixed order, so that sums do not depend on how rows were dealt
                site = sorted((b["query_base"], b["strand"], b["base_quality"], b["mapping_quality"], b["n"]) for b in site)
                made = call_site(ref, *zip(*site), options)
                if made:
                    rows.append({"contig": c, "position": p, "ref": ref} | made)
            yield pd.DataFrame(rows, columns=["contig", *[x.split()[0] for x in CALL_DDL.split(", ")]])

    return packed.mapInPandas(run, f"contig {contig}, {CALL_DDL}")


def vcf_rows(calls: DataFrame) -> DataFrame:
    """(contig, pos, id, ref, alt, qual, filter, info, format, sample) as texts."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    places = F.array_join(F.transform("af", lambda x: F.format_string("%.6f", x)), ",")
    info = F.concat(F.lit("DP="), F.col("depth").cast("string"), F.lit(";AF="), places, F.lit(";BSI="), F.col("bsi"), F.lit(";BS8="), listed("bs8"))
    sample = F.concat_ws(":", "genotype", F.col("gq").cast("string"), listed("aq"), F.col("depth").cast("string"), listed("ad"), listed("iad"), listed("pl"))
    return calls.select("contig", (F.col("position") + 1).alias("pos"), F.lit(".").alias("id"), "ref", "alt", F.format_string("%.2f", F.col("qual")).alias("qual"), "filter", info.alias("info"), F.lit("GT:GQ:AQ:DP:AD:IAD:PL").alias("format"), sample.alias("sample"))
