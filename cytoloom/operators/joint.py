"""Methylation and variants from one collapsed table of observations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame

from . import snp
from .evidence import collapse_overlaps
from .methylation import MethylationOptions, called_sites, site_counts


class Joint(NamedTuple):
    sites: DataFrame
    variants: DataFrame


def call(observations: DataFrame, meth: MethylationOptions = MethylationOptions(), variants: snp.SnpOptions = snp.SnpOptions(), extra_order: tuple[Column, ...] = ()) -> Joint:
    """Both results, each as its own caller would give it.

    Deletions pass the shared collapse; they never become variant evidence, and any passing base
    outranks them, so the variant half does not change.
    """
    one = collapse_overlaps(observations, meth.min_base_quality, meth.min_mapping_quality, True, extra_order=extra_order)
    one = one.persist(StorageLevel.MEMORY_AND_DISK)
    return Joint(called_sites(site_counts(one, meth), meth), snp.call(snp.usable(one, variants), variants))
