"""Command line: ``call meth|snp|joint``, ``combine``, ``index``, ``align``, ``info``.

Exit codes: 0 done, 1 a run failed, 2 the command line is wrong.
"""

from __future__ import annotations

import argparse
import logging
import sys

from . import api
from .errors import ConfigurationError, EngineError
from .functions.numeric import ppb
from .operators.combine import CombineOptions
from .operators.methylation import MethylationOptions
from .operators.single import ADAPTER
from .operators.snp import SnpOptions

log = logging.getLogger("cytoloom")


def _region(text: str) -> tuple[str, int, int]:
    contig, _, span = text.rpartition(":")
    first, _, last = span.partition("-")
    try:
        start, end = (int(x.replace(",", "")) for x in (first, last))
    except ValueError:
        raise ConfigurationError(f"not a region: {text!r}") from None
    if not contig or start < 1 or end < start:
        raise ConfigurationError(f"not a region: {text!r}")
    return contig, start - 1, end


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cytoloom")
    commands = top.add_subparsers(dest="command", required=True)
    call = commands.add_parser("call", help="methylation and variants from alignments").add_subparsers(dest="kind", required=True)
    for kind in ("meth", "snp", "joint"):
        p = call.add_parser(kind)
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-r", "--reference", required=True)
        p.add_argument("--region", action="append", default=[])
        p.add_argument("--regions-file")
        p.add_argument("--min-bq", type=int, default=20)
        p.add_argument("--min-mapq", type=int, default=20)
        p.add_argument("--min-depth", type=int, default=10)
        p.add_argument("--ignore-orphans", action="store_true")
        p.add_argument("--compress", action="store_true")
        if kind in ("meth", "joint"):
            p.add_argument("--format", choices=("cgmap", "bedmethyl"), default="bedmethyl")
            p.add_argument("--cg-only", action="store_true")
        if kind in ("snp", "joint"):
            p.add_argument("--sample-name")
            p.add_argument("--min-alt-count", type=int, default=2)
            p.add_argument("--min-alt-fraction", default="0.1")
            p.add_argument("--min-gq", type=int, default=0)
            p.add_argument("--min-aq", type=int, default=30)
            p.add_argument("--heterozygosity", type=float, default=1e-3)
            p.add_argument("--underconversion", type=float, default=2.5e-3)
            p.add_argument("--overconversion", type=float, default=0.0)
        if kind == "joint":
            p.add_argument("--meth-output", required=True)
            p.add_argument("--vcf-output", required=True)
        else:
            p.add_argument("-o", "--output", required=True)
    p = commands.add_parser("combine", help="cohort matrices from samples' methylation tables")
    p.add_argument("-i", "--inputs", required=True, help="paths, comma-separated")
    p.add_argument("-s", "--samples", required=True, help="names, comma-separated")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--matrix", choices=("level", "count", "both"), default="level")
    p.add_argument("--min-count", type=int, default=1)
    p.add_argument("--min-prop", default="0")
    p.add_argument("--cg-only", action="store_true")
    p.add_argument("--compress", action="store_true")
    p = commands.add_parser("index", help="a seed index from a FASTA file")
    p.add_argument("-r", "--reference", required=True)
    p.add_argument("-o", "--output", required=True)
    p = commands.add_parser("align", help="reads to SAM")
    p.add_argument("-r", "--reference", required=True)
    p.add_argument("-1", "--reads1", required=True)
    p.add_argument("-2", "--reads2")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--max-edits", type=int, default=5)
    p.add_argument("--non-directional", action="store_true")
    p.add_argument("--min-span", type=int, default=0)
    p.add_argument("--max-span", type=int, default=1000)
    p.add_argument("--mapped-only", action="store_true")
    p.add_argument("--tie-break-seed", type=int, default=0)
    p.add_argument("--metrics")
    p.add_argument("--adapter", default=ADAPTER, help="adapter that single reads may run into")
    p.add_argument("--no-adapter", action="store_true")
    p.add_argument("--index", help="an index of the reference")
    p.add_argument("--sensitive", action="store_true", help="search until no placement can be missing")
    commands.add_parser("info", help="versions and settings of this installation")
    return top


def _meth(a) -> MethylationOptions:
    return MethylationOptions(a.min_bq, a.min_mapq, a.min_depth, a.cg_only, a.ignore_orphans)


def _snp(a) -> SnpOptions:
    return SnpOptions(a.min_bq, a.min_mapq, a.min_depth, a.min_alt_count, ppb(a.min_alt_fraction), a.min_gq, a.min_aq, a.heterozygosity, a.underconversion, a.overconversion, a.sample_name)


def run(a) -> None:
    from .session import session

    spark = session(**{"spark.ui.enabled": "false"})
    if a.command == "call":
        regions = [_region(r) for r in a.region]
        where = dict(input=a.input, reference=a.reference, regions=regions, regions_file=a.regions_file, compress=a.compress)
        if a.kind == "meth":
            report = api.call_meth(spark, output=a.output, fmt=a.format, options=_meth(a), **where)
        elif a.kind == "snp":
            report = api.call_snp(spark, output=a.output, options=_snp(a), ignore_orphans=a.ignore_orphans, **where)
        else:
            report = api.call_joint(spark, meth_output=a.meth_output, vcf_output=a.vcf_output, fmt=a.format, meth=_meth(a), variants=_snp(a), **where)
    elif a.command == "combine":
        inputs = list(zip(a.samples.split(","), a.inputs.split(","), strict=True)) if a.samples.count(",") == a.inputs.count(",") else None
        if inputs is None:
            raise ConfigurationError("as many samples as inputs are needed")
        report = api.combine(spark, inputs, a.output, a.matrix, CombineOptions(a.min_count, ppb(a.min_prop), a.cg_only), a.compress)
    elif a.command == "index":
        report = api.index(spark, a.reference, a.output)
    elif a.command == "align":
        report = api.align(spark, a.reference, a.reads1, a.reads2, a.output, a.max_edits, a.non_directional, (a.min_span, a.max_span), a.mapped_only, a.tie_break_seed, a.metrics, None if a.no_adapter else a.adapter, a.index, a.sensitive)
    else:
        report = api.info(spark)
    for k, v in report.items():
        log.info("%s: %s", k, v)


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    args = parser().parse_args(argv)
    try:
        run(args)
    except ConfigurationError as error:
        log.error("%s", error)
        return 2
    except EngineError as error:
        log.error("%s", error)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
