"""What the command line does, as functions of a session and options."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigurationError, InputError
from .functions.chem import reverse_complement
from .operators import alignment as al
from .operators import combine as combining
from .operators import intervals, joint, methylation, paired, single, snp
from .operators.evidence import alignment_columns, collapse_overlaps, cytosine_strand, fragments, kept_records, pieces, with_reference
from .operators.records import described
from .session import cut
from .sinks.files import distinct_paths, matrix_paths, publish, tabbed, write_text
from .sinks.bam import write_bam
from .sources import bam, fasta, fastq, sam, sites

VERSION = "0.1.0"


def observations(spark: SparkSession, input: str, reference: str, regions=(), regions_file: str | None = None, ignore_orphans: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observed bases of an alignment file (SAM text, BAM, or Parquet of its records), the contigs, and the
    header (none for Parquet). Positions outside the regions are left out before anything is shuffled."""
    contigs = fasta.read(spark, reference)
    parquet = input.rstrip("/").endswith(".parquet")
    head = None
    if parquet:
        records = spark.read.parquet(input)
    else:
        reader = bam if input.endswith(".bam") else sam
        head = reader.header(spark, input)
        sam.check_header(head)
        fasta.check_identity(contigs, sam.dictionary(head))
        records = reader.records(spark, input)
    records = fragments(kept_records(records, ignore_orphans).withColumn("strand", cytosine_strand(F.col("xg"))))
    records = with_reference(records.select("fragment_id", "segment", "strand", "rname", "pos", F.col("mapq").alias("mapping_quality"), "cigar", "seq", "qual"), contigs)
    columns = alignment_columns(records.withColumnRenamed("rname", "contig").drop("piece")).where((F.col("position") >= F.col("window_start")) & (F.col("position") < F.col("window_end")))
    wanted = selection(spark, contigs, regions, regions_file)
    if wanted is not None:
        columns = intervals.clip(columns, wanted)
    at = F.col("position") - F.col("window_start") + 2
    context, second = methylation.context_of(F.col("window"), at)
    rows = columns.withColumn("reference_base", F.substring("window", (at + 1).cast("int"), F.lit(1))).withColumn("context", context).withColumn("second", second)
    rows = rows.drop("window", "window_start", "window_end", "pos")
    return rows, contigs, head


def selection(spark: SparkSession, contigs: DataFrame, regions=(), regions_file: str | None = None) -> DataFrame | None:
    """Disjoint regions, or None for everything."""
    rows = spark.createDataFrame(list(regions), "contig string, start bigint, end bigint") if regions else None
    if regions_file:
        more = sites.bed(spark, regions_file)
        rows = more if rows is None else rows.unionByName(more)
    if rows is None:
        return None
    bad = intervals.invalid(rows, contigs).head(1)
    if bad:
        raise InputError(f"not a region of the reference: {bad[0].contig}:{bad[0].start}-{bad[0].end}")
    return intervals.merged(rows)


def _ordinals(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    return rows.join(contigs.select("contig", F.col("ordinal").alias("_o")), "contig")


def _write_meth(called: DataFrame, contigs: DataFrame, output: str, fmt: str, compress: bool) -> int:
    table = methylation.cgmap_columns(called) if fmt == "cgmap" else methylation.bedmethyl_columns(called)
    place, strand = ("pos1", "nucleotide") if fmt == "cgmap" else ("start", "strand")
    rows = _ordinals(table, contigs).select("_o", F.col(place).alias("_p"), F.col(strand).alias("_s"), tabbed(*table.columns)).persist()
    write_text(rows, output, ["_o", "_p", "_s"], compress=compress)
    return rows.count()


def vcf_header(contigs: DataFrame, options: snp.SnpOptions, sample: str) -> list[str]:
    info = [
        ("FILTER", "LowAD", None, "Informative alternate depth is below the least"),
        ("FILTER", "LowGQ", None, "Genotype quality is below the least"),
        ("FILTER", "LowAQ", None, "Quality of an alternate's presence is below the least"),
        ("INFO", "DP", ("1", "Integer"), "Depth of fragments"),
        ("INFO", "AF", ("A", "Float"), "Expected alternate fraction, given the selected alternates"),
        ("INFO", "BSI", ("1", "String"), "Whether both strands or one tell the alleles apart"),
        ("INFO", "BS8", ("8", "Integer"), "Counts of A, C, G, T on the top, then the bottom strand"),
        ("FORMAT", "GT", ("1", "String"), "Genotype"),
        ("FORMAT", "GQ", ("1", "Integer"), "Quality of alternates and dosage"),
        ("FORMAT", "AQ", ("A", "Integer"), "Quality of each alternate's presence"),
        ("FORMAT", "DP", ("1", "Integer"), "Depth of fragments"),
        ("FORMAT", "AD", ("R", "Integer"), "Depth of each allele"),
        ("FORMAT", "IAD", ("R", "Integer"), "Informative depth of each allele"),
        ("FORMAT", "PL", ("G", "Integer"), "Phred-scaled genotype likelihoods"),
    ]
    lines = ["##fileformat=VCFv4.3", f"##source=cytoloom-{VERSION}", f"##options={json.dumps(options.__dict__, sort_keys=True)}"]
    lines += [f"##contig=<ID={r.contig},length={r.length}>" for r in contigs.select("contig", "length", "ordinal").orderBy("ordinal").toLocalIterator()]
    lines += [f'##{kind}=<ID={name},{f"Number={t[0]},Type={t[1]}," if t else ""}Description="{text}">' for kind, name, t, text in info]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def _write_vcf(calls: DataFrame, contigs: DataFrame, output: str, options: snp.SnpOptions, sample: str, compress: bool) -> int:
    table = snp.vcf_rows(calls)
    rows = _ordinals(table, contigs).select("_o", F.col("pos").alias("_p"), tabbed(*table.columns)).persist()
    write_text(rows, output, ["_o", "_p"], vcf_header(contigs, options, sample), compress)
    return rows.count()


def _sample(head: DataFrame | None, path: str, explicit: str | None) -> str:
    return explicit or (sam.sample_name(head, path) if head is not None else os.path.splitext(os.path.basename(path.rstrip("/")))[0])


def call_meth(spark: SparkSession, input: str, reference: str, output: str, fmt: str = "bedmethyl", options: methylation.MethylationOptions = methylation.MethylationOptions(), regions=(), regions_file: str | None = None, compress: bool = False) -> dict:
    distinct_paths(input, reference, output)
    obs, contigs, _ = observations(spark, input, reference, regions, regions_file, options.ignore_orphans)
    counted = methylation.site_counts(collapse_overlaps(obs, options.min_base_quality, options.min_mapping_quality, True), options).persist()
    missing = methylation.unresolved(counted, options).first()
    n = _write_meth(methylation.called_sites(counted, options), contigs, output, fmt, compress)
    return {"sites": n, "unresolved_sites": missing.sites, "unresolved_observations": missing.observations}


def call_snp(spark: SparkSession, input: str, reference: str, output: str, options: snp.SnpOptions = snp.SnpOptions(), regions=(), regions_file: str | None = None, compress: bool = False, ignore_orphans: bool = False) -> dict:
    distinct_paths(input, reference, output)
    obs, contigs, head = observations(spark, input, reference, regions, regions_file, ignore_orphans)
    one = snp.usable(collapse_overlaps(obs, options.min_base_quality, options.min_mapping_quality, False), options).persist()
    return {"variants": _write_vcf(snp.call(one, options), contigs, output, options, _sample(head, input, options.sample_name), compress)}


def call_joint(spark: SparkSession, input: str, reference: str, meth_output: str, vcf_output: str, fmt: str = "bedmethyl", meth: methylation.MethylationOptions = methylation.MethylationOptions(), variants: snp.SnpOptions = snp.SnpOptions(), regions=(), regions_file: str | None = None, compress: bool = False) -> dict:
    distinct_paths(input, reference, meth_output, vcf_output)
    obs, contigs, head = observations(spark, input, reference, regions, regions_file, meth.ignore_orphans)
    both = joint.call(obs, meth, variants)
    return {"sites": _write_meth(both.sites, contigs, meth_output, fmt, compress), "variants": _write_vcf(both.variants, contigs, vcf_output, variants, _sample(head, input, variants.sample_name), compress)}


def combine(spark: SparkSession, inputs: list[tuple[str, str]], output: str, kind: str = "level", options: combining.CombineOptions = combining.CombineOptions(), compress: bool = False) -> dict:
    """Matrices of (sample, path) inputs; inputs must be in one order of contigs and strictly sorted."""
    targets = dict(zip(("level", "count"), matrix_paths(output))) if kind == "both" else {kind: output}
    distinct_paths(*[p for _, p in inputs], *targets.values())
    names = [s for s, _ in inputs]
    if len(set(names)) != len(names):
        raise ConfigurationError("sample names must be distinct")
    rows = sites.read_samples(spark, inputs).persist()
    for check, what in ((combining.unordered(rows), "rows are not strictly sorted"), (combining.split_contigs(rows), "a contig comes in several blocks"), (combining.mixed_modifications(rows), "samples name a site's modification differently")):
        bad = check.head(1)
        if bad:
            raise InputError(f"{what}: {bad[0].asDict()}")
    order = combining.contig_order(rows)
    ranks = spark.createDataFrame([(c, i) for i, c in enumerate(order)], "contig string, _o int")
    staged = []
    for one, target in targets.items():
        table = combining.matrix(rows, names, one, options)
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(".")) for c in table.columns]
        head = [f"##matrix={one}", f"##min_count={options.min_count}", f"##min_prop={options.min_prop_ppb / 1e9:.9f}", f"##samples={len(names)}", "#" + "\t".join(["chrom", *table.columns[1:]])]
        lines = table.join(ranks, "contig").select("_o", "start", "end", "strand", F.concat_ws("\t", *cells).alias("row"))
        write_text(lines, target + ".new", ["_o", "start", "end", "strand"], head, compress)
        staged.append((target + ".new", target))
    publish(staged)
    report = combining.report(rows, len(names), options).first()
    return report.asDict()


def index(spark: SparkSession, reference: str, output: str) -> dict:
    """The seed index as Parquet with a manifest; range-partitioned by k-mer so lookups prune."""
    contigs = fasta.read(spark, reference)
    fasta.catalogue_errors(contigs)
    table = al.seed_index(contigs)
    table.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{output}/seeds")
    contigs.write.mode("overwrite").parquet(f"{output}/contigs")
    manifest = {"version": VERSION, "k": al.SEED, "reference_sha256": fasta.digest(contigs)}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{output}/manifest")
    return manifest


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contigs, seeds) of an index whose manifest agrees with its contigs."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    contigs = spark.read.parquet(f"{path}/contigs")
    if fasta.digest(contigs) != manifest["reference_sha256"]:
        raise InputError("the index does not belong to its contigs")
    return contigs, spark.read.parquet(f"{path}/seeds")


def sam_header(contigs: DataFrame) -> list[str]:
    rows = contigs.select("contig", "length", "md5", "ordinal").orderBy("ordinal").toLocalIterator()
    return ["@HD\tVN:1.6\tSO:unsorted", *[f"@SQ\tSN:{r.contig}\tLN:{r.length}\tM5:{r.md5}" for r in rows], f"@PG\tID:cytoloom\tPN:cytoloom\tVN:{VERSION}"]


def _described(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Records with cigar, nm, md, xm from (contig, start, end, top, distance, seq in forward orientation as
    ``forward``, and ``tail``, the read's last bases that are clipped). Reads meet pieces of the reference."""
    mapped = rows.where("contig is not null").withColumn("_kept", F.length("forward") - F.col("tail"))
    longest = mapped.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    texts = contigs.select("contig", F.explode(pieces(F.col("seq"), max(al.WINDOW_PIECE, longest + 4), 2, longest + 4)).alias("_p")).select("contig", F.col("_p.piece").alias("_piece"), F.col("_p.bases").alias("_ref"))
    size = max(al.WINDOW_PIECE, longest + 4)
    mapped = mapped.withColumn("_piece", F.floor(F.col("start") / size)).join(texts, ["contig", "_piece"])
    flank = F.substring("_ref", (F.col("start") - F.col("_piece") * size + 1).cast("int"), (F.col("end") - F.col("start") + 4).cast("int"))
    back = F.coalesce(F.col("rev"), F.lit(False))
    placed = F.when(back, F.right("forward", "_kept")).otherwise(F.left("forward", F.col("_kept")))
    out = mapped.withColumn("_d", described(flank, placed, F.col("top"), F.col("distance")))
    clip, dots = F.when(F.col("tail") > 0, F.concat(F.col("tail").cast("string"), F.lit("S"))).otherwise(""), F.repeat(F.lit("."), F.col("tail"))
    ends = lambda x, more: F.concat(F.when(back, more).otherwise(""), x, F.when(back, "").otherwise(more))
    return out.select(*rows.columns, ends(F.col("_d.cigar"), clip).alias("cigar"), "_d.nm", "_d.md", ends(F.col("_d.xm"), dots).alias("xm"))


def observed(hits: DataFrame) -> dict:
    """Counts of a run's reads, or pairs, in one pass: by status, by quality, and of what befell them."""
    one = lambda cond, name: F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("bigint")), F.lit(0)).alias(name)
    mapped = F.col("status") != "unmapped"
    of = [F.count("*").alias("total"), *[one(F.col("status") == s, s) for s in ("unique", "ambiguous", "unmapped")]]
    of += [one(mapped & (F.col("mapq") >= q), f"mapq_{q}") for q in (10, 20, 30, 40)]
    distances = [F.col(c) for c in ("distance", "distance1", "distance2") if c in hits.columns]
    of += [one(mapped & (sum(distances[1:], distances[0]) == 0), "without_edits")]
    for name, column, cond in (("clipped", "retained", lambda c: c.isNotNull()), ("incomplete", "complete", lambda c: ~c), ("rescued", "rescued", lambda c: c)):
        if column in hits.columns:
            of.append(one(mapped & cond(F.col(column)), name))
    return hits.agg(*of).first().asDict()


def align(spark: SparkSession, reference: str, reads1: str, reads2: str | None, output: str, max_edits: int = al.MAX_EDITS, non_directional: bool = False, span: tuple[int, int] = (0, 1000), mapped_only: bool = False, seed: int = 0, metrics: str | None = None, adapter: str | None = single.ADAPTER, index_path: str | None = None, sensitive: bool = False) -> dict:
    """Reads, or pairs, to SAM (BAM if ``output`` ends so) in the order of the input.

    Single reads that run into ``adapter`` (None: none) are mapped again without it, and its bases clipped;
    ``index_path`` names an index of the same reference, which is else made for the run; ``sensitive``
    searches until no placement within the edits can be missing, where hits are not too many.
    """
    if not 0 <= max_edits <= al.MAX_EDITS:
        raise ConfigurationError(f"the edit budget is 0 to {al.MAX_EDITS}")
    if not 0 <= span[0] <= span[1]:
        raise ConfigurationError("the least span must not exceed the greatest")
    if adapter is not None and not (adapter and set(adapter) <= set("ACGT")):
        raise ConfigurationError("an adapter is a text of A, C, G and T")
    distinct_paths(reference, reads1, reads2 or "", output)
    contigs = fasta.read(spark, reference).persist()
    seeds = None
    if index_path is not None:
        indexed, seeds = load_index(spark, index_path)
        if fasta.digest(indexed) != fasta.digest(contigs):
            raise InputError("the index is of another reference")
    first = fastq.read(spark, reads1, alignable=True)
    top = F.col("strand").isin("OT", "CTOT")
    tags = lambda xr: [F.concat(F.lit("NM:i:"), F.col("nm").cast("string")), F.concat(F.lit("MD:Z:"), F.col("md")), F.concat(F.lit("XG:Z:"), F.when(F.col("top"), "CT").otherwise("GA")), F.concat(F.lit("XR:Z:"), xr), F.concat(F.lit("XM:Z:"), F.col("xm"))]
    if reads2 is None:
        reads = first.select(F.col("ordinal").alias("read_id"), "seq")
        options = dict(non_directional=non_directional, seed=seed, index=seeds, sensitive=sensitive)
        hits = single.map_reads(reads, contigs, max_edits, **options)
        if adapter is None:
            hits = hits.withColumn("retained", F.lit(None).cast("int"))
        else:
            hits = single.with_adapter(cut(hits), reads, contigs, max_edits, adapter, **options)
        hits = cut(hits)
        rows = first.join(hits.withColumnRenamed("read_id", "ordinal"), "ordinal").withColumn("top", top).withColumn("rev", F.col("reverse"))
        rows = rows.withColumn("tail", F.coalesce(F.length("seq") - F.col("retained"), F.lit(0)).cast("int"))
        back = F.coalesce(F.col("reverse"), F.lit(False))
        rows = rows.withColumn("forward", F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).withColumn("fqual", F.when(back, F.reverse("qual")).otherwise(F.col("qual")))
        done = _described(rows, contigs)
        xr = F.when(F.col("strand").isin("OT", "OB"), "CT").otherwise("GA")
        flag = F.when(F.col("reverse"), 16).otherwise(0)
        mapped = done.select("ordinal", F.lit(0).alias("k"), F.concat_ws("\t", "name", flag.cast("string"), "contig", (F.col("start") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "forward", "fqual", *tags(xr)).alias("row"))
        lost = rows.where("contig is null").select("ordinal", F.lit(0).alias("k"), F.concat_ws("\t", "name", F.lit("4\t*\t0\t0\t*\t*\t0\t0"), "seq", "qual").alias("row"))
        summary = hits
    else:
        pairs = fastq.pair(first, fastq.read(spark, reads2, alignable=True)).withColumnRenamed("ordinal", "pair_id")
        hits = paired.map_pairs(pairs.select("pair_id", "seq1", "seq2"), contigs, max_edits, span, non_directional, seed, seeds, sensitive)
        hits = cut(hits)
        rows = pairs.join(hits, "pair_id").withColumn("top", top)
        mate = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"seq{k}").alias("seq"), F.col(f"qual{k}").alias("qual"), F.col(f"start{k}").alias("start"), F.col(f"end{k}").alias("end"), F.col(f"distance{k}").alias("distance"), F.col(f"start{3 - k}").alias("mstart"), F.col(f"end{3 - k}").alias("mend"), (F.col("reverse") if k == 1 else ~F.col("reverse")).alias("rev")) for k in (1, 2)]))
        each = rows.select("pair_id", "shared_name", "status", "mapq", "contig", "strand", "swapped", "top", mate.alias("m")).select("*", "m.*", F.lit(0).alias("tail")).drop("m")
        back = F.coalesce("rev", F.lit(False))
        each = each.withColumn("forward", F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).withColumn("fqual", F.when(back, F.reverse("qual")).otherwise(F.col("qual")))
        done = _described(each, contigs)
        flag = al.sam_flag(F.lit(True), F.lit(True), F.col("rev"), F.col("k") == 1, ~F.col("rev"))
        size = al.template_length(F.col("start"), F.col("end"), F.col("mstart"), F.col("mend"), F.col("k") == 1)
        xr = F.when((F.col("k") == 1) != F.col("swapped"), "CT").otherwise("GA")
        mapped = done.select(F.col("pair_id").alias("ordinal"), "k", F.concat_ws("\t", "shared_name", flag.cast("string"), "contig", (F.col("start") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("="), (F.col("mstart") + 1).cast("string"), size.cast("string"), "forward", "fqual", *tags(xr)).alias("row"))
        lost = each.where("contig is null").select(F.col("pair_id").alias("ordinal"), "k", F.concat_ws("\t", "shared_name", F.when(F.col("k") == 1, "77").otherwise("141"), F.lit("*\t0\t0\t*\t*\t0\t0"), "seq", "qual").alias("row"))
        summary = hits
    write = write_bam if output.endswith(".bam") else write_text
    write(mapped if mapped_only else mapped.unionByName(lost), output, ["ordinal", "k"], sam_header(contigs))
    report = {"schema": f"align-{'single' if reads2 is None else 'paired'}-1", **observed(summary), "seed": seed}
    if metrics:
        with open(metrics, "w") as f:
            f.write("\t".join(report) + "\n" + "\t".join(map(str, report.values())) + "\n")
    return report


def info(spark: SparkSession) -> dict:
    return {"version": VERSION, "spark": spark.version, "parallelism": spark.sparkContext.defaultParallelism, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}


__all__ = ["align", "call_joint", "call_meth", "call_snp", "combine", "index", "info", "load_index"]
