"""From alignments to observations: exclusion, CIGAR columns, mates, overlap collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import observation_error

#: Unmapped, secondary, failed, duplicate, supplementary.
EXCLUDED_FLAGS = 0x4 | 0x100 | 0x200 | 0x400 | 0x800


def kept_records(alignments: DataFrame, ignore_orphans: bool = False) -> DataFrame:
    """Records that may give evidence. Plain predicates on scan columns, so they are pushed down."""
    out = alignments.where(F.col("flag").bitwiseAND(EXCLUDED_FLAGS) == 0)
    if ignore_orphans:
        out = out.where((F.col("flag").bitwiseAND(1) == 0) | (F.col("flag").bitwiseAND(2) != 0))
    return out


def segment(flag: Column) -> Column:
    """0 for an unpaired read, else 1 or 2; a flag that contradicts itself is an error."""
    paired, first, second = (flag.bitwiseAND(x) != 0 for x in (0x1, 0x40, 0x80))
    bad = (paired & (first == second)) | (~paired & (first | second))
    return F.when(bad, F.raise_error(F.lit("a read's pairing flags contradict each other"))).when(~paired, 0).when(first, 1).otherwise(2).cast("int")


def cytosine_strand(xg: Column) -> Column:
    """T for CT, B for GA; anything else, or none, is an error."""
    return F.when(xg == "CT", "T").when(xg == "GA", "B").otherwise(F.raise_error(F.concat(F.lit("XG is neither CT nor GA: "), F.coalesce(xg, F.lit("missing")))))


def cigar_runs(cigar: Column) -> Column:
    """array<struct<len:int,op:string>> of a CIGAR text."""
    parts = F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("len"), F.substring(p, -1, 1).alias("op")))


def canonical_cigar(runs: Column) -> Column:
    """Runs without empty ones and with equal neighbours merged."""
    empty = F.array().cast("array<struct<len:int,op:string>>")

    def add(acc, r):
        last = F.element_at(acc, -1)
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last["len"] + r["len"]).cast("int").alias("len"), last["op"].alias("op"))))
        return F.when(r["len"] == 0, acc).when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == r["op"]), merged).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(runs, empty, add)


def cigar_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(r["len"].cast("string"), r["op"])), "")


def _consumed(runs: Column, ops: str) -> Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda acc, r: acc + F.when(F.instr(F.lit(ops), r["op"]) > 0, r["len"]).otherwise(0))


def reference_span(runs: Column) -> Column:
    return _consumed(runs, "MDN=X")


def query_span(runs: Column) -> Column:
    return _consumed(runs, "MIS=X")


def alignment_columns(records: DataFrame) -> DataFrame:
    """A row for each reference base a read covers: its columns, ``position``, ``query_base`` (null in a
    deletion) and ``base_quality`` (null where absent or in a deletion). ``pos`` is 0-based.

    Offsets of the runs come from one fold over the CIGAR; there is no shuffle.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("q"), F.array().cast("array<struct<op:string,r:bigint,q:bigint,len:int>>").alias("out"))
    takes = lambda op, ops: F.instr(F.lit(ops), op) > 0

    def step(acc, run):
        n, op = run["len"], run["op"]
        bad = F.when(op == "N", F.raise_error(F.lit("a CIGAR skips reference bases")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return F.struct(
            (acc["r"] + F.when(takes(op, "MD=X"), n).otherwise(0) + bad).alias("r"),
            (acc["q"] + F.when(takes(op, "MIS=X"), n).otherwise(0)).alias("q"),
            F.when(takes(op, "MD=X") & (n > 0), F.concat(acc["out"], F.array(F.struct(op.alias("op"), acc["r"].alias("r"), acc["q"].alias("q"), n.alias("len"))))).otherwise(acc["out"]).alias("out"),
        )

    runs = F.aggregate(cigar_runs(F.col("cigar")), start, step)["out"]
    cols = [c for c in records.columns if c not in ("cigar", "seq", "qual")]
    runs_of = records.select(*cols, "seq", "qual", F.explode(runs).alias("run"))
    at = runs_of.select(*cols, "seq", "qual", "run", F.explode(F.sequence(F.lit(0), F.col("run.len") - 1)).alias("i"))
    present = F.col("run.op") != "D"
    q = (F.col("run.q") + F.col("i") + 1).cast("int")
    quality = F.ascii(F.substring(F.col("qual"), q, 1)) - 33
    return at.select(*cols, (F.col("pos") + F.col("run.r") + F.col("i")).alias("position"), F.when(present, F.upper(F.substring(F.col("seq"), q, 1))).alias("query_base"), F.when(present & (F.col("qual") != "*"), quality).cast("int").alias("base_quality"))


#: Bases a piece of the reference that reads are joined with.
PIECE = 1 << 14


def pieces(text: Column, size: int, before: int, after: int) -> Column:
    """array<struct<piece,bases>>: a text cut every ``size`` letters, each piece with some of its neighbours'
    letters, and dots where it has none. One pass over the text: taking each piece by its place would
    walk a chromosome from its start every time."""
    cut = F.regexp_extract_all(text, F.lit(f".{{1,{size}}}"), F.lit(0))

    def one(parts, x, i):
        left = F.lpad(F.right(F.coalesce(F.get(parts, i - 1), F.lit("")), F.lit(before)), before, ".") if before else F.lit("")
        right = F.rpad(F.left(F.coalesce(F.get(parts, i + 1), F.lit("")), F.lit(after)), after, ".") if after else F.lit("")
        return F.struct(i.cast("bigint").alias("piece"), F.concat(left, x, right).alias("bases"))

    # the outer transform binds the parts once
    return F.transform(F.array(cut), lambda parts: F.transform(parts, lambda x, i: one(parts, x, i)))[0]


def with_reference(records: DataFrame, contigs: DataFrame, piece: int = PIECE) -> DataFrame:
    """``records`` with ``window``, the reference bases they cover and two more on each side, and
    ``window_start``; a record that crosses a border of pieces gives a row for each, with ``piece``.

    The join is on contig and piece, and only the read's own window stays, so no row carries a contig.
    """
    parts = contigs.select(F.col("contig").alias("rname"), F.explode(pieces(F.col("seq"), piece, 2, 2)).alias("_p")).select("rname", "_p.piece", F.col("_p.bases").alias("_f"))
    end = F.col("pos") + reference_span(cigar_runs(F.col("cigar")))
    number = lambda x: F.floor(x / piece)
    rows = records.withColumn("_end", end).withColumn("piece", F.explode(F.sequence(number(F.col("pos")), F.greatest(number(F.col("_end") - 1), number(F.col("pos"))))))
    start, stop = F.greatest(F.col("pos"), F.col("piece") * piece), F.least(F.col("_end"), (F.col("piece") + 1) * piece)
    rows = rows.join(parts, ["rname", "piece"])
    window = F.substring("_f", (start - F.col("piece") * piece + 1).cast("int"), (stop - start + 4).cast("int"))
    return rows.withColumn("window_start", start).withColumn("window", window).withColumn("window_end", stop).drop("_f", "_end")


def fragments(records: DataFrame) -> DataFrame:
    """``records`` with ``fragment_id``, equal for two mates that overlap on the reference and else the
    read's own.

    Mates agree on name, read group and contig, and each lies where the other says its mate lies; the
    first in order must reach the second's start. Two reads of one segment in a pair are an error, and so
    are mates with overlap that name two strands. ``records`` needs rname, pos, rnext, pnext (0-based), qname, flag, cigar, rg.
    """
    two_strands = F.lit(False)
    r = records.withColumn("segment", segment(F.col("flag"))).withColumn("ref_end", F.col("pos") + reference_span(cigar_runs(F.col("cigar"))))
    mate_known = (F.col("segment") > 0) & (F.col("flag").bitwiseAND(0x8) == 0) & ((F.col("rnext") == "=") | (F.col("rnext") == F.col("rname")))
    key = F.when(mate_known, F.concat_ws("\t", F.col("qname"), F.coalesce("rg", F.lit("\u0001")), F.col("rname"), F.least("pos", "pnext").cast("string"), F.greatest("pos", "pnext").cast("string")))
    own = F.concat_ws("\t", F.col("qname"), F.col("segment").cast("string"), F.col("rname"), F.col("pos").cast("string"), F.col("flag").cast("string"))
    r = r.withColumn("_pair", F.coalesce(key, own))
    w = Window.partitionBy("_pair")
    seen = F.collect_set("segment").over(w)
    n = F.count("*").over(w)
    reaches = F.max(F.when(F.col("pos") == F.least("pos", "pnext"), F.col("ref_end"))).over(w) > F.greatest("pos", "pnext")
    clash = mate_known & (n > 1) & (F.size(seen) < n)
    together = mate_known & (n == 2) & reaches
    if "strand" in records.columns:
        two_strands = together & (F.min("strand").over(w) != F.max("strand").over(w))
    return r.withColumn("fragment_id", F.when(clash, F.raise_error(F.lit("two mates are the same segment"))).when(two_strands, F.raise_error(F.concat(F.lit("a fragment's mates name both strands: "), F.col("qname")))).when(together, F.col("_pair")).otherwise(F.concat_ws("\t", F.col("_pair"), F.lit("segment"), F.col("segment").cast("string")))).drop("_pair", "ref_end")


def passes(min_base_quality: int, min_mapping_quality: int, deletions: bool) -> Column:
    """Whether an observation may be counted; deletions pass in methylation and joint mode only."""
    mapped = (F.col("mapping_quality") != 255) & (F.col("mapping_quality") >= min_mapping_quality)
    base = F.coalesce(F.col("base_quality") >= min_base_quality, F.lit(False))
    return mapped & F.when(F.col("query_base").isNull(), F.lit(deletions)).otherwise(base)


def collapse_overlaps(observations: DataFrame, min_base_quality: int = 20, min_mapping_quality: int = 20, deletions: bool = True, key: tuple[str, ...] = ("fragment_id", "contig", "position"), extra_order: tuple[Column, ...] = ()) -> DataFrame:
    """One observation a fragment and position, by a total preference: passes the filter, canonical
    base, base present, quality present, lower error (a missing one loses), first segment.

    Collapse comes before filtering. ``extra_order`` breaks ties that this leaves. One shuffle on the key; the window keeps one row a group.
    """
    known = F.col("query_base").isin("A", "C", "G", "T")
    mapping_only = F.pow(F.lit(10.0), -F.least(F.col("mapping_quality"), F.lit(60)) / F.lit(10.0))
    error = F.when(F.col("mapping_quality") == 255, F.lit(None)).when(F.col("base_quality").isNull(), F.least(F.lit(0.75), mapping_only)).otherwise(observation_error(F.col("base_quality"), F.col("mapping_quality")))
    order = [passes(min_base_quality, min_mapping_quality, deletions).desc(), F.coalesce(known, F.lit(False)).desc(), F.col("query_base").isNotNull().desc(), F.col("base_quality").isNotNull().desc(), error.asc_nulls_last(), F.col("segment").asc(), *extra_order]
    w = Window.partitionBy(*key).orderBy(*order)
    return observations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
