"""Single-end mapping as staged joins.

Seeds of one length at regular offsets of a read meet the genome's k-mers, of which those too common are
left out; their places are verified with gaps, first within three edits and, for reads still without a
placement, within the budget. A read's seeds lie so close that every placement within the budget has one
free of edits, if the read is long enough; the frontier is called complete only where that holds and no
seed was too common. The sensitive search adds the blocks of which one must be free of edits in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mapq
from ..functions.chem import converted, reverse_complement
from ..functions.kernels import affine_udf, flexible_udf
from ..session import cut
from . import alignment as al

COMPLEMENTARY = {"OT": "CTOT", "OB": "CTOB"}
#: Most bases between the beginnings of a read's seeds.
STRIDE = 12
#: Hits that a read's blocks may have together, in the sensitive search.
BLOCK_HITS = 4096


def unbroken(length: Column, edits) -> Column:
    """Bases that some run between ``edits`` edits has at least."""
    edits = F.lit(edits) if isinstance(edits, int) else edits
    return F.call_function("div", (length - edits).cast("bigint"), (edits + 1).cast("bigint")).cast("int")


def stride(length: Column, edits: int) -> Column:
    """The widest step between seeds with which none of the runs between edits is missed, or one base."""
    return F.greatest(F.lit(1), F.least(F.lit(STRIDE), unbroken(length, edits) - al.SEED + 1))


def seeds(reads: DataFrame, edits: int) -> DataFrame:
    """(read_id, offset, kmer) of ``reads`` (read_id, seq), projected."""
    n = F.length("text")
    rows = reads.select("read_id", converted(F.col("seq"), "C>T").alias("text"))
    rows = rows.select("read_id", "text", F.explode(F.sequence(F.lit(0), n - al.SEED, stride(n, edits))).alias("offset"))
    return rows.select("read_id", "offset", F.substring("text", F.col("offset") + 1, F.lit(al.SEED)).alias("kmer")).where(~F.col("kmer").contains("N"))


def block_seeds(reads: DataFrame, edits: int) -> DataFrame:
    """(read_id, block, offset, kmer, k) of ``reads`` (read_id, seq): proof blocks, projected."""
    b = reads.select("read_id", F.explode(al.proof_blocks(F.col("seq"), edits)).alias("b"))
    return b.select("read_id", F.col("b.block").alias("block"), F.col("b.start").alias("offset"), converted(F.col("b.bases"), "C>T").alias("kmer"), F.length("b.bases").alias("k"))


def _block_hits(reads: DataFrame, contigs: DataFrame, edits: int) -> DataFrame:
    """(read_id, contig, strand, start, seed) of the rarest blocks whose hits together stay in bounds; a row
    without a contig stands for blocks left out."""
    blocks = block_seeds(reads, edits)
    # the lengths of blocks follow from the lengths of reads: a handful
    sizes = sorted(r.k for r in blocks.select("k").distinct().collect())
    texts, places = al.genome_text(contigs), None
    for k in sizes:
        one = al.kmers(texts, k).withColumn("k", F.lit(k))
        places = one if places is None else places.unionByName(one)
    if places is None:
        return reads.sparkSession.createDataFrame([], "read_id bigint, contig string, strand string, start bigint, seed int")
    # k-mers over the bound by themselves are dropped before the join, so no key is long on either side
    counts = places.groupBy("k", "kmer").agg(F.count("*").alias("hits"))
    ranked = al.affordable_blocks(blocks.join(counts, ["k", "kmer"], "left").fillna({"hits": 0}), BLOCK_HITS)
    rare = places.join(counts.where(F.col("hits") <= BLOCK_HITS).select("k", "kmer"), ["k", "kmer"], "left_semi")
    hit = ranked.where("kept and hits > 0").join(rare, ["k", "kmer"]).select("read_id", "contig", "strand", (F.col("start") - F.col("offset")).cast("bigint").alias("start"), (-1 - F.col("block")).alias("seed"))
    left = ranked.where("not kept").select("read_id", F.lit(None).cast("string").alias("contig"), F.lit(None).cast("string").alias("strand"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("int").alias("seed")).distinct()
    return hit.unionByName(left)


def candidates(reads: DataFrame, contigs: DataFrame, edits: int, index: DataFrame | None = None, sensitive: bool = False) -> DataFrame:
    """(read_id, contig, strand, start, rounds): places that seeds support, with the number of disjoint
    stretches of the read that do. A start may lie off the contig by as much as gaps can shift it.

    A row without a contig says that a seed of the read was too common to be looked up, or, in the
    sensitive search, that a block was.
    """
    index = al.seed_index(contigs) if index is None else index
    kept = al.admissible(F.col("hits"), F.length("kmer"), al.MOST_HITS_SENSITIVE if sensitive else al.MOST_HITS)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    common = index.where(~kept).select("kmer").distinct().select("kmer", none("contig", "string"), none("strand", "string"), none("start", "int"))
    places = index.where(kept).select("kmer", "contig", "strand", "start").unionByName(common)
    hit = seeds(reads, edits).join(places, "kmer").select("read_id", "contig", "strand", (F.col("start") - F.col("offset")).cast("bigint").alias("start"), F.call_function("div", F.col("offset"), F.lit(al.SEED)).cast("int").alias("seed"))
    if sensitive:
        # the blocks are complete by themselves, so common seeds leave nothing open
        hit = hit.where("contig is not null").unionByName(_block_hits(reads, contigs, edits))
    return hit.groupBy("read_id", "contig", "strand", "start").agg(F.countDistinct("seed").cast("int").alias("rounds"))


def gapped(cands: DataFrame, reads: DataFrame, contigs: DataFrame, edits: int, longest: int) -> DataFrame:
    """Placements, with gaps or without: all of the least distance around each candidate."""
    n = F.length("seq")
    rows = al.windows(cands.where(F.col("start") >= -edits).join(reads.select("read_id", "seq"), "read_id"), contigs, edits, longest)
    # the window of a shorter read ends sooner
    rows = rows.withColumn("p", F.explode(flexible_udf(F.left("window", n + 2 * edits), F.col("seq"), F.lit(edits))))
    lo = F.col("start") - edits
    out = rows.select("read_id", "contig", "strand", (lo + F.col("p.start")).alias("start"), (lo + F.col("p.end")).alias("end"), F.col("p.distance").alias("distance"), "rounds")
    return out.groupBy("read_id", "contig", "strand", "start", "end").agg(F.min("distance").alias("distance"), F.max("rounds").alias("rounds"))


def placements(reads: DataFrame, contigs: DataFrame, edits: int = al.MAX_EDITS, index: DataFrame | None = None, sensitive: bool = False) -> DataFrame:
    """(read_id, contig, strand, start, end, distance, rounds, complete) in the coordinates of the strand's
    text; ``complete`` tells that no placement within the verified limit can be missing."""
    ready = reads.where(al.searchable(F.col("seq"), edits))
    longest = al.longest_read(ready)
    # both stages, and what ranks their result, read these again
    cands = cut(candidates(ready, contigs, edits, index, sensitive))
    places = cands.where("contig is not null")
    first = min(edits, al.FIRST_EDITS)
    found = gapped(places, ready, contigs, first, longest).withColumn("_limit", F.lit(first))
    if edits > first:
        found = cut(found)
        rest = ready.join(found.select("read_id").distinct(), "read_id", "left_anti")
        later = gapped(places.join(rest.select("read_id"), "read_id", "left_semi"), rest, contigs, edits, longest)
        found = found.unionByName(later.withColumn("_limit", F.lit(edits)))
    n = F.length("seq")
    sure = F.lit(True) if sensitive else unbroken(n, F.col("_limit")) >= al.SEED + stride(n, edits) - 1
    short = cands.where("contig is null").select("read_id", F.lit(True).alias("_short"))
    found = found.join(ready.select("read_id", "seq"), "read_id").join(short, "read_id", "left")
    return found.withColumn("complete", sure & F.col("_short").isNull()).drop("seq", "_short", "_limit")


def forward(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Placements in forward coordinates, with ``reverse`` and ``five_prime``; OB text runs backwards."""
    rows = rows.join(contigs.select("contig", F.length("seq").alias("_l")), "contig")
    back = F.col("strand") == "OB"
    start = F.when(back, F.col("_l") - F.col("end")).otherwise(F.col("start"))
    end = F.when(back, F.col("_l") - F.col("start")).otherwise(F.col("end"))
    out = rows.withColumn("_s", start).withColumn("_e", end).drop("start", "end", "_l").withColumnRenamed("_s", "start").withColumnRenamed("_e", "end")
    return out.withColumn("reverse", back).withColumn("five_prime", al.origin(F.col("strand"), F.col("start"), F.col("end")))


def map_reads(reads: DataFrame, contigs: DataFrame, edits: int = al.MAX_EDITS, non_directional: bool = False, seed: int = 0, index: DataFrame | None = None, sensitive: bool = False, affine: bool = True) -> DataFrame:
    """One row a read: status, mapping quality and, if mapped, its representative placement.

    ``reads`` has read_id and seq. The complementary pass searches the reverse complement and relabels
    its strands. Ties are settled by affine scores unless ``affine`` is off.
    """

    def one(reads: DataFrame) -> DataFrame:
        rows = placements(reads, contigs, edits, index, sensitive)
        text = F.struct("strand", "start", "end").alias("text")
        return forward(rows.select("*", text), contigs)

    found = one(reads).withColumn("pass", F.lit(0))
    if non_directional:
        turned = reads.select("read_id", reverse_complement(F.col("seq")).alias("seq"))
        other = one(turned).withColumn("pass", F.lit(1))
        other = other.withColumn("strand", F.when(F.col("strand") == "OT", "CTOT").otherwise("CTOB")).withColumn("reverse", ~F.col("reverse")).withColumn("five_prime", al.origin(F.col("strand"), F.col("start"), F.col("end")))
        found = found.unionByName(other)
    lengths = reads.select("read_id", F.length("seq").alias("read_length"))
    found = cut(found.join(lengths, "read_id").withColumn("net_gap", al.net_gap(F.col("start"), F.col("end"), F.col("read_length")).cast("int")))
    chosen = al.representative(found.drop("complete"), seed=seed)
    summary = al.selected(found)
    per = found.groupBy("read_id").agg(F.count("*").alias("located_rows"), F.countDistinct("contig", "strand", "start").alias("candidate_starts"), F.count("*").alias("placements"), F.bool_and("complete").alias("complete"))
    e = chosen.join(summary.drop("best"), "read_id").join(per, "read_id")
    e = e.withColumn("best", F.col("distance")).withColumn("distance_limit", F.when(F.col("best") <= al.FIRST_EDITS, F.lit(min(edits, al.FIRST_EDITS))).otherwise(edits))
    for name, value in (("first_hits", F.col("located_rows")), ("first_bases", F.lit(0)), ("direct_singleton", F.lit(False)), ("audited", F.col("complete"))):
        e = e.withColumn(name, value)
    e = e.withColumn("mapq", F.when(F.col("status") == "unique", mapq.single()).otherwise(0))
    e = e.select("read_id", "status", "mapq", "contig", "strand", "start", "end", "reverse", "distance", "second", "best_origins", "rounds", "complete")
    if affine:
        e = affine_reranked(cut(e), found, reads, contigs)
    return reads.select("read_id").join(e, "read_id", "left").withColumn("status", F.coalesce("status", F.lit("unmapped"))).withColumn("mapq", F.coalesce("mapq", F.lit(0)))


def affine_reranked(mapped: DataFrame, found: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Ambiguous reads with 2 to 15 tied origins, settled where one origin's affine score leads by enough.

    ``found`` has the reads' placements in forward coordinates, with the same in the coordinates of the
    ``text`` that was searched and the number of the ``pass``. A settled read becomes unique with the
    quality of an affine decision and takes that origin's best placement.
    """
    tied = mapped.where((F.col("status") == "ambiguous") & F.col("best_origins").between(2, mapq.AFFINE_ORIGINS) & F.col("complete")).select("read_id", F.col("distance").alias("_d"))
    if tied.isEmpty():
        return mapped
    rows = found.join(tied, "read_id").where(F.col("distance") == F.col("_d")).join(reads.select("read_id", "seq"), "read_id")
    place = F.struct("contig", "strand", "start", "end", "reverse")
    query = F.when(F.col("pass") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    rows = rows.select("read_id", "contig", F.col("text.strand").alias("strand"), F.col("text.start").alias("start"), F.col("text.end").alias("end"), query.alias("seq"), place.alias("_p"), F.struct("contig", "strand", "five_prime").alias("_o"))
    near = al.windows(rows, contigs, 0, al.longest_read(reads) + al.MAX_EDITS)
    scored = near.withColumn("score", affine_udf(F.left("window", (F.col("end") - F.col("start")).cast("int")), F.col("seq"), F.lit(False)))
    # the gaps of one origin may fall in several ways; its best stands for it
    best = Window.partitionBy("read_id", "_o").orderBy(F.desc("score"), "_p")
    own = scored.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    per = own.groupBy("read_id").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, 2).alias("two"), F.max_by("_p", "score").alias("_p"))
    first, second = F.try_element_at("two", F.lit(1)), F.try_element_at("two", F.lit(2))
    sure = per.where(mapq.affine_unique(F.lit(True), first, second).isNotNull()).select("read_id", *[F.col(f"_p.{c}").alias(f"_{c}") for c in ("contig", "strand", "start", "end", "reverse")])
    out = mapped.join(sure, "read_id", "left")
    won = F.col("_contig").isNotNull()
    pick = {c: F.when(won, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("contig", "strand", "start", "end", "reverse")}
    pick |= {"status": F.when(won, "unique").otherwise(F.col("status")), "mapq": F.when(won, mapq.AFFINE_MAPQ).otherwise(F.col("mapq"))}
    return out.withColumns(pick).select(*mapped.columns)


#: Bases a trimmed read must keep, and those a second, shorter search leaves out.
RETAINED, STABILITY = 50, 8
# Fixed value: the adapter looked for by default.
ADAPTER = "AGATCGGAAGAGC"


def with_adapter(mapped: DataFrame, reads: DataFrame, contigs: DataFrame, edits: int = al.MAX_EDITS, adapter: str = ADAPTER, **mapping) -> DataFrame:
    """Results after another look at reads that end in an adapter.

    The trimmed read is mapped again, and once more without its last bases; both must be unique at one
    origin. A read that was mapped keeps its status and quality and only takes the trimmed end, if the
    origin agrees; one that was not is adopted with a capped quality. Adds ``retained``, the number of bases
    that were placed, if not all. ``mapping`` are further options of ``map_reads``.
    """
    cut = reads.withColumn("_at", al.adapter_start(F.col("seq"), adapter)).where(F.col("_at") >= RETAINED)
    trimmed = cut.select("read_id", F.substring("seq", F.lit(1), F.col("_at")).alias("seq"))
    shorter = cut.where(F.col("_at") >= RETAINED + STABILITY).select("read_id", F.substring("seq", F.lit(1), F.col("_at") - STABILITY).alias("seq"))
    names = ("status", "mapq", "contig", "strand", "start", "end", "reverse", "distance")
    one = map_reads(trimmed, contigs, edits, **mapping).select("read_id", *[F.col(c).alias(f"t_{c}") for c in names])
    two = map_reads(shorter, contigs, edits, **mapping).select("read_id", *[F.col(c).alias(f"s_{c}") for c in names])
    both = one.join(two, "read_id", "left").join(cut.select("read_id", "_at"), "read_id")
    five = lambda p: al.origin(F.col(f"{p}strand"), F.col(f"{p}start"), F.col(f"{p}end"))
    same = lambda p, q: (F.col(f"{p}contig") == F.col(f"{q}contig")) & (F.col(f"{p}strand") == F.col(f"{q}strand")) & (five(p) == five(q))
    stable = F.coalesce((F.col("t_status") == "unique") & (F.col("s_status") == "unique") & same("t_", "s_"), F.lit(False))
    both = both.withColumn("_ok", stable)
    out = mapped.join(both, "read_id", "left")
    adopt = F.coalesce((F.col("status") == "unmapped") & (F.col("t_status") != "unmapped"), F.lit(False))
    shorten = F.coalesce((F.col("status") != "unmapped") & F.col("_ok") & same("", "t_"), F.lit(False))
    pick = {c: F.when(adopt | shorten, F.col(f"t_{c}")).otherwise(F.col(c)) for c in ("contig", "strand", "start", "end", "reverse", "distance")}
    pick["status"] = F.when(adopt, F.when(F.col("_ok"), "unique").otherwise("ambiguous")).otherwise(F.col("status"))
    pick["mapq"] = F.when(adopt, mapq.adapter_consensus(F.col("_ok"), F.col("t_mapq"), F.col("s_mapq"))).otherwise(F.col("mapq"))
    return out.withColumns(pick).withColumn("retained", F.when(adopt | shorten, F.col("_at"))).select(*mapped.columns, "retained")
