"""Paired-end mapping: both mates' placements, met in a band join and ranked together.

The second mate is sequenced from the complement, so its reverse complement is searched in the same
texts as the first mate; a fragment then has both mates on one text, the first at or before the second.
Pairs are mapped whole or not at all. Of a pair that does not meet, a mate with one sure place lends the other a
window to be looked for in, by shorter blocks than a search of the whole genome allows (*rescue*).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mapq
from ..functions.chem import converted, reverse_complement
from ..session import cut
from . import alignment as al
from .single import gapped, placements


def pairings(first: DataFrame, second: DataFrame, span: tuple[int, int]) -> DataFrame:
    """All compatible pairs of placements of one fragment on one text; an equi-join on pair, contig and
    strand with the span as residual."""
    side = lambda d, n: d.select(F.col("read_id").alias("pair_id"), "contig", "strand", *[F.col(c).alias(f"{c}{n}") for c in ("start", "end", "distance", "rounds")])
    rows = side(first, 1).join(side(second, 2), ["pair_id", "contig", "strand"])
    inward = (F.col("start1") <= F.col("start2")) & (F.col("end1") <= F.col("end2"))
    size = F.col("end2") - F.col("start1")
    return rows.where(inward & size.between(*span)).withColumn("span", size).withColumn("total", F.col("distance1") + F.col("distance2")).withColumn("score", mapq.edit_score(F.col("total")))


#: Edits of a mate that lends a window, and blocks, less one, by which the other is looked for in it.
ANCHOR_EDITS, RESCUE_EDITS = 1, 3


def anchors(found: DataFrame) -> DataFrame:
    """The placements of reads whose best place is the only one so good and within ANCHOR_EDITS edits."""
    best = found.groupBy("read_id").agg(F.min("distance").alias("_d")).where(F.col("_d") <= ANCHOR_EDITS)
    rows = found.join(best, "read_id").where(F.col("distance") == F.col("_d")).drop("_d")
    one = rows.groupBy("read_id").agg(F.countDistinct("contig", "strand", "start").alias("_k")).where("_k = 1").select("read_id")
    return rows.join(one, "read_id", "left_semi")


def rescued(sure: DataFrame, mates: DataFrame, contigs: DataFrame, edits: int, most_span: int, behind: bool) -> DataFrame:
    """Placements of ``mates`` (read_id, seq) in the windows that the placements ``sure`` of the other mates
    lend: up to ``most_span`` bases from their start, or, ``behind`` them, up to their end."""
    longest = max(al.longest_read(mates), 1)
    lo = F.col("end") - most_span if behind else F.col("start")
    rows = sure.select("read_id", "contig", "strand", lo.alias("start")).distinct().join(mates.select("read_id", "seq"), "read_id")
    rows = al.windows(rows, contigs, edits, most_span).withColumn("text", converted(F.col("window"), "C>T"))
    blocks = al.proof_blocks(converted(F.col("seq"), "C>T"), RESCUE_EDITS)
    at = lambda text, b: F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - F.length(b["bases"]), F.lit(0))), lambda i: F.substring(text, i + 1, F.length(b["bases"])) == b["bases"])
    hits = F.flatten(F.transform(blocks, lambda b: F.transform(at(F.col("text"), b), lambda i: F.struct(b["block"].alias("block"), (i - b["start"]).alias("shift")))))
    hit = rows.select("read_id", "contig", "strand", "start", F.explode(hits).alias("h"))
    cands = hit.groupBy("read_id", "contig", "strand", (F.col("start") - edits + F.col("h.shift")).cast("bigint").alias("start")).agg(F.countDistinct("h.block").cast("int").alias("rounds"))
    return gapped(cands, mates, contigs, edits, longest)


def map_pairs(pairs: DataFrame, contigs: DataFrame, edits: int = al.MAX_EDITS, span: tuple[int, int] = (0, 1000), non_directional: bool = False, seed: int = 0, index: DataFrame | None = None, sensitive: bool = False, rescue: bool = True) -> DataFrame:
    """One row a pair (pair_id, seq1, seq2): status, quality, the representative, in forward coordinates.

    Columns start1 .. end2 are the first and second mate's as read; ``reverse`` tells the first mate's
    orientation. A non-directional library is mapped again with the mates' roles swapped.
    """
    one = lambda seq: pairs.select(F.col("pair_id").alias("read_id"), seq.alias("seq"))

    def directional(a: str, b: str) -> DataFrame:
        mates = [one(F.col(a)), one(reverse_complement(F.col(b)))]
        first, second = (cut(placements(m, contigs, edits, index, sensitive)) for m in mates)
        met = cut(pairings(first, second, span)).withColumn("rescued", F.lit(False))
        if not rescue:
            return met
        lost = pairs.join(met.select("pair_id").distinct(), "pair_id", "left_anti").select(F.col("pair_id").alias("read_id"))
        sure = [anchors(found.join(lost, "read_id", "left_semi")) for found in (first, second)]
        late = pairings(sure[0], rescued(sure[0], mates[1], contigs, edits, span[1], False), span)
        early = pairings(rescued(sure[1], mates[0], contigs, edits, span[1], True), sure[1], span)
        more = late.unionByName(early).drop("rounds1", "rounds2").distinct().withColumns({"rounds1": F.lit(0), "rounds2": F.lit(0)})
        return met.unionByName(more.withColumn("rescued", F.lit(True)))

    found = directional("seq1", "seq2").withColumn("swapped", F.lit(False))
    if non_directional:
        found = found.unionByName(directional("seq2", "seq1").withColumn("swapped", F.lit(True)))
    # equal outer ends and labels are one origin, however its gaps fall
    origin = F.struct("contig", "strand", "swapped", "start1", "end2")
    best = Window.partitionBy("pair_id", origin).orderBy(F.desc("score"), "end1", "start2")
    per = found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    per = cut(per)
    sums = al.score_confidence(per, "pair_id")
    ties = per.join(sums.select("pair_id", "best"), "pair_id").where("score = best").groupBy("pair_id").agg(F.count("*").alias("ties"))
    h = al.tie_hash(F.col("pair_id"), F.col("contig"), F.col("strand"), F.col("start1"), F.col("end2"), seed=seed)
    w = Window.partitionBy("pair_id").orderBy(F.desc("score"), h, "contig", "strand", "start1", "end2")
    chosen = per.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    out = chosen.join(sums, "pair_id").join(ties, "pair_id").withColumn("status", F.when(F.col("ties") == 1, "unique").otherwise("ambiguous"))
    q = mapq.pair(F.col("status") == "unique", F.lit(True), F.col("best"), F.col("second_best"), F.col("near_best"))
    none = F.lit(False)
    q = mapq.pair_final(F.col("status") == "unique", q, F.lit(None).cast("int"), F.col("rescued"), none, F.lit(0), ~none, none)
    out = out.withColumn("mapq", q).join(contigs.select("contig", F.length("seq").alias("_l")), "contig")
    back = F.col("strand") == "OB"
    turn = lambda s, e: (F.when(back, F.col("_l") - F.col(e)).otherwise(F.col(s)), F.when(back, F.col("_l") - F.col(s)).otherwise(F.col(e)))
    (s1, e1), (s2, e2) = turn("start1", "end1"), turn("start2", "end2")
    pick = lambda a, b: F.when(F.col("swapped"), b).otherwise(a)
    out = out.select("pair_id", "status", "mapq", "contig", "strand", "swapped", pick(s1, s2).alias("start1"), pick(e1, e2).alias("end1"), pick(s2, s1).alias("start2"), pick(e2, e1).alias("end2"), (back != F.col("swapped")).alias("reverse"), "span", "rescued", pick(F.col("distance1"), F.col("distance2")).alias("distance1"), pick(F.col("distance2"), F.col("distance1")).alias("distance2"), "second_best", "near_best")
    return pairs.select("pair_id").join(out, "pair_id", "left").withColumn("status", F.coalesce("status", F.lit("unmapped"))).withColumn("mapq", F.coalesce("mapq", F.lit(0)))
