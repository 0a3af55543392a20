"""Seeds, candidates, verification, pairing and selection as joins and ranked groups.

A read is searched in the three-letter text of its strand: the genome's (or its reverse complement's)
bases with C read as T. Seeds are exact k-mers, or for a budget of d edits the d + 1 disjoint blocks of
which one must be free of edits, so the candidate set is complete for that budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.chem import converted, reverse_complement
from ..functions.kernels import mismatches_udf
from .evidence import pieces

# What a seed may hit.
SEED, MOST_HITS, MOST_HITS_SENSITIVE, LEAST_BASES = 16, 1000, 4096, 16
MAX_EDITS, FIRST_EDITS = 5, 3
#: Bases a piece of reference that windows are cut from.
WINDOW_PIECE = 16_384


def genome_text(contigs: DataFrame) -> DataFrame:
    """(contig, strand, text): both searchable texts of each contig; ``contigs`` has contig and seq."""
    both = F.array(
        F.struct(F.lit("OT").alias("strand"), converted(F.col("seq"), "C>T").alias("text"), F.col("seq").alias("bases")),
        F.struct(F.lit("OB").alias("strand"), converted(reverse_complement(F.col("seq")), "C>T").alias("text"), reverse_complement(F.col("seq")).alias("bases")),
    )
    return contigs.select("contig", F.explode(both).alias("t")).select("contig", "t.*")


#: Bases a piece of text that k-mers are taken from.
PIECE = 4096


def kmers(texts: DataFrame, k: int, stride: int = 1, piece: int = PIECE) -> DataFrame:
    """All k-mers without N as (its other columns, start, kmer); narrow, no shuffle.

    Long texts are cut into pieces first, as a k-mer far into a text costs a walk to its place.
    """
    cols = [c for c in texts.columns if c not in ("text", "bases")]
    size = piece - piece % stride
    part = F.explode(pieces(F.col("text"), size, 0, k - 1)).alias("_p")
    parts = texts.select(*cols, part).select(*cols, (F.col("_p.piece") * size).alias("_at"), F.rtrim(F.col("_p.bases"), F.lit(".")).alias("_t")).where(F.length("_t") >= k)
    out = parts.select(*cols, "_at", "_t", F.explode(F.sequence(F.lit(0), F.length("_t") - k, F.lit(stride))).alias("_i"))
    out = out.select(*cols, (F.col("_at") + F.col("_i")).cast("int").alias("start"), F.substring(F.col("_t"), F.col("_i") + 1, F.lit(k)).alias("kmer"))
    return out.where(~F.col("kmer").contains("N"))


def seed_index(contigs: DataFrame, k: int = SEED) -> DataFrame:
    """(kmer, contig, strand, start, hits): the searchable index; ``hits`` is the k-mer's number of places."""
    rows = kmers(genome_text(contigs), k)
    counts = rows.groupBy("kmer").agg(F.count("*").alias("hits"))
    return rows.join(counts, "kmer")


def read_seeds(reads: DataFrame, k: int = SEED, stride: int = 4) -> DataFrame:
    """(read_id, length, offset, kmer) at fixed offsets of ``reads`` (read_id, seq)."""
    rows = reads.where(F.length("seq") >= k).select("read_id", F.length("seq").alias("length"), converted(F.col("seq"), "C>T").alias("text"))
    rows = rows.select("read_id", "length", "text", F.explode(F.sequence(F.lit(0), F.col("length") - k, F.lit(stride))).alias("offset"))
    return rows.select("read_id", "length", "offset", F.substring("text", F.col("offset") + 1, F.lit(k)).alias("kmer")).where(~F.col("kmer").contains("N"))


def proof_blocks(seq: Column, edits: int) -> Column:
    """array<struct<block,start,bases>>: edits + 1 balanced disjoint blocks, without those that hold N.

    Empty where the read is too short, or holds more N than edits.
    """
    n, parts = F.length(seq), edits + 1
    edge = lambda i: F.call_function("div", i.cast("bigint") * n.cast("bigint"), F.lit(parts).cast("bigint")).cast("int")
    block = lambda i: F.struct(i.alias("block"), edge(i).alias("start"), F.substring(seq, edge(i) + 1, edge(i + 1) - edge(i)).alias("bases"))
    unknown = F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))
    usable = (n > edits) & (unknown <= edits)
    return F.when(usable, F.filter(F.transform(F.sequence(F.lit(0), F.lit(edits)), block), lambda b: ~b["bases"].contains("N"))).otherwise(F.array().cast("array<struct<block:int,start:int,bases:string>>"))


def searchable(seq: Column, edits: int = MAX_EDITS) -> Column:
    unknown = F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))
    return (F.length(seq) >= SEED) & (unknown <= edits)


def admissible(hits: Column, bases: Column, most: int = MOST_HITS) -> Column:
    """A seed that hits once, or is long enough and not too common."""
    return (hits == 1) | ((bases >= LEAST_BASES) & (hits <= most))


def seed_hits(seeds: DataFrame, index: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """Reads' seeds met with the index on the k-mer. Common k-mers are dropped before the join, so no key
    has more than ``most`` places on the index side; skew left on the reads' side is AQE's to split."""
    rare = index.where(admissible(F.col("hits"), F.length("kmer"), most))
    return seeds.join(rare, "kmer").withColumn("start", F.col("start") - F.col("offset"))


def votes(hits: DataFrame, lengths: DataFrame, least: int = 1) -> DataFrame:
    """(read_id, contig, strand, start, support): candidates inside their contig, by distinct seeds."""
    inside = hits.join(lengths.select("contig", F.col("length").alias("_l")), "contig").where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("_l")))
    out = inside.groupBy("read_id", "contig", "strand", "start").agg(F.countDistinct("offset").alias("support"))
    return out.where(F.col("support") >= least)


def exact_search(patterns: DataFrame, contigs: DataFrame, most: int | None = None) -> DataFrame:
    """(pattern_id, contig, strand, start): every place where a pattern (pattern_id, seq) of any length stands
    in a strand's projected text; a pattern with an N stands nowhere. One with over ``most`` places is an
    error, and never cut short.

    Patterns meet the text on their first bases, up to a seed's, and the rest is compared in windows.
    """
    rows = patterns.select("pattern_id", converted(F.col("seq"), "C>T").alias("pattern")).where((F.length("pattern") > 0) & ~F.col("pattern").contains("N"))
    rows = rows.withColumn("_k", F.least(F.length("pattern"), F.lit(SEED))).withColumn("kmer", F.left("pattern", F.col("_k")))
    shape = rows.agg(F.sort_array(F.collect_set("_k")).alias("sizes"), F.max(F.length("pattern")).alias("longest")).first()
    texts, places = genome_text(contigs), None
    for k in shape["sizes"] or [SEED]:  # at most a seed's length of them
        one = kmers(texts, k).select("contig", "strand", "start", "kmer", F.lit(k).alias("_k"))
        places = one if places is None else places.unionByName(one)
    hit = windows(rows.join(places, ["_k", "kmer"]), contigs, 0, shape["longest"] or SEED)
    hit = hit.where(converted(F.left("window", F.length("pattern")), "C>T") == F.col("pattern")).select("pattern_id", "contig", "strand", F.col("start").cast("bigint").alias("start"))
    if most is None:
        return hit
    many = hit.groupBy("pattern_id").agg(F.count("*").alias("n")).where(F.col("n") > most).head(1)
    if many:
        raise InputError(f"pattern {many[0].pattern_id} has {many[0].n} places, over the limit of {most}")
    return hit


def deduplicated(candidates: DataFrame) -> DataFrame:
    """One row a place, proofs joined."""
    return candidates.groupBy("read_id", "contig", "strand", "start").agg(F.bit_or("proof_mask").alias("proof_mask"))


def placement_masks(placements: DataFrame, candidates: DataFrame, reach: int = MAX_EDITS) -> DataFrame:
    """``placements`` with the joined proofs of the candidates that start within ``reach`` of them.

    An equi-join on read, contig and strand; a read's few candidates meet its few placements.
    """
    c = candidates.select("read_id", "contig", "strand", F.col("start").alias("_s"), F.col("proof_mask").alias("_m"))
    near = F.when(F.abs(F.col("_s") - F.col("start")) <= reach, F.col("_m")).otherwise(F.lit(0))
    keys = placements.columns
    return placements.join(c, ["read_id", "contig", "strand"], "left").groupBy(*keys).agg(F.bit_or(F.coalesce(near, F.lit(0)).cast("bigint")).alias("proof_mask"))


def windows(rows: DataFrame, contigs: DataFrame, flank: int, longest: int) -> DataFrame:
    """``rows`` (contig, strand, start, and any others) with ``window``: ``longest`` bases of that strand's text
    from ``start``, and ``flank`` more on both sides; dots stand beyond the contig.

    Rows meet the piece of text that holds their start, so none carries a contig; a contig many rows
    fall on is as many keys as it has pieces.
    """
    size = max(WINDOW_PIECE, longest + flank)
    parts = genome_text(contigs).select("contig", "strand", F.explode(pieces(F.col("bases"), size, 2 * flank + 1, longest + flank)).alias("_p")).select("contig", "strand", F.col("_p.piece").alias("_piece"), F.col("_p.bases").alias("_b"))
    rows = rows.withColumn("_piece", F.floor(F.greatest(F.col("start"), F.lit(0)) / size))
    at = F.col("start") - flank - F.col("_piece") * size + 2 * flank + 1
    return rows.join(parts, ["contig", "strand", "_piece"]).withColumn("window", F.substring("_b", (at + 1).cast("int"), F.lit(longest + 2 * flank))).drop("_b", "_piece")


def longest_read(reads: DataFrame) -> int:
    return reads.agg(F.max(F.length("seq"))).first()[0] or 0


def verified(candidates: DataFrame, reads: DataFrame, contigs: DataFrame, limit: int = FIRST_EDITS) -> DataFrame:
    """Candidates within ``limit`` mismatches, with ``distance``; the cheap check without gaps."""
    rows = windows(candidates.join(reads.select("read_id", "seq"), "read_id"), contigs, 0, longest_read(reads))
    distance = mismatches_udf(F.left("window", F.length("seq")), F.col("seq"))
    return rows.withColumn("distance", distance).where(F.col("distance") <= limit).drop("seq", "window")


def block_filter(window: Column, read: Column, blocks: int = 8, shift: int = 3, least: int = 5) -> Column:
    """Whether at least ``least`` of the read's blocks stand in the projected window within ``shift``."""
    size = F.call_function("div", F.length(read).cast("bigint"), F.lit(blocks).cast("bigint")).cast("int")
    w, r = converted(window, "C>T"), converted(read, "C>T")

    def hit(i):
        piece = F.substring(r, i * size + 1, size)
        return F.exists(F.sequence(F.lit(-shift), F.lit(shift)), lambda d: (i * size + d >= 0) & (F.substring(w, F.greatest(i * size + d + 1, F.lit(1)), size) == piece))

    return F.size(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), hit)) >= least


def origin(strand: Column, start: Column, end: Column, clip5: Column | int = 0) -> Column:
    """Place of a placement's first sequenced base, clipped bases included."""
    return F.when(strand.isin("OT", "CTOB"), start - clip5).otherwise(end - 1 + clip5)


def net_gap(start: Column, end: Column, query_span: Column) -> Column:
    return F.abs((end - start) - query_span)


def band_pairs(first: DataFrame, second: DataFrame, least: int, most: int) -> DataFrame:
    """Mates on opposite strands of one fragment, inward, with a template of ``least`` to ``most`` bases.

    Inputs have pair_id, contig, strand, start, end, distance. An equi-join on pair, contig and strand
    pair; the range is a residual over the few placements of one pair.
    """
    partner = F.when(F.col("strand") == "OT", "OB").when(F.col("strand") == "OB", "OT")
    b = second.select("pair_id", "contig", partner.alias("strand"), F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("distance").alias("distance2"))
    rows = first.join(b, ["pair_id", "contig", "strand"])
    lo, hi = F.least("start", "start2"), F.greatest("end", "end2")
    inward = F.when(F.col("strand") == "OT", (F.col("start") <= F.col("start2")) & (F.col("end") <= F.col("end2"))).otherwise((F.col("start2") <= F.col("start")) & (F.col("end2") <= F.col("end")))
    near = F.col("start2").between(F.col("end") - most, F.col("start") + most)
    return rows.where(near & inward & (hi - lo).between(least, most)).withColumn("span", hi - lo).withColumn("total", F.col("distance") + F.col("distance2"))


def with_partner(left: DataFrame, right: DataFrame, most_span: int, edits: int = MAX_EDITS) -> DataFrame:
    """``left`` candidates that have a nominal partner in ``right`` (semi-join; starts within the span)."""
    partner = F.when(F.col("strand") == "OT", "OB").when(F.col("strand") == "OB", "OT")
    r = right.select("pair_id", "contig", partner.alias("strand"), F.col("start").alias("_s"), F.col("length").alias("_n")).alias("r")
    cond = F.expr(
        f"""l.pair_id = r.pair_id and l.contig = r.contig and l.strand = r.strand and abs(l.start - r._s) <= {most_span}
        and case when l.strand = 'OT' then l.start < r._s + r._n + {edits} else r._s < l.start + l.length + {edits} end"""
    )
    return left.alias("l").join(r, cond, "left_semi")


def rescue_windows(anchors: DataFrame, mate_length: int, most_span: int, edits: int = MAX_EDITS) -> DataFrame:
    """Where an anchored read's mate may lie, merged when they overlap or adjoin."""
    from .intervals import merged

    fwd = F.col("strand") == "OT"
    start = F.when(fwd, F.col("start")).otherwise(F.col("end") - most_span)
    end = F.when(fwd, F.col("start") + most_span).otherwise(F.col("end"))
    mate = F.when(fwd, "OB").otherwise("OT")
    windows = anchors.select("pair_id", "contig", mate.alias("strand"), F.greatest(start - edits, F.lit(0)).alias("start"), F.least(end + edits, F.col("contig_length")).alias("end"))
    return merged(windows.where(F.col("end") - F.col("start") >= mate_length), 1, ("pair_id", "contig", "strand"))


def selected(placements: DataFrame, key: str = "read_id") -> DataFrame:
    """Per read: best distance, runner-up of other origins, origins at the best, and the status.

    ``placements`` has the key, contig, strand, five_prime, distance. One shuffle on the key.
    """
    own = F.struct("contig", "strand", "five_prime")
    per = placements.groupBy(key, own.alias("origin")).agg(F.min("distance").alias("distance"))
    # the second-least distance over origins is the runner-up, which equals the best for a tie
    out = per.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("distance")), 1, 2).alias("two"), F.min("distance").alias("best"), F.count("*").alias("origins"))
    ties = per.join(out.select(key, "best"), key).where("distance = best").groupBy(key).agg(F.count("*").alias("best_origins"))
    out = out.join(ties, key).select(key, "best", F.try_element_at("two", F.lit(2)).alias("second"), "origins", "best_origins")
    return out.withColumn("status", F.when(F.col("best_origins") == 1, "unique").otherwise("ambiguous"))


def tie_hash(*parts: Column, seed: int = 0) -> Column:
    """Seeded hash for fair choice among equals: never of a contig's ordinal, only of names and places."""
    return F.md5(F.concat_ws("\t", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def representative(placements: DataFrame, key: str = "read_id", seed: int = 0) -> DataFrame:
    """One placement a read: least distance, then least net gap, then the seeded hash, then the names."""
    h = tie_hash(F.col(key), F.col("contig"), F.col("strand"), F.col("five_prime"), seed=seed)
    w = Window.partitionBy(key).orderBy("distance", "net_gap", h, "contig", "strand", "five_prime", "start", "end")
    return placements.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def score_confidence(scores: DataFrame, key: str, score: str = "score", delta: int = 7) -> DataFrame:
    """Best, second distinct score, and how many others come within ``delta`` of the best."""
    w = Window.partitionBy(key)
    s = scores.withColumn("best", F.max(score).over(w))
    return s.groupBy(key, "best").agg(F.max(F.when(F.col(score) < F.col("best"), F.col(score))).alias("second_best"), (F.sum((F.col("best") - F.col(score) <= delta).cast("bigint")) - 1).alias("near_best"))


def affordable_blocks(blocks: DataFrame, budget: int, key: str = "read_id") -> DataFrame:
    """Rarest blocks first while their summed hits stay in the budget; absent blocks come last."""
    w = Window.partitionBy(key).orderBy((F.col("hits") == 0).cast("int"), "hits", "block").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("running", F.sum("hits").over(w)).withColumn("kept", F.col("running") <= budget)


def adapter_start(seq: Column, adapter: str = "AGATCGGAAGAGC", overlap: int = 8, most_clip: int = 30) -> Column:
    """Earliest place from which the read's rest is the adapter's beginning; null if there is none."""
    n = F.length(seq)
    lo, hi = F.greatest(n - most_clip, F.lit(0)), n - overlap
    fits = lambda i: F.substring(seq, i + 1, F.least(n - i, F.lit(len(adapter)))) == F.substring(F.lit(adapter), F.lit(1), F.least(n - i, F.lit(len(adapter))))
    return F.when(hi >= lo, F.array_min(F.filter(F.sequence(lo, F.greatest(hi, lo)), fits)))


def sam_flag(paired: Column, mapped: Column, reverse: Column, first: Column, mate_reverse: Column) -> Column:
    """Flags of a record; pairs are proper or wholly unmapped, never half mapped."""
    bit = lambda cond, b: F.when(cond, b).otherwise(0)
    both = paired & mapped
    return (bit(paired, 1) + bit(both, 2) + bit(~mapped, 4) + bit(paired & ~mapped, 8) + bit(mapped & reverse, 16) + bit(both & mate_reverse, 32) + bit(paired & first, 64) + bit(paired & ~first, 128)).cast("int")


def template_length(start: Column, end: Column, mate_start: Column, mate_end: Column, first: Column) -> Column:
    span = F.greatest(end, mate_end) - F.least(start, mate_start)
    leftmost = (start < mate_start) | ((start == mate_start) & first)
    return F.when(leftmost, span).otherwise(-span)
