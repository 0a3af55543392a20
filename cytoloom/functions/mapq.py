"""Mapping qualities as column expressions over evidence columns.

Single-end evidence columns: read_length, best, second (nullable), distance_limit, located_rows,
candidate_starts, placements, first_hits, first_bases, direct_singleton, complete, audited, rounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the single-end policy.
MAXIMUM, STEP, FLOOR_CERTIFIED, HIGH, CAP_UNCERTIFIED = 60, 10, 20, 40, 30
CAP_UNCONFIRMED, CAP_REPEAT, CAP_EDIT4, CAP_EDIT4_MULTI, CAP_EDIT5 = 20, 10, 15, 20, 10
LONG_READ, SHORT_SEED, LONG_SEED = 128, 16, 46
REPEAT_HITS, REPEAT_ROWS, REPEAT_STARTS, REPEAT_PLACEMENTS = 64, 256, 64, 64
CAP_ADAPTER, CAP_LOCUS, CAP_LOCUS_CERTIFIED, AFFINE_GAP, AFFINE_MAPQ, AFFINE_ORIGINS = 20, 10, 20, 2, 10, 15
REPLACE_FROM, CROSS_CHECK_FROM = 10, 20
# Fixed values of the paired-end policy.
GAP_HUNDREDTHS, RISK_ROWS, CAP_RISK, CAP_RESCUE, CAP_RESOLVED, CAP_ROWS = 1000, 384, 19, 20, 30, 30
CAP_MARGIN, CAP_NEAR, CAP_CLIP, EDIT_PENALTY, NEAR_DELTA, COMPLETE_BELOW = 39, 39, 20, 4, 7, 20

c = F.col
_true = lambda x: F.coalesce(x, F.lit(False))


def raw_single() -> Column:
    """Ten for each edit that separates the best origin from the next, or from the verified limit."""
    apart = F.when(c("second").isNotNull(), c("second") - c("best")).otherwise(c("distance_limit") + 1 - c("best"))
    return F.least(F.lit(MAXIMUM), F.greatest(apart, F.lit(0)) * STEP)


def coordinate_certified() -> Column:
    long_two = (c("read_length") >= LONG_READ) & (c("rounds") >= 2)
    return c("complete") & ((c("rounds") >= 3) | (long_two & c("direct_singleton") & (c("best") <= 2)) | (long_two & (c("best") == c("distance_limit")) & c("second").isNull()))


def locus_certified() -> Column:
    return coordinate_certified() | (c("complete") & (c("best") <= 1) & (c("rounds") >= 2))


def high_certified(raw: Column) -> Column:
    sure = c("audited") & (c("best") <= 3)
    singleton = c("direct_singleton") & (c("first_hits") == 1) & c("first_bases").between(SHORT_SEED, LONG_SEED)
    several = (c("rounds") >= 3) | ((c("rounds") >= 2) & ((raw >= HIGH + STEP) | ((raw >= HIGH) & (c("best") <= 1))))
    return sure & (singleton | several)


def single() -> Column:
    """Raw separation, then caps, then the named positive certificates, in this order."""
    raw = raw_single()
    capped = F.when((raw >= HIGH) & ~high_certified(raw), F.least(raw, F.lit(CAP_UNCERTIFIED))).otherwise(raw)
    multi = c("complete") & (c("rounds") >= 2)
    edit_cap = F.when(c("best") >= 5, CAP_EDIT5).when((c("best") == 4) & multi, CAP_EDIT4_MULTI).when(c("best") == 4, CAP_EDIT4).otherwise(MAXIMUM)
    repeat = (c("first_hits") > REPEAT_HITS) | (c("located_rows") > REPEAT_ROWS) | (c("candidate_starts") > REPEAT_STARTS) | (c("placements") > REPEAT_PLACEMENTS)
    repeat_cap = F.when(repeat & ~c("complete"), CAP_REPEAT).otherwise(MAXIMUM)
    blind_cap = F.when(~c("complete") & (c("rounds") < 1), CAP_UNCONFIRMED).otherwise(MAXIMUM)
    capped = F.least(capped, edit_cap, repeat_cap, blind_cap)
    raised = F.when((capped == raw) & raw.isin(10, 30) & c("complete") & (c("best") <= 3) & (c("rounds") >= 3), capped + STEP).otherwise(capped)
    return F.when(coordinate_certified(), F.greatest(raised, F.lit(FLOOR_CERTIFIED))).otherwise(raised).cast("int")


def local_locus(collapsed: Column) -> Column:
    q = single()
    return F.when(collapsed, F.least(q, F.when(locus_certified(), CAP_LOCUS_CERTIFIED).otherwise(CAP_LOCUS))).otherwise(q).cast("int")


def adapter_consensus(unique: Column, clipped: Column, stability: Column) -> Column:
    return F.when(unique, F.least(clipped, F.coalesce(stability, F.lit(0)), F.lit(CAP_ADAPTER))).otherwise(0).cast("int")


def cross_pass_cap(best: Column, runner_up: Column) -> Column:
    q = F.least(F.lit(MAXIMUM), F.greatest(runner_up - best, F.lit(0)) * STEP)
    return F.least(q, F.when(best >= 5, CAP_EDIT5).when(best == 4, CAP_EDIT4).otherwise(MAXIMUM)).cast("int")


def merged_repeat(mapq: Column, complete: Column, rows: Column, starts: Column, placements: Column) -> Column:
    pressed = (rows > REPEAT_ROWS) | (starts > REPEAT_STARTS) | (placements > REPEAT_PLACEMENTS)
    return F.when(~complete & (mapq < HIGH) & pressed, F.least(mapq, F.lit(CAP_REPEAT))).otherwise(mapq).cast("int")


def needs_cross_check(mapq: Column, best: Column) -> Column:
    return (mapq >= CROSS_CHECK_FROM) & (best <= 1)


def may_replace(mapq: Column) -> Column:
    return mapq >= REPLACE_FROM


def affine_unique(complete: Column, best: Column, runner_up: Column) -> Column:
    return F.when(complete & runner_up.isNotNull() & (best - runner_up >= AFFINE_GAP), AFFINE_MAPQ).cast("int")


def edit_score(distance: Column) -> Column:
    return (-EDIT_PENALTY * distance).cast("int")


def is_near(best: Column, other: Column) -> Column:
    return best - other <= NEAR_DELTA


def pair(unique: Column, complete: Column, best: Column, second: Column, near: Column) -> Column:
    """Score gap to the next origin less a logarithmic charge for further near-best ones."""
    gap = ((GAP_HUNDREDTHS * (best - second) + GAP_HUNDREDTHS // 20) / 100).cast("int")
    raw = F.when(second.isNull(), MAXIMUM).otherwise(gap)
    extra = F.greatest(near - 1, F.lit(0))
    charge = F.when(extra == 0, 0).otherwise((4.343 * F.ln(extra + 1) + 0.499).cast("int"))
    q = F.greatest(F.lit(0), F.least(F.lit(MAXIMUM), raw - charge))
    q = F.when(near == 0, q).otherwise(F.least(q, F.lit(CAP_NEAR)))
    return F.when(unique & complete & best.isNotNull(), q).otherwise(0).cast("int")


def pair_effective(mapq: Column, rescued: Column, resolved: Column, rows1: Column, rows2: Column) -> Column:
    risk = rescued | resolved | (F.greatest(rows1, rows2) >= RISK_ROWS)
    return F.when(risk, F.least(mapq, F.lit(CAP_RISK))).otherwise(mapq).cast("int")


def pair_final(unique: Column, mapq: Column, stability: Column, rescued: Column, resolved: Column, rows: Column, margin: Column, clipped: Column) -> Column:
    """Caps only lower: rescue before resolved ambiguity before row pressure, then an incomplete margin,
    the stability search and soft clips. ``rows`` is the larger mate's located rows."""
    first = F.when(rescued, CAP_RESCUE).when(resolved, CAP_RESOLVED).when((rows >= RISK_ROWS) & ~margin, CAP_ROWS).otherwise(MAXIMUM)
    q = F.least(mapq, F.coalesce(stability, F.lit(MAXIMUM)), first, F.when(~margin, CAP_MARGIN).otherwise(MAXIMUM), F.when(clipped, CAP_CLIP).otherwise(MAXIMUM))
    return F.when(unique, q).otherwise(0).cast("int")


def round_support(mask: Column) -> Column:
    return F.bit_count(mask.bitwiseAND(1023)).cast("int")
