"""SAM records from placements: orientation, NM, MD, bisulfite tags."""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ..functions.kernels import alignment, struct_of


def replay(ref: str, query: str, cigar: list[tuple[int, str]], top: bool, context: list[str]) -> tuple[int, str, str]:
    """(NM, MD, XM) of a read over the reference it covers.

    NM counts literal differences, conversions included. XM has a letter a read base: z, x, h, u for a
    CG, CHG, CHH or unresolved cytosine, capital if methylated; a dot elsewhere. ``context`` names each
    reference base's cytosine context on the called strand ('' if none).
    """
    letters = {"CG": "z", "CHG": "x", "CHH": "h", "?": "u"}
    kept, turned = ("C", "T") if top else ("G", "A")
    nm, md, run, xm = 0, [], 0, []
    r = q = 0
    for n, op in cigar:
        if op in "M=X":
            for _ in range(n):
                a, b = ref[r], query[q]
                if a == b and a != "N":
                    run += 1
                else:
                    nm += 1
                    md.append(f"{run}{a}")
                    run = 0
                letter = letters.get(context[r], "u") if a == kept else "."
                xm.append(letter.upper() if a == kept and b == kept else letter if a == kept and b == turned else ".")
                r, q = r + 1, q + 1
        elif op == "D":
            nm += n
            md.append(f"{run}^{ref[r : r + n]}")
            run, r = 0, r + n
        elif op == "I":
            nm += n
            xm.append("." * n)
            q += n
        elif op == "S":
            xm.append("." * n)
            q += n
    return nm, "".join(md) + str(run), "".join(xm)


def contexts(flanked: str, top: bool) -> list[str]:
    """Context of each base of ``flanked`` but its two flanks on both sides ('.' where there is none)."""
    partner = str.maketrans("ACGT.N", "TGCA.N")
    out = []
    for i in range(2, len(flanked) - 2):
        base = flanked[i]
        if base != ("C" if top else "G"):
            out.append("")
            continue
        one, two = (flanked[i + 1], flanked[i + 2]) if top else (flanked[i - 1].translate(partner), flanked[i - 2].translate(partner))
        if one == "G":
            out.append("CG")
        elif one not in "ACT" or two not in "ACGT":
            out.append("?")
        else:
            out.append("CHG" if two == "G" else "CHH")
    return out


def runs(cigar: str) -> list[tuple[int, str]]:
    out, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            out.append((int(n), c))
            n = ""
    return out


@F.pandas_udf(struct_of(cigar=StringType(), distance=IntegerType(), nm=IntegerType(), md=StringType(), xm=StringType()))
def described(flanked: pd.Series, query: pd.Series, top: pd.Series, distance: pd.Series) -> pd.DataFrame:
    """CIGAR, distance and tags of reads in reference orientation; ``flanked`` is the covered reference
    with two bases more on each side, ``distance`` that of the placement, or null if it has no gaps."""
    rows = []
    for f, q, t, least in zip(flanked, query, top, distance):
        ref, cigar = f[2:-2], f"{len(q)}M"
        d = sum(not (a == b and a != "N" or (a, b) == (("C", "T") if t else ("G", "A"))) for a, b in zip(ref, q))
        # an insertion and a deletion may leave the lengths equal
        if len(ref) != len(q) or (not pd.isna(least) and d > least):
            d, cigar, _ = alignment(ref, q, not t, None if pd.isna(least) else int(least))
        rows.append((cigar, d, *replay(ref, q, runs(cigar), bool(t), contexts(f, bool(t)))))
    return pd.DataFrame(rows, columns=["cigar", "distance", "nm", "md", "xm"])


COUNTS = ("distance", "literal_nm", "matches", "compatible", "mismatches", "unknown", "inserted", "deleted", "gap_runs")


def evaluated(ref: str, query: str, cigar: list[tuple[int, str]], top: bool) -> dict[str, int]:
    """What a CIGAR makes of a read over the reference it covers.

    ``matches`` are equal bases, ``compatible`` differences that conversion explains, ``unknown`` pairs with
    a letter other than A, C, G, T, ``mismatches`` the rest; ``distance`` counts mismatches, unknown pairs and
    gap bases, ``literal_nm`` the compatible ones, too. A CIGAR that does not cover both texts is an error.
    """
    out = dict.fromkeys(COUNTS, 0)
    r = q = 0
    last = ""
    for n, op in cigar:
        if op in "M=X":
            pairs = list(zip(ref[r : r + n], query[q : q + n], strict=True))
            if len(pairs) != n:
                raise ValueError("the CIGAR goes beyond a text")
            for a, b in pairs:
                kind = "unknown" if a not in "ACGT" or b not in "ACGT" else "matches" if a == b else "compatible" if (a, b) == (("C", "T") if top else ("G", "A")) else "mismatches"
                out[kind] += 1
            r, q = r + n, q + n
        elif op in "ID":
            out["inserted" if op == "I" else "deleted"] += n
            out["gap_runs"] += n > 0 and op != last
            r, q = r + n * (op == "D"), q + n * (op == "I")
        elif op == "S":
            q += n
        last = op if n else last
    if (r, q) != (len(ref), len(query)):
        raise ValueError("the CIGAR does not cover both texts")
    out["distance"] = out["mismatches"] + out["unknown"] + out["inserted"] + out["deleted"]
    out["literal_nm"] = out["distance"] + out["compatible"]
    return out


@F.pandas_udf(struct_of(**{c: IntegerType() for c in COUNTS}))
def evaluation(ref: pd.Series, query: pd.Series, cigar: pd.Series, top: pd.Series) -> pd.DataFrame:
    """``evaluated`` of each row; a null cigar stands for one run of matches or mismatches."""
    rows = [evaluated(r, q, [(len(q), "M")] if pd.isna(c) else runs(c), bool(t)) for r, q, c, t in zip(ref, query, cigar, top)]
    return pd.DataFrame(rows, columns=list(COUNTS))


def canonical(cigar: list[tuple[int, str]]) -> str:
    """Equal neighbours merged, empty runs dropped."""
    out = []
    for op, group in groupby((x for x in cigar if x[0]), key=lambda x: x[1]):
        out.append(f"{sum(n for n, _ in group)}{op}")
    return "".join(out)
