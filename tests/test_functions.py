"""Kernels and expressions against brute force on small domains."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.errors import ConfigurationError
from cytoloom.functions import chem, kernels, mapq, numeric
from cytoloom.operators import evidence, intervals, records, snp


def cost(a, b, bottom=False):
    if a == b and a in "ACGT":
        return 0
    return 0 if (a, b) == (("G", "A") if bottom else ("C", "T")) else 1


def all_paths(r, q):
    if not r and not q:
        yield []
        return
    if r:
        yield from (["D", *p] for p in all_paths(r[1:], q))
    if q:
        yield from (["I", *p] for p in all_paths(r, q[1:]))
    if r and q:
        yield from (["M", *p] for p in all_paths(r[1:], q[1:]))


def measure(path, r, q):
    i = j = edits = gaps = runs = 0
    last = "M"
    for op in path:
        if op == "M":
            edits += cost(r[i], q[j])
        else:
            edits, gaps, runs = edits + 1, gaps + 1, runs + (op != last)
        i, j, last = i + (op != "I"), j + (op != "D"), op
    return edits, gaps, runs, path


@pytest.mark.parametrize("seed", range(25))
def test_alignment_takes_the_least_path(seed):
    rng = random.Random(seed)
    r, q = ("".join(rng.choices("ACGTN", weights=(3, 4, 3, 4, 1), k=rng.randint(0, 5))) for _ in "ab")
    paths = [measure(p, r, q) for p in all_paths(r, q)]
    best = min(paths)
    d, cigar, multiple = kernels.alignment(r, q)
    assert d == best[0] == kernels.distance(r, q)
    assert "".join(op * n for n, op in records.runs(cigar)) == "".join(best[3])
    assert multiple == (sum(p[0] == best[0] for p in paths) > 1)


@pytest.mark.parametrize("seed", range(20))
def test_affine_score_equals_the_best_path(seed):
    rng = random.Random(seed)
    r, q = ("".join(rng.choices("ACGT", k=rng.randint(1, 5))) for _ in "ab")
    best = -(10**9)
    for p in all_paths(r, q):
        s, i, j = 0, 0, 0
        for op, g in itertools.groupby(p):
            n = len(list(g))
            if op == "M":
                s += sum(1 if cost(r[i + k], q[j + k]) == 0 else -4 for k in range(n))
            else:
                s -= 6 + n
            i, j = i + n * (op != "I"), j + n * (op != "D")
        best = max(best, s)
    assert kernels.affine_score(r, q) == best
    assert kernels.affine_score("A" * 30, "A" * 5) is None


def test_clipped_equals_exhaustive_search():
    rng = random.Random(1)
    for _ in range(30):
        r = "".join(rng.choices("ACGT", k=90))
        q = list(r)
        for k in rng.sample(range(90), rng.randint(0, 4)):
            q[k] = rng.choice("ACGT")
        q[: rng.randint(0, 12)] = rng.choices("ACGT", k=len(q[: rng.randint(0, 0)])) or q[:0]
        q = ("".join(q) + "A" * 90)[:90]
        options = []
        for left in range(31):
            for right in range(31 - left):
                if 0 < left + right and 90 - left - right >= 50:
                    d = sum(cost(a, b) for a, b in zip(r[left : 90 - right], q[left : 90 - right]))
                    if d <= 5 and 2 * d + left + right <= 18:
                        options.append((7 * d + left + right, left + right, d, left, right))
        got = kernels.clipped(r, q, 5)
        assert got == (None if not options else (min(options)[3], min(options)[4], min(options)[2]))


def test_flexible_keeps_every_best_placement():
    rng = random.Random(4)
    for _ in range(15):
        window, q = "".join(rng.choices("ACGT", k=18)), "".join(rng.choices("ACGT", k=12))
        if rng.random() < 0.7:
            q = window[3:9] + window[10:16]
        every = [(s, e, kernels.distance(window[s:e], q)) for s in range(7) for e in range(12, 19) if abs(e - 15) <= 3 and e >= s]
        every = [x for x in every if x[2] <= 3]
        least = min((x[2] for x in every), default=None)
        assert sorted(kernels.flexible(window, q, 3)) == sorted(x for x in every if x[2] == least)


def test_partition_takes_the_cheapest_boundaries():
    rng = random.Random(6)
    for _ in range(20):
        hits = [[rng.randint(0, 9) for _ in range(9)] for _ in range(4)]
        best = min(sum(h[3 * a + b] for h, a, b in zip(hits, (1, *s), (*s, 1))) for s in itertools.product(range(3), repeat=3))
        total, shifts = kernels.best_partition(hits)
        assert total == best and len(shifts) == 3


def test_integral_over_methylation():
    for n1, n2 in ((0, 0), (3, 5), (40, 2), (2000, 900), (100_000, 3)):
        # product of m ** n1 (1 - m) ** n2 integrates to a beta function
        got = snp.log_integral(np.array([1e-300, 1.0]), np.array([1.0, -1.0 + 1e-15]), np.array([n1, n2], float))
        want = math.lgamma(n1 + 1) + math.lgamma(n2 + 1) - math.lgamma(n1 + n2 + 2)
        assert abs(got - want) < 1e-6 * max(1, abs(want))


def test_conversion_alone_is_no_variant_but_the_other_strand_is():
    o = snp.SnpOptions()
    deep = lambda *bins: snp.call_site("C", *zip(*bins), o)
    assert deep(("T", "T", 40, 60, 200)) is None
    call = deep(("T", "T", 40, 60, 30), ("T", "B", 40, 60, 30))
    assert call["alt"] == "T" and call["genotype"] == "1/1" and call["bsi"] == "ONE" and call["ad"] == [0, 60] and call["iad"] == [0, 30]
    het = snp.call_site("A", *zip(("A", "T", 40, 60, 20), ("G", "T", 40, 60, 20)), o)
    assert het["genotype"] == "0/1" and het["af"] == [pytest.approx(0.5, abs=1e-6)] and het["filter"] == "PASS"
    two = snp.call_site("A", *zip(("C", "B", 40, 60, 20), ("T", "B", 40, 60, 20)), o)
    assert two["alt"] == "C,T" and two["genotype"] == "1/2" and len(two["pl"]) == 6
    assert snp.call_site("A", *zip(("G", "T", 40, 60, 9)), o) is None


def test_base_table(spark):
    rows = [(r, q, s) for r in "ACGTN" for q in "ACGTN" for s in "TB"]
    df = spark.createDataFrame(rows, "r string, q string, s string")
    got = {(x.r, x.q, x.s): (x.rel, x.cost, x.m) for x in df.select("r", "q", "s", chem.base_relation(F.col("r"), F.col("q"), F.col("s")).alias("rel"), chem.base_cost(F.col("r"), F.col("q"), F.col("s")).alias("cost"), chem.methylation_class(F.col("r"), F.col("q"), F.col("s")).alias("m")).collect()}
    for (r, q, s), (rel, c, m) in got.items():
        assert c == cost(r, q, s == "B")
        assert rel == ("unknown" if "N" in r + q else "literal" if r == q else "compatible" if c == 0 else "mismatch")
        site = (r, s) in (("C", "T"), ("G", "B"))
        assert m == (None if not site else "methylated" if q == r else "unmethylated" if (q, s) in (("T", "T"), ("A", "B")) else "different")


def test_ratio_rounds_half_up_in_integers(spark):
    rows = [(n, d) for d in range(1, 40) for n in range(d + 1)]
    df = spark.createDataFrame(rows, "n bigint, d bigint")
    for r in df.select("n", "d", numeric.scaled_ratio(F.col("n"), F.col("d"), 100).alias("x"), numeric.fixed_point(numeric.scaled_ratio(F.col("n"), F.col("d"), 10_000), 2).alias("t")).collect():
        assert r.x == (r.n * 100 + r.d // 2) // r.d
        assert r.t == f"{(r.n * 10_000 + r.d // 2) // r.d // 100}.{(r.n * 10_000 + r.d // 2) // r.d % 100:02d}"


def test_options_reject_what_makes_no_sense():
    for text in ("2", "1.5", "-0.1", "0.1234567891", "", "abc"):
        with pytest.raises(ConfigurationError):
            numeric.ppb(text)
    assert [numeric.ppb(x) for x in ("0", "1", "0.1", ".5", "1.0", "0.666666666")] == [0, 10**9, 10**8, 5 * 10**8, 10**9, 666_666_666]
    assert [numeric.required_samples(n, p) for n, p in ((3, 666_666_666), (3, 666_666_667), (4, 0), (1, 10**9))] == [2, 3, 1, 1]
    with pytest.raises(ConfigurationError):
        snp.SnpOptions(min_depth=0)


def test_cigar_columns_and_canonical_form(spark):
    df = spark.createDataFrame([("2S3M1D2M2I1M", "AACGTACGTT", "IIIIIIIIII", 10), ("1M0D1M", "AC", "*", 5)], "cigar string, seq string, qual string, pos bigint")
    cols = {(r.pos, r.position): (r.query_base, r.base_quality) for r in evidence.alignment_columns(df.withColumn("k", F.lit(1)).withColumn("pos", F.col("pos"))).select(F.col("position"), "query_base", "base_quality", "pos").collect()}
    assert [cols[10, p] for p in range(10, 17)] == [("C", 40), ("G", 40), ("T", 40), (None, None), ("A", 40), ("C", 40), ("T", 40)]
    assert cols[5, 5] == ("A", None)
    one = df.select(evidence.cigar_text(evidence.canonical_cigar(evidence.cigar_runs(F.col("cigar")))).alias("c")).collect()
    assert [r.c for r in one] == ["2S3M1D2M2I1M", "2M"]


def test_tags_of_a_record():
    flanked = "..ACGCTTCAG.."
    ctx = records.contexts(flanked, True)
    assert ctx == ["", "CG", "", "CHH", "", "", "CHG", "", ""]
    nm, md, xm = records.replay("ACGCTTCAG", "ATGCTCAG", [(5, "M"), (1, "D"), (3, "M")], True, ctx)
    assert (nm, md, xm) == (2, "1C3^T3", ".z.H.X..")


def test_planning_chunks(spark):
    contigs = spark.createDataFrame([("chr1", 0, 100), ("chr2", 0, 50)], "contig string, start bigint, end bigint")
    got = sorted(tuple(r) for r in intervals.chunked(contigs, 64).select("contig", "start", "end").collect())
    assert got == [("chr1", 0, 64), ("chr1", 64, 100), ("chr2", 0, 50)]
    rows = spark.createDataFrame([("chr1", 20, 80), ("chr1", 10, 30)], "contig string, start bigint, end bigint")
    got = sorted(tuple(r) for r in intervals.chunked(intervals.merged(rows), 40).select("contig", "start", "end").collect())
    assert got == [("chr1", 10, 50), ("chr1", 50, 80)]


def test_single_quality_never_rises_with_less_evidence(spark):
    grid = [(150, b, s, lim, r, r, r, 1, 30, True, comp, aud, rd) for b in range(6) for s in (None, b, b + 1, b + 3) for lim in (3, 5) for r in (1, 300) for comp in (True, False) for aud in (True, False) for rd in (0, 2, 3) if b <= lim]
    df = spark.createDataFrame(grid, "read_length int, best int, second int, distance_limit int, located_rows bigint, candidate_starts bigint, placements bigint, first_hits bigint, first_bases bigint, direct_singleton boolean, complete boolean, audited boolean, rounds int")
    got = {tuple(r[:13]): r.q for r in df.withColumn("q", mapq.single()).collect()}
    for key, q in got.items():
        assert 0 <= q <= 60
        worse = (*key[:12], 0)
        if worse in got:
            assert got[worse] <= q


def test_borders_of_pieces_and_spans_do_not_show(spark):
    from cytoloom.operators import methylation
    from cytoloom.sources import fasta

    rng = random.Random(12)
    seq = "".join(rng.choices("ACGTN", weights=(3, 4, 4, 3, 1), k=90))
    contigs = spark.createDataFrame([("c", seq)], "contig string, seq string")
    bases = fasta.bases(contigs)
    whole = {tuple(r) for r in methylation.with_context(bases).collect()}
    assert {tuple(r) for r in methylation.with_context(bases, span=7).collect()} == whole
    reads = spark.createDataFrame([("a", "c", 5, "40M"), ("b", "c", 0, "10M20D5M"), ("d", "c", 80, "10M")], "q string, rname string, pos bigint, cigar string").withColumn("seq", F.lit("A" * 40)).withColumn("qual", F.lit("I" * 40))
    rows = []
    for piece in (8, 1000):
        r = evidence.with_reference(reads, contigs, piece)
        c = evidence.alignment_columns(r).where("position >= window_start and position < window_end")
        at = F.col("position") - F.col("window_start") + 2
        context, second = methylation.context_of(F.col("window"), at)
        rows.append(sorted(map(str, c.select("q", "position", F.substring("window", (at + 1).cast("int"), F.lit(1)).alias("b"), context.alias("c"), second.alias("s")).collect())))
        known = {x[1]: (x[3], x[4]) for x in whole}
        for x in c.select("position", F.substring("window", (at + 1).cast("int"), F.lit(1)).alias("b"), context.alias("c"), second.alias("s")).collect():
            assert x.b == seq[x.position]
            assert known[x.position][0] == x.c and (x.c is None or known[x.position][1] == x.s)
    assert rows[0] == rows[1] and len(rows[0]) == 40 + 35 + 10


def test_kmers_of_pieces_are_those_of_the_text(spark):
    from cytoloom.operators import alignment

    rng = random.Random(3)
    text = "".join(rng.choices("ACGTN", weights=(9, 9, 9, 9, 1), k=131))
    df = spark.createDataFrame([("c", text), ("d", "ACG"), ("e", "")], "contig string, text string")
    for stride, piece in ((1, 10), (4, 10), (4, 1000), (3, 131)):
        got = sorted((r.contig, r.start, r.kmer) for r in alignment.kmers(df, 5, stride, piece).collect())
        want = [("c", i, text[i : i + 5]) for i in range(0, 127, stride) if "N" not in text[i : i + 5]]
        assert got == want


def test_order_of_a_samples_rows_across_stretches(spark):
    from cytoloom.operators import combine

    rng = random.Random(3)
    rows = []
    for sample in "ab":
        line = 0
        for contig in ("x", "y", "z"):
            at = 0
            for _ in range(60):
                at += rng.choice((0, 1, 1, 2, -1))
                line += rng.randint(1, 3)
                rows.append((sample, contig, line, at, at + 1, "+"))
    df = spark.createDataFrame(rows, "sample string, contig string, line bigint, start bigint, end bigint, strand string")
    want = [b for a, b in zip(rows, rows[1:]) if a[:2] == b[:2] and a[3:] >= b[3:]]
    for lines in (1, 7, 1 << 20):
        assert sorted(map(tuple, combine.unordered(df, lines).collect())) == sorted(want)
    assert combine.split_contigs(df).count() == 0
    mixed = df.union(spark.createDataFrame([("b", "x", 10_000, 1, 2, "+")], df.schema))
    assert {(r.sample, r.contig) for r in combine.split_contigs(mixed).collect()} == {("b", "x"), ("b", "y"), ("b", "z")}


def test_evaluation_of_a_cigar_agrees_with_the_alignment():
    rng = random.Random(12)
    for _ in range(60):
        r, q = ("".join(rng.choices("ACGTN", (4, 4, 4, 4, 1), k=rng.randint(1, 14))) for _ in "ab")
        for top in (True, False):
            d, cigar, _ = kernels.alignment(r, q, not top)
            out = records.evaluated(r, q, records.runs(cigar), top)
            ctx = records.contexts(f"..{r}..", top)
            assert out["distance"] == d and out["literal_nm"] == records.replay(r, q, records.runs(cigar), top, ctx)[0]
            assert out["matches"] + out["compatible"] + out["mismatches"] + out["unknown"] + out["inserted"] == len(q)
    with pytest.raises(ValueError):
        records.evaluated("ACGT", "ACG", [(3, "M")], True)
    assert records.evaluated("AC", "TTAT", [(2, "S"), (2, "M")], True)["compatible"] == 1
