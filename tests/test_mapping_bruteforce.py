"""Single-end mapping against every placement of every read."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoloom import api
from cytoloom.functions import kernels
from cytoloom.operators import alignment, records, single

COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def rc(s):
    return s.translate(COMPLEMENT)[::-1]


def brute(read, texts, edits):
    """All placements of the least distance within 3 edits, or else within ``edits``."""
    rows = []
    for strand, text in texts.items():
        for s in range(len(text)):
            for n in range(max(1, len(read) - edits), len(read) + edits + 1):
                if s + n <= len(text):
                    rows.append((strand, s, s + n, kernels.distance(text[s : s + n], read)))
    best = min((r[3] for r in rows), default=99)
    return {r for r in rows if r[3] == best <= edits}


def test_gapped_places_beat_ungapped_decoys(spark):
    rng = random.Random(3)
    place = "".join(rng.choices("ACGT", k=70))
    decoy = list(place[:30] + place[31:])
    for at in (12, 40, 62):
        decoy[at] = {"A": "G", "C": "A", "G": "T", "T": "G"}[decoy[at]]
    fill = lambda k: "".join(rng.choices("ACGT", k=k))
    genome = fill(50) + place + fill(60) + "".join(decoy) + fill(50)
    read = place[:30] + place[31:]
    contigs = spark.createDataFrame([("g", genome)], "contig string, seq string")
    reads = spark.createDataFrame([(1, read)], "read_id bigint, seq string")
    got = single.map_reads(reads, contigs).first()
    assert (got.status, got.distance, got.start, got.end) == ("unique", 1, 50, 120)


def test_placements_equal_brute_force(spark):
    rng = random.Random(7)
    genome = "".join(rng.choices("ACGT", k=90))
    texts = {"OT": genome, "OB": rc(genome)}
    reads = []
    for i in range(12):
        text = texts["OT" if i % 2 else "OB"]
        s = rng.randint(0, 40)
        read = list(text[s : s + 48].replace("C", "T") if i % 3 else text[s : s + 48])
        # edits beside an unbroken stretch that holds a seed
        for _ in range(i % 5):
            at, how = rng.randrange(20), rng.randrange(3)
            if how == 0:
                read[at] = rng.choice("ACGT")
            elif how == 1:
                del read[at]
            else:
                read.insert(at, rng.choice("ACGT"))
        reads.append((i, "".join(read)))
    contigs = spark.createDataFrame([("g", genome)], "contig string, seq string")
    found = single.placements(spark.createDataFrame(reads, "read_id bigint, seq string"), contigs)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.read_id, set()).add((r.strand, r.start, r.end, r.distance))
    for i, read in reads:
        want = brute(read, texts, 5)
        least = min(d for *_, d in got[i])
        assert {x for x in got[i] if x[3] == least} == want, (i, read)


def test_sensitive_search_finds_what_has_no_seed(spark):
    rng = random.Random(12)
    genome = "".join(rng.choices("ACGT", k=300))
    read = list(genome[100:148])
    for at in (7, 19, 31, 43):
        read[at] = {"A": "G", "C": "G", "G": "T", "T": "G"}[read[at]]
    contigs = spark.createDataFrame([("g", genome)], "contig string, seq string")
    reads = spark.createDataFrame([(1, "".join(read))], "read_id bigint, seq string")
    assert single.map_reads(reads, contigs).first().status == "unmapped"
    got = single.map_reads(reads, contigs, sensitive=True).first()
    assert (got.status, got.start, got.end, got.distance, got.complete) == ("unique", 100, 148, 4, True)


def test_completeness_is_claimed_only_where_it_holds(spark):
    reads = spark.createDataFrame([(1, "A" * 36), (2, "A" * 80), (3, "A" * 150)], "read_id bigint, seq string")
    n = F.length("seq")
    sure = lambda d: (single.unbroken(n, d) >= alignment.SEED + single.stride(n, 5) - 1)
    got = [tuple(r) for r in reads.select(sure(3), sure(5)).collect()]
    assert got == [(False, False), (True, False), (True, True)]


def test_common_seeds_leave_a_frontier_open(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_HITS", 2)
    monkeypatch.setattr(alignment.admissible, "__defaults__", (2,))
    rng = random.Random(2)
    unit, own = "".join(rng.choices("ACGT", k=80)), "".join(rng.choices("ACGT", k=120))
    contigs = spark.createDataFrame([("g", unit * 4 + own)], "contig string, seq string")
    reads = spark.createDataFrame([(1, own[:100]), (2, unit[20:] + own[:60])], "read_id bigint, seq string")
    got = {r.read_id: r for r in single.map_reads(reads, contigs).collect()}
    assert got[1].complete and got[2].status == "unique" and not got[2].complete


def test_kernels_of_batches_equal_those_of_rows():
    rng = random.Random(1)
    for n in (1, 12, 30):
        for slack in (0, 2, 3):
            queries = ["".join(rng.choices("ACGTN", (5, 5, 5, 5, 1), k=n)) for _ in range(20)]
            windows = []
            for q in queries:
                w = list("".join(rng.choices("ACGT", k=slack)) + q.replace("T", "C", 1) + "".join(rng.choices("ACGT", k=slack)))
                for _ in range(rng.randrange(3)):
                    w[rng.randrange(len(w))] = rng.choice("ACGT")
                windows.append("".join(w))
            for bottom in (False, True):
                got = kernels.flexible_batch(windows, queries, slack, bottom)
                assert [sorted(x) for x in got] == [sorted(kernels.flexible(w, q, slack, bottom)) for w, q in zip(windows, queries)]
    for n, m in ((1, 1), (8, 8), (14, 9), (20, 28), (40, 20)):
        refs, queries = (["".join(rng.choices("ACGT", k=k)) for _ in range(25)] for k in (n, m))
        for bottom in (False, True):
            assert kernels.affine_batch(refs, queries, bottom) == [kernels.affine_score(r, q, bottom) for r, q in zip(refs, queries)]


def test_no_placement_reaches_beyond_the_contig():
    [found] = kernels.flexible_batch(["..ACGTAA"], ["ACGT"], 2)
    assert found == [(2, 6, 0)]
    [found] = kernels.flexible_batch(["...CGTAA"], ["ACGT"], 2)
    assert found == [(3, 6, 1)]


def test_records_of_an_insertion_beside_a_deletion(spark):
    rng = random.Random(6)
    ref = "".join(rng.choices("AGT", k=50))  # nothing to convert, so all differences are edits
    query = ref[:10] + "T" + ref[10:39] + ref[40:]
    assert len(query) == 50 and kernels.distance(ref, query) == 2
    rows = spark.createDataFrame([(f"AA{ref}AA", query, True, 2), (f"AA{ref}AA", query, True, None)], "f string, q string, t boolean, d int")
    with_gaps, without = [r.x for r in rows.select(records.described("f", "q", "t", "d").alias("x")).collect()]
    assert with_gaps.distance == 2 and sum(n for n, op in records.runs(with_gaps.cigar) if op in "ID") == 2
    assert with_gaps.nm == 2 and without.cigar == "50M" and without.distance > 2
    assert kernels.alignment(ref, query, False, 2)[:2] == kernels.alignment(ref, query)[:2]


def test_mates_that_name_two_strands_are_an_error(spark):
    from cytoloom.operators.evidence import fragments

    base = dict(qname="a", rg=None, rname="c", rnext="=", cigar="10M")
    rows = [base | dict(flag=0x43, pos=5, pnext=8, strand="T"), base | dict(flag=0x83, pos=8, pnext=5, strand="B")]
    ddl = "qname string, rg string, rname string, rnext string, cigar string, flag int, pos bigint, pnext bigint, strand string"
    with pytest.raises(Exception, match="both strands"):
        fragments(spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in rows], ddl)).collect()
    same = [r | {"strand": "T"} for r in rows]
    assert fragments(spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in same], ddl)).count() == 2


def test_align_clips_adapters_settles_ties_and_uses_an_index(spark, tmp_path):
    rng = random.Random(9)
    genome = "".join(rng.choices("ACGT", k=400))
    # a read one edit from either of two places: a mismatch costs less than a gap
    twin = "".join(rng.choices("AGT", k=70))
    changed = twin[:30] + ("A" if twin[30] != "A" else "G") + twin[31:]
    genome = genome[:100] + changed + genome[100:250] + twin[:30] + twin[31:] + genome[250:]
    (tmp_path / "r.fa").write_text(f">g\n{genome}\n")
    tail = "AGATCGGAAGAGC"
    reads = {"cut": genome[10:80].replace("C", "T") + tail[:9], "plain": genome[330:400].replace("C", "T"), "tie": twin}
    (tmp_path / "r.fq").write_text("".join(f"@{k}\n{s}\n+\n{'I' * len(s)}\n" for k, s in reads.items()))
    api.index(spark, str(tmp_path / "r.fa"), str(tmp_path / "idx"))
    where = (str(tmp_path / "r.fa"), str(tmp_path / "r.fq"), None)
    api.align(spark, *where, str(tmp_path / "a.sam"), index_path=str(tmp_path / "idx"))
    api.align(spark, *where, str(tmp_path / "b.sam"), adapter=None)
    rows = lambda p: {f[0]: f for x in (tmp_path / p).read_text().splitlines() if not x.startswith("@") for f in [x.split("\t")]}
    a, b = rows("a.sam"), rows("b.sam")
    assert (a["cut"][3], a["cut"][5]) == ("11", "70M9S") and int(a["cut"][4]) <= 20 and len(a["cut"][9]) == 79
    xm = next(t for t in a["cut"] if t.startswith("XM:Z:"))[5:]
    assert len(xm) == 79 and set(xm[70:]) == {"."}
    assert b["cut"][5] != "70M9S" and a["plain"] == b["plain"]
    assert (a["tie"][3], a["tie"][4], a["tie"][5]) == ("101", "10", "70M")
    (tmp_path / "other.fa").write_text(">g\nACGTACGTACGTACGTACGTACGT\n")
    with pytest.raises(Exception, match="another reference"):
        api.align(spark, str(tmp_path / "other.fa"), str(tmp_path / "r.fq"), None, str(tmp_path / "c.sam"), index_path=str(tmp_path / "idx"))


def test_a_sure_mate_rescues_the_other(spark):
    from cytoloom.operators import paired

    rng = random.Random(14)
    genome = "".join(rng.choices("ACGT", k=900))
    contigs = spark.createDataFrame([("g", genome)], "contig string, seq string")

    def spoilt(text):
        out = list(text)
        for at in (15, 31, 46):  # no unbroken stretch has a seed's length
            out[at] = {"A": "G", "C": "G", "G": "T", "T": "G"}[out[at]]
        return "".join(out)

    top = lambda s, n=60: genome[s : s + n]
    rows = [(1, top(200), rc(spoilt(top(340)))), (2, spoilt(top(400)), rc(top(560))), (3, top(100), rc(top(250))), (4, top(100), rc(spoilt(top(700)))), (5, rc(top(500)), spoilt(top(380)))]  # in the last, a change of A to G is one that conversion allows
    pairs = spark.createDataFrame(rows, "pair_id bigint, seq1 string, seq2 string")
    got = {r.pair_id: r for r in paired.map_pairs(pairs, contigs, span=(100, 300)).collect()}
    for i, (a, b, d) in {1: (200, 340, (0, 3)), 2: (400, 560, (3, 0)), 3: (100, 250, (0, 0)), 5: (500, 380, (0, 3))}.items():
        r = got[i]
        assert (r.status, r.start1, r.start2, r.distance1, r.distance2, r.rescued) == ("unique", a, b, *d, i in (1, 2)), r
    assert got[1].mapq == 20 and got[3].mapq == 60 and got[4].status == "unmapped"
    plain = {r.pair_id: r.status for r in paired.map_pairs(pairs, contigs, span=(100, 300), rescue=False).collect()}
    assert plain == {1: "unmapped", 2: "unmapped", 3: "unique", 4: "unmapped", 5: "unique"}


def test_exact_search_never_cuts_short(spark):
    genome = "ACGT" * 30
    contigs = spark.createDataFrame([("g", genome)], "contig string, seq string")
    patterns = spark.createDataFrame([(1, "ACG"), (2, "TACGTACGTACGTACGTACG"), (3, "ANG"), (4, ""), (5, "G" * 200)], "pattern_id bigint, seq string")
    found = alignment.exact_search(patterns, contigs).collect()
    for i, p in ((1, "ACG"), (2, "TACGTACGTACGTACGTACG")):
        for strand, text in (("OT", genome), ("OB", rc(genome))):
            want = [k for k in range(len(text)) if text.replace("C", "T").startswith(p.replace("C", "T"), k)]
            assert sorted(r.start for r in found if r.pattern_id == i and r.strand == strand) == want
    assert {r.pattern_id for r in found} == {1, 2}
    with pytest.raises(Exception, match="limit of 5"):
        alignment.exact_search(patterns, contigs, most=5)


def test_distances_and_paths_of_batches_equal_those_of_rows():
    rng = random.Random(17)
    for n, m in [(1, 1), (1, 4), (4, 1), (7, 7), (6, 9), (9, 6), (20, 21), (2, 30), (30, 2), (0, 3), (3, 0)]:
        for bottom in (False, True):
            for letters in ("AC", "CT", "AG", "ACGTN"):
                refs = ["".join(rng.choices(letters, k=n)) for _ in range(25)]
                queries = ["".join(rng.choices(letters + ".", k=m)) for _ in refs]
                assert kernels.alignment_batch(refs, queries, bottom) == [kernels.alignment(r, q, bottom) for r, q in zip(refs, queries)]
                assert kernels.distance_batch(refs, queries, bottom) == [kernels.distance(r, q, bottom) for r, q in zip(refs, queries)]


def test_paths_of_many_rows_take_little_time():
    rng = random.Random(18)
    refs = ["".join(rng.choices("ACGT", k=35)) for _ in range(4000)]
    queries = [r[: 10 + i % 20] + "".join(rng.choices("ACGT", k=26 - i % 20)) for i, r in enumerate(refs)]
    refs[7], queries[8] = None, None
    sides = [None if i == 9 else i % 3 == 0 for i in range(len(refs))]
    began = time.process_time()
    paths = kernels.alignment_udf.func(pd.Series(refs), pd.Series(queries), pd.Series(sides))
    distances = kernels.distance_udf.func(pd.Series(refs), pd.Series(queries), pd.Series(sides))
    # a row at a time, this takes half a minute
    assert time.process_time() - began < 5
    assert distances.isna().tolist() == paths.cigar.isna().tolist() == [i in (7, 8) for i in range(len(refs))]
    for i in (0, 1, 2, 9, 10, 3999):
        assert tuple(paths.loc[i]) == kernels.alignment(refs[i], queries[i], bool(sides[i])) and distances[i] == paths.distance[i]
