"""Reads to SAM to methylation, variants and a matrix, on a simulated contig."""

import random

import pytest

from cytoloom import api
from cytoloom.errors import ConfigurationError, InputError
from cytoloom.operators.combine import CombineOptions
from cytoloom.operators.methylation import MethylationOptions
from cytoloom.operators.snp import SnpOptions

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMPLEMENT)[::-1]


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    folder = tmp_path_factory.mktemp("world")
    rng = random.Random(5)
    genome = "".join(rng.choices("ACGT", k=600))
    snv = 300
    while genome[snv] != "A":
        snv += 1
    donor = genome[:snv] + "G" + genome[snv + 1 :]
    (folder / "ref.fa").write_text(f">demo first contig\n{genome[:333].lower()}\n{genome[333:]}\n>other\n{'ACGTTGCA' * 20}\n")
    r1, r2 = [], []
    for i in range(60):
        s = rng.randint(150, 330)
        strand = i % 2
        # a base more, so that a CG cut by the fragment's end is still known as one
        piece = donor[s : s + 181] if strand == 0 else rc(donor[s - 1 : s + 180])
        text = piece.replace("CG", "cg").replace("C", "T").replace("cg", "CG")[:180]
        name = f"p{i:03d}.{s}.{strand}"
        r1.append(f"@{name}/1\n{text[:75]}\n+\n{'I' * 75}\n")
        r2.append(f"@{name}/2\n{rc(text)[:75]}\n+\n{'I' * 75}\n")
    (folder / "r1.fastq").write_text("".join(r1))
    (folder / "r2.fastq").write_text("".join(r2))
    return folder, genome, snv


@pytest.fixture(scope="module")
def sam(spark, world):
    folder, _, _ = world
    report = api.align(spark, str(folder / "ref.fa"), str(folder / "r1.fastq"), str(folder / "r2.fastq"), str(folder / "out.sam"), span=(100, 250), metrics=str(folder / "m.tsv"))
    assert report["unique"] == 60 and report["total"] == 60
    lines = (folder / "out.sam").read_text().splitlines()
    head = [x.replace("SO:unsorted", "SO:coordinate") for x in lines if x.startswith("@")]
    body = sorted((x for x in lines if not x.startswith("@")), key=lambda x: int(x.split("\t")[3]))
    (folder / "sorted.sam").write_text("\n".join([*head[:-1], "@RG\tID:a\tSM:donor", head[-1], *body]) + "\n")
    return [x.split("\t") for x in body]


def test_pairs_come_back_to_their_origin(sam, world):
    _, genome, _ = world
    assert len(sam) == 120
    for f in sam:
        start, strand = (int(x) for x in f[0].split(".")[1:])
        flag, pos = int(f[1]), int(f[3]) - 1
        assert f[4] == "60" and f[5] == "75M" and f[2] == "demo"
        first = bool(flag & 64)
        left = first == (strand == 0)
        assert pos == (start if left else start + 105)
        assert bool(flag & 16) == (not left)
        assert abs(int(f[8])) == 180
        assert ("XG:Z:CT" if strand == 0 else "XG:Z:GA") in f
        assert len(f[9]) == 75


def test_single_end_maps_alike(spark, world):
    folder, _, _ = world
    report = api.align(spark, str(folder / "ref.fa"), str(folder / "r1.fastq"), None, str(folder / "se.sam"))
    assert report["unique"] == 60


def test_joint_equals_the_single_callers_and_finds_the_variant(spark, sam, world):
    folder, genome, snv = world
    meth, variants = MethylationOptions(min_depth=3), SnpOptions(min_depth=5)
    where = dict(input=str(folder / "sorted.sam"), reference=str(folder / "ref.fa"))
    api.call_meth(spark, output=str(folder / "a.bed"), options=meth, **where)
    api.call_snp(spark, output=str(folder / "a.vcf"), options=variants, **where)
    api.call_joint(spark, meth_output=str(folder / "b.bed"), vcf_output=str(folder / "b.vcf"), meth=meth, variants=variants, **where)
    assert (folder / "a.bed").read_bytes() == (folder / "b.bed").read_bytes()
    assert (folder / "a.vcf").read_bytes() == (folder / "b.vcf").read_bytes()
    rows = [x.split("\t") for x in (folder / "a.vcf").read_text().splitlines() if not x.startswith("#")]
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [("demo", str(snv + 1), "A", "G")]
    assert (folder / "a.vcf").read_text().splitlines()[-len(rows) - 1].endswith("\tdonor")
    sites = [x.split("\t") for x in (folder / "a.bed").read_text().splitlines()]
    assert sites and all(int(s[9]) >= 3 for s in sites)
    # methylation was kept at CG only; the variant makes a site of its own beside it
    for s in sites:
        if abs(int(s[1]) - snv) > 2:
            assert s[10] == ("100.00" if s[3] == "m,CG,0" else "0.00"), s


def test_regions_equal_the_filtered_whole(spark, sam, world):
    folder, _, _ = world
    where = dict(input=str(folder / "sorted.sam"), reference=str(folder / "ref.fa"), options=MethylationOptions(min_depth=3), fmt="cgmap")
    api.call_meth(spark, output=str(folder / "all.cgmap"), **where)
    (folder / "r.bed").write_text("# a comment\ntrack name=x\ndemo\t250\t300\tx\n")
    api.call_meth(spark, output=str(folder / "part.cgmap"), regions=[("demo", 200, 240), ("demo", 230, 260)], regions_file=str(folder / "r.bed"), **where)
    inside = [x for x in (folder / "all.cgmap").read_text().splitlines() if 200 < int(x.split("\t")[2]) <= 300]
    assert (folder / "part.cgmap").read_text().splitlines() == inside and inside
    with pytest.raises(InputError):
        api.call_meth(spark, output=str(folder / "x"), regions=[("demo", 0, 10_000)], **where)


def test_wrong_reference_is_an_error(spark, sam, world):
    folder, genome, _ = world
    (folder / "wrong.fa").write_text(f">demo\n{'A' + genome[1:] if genome[0] != 'A' else 'C' + genome[1:]}\n>other\n{'ACGTTGCA' * 20}\n")
    with pytest.raises(InputError):
        api.call_meth(spark, str(folder / "sorted.sam"), str(folder / "wrong.fa"), str(folder / "y"))
    with pytest.raises(ConfigurationError):
        api.call_meth(spark, str(folder / "sorted.sam"), str(folder / "ref.fa"), str(folder / "ref.fa"))


def _bed_line(contig, start, strand, methylated, total):
    return "\t".join(map(str, [contig, start, start + 1, "m,CG,0", total, strand, start, start + 1, "255,0,0", total, "0.00", methylated, total - methylated, 0, 0, 0, 0, 0]))


def test_matrix_holds_the_sites_that_enough_samples_cover(spark, tmp_path):
    rng = random.Random(21)
    sites = [(c, p, rng.choice("+-")) for c in ("ctgA", "ctgB") for p in sorted(rng.sample(range(900), 12))]
    names, seen = ["leaf", "root", "seed", "stem"], {}
    files = []
    for k, name in enumerate(names):
        mine = [(s, rng.randint(0, 7), rng.randint(7, 12)) for s in sites if rng.random() < 0.6]
        for s, m, t in mine:
            seen.setdefault(s, {})[name] = (m, t)
        if k < 2:
            text = [_bed_line(*s, m, t) for s, m, t in mine]
        else:
            text = ["\t".join([c, "C" if st == "+" else "G", str(p + 1), "CG", "CG", f"{m / t:.6f}", str(m), str(t)]) for (c, p, st), m, t in mine]
        (tmp_path / f"{name}.txt").write_text("\n".join(text) + "\n")
        files.append((name, str(tmp_path / f"{name}.txt")))
    # a site needs two of four samples with at least nine observations
    kept = {s: by for s, by in seen.items() if sum(t >= 9 for _, t in by.values()) >= 2}
    report = api.combine(spark, files, str(tmp_path / "all.bed"), "both", CombineOptions(9, 500_000_000))
    assert report["sites_written"] == len(kept) <= report["sites_seen"] <= len(seen)
    rows = [x.split("\t") for x in (tmp_path / "all.count.bed").read_text().splitlines() if not x.startswith("#")]
    assert [(r[0], int(r[1]), r[5]) for r in rows] == sorted(kept)
    for r in rows:
        by = kept[r[0], int(r[1]), r[5]]
        want = [str(x) for n in names for x in (by[n] if n in by and by[n][1] >= 9 else (".", "."))]
        assert r[6:] == want


@pytest.mark.parametrize("fields", [("ctgA", "T", "4", "CG", "CG", "0.25", "1", "4"), ("ctgA", "G", "-3", "CHH", "CA", "0.25", "1", "4"), ("ctgA", "G", "4", "CHH", "CA", "0.25", "9", "4"), ("ctgA", "G", "4", "CHH", "CA", "na", "3", "4"), ("ctgA", "G", "4", "CHH"), ("ctgA", "G", "four", "CHH", "CA", "0.25", "1", "4")])
def test_a_bad_row_leaves_no_matrix(spark, tmp_path, fields):
    (tmp_path / "bad.cgmap").write_text("\t".join(fields) + "\n")
    with pytest.raises(Exception):
        api.combine(spark, [("bad", str(tmp_path / "bad.cgmap"))], str(tmp_path / "matrix.bed"))
    assert not (tmp_path / "matrix.bed").exists()


def test_index_round_trip(spark, world, tmp_path):
    folder, _, _ = world
    api.index(spark, str(folder / "ref.fa"), str(tmp_path / "idx"))
    contigs, seeds = api.load_index(spark, str(tmp_path / "idx"))
    assert contigs.count() == 2 and seeds.count() > 1000


def test_adapters_are_looked_at_again(spark):
    from cytoloom.operators import single

    rng = random.Random(9)
    genome = "".join(rng.choices("ACGT", k=400))
    contigs = spark.createDataFrame([("g", genome)], "contig string, seq string")
    tail = "AGATCGGAAGAGC"
    reads = spark.createDataFrame([(1, genome[10:80].replace("C", "T") + tail[:9]), (2, genome[300:370].replace("C", "T")), (3, "".join(rng.choices("AGT", k=70)) + tail)], "read_id bigint, seq string")
    strict = single.map_reads(reads, contigs)
    done = {r.read_id: r for r in single.with_adapter(strict, reads, contigs).collect()}
    assert done[1].status == "unique" and (done[1].start, done[1].end, done[1].retained) == (10, 80, 70) and done[1].mapq <= 20
    assert done[2].retained is None and done[2].start == 300 and done[3].status == "unmapped"
