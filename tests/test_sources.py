"""Readers accept what the formats allow and reject the rest; file outputs appear whole or not at all."""

import gzip

import pytest

from cytoloom.cli import main
from cytoloom.errors import ConfigurationError, InputError, PublicationError
from cytoloom.sinks.files import distinct_paths, matrix_paths, publish
from cytoloom.sources import fasta, fastq, sam, sites


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    c = {r.contig: r for r in fasta.read(spark, put(tmp_path / "a.fa", ">one first\r\nacgt\r\nNNAC\r\n>two\nT\n")).collect()}
    assert c["one"].seq == "ACGTNNAC" and c["one"].ordinal == 0 and c["two"].length == 1
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nACGT\n")
    z = fasta.read(spark, str(tmp_path / "b.fa.gz"))
    assert z.first().md5 == "f1f8f4bf413b16ad135722aa4591043e"
    assert [r.base for r in fasta.bases(z).orderBy("position").collect()] == list("ACGT")
    for bad in ("ACGT\n", ">a\nACGT\n\nACGT\n>b\nA\n", ">a\nAXGT\n", ">a\nA\n>a\nC\n", ">\nA\n", ">a\n>b\nA\n"):
        with pytest.raises(InputError):
            fasta.read(spark, put(tmp_path / "bad.fa", bad))


def test_fastq(spark, tmp_path):
    good = "@r1/1 x\nACGT\n+\nIIII\n@r2/1\nAC\n+r2/1\n!~\n"
    a = fastq.read(spark, put(tmp_path / "a.fq", good))
    assert [(r.ordinal, r.name, r.description, r.seq) for r in a.orderBy("ordinal").collect()] == [(0, "r1/1", "x", "ACGT"), (1, "r2/1", "", "AC")]
    b = fastq.read(spark, put(tmp_path / "b.fq", good.replace("/1", "/2")))
    assert [r.shared_name for r in fastq.pair(a, b).orderBy("ordinal").collect()] == ["r1", "r2"]
    for bad in ("@r\nACGT\n+\nIII\n", "r\nA\n+\nI\n", "@r\nA\n-\nI\n", "@r\nA\n+q\nI\n", "@r\n\n+\n\n", "@r\nA\n+\n", "@r\nAX\n+\nII\n"):
        with pytest.raises(InputError):
            fastq.read(spark, put(tmp_path / "bad.fq", bad))
    with pytest.raises(InputError):
        fastq.read(spark, put(tmp_path / "short.fq", good), alignable=True)
    with pytest.raises(InputError):
        fastq.pair(a, fastq.read(spark, put(tmp_path / "c.fq", "@r1/2\nA\n+\nI\n")))


def test_sam(spark, tmp_path):
    head = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:c\tLN:9\tM5:x\n@RG\tID:a\tSM:s1\n"
    path = put(tmp_path / "a.sam", head + "q\t0\tc\t3\t60\t4M1D2M\t*\t0\t0\tACGTAC\tIIIIII\tNM:i:1\tXG:Z:CT\n")
    h = sam.header(spark, path)
    sam.check_header(h)
    assert sam.sample_name(h, path) == "s1" and sam.sample_name(h, path, "own") == "own"
    r = sam.records(spark, path)
    assert r.first().pos == 2 and r.first().xg == "CT" and r.first().rg is None
    assert [sam.overlapping(r, "c", *span).count() for span in ((0, 2), (0, 3), (8, 9), (9, 12))] == [0, 1, 1, 0]
    sam.write_parquet(r, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    with pytest.raises(InputError):
        sam.check_header(sam.header(spark, put(tmp_path / "b.sam", head.replace("coordinate", "unsorted"))))


def test_sites(spark, tmp_path):
    rows = sites.read_samples(spark, [("a", put(tmp_path / "a.cgmap", "# x\nc\tG\t5\tCHG\tCA\t0.5\t1\t2\n\nc\tC\t9\tCG\tCG\tna\t0\t0\n"))]).orderBy("start").collect()
    assert [(r.start, r.strand, r.modification, r.meth, r.total) for r in rows] == [(4, "-", "m,CHG,0", 1, 2), (8, "+", "m,CG,0", 0, 0)]
    with pytest.raises(Exception):
        sites.bed(spark, put(tmp_path / "b.bed", "c\t5\tx\n")).collect()


def test_paths(tmp_path):
    assert matrix_paths("a/m.bed.gz") == ("a/m.level.bed.gz", "a/m.count.bed.gz")
    assert matrix_paths("m.tsv") == ("m.tsv.level", "m.tsv.count") and matrix_paths("m.bgz") == ("m.level.bgz", "m.count.bgz")
    with pytest.raises(ConfigurationError):
        distinct_paths("a", "b", "./a")
    old, new = tmp_path / "old", tmp_path / "new"
    old.write_text("old")
    new.write_text("new")
    with pytest.raises(PublicationError):
        publish([(str(new), str(old)), (str(tmp_path / "missing"), str(tmp_path / "other"))])
    assert old.read_text() == "old" and not (tmp_path / "other").exists()


def test_command_line_codes(spark, tmp_path):
    assert main(["combine", "-i", "a,b", "-s", "x", "-o", str(tmp_path / "m")]) == 2
    assert main(["call", "meth", "-i", "a.sam", "-r", "b.fa", "-o", "c", "--region", "chr1"]) == 2
    with pytest.raises(SystemExit) as stop:
        main(["nothing"])
    assert stop.value.code == 2
    (tmp_path / "r.fa").write_text(">a\nAXA\n")
    assert main(["index", "-r", str(tmp_path / "r.fa"), "-o", str(tmp_path / "i")]) == 1
