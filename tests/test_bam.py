"""BAM against SAM: the same records, header and calls, block by block."""

import gzip
import random
import struct

import pytest

from cytoloom import api
from cytoloom.sinks import bam as sink
from cytoloom.sources import bam, sam

HEAD = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:one\tLN:5000\tM5:x", "@SQ\tSN:two\tLN:90000\tM5:y", "@RG\tID:g\tSM:s"]


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(4)
    out = []
    for i in range(3000):
        n = rng.randint(1, 90)
        seq = "".join(rng.choices("ACGTN", k=n))
        qual = "*" if i % 11 == 0 else "".join(chr(33 + rng.randint(0, 41)) for _ in range(n))
        where = ("*", "0", "*") if i % 17 == 0 else (rng.choice(["one", "two"]), str(rng.randint(1, 4000)), f"{n}M" if i % 3 else f"{n}S7D")
        mate = ("=", str(rng.randint(1, 4000))) if i % 2 and where[0] != "*" else ("*", "0")
        tags = ["XG:Z:CT", f"NM:i:{rng.randint(-5, 70000)}", "ZA:A:q"] + ["ZB:B:s,1,-2,300"] * (i % 5 == 0)
        out.append("\t".join([f"r{i}", str(rng.randrange(4096)), *where[:2], str(rng.randint(0, 255)), where[2], *mate, str(rng.randint(-900, 900)), seq, qual, *tags]))
    return out


def test_round_trip_gives_the_records_of_the_text(spark, lines, tmp_path):
    rows = spark.createDataFrame(list(enumerate(lines)), "n bigint, row string").repartition(5)
    sink.write_bam(rows, str(tmp_path / "a.bam"), ["n"], HEAD)
    (tmp_path / "a.sam").write_text("\n".join([*HEAD, *lines]) + "\n")
    show = lambda df: [str(r) for r in df.withColumn("tags", df.tags.cast("string")).orderBy("qname").collect()]
    assert show(bam.records(spark, str(tmp_path / "a.bam"))) == show(sam.records(spark, str(tmp_path / "a.sam")))
    assert [r.qname for r in bam.records(spark, str(tmp_path / "a.bam")).collect()] == [f"r{i}" for i in range(len(lines))]
    heads = [sorted(map(str, m.header(spark, str(tmp_path / f"a.{x}")).collect())) for m, x in ((bam, "bam"), (sam, "sam"))]
    assert heads[0] == heads[1]


def test_blocks_follow_the_format(spark, lines, tmp_path):
    rows = spark.createDataFrame(list(enumerate(lines)), "n bigint, row string")
    sink.write_bam(rows, str(tmp_path / "b.bam"), ["n"], HEAD)
    raw, at, sizes = (tmp_path / "b.bam").read_bytes(), 0, []
    while at < len(raw):
        assert raw[at : at + 4] == b"\x1f\x8b\x08\x04" and raw[at + 12 : at + 14] == b"BC"
        size = struct.unpack_from("<H", raw, at + 16)[0] + 1
        sizes.append(len(gzip.decompress(raw[at : at + size])))
        at += size
    assert at == len(raw) and sizes[-1] == 0 and max(sizes) <= 65_536 and len(sizes) > 5
    assert gzip.decompress(raw)[:4] == b"BAM\1"


def test_bins_are_the_smallest_that_hold_a_range():
    rng = random.Random(2)
    first = [0, 1, 9, 73, 585, 4681]
    for _ in range(300):
        s = rng.randrange(1 << 29)
        e = min(s + rng.choice((1, 50, 20_000, 200_000, 5_000_000)), 1 << 29)
        got = sink.bin_of(s, e)
        level = max(k for k in range(6) if first[k] <= got)
        size = 1 << (29 - 3 * level)
        assert (got - first[level]) * size <= s and e <= (got - first[level] + 1) * size
        assert level == 5 or s // (size >> 3) != (e - 1) // (size >> 3)


@pytest.mark.parametrize("spoil", [lambda b: b"no bam", lambda b: b[:200], lambda b: gzip.compress(b"other")])
def test_broken_files_are_errors(spark, lines, tmp_path, spoil):
    rows = spark.createDataFrame(list(enumerate(lines[:50])), "n bigint, row string")
    sink.write_bam(rows, str(tmp_path / "c.bam"), ["n"], HEAD)
    (tmp_path / "d.bam").write_bytes(spoil((tmp_path / "c.bam").read_bytes()))
    with pytest.raises(Exception):
        bam.records(spark, str(tmp_path / "d.bam")).collect()


def test_calls_of_a_bam_equal_those_of_its_text(spark, tmp_path):
    rng = random.Random(7)
    genome = "".join(rng.choices("ACGT", k=300))
    (tmp_path / "r.fa").write_text(f">g\n{genome}\n")
    reads = [genome[s : s + 60].replace("C", "T") for s in range(0, 240, 6)]
    (tmp_path / "r.fq").write_text("".join(f"@q{i}\n{r}\n+\n{'I' * 60}\n" for i, r in enumerate(reads)))
    for kind in ("sam", "bam"):
        api.align(spark, str(tmp_path / "r.fa"), str(tmp_path / "r.fq"), None, str(tmp_path / f"x.{kind}"), adapter=None)
    body = [x for x in (tmp_path / "x.sam").read_text().splitlines()]
    head = [x.replace("SO:unsorted", "SO:coordinate") for x in body if x.startswith("@")]
    body = sorted((x for x in body if not x.startswith("@")), key=lambda x: int(x.split("\t")[3]))
    assert bam.records(spark, str(tmp_path / "x.bam")).count() == len(body) == len(reads)
    (tmp_path / "s.sam").write_text("\n".join([*head, *body]) + "\n")
    sink.write_bam(spark.createDataFrame(list(enumerate(body)), "n bigint, row string"), str(tmp_path / "s.bam"), ["n"], head)
    for kind in ("sam", "bam"):
        api.call_meth(spark, str(tmp_path / f"s.{kind}"), str(tmp_path / "r.fa"), str(tmp_path / f"{kind}.bed"))
    assert (tmp_path / "sam.bed").read_bytes() == (tmp_path / "bam.bed").read_bytes() and (tmp_path / "sam.bed").stat().st_size
