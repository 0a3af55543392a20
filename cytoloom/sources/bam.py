"""BAM: header and records of binary alignment files.

Files come through Spark's binary reader, so any store it reaches will do. A file is inflated and decoded
as a stream by one task, at most a batch of records at a time; a sample in several files is read in
parallel. Spark hands over at most 2 GB a file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from . import sam

# Fixed values of the format.
MAGIC, SEQUENCE, OPERATIONS = b"BAM\1", "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_FIXED = struct.Struct("<iiBBHHHiiii")
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
_PAIRS = [a + b for a in SEQUENCE for b in SEQUENCE]
#: Records a batch, and bytes inflated at a time.
BATCH, PIECE = 4096, 1 << 20

RECORD = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string, tags map<string,string>"


class Stream:
    """The inflated bytes of gzip members one after another, taken in order."""

    def __init__(self, content: bytes):
        self._left, self._held, self._at = memoryview(content), bytearray(), 0
        self._zip = zlib.decompressobj(31)

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or as many as there are."""
        while len(self._held) - self._at < n and (self._left or self._zip.unconsumed_tail):
            if self._at > PIECE:
                del self._held[: self._at]
                self._at = 0
            if self._zip.unconsumed_tail:
                self._held += self._zip.decompress(self._zip.unconsumed_tail, PIECE)
            else:
                part, self._left = self._left[:PIECE], self._left[PIECE:]
                self._held += self._zip.decompress(part, PIECE)
            while self._zip.eof and (rest := self._zip.unused_data or bytes(self._left[:PIECE])):
                if not self._zip.unused_data:
                    self._left = self._left[PIECE:]
                self._zip = zlib.decompressobj(31)
                self._held += self._zip.decompress(rest, PIECE)
        out = bytes(self._held[self._at : self._at + n])
        self._at += len(out)
        return out

    def finished(self) -> bool:
        """Whether the last member is a whole one."""
        return self._zip.eof and not self._left

    def whole(self, n: int) -> bytes:
        out = self.take(n)
        if len(out) < n:
            raise InputError("the BAM file ends inside a record")
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.whole(4))[0]


def opened(content: bytes) -> tuple[Stream, str, list[str]]:
    """The stream behind the header, the header's text and the names of the contigs."""
    try:
        stream = Stream(content)
        if stream.take(4) != MAGIC:
            raise InputError("not a BAM file")
        text = stream.whole(stream.number()).rstrip(b"\0").decode()
        names = []
        for _ in range(stream.number()):
            names.append(stream.whole(stream.number())[:-1].decode())
            stream.whole(4)
    except zlib.error as error:
        raise InputError(f"not a BAM file: {error}") from error
    return stream, text, names


def tags_of(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind == "A":
            out[name], at = chr(raw[at]), at + 1
        elif kind in "ZH":
            end = raw.index(0, at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            of, n = _NUMBERS[chr(raw[at])], struct.unpack_from("<i", raw, at + 1)[0]
            size = struct.calcsize(of)
            values = struct.unpack_from("<" + str(n) + of[1], raw, at + 5)
            out[name], at = ",".join([chr(raw[at]), *map(str, values)]), at + 5 + n * size
        else:
            of = _NUMBERS[kind]
            out[name], at = str(struct.unpack_from(of, raw, at)[0]), at + struct.calcsize(of)
    return out


def decoded(raw: bytes, names: list[str]) -> tuple:
    """A record's fields, as those of ``RECORD``."""
    ref, pos, name_size, mapq, _, n_ops, flag, size, mate, mate_pos, span = _FIXED.unpack_from(raw)
    at = _FIXED.size
    qname = raw[at : at + name_size - 1].decode()
    at += name_size
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", raw, at)) or "*"
    at += 4 * n_ops
    seq = "".join(map(_PAIRS.__getitem__, raw[at : at + (size + 1) // 2]))[:size] or "*"
    at += (size + 1) // 2
    quality = raw[at : at + size]
    qual = "*" if not size or quality[0] == 255 else bytes(q + 33 for q in quality).decode()
    of = lambda k: names[k] if k >= 0 else "*"
    return qname, flag, of(ref), pos, mapq, cigar, "=" if mate == ref and mate >= 0 else of(mate), mate_pos, span, seq, qual, list(tags_of(raw[at + size :]).items())


def _rows(content: bytes) -> Iterator[tuple]:
    stream, _, names = opened(content)
    while len(head := stream.take(4)) == 4:
        yield decoded(stream.whole(struct.unpack("<i", head)[0]), names)
    if head or not stream.finished():
        raise InputError("the BAM file ends inside a record")


def header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, tags) of header lines."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(opened(content)[1].splitlines(), pa.string())], names=["value"])

    return sam.header_of(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records as ``sam.records`` gives them."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                held: list[tuple] = []
                for row in _rows(content):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names=names)

    out = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
    return out.withColumn("rg", F.try_element_at("tags", F.lit("RG"))).withColumn("xg", F.try_element_at("tags", F.lit("XG")))
