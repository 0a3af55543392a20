"""BAM output: SAM lines encoded in the tasks as BGZF blocks, strung together behind the header."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import OutputError
from ..sources.bam import MAGIC, OPERATIONS, SEQUENCE, _FIXED

_CODE = {c: i for i, c in enumerate(SEQUENCE)}
#: Inflated bytes a block at most, so that the deflated ones surely fit the format's 16-bit size.
BLOCK = 0xFF00


def block(raw: bytes) -> bytes:
    """One BGZF member of at most BLOCK bytes."""
    zipped = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = zipped.compress(raw) + zipped.flush()
    head = struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(data) + 25)
    return head + data + struct.pack("<II", zlib.crc32(raw), len(raw))


def blocks(raw: bytes) -> Iterable[bytes]:
    for at in range(0, len(raw), BLOCK):
        yield block(raw[at : at + BLOCK])


def encoded_header(lines: list[str]) -> bytes:
    text = "".join(x + "\n" for x in lines).encode()
    out = [MAGIC, struct.pack("<i", len(text)), text]
    contigs = [dict(f.split(":", 1) for f in x.split("\t")[1:]) for x in lines if x.startswith("@SQ")]
    out.append(struct.pack("<i", len(contigs)))
    for c in contigs:
        name = c["SN"].encode() + b"\0"
        out += [struct.pack("<i", len(name)), name, struct.pack("<i", int(c["LN"]))]
    return b"".join(out)


def bin_of(start: int, end: int) -> int:
    """The smallest bin of the format's index that holds a range: 16,384 bases a bin, eight times that a level."""
    for level in range(5, -1, -1):
        shift = 14 + 3 * (5 - level)
        if start >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def encoded_tag(text: str) -> bytes:
    name, kind, value = text.split(":", 2)
    raw = name.encode()
    if kind == "A":
        return raw + b"A" + value.encode()
    if kind == "i":
        return raw + b"i" + struct.pack("<i", int(value))
    if kind == "f":
        return raw + b"f" + struct.pack("<f", float(value))
    if kind in "ZH":
        return raw + kind.encode() + value.encode() + b"\0"
    of, *values = value.split(",")
    code = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[of]
    return raw + b"B" + of.encode() + struct.pack(f"<i{len(values)}{code}", len(values), *[(float if of == "f" else int)(v) for v in values])


def encoded(line: str, order: dict[str, int]) -> bytes:
    """One SAM line as a record with its size."""
    qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, *tags = line.split("\t")
    ref = order.get(rname, -1)
    mate = ref if rnext == "=" else order.get(rnext, -1)
    ops, n, span = [], "", 0
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            n += c
        else:
            ops.append(int(n) << 4 | OPERATIONS.index(c))
            span += int(n) if c in "MDN=X" else 0
            n = ""
    start = int(pos) - 1
    name = qname.encode() + b"\0"
    bases = "" if seq == "*" else seq
    codes = [_CODE.get(b, 15) for b in bases.upper()]
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], [*codes[1::2], 0]))
    quality = b"\xff" * len(bases) if qual == "*" else bytes(q - 33 for q in qual.encode())
    fixed = _FIXED.pack(ref, start, len(name), int(mapq), bin_of(start, start + max(span, 1)) if start >= 0 else 4680, len(ops), int(flag), len(bases), mate, int(pnext) - 1, int(tlen))
    body = fixed + name + struct.pack(f"<{len(ops)}I", *ops) + packed + quality + b"".join(map(encoded_tag, tags))
    return struct.pack("<i", len(body)) + body


def write_bam(rows: DataFrame, path: str, order: list, header: Iterable[str]) -> None:
    """SAM lines (column ``row``) as one BAM file in the order of the columns of ``order``.

    Tasks sort, encode and deflate their ranges; the driver only strings the finished blocks together. The
    old file is replaced in one step or not at all.
    """
    lines = list(header)
    index = {x.split("\tSN:", 1)[1].split("\t", 1)[0]: i for i, x in enumerate(x for x in lines if x.startswith("@SQ"))}
    aside = f"{path}.{uuid.uuid4().hex}"
    parts = aside + ".parts"

    def run(batches):
        held, n = bytearray(), 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                held += encoded(line, index)
            made = []
            while len(held) >= BLOCK:
                made.append(block(bytes(held[:BLOCK])))
                del held[:BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(made)), pa.int64()), pa.array(made, pa.binary())], names=["n", "block"])
            n += len(made)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([block(bytes(held))], pa.binary())], names=["n", "block"])

    try:
        spark = rows.sparkSession
        made = rows.orderBy(*order).select("row").mapInArrow(run, "n bigint, block binary")
        made.withColumn("part", F.spark_partition_id()).write.parquet(parts)
        with open(aside, "wb") as out:
            for b in blocks(encoded_header(lines)):
                out.write(b)
            for r in spark.read.parquet(parts).orderBy("part", "n").select("block").toLocalIterator():
                out.write(r.block)
            out.write(block(b""))
        os.replace(aside, path)
    except OSError as error:
        raise OutputError(str(error)) from error
    finally:
        shutil.rmtree(parts, ignore_errors=True)
        if os.path.exists(aside):
            os.remove(aside)
