"""WARC archives: writing, normalising monolithic gzip, and reading by index.

``write_monolithic`` puts a record per page into archives that are each one gzip stream, as careless
crawlers leave them. ``normalise`` inflates every such file once, as a stream, rewrites each record as a
gzip member of its own and writes a sidecar index (a JSON line a record: offset and length of its member,
id, type, digest). ``read_records`` seeks by the index and reads single members.

Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the largest id is a response and
the others are revisits that refer to it.

Files are named by a fresh id and count only once the task that wrote them has handed in its manifest
row, so a task that is repeated leaves at most an unlisted file.

Defined results: a null html is an empty payload; a null url an empty target; rows with equal ids and
payloads that are the largest of their group are all responses; a null id loses to others, and is a
response where the group has none; an empty table gives no files and an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import size_checked, slices
from .scratch import new_folder, stored

#: Least payload that is deduplicated, bytes of a file after which the next begins, compression levels.
REVISIT_BYTES, FILE_BYTES, MONOLITHIC_LEVEL, MEMBER_LEVEL = 1000, 1 << 30, 1, 4
#: Groups of equal payloads up to this number are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 500_000
DATE = "1970-01-01T00:00:00Z"
_CHUNK = 1 << 20


def _where(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record."""
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Id: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


class _Records:
    """Records of an inflated stream, one at a time; holds one record and a chunk."""

    def __init__(self, chunks):
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        for chunk in self.chunks:
            if chunk:
                self.held += chunk
                return True
        return False

    def __iter__(self):
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a record's head")
                    return
            head = parse_head(bytes(self.held[:end]))
            size = end + 4 + int(head["content-length"]) + 4
            while len(self.held) < size:
                if not self._more():
                    raise ValueError("the archive ends inside a record")
            whole = bytes(self.held[:size])
            del self.held[:size]
            yield head, whole


def _inflated(stream):
    """The content of a gzip file, whether it is one stream or many members."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(_CHUNK):
        while data:
            yield unzip.decompress(data, _CHUNK)
            data = unzip.unconsumed_tail or unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
    if tail := unzip.flush():
        yield tail


def decided(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, payload, digest, refers_to, revisit): each page's record type."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    same = rows.where(large).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("m")).where("m > 1").select(F.col("digest").alias("d"), "last")
    out = rows.join(size_checked(stored(same, "warc-same"), BROADCAST_GROUPS), (F.col("digest") == F.col("d")) & large, "left")
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    return out.select("id", "url", "payload", "digest", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Write the records into files of one gzip stream each; a row (path, records) a file."""

    def run(batches):
        fs, base = _where(folder)
        fs.create_dir(base, recursive=True)
        out, done = None, []
        for part in slices(batches, 2):
            for i, url, payload, digest, refers, revisit in zip(*(c.to_pylist() for c in part.columns)):
                if out is None:
                    path, n, size = f"{base}/mono-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, zipped = fs.open_output_stream(path, compression=None), zlib.compressobj(MONOLITHIC_LEVEL, zlib.DEFLATED, 31)
                data = zipped.compress(record(i, url, payload, digest, refers, revisit))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.write(zipped.flush())
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.write(zipped.flush())
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return stored(records.select("id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(run, "path string, records bigint"), "warc-files")


def _file_each(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()))


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each file record by record; a row (path, index, records) a file.

    Works on any WARC gzip, monolithic or of many members; a damaged archive is an error.
    """

    def run(batches):
        fs, base = _where(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for source in b.column(0).to_pylist():
                path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                at = n = 0
                with fs.open_input_stream(source, compression=None) as stream, fs.open_output_stream(path, compression=None) as out, fs.open_output_stream(path + ".index", compression=None) as index:
                    for head, whole in _Records(_inflated(stream)):
                        zipped = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
                        member = zipped.compress(whole) + zipped.flush()
                        out.write(member)
                        line = {"offset": at, "length": len(member), "id": head.get("warc-record-id"), "type": head.get("warc-type"), "digest": head.get("warc-payload-digest"), "url": head.get("warc-target-uri")}
                        index.write(json.dumps(line).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([path + ".index"]), pa.array([n], pa.int64())], names=["path", "index", "records"])

    return stored(_file_each(files.select("path")).mapInArrow(run, "path string, index string, records bigint"), "warc-members")


def read_member(stream, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Head and block of the one record at an offset."""
    stream.seek(offset)
    whole = zlib.decompress(stream.read(length), 31)
    end = whole.index(b"\r\n\r\n")
    head = parse_head(whole[:end])
    return head, whole[end + 4 : end + 4 + int(head["content-length"])]


def read_records(files: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """A row a record: page_id, payload_bytes, payload_digest, record_type, refers_to (ids as text), and
    the payload of responses if asked for.

    A response's length and digest are taken from its payload; a revisit's from its head.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]

    def rows(fs, path, index):
        with fs.open_input_stream(index, compression=None) as f:
            lines = f.read().decode().splitlines()
        with fs.open_input_file(path) as stream:
            for line in map(json.loads, lines):
                head, block = read_member(stream, line["offset"], line["length"])
                body = block[block.index(b"\r\n\r\n") + 4 :]
                if head["warc-type"] == "response":
                    size, digest = len(body), hashlib.sha1(body).hexdigest()
                else:
                    size, digest, body = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), None
                yield (head.get("x-page-id"), size, digest, head["warc-type"], head.get("x-refers-to-id"), body)[: len(names)]

    def run(batches):
        fs, _ = _where(folder)
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            for path, index in zip(*(c.to_pylist() for c in b.columns)):
                held, size = [], 0
                for row in rows(fs, path, index):
                    held.append(row)
                    size += row[1] if payload else 1000
                    if size >= 8 * _CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return _file_each(files.select("path", "index")).mapInArrow(run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages into monolithic archives, normalise these, and read every record back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "warc")
    files = write_monolithic(decided(pages), f"{folder}/monolithic")
    kind = pages.schema["page_id"].dataType
    read = read_records(normalise(files, f"{folder}/members"), folder)
    return read.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


OP6_SQL = """
with p as (
  select page_id, coalesce(html, '') as html from pages
), d as (
  select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as payload_digest from p
), g as (
  select *, max(page_id) over (partition by payload_digest) as last from d
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and last is not null and page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id is distinct from last then last end as refers_to
from g
"""
