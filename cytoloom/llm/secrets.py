"""Secret scan by dictionary-primed zstandard novelty.

Three pattern families (assignments, access keys, hex runs) give the base spans. Beyond them, every
long token in a sensitive context is compressed twice with a dictionary made of the corpus' own
commonest identifiers: once its surroundings alone, once surroundings and token. What the token adds,
in bytes a character, is its novelty; tokens that neither the surroundings nor the dictionary explain
are reported as kind ``novel``.

Defined results: null text counts as empty; a null id is kept; repeated rows each give a row; an empty
table gives an empty result; further columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .batches import map_slices, slices, tidy
from .scratch import stored

KINDS = ("assign", "access", "hex")

_WORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=~.-]{16,}")
# where a word of an identifier may begin or end: db|Password|Prod, DB|Password
_EDGE = r"(?:(?<![A-Za-z])|(?![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
_SENSITIVE = re.compile("(?=[abcpstABCPST])" + _EDGE + r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|auth(?:orization)?|bearer|signing[ _-]?key|client[ _-]?id)" + _EDGE, re.A)
_STEMS = ("pass", "pwd", "secret", "token", "api", "access", "private", "credential", "auth", "bearer", "signing", "client")
_BLOCK = re.compile(r"(?:\x20BLOCK)?-----", re.A)
# between the lines of a wrapped token, and its shorter last line
_WRAP = re.compile(r"(?:[\s\"'\\,]|(?<=[\s\"'])\+(?=\s)){1,64}", re.A)
_LINE_END = re.compile(r"\n|\\", re.A)
_BLOCK_END = re.compile(r"[\s\"'\\,]*n?-----END", re.A)
_LAST = re.compile(r"(?!n?--)[A-Za-z0-9+/_=~.-]+(?=\x20*(?:[\r\n\"'\\]|\Z))", re.A)
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,}")

#: Identifiers in the dictionary; fixes its size.
DICTIONARY_WORDS = 4096
#: Shares of the identifiers that are ranked apart, and tasks that then rank the best of them.
SHARES, FEW_TASKS = 64, 4
#: Characters of surroundings on each side, and how far from a token the sensitive word or novel token may stand.
AROUND, REACH = 160, 48
#: Least length of a token, and the added bytes a character at which it is novel.
NOVELTY = 0.62
FLUSH_WORDS = 400_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the pattern spans, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(0, *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def identifier_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, docs): documents with each identifier, over the whole table."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            names = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[w] for w in names], pa.int64())], names=["word", "docs"])
            counts.clear()
            return out

        for part in slices(batches, 0):
            for t in part.column(0).to_pylist():
                if t:
                    counts.update(set(_IDENT.findall(t)))
            if len(counts) >= FLUSH_WORDS:
                yield flush()
        if counts:
            yield flush()

    parts = docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "word string, docs bigint")
    return parts.groupBy("word").agg(F.sum("docs").alias("docs"))


def dictionary(docs: DataFrame, text: str = "text", words: int = DICTIONARY_WORDS) -> bytes:
    """The corpus' commonest identifiers, commonest last, where zstandard finds them cheapest."""
    order = (F.desc("docs"), F.col("word"))
    counts = identifier_counts(docs, text).where(F.length("word") <= 40)
    # the best of each of a fixed number of shares first, so that the driver's part doesn't grow with the tasks
    share = Window.partitionBy(F.pmod(F.xxhash64("word"), F.lit(SHARES))).orderBy(*order)
    top = stored(counts.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= words).drop("rank"), "secret-words")
    rows = top.coalesce(FEW_TASKS).orderBy(*order).limit(words).collect()
    return (" ".join(r.word for r in reversed(rows)) + " password=secret token: api_key=").encode()


class Novelty:
    """Marginal compressed size of a token after its surroundings and the dictionary."""

    def __init__(self, content: bytes):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters(compression_level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        data.precompute_compress(compression_params=params)
        self._zip = zstandard.ZstdCompressor(dict_data=data, compression_params=params)

    def __call__(self, before: str, token: str, after: str) -> float:
        ctx = (before + " " + after + " ").encode()
        tok = token.encode()
        return (len(self._zip.compress(ctx + tok)) - len(self._zip.compress(ctx))) / len(tok)


def _candidates(text: str, cues: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, end if novel) of the long tokens, by start.

    A sensitive word cuts a token, but what turns out novel before it goes on to the token's end. Lines of
    one length, with a shorter last one, are one wrapped token.
    """
    out: list[tuple[int, int, int]] = []
    at = lines = rows = done = 0
    for m in _TOKEN.finditer(text):
        (s, end), after = m.span(), done
        if s < done:
            continue
        while at < len(cues) and cues[at][1] <= s:
            at += 1
        cut = at
        while cut < len(cues) and cues[cut][0] < end:
            if cues[cut][0] - s >= 16:
                out.append((s, cues[cut][0], end))
            s = max(s, cues[cut][1])
            cut += 1
        whole, done = s == m.start(), end
        if whole and lines and end - s == lines and (w := _WRAP.fullmatch(text, after, s)) and _LINE_END.search(w[0]):
            out[-1] = (out[-1][0], end, end)
            rows += 1
        elif end - s >= 16:
            out.append((s, end, end))
            lines, rows = end - s if whole else 0, 1
        else:
            lines = 0
            continue
        # the last line is shorter than the others; after a single line only the end of a block shows it
        if lines and (w := _WRAP.match(text, end)) and _LINE_END.search(w[0]) and (t := _LAST.match(text, w.end())) and t.end() - t.start() < lines:
            if rows > 1 or _BLOCK_END.match(text, t.end()):
                done = t.end()
                out[-1] = (out[-1][0], done, done)
                lines = 0
    return out


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int]]:
    """Incompressible tokens that no base span touches near a sensitive word, on either side, or near a
    token found so. A private key's block is sensitive up to its end."""
    low = text.lower()
    cues = [m.span() for m in _SENSITIVE.finditer(text)] if any(w in low for w in _STEMS) else []
    if not cues:
        return []
    near = []
    for s, e in cues:
        block = _BLOCK.match(text, e) if text.startswith("-----BEGIN ", text.rfind("-----", max(0, s - 64), s)) else None
        until = text.find("-----END", e) if block else 0
        near.append((s, len(text) if until < 0 else max(until, e + REACH)))
    tokens = _candidates(text, cues)
    found: dict[int, int | None] = {}  # number of a token measured: its end if it is secret

    def secret(i: int) -> int | None:
        if i not in found:
            s, cut, full = tokens[i]
            token = text[s:cut].rstrip(".-=")
            e = s + len(token) if cut == full else full
            before, after = text[max(0, s - AROUND) : s], text[e : e + AROUND]
            touching = [k for k, bs, be in base if bs < full and s < be]
            if touching:
                # an assigned value or key is a secret found; a bare hex run need not be
                found[i] = full if min(touching) < 2 else None
            else:
                found[i] = e if any(novelty(before, line, after) >= least for line in _TOKEN.findall(token)) else None
        return found[i]

    # forwards from words and tokens to what follows, then backwards to what stands before
    at, reach = 0, -1
    for i, (s, _, _) in enumerate(tokens):
        while at < len(near) and near[at][0] <= s:
            reach = max(reach, near[at][1])
            at += 1
        if s <= reach and (e := secret(i)) is not None:
            reach = max(reach, e + REACH)
    at, reach = len(cues) - 1, len(text) + REACH + 1
    for i in range(len(tokens) - 1, -1, -1):
        s, cut, _ = tokens[i]
        while at >= 0 and cues[at][0] >= cut:
            reach = cues[at][0]
            at -= 1
        if (found.get(i) is not None) or (cut + REACH >= reach and secret(i) is not None):
            reach = s
    out, after = [], 0
    for i, (s, _, full) in enumerate(tokens):
        e = found.get(i)
        if e is not None and s >= after and not any(bs < full and s < be for _, bs, be in base):
            out.append((s, e))
            after = e
    return out


def _spanned(content: bytes):
    """A function of a text that gives all its spans; the compressor is made once a worker."""
    state: list[Novelty] = []

    def spans(text: str) -> list[tuple[str, int, int]]:
        if not state:
            state.append(Novelty(content))
        base = base_spans(text)
        out = [(KINDS[k], s, e, k) for k, s, e in base] + [("novel", s, e, 3) for s, e in novel_spans(text, base, state[0])]
        return [x[:3] for x in sorted(out, key=lambda x: (x[1], x[3]))]

    return spans


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", content: bytes | None = None) -> DataFrame:
    """The id and ``spans`` (array of kind, start, end; by start, then kind) of every document."""
    content = dictionary(docs, text) if content is None else content
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = StructType.fromDDL(f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")
    spans = _spanned(content)

    def run(cols):
        return {"id": cols["id"], "spans": [[dict(zip(("kind", "start", "end"), s)) for s in spans(t or "")] for t in cols["text"]]}

    return map_slices(rows, run, schema, "text").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text: str = "text", length: str | None = None, content: bytes | None = None) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``<SECRET>``; ``length`` follows where it is set.

    Rows, their order of columns and all other columns stay; a null text stays null.
    """
    content = dictionary(docs, text) if content is None else content
    spans = _spanned(content)
    at, size_at = docs.columns.index(text), docs.columns.index(length) if length else None

    def clean(t: str | None) -> str | None:
        end, out = 0, []
        for _, s, e in spans(t or ""):
            if s >= end:
                out += [t[end:s], "<SECRET>"]
            end = max(end, e)
        return "".join(out) + t[end:] if out else t

    def run(batches):
        # all other columns pass as they are
        for part in slices(batches, at):
            columns = list(part.columns)
            old = columns[at].to_pylist()
            new = [clean(t) for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if size_at is not None:
                sizes = [n if a == b else len(b) for n, a, b in zip(columns[size_at].to_pylist(), old, new)]
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; the digest covers the pattern spans alone."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text_of = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"), text_of("spans").alias("spans"))
