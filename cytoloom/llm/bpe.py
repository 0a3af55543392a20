"""Byte-level BPE by monoid tree reduction.

The encodings of byte strings form a monoid: ``join(enc(x), enc(y)) == enc(x + y)``. A piece (one match
of the split pattern) is cut in halves down to short leaves, leaves are merged by rank, and neighbours
are joined up the tree. A join re-encodes a window around the seam and grows it until the tokens
outside are provably stable: a token sequence is the encoding of its bytes exactly if every adjacent
pair of tokens is the encoding of the pair's bytes, so once the window's ends pair up with their outer
neighbours, nothing further out can change. Decoding concatenates up a tree, too.

Defined results: null text counts as empty (no tokens); a null id is kept; repeated rows each give a
row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import slices, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Longest leaf in bytes. Pieces up to this length never need a join.
LEAF_BYTES = 24
#: Neighbours that one node of the decoding tree puts together; bytes need no re-encoding, so nodes are wide.
FAN = 64
#: Encoded pieces a worker remembers; the memory is emptied when full.
CACHED_PIECES = 400_000


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._packed = _Packed(self)

    @classmethod
    def load(cls, path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        return cls(ranks, pattern)

    def forget(self) -> None:
        """Empty the memory of pieces and pairs."""
        self._packed.clear()
        self._pairs.clear()

    def leaf(self, piece: bytes) -> list[int]:
        """The encoding of a short piece; one that is a token is that token."""
        whole = self.ranks.get(piece)
        return self.merge(piece) if whole is None else [whole]

    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours, leftmost first, until none can be merged."""
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1])

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side are the encoding of their bytes."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= CACHED_PIECES:
                self._pairs.clear()
            known = self._pairs[a, b] = self.leaf(self.words[a] + self.words[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of ``left`` followed by those of ``right``."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.leaf(b"".join(self.words[t] for t in left[-i:] + right[:j]))
            fixed_l = i == len(left) or self.stable(left[-i - 1], window[0])
            fixed_r = j == len(right) or self.stable(window[-1], right[j])
            if fixed_l and fixed_r:
                return left[:-i] + window + right[j:]
            i, j = i + (0 if fixed_l else i), j + (0 if fixed_r else j)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tree reduction over one piece, without recursion: leaves first, then level by level."""
        if len(piece) <= LEAF_BYTES:
            return self.leaf(piece)
        # halves of halves, as often as it takes for none to be longer than a leaf
        n = len(piece)
        depth = (-(-n // LEAF_BYTES) - 1).bit_length()
        cuts = [n * i >> depth for i in range((1 << depth) + 1)]
        level = [self.leaf(piece[a:b]) for a, b in zip(cuts, cuts[1:])]
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        return level[0]

    def encode_packed(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers.

        Between pieces nothing merges, so up there a join is plain concatenation.
        """
        return b"".join(map(self._packed.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The tokens' bytes, put together up a tree whose nodes have ``FAN`` children."""
        level = [self.words[t] for t in ids]
        while len(level) > 1:
            level = [b"".join(level[k : k + FAN]) for k in range(0, len(level), FAN)]
        return level[0] if level else b""


class _Packed(dict):
    """Piece to packed ids; computes what is missing."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = np.array(self.codec.encode_piece(raw), "<u4").tobytes()
        if len(raw) <= 64:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


_codecs: dict[str, Codec] = {}


def codec(name: str = VOCABULARY) -> Codec:
    """The codec of a public rank file or a path; one a process."""
    if name not in _codecs:
        _codecs[name] = Codec.load(name if "/" in name else public_tokenizers.path(name))
    return _codecs[name]


def tokenise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, keep_ids: bool = True) -> DataFrame:
    """Id, ``ids`` (array, unless dropped), ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``round_trip``.

    ``decoded_sha256`` is taken from the bytes that decoding the ids gives back.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", *["ids"] * keep_ids, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    ddl = f"id {id_type}, " + "ids array<int>, " * keep_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def run(batches):
        bpe = codec(vocabulary)
        for part in slices(batches, 1):
            ids, n, hashed, decoded, same = [], [], [], [], []
            for t in part.column(1).to_pylist():
                packed = bpe.encode_packed(t or "")
                got = np.frombuffer(packed, "<u4")
                raw = bpe.decode(got.tolist())
                ids.append(got.astype(np.int32) if keep_ids else None)
                n.append(len(got))
                hashed.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
                same.append(raw == (t or "").encode())
            cols = [part.column(0), *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(tidy(run, lambda: codec(vocabulary).forget()), ddl).withColumnRenamed("id", id_col)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    out = tokenise(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
