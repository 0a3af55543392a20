"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit a dimension, its sign. Codes are cut into segments; an index lists, for each
segment and value, the codes that have it. For a query the segments are searched in growing radius: after
all segments have been searched to radius r, every code within (r + 1) * segments - 1 bits has been seen,
so the search ends as soon as the k-th verified distance is covered, and its result is exact.

Rows with equal codes are one entry that keeps the k + 1 least ids (ties go to the lesser id, and no
result can name more); a hot vector therefore costs one entry. Entries are dealt into shards of bounded
size by a hash. A shard's entries are moved once, its index is made once, and the queries then pass by it
as a stream; the shards' k best are merged. Only a table of few shards gives each several tasks.

Defined results: a null or empty vector, or one with a null or NaN component, is neither found nor a
query; a null id is no query and is never found; fewer than k other rows give fewer ranks; repeated ids
count once per code; vectors of another length than the commonest are compared only with their own
length; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from .batches import slices, tidy
from .scratch import stored

K, EVERY = 10, 50
#: Bits a segment (its index has 2 ** bits heads), entries a shard, and tasks that a table of few shards is
#: given; no entry is copied more often than that, and none in a table of as many shards.
SEGMENT_BITS, SHARD_ENTRIES, LEAST_TASKS = 16, 65_536, 8


def coded(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, code, bits): the sign bits of each usable vector, 64 to a bigint of the array."""
    v = F.col(vector)
    usable = F.size(v) > 0
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    rows = vectors.where(v.isNotNull() & usable & whole & F.col(id_col).isNotNull())
    word = lambda k: F.aggregate(F.slice(v, k * 64 + 1, F.lit(64)), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")))
    return rows.select(F.col(id_col).alias("id"), F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / 64).cast("int")), word).alias("code"), F.size(v).alias("bits"))


def _unpacked(codes: list) -> np.ndarray:
    return np.array(codes, np.int64).reshape(len(codes), -1).view(np.uint64)


def _segments(words: np.ndarray, segments: int) -> np.ndarray:
    per = 64 // SEGMENT_BITS
    out = np.stack([(words[:, s // per] >> np.uint64(SEGMENT_BITS * (s % per))) & np.uint64((1 << SEGMENT_BITS) - 1) for s in range(segments)], 1)
    return out.astype(np.int64)


def _flips(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT_BITS), radius)], np.int64)


class MultiIndex:
    """Entries of one shard, found by the values of their segments."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.segments = words.shape[1] * 64 // SEGMENT_BITS
        values = _segments(words, self.segments)
        self.order = [np.argsort(values[:, s], kind="stable") for s in range(self.segments)]
        self.heads = [np.searchsorted(values[o, s], np.arange((1 << SEGMENT_BITS) + 1)) for s, o in enumerate(self.order)]
        self._masks: list[np.ndarray] = []

    def search(self, query: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and distances that surely hold the k nearest rows; an entry stands for ``weights`` rows."""
        own = _segments(query[None], self.segments)[0]
        seen = np.zeros(len(self.words), bool)
        found: list[np.ndarray] = []
        rows_at = np.zeros(64 * len(query) + 1, np.int64)
        for radius in range(SEGMENT_BITS + 1):
            if radius == len(self._masks):
                self._masks.append(_flips(radius))
            for s in range(self.segments):
                probe = own[s] ^ self._masks[radius]
                lo, hi = self.heads[s][probe], self.heads[s][probe + 1]
                n = hi - lo
                total = int(n.sum())
                if total:
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                    new = self.order[s][at]
                    new = new[~seen[new]]
                    if len(new):
                        seen[new] = True
                        d = np.bitwise_count(self.words[new] ^ query).sum(1).astype(np.int64)
                        found.append(np.stack([new, d]))
                        rows_at += np.bincount(d, weights[new], len(rows_at)).astype(np.int64)
                # all segments up to s have been searched to this radius, the rest to one less
                covered = self.segments * radius + s
                if rows_at[: covered + 1].sum() >= k:
                    both = np.concatenate(found, 1)
                    last = int(np.searchsorted(np.cumsum(rows_at), k))
                    near = both[1] <= last
                    return both[0][near], both[1][near]
        both = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest other rows of each query row, by distance
    and then id."""
    w = Window.partitionBy("bits", "code").orderBy("id")
    # the limit is applied before the shuffle, so a hot code sends k + 1 rows a task
    kept = coded(vectors, id_col, vector).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    entries = stored(kept.groupBy("bits", "code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mih-entries")
    asked = stored(coded(queries, id_col, vector).distinct(), "mih-asked")
    codes = asked.select("bits", "code").distinct()
    shards = max(1, -(-entries.count() // SHARD_ENTRIES))
    copies = -(-LEAST_TASKS // shards)
    deal = lambda n, salt: F.pmod(F.xxhash64("code", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select("bits", deal(shards, "shard").alias("shard"), every(copies).alias("copy"), F.lit(0).alias("asked"), "code", "ids")
    right = codes.select("bits", every(shards).alias("shard"), deal(copies, "copy").alias("copy"), F.lit(1).alias("asked"), "code", F.lit(None).cast(entries.schema["ids"].dataType).alias("ids"))
    id_type = entries.schema["ids"].dataType.elementType
    schema = StructType([*[f for f in entries.schema.fields if f.name in ("bits", "code")], StructField("neighbour_id", id_type), StructField("distance", IntegerType())])
    arrow = to_arrow_schema(schema)

    def search(batches):
        key, index = None, None
        words, ids, weights = [], [], None
        for part in slices(batches):
            bits, shard, copy, asked, code, own = (part.column(i).to_pylist() for i in range(6))
            out = []
            for b, *where, is_query, c, listed in zip(bits, shard, copy, asked, code, own):
                if (b, *where) != key:
                    key, index, words, ids = (b, *where), None, [], []
                if not is_query:
                    words.append(c)
                    ids.append(listed)
                    continue
                if not words:
                    continue
                if index is None:
                    index, weights = MultiIndex(_unpacked(words)), np.array([len(x) for x in ids])
                at, d = index.search(np.asarray(c, np.int64).view(np.uint64), weights, k + 1)
                out += [(b, c, i, dd) for dd, i in sorted((int(dd), i) for a, dd in zip(at.tolist(), d.tolist()) for i in ids[a])[: k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(list(zip(*out)) or [()] * 4, arrow)], schema=arrow)

    # entries come before the queries of their shard
    dealt = left.unionByName(right).repartition("bits", "shard", "copy").sortWithinPartitions("bits", "shard", "copy", "asked")
    near = dealt.select("bits", "shard", "copy", "asked", "code", "ids").mapInArrow(tidy(search), schema)
    best = Window.partitionBy("bits", "code").orderBy("distance", "neighbour_id")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    # equal queries share one search; each then leaves itself out
    pairs = asked.join(near, ["bits", "code"]).where("id != neighbour_id")
    own = Window.partitionBy("id", "bits", "code").orderBy("distance", "neighbour_id")
    out = pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select(F.col("id").alias("query_id"), "rank", "neighbour_id", "distance")


def op9_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every row whose id is divisible by 50, against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP9_SQL = """
with v as (
  select distinct vec_id, embedding from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0
), b as (
  select vec_id, len(embedding) as bits, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as code from v
), p as (
  select q.vec_id as query_id, n.vec_id as neighbour_id,
    cast(list_sum(list_transform(list_zip(q.code, n.code), lambda z: abs(z[1] - z[2]))) as integer) as distance
  from b q join b n on q.bits = n.bits and q.vec_id <> n.vec_id where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by distance, neighbour_id) as integer) as rank, neighbour_id, distance from p
)
select query_id, rank, neighbour_id, distance from r where rank <= 10
"""
