"""Exact Jaccard similarity join on word n-grams, and its connected groups.

Documents with equal n-gram sets form one class, and only classes are compared. All n-grams stand in one
global order, rare first. It is made in two steps, so that counts are exact where they matter and no
n-gram outside a prefix is shuffled:

1. By a count sketch of fixed size over the whole corpus (its logarithm, then the hash). Sets at or over
   the threshold share ``l`` n-grams within the first ``n - ceil(t n) + l`` of each; such *extended
   prefixes* are dealt by n-gram, which gives the exact number of classes that name each.
2. Within its extended prefix a class orders its n-grams by that number. As similar classes share ``l`` of
   them, the rarest few must hold a shared one (*prefix filter* again, now with exact counts). N-grams no
   other class names come first, so a class with enough of its own has no candidate at all.

Pairs must pass the *length* and *positional* filters in the join, then the *suffix* filter (what follows
the extended prefixes is cut at pivots, and the pieces bound what it can share), and are verified once
on whole sets.

A token's pairs are not listed where it is named by many. Up to ``FEW`` classes are compared with one
another, at most a few pairs a row; of more, each is compared with one centre, the class that shares
most. Two classes x, y of such a group that no link with the centre c joins are found by their
*differences* from it: with D = x xor c, |Dx ^ Dy| = (|Dx| + |Dy| - |x xor y|) / 2, so similar x and y must
share a number of differences that is over a half of them, mostly, and the same prefix and positional
filters hold for differences (those not in the centre first, as they are rare). Copies each changed in
their own way share no such prefix, so a group of near copies costs rows in proportion to its size, and
the result is exact.

Defined results: a null or wordless text has an empty set and links with nothing; fewer words than n
make one n-gram of the whole sequence; equal documents are one class, so ties cost nothing; null ids
keep their links and lose to others when the least id of a group is taken; an empty table gives an empty
result; further columns are ignored by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import free_names, size_checked, slices, tidy
from .components import components
from .scratch import discard, stored

CACHED_WORDS = 400_000
#: log2 of the cells of the count sketch, and bits of an n-gram's key that hold the logarithm of its count.
SKETCH_BITS, RANK_BITS = 20, 5
#: A token at over so many times the mean of the sketch's cells, and this count, is dealt over tasks by its
#: classes; of others a task counts up to HELD rows and then lets them pass with that count.
HEAVY_TIMES, HEAVY_LEAST, HEAVY_SPREAD, HELD = 8, 2_000, 64, 4_096
#: A token's classes are compared with one another up to this number, and with a centre beyond it.
FEW = 8
#: Pieces that the suffix filter cuts a set into.
PIECES = 64
#: Ids, and pairs, up to these numbers are broadcast; more are joined by shuffle.
BROADCAST_IDS, BROADCAST_PAIRS = 1_000_000, 50_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)


@dataclass(frozen=True)
class Shape:
    """Words a shingle and the threshold in hundredths."""

    words: int = 4
    percent: int = 85

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def shared(self, n: int) -> int:
        """How many n-grams of its extended prefix a set of n shares with any similar one, if that is no smaller."""
        p = self.prefix(n)
        return max(1, min(p // 2, n - p + 1))

    def extended(self, n: int) -> int:
        return self.prefix(n) - 1 + self.shared(n)

    def sql(self, n: str) -> tuple[str, str, str]:
        """``shared``, ``extended`` and the number of rarest n-grams to join on, as SQL of column ``n``."""
        t = self.percent
        prefix = lambda x: f"({x} - int(({t}L * {x} + 99) div 100) + 1)"
        shared = lambda x: f"greatest(1, least(int({prefix(x)} div 2), {x} - {prefix(x)} + 1))"
        extended = f"({prefix(n)} - 1 + {shared(n)})"
        # a similar set may be smaller and so share fewer
        smallest = f"greatest(1, int(({t}L * {n} + 99) div 100))"
        return shared(n), extended, f"({extended} - {shared(smallest)} + 1)"

    def apart(self, total):
        """The most n-grams in which two similar sets of ``total`` n-grams together may differ."""
        return total - 2 * -(-self.percent * total // (100 + self.percent))

    def differences(self, d: int, n: int, centre: int) -> tuple[int, int]:
        """Least numbers of differences from a centre that a set shares with a similar one: of any set, and of
        one not similar to the centre; one of the two must be such."""
        other = np.arange(-(-self.percent * n // 100), 100 * n // self.percent + 1)
        apart = self.apart(n + other)
        some = max(1, d - int(apart.max()))
        # sizes and differences are odd or even together, so a set not similar is at least two over the limit
        return some, max(some, int(((d + 3 + self.apart(other + centre) - apart) // 2).min()))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _forget() -> None:
    # a function of the module, so that a worker empties its own memory and not a copy
    _hashes.clear()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles; A-Z lower-cased, split at ASCII white space."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        # a position beyond the table's end mixes its factor once more
        f = _MIX[i % len(_MIX)] + np.uint64(2 * (i // len(_MIX)))
        part = h[i : len(h) - k + 1 + i] * f
        out += part ^ (part >> np.uint64(32))
        out *= _MIX[1]
    out ^= out >> np.uint64(29)
    return np.unique(out * _MIX[0])


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _class(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(h.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _signatures(docs: DataFrame, shape: Shape) -> tuple[DataFrame, np.ndarray]:
    """(id, of, n, c1, c2) of each document, and the sketch of all n-gram occurrences; ``of`` is the text's hash."""
    names = ["id", "of", "n", "c1", "c2", "sketch"]
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        arrow_id = None
        for part in slices(batches, 2):
            arrow_id = part.column(0).type
            n, c1, c2, hs = [], [], [], []
            for t in part.column(2).to_pylist():
                h = shingles(t, shape.words)
                a, b = _class(h) if len(h) else (None, None)
                n.append(len(h))
                c1.append(a)
                c2.append(b)
                hs.append(h)
            counts += np.bincount(_cells(np.concatenate(hs)), minlength=len(counts)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.nulls(len(n), pa.binary())], names=names)
        if arrow_id is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow_id), *[pa.nulls(1, pa.int64())] * 4, pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=names)

    both = stored(docs.select("id", "of", "text").mapInArrow(tidy(run, _forget), f"id {id_type}, of bigint, n bigint, c1 bigint, c2 bigint, sketch binary"), "ngram-sets")
    return both.where("sketch is null").drop("sketch"), _merged(both.where("sketch is not null").select("sketch"))


def _merged(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches, by a tree of tasks that each read a few."""

    def run(batches):
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                one = np.frombuffer(zlib.decompress(x), np.uint32)
                total = one.astype(np.uint64) if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)], pa.binary())], names=["sketch"])

    left = parts.count()
    while left > 1:
        to = -(-left // 16)
        parts = stored(parts.coalesce(to).mapInArrow(tidy(run), "sketch binary"), "ngram-sketch")
        left = parts.count()
    row = parts.first()
    return np.frombuffer(zlib.decompress(row[0]), np.uint32) if row else np.zeros(1 << SKETCH_BITS, np.uint32)


def _ordered(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys of the n-grams in the sketch's order: the logarithm of the count, then the hash; sorted."""
    rank = np.frexp(counts[_cells(h)].astype(np.float64))[1].astype(np.uint64)
    keys = np.minimum(rank, np.uint64((1 << RANK_BITS) - 1)) << np.uint64(64 - RANK_BITS) | h >> np.uint64(RANK_BITS)
    return np.unique(keys)


def _prefixes(docs: DataFrame, sketch: np.ndarray, shape: Shape) -> DataFrame:
    """(tok, c1, c2, n, heavy): the extended prefix of each class; a task names a class once.

    ``heavy`` is the sketch's count of a token that is too common to be counted in one task, else 0.
    """
    names = ["tok", "c1", "c2", "n", "heavy"]
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    heavy_at = max(HEAVY_LEAST, HEAVY_TIMES * float(sketch.mean()))

    def run(batches):
        counts, seen = shared.value, set()
        for part in slices(batches, 0):
            toks, heavy, sizes, ids = [], [], [], []
            for t in part.column(0).to_pylist():
                h = shingles(t, shape.words)
                if not len(h) or (c := _class(h)) in seen:
                    continue
                if len(seen) >= CACHED_WORDS:
                    seen.clear()
                seen.add(c)
                keys = _ordered(h, counts)
                first = keys[: shape.extended(len(keys))]
                # the cell is the top of the hash, which the key holds below its rank
                freq = counts[(first << np.uint64(RANK_BITS) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                toks.append(first)
                heavy.append(np.where(freq >= heavy_at, np.minimum(freq, 2**30), 0))
                sizes.append(len(first))
                ids.append((*c, len(keys)))
            if ids:
                rep = [np.repeat(np.array(x, np.int64), sizes) for x in zip(*ids)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).view(np.int64)), pa.array(rep[0]), pa.array(rep[1]), pa.array(rep[2].astype(np.int32)), pa.array(np.concatenate(heavy).astype(np.int32))], names=names)

    return docs.select("text").mapInArrow(tidy(run, _forget), "tok bigint, c1 bigint, c2 bigint, n int, heavy int")


def _counted(rows: DataFrame) -> DataFrame:
    """(tok, c1, c2, n, often) of the tokens that more than one class names, each class once.

    ``often`` orders tokens by the number of their classes. Tokens are gathered by a shuffle and read as a
    sorted stream, of which at most HELD rows are held; a token of more has that count in all its rows, and
    heavy tokens, dealt over several tasks, have the sketch's above it. So a token's value is the same in
    all its rows, as the prefix filter needs.
    """
    names = ["tok", "c1", "c2", "n", "often"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        now = last = None  # token of the open group, and its last class
        n_held, over = 0, False

        def out(batch, often):
            return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(often.astype(np.int32))], names=names)

        def close():
            if not over and held:
                k = n_held
                heavy = held[0].column(4)[0].as_py()
                if k > 1 or heavy:
                    yield from (out(b, np.full(b.num_rows, HELD + heavy if heavy else k)) for b in held)

        for batch in batches:
            tok, c1, c2 = (batch.column(i).to_numpy() for i in range(3))
            if not len(tok):
                continue
            fresh = np.append(True, (tok[1:] != tok[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))
            fresh[0] = (int(tok[0]), int(c1[0]), int(c2[0])) != last
            last = (int(tok[-1]), int(c1[-1]), int(c2[-1]))
            if not fresh.all():
                batch, tok = batch.filter(pa.array(fresh)), tok[fresh]
            at = 0
            while at < len(tok):
                if now is None or tok[at] != now:
                    yield from close()
                    held, n_held, over, now = [], 0, False, None
                    # whole groups up to the last one, which may go on in the next batch
                    end = int(np.searchsorted(tok, tok[-1], "left"))
                    if end > at:
                        part, mine = batch.slice(at, end - at), tok[at:end]
                        group = np.cumsum(np.append(True, mine[1:] != mine[:-1])) - 1
                        k = np.bincount(group)[group]
                        heavy = part.column(4).to_numpy()
                        often = np.where(heavy > 0, HELD + heavy, np.minimum(k, HELD))
                        many = (k > 1) | (heavy > 0)
                        yield out(part.filter(pa.array(many)), often[many])
                        at = end
                    now = tok[at]
                end = int(np.searchsorted(tok, now, "right"))
                part, at = batch.slice(at, end - at), end
                if not over and n_held + part.num_rows < HELD:
                    held.append(part)
                    n_held += part.num_rows
                    continue
                for b in (*held, part):
                    heavy = b.column(4).to_numpy()
                    yield out(b, HELD + heavy)
                held, over = [], True
        yield from close()

    # the rows of a heavy token are kept without a look at the others
    salt = F.when(F.col("heavy") > 0, F.pmod("c1", F.lit(HEAVY_SPREAD))).otherwise(F.lit(0))
    dealt = rows.withColumn("salt", salt).repartition("tok", "salt").sortWithinPartitions("tok", "c1", "c2").drop("salt")
    return dealt.mapInArrow(tidy(run), "tok bigint, c1 bigint, c2 bigint, n int, often int")


def _pair(a: str, b: str):
    return F.struct(F.col(a), F.col(b))


def _rarest(rows: DataFrame, shape: Shape) -> DataFrame:
    """(tok, c, n, cap, least, shared): the tokens of each class to join on.

    ``cap`` is how many n-grams of the extended prefix can be shared if the token is the first that is,
    ``least`` how many must be, and ``shared`` how many others name.
    """
    least, extended, wanted = shape.sql("n")
    # n-grams that no other class names come before all of these
    own = Window.partitionBy("c1", "c2")
    # one sort serves both windows
    rows = rows.withColumn("at", F.row_number().over(own.orderBy("often", "tok"))).withColumn("shared", F.count("*").over(own).cast("int"))
    rows = rows.withColumn("pos", F.expr(f"{extended} - shared + at - 1")).where(F.col("pos") < F.expr(wanted))
    return rows.select("tok", _pair("c1", "c2").alias("c"), "n", F.expr(f"{extended} - pos").cast("int").alias("cap"), F.expr(least).cast("int").alias("least"), "shared")


def _fetched(pairs: DataFrame, docs: DataFrame, sigs: DataFrame, sketch: np.ndarray, shape: Shape) -> DataFrame:
    """(c, keys): the whole set of every class of ``pairs``, in the sketch's order.

    A class is read from one row, that with its least id and text hash, so a null id is as good as another.
    """
    need = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    of = sigs.where("n > 0").select(_pair("c1", "c2").alias("c"), F.struct("id", "of").alias("row"))
    rows = stored(of.join(size_checked(stored(need, "ngram-need"), BROADCAST_IDS), "c").groupBy("c").agg(F.min("row").alias("row")).select("row.*"), "ngram-rows")
    same = docs["id"].eqNullSafe(F.col("row_id")) & (docs["of"] == F.col("row_of"))
    rows = docs.join(size_checked(rows.select(F.col("id").alias("row_id"), F.col("of").alias("row_of")), BROADCAST_IDS), same, "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def fetch(batches):
        seen = set()
        for part in slices(batches, 0):
            c1, c2, keys = [], [], []
            for t in part.column(0).to_pylist():
                h = shingles(t, shape.words)
                if not len(h) or (c := _class(h)) in seen:
                    continue
                if len(seen) >= CACHED_WORDS:
                    seen.clear()
                seen.add(c)
                c1.append(c[0])
                c2.append(c[1])
                keys.append(_ordered(h, shared.value).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(keys, pa.binary())], names=["c1", "c2", "keys"])

    sets = rows.select("text").mapInArrow(tidy(fetch, _forget), "c1 bigint, c2 bigint, keys binary").select(_pair("c1", "c2").alias("c"), "keys")
    # rows that share id and text hash, or null ids, may name a class more than once
    return stored(sets.dropDuplicates(["c"]), "ngram-fetched")


def suffix_bound(x: np.ndarray, y: np.ndarray, pieces: int = PIECES) -> int:
    """The most that two sorted arrays can share, by the sizes of their pieces between pivots of the longer."""
    if len(x) < len(y):
        x, y = y, x
    if not len(y):
        return 0
    pivots = x[np.arange(1, pieces) * len(x) // pieces]
    cut = lambda z: np.diff(np.concatenate([[0], np.searchsorted(z, pivots), [len(z)]]))
    return int(np.minimum(cut(x), cut(y)).sum())


def _may_link(x: np.ndarray, y: np.ndarray, cap: int | None, shape: Shape) -> bool:
    """The suffix filter: what the extended prefixes share, at most, and what can be shared after them."""
    n = len(x), len(y)
    if cap is not None:
        last = min(x[shape.extended(n[0]) - 1], y[shape.extended(n[1]) - 1])
        p, q = (int(np.searchsorted(z, last, "right")) for z in (x, y))
        bound = min(cap, p, q) + suffix_bound(x[p:], y[q:])
    else:
        bound = suffix_bound(x, y)
    return (100 + shape.percent) * bound >= shape.percent * sum(n)


_PAIR = "struct<c1: bigint, c2: bigint>"


def _verified(pairs: DataFrame, sets: DataFrame, shape: Shape) -> DataFrame:
    """(a, b, centre, linked, na, nb, d, k, kc, diff) of each pair (a, b, centre, cap), on whole sets.

    For a pair with a centre ``a``: ``d`` differences, of which ``diff`` has, in order, those that any
    similar set has to share, ``k`` of them, or one that is not similar to the centre, ``kc`` of them.
    """
    side = lambda s: sets.select(F.col("c").alias(s), F.col("keys").alias(f"h{s}"))
    wide = size_checked(pairs, BROADCAST_PAIRS).join(side("a"), "a").join(side("b"), "b").select("a", "b", "centre", "cap", "ha", "hb")
    names = ["a", "b", "centre", "linked", "na", "nb", "d", "k", "kc", "diff"]

    def judge(x: np.ndarray, y: np.ndarray, centre: bool, cap: int | None):
        n = len(x), len(y)
        if not centre and not _may_link(x, y, cap, shape):
            return False, *n, 0, 0, 0, None
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        same = both[1:][both[1:] == both[:-1]]
        linked = 100 * len(same) >= shape.percent * (sum(n) - len(same))
        if not centre:
            return linked, *n, 0, 0, 0, None
        d = sum(n) - 2 * len(same)
        some, half = shape.differences(d, n[1], n[0])
        # a set similar to the centre is only of use to one that is not
        k, kc = (0 if linked else max(0, d - some + 1)), max(0, d - half + 1)
        most = max(k, kc)
        diff = np.setdiff1d(y, same, assume_unique=True)
        if len(diff) < most:
            diff = np.concatenate([diff, np.setdiff1d(x, same, assume_unique=True)])
        return linked, *n, d, k, kc, diff[:most].view(np.int64)

    def run(batches):
        for part in slices(batches, 4):
            got = [judge(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), c, cap) for c, cap, x, y in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            cols = list(zip(*got)) or [()] * 7
            kinds = [pa.bool_(), *[pa.int32()] * 5, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], names=names)

    return stored(wide.mapInArrow(tidy(run), f"a {_PAIR}, b {_PAIR}, centre boolean, linked boolean, na int, nb int, d int, k int, kc int, diff array<bigint>"), "ngram-judged")


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` of the tokens that several classes join on, with their number ``m`` and their centre."""
    centre = rows.groupBy("tok").agg(F.count("*").alias("m"), F.max_by("c", F.struct("shared", F.xxhash64("c"))).alias("middle")).where("m > 1")
    return rows.join(centre, "tok")


def _first_pairs(rows: DataFrame, shape: Shape) -> DataFrame:
    """(a, b, centre, cap): pairs of classes that share a token of few, and of each other class with the centre of a token."""
    few = rows.where(F.col("m") <= FEW).select("tok", "c", "n", "cap", "least")
    t = shape.percent
    ab = few.alias("x").join(few.alias("y"), F.expr(f"""x.tok = y.tok and x.c < y.c and 100L * least(x.n, y.n) >= {t}L * greatest(x.n, y.n)
        and least(x.cap, y.cap) >= least(x.least, y.least)"""))
    # the first shared token is the one with the largest cap
    direct = ab.select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), F.least("x.cap", "y.cap").alias("cap")).groupBy("a", "b").agg(F.max("cap").alias("cap"))
    around = rows.where((F.col("m") > FEW) & (F.col("c") != F.col("middle"))).select(F.col("middle").alias("a"), F.col("c").alias("b")).distinct()
    return direct.select("a", "b", F.lit(False).alias("centre"), "cap").unionByName(around.select("a", "b", F.lit(True).alias("centre"), F.lit(None).cast("int").alias("cap")))


def _second_pairs(judged: DataFrame, labels: DataFrame, shape: Shape) -> DataFrame:
    """(a, b, centre, cap): pairs of classes around one centre, in different components, that share enough differences."""
    named = lambda s: size_checked(labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}")), BROADCAST_IDS)
    rows = judged.where("centre and d > 0 and greatest(k, kc) > 0").join(named("a"), "a", "left").join(named("b"), "b", "left")
    rows = rows.withColumn("la", F.coalesce("la", "a")).withColumn("lb", F.coalesce("lb", "b"))
    # a centre all of whose classes are in its component has no work left
    left = rows.where("la != lb").select("a").distinct()
    rows = rows.join(size_checked(stored(left, "ngram-centres"), BROADCAST_IDS), "a", "left_semi")
    rows = stored(rows.select("a", "b", "linked", "nb", "d", "k", "kc", "lb", F.posexplode("diff").alias("pos", "tok")), "ngram-differences")
    t = shape.percent
    total = "(x.nb + y.nb)"
    apart = f"({total} - 2 * int(({t}L * {total} + {99 + t}) div {100 + t}))"
    pairs = rows.where("not linked").alias("x").join(rows.alias("y"), F.expr(f"""x.a = y.a and x.tok = y.tok and x.lb != y.lb
        and if(y.linked, x.pos < x.k and y.pos < y.kc, x.b < y.b and x.pos < x.kc and y.pos < y.kc)
        and 100L * least(x.nb, y.nb) >= {t}L * greatest(x.nb, y.nb) and 2 * least(x.d - x.pos, y.d - y.pos) >= x.d + y.d - {apart}"""))
    return pairs.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct().select("a", "b", F.lit(False).alias("centre"), F.lit(None).cast("int").alias("cap"))


def links(docs: DataFrame, shape: Shape = Shape()) -> tuple[DataFrame, DataFrame]:
    """From (id, text): the signatures (id, n, c1, c2) and the component label of every linked class.

    Labels are classes (structs of c1, c2); classes without a link to another have no row.
    """
    docs = docs.select("id", "text", F.xxhash64("text").alias("of"))
    sigs, sketch = _signatures(docs, shape)
    rarest = stored(_rarest(_counted(_prefixes(docs, sketch, shape)), shape), "ngram-rarest")
    shared = stored(_shared(rarest), "ngram-shared")
    pairs = stored(_first_pairs(shared, shape), "ngram-first")
    discard(rarest, shared)
    sets = _fetched(pairs, docs, sigs, sketch, shape)
    judged = _verified(pairs, sets, shape)
    edges = judged.where("linked").select("a", "b")
    labels = stored(components(edges), "ngram-labels")
    more = _verified(stored(_second_pairs(judged, labels, shape), "ngram-second"), sets, shape).where("linked").select("a", "b")
    if not more.isEmpty():
        labels = stored(components(edges.unionByName(more)), "ngram-labels")
    return sigs.drop("of"), labels


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """Id, ``n_shingles`` and ``component_id`` (the least id reachable by links) of each document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sigs, labels = links(rows, shape)
    sigs = sigs.withColumn("c", F.when(F.col("n") > 0, _pair("c1", "c2"))).drop("c1", "c2")
    per_class = sigs.where("n > 0").groupBy("c").agg(F.min("id").alias("least"), F.count("*").alias("m"))
    per_class = per_class.join(labels.select(F.col("node").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    per_class = stored(per_class, "ngram-least")
    least = per_class.groupBy("label").agg(F.min("least").alias("component"), F.sum("m").alias("docs")).where("docs > 1")
    many = stored(per_class.join(least, "label").select("c", "component"), "ngram-many")
    if many.count() <= BROADCAST_IDS // 4:
        out = sigs.join(F.broadcast(many), "c", "left")
    else:
        # a class may hold a third of all rows: the few rows that name its component meet it in 16 places
        spread = 16
        many = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        out = sigs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")).join(many, ["c", "salt"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """One row of each group of similar documents, that with the least id, with its columns as it was.

    Documents without words link with nothing and all stay, as do those with a null id. Of rows that
    share id and text one stays.
    """
    own, = free_names(docs, "id")
    found = stored(groups(docs, id_col, text, shape).withColumnRenamed(id_col, own), "ngram-groups")
    keep = found.where((F.col("component_id") == F.col(own)) | F.col(own).isNull()).select(own).distinct()
    kept = docs.join(size_checked(keep, BROADCAST_IDS), docs[id_col].eqNullSafe(F.col(own)), "left_semi")
    again = found.where(F.col(own).isNotNull() & (F.col("n_shingles") > 0)).groupBy(own).agg(F.count("*").alias("m")).where("m > 1").select(own)
    if again.isEmpty():
        return kept
    again = size_checked(stored(again, "ngram-again"), BROADCAST_IDS)
    same = F.col(id_col) == F.col(own)
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, text]))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
with recursive w as materialized (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as materialized (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end)) as g from w
), n as materialized (
  select doc_id, count(*) as n from s group by doc_id
), p as materialized (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), e as materialized (
  select p.x, p.y from p join n a on p.x = a.doc_id join n b on p.y = b.doc_id where 100 * c >= 85 * (a.n + b.n - c)
), u as materialized (
  select x, y from e union all select y, x from e
), r as (
  select doc_id, doc_id as m from documents union select u.y, r.m from r join u on r.doc_id = u.x
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from documents d left join n on d.doc_id = n.doc_id join (select doc_id, min(m) as component_id from r group by doc_id) c on d.doc_id = c.doc_id
"""
