"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated character models of words are counted, one from toxic and one from ordinary labelled
documents: order ``ORDER`` from raw counts, each lower order from continuation counts (distinct left
extensions). Both are smoothed at every order towards one model of the counts of both classes together:
the mass that a class's discounts free goes half to its own next lower order and half to the shared one,
so that rare expressions, which neither class tells much about, weigh alike under either. A document's evidence is the difference of the
log-likelihoods of its words, divided by their number; a rising curve turns evidence into a score.

Counts cover every labelled training row: words, then grams, are counted exactly in shuffled tables
that grow with the input, and scoring uses those exact counts: up to ``BROADCAST_GRAMS`` grams they are
broadcast as sorted arrays; more are joined to the grams of each distinct word by shuffle. The curve is fitted on about ``CURVE_ROWS`` training rows at most,
each scored by the model of the other half of the training rows.

Defined results: null text counts as empty and gets the curve's value at no evidence; null ids are
kept (and never learned from); repeated rows each give a row; rows with a null label are not learned
from, a document labelled both ways counts as toxic; with no toxic or no ordinary training row every
score is the share of toxic rows (0 without labels); an empty table gives an empty result; further
columns are ignored by ``score`` and kept by ``keep_ordinary``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .batches import free_names, held_out, map_slices, size_checked, slices, tidy
from .scratch import stored

_WORD = re.compile(r"\w+")
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_OPEN, _CLOSE = "\x02", "\x03"

#: Characters of the longest gram, and the number of characters among which the lowest order spreads what is unseen.
ORDER, CHARS = 5, 1 << 16
#: Share of the discounted mass that goes to the lower order of both classes together.
SHARED = 0.5
#: Grams up to this number, of all orders, are broadcast; more are joined by shuffle.
BROADCAST_GRAMS = 2_000_000
#: Rows the score curve is fitted on.
CURVE_ROWS = 20_000
#: Labels up to this number are broadcast to the documents; more are joined by shuffle.
BROADCAST_LABELS = 2_000_000
#: Distinct words a task counts before it hands the counts on, and words whose evidence a worker remembers.
FLUSH_WORDS, CACHED_WORDS = 300_000, 300_000
#: Words whose grams are held in memory at once.
AT_ONCE = 10_000
#: Words without evidence added to each document's number, so that one odd word is no verdict.
PADDING = 3
#: Score from which a document is called toxic.
CUT = 0.7


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of the words one after another, each between marks: every character's place in its word, where
    the words start, and for each order the hash of the gram that ends at each character."""
    text = _OPEN + (_CLOSE + _OPEN).join(words) + _CLOSE
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.flatnonzero(chars == ord(_OPEN))
    place = np.arange(len(chars)) - np.repeat(start, np.diff(np.append(start, len(chars))))
    hashes = [chars * _MIX_A]
    for _ in range(ORDER - 1):
        h = np.zeros_like(chars)
        h[1:] = (hashes[-1][:-1] ^ (chars[1:] * _MIX_B)) * _MIX_A
        h ^= h >> np.uint64(31)
        hashes.append(h * _MIX_B)
    return place, start, hashes


COUNTS = ("t0", "o0", "t1", "o1")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, t0, o0, t1, o1) from (text, toxic, half): occurrences by class and half."""

    def run(batches):
        counts = [Counter() for _ in COUNTS]

        def flush():
            for kind, c in enumerate(counts):
                if c:
                    names = list(c)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.full(len(names), kind, np.int8)), pa.array([c[w] for w in names], pa.int64())], names=["word", "kind", "n"])
                    c.clear()

        for part in slices(batches, 0):
            for t, toxic, half in zip(*(c.to_pylist() for c in part.columns)):
                if t:
                    counts[1 - toxic + 2 * half].update(_WORD.findall(t.lower()))
            if sum(map(len, counts)) >= FLUSH_WORDS:
                yield from flush()
        yield from flush()

    parts = rows.select("text", "toxic", "half").mapInArrow(tidy(run), "word string, kind tinyint, n bigint")
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    return parts.groupBy("word").agg(*[of(k).alias(c) for k, c in enumerate(COUNTS)])


def gram_counts(words: DataFrame) -> DataFrame:
    """Raw counts of the grams of every order from 2 up.

    Columns: order, key, ctx (the gram without its last character), tail (without its first), tail_ctx,
    first (whether it begins the word), and the four counts.
    """
    names = ["k", "key", "ctx", "tail", "tail_ctx", "first", *COUNTS]

    def run(batches):
        for part in slices(batches):
            listed = part.column(0).to_pylist()
            place, start, hashes = grams(listed)
            word = np.repeat(np.arange(len(listed)), np.diff(np.append(start, len(place))))
            n = [c.to_numpy() for c in part.columns[1:]]
            none = np.zeros(1, np.uint64)
            for k in range(2, ORDER + 1):
                at = np.flatnonzero(place >= k - 1)
                keys, first, where = np.unique(hashes[k - 1][at], return_index=True, return_inverse=True)
                i = at[first]
                cols = [keys, hashes[k - 2][i - 1], hashes[k - 2][i], hashes[k - 3][i - 1] if k > 2 else np.repeat(none, len(i))]
                sums = [np.bincount(where, c[word[at]], len(keys)).astype(np.int64) for c in n]
                arrays = [pa.array(np.full(len(keys), k, np.int8)), *[pa.array(c.view(np.int64)) for c in cols], pa.array(place[i] == k - 1), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    parts = words.select("word", *COUNTS).mapInArrow(tidy(run), "k tinyint, key bigint, ctx bigint, tail bigint, tail_ctx bigint, first boolean, t0 bigint, o0 bigint, t1 bigint, o1 bigint")
    return parts.groupBy(*names[:6]).agg(*[F.sum(c).alias(c) for c in COUNTS])


#: What a model counts: all training rows, or those of one half; for each, toxic and ordinary.
_MODELS = {"all": ("t0 + t1", "o0 + o1"), "0": ("t0", "o0"), "1": ("t1", "o1")}
_NAMED = {f"{m}_{i}": e for m, pair in _MODELS.items() for i, e in enumerate(pair)}


def kneser_ney_counts(raw: DataFrame) -> DataFrame:
    """(k, key, ctx) and a count for each model and class: raw for the longest grams and those that
    begin a word, else the number of distinct left extensions."""
    whole = raw.where((F.col("k") == ORDER) | F.col("first")).select("k", "key", "ctx", *[F.expr(e).alias(c) for c, e in _NAMED.items()])
    lower = raw.groupBy((F.col("k") - 1).cast("tinyint").alias("k"), F.col("tail").alias("key"), F.col("tail_ctx").alias("ctx")).agg(*[F.count(F.when(F.expr(e) > 0, 1)).alias(c) for c, e in _NAMED.items()])
    return whole.unionByName(lower).groupBy("k", "key", "ctx").agg(*[F.sum(c).alias(c) for c in _NAMED])


def _at(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash stands in the sorted keys; one past the end if it does not."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    i = np.searchsorted(keys, h)
    return np.where(keys[np.minimum(i, len(keys) - 1)] == h, i, len(keys))


@dataclass
class Statistics:
    """Of one model: the discounts by order and class, and the sum of the lowest order's counts by class."""

    discount: list  # by order: of toxic, ordinary and both together
    lowest: tuple


@dataclass
class Model:
    """Exact counts by order: the sorted hashes of the grams with ``count``, and those of their contexts
    with ``total`` and ``types``, each by class (toxic, ordinary) and with a last cell for what is unseen;
    ``types`` has both classes together as a third."""

    keys: list
    count: list
    contexts: list
    total: list
    types: list
    stats: Statistics
    known: dict = field(default_factory=dict)

    def word_evidence(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under toxic less that under ordinary."""
        place, start, hashes = grams(words)
        cells = [_at(keys, h) for keys, h in zip(self.keys, hashes)]
        before = [None, *[np.append(len(keys), _at(keys, h[:-1])) for keys, h in zip(self.contexts[1:], hashes)]]
        lowest = [n[cells[0]] for n in self.count[0]]
        both = (lowest[0] + lowest[1] + 0.5) / (sum(self.stats.lowest) + 0.5 * CHARS)
        p = [(lowest[c] / max(self.stats.lowest[c], 1) + both) / 2 for c in (0, 1)] + [both]
        for k in range(2, ORDER + 1):
            ctx, cell, d = before[k - 1], cells[k - 1], self.stats.discount[k - 1]
            total = [self.total[k - 1][c][ctx] for c in (0, 1)]
            count = [self.count[k - 1][c][cell] for c in (0, 1)]
            total.append(total[0] + total[1])
            count.append(count[0] + count[1])
            lower = [(1 - SHARED) * p[0] + SHARED * p[2], (1 - SHARED) * p[1] + SHARED * p[2], p[2]]
            for c in (0, 1, 2):
                safe = np.maximum(total[c], 1)
                new = np.maximum(count[c] - d[c], 0) / safe + d[c] * self.types[k - 1][c][ctx] / safe * lower[c]
                p[c] = np.where((place >= k - 1) & (total[c] > 0), new, p[c])
        out = np.log(p[0]) - np.log(p[1])
        out[start] = 0
        return np.add.reduceat(out, start)

    def evidence(self, texts: list) -> np.ndarray:
        split = [_WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        new = list({w for words in split for w in words if w not in self.known})
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            self.known.update(zip(some, self.word_evidence(some).tolist()))
        return np.array([sum(map(self.known.__getitem__, words)) / (len(words) + PADDING) if words else 0.0 for words in split])


def statistics(counts: DataFrame) -> dict[str, Statistics]:
    """Of the models of all training rows and of each half."""
    seen = {c: F.col(c) for c in _NAMED} | {f"{m}_2": F.col(f"{m}_0") + F.col(f"{m}_1") for m in _MODELS}
    few = {r["k"]: r for r in counts.groupBy("k").agg(*[F.count(F.when(e == n, 1)).alias(f"{c}_{n}") for c, e in seen.items() for n in (1, 2)], *[F.sum(c).alias(c) for c in _NAMED]).collect()}

    def discount(k: int, c: str) -> float:
        one, two = (few[k][f"{c}_{n}"] for n in (1, 2)) if k in few else (0, 0)
        return min(max(one / max(1, one + 2 * two), 0.1), 0.9)

    own = {m: (f"{m}_0", f"{m}_1") for m in _MODELS}
    return {m: Statistics([tuple(discount(k, c) for c in (*own[m], f"{m}_2")) for k in range(1, ORDER + 1)], tuple(few[1][c] if 1 in few else 0 for c in own[m])) for m in _MODELS}


def _by_context(counts: DataFrame, columns: list[str]) -> DataFrame:
    """(k, ctx), of each column the sum and, as ``_n``, the number of grams, and that of both classes' grams."""
    both = {f"{c[:-1]}2_n": (F.col(c) > 0) | (F.col(f"{c[:-1]}1") > 0) for c in columns if c.endswith("_0")}
    return counts.where("k > 1").groupBy("k", "ctx").agg(*[F.sum(c).alias(c) for c in columns], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_n") for c in columns], *[F.count(F.when(e, 1)).alias(n) for n, e in both.items()])


def models(counts: DataFrame, stats: dict[str, Statistics] | None = None) -> dict[str, Model]:
    """The models of all training rows and of each half, of the exact counts."""
    stats = stats or statistics(counts)
    by_key = counts.select("k", "key", *_NAMED).toArrow()
    by_ctx = _by_context(counts, list(_NAMED)).toArrow()

    def tables(arrow, key: str, own: list[str], *groups: list[str]) -> tuple:
        order, hashes = arrow["k"].to_numpy(), arrow[key].to_numpy().view(np.uint64)
        values = {c: arrow[c].to_numpy() for g in groups for c in g}
        kept = (values[own[0]] > 0) | (values[own[1]] > 0)
        out = [[] for _ in range(1 + len(groups))]
        for k in range(1, ORDER + 1):
            rows = np.flatnonzero((order == k) & kept)
            rows = rows[np.argsort(hashes[rows])]
            out[0].append(hashes[rows])
            for made, g in zip(out[1:], groups):
                made.append(np.array([np.append(values[c][rows], 0) for c in g]))
        return tuple(out)

    made = {}
    for m in _MODELS:
        own = [f"{m}_0", f"{m}_1"]
        made[m] = Model(*tables(by_key, "key", own, own), *tables(by_ctx, "ctx", own, own, [f"{c}_n" for c in (*own, f"{m}_2")]), stats[m])
    return made


def joined_word_evidence(words: DataFrame, counts: DataFrame, m: str, stats: Statistics) -> DataFrame:
    """(word, evidence) of ``words`` under model ``m``, by joins alone: what ``Model.word_evidence`` gives."""

    def run(batches):
        for part in slices(batches, 0):
            listed = part.column(0).to_pylist()
            place, start, hashes = grams(listed)
            word = np.repeat(np.arange(len(listed)), np.diff(np.append(start, len(place))))
            for k in range(1, ORDER + 1):
                i = np.flatnonzero(place >= max(1, k - 1))
                ctx = hashes[k - 2][i - 1] if k > 1 else np.zeros(len(i), np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(word[i])), pa.array(place[i], pa.int64()), pa.array(np.full(len(i), k, np.int8)), pa.array(hashes[k - 1][i].view(np.int64)), pa.array(ctx.view(np.int64))], names=["word", "place", "k", "key", "ctx"])

    own = [f"{m}_0", f"{m}_1"]
    rows = words.select("word").mapInArrow(tidy(run), "word string, place bigint, k tinyint, key bigint, ctx bigint")
    by_key = counts.select("k", "key", *[F.col(c).alias(f"n{i}") for i, c in enumerate(own)])
    by_ctx = _by_context(counts, own).select("k", "ctx", *[F.col(c).alias(f"total{i}") for i, c in enumerate(own)], *[F.col(f"{c}_n").alias(f"types{i}") for i, c in enumerate((*own, f"{m}_2"))])
    met = rows.join(by_key, ["k", "key"], "left").join(by_ctx, ["k", "ctx"], "left")
    of = lambda k, c: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0)).alias(f"{c}_{k}")
    per = met.groupBy("word", "place").agg(*[of(k, c) for k in range(1, ORDER + 1) for c in (("n0", "n1", "total0", "total1", "types0", "types1", "types2") if k > 1 else ("n0", "n1"))])
    both = (F.col("n0_1") + F.col("n1_1") + 0.5) / (sum(stats.lowest) + 0.5 * CHARS)
    per = per.withColumns({f"p{i}": (F.col(f"n{i}_1") / max(stats.lowest[i], 1) + both) / 2 for i in (0, 1)} | {"p2": both})
    for k in range(2, ORDER + 1):
        step = {}
        for i in (0, 1, 2):
            of_both = lambda c: F.col(f"{c}0_{k}") + F.col(f"{c}1_{k}")
            d, total = stats.discount[k - 1][i], of_both("total") if i == 2 else F.col(f"total{i}_{k}")
            count = of_both("n") if i == 2 else F.col(f"n{i}_{k}")
            lower = F.col("p2") if i == 2 else (1 - SHARED) * F.col(f"p{i}") + SHARED * F.col("p2")
            new = F.when(total > 0, F.greatest(count - d, F.lit(0.0)) / total + d * F.col(f"types{i}_{k}") / total * lower)
            step[f"p{i}"] = F.coalesce(F.when(F.col("place") >= k - 1, new), F.col(f"p{i}"))
        per = per.withColumns(step)
    return per.groupBy("word").agg(F.sum(F.log("p0") - F.log("p1")).alias("evidence"))


def joined_evidence(rows: DataFrame, counts: DataFrame, m: str, stats: Statistics) -> DataFrame:
    """(row, x) of ``rows`` (row, text) that have words: what ``Model.evidence`` gives."""

    def run(batches):
        for part in slices(batches, 1):
            found = [(i, w, n, c.total()) for i, t in zip(*(c.to_pylist() for c in part.columns)) if t for c in [Counter(_WORD.findall(t.lower()))] for w, n in c.items()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["row", "word", "n", "size"])

    used = stored(rows.select("row", "text").mapInArrow(tidy(run), "row bigint, word string, n bigint, size bigint"), "tox-used")
    per = joined_word_evidence(used.select("word").distinct(), counts, m, stats)
    return used.join(per, "word").groupBy("row").agg((F.sum(F.col("n") * F.col("evidence")) / (F.first("size") + PADDING)).alias("x"))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising curve through (evidence, class): pool adjacent violators, then join the
    blocks' centres. Beyond the outer blocks it goes on to 0 and 1 over a spread of the evidence."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # rows, sum of evidence, sum of class
    for xi, yi in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([1.0, xi, yi])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            n, sx, sy = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + sx, blocks[-1][2] + sy]
    share, spread = float(y.mean()), float(x.std() or 1.0)
    centres = [sx / n for n, sx, _ in blocks]
    values = [(sy + share) / (n + 1) for n, _, sy in blocks]
    values = np.maximum.accumulate(np.clip(values, 1e-3, 0.999))
    return np.array([centres[0] - 4 * spread, *centres, centres[-1] + 4 * spread]), np.array([0.0, *values, 1.0])


@dataclass
class Scorer:
    """What scoring needs: the model of all training rows and the curve, or a constant. In place of the
    model, counts too many to broadcast."""

    model: Model | None
    curve: tuple[np.ndarray, np.ndarray] | None
    constant: float = 0.0
    counts: DataFrame | None = None
    stats: Statistics | None = None

    def __call__(self, texts: list) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.constant)
        return np.interp(self.model.evidence(texts), *self.curve)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Learn from the documents whose id is labelled and not held out."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label) != 0).cast("int")).alias("toxic"))
    known = known.withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(size_checked(stored(known, "tox-labels"), BROADCAST_LABELS), "id")
    words = stored(word_counts(rows), "tox-words")
    counts = stored(kneser_ney_counts(gram_counts(words)), "tox-grams")
    stats = statistics(counts)
    if not all(stats["all"].lowest):
        share = known.agg(F.avg("toxic")).first()[0]
        return Scorer(None, None, float(share or 0.0))
    total = max(1, known.count())
    # a bounded sample by hash of the id
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(1_000_000)) < int(min(1.0, CURVE_ROWS / total) * 1_000_000))
    if counts.count() > BROADCAST_GRAMS:
        sample = stored(sample.select("toxic", "half", "text").withColumn("row", F.monotonically_increasing_id()), "tox-sample")
        x = [joined_evidence(sample.where(F.col("half") == h), counts, str(1 - h), stats[str(1 - h)]) for h in (0, 1)]
        got = sample.join(x[0].unionByName(x[1]), "row", "left").select("toxic", F.coalesce("x", F.lit(0.0)).alias("x")).toArrow()
        return _fitted(got, counts=counts, stats=stats["all"])
    made = models(counts, stats)
    halves = spark.sparkContext.broadcast([made["0"], made["1"]])

    def run(cols):
        out = np.zeros(len(cols["half"]))
        half = np.array(cols["half"])
        for h in (0, 1):
            at = np.flatnonzero(half == h)
            out[at] = halves.value[1 - h].evidence([cols["text"][i] for i in at])
        return {"toxic": cols["toxic"], "x": out}

    got = map_slices(sample.select("text", "toxic", "half"), run, StructType.fromDDL("toxic int, x double"), "text").toArrow()
    halves.destroy()
    return _fitted(got, model=made["all"])


def _fitted(got: pa.Table, model: Model | None = None, **joined) -> Scorer:
    x, y = got["x"].to_numpy(), got["toxic"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return Scorer(None, None, float(y.mean() if len(y) else 0.0))
    return Scorer(model, fit_curve(x, y), **joined)


def with_score(docs: DataFrame, scorer: Scorer, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score appended."""
    if scorer.counts is not None:
        return _with_joined_score(docs, scorer, text, column)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    at = docs.columns.index(text)

    def run(batches):
        for part in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value(part.column(at).to_pylist()), pa.float64())], names=[*part.schema.names, column])

    def forget():
        if shared.value.model is not None:
            shared.value.model.known.clear()

    return docs.mapInArrow(tidy(run, forget), schema)


def _with_joined_score(docs: DataFrame, scorer: Scorer, text: str, column: str) -> DataFrame:
    names, curve = docs.columns, scorer.curve
    # columns by number, as docs may have any names
    rows = stored(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()), "tox-docs")
    x = joined_evidence(rows.select("row", F.col(f"c{names.index(text)}").alias("text")), scorer.counts, "all", scorer.stats)
    rows = rows.join(x, "row", "left").drop("row").withColumn("x", F.coalesce("x", F.lit(0.0)))

    def run(batches):
        for part in batches:
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.interp(part.column(part.num_columns - 1).to_numpy(), *curve), pa.float64())], names=[*names, column])

    return rows.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of each document."""
    scorer = scorer or train(docs, labels, id_col, text)
    rows = with_score(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), scorer)
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """The rows of ``docs`` that are not called toxic, with their columns as they were."""
    scorer = scorer or train(docs, labels, id_col, text)
    column, = free_names(docs, "toxicity")
    return with_score(docs, scorer, text, column).where(F.col(column) < CUT).drop(column)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
