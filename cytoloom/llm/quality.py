"""Quality classifier by positive-unlabelled learning.

Trusted positives are the training rows labelled good; every document counts as unlabelled web text,
and labels of bad rows are never used. With the logistic loss and a linear score over a fixed basis of
text statistics, the unbiased risk

    R = E_U[log(1 + exp g)] - prior * E_P[g]

is convex, and its part for negatives must not fall under zero: a step that would take it there is
shortened until it does not (the non-negative correction). The class prior is estimated from the data:
a first classifier of positives against unlabelled text ranks all documents, and the prior is the least
ratio, over score cut-offs, of the unlabelled to the positive share above it (with a margin for
sampling error), since no region can hold more positives than documents.

Every document takes part in every Newton step; a task sends one gradient and one matrix of fixed size.
Features are kept in one written table, so steps do not parse texts again.

Defined results: null text counts as empty, whose statistics are all zero; null ids are kept and never
learned from; repeated rows each count and each give a row; null labels are not learned from, a document
labelled both ways is no trusted positive; without positives every score is 0.5; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import held_out, size_checked, slices
from .scratch import stored

#: Labels up to this number are broadcast to the documents; more are joined by shuffle.
BROADCAST_LABELS = 2_000_000
#: Newton steps at most, damping, bins of the prior's estimate and knots of a statistic's basis.
STEPS, DAMPING, BINS, KNOTS = 12, 1e-3, 400, (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
#: Tasks whose sums one task adds, and that may reach the driver.
FAN = 16
#: Score from which a document is called good.
CUT = 0.5

_PUNCT_RUN = re.compile(r"[^\w\s]{2,}")
_WORD = re.compile(r"[^\W\d_]+")

STATISTICS = ("words", "word_length", "longest_word", "distinct_words", "repeats_previous", "top_word", "symbols", "symbol_runs", "digits", "upper", "upper_words", "lines", "line_length", "distinct_lines", "short_lines", "sentence_ends", "bars", "letters", "vowels", "white_space")


def statistics(text: str | None) -> list[float]:
    """What a reader sees at a glance, each in a bounded range."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    words = text.split()
    w = len(words) or 1
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    low = text.lower()
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    letters = _WORD.findall(text)
    n_letters = sum(map(len, letters))
    white = n - sum(map(len, words))
    ascii_only = text.encode("ascii", "ignore").decode() if not text.isascii() else text
    digits = sum(map(ascii_only.count, "0123456789"))
    same = sum(a == b for a, b in zip(words, words[1:]))
    upper = sum(x.isupper() and len(x) > 1 for x in letters)
    capitals = sum(map(ascii_only.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        min(np.log1p(len(words)) / 12, 1.0),
        min(sum(map(len, words)) / w / 20, 1.0),
        min(max(map(len, words), default=0) / 60, 1.0),
        len(counts) / w,
        same / w,
        max(counts.values(), default=0) / w,
        (n - white - n_letters - digits) / n,
        len(_PUNCT_RUN.findall(text)) / w,
        digits / n,
        capitals / n,
        upper / w,
        min(np.log1p(len(lines)) / 8, 1.0),
        min(np.log1p(n / len(lines)) / 10, 1.0),
        len(set(lines)) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines),
        min(sum(map(text.count, ".!?")) / w, 1.0),
        text.count("|") / w if w else 0.0,
        n_letters / n,
        sum(map(low.count, "aeiou")) / n,
        white / n,
    ]


def features(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, x): the statistics of every document as an array of floats."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches):
        for part in slices(batches, 1):
            x = [statistics(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float32()))], names=["id", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>")


@dataclass
class Basis:
    """Hinges at quantiles of each statistic: a linear score over them bends at every knot."""

    knots: np.ndarray  # statistics x knots
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        hinges = np.maximum(x[:, :, None] - self.knots[None], 0) / self.scale[None, :, None]
        return np.concatenate([np.ones((len(x), 1)), x / self.scale, np.minimum(hinges, 8).reshape(len(x), -1)], 1)


def _basis(table: DataFrame) -> Basis:
    """Knots from quantiles over all documents (an approximate quantile of fixed error)."""
    cols = [F.col("x")[i] for i in range(len(STATISTICS))]
    row = table.agg(*[F.percentile_approx(c, list(KNOTS), 2000).alias(f"q{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    knots = np.array([row[f"q{i}"] or [0.0] * len(KNOTS) for i in range(len(STATISTICS))], float)
    return Basis(knots, np.array([max(row[f"s{i}"] or 0.0, 1e-3) for i in range(len(STATISTICS))]))


def _sums(table: DataFrame, basis: Basis, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Over all documents: sum of sigma(g) x, of sigma(1 - sigma) x x', of log(1 + exp g), and their number."""
    k = len(w)

    half = np.triu_indices(k)  # the matrix is symmetric

    def of(x):
        a = basis(x)
        g = np.clip(a @ w, -30, 30)
        p = 1 / (1 + np.exp(-g))
        return np.concatenate([((a * (p * (1 - p))[:, None]).T @ a)[half], a.T @ p, [np.log1p(np.exp(g)).sum(), len(g)]])

    n = len(half[0])
    out = _summed(table, of, n + k + 2)
    matrix = np.zeros((k, k))
    matrix[half] = out[:n]
    return out[n : n + k], matrix + np.triu(matrix, 1).T, float(out[-2]), float(out[-1])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"", np.float32).reshape(0, len(STATISTICS)).astype(float) if not len(column) else column.flatten().to_numpy().reshape(-1, len(STATISTICS)).astype(float)


def _fit(table: DataFrame, positives: DataFrame, basis: Basis, mean_p: np.ndarray, prior: float) -> np.ndarray:
    """Newton steps on the non-negative risk; ``mean_p`` is the positives' mean basis vector.

    The weights returned are the last whose risk was taken and found lower, with a part for negatives not
    under zero; a step that was never looked at is not among them.
    """
    w = np.zeros(len(mean_p))
    good, last, step, size = w, np.inf, np.zeros_like(w), 1.0
    for _ in range(STEPS):
        sx, sxx, loss, n = _sums(table, basis, w)
        n = max(n, 1)
        risk = loss / n - prior * mean_p @ w + DAMPING / 2 * w[1:] @ w[1:]
        negatives = loss / n - prior * _mean_loss(positives, basis, w)
        if not np.isfinite(risk) or risk > last + 1e-9 or negatives < 0:
            size /= 2
            w = good + step * size  # half of what was added
            continue
        gain, good = last - risk, w
        if gain < 1e-6:
            break
        damp = np.full(len(w), DAMPING)
        damp[0] = 1e-9
        grad = sx / n - prior * mean_p + damp * w
        last, size = risk, 1.0
        step = -np.linalg.solve(sxx / n + np.diag(damp + 1e-9), grad)
        step *= min(1.0, 20 / max(np.abs(step).max(), 1e-9))
        w = good + step
    return good


def _summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all rows of ``of(statistics matrix)``, a vector of fixed size."""

    def run(batches):
        total = np.zeros(size)
        for b in slices(batches):
            total += of(_matrix(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def add(batches):
        total = np.zeros(size)
        for b in batches:
            for s in b.column(0).to_pylist():
                total += np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    # a task sends one vector, and tasks add up a few each, level by level
    parts = rows.select("x").mapInArrow(run, "s binary")
    left = rows.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.repartition(left).mapInArrow(add, "s binary")
    return sum((np.frombuffer(r.s) for r in parts.collect()), np.zeros(size))


def _mean_of(rows: DataFrame, basis: Basis) -> tuple[np.ndarray, float]:
    k = 1 + len(STATISTICS) * (1 + len(KNOTS))
    out = _summed(rows, lambda x: np.append(basis(x).sum(0), len(x)), k + 1)
    return out[:k] / max(out[k], 1), float(out[k])


def _mean_loss(rows: DataFrame, basis: Basis, w: np.ndarray) -> float:
    total, n = _summed(rows, lambda x: np.array([np.log1p(np.exp(np.clip(basis(x) @ w, -30, 30))).sum(), len(x)]), 2)
    return total / max(n, 1)


def _histogram(rows: DataFrame, basis: Basis, w: np.ndarray) -> np.ndarray:
    def of(x):
        p = 1 / (1 + np.exp(-np.clip(basis(x) @ w, -30, 30)))
        return np.bincount(np.minimum((p * BINS).astype(int), BINS - 1), minlength=BINS).astype(float)

    return _summed(rows, of, BINS)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least upper bound on the share of positives, over score cut-offs, with two standard errors."""
    up = np.cumsum(positive[::-1]) / max(positive.sum(), 1)
    uu = np.cumsum(unlabelled[::-1]) / max(unlabelled.sum(), 1)
    err = lambda q, n: 2 * np.sqrt(q * (1 - q) / max(n, 1))
    use = up >= 0.2
    bound = (uu + err(uu, unlabelled.sum()))[use] / np.maximum(up - err(up, positive.sum()), 1e-9)[use]
    return float(np.clip(bound.min(initial=1.0), 0.01, 0.99))


@dataclass
class Scorer:
    basis: Basis | None
    weights: np.ndarray | None
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.basis(x) @ self.weights, -30, 30)))


def train(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> Scorer:
    """From the written feature table and the labels of rows that are not held out."""
    good = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.min((F.col(label) != 0).cast("int")).alias("good")).where("good = 1").select("id")
    basis = _basis(table)
    positives = stored(table.join(size_checked(stored(good, "quality-good"), BROADCAST_LABELS), "id", "left_semi").select("x"), "quality-positive")
    mean_p, n = _mean_of(positives, basis)
    if not n:
        return Scorer(None, None, 0.5)
    rough = _fit(table, positives, basis, mean_p, 0.5)
    prior = estimated_prior(_histogram(positives, basis, rough), _histogram(table, basis, rough))
    return Scorer(basis, _fit(table, positives, basis, mean_p, prior), prior)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of each document."""
    table = stored(features(docs, id_col, text), "quality-features")
    shared = docs.sparkSession.sparkContext.broadcast(train(table, labels, id_col, label))

    def run(batches):
        for part in slices(batches):
            s = shared.value(_matrix(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    rows = table.mapInArrow(run, f"id {table.schema['id'].dataType.simpleString()}, score double")
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
