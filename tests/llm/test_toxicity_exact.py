"""The toxicity models hold the counts of every distinct gram, however many there are."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cytoloom.llm import toxicity as tox

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(LETTERS, k=rng.randint(6, 12)))
    docs = [(i, " ".join(word() for _ in range(25))) for i in range(800)]
    return docs, [(i, int(i % 3 == 0)) for i, _ in docs], [word() for _ in range(400)]


def plain_evidence(texts, toxic, words):
    """Kneser-Ney by dictionaries of strings."""
    marked = lambda w: "\x02" + w + "\x03"
    count, total, types, discount = {}, {}, {}, {}
    for c in (0, 1):
        raw = Counter()
        for t, label in zip(texts, toxic):
            if label == 1 - c:
                for w in map(marked, t.split()):
                    raw.update((w[i : i + k], i == 0) for k in range(2, tox.ORDER + 1) for i in range(len(w) - k + 1))
        n, left = Counter(), defaultdict(set)
        for (g, first), x in raw.items():
            if len(g) == tox.ORDER or first:
                n[g] += x
            left[g[1:]].add((g, first))
        for g, grams in left.items():
            n[g] += len(grams)
        count[c], total[c], types[c] = n, Counter(), Counter()
        for g, x in n.items():
            if len(g) > 1:
                total[c][g[:-1]] += x
                types[c][g[:-1]] += 1
        for k in range(1, tox.ORDER + 1):
            one, two = (sum(x == v for g, x in n.items() if len(g) == k) for v in (1, 2))
            discount[c, k] = min(max(one / max(1, one + 2 * two), 0.1), 0.9)
    # the third model is of both classes' counts
    count[2] = count[0] + count[1]
    total[2], types[2] = total[0] + total[1], Counter(g[:-1] for g in count[2] if len(g) > 1)
    for k in range(1, tox.ORDER + 1):
        one, two = (sum(x == v for g, x in count[2].items() if len(g) == k) for v in (1, 2))
        discount[2, k] = min(max(one / max(1, one + 2 * two), 0.1), 0.9)
    low = [sum(x for g, x in count[c].items() if len(g) == 1) for c in (0, 1)]
    out = []
    for w in map(marked, words):
        logs = [0.0, 0.0]
        for i in range(1, len(w)):
            shared = (count[0][w[i]] + count[1][w[i]] + 0.5) / (sum(low) + 0.5 * 65536)
            p = [*[(count[c][w[i]] / max(low[c], 1) + shared) / 2 for c in (0, 1)], shared]
            for k in range(2, min(tox.ORDER, i + 1) + 1):
                g = w[i - k + 1 : i + 1]
                lower = [(p[0] + p[2]) / 2, (p[1] + p[2]) / 2, p[2]]
                for c in (0, 1, 2):
                    if t := total[c][g[:-1]]:
                        p[c] = max(count[c][g] - discount[c, k], 0) / t + discount[c, k] * types[c][g[:-1]] / t * lower[c]
            logs = [x + math.log(y) for x, y in zip(logs, p)]
        out.append(logs[0] - logs[1])
    return np.array(out)


def test_evidence_is_that_of_exact_counts(spark, corpus):
    docs, labels, unseen = corpus
    rows = spark.createDataFrame([(t, x, 0) for (_, t), (_, x) in zip(docs, labels)], "text string, toxic int, half int")
    counts = tox.kneser_ney_counts(tox.gram_counts(tox.word_counts(rows))).cache()
    words = unseen + docs[0][1].split()
    want = plain_evidence([t for _, t in docs], [x for _, x in labels], words)
    got = tox.models(counts)["all"].word_evidence(words)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
    joined = {r.word: r.evidence for r in tox.joined_word_evidence(spark.createDataFrame([(w,) for w in set(words)], "word string"), counts, "all", tox.statistics(counts)["all"]).collect()}
    assert np.allclose([joined[w] for w in words], want, rtol=1e-9, atol=1e-9)


def test_joined_scores_equal_broadcast_ones(spark, corpus, monkeypatch):
    docs, labels, _ = corpus
    table = spark.createDataFrame([*docs, docs[3], (None, docs[4][1]), (9000, None), (9001, "")], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    of = lambda: sorted((str(r.doc_id), r.score, r.predicted) for r in tox.score(table, marks).collect())
    want = of()
    monkeypatch.setattr(tox, "BROADCAST_GRAMS", 0)
    got = of()
    assert [x[0] for x in got] == [x[0] for x in want] and len(want) == len(docs) + 4
    assert np.allclose([x[1] for x in got], [x[1] for x in want], rtol=1e-6)
    kept = tox.keep_ordinary(table, marks)
    assert kept.columns == table.columns and kept.count() == sum(x[1] < tox.CUT for x in want)


@pytest.mark.parametrize("extra", ["toxicity", "__toxicity", "Toxicity", "score", "row"])
def test_clashing_columns_stay(spark, corpus, extra):
    docs, labels, _ = corpus
    table = spark.createDataFrame([(i, t, "own") for i, t in docs[:60]], f"doc_id bigint, text string, `{extra}` string")
    kept = tox.keep_ordinary(table, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert kept.columns == table.columns and {r[2] for r in kept.collect()} <= {"own"}
