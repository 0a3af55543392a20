"""The n-gram join against all pairs, along each of its ways."""

import random

import numpy as np
import pytest

from cytoloom.llm import components, ngram_join
from cytoloom.llm.ngram_join import Shape


def brute(rows, shape):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(shape.words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= shape.percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    passage = rng.choices(words, k=40)
    out = []
    for i in range(60):
        out.append(rng.choices(words, k=rng.choice((1, 2, 3, 4, 5, 30, 90))))
    base = rng.choices(words, k=120)
    for i in range(40):  # one large group of near copies, some of which only chain
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(copy)
    for i in range(40):  # a passage that many share
        out.append(rng.choices(words, k=15) + passage + rng.choices(words, k=15))
    for i in range(30):
        out.append(list(out[rng.randrange(60)]))
    chain = rng.choices(words, k=80)
    for i in range(12):
        chain = list(chain)
        chain[(i * 7) % 80] = f"x{i}"
        out.append(chain)
    rng.shuffle(out)
    return [(i * 3 + 1, (" \t\n"[i % 3]).join(w).title() if i % 4 == 0 else " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("way", ["plain", "centres", "loose", "heavy", "held", "cluster"])
def test_groups_equal_all_pairs(spark, rows, way, monkeypatch):
    shape = {"cluster": Shape(5, 80), "loose": Shape(2, 40)}.get(way, Shape())
    if way in ("centres", "loose"):  # every token of more than one class has a centre
        monkeypatch.setattr(ngram_join, "FEW", 1)
    if way == "heavy":
        monkeypatch.setattr(ngram_join, "HEAVY_LEAST", 3)
        monkeypatch.setattr(ngram_join, "HEAVY_TIMES", 1)
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 3)
        monkeypatch.setattr(ngram_join, "BROADCAST_PAIRS", 3)
    if way == "held":
        monkeypatch.setattr(ngram_join, "HELD", 3)
        monkeypatch.setattr(ngram_join, "FEW", 3)
    if way == "cluster":
        monkeypatch.setattr(ngram_join, "components", lambda e: components.components(e, one_task=0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(docs, shape=shape).collect()}
    assert got == brute(rows, shape)


def test_differences_link_what_no_centre_links(spark, monkeypatch):
    """Copies too far from the centre, of which some share their changes, are not all put in pairs."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    out = [list(base)]
    for i in range(25):
        copy = list(base)
        for at in rng.sample(range(100), 5):
            copy[at] = f"own{i}-{at}"
        out.append(copy)
        if i % 3 == 0:
            twin = list(copy)
            twin[rng.randrange(100)] = f"twin{i}"
            out.append(twin)
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = []
    second = ngram_join._second_pairs
    monkeypatch.setattr(ngram_join, "_second_pairs", lambda *a: found.append(second(*a)) or found[-1])
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(docs).collect()}
    assert got == brute(rows, Shape())
    assert found[0].count() < 30


def test_classes_of_null_ids_keep_links(spark):
    base = [f"w{i}" for i in range(60)]
    changed = [*base]
    changed[10] = "x"
    far = [*changed]
    far[40] = "y"
    rows = [(1, " ".join(base)), (None, " ".join(changed)), (9, " ".join(far)), (4, "a b c"), (None, None), (None, "a b c")]
    shape = Shape(4, 86)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(docs, shape=shape).collect()), key=str)
    assert got == sorted([(1, 57, 1), (None, 57, 1), (9, 57, 1), (4, 1, 4), (None, 0, None), (None, 1, 4)], key=str)


def test_suffix_bound_is_never_below_what_is_shared():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 400, rng.integers(0, 300))).astype(np.uint64) for _ in "xy")
        assert len(np.intersect1d(x, y)) <= ngram_join.suffix_bound(x, y, int(rng.integers(1, 80))) <= min(len(x), len(y))


def test_least_shared_differences_against_all_sizes():
    """No two similar sets around a centre share fewer differences than ``Shape.differences`` says."""
    rng = random.Random(8)
    shape = Shape(4, 80)
    for _ in range(4000):
        centre = set(range(rng.randint(1, 30)))
        change = lambda s, m: {x for x in s if rng.random() > m} | {rng.randrange(45) for _ in range(rng.randint(0, 6))}
        x = change(centre, 0.3)
        y = change(x, 0.1)
        like = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
        if not x or not y or not like(x, y) or like(x, centre):
            continue
        shared = len((x ^ centre) & (y ^ centre))
        some, _ = shape.differences(len(x ^ centre), len(x), len(centre))
        _, half = shape.differences(len(y ^ centre), len(y), len(centre))
        assert shared >= some and shared >= half
        if not like(y, centre):
            assert shared >= shape.differences(len(x ^ centre), len(x), len(centre))[1]


@pytest.mark.parametrize("extra", ["id", "ID", "__id", "component_id", "n_shingles", "c1"])
def test_one_of_each_group_stays_beside_clashing_columns(spark, extra):
    base = [f"w{i}" for i in range(60)]
    near = [*base, "z"]
    rows = [(2, " ".join(near), "a"), (1, " ".join(base), "b"), (1, " ".join(base), "b"), (3, "other words are here", "c"), (None, " ".join(base), "d"), (5, None, None)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, `{extra}` string")
    kept = ngram_join.keep_one(docs, shape=Shape(5, 80))
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[0], tuple(r)[2]) for r in kept.collect() if r[0] is not None) == [(1, "b"), (3, "c"), (5, None)]


def test_distributed_components_equal_those_of_one_task(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 40)]
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a bigint, b bigint")
    one = {tuple(r) for r in components.components(df).collect()}
    far = {tuple(r) for r in components.components(df, one_task=0).collect()}
    assert one == far and len({n for n, _ in one}) == len(one)
