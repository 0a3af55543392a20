"""The quality classifier's risk, its sums and its last step."""

import numpy as np
import pytest

from cytoloom.llm import quality as q


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    good = rng.random(400) < 0.4
    x = rng.random((400, len(q.STATISTICS))) * 0.5
    x[good, :4] += 0.35
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "id bigint, x array<float>").repartition(5).cache()
    known = spark.createDataFrame([(int(i),) for i in np.flatnonzero(good)[:90]], "id bigint")
    return df, df.join(known, "id", "left_semi").select("x").cache(), x.astype(np.float32).astype(float), good


@pytest.mark.parametrize("fan", [1 << 20, 2])
def test_sums_of_tasks_equal_those_of_rows(spark, table, fan, monkeypatch):
    df, _, x, _ = table
    monkeypatch.setattr(q, "FAN", fan)
    basis = q._basis(df)
    a = basis(x)
    w = np.linspace(-0.2, 0.2, a.shape[1])
    p = 1 / (1 + np.exp(-a @ w))
    sx, sxx, loss, n = q._sums(df, basis, w)
    assert n == 400 and np.allclose(sx, a.T @ p) and np.allclose(sxx, (a * (p * (1 - p))[:, None]).T @ a)
    assert np.isclose(loss, np.log1p(np.exp(a @ w)).sum())


@pytest.mark.parametrize("damping", [0.2, 1e-3])
def test_the_risk_is_least_and_never_negative(spark, table, damping, monkeypatch):
    monkeypatch.setattr(q, "DAMPING", damping)
    df, positives, x, good = table
    basis = q._basis(df)
    mean_p, n = q._mean_of(positives, basis)
    assert n == 90
    prior = 0.4
    w = q._fit(df, positives, basis, mean_p, prior)
    a = basis(x)
    known = basis(np.array([r.x for r in positives.collect()], float))

    def risk(v):
        return np.log1p(np.exp(a @ v)).mean() - prior * mean_p @ v + q.DAMPING / 2 * v[1:] @ v[1:]

    def negatives(v):
        return np.log1p(np.exp(a @ v)).mean() - prior * np.log1p(np.exp(known @ v)).mean()

    assert negatives(w) >= 0 and risk(w) < risk(np.zeros_like(w))
    assert ((a @ w > 0) == good).mean() > 0.85
    if damping == 0.2:  # with little damping so few rows are told apart wholly, and the correction stops the steps
        rng = np.random.default_rng(1)
        for size in (0.01, 0.1):
            for _ in range(100):
                assert risk(w) <= risk(w + rng.normal(0, size, len(w))) + 1e-6


def test_a_step_that_was_not_looked_at_is_not_returned(spark, table, monkeypatch):
    df, positives, _, _ = table
    basis = q._basis(df)
    mean_p, _ = q._mean_of(positives, basis)
    monkeypatch.setattr(q, "STEPS", 1)
    assert not q._fit(df, positives, basis, mean_p, 0.4).any()
