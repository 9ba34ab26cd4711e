import numpy as np
import pytest

from tracewright.llm import mixing

NAMES = ("clean", "low", "toxic")


def soft(seed, n=4000, sharp=2.0):
    rng = np.random.default_rng(seed)
    kind = rng.choice(3, n, p=[0.6, 0.3, 0.1])
    x = np.exp(sharp * np.eye(3)[kind] + rng.normal(size=(n, 3)))
    return rng.integers(0, 300, n), x / x.sum(1, keepdims=True)


def fitted(spark, monkeypatch, tokens, p, *args, **kw):
    rows = spark.createDataFrame([(int(n), [float(c) for c in x]) for n, x in zip(tokens, p)], "n_tokens long, posterior array<double>")
    monkeypatch.setattr(mixing, "predict", lambda *_: rows)
    mix = mixing.fit(rows, mixing.Classifier(NAMES, np.zeros((1, 3)), np.zeros(3)), *args, **kw)
    rates = [r["rate"] for r in rows.withColumn("rate", mixing._rate(mix.steps, mix.ceiling)).select("posterior", "rate", "n_tokens").collect()]
    return mix, np.array(rates)


def least_miss(tokens, p, target, w, ceiling):
    """Weighted squares of the misses after very many accelerated projected gradient steps."""
    a = p * tokens[:, None]
    top = np.linalg.eigvalsh(np.sqrt(w)[:, None] * (a.T @ p) * np.sqrt(w)).max()
    r = ahead = np.ones(len(p))
    for t in range(20_000):
        new = np.clip(ahead - p @ (w * (a.T @ ahead - target)) / top, 0, ceiling)
        if (ahead - new) @ (tokens * (new - r)) > 0:
            ahead = new
        else:
            ahead = new + t / (t + 3) * (new - r)
        r = new
    return (w * (a.T @ r - target) ** 2).sum()


@pytest.mark.parametrize("sharp", [0.7, 1.5, 3.0])
def test_attainable_targets_are_met(spark, monkeypatch, sharp):
    tokens, p = soft(1, sharp=sharp)
    rate = np.clip(1 - p @ [-0.8, 0.9, 2.5], 0, None)       # some rates that can be had
    want = (p * (tokens * rate)[:, None]).sum(0)
    mix, rates = fitted(spark, monkeypatch, tokens, p, dict(zip(NAMES, want * tokens.sum() / want.sum())))
    total = tokens.sum()
    got = (p * (tokens * rates)[:, None]).sum(0)
    reached = np.array([mix.reached[d] for d in NAMES])
    assert np.abs(got - reached).max() < 1e-6 * total and rates.min() >= 0
    assert np.abs(reached - total * want / want.sum()).max() <= mixing.CLOSE * total


@pytest.mark.parametrize(("weights", "ceiling", "keep"), [((0.2, 0.1, 0.7), None, True), ((0.9, 0.1, 0.0), None, True), ((0.9, 0.08, 0.02), 1.0, False), ((0.5, 0.2, 0.3), 1.0, True)])
def test_targets_out_of_reach_are_missed_by_the_least(spark, monkeypatch, weights, ceiling, keep):
    tokens, p = soft(2, sharp=1.0)
    mix, rates = fitted(spark, monkeypatch, tokens, p, dict(zip(NAMES, weights)), ceiling=ceiling, keep_total=keep)
    target, reached = (np.array([x[d] for d in NAMES]) for x in (mix.targets, mix.reached))
    w = 1 / ((tokens[:, None] * p).T @ p).diagonal()
    miss = (w * (reached - target) ** 2).sum()
    assert rates.min() >= 0 and (ceiling is None or rates.max() <= ceiling)
    assert np.abs(reached - target).max() <= mixing.CLOSE * target.sum() or miss <= 1.001 * least_miss(tokens, p, target, w, ceiling)
