import numpy as np
import pytest

from surfacelab.llm import mixing as q

DOMAINS = ("clean", "low", "toxic")


def skewed(spark, shares, n=4000):
    rng = np.random.default_rng(11)
    true = rng.choice(3, n, p=shares)
    z = rng.normal(0, 1, (n, 3)) + 4 * np.eye(3)[true] + np.log(shares)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    return spark.createDataFrame([(i, int(rng.integers(20, 400)), p[i].tolist()) for i in range(n)], "doc_id long, n_tokens long, posterior array<double>")


@pytest.mark.parametrize("shares", [(0.95, 0.04, 0.01), (0.98, 0.015, 0.005), (0.995, 0.0045, 0.0005)])
def test_rare_domains_reach_the_default_targets(spark, shares):
    members = skewed(spark, shares)
    plan = q.solve(members, DOMAINS, q.TARGETS)
    rows = q.with_rates(members, plan).collect()
    n, p, r = (np.array([x[c] for x in rows], float) for c in ("n_tokens", "posterior", "rate"))
    assert (r >= 0).all() and np.abs((r * n) @ p / n.sum() - [q.TARGETS[d] for d in DOMAINS]).max() <= q.TOLERANCE


def test_targets_out_of_reach_are_reported(spark):
    members = spark.createDataFrame([(i, 10, [0.6, 0.4] if i % 2 else [0.7, 0.3]) for i in range(50)], "doc_id long, n_tokens long, posterior array<double>")
    with pytest.warns(RuntimeWarning, match="miss the targets"):
        plan = q.solve(members, ("a", "b"), {"a": 0.1, "b": 0.9})
    assert plan.miss > 0.1 and np.isfinite(plan.weights).all()
