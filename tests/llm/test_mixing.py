import numpy as np

from surfacelab.llm import mixing as q


def corpus(spark):
    rng = np.random.default_rng(4)
    common = ["and", "the", "of", "a", "to"]
    own = {"clean": ["tree", "lake", "hill"], "low": ["buy", "now", "click"], "toxic": ["scum", "trash", "vile"]}
    rows = []
    for i in range(300):
        d = ["clean", "clean", "clean", "low", "toxic"][i % 5]
        rows.append((i, " ".join(rng.choice(common + own[d], rng.integers(5, 60))), d))
    return spark.createDataFrame(rows, "doc_id long, text string, domain string")


def test_totals_match_targets_and_equal_brute_force(spark):
    df = corpus(spark)
    model = q.train(df, df)
    members = q.memberships(df.select("doc_id", "text"), model)
    plan = q.solve(members, model.domains, {"clean": 0.2, "low": 0.2, "toxic": 0.6}, rounds=400, tolerance=1e-7)
    rows = q.with_rates(members, plan).collect()
    n, p, r = (np.array([x[c] for x in rows], float) for c in ("n_tokens", "posterior", "rate"))
    assert (r >= 0).all() and abs(p.sum(axis=1) - 1).max() < 1e-9
    want = n.sum() * np.array([0.2, 0.2, 0.6])
    assert np.allclose((r * n) @ p, want, atol=1e-4 * n.sum())
    # Plain projected gradient on all rates at once, from the same start, meets the same totals.
    rate = np.ones(len(n))
    for _ in range(4000):
        rate = np.maximum(0, rate - p @ ((rate * n) @ p - want) / n.sum())
    assert np.allclose((rate * n) @ p, want, atol=1e-3 * n.sum())


def test_classifier_finds_the_domains(spark):
    df = corpus(spark)
    model = q.train(df, df)
    rows = q.memberships(df, model).collect()
    assert np.mean([model.domains[int(np.argmax(r.posterior))] == r.domain for r in rows]) > 0.95
    assert all(r.n_tokens == len(r.text.split()) for r in rows)


def test_odd_rows(spark):
    df = corpus(spark)
    model = q.train(df, df)
    odd = spark.createDataFrame([(1, None, 0), (None, "", 0), (3, "scum " * 50_000, 0), (3, "tree", 0), (3, "tree", 0)], "doc_id long, text string, rate int")
    got = q.with_rates(q.memberships(odd, model), q.solve(q.memberships(odd, model), model.domains, q.TARGETS)).collect()
    assert len(got) == 5 and got[3].rate == got[4].rate and got[0].n_tokens == 0
    empty = odd.limit(0)
    assert q.with_rates(q.memberships(empty, model), q.solve(q.memberships(empty, model), model.domains, q.TARGETS)).count() == 0
    alone = q.train(df, df.limit(0))
    assert alone.domains == ("all",) and q.with_rates(q.memberships(odd, alone), q.solve(q.memberships(odd, alone), alone.domains)).first().rate == 1.0


def test_mixed_rows_follow_the_factors(spark):
    df = corpus(spark)
    out = q.mix(df.drop("domain"), df.select("doc_id", "domain"), factors={"toxic": 0.0})
    assert out.columns == ["doc_id", "text"]
    left = {r.doc_id for r in out.collect()}
    assert len([i for i in left if i % 5 == 4]) < 20 and len([i for i in left if i % 5 < 3]) >= 165


def test_registered_query_equals_brute_force(spark):
    """Posteriors from the whole weight table, rates by plain projected gradient on all rows at once."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = q.train(docs.select("doc_id", "text"), q.domain_labels(spark, sf_dir))
    got = {r.doc_id: r for r in q.op10_mixing(spark, sf_dir).collect()}
    ids, n, p = [], [], []
    for r in docs.select("doc_id", "text").collect():
        words = (r.text or "").lower().split()
        z = model.bias.copy()
        for w in set(words):
            if w in model.words:
                z = z + model.weights[model.words[w]]
        e = np.exp(z - z.max())
        ids.append(r.doc_id), n.append(len(words)), p.append(e / e.sum())
    n, p = np.array(n, float), np.array(p)
    assert all(got[i].n_tokens == k for i, k in zip(ids, n)) and np.allclose([[got[i][f"p_{d}"] for d in model.domains] for i in ids], p, atol=1e-9)
    want = n.sum() * np.array([q.TARGETS[d] for d in model.domains])
    rate = np.array([got[i].rate for i in ids])
    assert np.abs((rate * n) @ p - want).max() <= 2e-5 * n.sum()
    plain = np.ones(len(n))
    for _ in range(40_000):
        plain = np.maximum(0, plain - p @ ((plain * n) @ p - want) / n.sum())
    assert np.abs((plain * n) @ p - want).max() <= 1e-4 * n.sum()
    assert np.abs(plain - rate).max() < 0.05
    assert all(got[i].copies in (int(r), int(r) + 1) for i, r in zip(ids, rate))
