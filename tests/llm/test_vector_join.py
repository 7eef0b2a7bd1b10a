import numpy as np

from surfacelab.llm import vector_join as q


def brute(rows, least=0.98):
    good = [(i, np.array(e, float), k) for i, e, k in rows if i is not None and k is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i, _, _ in rows}
    for i, x, k in good:
        for j, y, m in good:
            if i != j and k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i].add(j)
    root = {i: i for i in links}
    while any(root[j] < root[i] for i in links for j in links[i]):
        for i in links:
            root[i] = min([root[i], *(root[j] for j in links[i])])
    return {(i, len(links[i]), root[i], root[i] == i) for i in links}


def sample():
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1):
        for _ in range(25):
            base = rng.normal(size=8)
            for _ in range(rng.integers(1, 9)):
                rows.append((len(rows), (base + rng.normal(size=8) * rng.choice([0, 0.01, 0.1, 0.3])).astype(np.float32).tolist(), label))
    nan, inf = float("nan"), float("inf")
    odd = [(None, 0), ([], 0), ([0.0] * 8, 0), ([nan] * 8, 0), ([inf] + [1.0] * 7, 0), ([None] + [1.0] * 7, 0), (rows[0][1], None), (rows[0][1][:5], 0), (rows[0][1], 1), ([2 * x for x in rows[0][1]], 0)]
    return rows + [(len(rows) + k, e, label) for k, (e, label) in enumerate(odd)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_equals_brute_force(spark, monkeypatch):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for leaf, parameters in ((128, {}), (1, {"fanout": 4, "node_rows": 6, "group_rows": 10})):
        monkeypatch.setattr(q, "LEAF", leaf)
        got = {tuple(r) for r in q.near_vectors(df, **parameters).collect()}
        assert got == want


def test_multiples_and_tight_groups_end(spark, monkeypatch):
    monkeypatch.setattr(q, "LEAF", 4)
    rng = np.random.default_rng(7)
    base, close, far = rng.normal(size=6), rng.normal(size=6), rng.normal(size=6)
    rows = [(k, (base * 2.0 ** (k % 40 - 20)).astype(np.float32).tolist(), 1) for k in range(40)]
    rows += [(100 + k, (base * (1 + k)).astype(np.float32).tolist(), 1) for k in range(160)]
    rows += [(300 + k, (close + rng.normal(size=6) * 0.02).astype(np.float32).tolist(), 1) for k in range(60)]
    # As near to the multiples as the threshold, so that neither bound decides.
    side = far - base * (far @ base) / (base @ base)
    edge = 0.98 * base / np.linalg.norm(base) + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side)
    rows += [(500 + k, ((edge + side * 1e-6 * (k % 3 - 1)) * (1 + k)).astype(np.float32).tolist(), 1) for k in range(30)]
    df, want = spark.createDataFrame(rows, SCHEMA), brute(rows)
    for parameters in ({}, {"fanout": 3, "node_rows": 20, "group_rows": 50}):
        assert {tuple(r) for r in q.near_vectors(df, **parameters).collect()} == want


def test_tree_levels_and_traversal(monkeypatch):
    monkeypatch.setattr(q, "LEAF", 2)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 6)), np.ones((80, 6)) + rng.normal(size=(80, 6)) * 0.05])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    tree = q.Tree(unit)
    node = tree.root
    while len(node["rows"]) > 1:
        below = tree.children(node)
        assert sorted(np.concatenate([c["rows"] for c in below])) == sorted(node["rows"])
        assert all(c["reach"] <= c["radius"] <= node["radius"] / 2 for c in below) and len(below) > 1
        node = max(below, key=lambda c: len(c["rows"]))
    ones = np.ones(len(x), np.int64)
    links, _, _ = q.traverse(tree, tree, x, x, ones, ones, 0.98, True)
    want = ((unit @ unit.T >= 0.98) & ~np.eye(len(x), dtype=bool)).sum(axis=1)
    assert np.array_equal(links, want)


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (9, [2.0, 0.0], 1)], SCHEMA).withColumn("rep", q.F.lit(0))
    got = sorted(map(tuple, q.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (3, 2, 3, True), (3, 2, 3, True), (9, 2, 3, False)], key=str)
    assert q.near_vectors(df.limit(0)).count() == 0
