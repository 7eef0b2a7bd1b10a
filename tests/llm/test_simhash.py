import numpy as np
import xxhash

from surfacelab.llm import simhash as q
from surfacelab.llm.components import components


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_roots(values):
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 2 and root[b] < root[a]:
                    root[a] = root[b]
                    changed = True
    return root


def test_fingerprint_equals_brute_force():
    for t in [None, "", "  ", "One", "one TWO", "a b c", "É é\x1fx y z", "w " * 500, " ".join(f"x{i % 7}" for i in range(400))]:
        assert q.fingerprint(t) & (2**64 - 1) == brute_fingerprint(t)


def clusters():
    rng = np.random.default_rng(3)
    values = set()
    for base in rng.integers(-(2**63), 2**63 - 1, 12):
        for _ in range(14):
            v = int(base)
            for k in rng.choice(64, rng.integers(0, 4), replace=False):
                v ^= (1 << int(k)) - ((1 << 64) if k == 63 else 0)
            values.add(v)
    return sorted(values)


def test_links_give_the_brute_force_components(spark):
    values = clusters()
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute_roots(values)
    for limit in (64, 2):
        got = {v: v for v in values} | {r.node: r.root for r in components(q.links(fps, pair_limit=limit)).collect()}
        assert got == want


def test_small_buckets_hold_every_link_once_or_twice(spark):
    values = clusters()
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {(r.a, r.b) for r in q.links(fps, pair_limit=10**6).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}


def test_nulls_copies_and_empty_table(spark):
    rows = [(5, "same text here again"), (3, "SAME text\there again"), (9, None), (7, ""), (None, "same text here again"), (1, "other words in this one")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in q.simhash_groups(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 7), (7, 7), (None, 3), (1, 1)}
    assert q.simhash_groups(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in q.keep_one(df).collect()) == [1, 3, 7]


def test_components_of_a_long_chain(spark):
    n = 60
    chain = spark.range(n).selectExpr("id + 1 AS a", "id AS b")
    assert {r.root for r in components(chain).collect()} == {0}
    assert components(chain).count() == n + 1
    assert components(chain.limit(0)).count() == 0
