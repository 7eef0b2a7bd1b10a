import numpy as np

import corpus_pipeline
from surfacelab.llm import shingle_join as q
from surfacelab.llm import simhash


def near_texts():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(3000)])
    shared = list(rng.choice(words, 30))
    rows = []
    for _ in range(12):
        base = list(rng.choice(words, rng.integers(60, 200))) + shared
        for k in range(8):
            t = list(base)
            for i in rng.choice(len(t), k // 2, replace=False):
                t[i] = str(rng.choice(words))
            rows.append(" ".join(t))
    rows += ["one two", "one  TWO", "", "only three words", " ".join(shared)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[i]) for i in order]


def brute_kept(rows):
    grams = {}
    for i, t in rows:
        w = (t or "").lower().split()
        grams[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = [(a, b) for a in grams for b in grams if a < b and 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b])]
    root = {i: i for i in grams}
    while any(root[a] != root[b] for a, b in near):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    return {i for i in root if root[i] == i}, near


def test_stage_removes_near_copies_beyond_two_bits(spark, sf_dir):
    rows = near_texts()
    want, near = brute_kept(rows)
    prints = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in rows}
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in near) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want


def test_stage_on_the_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {r.doc_id for r in stage(spark, docs, sf_dir).collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])[0]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "A b  c"), (2, None), (3, ""), (None, None), (4, "A b  c")], "doc_id long, text string")
    assert [(r.doc_id, (r.text or "").lower().split()) for r in q.keep_one(df).orderBy("doc_id").collect()] == [(2, []), (4, ["a", "b", "c"])]
    assert q.keep_one(df.limit(0)).count() == 0


def test_a_text_is_not_lost_with_its_id(spark):
    """Rows that share an id are judged by their texts; columns of clashing and dotted names are carried."""
    one, two, three = ("x1 x2 x3 x4 x5 x6 x7", "y1 y2 y3 y4 y5 y6 y7", "z1 z2 z3 z4 z5 z6 z7")
    rows = [(3, one), (5, one), (5, two), (7, three), (7, three), (None, three), (None, "only here"), (None, "only here")]
    df = spark.createDataFrame([(i, t, k, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node_ int, maybe_ int, `a.b` int")
    want = sorted([(3, one), (5, two), (7, three), (None, "only here")], key=str)
    for keep in (q.keep_one, simhash.keep_one):
        out = keep(df)
        assert out.columns == df.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want


def test_prefix_bound_leaves_no_similar_pair_out():
    rng = np.random.default_rng(9)
    often = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    met = 0
    for _ in range(4000):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 10**6, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.choice([0.8, 0.9, 1])], rng.integers(0, 10**6, rng.integers(0, 1 + n // 4)).astype(np.uint64)]))
        if len(y) and q.similar(x, y):
            shared = len(np.intersect1d(q.prefix(x, often), q.prefix(y, often)))
            need = -(-80 * (len(x) + len(y)) // 180) - (-(-80 * max(len(x), len(y)) // 100) - 1)
            assert shared >= max(1, need)
            assert q.may_be_similar(q.parities(x), q.parities(y), len(x), len(y))
            met += 1
    assert met > 500
    # Sets that differ by a third are mostly ruled out by their parities alone.
    out = 0
    for n in (100, 300, 2000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[: int(0.8 * len(x))], rng.integers(0, 2**63, n // 5).astype(np.uint64)]))
            out += not q.may_be_similar(q.parities(x), q.parities(y), len(x), len(y))
    assert out > 50


def test_marks_in_the_join_follow_their_bound(spark):
    """The SQL bound on marks never excludes a similar pair, and says the same as the parities of as many slots."""
    rng = np.random.default_rng(11)
    rows, said = [], []
    for n in (1, 20, 90, 110, 400, 3000):
        for share in (0.7, 0.85, 0.88, 0.95, 1):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[: int(np.ceil(share * len(x)))], rng.integers(0, 2**63, int((1 - share) * n)).astype(np.uint64)]))
            mx, my = (q.mark(q.parities(s)) for s in (x, y))
            said.append((q.may_be_similar(mx.tobytes(), my.tobytes(), len(x), len(y)), q.similar(x, y)))
            rows.append((len(rows), len(x), len(y), mx.tolist(), my.tolist()))
    df = spark.createDataFrame(rows, "k int, na int, nb int, ma array<long>, mb array<long>")
    kept = {r.k for r in df.where(q._may_match("na", "nb", "ma", "mb", 80)).collect()}
    assert all(k in kept for k, (_, similar) in enumerate(said) if similar)
    assert all((k in kept) >= may for k, (may, _) in enumerate(said))
    assert 5 < len(kept) < len(rows)


def test_parts_of_similar_sets_meet():
    """Of two similar sets of any sizes, a part at the larger one's level is similar, and its prefixes share as many buckets as the join asks for."""
    rng = np.random.default_rng(21)
    often = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    levels = set()
    for n in (5, 200, 255, 256, 257, 300, 512, 513, 1000, 2050, 5000):
        for share in (0.9, 0.92, 0.98, 1):
            x = np.unique(rng.integers(0, 2**64, n, np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) < share], rng.integers(0, 2**64, int((1 - share) * n), np.uint64)]))
            if not q.similar(x, y):
                continue
            px, py = ({(level, place): (own, m, mark, set(buckets)) for level, place, own, m, mark, buckets in q.parts(s, often)} for s in (x, y))
            met = []
            for at in px.keys() & py.keys():
                (ownx, mx, markx, bx), (owny, my, marky, by) = px[at], py[at]
                need = -(-80 * (mx + my) // 180) - (-(-80 * max(mx, my) // 100) - 1)
                ok = 100 * min(mx, my) >= 80 * max(mx, my) and q.may_be_similar(markx.tobytes(), marky.tobytes(), mx, my)
                met.append((ownx or owny) and ok and len(bx & by) >= max(1, need))
            assert any(met)
            levels |= {level for level, _ in px}
    assert len(levels) > 4 and all(sum(m for level, _, own, m, *_ in q.parts(x, often) if own) == len(x) for x in (x, y))


def test_a_large_group_is_not_made_into_pairs(spark, monkeypatch):
    """Near copies of one text, many of them not similar to each other, are joined by a number of verified pairs that grows with their number."""
    rng = np.random.default_rng(17)
    base, rows = [f"b{i}" for i in range(150)], []
    for k in range(300):
        t = list(base)
        for i in rng.choice(len(t), 1 + k % 4, replace=False):
            t[i] = f"x{rng.integers(10**6)}"
        rows.append((k, " ".join(t)))
    seen, old = [], q.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return old(pairs, *rest)

    monkeypatch.setattr(q, "verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, near = brute_kept(rows)
    assert len(near) > 10 * len(rows)
    assert {r.doc_id for r in q.keep_one(docs).collect()} == want
    assert sum(seen) <= 3 * len(rows)


def test_parts_tell_large_sets_apart():
    """Sets of some 2000 elements and similarity a half fill the slots of a whole set's mark, but not those of their parts."""
    rng = np.random.default_rng(19)
    often = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    whole = passed = places = 0
    for _ in range(10):
        x = np.unique(rng.integers(0, 2**64, 2000, np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[: int(len(x) * 2 / 3)], rng.integers(0, 2**64, len(x) // 3, np.uint64)]))
        whole += q.may_be_similar(q.mark(q.parities(x)).tobytes(), q.mark(q.parities(y)).tobytes(), len(x), len(y))
        px, py = ({p[:2]: p for p in q.parts(s, often) if p[2]} for s in (x, y))
        both = px.keys() & py.keys()
        places += len(both)
        passed += sum(q.may_be_similar(px[k][4].tobytes(), py[k][4].tobytes(), px[k][3], py[k][3]) for k in both)
    assert whole == 10 and places >= 60 and passed <= places // 20
