import hashlib
import math
import re
import zlib

import numpy as np

from surfacelab.llm import resampling as q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [*w, *(" ".join(p) for p in zip(w, w[1:]))]


def brute(docs, target, percent=25, least=20, buckets=10_000):
    def count(texts):
        n = [0] * buckets
        for t in texts:
            for f in brute_features(t)[1]:
                n[zlib.crc32(f.encode()) % buckets] += 1
        return n

    s, t = count(x for _, x in docs), count(target)
    total, goal = sum(s), sum(t)
    rows = []
    for i, text in docs:
        w, f = brute_features(text)
        g = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets)))) for b in (zlib.crc32(x.encode()) % buckets for x in f)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    rank = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        rank.setdefault(r, []).append(k + 1)
    return sorted(((i, f, w, s, rank[r].pop(0) if rank.get(r := (i, n, f, w, s)) else None) for i, n, f, w, s in rows), key=str)


def test_prefix_hashes_equal_plain_crc32():
    rng = np.random.default_rng(5)
    texts = [None, b"", b" .,;", b"One", b"a\x00B\x7fc", "ÄÖ ünd É9 x".encode(), b"x" * 70_000 + b" y " + b"z" * 300]
    texts += [" ".join("ab0é"[k] * n for k, n in zip(rng.integers(0, 4, 50), rng.integers(1, 40, 50))).encode() for _ in range(5)]
    for n in (1, 2, 4):
        hashes, owners, words = q.Hasher(n).features(texts)
        for i, t in enumerate(texts):
            w = brute_features((t or b"").decode())[0]
            want = [zlib.crc32(" ".join(w[a : a + k]).encode()) for k in range(1, n + 1) for a in range(len(w) - k + 1)]
            assert hashes[owners == i].tolist() == want and words[i] == len(w)


def corpus():
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(80)]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in rng.permutation(150)]
    return docs + [(None, None), (None, " ".join(vocabulary)), (500, ""), (501, "!!"), *[(600, " ".join(vocabulary[:40]))] * 5, (600, "other text " * 30)]


def test_weights_scores_and_ranks_equal_brute_force(spark):
    docs, target = corpus(), [" ".join(f"w{k}" for k in range(0, 40)), None, "w1 w2 w3"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, at int").repartition(5)
    got = q.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"))
    rows = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str)
    assert rows == brute(docs, target)
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, sum(r[4] is not None for r in rows) + 1))


def test_the_draw_moves_towards_the_target(spark):
    rng = np.random.default_rng(2)
    docs = [(k, " ".join(rng.choice([f"{'good' if k % 4 == 0 else 'other'}{x}" for x in range(30)], 40))) for k in range(400)]
    target = spark.createDataFrame([(" ".join(f"good{x}" for x in rng.integers(0, 30, 400)),)], "text string")
    got = q.resampled(spark.createDataFrame(docs, "doc_id long, text string"), target).where("rank IS NOT NULL").collect()
    # Without a target 25 of the 100 would be of the target's words.
    assert len(got) == 100 and sum(r.doc_id % 4 == 0 for r in got) >= 60


def test_empty_tables_and_no_able_document(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert q.resampled(none, none.select("text")).count() == 0
    got = {r.doc_id: (r.n_features, r["rank"]) for r in q.resampled(some, none.select("text")).collect()}
    assert got == {1: (3, None), 2: (0, None)}
