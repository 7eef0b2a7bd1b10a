import zlib

import numpy as np

from surfacelab.llm import language as q

EN = "the river was wide and the house stood there with them when they were walking home"
RU = "она пошла домой и увидела большой город где жили люди которые любили читать книги"
FR = "la maison est grande et les enfants jouent dans le jardin avec leurs amis pendant que nous lisons"


def model():
    return q.fit([("en", EN), ("ru", RU), ("fr", FR)] * 3)


def test_spans_of_mixed_text(spark):
    df = spark.createDataFrame([(1, f"{EN}. {RU}! {FR}", 0), (2, RU, 0), (3, None, 0), (4, "12 ... ½", 0), (None, EN.upper(), 0), (6, "", 0), (6, "", 0)], "doc_id long, text string, score int")
    rows = q.identify(df, model()).collect()
    got = {r.doc_id: r for r in rows}
    assert [s.lang for s in got[1].spans] == ["en", "ru", "fr"] and sum(s.words for s in got[1].spans) == len(q.words_of(f"{EN} {RU} {FR}"))
    assert got[2].lang_pred == "ru" and got[None].lang_pred == "en" and got[None].score == 1.0
    assert [got[k].lang_pred for k in (3, 4, 6)] == ["und"] * 3 and len(rows) == 7
    assert q.identify(df.limit(0), model()).count() == 0
    assert {r.lang_pred for r in q.identify(df, q.fit([])).collect()} == {"und"}


def test_paths_equal_brute_force():
    rng = np.random.default_rng(2)
    own = q.Labeller(model())
    sizes = np.array([0, 5, 1, 7, 3])
    scores = rng.normal(0, 9, (sizes.sum(), 3)).astype(np.float32)
    at = 0
    for n, path in zip(sizes, own._paths(scores, sizes)):
        part = scores[at : at + n].astype(float)
        at += n
        best = max((sum(part[i, p] for i, p in enumerate(c)) - q.SWITCH * sum(x != y for x, y in zip(c, c[1:])) for c in np.ndindex(*[3] * n)), default=0)
        got = sum(part[i, p] for i, p in enumerate(path)) - q.SWITCH * sum(x != y for x, y in zip(path, path[1:]))
        assert abs(got - best) < 1e-6


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in q.op5_language(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in docs if got[r.doc_id].held_out]) >= 0.97
