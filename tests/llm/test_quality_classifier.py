import zlib

import numpy as np
import zstandard

from surfacelab.llm import quality_classifier as q


def labelled(spark, n=120):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "of", "river", "house", "walks", "green"], 80)) for _ in range(n)]
    bad = [" ".join(rng.choice(["BUY!!", "###", "$$$ now", "click|here"], 80)) for _ in range(n)]
    rows = [(i, t, k) for i, (t, k) in enumerate([(t, 1) for t in good] + [(t, 0) for t in bad])]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_separates_and_handles_odd_texts(spark):
    df = labelled(spark)
    model = q.train(df, df)
    assert all((r.score >= 0.5) == (r.label == 1) for r in q.score(df, model).collect())
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "the river", 5), (4, "x" * 300_000, 5)], "doc_id long, text string, score int")
    got = q.score(odd, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert q.score(odd.limit(0), model).count() == 0


def test_one_class_or_no_labels_give_the_share(spark):
    df = labelled(spark)
    ones = q.score(df, q.train(df, df.where("label = 1"))).select("score").distinct().collect()
    assert len(ones) == 1 and ones[0].score > 0.9
    assert q.score(df, q.train(df, df.limit(0))).first().score == 0.5


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in q.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    right = [got[r.doc_id].predicted == r.quality for r in labels if got[r.doc_id].held_out]
    assert np.mean(right) >= 0.9


def brute_score(model, text):
    """Each block with compressors of its own, sizes added up in plain Python."""
    data, sizes = (text or "").encode(), []
    for raw in (model.good, model.bad):
        total = 0
        for k in range(0, len(data), q.BLOCK_BYTES):
            total += len(zstandard.ZstdCompressor(level=q.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw)).compress(data[k : k + q.BLOCK_BYTES]))
        sizes.append(total)
    z = model.slope * ((sizes[1] - sizes[0]) / len(data) if data else 0.0) + model.intercept
    return 1 / (1 + np.exp(-z)) if abs(z) < 30 else float(z > 0)


def test_registered_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = q.train(docs, q.learnable_labels(spark, sf_dir))
    got = {r.doc_id: r.score for r in q.op2_quality_classifier(spark, sf_dir).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - brute_score(model, r.text)) < 1e-9


def test_sample_is_bounded_by_rows_and_bytes(spark):
    rows = [(1, "same id", 1)] * 5000 + [(k, "x" * 1000, 0) for k in range(2, 60)] + [(None, "null", 1)] * 50 + [(99, "y" * 5000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = q.labelled_sample(df, df.select("doc_id", "label"), 10, 2000, 4500)
    assert sorted((k, len(t)) for k, t in got) == [(0, 1000)] * 4 + [(1, 7)]
    assert len(q.labelled_sample(df, None, 10, 2000, 10**9)) == 11
