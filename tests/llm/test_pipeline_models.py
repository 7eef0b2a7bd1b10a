import numpy as np

import corpus_pipeline as q
from surfacelab.llm import mixing

STOP = ["the", "of", "and", "to", "in", "is"]


def text(rng, own, n):
    return " ".join(rng.choice([*STOP * 8, *own], n))


def folder(spark, path):
    """Clean texts, bad ones too short for the rules, and one labelled bad document that passes them."""
    rng = np.random.default_rng(8)
    clean, spam = ([f"{c}{i}ing" for i in range(300)] for c in ("tree", "buy"))
    rows = [(i, text(rng, clean, 120), 1) for i in range(120)] + [(i, text(rng, spam, 40), 0) for i in range(120, 240)]
    rows.append((1000, text(rng, spam, 120), 0))
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_classifier_rejects_a_bad_document_that_passes_the_rules(spark, tmp_path):
    at = folder(spark, tmp_path)
    kept = q.by_rules(spark, spark.read.parquet(f"{at}/documents.parquet"), at)
    assert {r.doc_id for r in kept.collect() if r.doc_id >= 120} == {1000}
    left = {r.doc_id for r in q.by_classifier(spark, kept, at).collect()}
    assert 1000 not in left and len(left) >= 110


def test_mixing_knows_the_domains_of_all_labels(spark, tmp_path, monkeypatch):
    at = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen, solve = [], mixing.solve
    monkeypatch.setattr(mixing, "solve", lambda members, domains, *a, **k: seen.append(domains) or solve(members, domains, *a, **k))
    q.mixture(spark, docs.where("doc_id < 120"), at).count()
    assert seen == [("clean", "low")]
