import re
import struct
from collections import Counter

import numpy as np
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline as q
from surfacelab.llm import bpe, mixing, quality_classifier, quality_rules
from tests.llm.test_quality_classifier import brute_score
from tests.llm.test_quality_rules import brute
from tests.llm.test_shingle_join import brute_kept


def passes_the_rules(text):
    n_words, chars, symbols, dup_lines, repeats = brute(text)
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    stop = {w for ws in quality_rules.STOP_WORDS.values() for w in ws}
    return bool(n_words >= 50 and repeats <= 0.5 * n_words and 2 <= chars / n_words <= 12 and symbols / n_words <= 0.1 and sum(w in stop for w in words) / n_words >= 0.06 and dup_lines / len(lines) <= 0.6)


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = q.by_rules(spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if passes_the_rules(r.text)}

    # The classifier is tried on all documents, as the rules leave few that it would reject.
    model = quality_classifier.train(docs, quality_classifier.learnable_labels(spark, sf_dir))
    good = q.by_classifier(spark, docs, sf_dir)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect() if brute_score(model, r.text) >= 0.7}
    assert 0 < good.count() < docs.count()

    single = q.near_copies(spark, kept, sf_dir).cache()
    assert {r.doc_id for r in single.collect()} == brute_kept([(r.doc_id, r.text) for r in kept.collect()])[0]

    # Rates by plain projected gradient on all rows; copies by the same hash in plain Python.
    labels = mixing.domain_labels(spark, sf_dir)
    shares = mixing.train(docs, labels)
    rows = sorted(single.collect(), key=lambda r: r.doc_id)
    found = [shares.tokens_and_posterior(r.text) for r in rows]
    n, p = np.array([x[0] for x in found], float), np.array([x[1] for x in found])
    want = (n @ p) * np.array([mixing.FACTORS[d] for d in shares.domains])
    want *= n.sum() / want.sum()
    rate = np.ones(len(n))
    for _ in range(40_000):
        rate = np.maximum(0, rate - p @ ((rate * n) @ p - want) / n.sum())
    draw = np.array([(xxhash.xxh64_intdigest(b"mix", xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)) % (1 << 30)) / (1 << 30) for r in rows])
    copies = np.floor(rate) + (draw < rate - np.floor(rate))
    mixed = q.mixture(spark, single, sf_dir).cache()
    assert mixed.columns == docs.columns
    got = Counter(r.doc_id for r in mixed.collect())
    sure = np.abs(draw - (rate - np.floor(rate))) > 0.02
    assert sure.mean() > 0.8 and all(got[r.doc_id] == c for r, c, s in zip(rows, copies, sure) if s)

    out = q.encoding(spark, mixed, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == got
    tok, texts = Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json")), {r.doc_id: r.text for r in rows}
    assert all(r.n_tokens == len(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in out)


def test_run_with_odd_rows(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, docs.first().text, "en", "s", 1)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = q.run(spark, str(tmp_path)).collect()
    assert rows and all(r.n_tokens > 0 for r in rows)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/empty/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert q.run(spark, f"{tmp_path}/empty").count() == 0


def test_own_columns_of_clashing_names_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "concat('own ', doc_id) AS n_words", "doc_id AS Score", "-doc_id AS rate", "'x' AS kept", "1 AS `a.b`", "2 AS __text", "3 AS input", "4 AS own_Score", "5 AS node_")
    for stage in (q.by_rules, q.by_classifier, q.near_copies, q.mixture):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r.n_words == f"own {r.doc_id}" and r.Score == r.doc_id and r.rate == -r.doc_id and r.kept == "x" for r in rows)
