import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from surfacelab.llm import bpe as q

TEXTS = [None, "", "  \n", "It's we'll THEY'RE", "Été ça va 12345", "Σας ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "é́é İ ǅ ﬁ", "日本語 テスト русский", "aaaaaaaaaaaaaaa bbbb" * 30, "!!!???...$$$", "x y z\x85w\x1c\x1fv", "\U0001f600\U0001f601 👩‍👩‍👧", "word " * 300, "q" * 6000 + "the" * 900]


@pytest.fixture(scope="module")
def path():
    return q.vocabulary_path("word_bpe_49k.json")


def test_equals_the_library(spark, path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (-1, None)], "doc_id long, text string")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    rows = q.encode_decode(docs.unionByName(extra), path).collect()
    assert len(rows) == docs.count() + len(TEXTS) + 2
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids, r.text
        assert r.decoded == tok.decode(ids, skip_special_tokens=False)


def test_digests_and_carried_columns(spark, path):
    df = spark.createDataFrame([(1, "It's 12", "clash")], "doc_id long, text string, ids string")
    r = q.digests(q.encode_decode(df, path)).first()
    ids = Tokenizer.from_file(path).encode("It's 12", add_special_tokens=False).ids
    assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert q.encode_decode(df.limit(0), path).count() == 0


def test_rounds_alone_and_small_memory_agree(path, monkeypatch):
    model = q.Bpe(path)
    rng = np.random.default_rng(3)
    words = [w.encode() for w in ["aaaa", "aaaaa", "thethethe", "mississippi", "z", "ééé", *("".join(rng.choice(list("aaethinrs"), n)) for n in (20, 300, 3000))]]
    ids, counts = model.merge(words)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [list(model.merge_long(w)) for w in words]
    monkeypatch.setattr(q, "KNOWN_WORDS", 1)
    monkeypatch.setattr(q, "CHUNK_CHARS", 3)
    texts = ["one two", "", "two three", "four"]
    want, ends = model.encode(texts)
    parts = [model.encode(texts[a:b])[0] for a, b in q._chunks(texts)]
    assert np.array_equal(want, np.concatenate(parts)) and list(ends) == list(np.cumsum([len(model.encode([t])[0]) for t in texts]))


def test_registered_query_equals_the_library(spark, path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    tok = Tokenizer.from_file(path)
    want = {}
    for r in docs:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in q.op6_bpe(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_other_pattern_is_refused(path, tmp_path):
    text = open(path, encoding="utf-8").read()
    (tmp_path / "other.json").write_text(text.replace("'s|'t|", "'s|"), encoding="utf-8")
    with pytest.raises(ValueError):
        q.Bpe(str(tmp_path / "other.json"))
