import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from surfacelab.llm import token_files as q
from surfacelab.llm.shared import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a  b\n\n c\t", "It's we'll", "x<|endoftext|>y", "é 日本 \U0001f600", "\x1c\x1d z\x85\xa0w", "½² Ⅷ 12", "the cat " * 4000, "q" * 3000]


def brute(rows):
    tok, at, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(q, "BLOCK_IDS", 700)
    monkeypatch.setattr(q, "LANES", 5)
    rows = [(3 * i % 11, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (4, "again"), (4, "again")]
    df = spark.createDataFrame([r + (1,) for r in rows], "doc_id long, text string, part int").repartition(3)
    path = new_path(spark, "tokens-test")
    q.write_tokens(df, path, PATH)
    got = [tuple(r) for r in q.read_documents(spark, path).collect()]
    # Rows of equal id and text are alike, so only their order among themselves is free.
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    path = new_path(spark, "tokens-test")
    q.write_tokens(df.limit(0), path, PATH)
    assert q.read_documents(spark, path).count() == 0


def test_documents_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in q.op1_token_files(spark, sf_dir).collect())
    assert got == brute([tuple(r) for r in docs])


def test_coder_round_trip_and_size():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 50257, n) for n in (0, 1, 5, 300)] + [np.zeros(900, np.int64), np.tile(rng.integers(0, 50257, 40), 30), np.array([65534, 0, 50256] * 9)]
    coded = q.compress(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, q.expand(coded, [len(b) for b in blocks])))
    assert len(coded[4]) < 100 and len(coded[5]) < 0.4 * 2 * len(blocks[5])
    # A block's code doesn't depend on the blocks beside it.
    assert q.compress([blocks[3]])[0] == coded[3]


def test_damage_is_found():
    block = q.pack([(7, 3, 3), (None, 2, 3)], 9, 4, 5, b"\x01\x02\x03\x04")
    assert q.unpack(block) == (5, 9, 4, [(7, 3, 3), (None, 2, 3)], b"\x01\x02\x03\x04")
    for k in range(len(block)):
        with pytest.raises(ValueError):
            q.unpack(block[:k] + bytes([block[k] ^ 1]) + block[k + 1 :])


def test_crc_join():
    a, b, c = b"abc" * 50, b"", bytes(range(256)) * 40
    j = q.CrcJoin()
    assert j.join(j.join(zlib.crc32(a), zlib.crc32(b), len(b)), zlib.crc32(c), len(c)) == zlib.crc32(a + b + c)


def test_ids_that_do_not_fit_are_refused():
    for x in (65535, 70000, -1):
        with pytest.raises(ValueError):
            q.compress([np.array([1, x])])


def test_weights_learn_which_order_to_trust():
    """In a block that repeats, order 2 is right; where only the last id tells, order 1 is: the mix follows either."""
    rng = np.random.default_rng(2)
    follows = rng.permutation(2000)
    chain = [0]
    for _ in range(4000):
        chain.append(int(follows[chain[-1]]) if rng.random() < 0.9 else int(rng.integers(2000)))
    noise = rng.integers(0, 2000, 4000)
    coded = q.compress([np.array(chain), noise])
    assert len(coded[0]) < 0.8 * len(coded[1])
    assert all(np.array_equal(a, b) for a, b in zip([chain, noise], q.expand(coded, [len(chain), len(noise)])))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        q.Encoder(public_tokenizers.path("word_bpe_49k.json"))
