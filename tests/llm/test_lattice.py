import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from surfacelab.llm import lattice as q

PATH = public_tokenizers.path("piece_bpe_32k.model")
#: Stands for a mark inside a word, which is no piece's.
INNER = "\U0010ffff"
WHITE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def pieces():
    return q.Pieces(PATH)


def words_of(text):
    return [w for w in "".join(" " if c in WHITE else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]


def segmentations(pieces, word):
    """All (ids) of a word's segmentations; a character that is no piece is its bytes."""
    number = {t: k for k, t in enumerate(pieces.texts)}
    text = [q.MARK, *(INNER if c == q.MARK else c for c in word)]

    def walk(i):
        if i == len(text):
            yield ()
        for j in range(i + 1, len(text) + 1):
            k = number.get("".join(text[i:j]))
            if k is not None:
                yield from ((k, *rest) for rest in walk(j))
            elif j == i + 1:
                yield from ((*(pieces.bytes + b for b in text[i].replace(INNER, q.MARK).encode()), *rest) for rest in walk(j))

    return list(walk(0))


def brute_score(pieces, share, word):
    return math.log10(sum(math.prod(share[k] for k in s) for s in segmentations(pieces, word)))


WORDS = ["the", "nation", "x", "é", "zäh", "日本語", "a▁b", "q\U0001f600x", "12,50", "e0e0", "\x00\x7f"]


def test_forward_sums_all_segmentations(pieces):
    share = np.random.default_rng(1).dirichlet(np.ones(len(pieces.start)))
    got = q.Lattice(pieces, share).scores([w.encode() for w in WORDS])
    assert np.allclose(got, [brute_score(pieces, share, w) for w in WORDS], rtol=1e-10)


def test_expected_uses_are_those_of_all_segmentations(pieces):
    lattice = q.Lattice(pieces, pieces.start)
    want = np.zeros(len(pieces.start))
    for w, times in zip(WORDS, range(1, 20)):
        all_ = segmentations(pieces, w)
        weight = np.array([math.prod(pieces.start[k] for k in s) for s in all_])
        for s, p in zip(all_, weight / weight.sum()):
            for k in s:
                want[k] += p * times
    got = np.zeros_like(want)
    for own, codes, n in lattice.grids([w.encode() for w in WORDS]):
        got += lattice.expected(codes, n, np.arange(1, 20)[own])
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_long_words_are_summed_in_blocks(pieces, monkeypatch):
    word = ("internationalisierung" * 12 + "é▁日").encode()
    lattice = q.Lattice(pieces, pieces.start)
    codes, n = q._codes([word])
    whole, uses = lattice.forward(codes), lattice.expected(codes, n, np.array([3]))
    monkeypatch.setattr(q, "BLOCK", 20)
    assert np.allclose(lattice.forward(codes), whole) and np.allclose(lattice.expected(codes, n, np.array([3])), uses)


def test_shares_are_a_distribution_over_strings(pieces):
    # Over one-letter alphabets the marginals of all words of up to 5 letters sum to less than one.
    words = [("a" * k).encode() for k in range(1, 6)]
    assert 0 < (10 ** q.Lattice(pieces, pieces.start).scores(words)).sum() < 1 and abs(pieces.start.sum() - 1) < 1e-12


def rows(n=60):
    rng = np.random.default_rng(8)
    vocabulary = ["der", "the", "Nation", "of", "ly", "zusammen", "été", "12%", "\x0bword", "a▁b"]
    docs = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 30))) + (f" only{k}\n" if k % 3 else "")) for k in range(n)]
    return docs + [(None, None), (None, ""), (7, "the"), (7, "the"), (500, "x" * 9000)]


def learns(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 != 0


def brute(pieces, share, docs):
    learned = Counter(w for i, t in docs if learns(i) for w in [*words_of(t), ""])
    total, distinct = sum(learned.values()), len(learned)
    lattice = q.Lattice(pieces, share)
    out = []
    for i, t in docs:
        tokens = [*words_of(t), ""]
        base = sum(math.log10((learned[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        score = sum(math.log10(share[pieces.end]) if not w else brute_score(pieces, share, w) if len(w) < 20 else float(lattice.scores([w.encode()])[0]) for w in tokens)
        out.append((str(i), len(tokens), sum(learned[w] > 0 for w in tokens), base, score))
    return sorted(out), total


@pytest.mark.parametrize("head", [1 << 18, 3, 0])
def test_scores_equal_brute_force(spark, pieces, monkeypatch, head):
    monkeypatch.setattr(q, "HEAD", head)
    monkeypatch.setattr(q, "HELD", 5)
    docs = rows()
    df = spark.createDataFrame([(i, t, "x", 1, learns(i)) for i, t in docs], "doc_id long, text string, word string, n int, learn boolean").repartition(4)
    model = q.LanguageModel(df, PATH, rounds=2)
    want, total = brute(pieces, model.share, docs)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in model.scores().collect())
    assert model.tokens == total and [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9)


def test_each_round_makes_the_training_texts_likelier(spark, pieces):
    counts = spark.createDataFrame([(w.encode(), n, n) for w, n in [("nation", 40), ("national", 9), ("zusammen", 30), ("été", 5), ("", 10)]], "word binary, n long, c long")
    lists = [(r.word, r.c) for r in counts.collect()]
    likely = []
    for rounds in range(4):
        share = q.learned(counts, pieces, 10, rounds, 0.01)
        likely.append(sum(n * s for (_, n), s in zip(lists, q.Lattice(pieces, share).scores([w for w, _ in lists]))))
    assert likely == sorted(likely) and likely[3] > likely[0]


def test_empty_table_and_nothing_to_learn_from(spark, pieces):
    none = spark.createDataFrame([], "doc_id long, text string, learn boolean")
    assert q.LanguageModel(none, PATH).scores().count() == 0
    some = q.LanguageModel(spark.createDataFrame([(1, "a the", False)], none.schema), PATH)
    (r,) = some.scores().collect()
    assert some.tokens == 0 and r.n_known == 0 and r.base_score == 0.0 and r.score < 0
    assert np.allclose(some.share, pieces.start)
