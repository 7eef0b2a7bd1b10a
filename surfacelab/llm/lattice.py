"""Operator 12, language-model scores from a subword lattice: the marginal probability of a text over all its segmentations.

The pieces are those of an existing vocabulary file. A word, led by the mark of a word's start, has a lattice
whose arcs are the pieces that occur in it (a character that is no piece has one arc, its bytes). Each
segmentation is as likely as the product of its pieces; the forward recursion in log space sums over all of
them: alpha(end) = log sum exp(alpha(start) + log p(piece)). Words don't share pieces, so a text's marginal
is the product of its words' and of the end's, and a distinct word is summed once, however often it occurs.

The file's scores are ranks (that of piece k is -k), so pieces start at a Zipf share of 1 / (1 - score). On
these, expectation and maximisation learn from the training texts: the expected number of times that a
piece is used in all segmentations of all words, plus `prior` uses at the starting shares, is its next weight.

Spark counts all distinct words of all documents; sums over pieces come from every word of the training
texts. Documents meet their words' counts and probabilities in two ways: the most frequent words, at most HEAD
of at most HEAD_BYTES bytes, are broadcast; all others are joined by the word.

Cases: a null text is empty and holds the end alone; without training texts the counts are zero and the pieces
keep their starting shares; repeated rows and null ids are scored each on its own; a word of any length is
summed in blocks; what isn't valid UTF-8 is scored as U+FFFD; further input columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacelab.llm.quality_classifier import held_out
from surfacelab.llm.shared import new_path, table, written_to

#: Mark of a word's start in the vocabulary (fixed value).
MARK = "▁"
HEAD, HEAD_BYTES = 1 << 18, 64
#: Cells (words x characters) of a grid, and characters of a long word's block.
CELLS, BLOCK = 1 << 15, 2048
#: Distinct words that a counting task holds before it passes them on.
HELD = 200_000
#: A word of the table, empty: the end of a text.
END = b""


class Pieces:
    """A vocabulary as a trie with sorted transitions, its shares, and the shares of single bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        file = SentencePieceProcessor(model_file=path)
        ids = [k for k in range(file.vocab_size()) if not (file.is_control(k) or file.is_unknown(k) or file.is_unused(k))]
        bytes_ = [k for k in ids if file.is_byte(k)]
        words = [k for k in ids if not file.is_byte(k) and MARK not in file.id_to_piece(k)[1:]]
        self.texts = [file.id_to_piece(k) for k in words]
        # 256 bytes, then the end, follow the pieces; each starts at the share of the last rank.
        last = min((file.get_score(k) for k in words), default=0.0)
        share = 1 / (1 - np.array([file.get_score(k) for k in words] + [last] * 257))
        self.start = share / share.sum()
        self.bytes, self.end = len(words), len(words) + 256
        if len(bytes_) != 256:
            raise ValueError("the vocabulary must hold all bytes")
        edges: dict[tuple[int, int], int] = {}
        piece = {0: -1}
        for k, text in enumerate(self.texts):
            node = 0
            for c in text:
                node = edges.setdefault((node, ord(c)), len(edges) + 1)
            piece[node] = k
        order = sorted(edges)
        self.keys = np.array([n << 21 | c for n, c in order], np.int64)
        self.child = np.array([edges[e] for e in order], np.int64)
        self.piece = np.array([piece.get(n, -1) for n in range(len(edges) + 1)], np.int64)
        self.longest = max(map(len, self.texts))

    def arcs(self, codes: np.ndarray):
        """(row, start, length, piece) of all pieces in a grid of code points (words x characters, -1 beyond the end)."""
        row, start = (x.ravel() for x in np.indices(codes.shape))
        node, out = np.zeros(len(row), np.int64), []
        for k in range(self.longest):
            there = start + k < codes.shape[1]
            row, start, node = row[there], start[there], node[there]
            code = codes[row, start + k]
            at = np.minimum(np.searchsorted(self.keys, node << 21 | np.maximum(code, 0)), len(self.keys) - 1)
            there = (self.keys[at] == (node << 21 | np.maximum(code, 0))) & (code >= 0)
            row, start, node = row[there], start[there], self.child[at[there]]
            if not len(row):
                break
            ends = self.piece[node] >= 0
            out.append((row[ends], start[ends], np.full(int(ends.sum()), k + 1), self.piece[node[ends]]))
        return [np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the marked words, aligned to the left, and their numbers; a mark inside a word is no piece's."""
    texts = [w.decode("utf-8", "replace") for w in words]
    n = np.array([len(t) + 1 for t in texts])
    flat = np.frombuffer("".join(MARK + t for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    grid = np.full((len(words), int(n.max())), -1, np.int64)
    grid[np.arange(grid.shape[1]) < n[:, None]] = flat
    inner = grid[:, 1:]
    inner[inner == ord(MARK)] = 0x110000 + ord(MARK)
    return grid, n


def _utf8(code: int) -> bytes:
    return chr(code - 0x110000 if code >= 0x110000 else code).encode("utf-8", "replace")


class Lattice:
    """Sums over the segmentations of words under shares of the pieces."""

    def __init__(self, pieces: Pieces, share: np.ndarray):
        self.pieces, self.log = pieces, np.log(share)

    def _blocks(self, codes: np.ndarray):
        """Blocks (first, last) of characters, with the arcs that end in each: row, start, length, piece (-1: the bytes of its character), log share."""
        p, most = self.pieces, self.pieces.longest
        for first in range(0, codes.shape[1], BLOCK):
            last = min(first + BLOCK, codes.shape[1])
            low = max(0, first - most + 1)
            row, start, length, piece = p.arcs(codes[:, low:last])
            start = start + low
            own = start + length > first
            row, start, length, piece = row[own], start[own], length[own], piece[own]
            single = np.zeros((len(codes), last - first), bool)
            one = length == 1
            single[row[one], start[one] - first] = True
            r, s = np.nonzero(~single & (codes[:, first:last] >= 0))
            spelled = {c: float(sum(self.log[p.bytes + b] for b in _utf8(c))) for c in set(codes[r, s + first].tolist())}
            cost = np.concatenate([self.log[piece], np.array([spelled[c] for c in codes[r, s + first].tolist()])])
            yield first, last, (np.append(row, r), np.append(start, s + first), np.append(length, np.ones(len(r), np.int64)), np.append(piece, np.full(len(r), -1)), cost)

    def forward(self, codes: np.ndarray) -> np.ndarray:
        """log of the summed weight of all segmentations of each word's first k characters: (words, characters + 1)."""
        most = self.pieces.longest
        alpha = np.full((len(codes), codes.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for first, last, (row, start, length, _, cost) in self._blocks(codes):
            weight = np.full((last - first, most, len(codes)), -np.inf)
            weight[start + length - 1 - first, length - 1, row] = cost
            for k in range(first + 1, last + 1):
                reach = min(most, k)
                terms = weight[k - 1 - first, :reach] + alpha[:, k - reach : k][:, ::-1].T
                alpha[:, k] = _log_sum(terms)
        return alpha

    def expected(self, codes: np.ndarray, n: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in all segmentations of the words, each counted so many times."""
        p, alpha = self.pieces, self.forward(codes)
        most, out = p.longest, np.zeros(len(self.log))
        total = alpha[np.arange(len(n)), n]
        beta = np.full((len(codes), codes.shape[1] + 1), -np.inf)
        beta[np.arange(len(n)), n] = 0
        for first, last, (row, start, length, piece, cost) in reversed(list(self._blocks(codes)) if codes.shape[1] <= BLOCK else _Again(self, codes)):
            weight = np.full((last - first, most, len(codes)), -np.inf)
            weight[start + length - 1 - first, length - 1, row] = cost
            for k in range(last, first, -1):
                # The arcs that end at k hand its beta to their starts.
                reach = min(most, k)
                back = (weight[k - 1 - first, :reach] + beta[:, k])[::-1].T
                beta[:, k - reach : k] = np.logaddexp(beta[:, k - reach : k], back)
            used = times[row] * np.exp(alpha[row, start] + cost + beta[row, start + length] - total[row])
            whole = piece >= 0
            out += np.bincount(piece[whole], used[whole], minlength=len(out))
            for r, s, u in zip(row[~whole], start[~whole], used[~whole]):
                for b in _utf8(int(codes[r, s])):
                    out[p.bytes + b] += u
        return out

    def grids(self, words: list[bytes]):
        """Words of about one length together: their numbers, code points and lengths."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        first = 0
        while first < len(order):
            last = first + 1
            while last < len(order) and sizes[order[last]] <= sizes[order[first]] * 1.3 + 2 and (last + 1 - first) * (sizes[order[last]] + 1) <= CELLS:
                last += 1
            own = order[first:last]
            yield own, *_codes([words[k] for k in own])
            first = last

    def scores(self, words: list[bytes]) -> np.ndarray:
        """log10 of the marginal probability of each word; of the end for the empty one."""
        out = np.zeros(len(words))
        for own, codes, n in self.grids(words):
            out[own] = self.forward(codes)[np.arange(len(n)), n]
        out[[k for k, w in enumerate(words) if w == END]] = self.log[self.pieces.end]
        return out / np.log(10)


class _Again:
    """A long word's blocks from the last to the first, each made when it is asked for."""

    def __init__(self, lattice: Lattice, codes: np.ndarray):
        self.lattice, self.codes = lattice, codes

    def __reversed__(self):
        for first in reversed(range(0, self.codes.shape[1], BLOCK)):
            low = max(0, first - BLOCK)
            for a, z, arcs in self.lattice._blocks(self.codes[:, low : first + BLOCK]):
                if a + low == first:
                    yield first, z + low, (arcs[0], arcs[1] + low, *arcs[2:])


def _log_sum(terms: np.ndarray) -> np.ndarray:
    most = terms.max(0)
    safe = np.where(np.isfinite(most), most, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(terms - safe).sum(0))


def lowered(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: bytes' white space is the blank and 0x09 to 0x0D."""
    return text.lower().split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n, c: occurrences in all texts of docs (text binary, learn) and in those with learn; the empty word counts the texts."""

    def run(batches):
        def rows(held):
            words = list(held[0].keys() | held[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([held[0][w] + held[1][w] for w in words], pa.int64()), pa.array([held[1][w] for w in words], pa.int64())], ["word", "n", "c"])

        held = (Counter(), Counter())
        for b in batches:
            for text, learn in zip(b.column("text"), b.column("learn").to_pylist()):
                held[bool(learn)].update(lowered(text.as_py()))
                held[bool(learn)][END] += 1
                if len(held[0]) + len(held[1]) > HELD:
                    yield rows(held)
                    held = (Counter(), Counter())
        yield rows(held)

    return docs.mapInArrow(run, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def expectation(counts: DataFrame, pieces, share) -> np.ndarray:
    """Expected uses of every piece over all words of counts (word, c); pieces and share are broadcast."""

    def run(batches):
        lattice = Lattice(pieces.value, share.value)
        total = np.zeros(len(share.value))
        for b in batches:
            words, times = b.column("word").to_pylist(), b.column("c").to_numpy()
            for own, codes, n in lattice.grids(words):
                total += lattice.expected(codes, n, times[own])
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

    got = counts.where("c > 0 AND octet_length(word) > 0").select("word", "c").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
    out = np.zeros(len(share.value))
    out[got.column("piece").to_numpy()] = got.column("uses").to_numpy()
    return out


def learned(counts: DataFrame, pieces: Pieces, texts: int, rounds: int, prior: float) -> np.ndarray:
    """Shares of the pieces after rounds of expectation and maximisation over counts (word, c) of so many texts."""
    spark, share = counts.sparkSession, pieces.start
    held = spark.sparkContext.broadcast(pieces)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(share)
        uses = expectation(counts, held, sent) + prior * pieces.start
        uses[pieces.end] += texts
        share = uses / uses.sum()
        sent.unpersist()
    return share


def lexicon(counts: DataFrame, pieces: Pieces, share: np.ndarray) -> DataFrame:
    """counts with log10 of each word's marginal probability."""
    spark = counts.sparkSession
    held, sent = spark.sparkContext.broadcast(pieces), spark.sparkContext.broadcast(share)

    def run(batches):
        lattice = Lattice(held.value, sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lattice.scores(b.column("word").to_pylist()), pa.float64())], ["word", "n", "c", "score"])

    return counts.select("word", "n", "c").mapInArrow(run, "word binary, n long, c long, score double")


def head(words: DataFrame):
    """The most frequent words of a lexicon, at most HEAD of at most HEAD_BYTES bytes, and the condition that selects the others."""
    step = F.floor(8 * F.log2("n"))
    short = F.octet_length("word") <= HEAD_BYTES
    # Counts up to 2**63 fall into at most 504 steps.
    steps = sorted((tuple(r) for r in words.where(short & (F.col("n") > 0)).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, so_far = float("inf"), 0
    for at, k in steps:
        so_far += k
        if so_far > HEAD:
            break
        least = at
    inside = short & (step >= F.lit(least))
    return words.where(inside).select("word", "c", "score").toArrow(), ~inside


class LanguageModel:
    """Counts and shares learned from those of docs (doc_id, text, learn) with learn, and the scores of all of docs.

    paths lists the tables that it has written; they may be removed once its scores are.
    """

    def __init__(self, docs: DataFrame, path: str, rounds: int = 3, prior: float = 1000.0):
        self.spark, self.paths = docs.sparkSession, []
        text = F.col("text").cast("string").cast("binary").alias("text")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.coalesce(F.col("learn"), F.lit(False)).alias("learn"))
        counts = self._kept(word_counts(self.docs.select("text", "learn")), "lattice-counts")
        sums = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(F.octet_length("word") == 0, F.col("c")))).first()
        self.tokens, self.distinct, texts = (x or 0 for x in sums)
        self.pieces = Pieces(path)
        self.share = learned(counts, self.pieces, texts, rounds, prior)
        self.words = self._kept(lexicon(counts, self.pieces, self.share), "lattice-words")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return written_to(df, self.paths[-1])

    def scores(self) -> DataFrame:
        """doc_id, n_tokens, n_known, base_score, score of every row."""
        frequent, rest = head(self.words)
        sent = self.spark.sparkContext.broadcast((frequent.column("word").to_pylist(), frequent.column("c").to_numpy(), frequent.column("score").to_numpy()))
        low = np.log10(self.tokens + 0.1 * (self.distinct + 1))

        def run(batches):
            words, c, score = sent.value
            at = {w: k for k, w in enumerate(words)}
            base = np.log10(c + 0.1) - low
            for b in batches:
                out, others, times, ends = ([], [], [], []), [], [], [0]
                for text in b.column("text"):
                    counted = Counter(lowered(text.as_py()))
                    counted[END] += 1
                    place = np.fromiter((at.get(w, -1) for w in counted), np.int64, len(counted))
                    n = np.fromiter(counted.values(), np.int64, len(counted))
                    there = place >= 0
                    k, m = place[there], n[there]
                    for x, v in zip(out, (int(n.sum()), int(m[c[k] > 0].sum()), float(m @ base[k]), float(m @ score[k]))):
                        x.append(v)
                    if not there.all():
                        rare = [w for w in counted if w not in at]
                        others.extend(rare), times.extend(counted[w] for w in rare)
                    ends.append(len(others))
                pairs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(others, pa.binary()), pa.array(times, pa.int64())], ["word", "n"]))
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, types)), pairs], ["doc_id", "n_tokens", "n_known", "base_score", "score", "others"])

        told = self.docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, others array<struct<word: binary, n: long>>")
        told = self._kept(told.withColumn("row", F.monotonically_increasing_id()), "lattice-documents")
        pairs = told.select("row", F.inline("others")).join(self.words.where(rest).select("word", "c", "score"), "word")
        sums = pairs.groupBy("row").agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * (F.log10(F.col("c") + 0.1) - F.lit(float(low)))).alias("base"), F.sum(F.col("n") * F.col("score")).alias("own")
        )
        add = [(F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("n_known", "known"), ("base_score", "base"), ("score", "own"))]
        return told.drop("others").join(sums, "row", "left").select("doc_id", "n_tokens", *add)


def op12_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("learn", ~held_out(10, 0))
    model = LanguageModel(docs, public_tokenizers.path("piece_bpe_32k.model"))
    got = model.scores().withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return got.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
