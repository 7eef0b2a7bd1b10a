"""Operator 6, BPE encoding and decoding by batched numpy merge rounds.

A vocabulary file (JSON, BPE with word ends) is read in each task from a path parameter. A text is
cut at special tokens, composed (NFC), lower-cased and split into words; the words of a batch that
the task hasn't met are merged together: their byte symbols lie in one flat array, each round looks
all neighbour pairs up by binary search over the sorted pair keys, and merges each word's pair of
lowest rank, left to right. A very long word takes its rounds alone, so that a round looks up changed pairs only. Decoding joins the ids' token strings by a space, as the file names no decoder.

Cases: a null text is an empty one (no ids, empty decoded text); texts are processed in chunks of a
bounded number of characters, a long text alone; the memory of known words is bounded; null ids,
ties and repeated rows pass through; an empty table gives an empty result; other columns of the
input are carried under their names, except ids and decoded, which are replaced; a vocabulary file of another split pattern raises an error.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surfacelab.llm.shared import WHITE, column, others, plain, renamed, slices, table

#: The vocabulary file's split pattern (fixed value), and the same with white space written out.
FILE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+"
#: Characters of text worked on at once, known words kept, characters above which a word takes its rounds alone.
CHUNK_CHARS, KNOWN_WORDS, LONG_WORD = 1_000_000, 200_000, 1024


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class Bpe:
    """Vocabulary, sorted pair keys and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if cuts[0].get("pattern") != {"Regex": FILE_SPLIT} or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("the vocabulary must have the word pattern and the normalizers that this encoder knows, and no decoder")
        vocab, end = dict(model["vocab"]), model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (vocab | self.special).items()}
        self.tokens = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.size = len(self.tokens)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_rank = made
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.split = regex.compile(SPLIT)
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.pool, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._remember(list(self.special), np.array(list(self.special.values()), np.int32), np.ones(len(self.special), np.int64))

    def _remember(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.codes.update(zip(words, range(len(self.codes), len(self.codes) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])

    def words(self, text: str) -> list[str]:
        """Words and special tokens of a text; letters and symbols never mix in a word, so both share a name space."""
        if self.cut is not None and self.cut.search(text):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(m.group())
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # Each letter alone, so that a sigma at a word's end isn't special.
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return self.split.findall(text)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], len(self.keys))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids for each word of many non-empty words."""
        none = len(self.keys)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[flat]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_word, done_sym = [], []
        while len(sym):
            inside = word[1:] == word[:-1]
            rank = np.full(len(sym), none, np.int64)
            at = np.nonzero(inside)[0]
            rank[at] = self.lookup(sym[at], sym[at + 1])
            first = np.nonzero(np.concatenate([[True], ~inside]))[0]
            least = np.minimum.reduceat(rank, first)
            of = np.repeat(least, np.diff(np.concatenate([first, [len(sym)]])))
            over = of == none
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
                stay = ~over
                word, sym, rank, of = word[stay], sym[stay], rank[stay], of[stay]
                if not len(sym):
                    break
            hit = np.nonzero(rank == of)[0]
            # Of neighbouring hits (a pair of equal symbols in a row) every second one merges.
            fresh = np.concatenate([[True], np.diff(hit) != 1])
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[run % 2 == 0]
            sym[hit] = self.by_rank[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            word, sym = word[keep], sym[keep]
        words_of, ids = (np.concatenate(done_word), np.concatenate(done_sym)) if done_word else (np.zeros(0, np.int64),) * 2
        order = np.argsort(words_of, kind="stable")
        return ids[order], np.bincount(words_of, minlength=len(words))

    def merge_long(self, word: bytes) -> np.ndarray:
        """One word's ids by the same rounds; a round looks up only the pairs that the one before has changed."""
        none = len(self.keys)
        sym = self.first[np.frombuffer(word, np.uint8)]
        sym[-1] = self.last[word[-1]]
        rank = np.append(self.lookup(sym[:-1], sym[1:]), none)
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        alive = len(sym)
        while (least := rank.min()) < none:
            hit = np.nonzero(rank == least)[0]
            # Of neighbouring hits (a pair of equal symbols in a row) every second one merges.
            fresh = np.concatenate([[True], after[hit[:-1]] != hit[1:]])
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[run % 2 == 0]
            gone = after[hit]
            sym[hit], sym[gone], rank[gone] = self.by_rank[least], -1, none
            after[hit] = after[gone]
            follow = after[hit] < len(sym)
            before[after[hit][follow]] = hit[follow]
            left = before[hit]
            changed = np.unique(np.concatenate([hit, left[left >= 0]]))
            inside = after[changed] < len(sym)
            rank[changed] = none
            rank[changed[inside]] = self.lookup(sym[changed[inside]], sym[after[changed[inside]]])
            alive -= len(hit)
            if 2 * alive < len(sym):
                keep = sym >= 0
                sym, rank = sym[keep], rank[keep]
                after, before = np.arange(1, alive + 1), np.arange(-1, alive - 1)
        return sym[sym >= 0]

    def learn(self, words: list[str]) -> None:
        short = [w for w in words if len(w) <= LONG_WORD]
        if short:
            self._remember(short, *self.merge([w.encode() for w in short]))
        for w in words:
            if len(w) > LONG_WORD:
                ids = self.merge_long(w.encode())
                self._remember([w], ids, np.array([len(ids)], np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts and the end of each text in them."""
        if len(self.codes) > KNOWN_WORDS:
            self.forget()
        split = [self.words(t) for t in texts]
        new = set().union(*split).difference(self.codes) if split else set()
        if new:
            self.learn(sorted(new))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        per_word = self.counts[codes]
        stops = np.cumsum(per_word)
        take = np.repeat(self.starts[codes] - (stops - per_word), per_word) + np.arange(stops[-1] if len(stops) else 0)
        words = np.cumsum([len(ws) for ws in split])
        ends = np.concatenate([[0], stops])[words]
        return self.pool[take], ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of flat ids, cut at ends."""
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int64))
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.tokens.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


def _chunks(texts: list[str]):
    """(start, stop) of runs of texts of at most CHUNK_CHARS characters, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all by default) with ids (array of int) and decoded (string)."""
    carried = [c for c in others(docs, ("ids", "decoded")) if carry is None or c in carry]
    rows, names = plain(docs, carried, text=column(text).cast("string"))

    def run(batches):
        model = Bpe(vocabulary)
        for b in slices(batches):
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            for start, stop in _chunks(texts):
                ids, ends = model.encode(texts[start:stop])
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                part = b.slice(start, stop - start)
                columns = [part.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, lists, model.decode(ids, ends).cast(pa.string())], [*names, "ids", "decoded"])

    schema = rows.drop("text").schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return renamed(rows.mapInArrow(run, schema), carried)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(df: DataFrame) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 in place of ids and decoded."""
    line = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(line, 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, vocabulary_path("word_bpe_49k.json"), carry=["doc_id"]))
