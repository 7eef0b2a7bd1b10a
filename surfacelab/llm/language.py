"""Operator 5, language identification: script ranges, per-word scores and a Viterbi path.

A word is a run of letters, in lower case. Its script (from code-point ranges) leaves the languages that use
that script; each of them scores the word by the log frequencies of its letter n-grams and of the
word itself. The best path over a text's words, at a penalty for each switch of language, labels spans;
the language with most words is the text's, its share of words the score.

Counts come from a bounded sample: sample_docs texts of at most sample_bytes bytes (and total_bytes together), shared among the
languages, chosen by a hash of the id. Labelling reads every whole text; all texts of a batch
take their steps together, so a step is one array operation.

Cases: null text, or text without a letter, is und with score 0 and no spans; rows with a null
language or id are labelled but not learned from, and a repeated id counts once; a very long text is labelled alone, with a few arrays of its number of words; with no language learned all texts are und; ties go
to the language that sorts first; repeated rows are labelled alike; an empty table gives an empty
result; columns of the input are carried under their names, except lang_pred, score and spans, which are replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surfacelab.llm.quality_classifier import held_out
from surfacelab.llm.shared import column, labelled_sample, others, plain, renamed, slices, table

SAMPLE_DOCS, SAMPLE_BYTES, TOTAL_BYTES = 4000, 200_000, 48_000_000
GRAMS, BUCKET_BITS, SWITCH, WORD_LIMIT = (2, 3, 4), 18, 12.0, 6.0
CHUNK_SCORES, KNOWN_WORDS = 8_000_000, 300_000

# First code point of each range of letters and the script that it starts.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
NAMES = tuple(sorted({s for _, s in SCRIPTS}))
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(s) for _, s in SCRIPTS])
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram and whole word, and each word's script."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    nums, buckets = [np.arange(len(words))], [np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)]
    for n in GRAMS:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x100000001B3) + np.uint64(0x51ED270B)
        inside = word[: len(h)] == word[n - 1 :]
        nums.append(word[: len(h)][inside])
        buckets.append((h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS))
    script = _SCRIPT[np.searchsorted(_STARTS, points[starts + 1].astype(np.int64), side="right") - 1]
    return np.concatenate(nums), np.concatenate(buckets).astype(np.int64), script


@dataclass(frozen=True)
class Model:
    """langs, weights [bucket, lang] and the scripts [script, lang] that a language uses."""

    langs: tuple[str, ...]
    weights: np.ndarray
    scripts: np.ndarray


def fit(texts: list[tuple[str, str]]) -> Model:
    """A model of (language, text) pairs: smoothed log frequencies less their mean over languages."""
    langs = tuple(sorted({lang for lang, _ in texts}))
    counts = np.zeros((1 << BUCKET_BITS, len(langs)))
    scripts = np.zeros((len(NAMES), len(langs)))
    for k, lang in enumerate(langs):
        tally: dict[str, int] = {}
        for own, text in texts:
            if own == lang:
                for w in words_of(text):
                    tally[w] = tally.get(w, 0) + 1
        if tally:
            times = np.array(list(tally.values()), float)
            num, bucket, script = features(list(tally))
            counts[:, k] = np.bincount(bucket, times[num], 1 << BUCKET_BITS)
            scripts[:, k] = np.bincount(script, times, len(NAMES))
    logs = np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * len(counts))
    uses = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
    # A script that no language uses narrows nothing.
    uses[~uses.any(axis=1)] = True
    return Model(langs, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32) if langs else logs, uses)


class Labeller:
    """A model with the words met so far in a task."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)

    def _learn(self, words: list[str]) -> None:
        num, bucket, script = features(words)
        size = np.bincount(num, minlength=len(words))
        out = np.stack([np.bincount(num, self.model.weights[bucket, k], len(words)) for k in range(len(self.model.langs))], axis=1)
        # The mean over a word's features, times a few: overlapping n-grams aren't independent.
        out = np.clip(out / size[:, None] * np.minimum(size, 12)[:, None], -WORD_LIMIT, WORD_LIMIT)
        out = np.where(self.model.scripts[script], out, -10 * WORD_LIMIT)
        odd = np.array([not any(c.isalpha() for c in w) for w in words])
        out[odd] = np.nan
        self.codes.update(zip(words, range(len(self.codes), len(self.codes) + len(words))))
        self.scores = np.concatenate([self.scores, out.astype(np.float32)])

    def label(self, texts: list[str | None]) -> list[np.ndarray]:
        """The language number of each word of each text."""
        if len(self.codes) > KNOWN_WORDS:
            self.forget()
        split = [words_of(t) for t in texts]
        new = set().union(*split).difference(self.codes)
        if new:
            self._learn(sorted(new))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        doc = np.repeat(np.arange(len(texts)), list(map(len, split)))
        scores = self.scores[codes] if len(codes) else np.zeros((0, len(self.model.langs)), np.float32)
        real = ~np.isnan(scores[:, 0]) if len(codes) else np.zeros(0, bool)
        doc, scores = doc[real], scores[real]
        return self._paths(scores, np.bincount(doc, minlength=len(texts)))

    def _paths(self, scores: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Best paths of texts that lie one after the other: longest first, all take a step at once."""
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        begin, size = starts[order], sizes[order]
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(steps), side="left")
        stay = np.zeros(scores.shape, bool)
        came = np.zeros(len(scores), np.int16)
        label = np.zeros(len(scores), np.int16)
        total = np.zeros((len(size), scores.shape[1]), np.float64)
        for t in range(steps):
            n = active[t]
            at, d = begin[:n] + t, total[:n]
            if t:
                best = d.argmax(axis=1)
                switch = d[np.arange(n), best] - SWITCH
                kept = d >= switch[:, None]
                stay[at], came[at] = kept, best
                d = np.where(kept, d, switch[:, None])
            total[:n] = d + scores[at]
        now = total.argmax(axis=1).astype(np.int16)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            at = begin[:n] + t
            label[at] = now[:n]
            if t:
                now[:n] = np.where(stay[at, now[:n]], now[:n], came[at])
        return [label[a : a + n] for a, n in zip(starts, sizes)]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> Model:
    """A model from rows (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", F.col("lang").alias("label"))
    n = max(1, rows.agg(F.count_distinct("label")).first()[0])
    return fit(labelled_sample(rows, None, -(-sample_docs // n), sample_bytes, total_bytes // n))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and spans (word counts and languages in order)."""
    carried = others(docs, ("lang_pred", "score", "spans"))
    rows, names = plain(docs, carried, text=column(text).cast("string"))
    span = pa.list_(pa.struct([("words", pa.int32()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(shared.value)
        langs = shared.value.langs
        for b in slices(batches, 1024):
            texts = b.column(b.num_columns - 1).to_pylist()
            pred, score, spans = [], [], []
            for start, stop in _chunks(texts, CHUNK_SCORES // max(1, len(langs)) * 4):
                for path in labeller.label(texts[start:stop]) if langs else [()] * (stop - start):
                    if len(path) == 0:
                        pred.append("und"), score.append(0.0), spans.append([])
                        continue
                    n = np.bincount(path, minlength=len(langs))
                    best = int(n.argmax())
                    cut = np.concatenate([[0], np.nonzero(np.diff(path))[0] + 1, [len(path)]])
                    pred.append(langs[best]), score.append(float(n[best] / len(path)))
                    spans.append([{"words": int(z - a), "lang": langs[path[a]]} for a, z in zip(cut, cut[1:])])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)], [*names, "lang_pred", "score", "spans"])

    spans = T.ArrayType(T.StructType([T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType())]))
    return renamed(rows.mapInArrow(run, rows.drop("text").schema.add("lang_pred", "string").add("score", T.DoubleType()).add("spans", spans)), carried)


def _chunks(texts: list[str | None], most: int):
    """(start, stop) of runs of texts of at most so many characters, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > most:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if len(texts) > start:
        yield start, len(texts)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(5, 0)))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
