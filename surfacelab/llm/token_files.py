"""Operator 1, token ids in files: an adaptive context-mixing range coder over independent blocks.

Documents are range-partitioned and sorted by doc_id, encoded with a tokenizers file and cut into
blocks of whole documents (a longer document spans blocks of its own). Each block is coded with
fresh statistics and carries its document table, place and checksum, so it can be read alone.

Two ids are candidates for the next one: what last followed the same two ids, and what last followed the same id. How likely a
candidate is right is said by order 2 (how often its own context held), by order 1 (the same, and whether
both agree) and by order 0 (how often the candidate occurred in the block), each as an adaptive probability. The three are mixed in the
logistic domain with weights that every block learns from the coding error. An id that is no candidate follows by
order 0 alone: three adaptive digits of its number, each in the context of those before, and four flat bits. All blocks of a
batch take each step together, in numpy arrays whose state stays small; encoder and
decoder run the same model. The range has 48 bits and is refilled 16 bits at a time.

The files are Parquet rows of (part, block), block being the binary format written by pack().

Cases: null text counts as empty, an empty document is its end id alone; a very long text is encoded alone and
spans many blocks; null doc_ids come first;
rows of equal doc_id are ordered by text; an empty table gives no block; further input columns are
ignored; an id of 65535 or more raises an error, as does a vocabulary file of another pre-tokenizer; a damaged block raises an error when it is read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfacelab.llm.shared import WHITE, new_path, table, written

MAGIC, HEAD, DOC = b"TCM2", struct.Struct("<4sIIIQQII"), struct.Struct("<qIB")
BLOCK_IDS, LANES, KNOWN_WORDS, CHUNK_CHARS = 4096, 1024, 100_000, 500_000
#: Rows turned into Python objects and new words given to the library at once.
ROWS, NEW_WORDS = 256, 20_000
FIRST, LAST, NULL_ID = 1, 2, 4
END_ID = 2
#: The byte-level pre-tokenizer's pattern (fixed value), white space written out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"

#: Slots of a block's tables of orders 0, 1 and 2; an id that is none; the most that a count or a trust can be.
SLOTS_0, SLOTS_1, SLOTS_2, NO_ID, MOST = 1 << 11, 1 << 10, 1 << 11, 0xFFFF, 7
HIT_2, HIT_1, MISS = 0, 1, 2
#: A candidate's probability is of 2**12; the inputs' are of 2**16 and adapt by a shift; STEP is the weights' rate.
HIT_BITS, INPUT_RATE, STEP = 12, 5, np.float32(6e-9)
_HALF = 1 << HIT_BITS - 1
STRETCH = np.clip(np.rint(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))), -2047, 2047).astype(np.float32)
SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-(np.arange(4096) - 2048) / 256))), 16, 4080).astype(np.int32)
#: Digits' probabilities are of 2**14; LEAST is any digit's share.
TOTAL_BITS, RATE, LEAST = 14, 4, 8
TOTAL = 1 << TOTAL_BITS
#: Rows of a block's digits: the first, the second for each first, the third for each of both.
ROWS_0 = 1 + 16 + 256

_STEPS = np.arange(16)
_FLAT = (_STEPS * (TOTAL // 16)).astype(np.int16)
#: _TARGET[s]: the distribution that leaves LEAST to each digit but s.
_TARGET = np.stack([np.where(_STEPS <= s, _STEPS * LEAST, TOTAL - (16 - _STEPS) * LEAST) for s in range(16)]).astype(np.int16)


class Mixer:
    """The model of many blocks at once; n falls as shorter blocks end (blocks are sorted by length)."""

    def __init__(self, lanes: int):
        lane, two = np.arange(lanes), np.arange(2)[:, None]
        self.bases = [lane * k for k in (SLOTS_0, SLOTS_1, SLOTS_2)]
        self.seen = [np.full(lanes * k, NO_ID << 3, np.uint32) for k in (SLOTS_1, SLOTS_2)]
        self.often = np.zeros(lanes * SLOTS_0, np.uint8)
        # For both candidates: what the states of order 2, 1 and 0 have told, and the weights of the three.
        self.states = [(two * lanes + lane) * k for k in (MOST + 1, 2 * MOST + 2, MOST + 1)]
        self.told = [np.full(2 * lanes * k, 1 << 14, np.int32) for k in (MOST + 1, 2 * MOST + 2, MOST + 1)]
        self.weights = np.full((3, 2, lanes), 0.4, np.float32)
        self.digits = np.tile(_FLAT, (lanes * ROWS_0, 1))
        self.before = np.zeros((2, lanes), np.int64)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares of 2**12 of either candidate for the next id of the first n lanes."""
        last, past = self.before[:, :n]
        mixed = last * 0x9E3B
        self.slots = self.bases[1][:n] + (mixed >> 3 & SLOTS_1 - 1), self.bases[2][:n] + (mixed + past * 0x1F35D >> 5 & SLOTS_2 - 1)
        one, two = (seen.take(at) for seen, at in zip(self.seen, self.slots))
        self.entries = one, two
        self.candidates = np.stack([two >> 3, one >> 3])
        agree = self.candidates[0] == self.candidates[1]
        counts = self.often.take(self.bases[0][:n] + (self.candidates * np.uint32(0x9E3B) >> np.uint32(4) & np.uint32(SLOTS_0 - 1)))
        states = (two & 7, (one & 7) * 2 + agree, counts)
        self.at = [base[:, :n] + s for base, s in zip(self.states, states)]
        self.now = [told.take(at) for told, at in zip(self.told, self.at)]
        self.inputs = [STRETCH.take(p >> 4) for p in self.now]
        w = self.weights[:, :, :n]
        dot = w[0] * self.inputs[0]
        dot += w[1] * self.inputs[1]
        dot += w[2] * self.inputs[2]
        # Beyond the table's ends its ends hold.
        self.shares = SQUASH.take(dot.astype(np.int32) + 2048, mode="clip")
        first = self.shares[0]
        return first, np.maximum((4096 - first) * self.shares[1] >> 12, 1)

    def learn(self, choice: np.ndarray, ids: np.ndarray) -> None:
        n = len(ids)
        right = np.stack([choice == HIT_2, choice == HIT_1])
        asked = choice != HIT_2
        error = ((right << 12) - self.shares).astype(np.float32) * STEP
        error[1] *= asked
        w = self.weights[:, :, :n]
        full = right * np.int32(65535)
        for k in range(3):
            pull = self.inputs[k]
            pull *= error
            w[k] += pull
            move = full - self.now[k]
            move >>= INPUT_RATE
            move[1] *= asked
            move += self.now[k]
            self.told[k][self.at[k]] = move
        for seen, slot, entry in zip(self.seen, self.slots, self.entries):
            trust, held = entry & 7, entry >> 3 == ids
            fresh = ~held & (trust < 2)
            seen[slot] = np.where(fresh, ids << 3 | 1, entry - trust + np.where(held, np.minimum(trust + 1, MOST), trust >> 1))
        place = self.bases[0][:n] + (ids * np.uint32(0x9E3B) >> np.uint32(4) & np.uint32(SLOTS_0 - 1))
        self.often[place] = np.minimum(self.often.take(place) + 1, MOST)
        self.before[1, :n] = self.before[0, :n]
        self.before[0, :n] = ids

    def digit(self, row: np.ndarray, digit: np.ndarray | None, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digit, below, share) of a digit, given or found by at; its row learns it."""
        model = self.digits.take(row, axis=0)
        if digit is None:
            digit = np.bitwise_count((model <= at[:, None]).view(np.uint64)).sum(axis=1, dtype=np.int64) - 1
        flat = np.arange(0, 16 * len(row), 16) + digit
        low = model.ravel().take(flat).astype(np.int64)
        above = np.where(digit == 15, TOTAL, model.ravel().take(np.minimum(flat + 1, model.size - 1)))
        move = _TARGET.take(digit, axis=0)
        move -= model
        move >>= RATE
        move += model
        self.digits[row] = move
        return digit, low, above - low


def _active(sizes: np.ndarray) -> np.ndarray:
    """How many of the blocks, longest first, have an id at each step."""
    return np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")


def compress(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded words of each block of ids (all below 65535)."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    if not len(sizes) or not sizes[0]:
        return [b""] * len(blocks)
    lanes, steps = len(order), int(sizes[0])
    ids = np.zeros((steps, lanes), np.uint16)
    for k, i in enumerate(order):
        if len(blocks[i]) and not 0 <= int(blocks[i].min()) <= int(blocks[i].max()) < NO_ID:
            raise ValueError(f"ids must be from 0 to {NO_ID - 1}")
        ids[: sizes[k], k] = blocks[i]
    mixer = Mixer(lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
    words, used = np.zeros((lanes, steps * 3 // 4 + 128), np.uint32), np.zeros(lanes, np.int64)
    few, low32, refill = np.uint64(1 << 32), np.uint64(0xFFFFFFFF), np.uint64(16)

    def shift(lane: np.ndarray) -> None:
        words[lane, used[lane]] = low[lane] >> np.uint64(32)
        used[lane] += 1
        low[lane] = (low[lane] & low32) << refill

    def narrow(lane: np.ndarray) -> None:
        while len(lane := lane[width[lane] < few]):
            shift(lane)
            width[lane] <<= refill

    for t, n in enumerate(_active(sizes)):
        if t % 8 == 0 and used[:n].max() + 64 > words.shape[1]:
            words = np.concatenate([words, np.zeros((lanes, steps // 4 + 64), np.uint32)], axis=1)
        first, second = mixer.predict(n)
        now = ids[t, :n].astype(np.uint32)
        choice = np.where(mixer.candidates[0] == now, HIT_2, np.where(mixer.candidates[1] == now, HIT_1, MISS))
        unit = width[:n] >> np.uint64(HIT_BITS)
        to_first, to_second = unit * first.astype(np.uint64), unit * second.astype(np.uint64)
        both = to_first + to_second
        low[:n] += np.where(choice == HIT_2, np.uint64(0), np.where(choice == HIT_1, to_first, both))
        width[:n] = np.where(choice == HIT_2, to_first, np.where(choice == HIT_1, to_second, width[:n] - both))
        narrow(np.nonzero(width[:n] < few)[0])
        new = np.nonzero(choice == MISS)[0]
        x, m = now[new].astype(np.int64), len(new)
        row = new * ROWS_0
        # The encoder knows all three digits, so their rows are looked up together.
        _, below, share = mixer.digit(np.concatenate([row, row + 1 + (x >> 12), row + 17 + (x >> 8)]), np.concatenate([x >> 12, x >> 8 & 15, x >> 4 & 15]))
        below, share = below.astype(np.uint64), share.astype(np.uint64)
        for k in range(3):
            unit = width[new] >> np.uint64(TOTAL_BITS)
            low[new] += unit * below[k * m : k * m + m]
            width[new] = unit * share[k * m : k * m + m]
            if k == 1:
                narrow(new)
        rest = width[new] >> np.uint64(4)
        low[new] += rest * (x & 15).astype(np.uint64)
        width[new] = rest
        narrow(new)
        mixer.learn(choice, now)
    for _ in range(3):
        shift(np.arange(lanes))
    # Words hold a carry above 16 bits; it belongs to the word before.
    out = [b""] * len(blocks)
    for k, i in enumerate(order):
        w = words[k, : used[k]].astype(np.int64)
        while (w >> 16).any():
            w = (w & 0xFFFF) + np.append(w[1:] >> 16, 0)
        out[i] = w.astype("<u2").tobytes()
    return out


def expand(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each coded block."""
    order = sorted(range(len(coded)), key=lambda i: -sizes[i])
    count = np.array([sizes[i] for i in order])
    if not len(count) or not count[0]:
        return [np.zeros(0, np.uint16) for _ in coded]
    lanes, steps = len(order), int(count[0])
    words = np.zeros((lanes, max(len(c) for c in coded) // 2 + 4), np.uint16)
    for k, i in enumerate(order):
        w = np.frombuffer(coded[i], "<u2")
        words[k, : len(w)] = w
    ids, mixer, used = np.zeros((lanes, steps), np.uint16), Mixer(lanes), np.full(lanes, 3, np.int64)
    value = words[:, 0].astype(np.uint64) << np.uint64(32) | words[:, 1].astype(np.uint64) << np.uint64(16) | words[:, 2]
    width, few, refill = np.full(lanes, 1 << 48, np.uint64), np.uint64(1 << 32), np.uint64(16)

    def narrow(lane: np.ndarray) -> None:
        while len(lane := lane[width[lane] < few]):
            value[lane] = value[lane] << refill | words[lane, used[lane]]
            used[lane] += 1
            width[lane] <<= refill

    for t, n in enumerate(_active(count)):
        first, second = mixer.predict(n)
        unit = width[:n] >> np.uint64(HIT_BITS)
        to_first, to_second = unit * first.astype(np.uint64), unit * second.astype(np.uint64)
        both, here = to_first + to_second, value[:n]
        choice = (here >= to_first).astype(np.int64) + (here >= both)
        value[:n] -= np.where(choice == HIT_2, np.uint64(0), np.where(choice == HIT_1, to_first, both))
        width[:n] = np.where(choice == HIT_2, to_first, np.where(choice == HIT_1, to_second, width[:n] - both))
        narrow(np.nonzero(width[:n] < few)[0])
        now = np.where(choice == HIT_2, mixer.candidates[0], mixer.candidates[1])
        new = np.nonzero(choice == MISS)[0]
        row, x = new * ROWS_0, np.zeros(len(new), np.int64)
        for k in range(3):
            unit = width[new] >> np.uint64(TOTAL_BITS)
            digit, below, share = mixer.digit(row + (0, 1, 17)[k] + x, None, np.minimum(value[new] // unit, np.uint64(TOTAL - 1)).astype(np.int16))
            value[new] -= unit * below.astype(np.uint64)
            width[new] = unit * share.astype(np.uint64)
            x = x << 4 | digit
            if k == 1:
                narrow(new)
        rest = width[new] >> np.uint64(4)
        got = np.minimum(value[new] // rest, np.uint64(15))
        value[new] -= got * rest
        width[new] = rest
        narrow(new)
        now[new] = x << 4 | got.astype(np.int64)
        mixer.learn(choice, now)
        ids[:n, t] = now
    out: list = [None] * len(coded)
    for k, i in enumerate(order):
        out[i] = ids[k, : count[k]]
    return out


def pack(docs: list[tuple[int | None, int, int]], place: int, ordinal: int, size: int, words: bytes) -> bytes:
    """A block: head (magic, ids, documents, words, first id's place, first document's number, checksums), documents, words.

    docs: (doc_id, ids in this block, flags FIRST and LAST) of each document.
    """
    rows = b"".join(DOC.pack(i or 0, n, f | (NULL_ID if i is None else 0)) for i, n, f in docs)
    bare = HEAD.pack(MAGIC, size, len(docs), len(words), place, ordinal, 0, 0)
    return HEAD.pack(MAGIC, size, len(docs), len(words), place, ordinal, zlib.crc32(bare + rows), zlib.crc32(words)) + rows + words


def unpack(block: bytes) -> tuple[int, int, int, list[tuple[int | None, int, int]], bytes]:
    """(ids, place, ordinal, docs, words) of a block; ValueError when it is damaged."""
    if len(block) < HEAD.size:
        raise ValueError("damaged token block: short head")
    magic, size, count, length, place, ordinal, crc_docs, crc_words = HEAD.unpack_from(block)
    end = HEAD.size + count * DOC.size
    rows, words = block[HEAD.size : end], block[end:]
    bare = HEAD.pack(magic, size, count, length, place, ordinal, 0, 0)
    if magic != MAGIC or len(words) != length or zlib.crc32(bare + rows) != crc_docs or zlib.crc32(words) != crc_words:
        raise ValueError("damaged token block: checksum")
    docs = [(None if f & NULL_ID else i, n, f & (FIRST | LAST)) for i, n, f in DOC.iter_unpack(rows)]
    return size, place, ordinal, docs, words


class Encoder:
    """A tokenizers file; words met before are looked up, new ones of a batch go to the library together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError("the vocabulary must be byte-level, with that pre-tokenizer's own pattern and no normalizer")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.pool, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text without the end id."""
        if len(self.codes) > KNOWN_WORDS:
            self.forget()
        whole = [any(s in t for s in self.special) for t in texts]
        split = [[] if w else self.split.findall(t) for t, w in zip(texts, whole)]
        new = sorted(set().union(*split).difference(self.codes)) if split else []
        for k in range(0, len(new), NEW_WORDS):
            part = new[k : k + NEW_WORDS]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            counts = np.fromiter(map(len, got), np.int64, len(got))
            self.codes.update(zip(part, range(len(self.codes), len(self.codes) + len(part))))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(got), np.int32, int(counts.sum()))])
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        per_word = self.counts[codes]
        stops = np.cumsum(per_word)
        take = np.repeat(self.starts[codes] - (stops - per_word), per_word) + np.arange(stops[-1] if len(stops) else 0)
        ends = np.concatenate([[0], stops])[np.cumsum([len(ws) for ws in split])] if split else []
        parts = np.split(self.pool[take], ends[:-1]) if split else []
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) if w else p for t, w, p in zip(texts, whole, parts)]


def _small(held: list[np.ndarray]) -> np.ndarray:
    """A block's ids in 16 bits."""
    ids = np.concatenate(held)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < NO_ID:
        raise ValueError(f"ids must be from 0 to {NO_ID - 1}")
    return ids.astype(np.uint16)


def _blocks(docs: Iterable[tuple[int | None, np.ndarray]]) -> Iterator[tuple]:
    """(docs, place, ordinal, ids) of the blocks of a partition's documents, in order."""
    held, rows, size, place, ordinal = [], [], 0, 0, 0
    number = 0
    for doc_id, ids in docs:
        if size and size + len(ids) > BLOCK_IDS:
            yield rows, place, ordinal, _small(held)
            place, held, rows, size = place + size, [], [], 0
        if not size:
            ordinal = number
        number += 1
        if len(ids) <= BLOCK_IDS:
            held.append(ids)
            rows.append((doc_id, len(ids), FIRST | LAST))
            size += len(ids)
            continue
        for at in range(0, len(ids), BLOCK_IDS):
            part = ids[at : at + BLOCK_IDS]
            flags = (FIRST if at == 0 else 0) | (LAST if at + BLOCK_IDS >= len(ids) else 0)
            yield [(doc_id, len(part), flags)], place, number - 1, _small([part])
            place += len(part)
    if size:
        yield rows, place, ordinal, _small(held)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Token files of docs (doc_id, text) in path, in ascending doc_id order."""

    def run(batches):
        encoder = Encoder(vocabulary)
        part = TaskContext.get().partitionId()

        def documents():
            for b in batches:
                for first in range(0, b.num_rows, ROWS):
                    rows = b.slice(first, ROWS)
                    numbers, texts = rows.column("doc_id").to_pylist(), [t or "" for t in rows.column("text").to_pylist()]
                    at = 0
                    while at < len(texts):
                        stop, size = at, 0
                        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK_CHARS):
                            size += len(texts[stop])
                            stop += 1
                        for i, ids in zip(numbers[at:stop], encoder.encode(texts[at:stop])):
                            yield i, np.append(ids, np.int32(end_id))
                        at = stop

        def out(held):
            packed = [pack(rows, place, ordinal, len(ids), w) for (rows, place, ordinal, ids), w in zip(held, compress([h[3] for h in held]))]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(packed, pa.binary())], ["part", "place", "block"])

        held = []
        for block in _blocks(documents()):
            held.append(block)
            if len(held) == LANES:
                yield out(held)
                held = []
        if held:
            yield out(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part long, place long, block binary").write.option("compression", "uncompressed").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """part, ordinal, doc_id, place, n, crc and whole of each piece of a document in a block."""
    kinds = {"part": pa.int64(), "ordinal": pa.int64(), "doc_id": pa.int64(), "place": pa.int64(), "n": pa.int64(), "crc": pa.int64(), "whole": pa.bool_()}

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, LANES):
                own = b.slice(at, LANES)
                heads = [unpack(x) for x in own.column("block").to_pylist()]
                rows: dict[str, list] = {k: [] for k in kinds}
                for part, (_, place, ordinal, docs, _), ids in zip(own.column("part").to_pylist(), heads, expand([h[4] for h in heads], [h[0] for h in heads])):
                    raw, start = memoryview(ids.astype("<u4").tobytes()), 0
                    for k, (doc_id, n, flags) in enumerate(docs):
                        values = (part, ordinal + k, doc_id, place + start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), flags & 3 == 3)
                        for c, v in zip(rows.values(), values):
                            c.append(v)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], k) for c, k in kinds.items()], list(kinds))

    files = spark.read.schema("part long, place long, block binary").parquet(path)
    return files.select("part", "block").mapInArrow(run, "part long, ordinal long, doc_id long, place long, n long, crc long, whole boolean")


def _zeros(bits: int) -> list[int]:
    """Columns of the map that feeds 2**bits zero bytes to a crc32 register."""
    step = [0xEDB88320, *(1 << k for k in range(31))]
    square = step
    for _ in range(bits + 3):
        square = [_apply(square, c) for c in square]
    return square


def _apply(columns: list[int], value: int) -> int:
    out = 0
    while value:
        low = value & -value
        out ^= columns[low.bit_length() - 1]
        value ^= low
    return out


class CrcJoin:
    """crc32 of a concatenation from the crc32 of its parts."""

    def __init__(self):
        self.powers: dict[int, list[int]] = {}

    def join(self, first: int, second: int, length: int) -> int:
        bit = 0
        while length:
            if length & 1:
                if bit not in self.powers:
                    self.powers[bit] = _zeros(bit)
                first = _apply(self.powers[bit], first)
            length, bit = length >> 1, bit + 1
        return first ^ second


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents of token files."""
    pieces = written(read_segments(spark, path), "token-pieces")

    def joined(batches):
        crcs = CrcJoin()
        for b in batches:
            crc = []
            for own in b.column("pieces").to_pylist():
                own.sort(key=lambda x: x["place"])
                total = own[0]["crc"]
                for x in own[1:]:
                    total = crcs.join(total, x["crc"], 4 * x["n"])
                crc.append(total)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], [*b.schema.names[:-1], "crc"])

    long_docs = (
        pieces.where("NOT whole").groupBy("part", "ordinal")
        .agg(F.first("doc_id").alias("doc_id"), F.min("place").alias("place"), F.sum("n").alias("n"), F.collect_list(F.struct("place", "n", "crc")).alias("pieces"))
        .select("part", "doc_id", "place", "n", "pieces")
    )
    docs = pieces.where("whole").select("part", "doc_id", "place", "n", "crc").unionByName(long_docs.mapInArrow(joined, "part long, doc_id long, place long, n long, crc long"))
    # One row for each file part, so this window is over a few rows.
    sizes = pieces.groupBy("part").agg(F.sum("n").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("offset"))
    return docs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("place")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
