"""Operator 11, importance resampling towards a target distribution, n-grams hashed from prefix CRCs.

Documents and target texts are bags of hashed runs of words. A text is normalised to its words, each
two joined by one separator, and scanned once for the running crc32 at each word's start and end. As
crc32(A + B) = shift(crc32(A), len(B)) xor crc32(B), where shift is a linear map over GF(2), the hash of
any run of words is the difference of two prefixes: crc32(prefix to its end) xor shift(crc32(prefix to
its start), its length). No run's bytes are read again, whatever the order of the n-grams.

A feature's gain is the log ratio of its smoothed shares in target and documents, a document's weight
the floored mean of its features' gains, its score the weight plus Gumbel noise by its id; the highest
scores are a sample without replacement in proportion to the weights. Ranks come from ranges: one
histogram of the scores (integers of bounded range) gives the last score drawn, rows from there on are
range-partitioned, sorted, and numbered by their place in their range.

Cases: a null text has no features and weight 0; null ids hash as an empty id and come last among equal
scores; repeated rows are documents of their own; without documents of enough words nothing is drawn;
an empty target leaves gains by the documents alone; further input columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacelab.llm.shared import slices, table, written

#: Reflected polynomial of crc32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: Words whose n-grams are hashed at once.
RUN = 1 << 16


def _normal_bytes() -> bytes:
    """A-Z in lower case; other ASCII but digits and a-z to the separator."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


NORMAL = _normal_bytes()


class Shifts:
    """The maps that feed zero bytes to many crc32 values at once, as tables by powers of two."""

    def __init__(self):
        bits = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            bits = (bits >> 1) ^ np.where(bits & 1, np.uint32(POLYNOMIAL), np.uint32(0))
        places = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        self.tables = [(places >> 8) ^ bits[places & 255]]

    def _once(self, values: np.ndarray, power: int) -> np.ndarray:
        t = self.tables[power]
        return t[0][values & 255] ^ t[1][(values >> 8) & 255] ^ t[2][(values >> 16) & 255] ^ t[3][values >> 24]

    def shift(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each value (uint32) after as many zero bytes as its length."""
        out, power, left = values.copy(), 0, lengths.copy()
        while left.any():
            if power == len(self.tables):
                self.tables.append(self._once(self.tables[-1], power - 1))
            odd = np.nonzero(left & 1)[0]
            out[odd] = self._once(out[odd], power)
            left, power = left >> 1, power + 1
        return out


class Hasher:
    """crc32 of all runs of 1 to n words of texts."""

    def __init__(self, n: int):
        self.n, self.shifts = n, Shifts()

    def features(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all texts' features, the text of each, and the number of words of each text."""
        starts, ends, sizes, counts = [], [], [], []
        crc = zlib.crc32
        for t in texts:
            words = t.translate(NORMAL).split() if t else []
            r = 0
            for w in words:
                starts.append(r)
                r = crc(w, r)
                ends.append(r)
                r = crc(b" ", r)
            sizes.extend(map(len, words))
            counts.append(len(words))
        start, end = np.array(starts, np.uint32), np.array(ends, np.uint32)
        counts = np.array(counts, np.int64)
        text = np.repeat(np.arange(len(texts)), counts)
        # The places of words are counted through all texts; only differences within a text are used.
        stop = np.cumsum(np.array(sizes, np.int64) + 1)
        begin = stop - np.array(sizes, np.int64) - 1
        hashes, owners = [], []
        for k in range(1, self.n + 1):
            first = np.arange(max(0, len(text) - k + 1))
            first = first[text[first] == text[first + k - 1]]
            last = first + k - 1
            hashes.append(end[last] ^ self.shifts.shift(start[first], stop[last] - 1 - begin[first]))
            owners.append(text[first])
        return np.concatenate(hashes), np.concatenate(owners), counts


def _runs(batches):
    """Rows of batches in runs of about RUN words or one text, so that arrays stay small."""
    for b in slices(batches):
        texts, first, held = b.column("text").to_pylist(), 0, 0
        for i, t in enumerate(texts):
            held += len(t or b"")
            if held > 6 * RUN:
                yield b.slice(first, i + 1 - first), texts[first : i + 1]
                first, held = i + 1, 0
        if first < len(texts):
            yield b.slice(first), texts[first:]


def bucket_counts(texts: DataFrame, n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Features of each bucket over all texts (text): a vector a task, summed by Spark."""

    def run(batches):
        hasher, total = Hasher(n), np.zeros(buckets, np.int64)
        for _, rows in _runs(batches):
            total += np.bincount(hasher.features(rows)[0] % np.uint32(buckets), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    each = texts.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    got = each.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000 * log of the ratio of a bucket's add-one shares in target and documents."""
    k, s, t = len(documents), float(documents.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + k) / ((x + 1.0) * (t + k)))) for x, y in zip(documents.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = 2) -> DataFrame:
    """doc_id, n_words, n_features, weight of docs (doc_id, text)."""
    buckets = np.uint32(len(gain))

    def run(batches):
        hasher = Hasher(n)
        for b, rows in _runs(batches):
            hashes, owners, words = hasher.features(rows)
            own = np.bincount(owners, minlength=len(rows))
            order = np.argsort(owners, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[hashes[order] % buckets])])
            stop = np.cumsum(own)
            weight = (sums[stop] - sums[stop - own]) // np.maximum(own, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(own), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Floored 1000 * Gumbel noise by seed and doc_id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    place = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(place)))


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored (doc_id, n_words, n_features, weight, score, row) with rank: 1, 2, ... of the highest scores, null for others.

    The histogram that comes to the driver has a row a score: scores are integers between -50000 and 75000, as gains
    are thousandths of logarithms of ratios of counts below 2**63.
    """
    able = scored.where(F.col("n_words") >= least_words)
    got = sorted(((r.score, r.n) for r in able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in got) // 100
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.withColumn("rank", none)
    so_far, last = 0, got[0][0]
    for last, n in got:
        so_far += n
        if so_far >= wanted:
            break
    within = (F.col("n_words") >= least_words) & (F.col("score") >= last)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("weight"), F.col("n_features"), F.col("row")]
    placed = written(scored.where(within).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "resampling-ranges")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a range
        offsets.append((r.part, before))
        before += r.n
    offsets = scored.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + place + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= wanted, rank)).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~F.coalesce(within, F.lit(False))).withColumn("rank", none))


def resampled(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of docs (doc_id, text), drawn towards target (text).

    rank is null but for the `percent` of the documents of least_words words that are drawn.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    scored = weighed(docs, gain, n).withColumn("score", (F.col("weight") + noise(seed)).cast("long")).withColumn("row", F.monotonically_increasing_id())
    return drawn(written(scored, "resampling"), percent, least_words).drop("row")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def op11_sql() -> str:
    # Eight steps on a byte's 256 values make the table; bytes of features then look it up.
    stepped = "list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, %d * (c & 1)))" % POLYNOMIAL
    return f"""
WITH crc_table AS (SELECT list({stepped} ORDER BY b) AS t FROM (SELECT unnest(range(256))::BIGINT AS b)),
bags AS (
  SELECT doc_id AS id, 0 AS kind, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT item_id, 1, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), features AS (
  SELECT kind, row, unnest(w) AS f FROM bags
  UNION ALL
  SELECT kind, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM bags WHERE len(w) > 1
), held AS (SELECT kind, row, f, count(*) AS n FROM features GROUP BY ALL),
spelled AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM held)),
digits AS (
  SELECT f, list_transform(range(0, len(h) // 2), lambda i: (16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT) AS bytes FROM spelled
), crcs AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM digits, crc_table
), hashed AS (SELECT kind, row, bucket, sum(n) AS n FROM held JOIN crcs USING (f) GROUP BY ALL),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM hashed GROUP BY bucket
), totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS g FROM sums, totals),
weights AS (
  SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM hashed JOIN gain USING (bucket) WHERE kind = 0 GROUP BY row
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM bags LEFT JOIN weights USING (row) WHERE kind = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, 25 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS most FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= most THEN k END AS rank FROM placed"""
