"""Operator 4, SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Fingerprints
at 2 or fewer differing bits link. Cut into two 32-bit segments, one segment of a linked pair differs by
at most one bit, so each distinct fingerprint is indexed under both segments, each whole and with
each bit cleared in turn; members of a bucket are equality-joined and verified. A wildcard bucket
joins only members that differ in the cleared bit, so a pair meets at most once for each segment.

A bucket above pair_limit (a large group of near copies) is not expanded into pairs. Its members
are indexed by every point within one bit instead: two fingerprints share such a point exactly when
they link or are equal, so a star to the point's smallest member keeps every component whole.

Cases: null text counts as empty, fingerprint zero, linked like any other; a null doc_id keeps its
row and gets its component's smallest id; repeated rows and equal texts share one fingerprint; an
empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacelab.llm.components import components
from surfacelab.llm.shared import table, written
from surfacelab.llm.survivors import keep_first

SEED = 42
#: Hashes whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence where it is shorter."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    starts = [0]
    for w in parts:
        starts.append(starts[-1] + len(w) + 1)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(line, SEED)], np.uint64)
    return np.fromiter((h(line[s : e - 1], SEED) for s, e in zip(starts, starts[words:])), np.uint64, len(parts) - words + 1)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit majority of the shingle hashes, as a signed long."""
    return majority(shingle_hashes(text, words))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[k : k + BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _differ(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def index(fps: DataFrame) -> DataFrame:
    """bucket, fp: segment slot // 33 whole (slot % 33 = 32) or with bit slot % 33 cleared; slot is the high word."""
    entries = []
    for slot in range(66):
        high, bit = divmod(slot, 33)
        value = F.shiftrightunsigned("fp", 32) if high else F.col("fp")
        mask = 0xFFFFFFFF & ~((1 << bit) if bit < 32 else 0)
        entries.append(value.bitwiseAND(F.lit(mask).cast("long")).bitwiseOR(F.lit(slot << 32)))
    return fps.select("fp", F.explode(F.array(*entries)).alias("bucket"))


def _may_meet() -> Column:
    """Members of a wildcard bucket meet only across its bit; those of a whole-segment bucket all do."""
    slot = F.shiftrightunsigned("bucket", 32).cast("int")
    bit = F.pmod(slot, F.lit(33))
    at = F.when(slot >= 33, bit + 32).otherwise(bit)
    across = F.call_function("shiftrightunsigned", F.col("a").bitwiseXOR(F.col("b")), at).bitwiseAND(F.lit(1).cast("long")) == 1
    return (bit == 32) | across


def links(fps: DataFrame, bits: int = 2, pair_limit: int = 64) -> DataFrame:
    """a, b links among distinct fingerprints whose components are those of "2 or fewer bits differ"."""
    if bits != 2:
        raise ValueError("two segments with one wildcard are exact for two bits")
    dealt = index(fps).repartition("bucket")
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(dealt.join(sizes, "bucket"), "simhash-buckets")
    small = shared.where(F.col("n") <= pair_limit)
    pairs = (
        small.select("bucket", F.col("fp").alias("a"))
        .join(small.select("bucket", F.col("fp").alias("b")), "bucket")
        .where((F.col("a") < F.col("b")) & _may_meet() & (_differ(F.col("a"), F.col("b")) <= bits))
        .select("a", "b")
    )
    hot = shared.where(F.col("n") > pair_limit).select("fp").distinct()
    near = F.concat(F.array("fp"), F.array(*[F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(64)]))
    points = hot.select("fp", F.explode(near).alias("point")).repartition("point")
    stars = points.join(points.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def simhash_groups(docs: DataFrame, words: int = 3, bits: int = 2, pair_limit: int = 64) -> DataFrame:
    """doc_id, fp, root (the component's smallest fingerprint) and component_id (smallest doc_id reachable by links) of docs (doc_id, text)."""
    each = written(fingerprints(docs, words), "simhash")
    classes = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), bits, pair_limit))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(named.join(best, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, words: int = 3, **parameters) -> DataFrame:
    """The row of smallest doc_id (null ids last) of each component, of equal rows one, with all columns of docs."""
    grouped = simhash_groups(docs, words, **parameters).select("doc_id", F.col("fp").alias("node"), F.col("root"))
    return keep_first(docs, grouped, lambda text: fingerprint(text, words))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = simhash_groups(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
