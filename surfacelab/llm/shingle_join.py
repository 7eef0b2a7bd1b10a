"""Near copies by exact Jaccard similarity of word-shingle sets, for the pipeline's stage.

First the operator's own method: fingerprints of the 5-word shingles are linked by deletion variants at 2 or
fewer bits (simhash.links) and each link is verified on the shingle sets. Near 0.8, fingerprints can't do the rest:
such pairs differ in some 15 of 100 bits, which leaves segments too short to select anything. So an exact join follows.

A set is cut by the first bits of its hashes into parts of some PART elements, as many as the larger set of a pair has. If two sets have
similarity t or more, so have their parts in some place: were all parts less similar, so would be their union. Two parts of similarity t or more
share at least t of the larger one, so under any one order of all
shingles they share a shingle among the first n - ceil(t n) + 1 of each (the prefix), and of prefixes of such lengths a
number that grows with the sizes. Each distinct set is indexed under its parts' prefixes, members of a bucket are
equality-joined where the sizes and the parities of 256 slots leave room for a similar pair of parts (bounds that the join itself applies, so
none is lost and no other row is made; a whole set of many elements would fill all slots), pairs that share too few are left out, then those of which the parities of two slots an element show
that the whole sets differ too much, and the others are verified on their whole sets: no pair is missed and none is linked by chance.

The order puts shingles that are frequent in a sample last (a fixed share of the table, 5000 texts at least), so that
shared passages (licenses, repeated lines) hardly get into prefixes. Any sample gives the same result.

Large groups aren't expanded into pairs: links and then stars (each set with the one set, a bucket's most typical member, that it
shares most with) are verified first, and only members of buckets that still hold several components meet, across components.

Cases: null text counts as empty, all empty texts are copies of each other; texts of fewer words than a
shingle are one shingle; a very long text's shingle hashes are held by one task; repeated rows, rows that share an id and equal sets are judged by their
texts, so a text is never lost with another's id; of a group the row of smallest id stays (null ids last), of equal rows one; an empty
table gives an empty result; other columns are carried under their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfacelab.llm import simhash
from surfacelab.llm.components import components
from surfacelab.llm.shared import new_path, remove, slices, written, written_to
from surfacelab.llm.simhash import SEED, majority, shingle_hashes
from surfacelab.llm.survivors import bitmap, has, keep_first, slot

WORDS, PERCENT = 5, 80
#: The sample for the order: so many rows or so large a share, their first bytes, and the shingles kept.
SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_BYTES, SAMPLE_SHINGLES = 5000, 0.1, 20_000, 1_000_000
#: Elements of a set's part, about at most.
PART = 256
#: Rounds of one candidate a set before all that is left meets.
STARS = 1
#: Longs of the parities that go with a part into its buckets.
MARK = 4
#: Low bits of a bucket, which hold the level (the logarithm of the number of parts) in place of the hash's own.
LEVEL_BITS = 5


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text, words))


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * 100 >= percent * (len(x) + len(y) - both)


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that several texts of a bounded sample have, with their numbers of texts."""
    rows = docs.select(F.col("text").cast("string").substr(1, SAMPLE_BYTES).alias("text")).where("text IS NOT NULL")
    n = rows.count()
    some = rows.sample(min(1.0, max(SAMPLE_SHARE, SAMPLE_ROWS / max(n, 1))), 1).dropDuplicates(["text"])

    def run(batches):
        for b in slices(batches):
            h = [shingle_set(t.as_py(), words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*h, np.zeros(0, np.uint64)]).view(np.int64))], ["h"])

    often = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(SAMPLE_SHINGLES).toArrow()
    h, n = often.column("h").to_numpy().view(np.uint64), often.column("n").to_numpy()
    at = np.argsort(h)
    return h[at], n[at]


def prefix(hashes: np.ndarray, often: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The shingles that a similar set must share one of: the first ones by (frequency, hash)."""
    n = len(hashes)
    if not n:
        return hashes
    rank = np.zeros(n, np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], hashes), len(often[0]) - 1)
        rank = np.where(often[0][at] == hashes, often[1][at], 0)
    return hashes[np.argsort(rank, kind="stable")[: n + (-n * percent // 100) + 1]]


def parities(hashes: np.ndarray) -> bytes:
    """For each of about two slots an element, whether an odd number of the set's hashes falls in it; the slots are a power of two, 256 at least."""
    slots = max(256, 1 << (2 * len(hashes)).bit_length())
    counts = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def mark(odd: bytes) -> np.ndarray:
    """Parities of 64 * MARK slots: halves of more slots add up."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.int64).reshape(-1, MARK), axis=0)


def may_be_similar(x: bytes, y: bytes, nx: int, ny: int, percent: int = PERCENT) -> bool:
    """False where parities show that two sets differ too much: every slot of different parity holds an element of one set alone."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        # Half as many slots: the parities of the two halves add up.
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    differ = int(np.bitwise_count(a ^ b).sum())
    both = (nx + ny - differ) // 2
    return both * 100 >= percent * (nx + ny - both)


def level_of(n: int) -> int:
    """Smallest level whose parts of a set of n elements hold PART on average at most."""
    return max(0, (max(n, 1) - 1) // PART).bit_length()


def parts(hashes: np.ndarray, often: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> list[tuple]:
    """(level, place, own, size, mark, buckets) of the parts of a sorted set, at its own level and at those of larger sets that it can be similar to."""
    n, out = len(hashes), []
    own = level_of(n)
    for level in range(own, level_of(n * 100 // percent) + 1):
        ends = np.searchsorted(hashes, np.arange(1, 1 << level, dtype=np.uint64) << np.uint64(64 - level)) if level else []
        for place, part in enumerate(np.split(hashes, ends)):
            if len(part):
                buckets = prefix(part, often, percent) & ~np.uint64((1 << LEVEL_BITS) - 1) | np.uint64(level)
                out.append((level, place, level == own, len(part), mark(parities(part)), np.unique(buckets)))
    return out


def _part_of_bucket() -> list[Column]:
    """level and place of the parts that meet in a bucket."""
    level = F.col("bucket").bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int")
    place = F.when(level == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", F.col("bucket"), 64 - level).cast("int"))
    return [level.alias("level"), place.alias("place")]


def _part_lists(found: list[list[tuple]]) -> pa.Array:
    """Lists of parts as an Arrow column."""
    flat = [p for one in found for p in one]
    firsts = np.concatenate([np.zeros(1, np.int32), np.cumsum([len(p[5]) for p in flat], dtype=np.int32)])
    marks = np.concatenate([p[4] for p in flat]) if flat else np.zeros(0, np.int64)
    buckets = np.concatenate([p[5] for p in flat]).view(np.int64) if flat else np.zeros(0, np.int64)
    fields = [
        *[pa.array([p[k] for p in flat], kind) for k, kind in ((0, pa.int32()), (1, pa.int32()), (2, pa.bool_()), (3, pa.int32()))],
        pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * MARK), pa.array(marks)),
        pa.ListArray.from_arrays(pa.array(firsts), pa.array(buckets)),
    ]
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum([len(one) for one in found], dtype=np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["level", "place", "own", "m", "mark", "buckets"]))


def node_of(text: str | None, words: int = WORDS) -> int:
    """Digest of a text's shingle set, as a signed long."""
    return _digest(shingle_set(text, words).tobytes())


def _digest(raw: bytes) -> int:
    k = xxhash.xxh64_intdigest(raw, SEED)
    return k - (1 << 64) if k >> 63 else k


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def prefixes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, node (digest of the set), n, fp (fingerprint), parities and parts of docs (doc_id, text)."""
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, words))

    def run(batches):
        for b in slices(batches):
            hashes = [shingle_hashes(t.as_py(), words) for t in b.column("text")]
            found = [np.unique(h) for h in hashes]
            columns = [pa.array([_digest(s.tobytes()) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int32()), pa.array([majority(s) for s in found], pa.int64()), pa.array([parities(s) for s in found], pa.binary()), _part_lists([parts(s, often.value, percent) for s in found])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "node", "n", "fp", "parities", "parts"])

    return _texts(docs).mapInArrow(run, "doc_id long, node long, n int, fp long, parities binary, parts array<struct<level int, place int, own boolean, m int, mark array<long>, buckets array<long>>>")


def sets(docs: DataFrame, each: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """node, shingles (the set's bytes) of nodes, from one row each; a bitmap says which texts to cut into shingles."""
    reps = each.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(reps.select(slot("doc_id").alias("slot"))))

    def run(batches):
        for b in slices(batches):
            raw = [shingle_set(b.column("text")[int(k)].as_py(), words).tobytes() for k in np.nonzero(has(wanted.value, b.column("slot").to_numpy()))[0]]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(r) for r in raw], pa.int64()), pa.array(raw, pa.binary())], ["node", "shingles"])

    rows = _texts(docs).select("text", slot("doc_id").alias("slot")).mapInArrow(run, "node long, shingles binary")
    return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, docs: DataFrame, each: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar."""
    spark = docs.sparkSession
    paths = [new_path(spark, name) for name in ("shingle-pairs", "shingle-sets")]
    pairs = written_to(pairs, paths[0])
    if pairs.isEmpty():
        return pairs
    found = written_to(sets(docs, each, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words), paths[1])

    def run(batches):
        for b in batches:
            x, y = ([np.frombuffer(s.as_buffer(), np.uint64) for s in b.column(c)] for c in ("x", "y"))
            yield b.select(["a", "b"]).filter(pa.array([similar(p, q, percent) for p, q in zip(x, y)], pa.bool_()))

    # The sets of the larger numbers come to the pairs first, so what is moved twice is one set a pair.
    full = pairs.join(found.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    links = written(full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "shingle-links")
    remove(spark, *paths)
    return links


def _may_reach(x: str, y: str, percent: int) -> str:
    """SQL: sets of sizes x and y can be similar at all."""
    return f"least({x}, {y}) * 100 >= {percent} * greatest({x}, {y})"


def _may_match(x: str, y: str, mx: str, my: str, percent: int) -> str:
    """SQL: the marks of sets of sizes x and y leave room for a similar pair, as in may_be_similar."""
    differ = " + ".join(f"bit_count({mx}[{k}] ^ {my}[{k}])" for k in range(MARK))
    return f"({x} + {y} - ({differ})) * {100 + percent} >= {2 * percent} * ({x} + {y})"


def _enough(x: str, y: str, shared: str, percent: int) -> str:
    """SQL: prefixes that share so many shingles leave room for a similar pair.

    The set whose prefix ends first has all that its prefix shares counted, so the overlap is at most
    shared more than the rest of that set, and the rest of the larger set is the longer one.
    """
    need = f"ceil({percent} * ({x} + {y}) / (100.0 + {percent}))"
    return f"{shared} >= {need} - (ceil({percent} * greatest({x}, {y}) / 100.0) - 1)"


def mixed(entries: DataFrame, path: str) -> DataFrame:
    """bucket, node, root and n (the bucket's entries) of the buckets that hold several roots, written to path."""
    dealt = entries.repartition("bucket")
    sizes = dealt.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("bucket", "n")
    return written_to(dealt.join(sizes, "bucket"), path)


def stars(still: DataFrame) -> DataFrame:
    """a, b: each set of the mixed buckets with one of another root, which is some bucket's star and shares most buckets with it.

    The star of a bucket is the member whose buckets hold most entries: among near copies of a text that is the one that was changed least, and
    most are similar to it.
    """
    weights = still.groupBy("node").agg(F.sum("n").alias("weight"))
    star = still.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "root")).alias("star"))
    near = still.join(star, "bucket").where(F.col("root") != F.col("star.root"))
    shared = near.groupBy(F.col("node").alias("a"), F.col("star.node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    return shared.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))


def undecided(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """a, b of those pairs (a, b, na, nb) that their parities don't rule out; whole sets are moved for these alone."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("x", "y", "na", "nb")))
            yield b.select(["a", "b"]).filter(pa.array([may_be_similar(*r, percent) for r in rows], pa.bool_()))

    full = pairs.join(marks.select(F.col("node").alias("a"), F.col("parities").alias("x")), "a").join(marks.select(F.col("node").alias("b"), F.col("parities").alias("y")), "b")
    return full.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def links(each: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """a, b links among distinct sets whose components are those of "similarity percent or more"."""
    spark = docs.sparkSession
    nodes = each.dropDuplicates(["node"])
    sizes = nodes.select("node", "n")
    marks = nodes.select("node", "parities")
    # The dealt method: each fingerprint with the smallest one that its deletion variants link it to, and sets of one fingerprint.
    reps = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "shingle-prints")
    near = simhash.links(reps.select("fp")).groupBy(F.greatest("a", "b").alias("a")).agg(F.min(F.least("a", "b")).alias("b"))
    a, b = (reps.select(F.col("fp").alias(x), F.col("node").alias("node" + x)) for x in "ab")
    same = nodes.select("node", "fp").join(reps.select("fp", F.col("node").alias("b")), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    found = verified(near.join(a, "a").join(b, "b").select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).unionByName(same), docs, each, words, percent)
    still, path = None, new_path(spark, "shingle-buckets")
    for round_ in range(STARS + 1):
        roots = components(found)
        entries = nodes.select("node", F.explode(F.flatten("parts.buckets")).alias("bucket")) if still is None else still.select("node", "bucket")
        ahead = new_path(spark, "shingle-buckets")
        still = mixed(entries.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "bucket"), ahead)
        remove(spark, path)
        path = ahead
        if still.isEmpty():
            break
        if round_ < STARS:
            chosen = stars(still).join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b").where(_may_reach("na", "nb", percent))
        else:
            # A pair of parts meets in a bucket only where sizes and marks allow it; they are the same in all its buckets, so shared stays whole.
            of = nodes.select("node", "n", F.inline("parts")).drop("buckets")
            known = still.select("bucket", "node", "root", *_part_of_bucket()).join(of, ["node", "level", "place"])
            x, y = (known.select("bucket", "level", "place", F.col("node").alias(side), *[F.col(c).alias(c + side) for c in ("root", "n", "own", "m", "mark")]) for side in "ab")
            bounds = [_may_reach("na", "nb", percent), _may_reach("ma", "mb", percent), _may_match("ma", "mb", "marka", "markb", percent)]
            meet = f"x.bucket = y.bucket AND a < b AND roota <> rootb AND (owna OR ownb) AND {' AND '.join(bounds)}"
            met = x.alias("x").join(y.drop("level", "place").alias("y"), F.expr(meet)).groupBy("a", "b", "na", "nb", "level", "place", "ma", "mb").agg(F.count(F.lit(1)).alias("shared"))
            chosen = met.where(_enough("ma", "mb", "shared", percent)).select("a", "b", "na", "nb").distinct()
        found = found.unionByName(verified(undecided(chosen, marks, percent), docs, each, words, percent))
    remove(spark, path)
    return found


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, node, root of each row of docs (doc_id, text): the digest of its set, and its component's smallest one."""
    each = written(prefixes(docs, words, percent), "shingles")
    roots = components(links(each, docs, words, percent))
    return each.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The row of smallest doc_id of each group of near copies, with all its columns."""
    return keep_first(docs, groups(docs, words, percent), lambda text: node_of(text, words))
