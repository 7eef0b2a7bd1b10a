"""Ranking, spatial non-maximum suppression, sheets, resumption and upserts of candidate records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfacelab.functions.vec import dot, norm, normalize, sub
from surfacelab.operators.rounds import advance, cut, greedy_rounds, shuffled


def _near(rows: DataFrame, others: DataFrame, distance: float, similarity: float, node: str, within: str | None, own: bool) -> DataFrame:
    """s, t of rows and others nearer than distance whose normals agree; own: both are the same rows, and each pair is met once.

    Cells of the distance's size are the join key; a point meets its own and the neighbouring cells, or half of them if the rows meet
    themselves. Only candidates of equal within (a volume) meet, if it is named.
    """
    cell = [F.floor(F.col("p")[k] / distance).cast("long").alias("c" + k) for k in "xyz"]
    left, right = (x.select((F.col(within) if within else F.lit(0)).alias("w"), F.col(node).alias("id"), "p", normalize("n").alias("n"), *cell) for x in (rows, others))
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if not own or (i, j, k) >= (0, 0, 0)]
    steps = F.array(*[F.struct((F.col("cx") + i).alias("jx"), (F.col("cy") + j).alias("jy"), (F.col("cz") + k).alias("jz"), F.lit((i, j, k) == (0, 0, 0)).alias("own")) for i, j, k in around])
    near = left.select("w", F.col("id").alias("s"), F.col("p").alias("ps"), F.col("n").alias("ns"), F.inline(steps))
    there = right.select("w", F.col("id").alias("t"), F.col("p").alias("pt"), F.col("n").alias("nt"), F.col("cx").alias("jx"), F.col("cy").alias("jy"), F.col("cz").alias("jz"))
    met = near.join(there, ["w", "jx", "jy", "jz"])
    met = met.where((~F.col("own")) | (F.col("s") < F.col("t"))) if own else met
    return met.where((norm(sub("ps", "pt")) < distance) & (F.abs(dot("ns", "nt")) >= similarity)).select("s", "t")


def conflicts(points: DataFrame, distance: float, similarity: float, node: str = "candidate_id", within: str | None = None) -> DataFrame:
    """a, b (a < b) of candidates nearer than distance whose normals agree: a range self-join.

    Cells of the distance's size are the join key; a point meets its own and half of the
    neighbouring cells, so each pair of cells meets once. Only candidates of equal within (a volume) meet, if it is named.
    """
    return _near(points, points, distance, similarity, node, within, True).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))


#: Candidates of the first part that a greedy suppression decides on.
FIRST = 4096


def suppress(points: DataFrame, distance: float, similarity: float = 0.8, limit: int | None = None, within: str | None = None, first: int = FIRST) -> DataFrame:
    """Candidates that a greedy pass by falling score keeps; ties by candidate_id.

    The rank is (score, id) itself, so no row number over all rows is needed. The best are decided first, in parts that grow fourfold; what conflicts with a
    candidate that they keep is out before it meets anything else. So where many lie close together few pairs are made: they are those of a part, and
    those with the kept ones, of which a cell and a direction hold few.
    """
    fall = -F.col("score")
    rank = F.struct(fall.alias("s"), F.col("candidate_id").alias("i"))
    live = cut(points.select(F.col("candidate_id").alias("node"), rank.alias("rank"), "p", "n", *([F.col(within).alias("in_")] if within else [])))
    group, found, size = "in_" if within else None, None, first
    while True:
        n = live.count()
        limit_ = None if n <= size else live.select(F.percentile_approx("rank.s", F.lit(size / n), F.lit(10_000))).first()[0]
        # Rows of equal score are of one part; null scores come first, as they do in the rank.
        now = F.lit(True) if limit_ is None else F.col("rank.s").isNull() | (F.col("rank.s") <= limit_)
        part = live.where(now)
        kept = cut(greedy_rounds(part.select("node", "rank"), conflicts(part, distance, similarity, "node", group)))
        found = kept if found is None else found.unionByName(kept)
        if limit_ is None:
            break
        taken = live.join(kept.select("node"), "node", "left_semi")
        rest = live.where(~now)
        out = _near(rest, taken, distance, similarity, "node", group, False).select(F.col("s").alias("node")).distinct()
        live, size = advance(live, rest.join(out, "node", "left_anti")), 4 * size
    out = points.join(shuffled(found.select(F.col("node").alias("candidate_id"))), "candidate_id", "left_semi")
    return out.orderBy(F.desc("score"), "candidate_id").limit(limit) if limit else out


def top(points: DataFrame, k: int) -> DataFrame:
    return points.orderBy(F.desc("score"), "candidate_id").limit(k)


def select_candidates(points: DataFrame, min_score: float = 0.0, top_n: int = 0) -> DataFrame:
    """Those at or above min_score if it is set, else the top_n (50 where it isn't set)."""
    return points.where(F.col("score") >= min_score) if min_score > 0 else top(points, top_n or 50)


def running_sums(rows: DataFrame, keys: list[str], order: list[str], value: str | None, name: str) -> DataFrame:
    """rows with name: the sum of value (of 1 if it is None) over the rows before, in the order of each key.

    Rows are dealt by ranges of (keys, order); a range's own sums are a window, and what lies before a range comes from one row
    for each key and range. So a key of any size is as many tasks as its share of the ranges. Rows of equal order must not fall into
    two ranges, so the order should be unique or its ties summed.
    """
    v = F.lit(1) if value is None else F.col(value)
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("part_", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "part_").agg(F.sum(v).alias("sum_"))
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "part_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("offset_"))
    own = Window.partitionBy(*keys, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.withColumn(name, F.coalesce(F.sum(v).over(own), F.lit(0)))
    return here.join(offsets, [*keys, "part_"]).withColumn(name, F.col(name) + F.col("offset_")).drop("part_", "offset_")


def numbered(points: DataFrame, keys: list[str], name: str = "number") -> DataFrame:
    """points with a number 0, 1, ... by falling score within keys, ties by candidate_id; counted by ranges."""
    return running_sums(points.withColumn("fall_", -F.col("score")), keys, ["fall_", "candidate_id"], None, name).drop("fall_")


def exact_quantile(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """keys with name: the linearly interpolated quantile of value over the rows of each key, nulls left out.

    Ranks come from running sums by ranges, so no task or buffer holds a key's values.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x_"))
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    place = (F.col("n_") - 1) * F.lit(float(q))
    ranked = running_sums(known, keys, ["x_"], None, "at_").join(counts, keys).withColumn("place_", place)
    low, high = (F.max(F.when(F.col("at_") == f("place_"), F.col("x_"))).alias(n) for f, n in ((F.floor, "low_"), (F.ceil, "high_")))
    got = ranked.where(F.abs(F.col("at_") - F.col("place_")) < 1).groupBy(*keys, "place_").agg(low, high)
    return got.select(*keys, (F.col("low_") + (F.col("high_") - F.col("low_")) * (F.col("place_") - F.floor("place_"))).alias(name))


def sheets(points: DataFrame, group: str, axis: str, count: int) -> DataFrame:
    """points with sheet: equal-count parts of each group along an axis; the first parts have one more where it doesn't divide."""
    placed = running_sums(points, [group], [axis, "candidate_id"], None, "at_").join(points.groupBy(group).agg(F.count(F.lit(1)).alias("n_")), group)
    small, more = F.floor(F.col("n_") / count), F.col("n_") % count
    after = more + F.floor((F.col("at_") - more * (small + 1)) / F.greatest(small, F.lit(1)))
    return placed.withColumn("sheet", F.when(F.col("at_") < more * (small + 1), F.floor(F.col("at_") / (small + 1))).otherwise(after).cast("int")).drop("at_", "n_")


def evenly(points: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """count rows of each key at evenly spaced places, ends included (fewer rows: places repeat once)."""
    rows = running_sums(points, keys, order, None, "at_").join(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")), keys)
    places = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.floor(k * (F.col("n_") - 1) / (count - 1)))
    return rows.where(F.array_contains(places, F.col("at_"))).drop("at_", "n_")


def chunk_order(points: DataFrame, chunk: int) -> DataFrame:
    """points dealt by ranges of their chunk and sorted by it, so that tasks read near chunks."""
    keys = [F.floor(F.col("p")[k] / chunk).cast("int").alias("c" + k) for k in "zyx"]
    return points.select("*", *keys).repartitionByRange("cz", "cy", "cx").sortWithinPartitions("cz", "cy", "cx", "candidate_id")


def remaining(todo: DataFrame, done: DataFrame, key: str, final: tuple[str, ...]) -> DataFrame:
    """Rows without a record of a final status: what a resumed run still has to do."""
    return todo.join(done.where(F.col("status").isin(*final)).select(key).distinct(), key, "left_anti")


def upsert(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """known with the rows of new put in or replaced."""
    rows = known.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    values = [c for c in known.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "__new").alias("r")).select(key, "r.*")


def first_places(lists: DataFrame, key: str, place: str) -> DataFrame:
    """Distinct keys of concatenated lists with the first place of each."""
    return lists.groupBy(key).agg(F.min(place).alias(place))


def lookup(ids: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """ids with their record, and error where there is none."""
    found = ids.join(records.withColumn("__found", F.lit(True)), key, "left")
    return found.withColumn("error", F.when(F.col("__found").isNull(), F.concat(F.lit("no record "), F.col(key).cast("string")))).drop("__found")


def choose(points: DataFrame, count: int, seed: int, key: str = "candidate_id") -> DataFrame:
    """count rows without replacement, the same for the same seed: those of least MD5 of seed and key."""
    return points.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(count)
