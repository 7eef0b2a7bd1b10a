"""Iterative graph operators as DataFrame rounds; each round is written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfacelab.operators import intask


def new_path(spark: SparkSession, name: str) -> str:
    """A path below spark.checkpoint.dir, the folder that all executors share, that no other run uses."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-rounds-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """df, whose joins send both sides to tasks by key: the size of its files doesn't tell how many rows are made of them (a vector is
    hundreds of voxels, a round's keys are packed), so the planner would take many for few and collect them in the driver."""
    return df.hint("merge")


def apart(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """df with more columns that the planner doesn't see through: what comes after neither repeats their expressions nor draws conclusions
    from them. A few steps of expressions on one another grow by powers without that, and fill the driver before a job begins."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt to tasks by key, for keys of few rows each: joins, sums and windows by key and more columns move nothing any more.

    The number of tasks is given, as the planner would join few bytes into few tasks, however many rows are made of them.
    """
    spark = df.sparkSession
    # Rows dealt by key lie together for key and more columns as well; without this a join on (key, node) moves both sides again.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(parts(spark), key)


def cut(df: DataFrame, key: str | None = None) -> DataFrame:
    """df written below the shared folder and read again, so that lineage doesn't grow; with key it stays dealt by it."""
    spark = df.sparkSession
    path = new_path(spark, "round")
    if key is None:
        df.write.parquet(path)
        out = shuffled(spark.read.schema(df.schema).parquet(path))
    else:
        out_name = "round_" + uuid.uuid4().hex
        dealt(df, key).write.format("parquet").bucketBy(parts(spark), key).option("path", path).saveAsTable(out_name)
        out = shuffled(spark.table(out_name))
        out.table_name = out_name
    out.written_at, out.dealt_by = path, key
    return out


def advance(old: DataFrame, df: DataFrame) -> DataFrame:
    """df written and read again in the place of old, which it is made of and whose table is removed: an iteration keeps one round."""
    new = cut(df) if old.dealt_by is None else cut(df, old.dealt_by)
    discard(old)
    return new


def discard(*tables: DataFrame) -> None:
    """Removes the tables of frames that cut has returned and that no later result reads."""
    for df in tables:
        spark = df.sparkSession
        if df.dealt_by is not None:
            spark.sql(f"DROP TABLE {df.table_name}")
        place = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _swapped(edges: DataFrame, own: list[str], *more: str) -> DataFrame:
    """Edges in both directions, each row twice where it lies."""
    return shuffled(edges.select(*own, F.inline(F.array(F.struct("a", "b", *more), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), *more)))))


def component_labels(nodes: DataFrame, edges: DataFrame, key: str | None = None) -> DataFrame:
    """node, label of nodes (node) and edges (a, b): the least node of each component.

    Alternating stars: each node links its larger neighbours to its least one, then itself's smaller ones likewise, until every
    node links to its root alone. Links never grow, and a component of any size is many keys until its last round.
    key: a field of the nodes that edges don't leave and that few nodes share; its graph is worked out in the task that its edges meet in.
    Where a key has too many edges for that, rounds are dealt by it and move nothing.
    """
    own = [] if key is None else ["__key"]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df if key is None else df.select(F.col(name)[key].alias("__key"), "*")

    def least(links: DataFrame) -> DataFrame:
        return links.groupBy(*own, "a").agg(F.min("b").alias("m"))

    links = keyed(edges.select("a", "b").where("a <> b"), "a")
    fields = key and intask.own_fields(edges.schema["a"].dataType, key)
    if fields:
        links = cut(links, *own)
        if intask.fits(links, *own):
            ends = intask.component_labels(links, key, *own, fields)
            return shuffled(keyed(nodes.select("node"), "node")).join(ends, [*own, "node"], "left").select("node", F.coalesce("label", "node").alias("label"))
    now = cut(links.distinct(), *own)
    last = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sign == last or not sign[0]:
            break
        last = sign
        both = _swapped(now, own)
        large = both.where("b > a").join(least(both).select(*own, "a", F.least("a", "m").alias("m")), [*own, "a"]).select(*own, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(*own, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # A node and each of its smaller neighbours link to the least one.
        stars = shuffled(down).join(least(down), [*own, "a"]).select(*own, F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = advance(now, stars.where("a <> b").distinct())
    ends = now.select(*own, F.col("a").alias("node"), F.col("b").alias("label"))
    return shuffled(keyed(nodes.select("node"), "node")).join(ends, [*own, "node"], "left").select("node", F.coalesce("label", "node").alias("label"))


def grid_edges(cells: DataFrame, keys: list[str], axes: list[str], reach: int) -> DataFrame:
    """a, b of neighbouring cells: offsets of -1, 0, 1 whose absolute values sum to reach at most.

    A cell's node is a struct of its keys and axes, so grids of one table stay apart.
    """
    offsets = [()]
    for _ in axes:
        offsets = [(*o, k) for o in offsets for k in (-1, 0, 1)]
    ahead = [o for o in offsets if any(o) and sum(map(abs, o)) <= reach and o > tuple([0] * len(axes))]
    shift = F.explode(F.array(*[F.array(*[F.lit(k) for k in o]) for o in ahead])).alias("o")
    near = cells.select(*keys, *axes, shift)
    moved = near.select(*keys, F.struct(*keys, *axes).alias("a"), *[(F.col(x) + F.get("o", F.lit(i))).alias(x) for i, x in enumerate(axes)])
    return moved.join(cells.select(*keys, *axes), [*keys, *axes]).select("a", F.struct(*keys, *axes).alias("b"))


def label_cells(cells: DataFrame, keys: list[str], axes: list[str], reach: int, key: str | None = None) -> DataFrame:
    """cells with label: the first cell of the component, in the order of keys and axes. key: one of keys, where few cells share it."""
    nodes = cells.select(F.struct(*keys, *axes).alias("node"))
    labels = component_labels(nodes, grid_edges(cells, keys, axes, reach), key)
    return labels.select(*[F.col("node")[k].alias(k) for k in [*keys, *axes]], "label")


def largest(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of each key's largest component; of equal ones the first."""
    sizes = labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy(*keys).orderBy(F.desc("n"), "label")
    best = sizes.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "n")
    return shuffled(labelled.join(best, [*keys, "label"], "left_semi"))


def fill_holes(field: DataFrame, keys: list[str], axes: list[str], name: str, key: str | None = None) -> DataFrame:
    """field with the background that no path of cross neighbours joins to the border filled in. key: one of keys, where few cells share it."""
    rows = cut(field, key)
    space = rows.where(~F.col(name))
    labels = label_cells(space, keys, axes, 1, key)
    ends = rows.groupBy(*keys).agg(*[F.max(a).alias("hi_" + a) for a in axes], *[F.min(a).alias("lo_" + a) for a in axes])
    edge = F.lit(False)
    for a in axes:
        edge = edge | (F.col(a) == F.col("hi_" + a)) | (F.col(a) == F.col("lo_" + a))
    open_ = labels.join(ends, keys).where(edge).select(*keys, "label").distinct()
    holes = labels.join(open_, [*keys, "label"], "left_anti").select(*keys, *axes, F.lit(True).alias("__hole"))
    return rows.join(holes, [*keys, *axes], "left").withColumn(name, F.col(name) | F.coalesce("__hole", F.lit(False))).drop("__hole")


def shortest_paths(sources: DataFrame, edges: DataFrame, most: float = float("inf"), key: str | None = None) -> DataFrame:
    """node, distance from the sources (node) over edges (a, b, w), up to the distance most: minimum rounds until none falls.

    key: as of component_labels.
    """
    own = [] if key is None else ["__key"]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df if key is None else df.select(F.col(name)[key].alias("__key"), "*")

    both = cut(_swapped(keyed(edges.select("a", "b", "w"), "a").where(F.col("w") <= most), own, "w"), *own)
    fields = key and intask.own_fields(edges.schema["a"].dataType, key)
    if fields and intask.fits(both, *own):
        return intask.shortest_paths(keyed(sources.select("node"), "node"), both, most, key, *own, fields).select("node", "distance")
    now = cut(keyed(sources.select("node", F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")), "node"), *own)
    while now.where("fresh").limit(1).count():
        moved = now.where("fresh").withColumnRenamed("node", "a").join(both, [*own, "a"]).select(*own, F.col("b").alias("node"), (F.col("distance") + F.col("w")).alias("new")).where(F.col("new") <= most)
        least = moved.groupBy(*own, "node").agg(F.min("new").alias("new"))
        met = now.drop("fresh").join(least, [*own, "node"], "full")
        better = F.coalesce(F.col("new") < F.col("distance"), F.col("distance").isNull())
        now = advance(now, met.select(*own, "node", F.least("distance", "new").alias("distance"), better.alias("fresh")))
    return now.select("node", "distance")


def greedy_rounds(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The nodes (node, rank) that a greedy pass by rank accepts, conflicts (a, b) excluding one another.

    A live node that outranks its live neighbours is accepted; they are rejected; repeat. The
    result is the sequential one, in as many rounds as the longest chain of decisions.
    """
    both = cut(conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(nodes.select("node", "rank", F.lit(0).alias("state")))
    while state.where("state = 0").limit(1).count():
        live = state.where("state = 0").select("node", "rank")
        near = both.join(live.select(F.col("node").alias("b"), F.col("rank").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        accepted = live.join(near, "node", "left").where("other IS NULL OR rank < other").select("node")
        hit = both.join(accepted.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node")).distinct()
        marks = accepted.select("node", F.lit(1).alias("mark")).unionByName(hit.select("node", F.lit(2).alias("mark"))).groupBy("node").agg(F.min("mark").alias("mark"))
        state = advance(state, state.join(marks, "node", "left").select("node", "rank", F.when(F.col("state") == 0, F.coalesce("mark", F.lit(0))).otherwise(F.col("state")).alias("state")))
    return state.where("state = 1").select("node", "rank")
