import os

import pytest
from pyspark.sql import functions as F

from surfacelab.operators import rounds as G


@pytest.fixture
def writes(monkeypatch):
    """Counts the tables that rounds write."""
    seen, cut = [], G.cut

    def counted(df):
        out = cut(df)
        seen.append(out.written_at)
        return out

    monkeypatch.setattr(G, "cut", counted)
    return seen


def left(paths):
    return [p for p in paths if os.path.exists(p.removeprefix("file://"))]


def test_a_long_path_and_a_hub_take_few_rounds_and_leave_one_table(spark, writes):
    n = 100_000
    # Node k of the path is k * 7919 mod n, so neighbours in the path aren't neighbours by number.
    path = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("a"), ((F.col("id") + 1) * 7919 % n).alias("b"))
    hub = spark.range(1, 20_000).select((F.col("id") + 10 * n).alias("a"), F.lit(10 * n).cast("long").alias("b"))
    edges = path.unionByName(hub)
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().unionByName(spark.range(50 * n, 50 * n + 3).select(F.col("id").alias("node")))
    got = {(r.label, r.n) for r in G.component_labels(nodes, edges).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(0, n), (10 * n, 20_000), *((50 * n + k, 1) for k in range(3))}
    assert len(writes) <= 25 and len(left(writes)) == 1


def test_no_edges_and_no_nodes(spark):
    edges = spark.createDataFrame([], "a long, b long")
    assert [tuple(r) for r in G.component_labels(spark.range(2).withColumnRenamed("id", "node"), edges).orderBy("node").collect()] == [(0, 0), (1, 1)]
    assert G.component_labels(edges.select(F.col("a").alias("node")), edges).count() == 0


def test_paths_stop_at_a_distance_and_leave_one_round(spark, writes):
    line = spark.createDataFrame([(k, k + 1, 1.0) for k in range(12)], "a long, b long, w double")
    start = spark.createDataFrame([(0,)], "node long")
    got = {r.node: r.distance for r in G.shortest_paths(start, line, 5.5).collect()}
    assert got == {k: float(k) for k in range(6)}
    # The edges and the last round.
    assert len(left(writes)) == 2


def test_rounds_dealt_by_a_key_move_nothing_and_equal_others(spark):
    """Paths of ten nodes each in five meshes: labels and distances are those of undealt rounds, and a dealt round's joins need no exchange."""
    node = lambda x: F.struct("mesh", x.cast("long").alias("vid"))
    rows = spark.range(50).select((F.col("id") % 5).alias("mesh"), F.floor(F.col("id") / 5).alias("k"))
    nodes = rows.select(node(F.col("k")).alias("node"))
    edges = rows.where("k < 9 AND k <> 4").select(node(F.col("k")).alias("a"), node(F.col("k") + 1).alias("b"), (F.col("k") + 1.0).alias("w"))
    for make in (lambda key: G.component_labels(nodes, edges, key), lambda key: G.shortest_paths(nodes.where("node.vid = 2"), edges, key=key)):
        assert sorted(make("mesh").collect()) == sorted(make(None).collect())
    one = G.cut(rows, "mesh")
    two = one.groupBy("mesh", "k").agg(F.count(F.lit(1)).alias("n")).join(one.select("mesh", "k"), ["mesh", "k"])
    assert "Exchange" not in two._jdf.queryExecution().executedPlan().toString()


def test_small_keys_are_worked_out_in_tasks_as_rounds_do(spark, monkeypatch):
    from surfacelab.operators import intask

    at = [F.struct(F.col("k").alias("mesh"), F.col(n).alias("vid")).alias(n) for n in "ab"]
    edges = spark.range(300).select((F.col("id") % 7).alias("k"), *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40)).alias(n) for i, n in enumerate("ab")])
    edges = edges.select(*at, ((F.abs(F.col("a") - F.col("b")) % 5 + 1) / 3).alias("w")).cache()
    nodes = spark.range(7 * 45).select(F.struct((F.col("id") % 7).alias("mesh"), F.floor(F.col("id") / 7).alias("vid")).alias("node"))
    start = nodes.where("node.vid IN (3, 44)")
    written, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, *a: written.append(df) or cut(df, *a))

    def told(key):
        written.clear()
        got = [sorted((tuple(r[0]), r[1] if isinstance(r[1], float) else tuple(r[1])) for r in df.collect()) for df in (G.component_labels(nodes, edges, key), G.shortest_paths(start, edges, 2.5, key))]
        return got, len(written)

    want, _ = told(None)
    assert told("mesh") == (want, 2)  # the links and the edges, and no rounds
    monkeypatch.setattr(intask, "IN_TASK", 10)
    got, n = told("mesh")
    assert got == want and n > 2


def test_loops_of_small_meshes_have_the_places_of_doubling(spark):
    from surfacelab.operators import mesh as M
    from surfacelab.operators import parameterise as P

    grid = spark.range(3 * 36).select((F.col("id") % 3).alias("grid"), (F.floor(F.col("id") / 3) % 6).alias("r"), F.floor(F.col("id") / 18).alias("c"))
    grid = grid.withColumn("valid", ~((F.col("r") == 2 + F.col("grid") % 2) & (F.col("c") == 2))).withColumn("p", F.struct(*[F.col(k).cast("double").alias(n) for k, n in zip("crc", "xyz")]))
    faces = M.grid_faces(grid, 6)
    assert sorted(P.ordered_loops(faces, "mesh").collect()) == sorted(P.ordered_loops(faces).collect())
