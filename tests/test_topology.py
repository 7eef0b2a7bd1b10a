import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacelab.operators import mesh as M
from surfacelab.operators import parameterise as P
from surfacelab.operators import raster, ridge, stencil
from surfacelab.operators.ranking import exact_quantile
from surfacelab.plans.topology import topology_unwrap
from tests.test_flatten import frames, sheet

SIZE = 30


def probability_sheet(second_layer):
    z, y, x = np.mgrid[:SIZE, :SIZE, :SIZE]
    first = np.exp(-0.5 * ((z - (13 + 1.5 * np.sin(x / 9))) / 1.2) ** 2)
    if second_layer:
        first = np.maximum(first, np.exp(-0.5 * ((z - (20 + 1.0 * np.cos(y / 8))) / 1.2) ** 2))
    return first


def voxels(spark, volumes):
    import pandas as pd

    parts = []
    for k, v in volumes.items():
        z, y, x = np.indices(v.shape)
        parts.append(pd.DataFrame({"vol": k, "z": z.ravel().astype("int32"), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": v.ravel()}))
    return spark.createDataFrame(pd.concat(parts))


def seeds(spark, at):
    return spark.createDataFrame([(k, dict(zip("xyz", map(float, p)))) for k, p in at.items()], "vol long, seed struct<x: double, y: double, z: double>")


@pytest.fixture(scope="module")
def unwrapped(spark):
    volume = voxels(spark, {0: probability_sheet(False), 1: probability_sheet(True), 2: np.full((5, 5, 5), 0.5)})
    smooth = stencil.gaussian(volume, ["vol"], ["z", "y", "x"], 0.6)
    return topology_unwrap(smooth, seeds(spark, {0: (15, 15, 13), 1: (15, 15, 13), 2: (2, 2, 2)}), 9.0, SIZE, slim_rounds=1)


def test_sheets_become_disks_without_flips_and_the_seed_chooses_its_layer(unwrapped):
    got = {r.mesh: r for r in unwrapped.metrics.collect()}
    assert got[2].status == "no ridge"
    for m in (0, 1):
        r = got[m]
        assert r.status == "unwrapped" and r.euler == 1 and r.flipped == 0 and r.collapsed == 0 and r.vertices >= 100 and r.method == "harmonic+slim"
        assert r.adherence > 0.95 and r.coverage > 0.95 and r.overlap < 0.05
    z = {r.mesh: r.z for r in unwrapped.surface.groupBy("mesh").agg(F.percentile("p.z", F.lit(0.5)).alias("z")).collect()}
    assert set(z) == {0, 1} and all(12 < v < 16 for v in z.values())


def test_the_surface_follows_the_sheet(unwrapped):
    rows = unwrapped.surface.select("mesh", "p", "normal").collect()
    off = [abs(r.p.z - (13 + 1.5 * np.sin(r.p.x / 9))) for r in rows]
    assert np.mean(off) < 0.2 and max(off) < 0.8
    # Inside, normals point along z; at the rim of the raster places outside count as zero.
    assert np.median([abs(r.normal.z) for r in rows]) > 0.9


def test_eigenvectors_of_simple_double_and_triple_values(spark):
    rng = np.random.default_rng(0)
    cases = [(a + a.T) / 2 for a in rng.normal(size=(40, 3, 3))] + [np.diag([-2.0, -2.0, 1.0]), np.diag([0.0, -1.0, -1.0]), np.zeros((3, 3)), np.diag([-1.0, 3.0, 3.0]), -np.eye(3)]
    names = {"axx": (0, 0), "ayy": (1, 1), "azz": (2, 2), "axy": (0, 1), "axz": (0, 2), "ayz": (1, 2)}
    rows = spark.createDataFrame([(k, *[float(a[i]) for i in names.values()]) for k, a in enumerate(cases)], "k long, " + ", ".join(n + " double" for n in names))
    for r in ridge.least_eigenvector(stencil.symmetric_eigenvalues(rows)).collect():
        n, a = np.array(r.n), cases[r.k]
        assert abs(n @ n - 1) < 1e-9 and np.allclose(a @ n, np.linalg.eigvalsh(a)[0] * n, atol=1e-6)


def test_features_equal_a_dense_eigen_decomposition(spark):
    v = np.random.default_rng(6).random((6, 5, 7))
    field = voxels(spark, {4: v})
    got = {(r.z, r.y, r.x): r for r in ridge.features(field, seeds(spark, {4: (3, 2, 3)})).collect()}
    g = np.stack(np.gradient(v), -1)
    h = np.stack([np.stack(np.gradient(g[..., k]), -1) for k in range(3)], -2)
    e, vectors = np.linalg.eigh((h + np.swapaxes(h, -1, -2)) / 2)
    curvature, normal = np.maximum(-e[..., 0], 0), vectors[..., 0]
    anisotropy = curvature / (abs(e[..., 1]) + abs(e[..., 2]) + curvature + 1e-6)
    candidate = (v >= 0.15) & (anisotropy >= 0.25) & (curvature >= np.percentile(curvature[curvature > 0], 15))
    grown = candidate.copy()
    for axis in range(3):
        for way in (1, -1):
            moved = np.roll(candidate, way, axis)
            index = [slice(None)] * 3
            index[axis] = 0 if way == 1 else -1
            moved[tuple(index)] = False
            grown |= moved
    reference = None
    box = np.argwhere(np.ones_like(v, bool))
    near = [tuple(p) for p in box if (abs(p - [3, 2, 3]) <= 4).all()]
    reference = normal[max(near, key=lambda p: (v * anisotropy)[p])]
    for p, r in got.items():
        n = normal[p] * (1 if normal[p] @ reference >= 0 else -1)
        sign = 1 if np.array(r.n)[::-1] @ n > 0 else -1
        assert np.allclose(np.array(r.n)[::-1] * sign, n, atol=1e-6) and np.isclose(r.ridge * sign, g[p] @ n, atol=1e-6)
        assert r.candidate == grown[p] and np.isclose(r.confidence, (v * anisotropy * curvature)[p], atol=1e-6)


def test_a_punctured_disk_is_filled_at_its_first_radius(spark):
    points, triangles = sheet(9, lambda c, r: 0.1 * c)
    hole = {4 * 9 + 4}
    small = np.array([t for t in triangles if not hole & set(map(int, t))])
    # A sheet with a square cut out of its middle, four cells wide, is an annulus: its inner loop is too long to be filled.
    wide = np.array([t for t in triangles if not all(2 <= points[k][0] <= 6 and 2 <= points[k][1] <= 6 for k in t)])
    vertices, faces = frames(spark, {1: (points, small), 2: (points, wide), 3: (points, triangles)})
    faces = P.orient(faces)
    distance = vertices.select("mesh", "vid", F.sqrt(F.pow(F.col("p.x") - 4, 2) + F.pow(F.col("p.y") - 4, 2)).alias("distance"))
    disk, at, told = P.disks(faces, vertices, distance, [9.0, 7.2], 8)
    assert {r.mesh: (r.radius, r.filled) for r in told.collect()} == {1: (9.0, 1), 3: (9.0, 0)}
    got = {r.mesh: r for r in M.topology(disk).collect()}
    assert got[1].euler == 1 and got[1].vertices == 81 and got[3].vertices == 81
    assert at.where("vid < 0").select("mesh").collect() == [(1,)]
    # The fan runs the same way as the faces around it.
    twice = P.directed_edges(disk).groupBy("mesh", "s", "t").count().where("count > 1")
    assert twice.count() == 0


def test_the_largest_component_within_reach_is_chosen(spark):
    vertices, faces = frames(spark, {1: sheet(4, lambda c, r: 0), 2: sheet(3, lambda c, r: 1)})
    both = vertices.select(F.lit(9).cast("long").alias("mesh"), (F.col("vid") + 100 * F.col("mesh")).alias("vid"), "p")
    three = faces.select(F.lit(9).cast("long").alias("mesh"), (F.col("fid") + 100 * F.col("mesh")).alias("fid"), *[(F.col(k) + 100 * F.col("mesh")).alias(k) for k in "abc"])
    seed = spark.createDataFrame([(9, (0.0, 0.0, 1.0))], "mesh long, seed struct<x: double, y: double, z: double>")
    assert M.near_component(three, both, seed, 20).count() == 18
    assert M.near_component(three, both, seed, 0.5).count() == 8
    far = spark.createDataFrame([(9, (0.0, 0.0, 90.0))], "mesh long, seed struct<x: double, y: double, z: double>")
    assert M.near_component(three, both, far, 20).count() == 8


def test_the_raster_keeps_areas_and_refuses_too_many_pixels(spark):
    vertices, faces = frames(spark, {1: sheet(5, lambda c, r: 0)})
    uv = vertices.select("mesh", "vid", (F.col("p.x") / 4).alias("u"), (F.col("p.y") / 4).alias("v"))
    pixels, sizes = raster.scaled(faces, vertices, uv, 0.5)
    (s,) = sizes.collect()
    assert (s.width, s.height, s.fits) == (9, 9, True) and abs(s.scale - 8) < 1e-12
    got = {(r.row, r.col): r for r in pixels.collect()}
    assert len(got) == 64 and all(abs(r.p.x - (c + 0.5) / 2) < 1e-9 and abs(r.p.y - (k + 0.5) / 2) < 1e-9 for (k, c), r in got.items())
    pixels, sizes = raster.scaled(faces, vertices, uv, 0.5, most=80)
    assert pixels.count() == 0 and not sizes.first().fits


def test_exact_quantiles_by_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(k, None if rng.random() < 0.1 else float(rng.integers(0, 40))) for k in range(3) for _ in range(1 + 60 * k)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)
    for q in (0.0, 0.15, 0.5, 1.0):
        got = {r.k: r.q for r in exact_quantile(df, ["k"], "v", q, "q").collect()}
        want = {k: [v for i, v in rows if i == k and v is not None] for k in range(3)}
        assert all(np.isclose(got[k], np.quantile(x, q)) for k, x in want.items() if x)


def test_stencils_do_not_reach_across_gaps(spark):
    line = spark.createDataFrame([(0, 0, 0, z, float(v)) for z, v in ((0, 1), (1, 4), (5, 100), (6, 110))], "vol long, y int, x int, z int, v double")
    got = {r.z: r.gz for r in stencil.gradient(line, ["vol"], ["z"]).collect()}
    assert got == {0: 3.0, 1: 3.0, 5: 10.0, 6: 10.0}
    assert {r.z for r in stencil.local_maxima(line, ["vol"], ["z"], 2, 0.0).collect()} == {1, 6}
    means = {r.z: r.mean4 for r in stencil.neighbour_mean(line, ["vol"], ["z"], F.lit(True)).collect()}
    assert means == {0: 4.0, 1: 1.0, 5: 110.0, 6: 100.0}
    marked = line.withColumn("m", F.col("z") == 1)
    assert {r.z for r in stencil.dilate_cross(marked, ["vol"], ["z"], "m").where("m").collect()} == {0, 1}
    # Two runs are blurred each for itself: sums are kept.
    sums = {r.k: r.s for r in stencil.gaussian(line, ["vol"], ["z"], 0.6).groupBy((F.col("z") > 3).alias("k")).agg(F.sum("v").alias("s")).collect()}
    assert np.isclose(sums[False], 5) and np.isclose(sums[True], 210)


def test_volumes_of_known_extent_have_the_features_of_any_and_move_no_voxels(spark):
    cells = spark.range(2 * 6 * 6 * 6).select(F.floor(F.col("id") / 216).cast("long").alias("vol"), (F.floor(F.col("id") / 36) % 6).cast("int").alias("z"), (F.floor(F.col("id") / 6) % 6).cast("int").alias("y"), (F.col("id") % 6).cast("int").alias("x"))
    field = cells.withColumn("v", F.exp(-0.5 * F.pow((F.col("z") - 2.3 - 0.3 * F.col("y") + 0.1 * F.col("vol")) / 1.2, 2)) + 0.01 * F.pmod(F.xxhash64("vol", "z", "y", "x"), F.lit(10))).repartition(4, "vol")
    at = seeds(spark, {0: (3, 2, 3), 1: (0, 9, 5)})
    columns = ["vol", "z", "y", "x", "candidate", *[F.round(k, 9).alias(k) for k in ("v", "n.x", "n.y", "n.z", "ridge", "confidence")]]
    whole = ridge.features(field, at, extent=6)
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, ridge.features(field, at).select(*columns).collect()))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(vol") <= 5 and "hashpartitioning(vol#" in plan and ", z#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_ridge_meshes_are_planned_by_steps_that_do_not_grow_on_one_another(spark, monkeypatch):
    import threading

    class Planned(Exception):
        pass

    plans = []

    def cut(df, key=None):
        plans.append(df._jdf.queryExecution())
        raise Planned

    monkeypatch.setattr(ridge, "cut", cut)
    field = voxels(spark, {0: probability_sheet(False)[:8, :8, :8]})
    with pytest.raises(Planned):
        ridge.ridge_mesh(ridge.features(field, seeds(spark, {0: (4, 4, 4)}), extent=8), 8)
    # In a thread, as a plan that grows by powers ends with the heap only.
    planner = threading.Thread(target=lambda: len(plans[0].optimizedPlan().toString()), daemon=True)
    planner.start()
    planner.join(60)
    assert not planner.is_alive()
