import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacelab.operators import flatten, linear
from surfacelab.operators import mesh as M
from surfacelab.operators import parameterise as P


def frames(spark, meshes):
    """vertices and faces of {name: (points, triangles)}."""
    v = [(m, k, dict(zip("xyz", map(float, p)))) for m, (points, _) in meshes.items() for k, p in enumerate(points)]
    f = [(m, k, *map(int, t)) for m, (_, triangles) in meshes.items() for k, t in enumerate(triangles)]
    vertices = spark.createDataFrame(v, "mesh long, vid long, p struct<x: double, y: double, z: double>")
    return vertices, spark.createDataFrame(f, "mesh long, fid long, a long, b long, c long")


def sheet(n, height):
    """A grid of n x n points on a height field, two triangles a square."""
    points = [(c, r, height(c, r)) for r in range(n) for c in range(n)]
    at = lambda r, c: r * n + c
    triangles = [t for r in range(n - 1) for c in range(n - 1) for t in ((at(r, c), at(r, c + 1), at(r + 1, c)), (at(r, c + 1), at(r + 1, c + 1), at(r + 1, c)))]
    return np.array(points, float), np.array(triangles)


MESHES = {1: sheet(7, lambda c, r: np.sin(c / 2) + 0.3 * r), 2: sheet(5, lambda c, r: 0.8 * c * r / 4), 3: sheet(9, lambda c, r: 2 * np.exp(-((c - 4) ** 2 + (r - 4) ** 2) / 4))}


def by_mesh(uv):
    out = {}
    for r in uv.collect():
        out.setdefault(r.mesh, {})[r.vid] = (r.u, r.v)
    return {m: np.array([d[k] for k in sorted(d)]) for m, d in out.items()}


def areas(uv, t):
    a, b, c = (uv[t[:, k]] for k in range(3))
    return ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2


def dense_cotangents(points, triangles):
    w = np.zeros((len(points),) * 2)
    for t in triangles:
        for k in range(3):
            i, j, o = t[k], t[(k + 1) % 3], t[(k + 2) % 3]
            x, y = points[i] - points[o], points[j] - points[o]
            w[i, j] += x @ y / np.linalg.norm(np.cross(x, y)) / 2
            w[j, i] = w[i, j]
    return w


@pytest.mark.parametrize("in_task", [linear.IN_TASK, 0])
def test_systems_are_solved_in_tasks_and_in_rounds(spark, in_task):
    rng = np.random.default_rng(3)
    rows, sides, want = [], [], {}
    for m, n in ((1, 5), (2, 12)):
        a = rng.normal(size=(n, n))
        a, b = a @ a.T + 4 * np.eye(n), rng.normal(size=(n, 2))
        rows += [(m, i - 3, j - 3, float(a[i, j])) for i in range(n) for j in range(n)]
        sides += [(m, i - 3, float(b[i, 0]), float(b[i, 1])) for i in range(n)]
        want[m] = np.linalg.solve(a, b)
    got = linear.solve(spark.createDataFrame(rows, "mesh long, i long, j long, a double"), spark.createDataFrame(sides, "mesh long, i long, u double, v double"), ["u", "v"], 1e-10, in_task=in_task)
    got = by_mesh(got.withColumnRenamed("i", "vid"))
    assert all(np.allclose(got[m], want[m], atol=1e-8) for m in want)


def test_a_system_that_is_not_solved_raises():
    with pytest.raises(ValueError, match="not solved"):
        linear.conjugate_gradients(np.array([0, 1, 0, 1]), np.array([0, 1, 1, 0]), np.array([1.0, 1, 0.9, 0.9]), np.ones(2) * [1, 2], 1e-12, 1)


def test_harmonic_and_conformal_maps_equal_dense_solves(spark):
    vertices, faces = frames(spark, MESHES)
    rim = P.on_circle(P.ordered_loops(faces), vertices)
    held = {m: {} for m in MESHES}
    for r in rim.collect():
        held[r.mesh][r.vid] = (r.u, r.v)
    got = by_mesh(flatten.harmonic(faces, vertices, rim, 1e-12))
    pins = spark.createDataFrame([(m, 0, 0.0, 0.0) for m in MESHES] + [(m, 3, 1.0, 0.0) for m in MESHES], "mesh long, vid long, u double, v double")
    plain = by_mesh(flatten.conformal(faces, vertices, pins, 1e-12))
    for m, (points, triangles) in MESHES.items():
        w = dense_cotangents(points, triangles)
        lap = np.diag(w.sum(1)) - w
        on = sorted(held[m])
        off = [k for k in range(len(points)) if k not in held[m]]
        uv = np.zeros((len(points), 2))
        uv[on] = [held[m][k] for k in on]
        uv[off] = np.linalg.solve(lap[np.ix_(off, off)], -lap[np.ix_(off, on)] @ uv[on])
        assert np.allclose(got[m], uv, atol=1e-8) and (areas(uv, triangles) > 0).all()
        # Rows of the Cauchy-Riemann equations, one complex row a face.
        rows = np.zeros((len(triangles), len(points)), complex)
        for k, t in enumerate(triangles):
            a, b, c = points[t]
            x = (b - a) / np.linalg.norm(b - a)
            y = np.cross(np.cross(b - a, c - a), x)
            y /= np.linalg.norm(y)
            flat = [complex(p @ x, p @ y) for p in (a - a, b - a, c - a)]
            rows[k, t] = np.array([flat[2] - flat[1], flat[0] - flat[2], flat[1] - flat[0]]) / np.sqrt(np.linalg.norm(np.cross(b - a, c - a)))
        known, free = [0, 3], [k for k in range(len(points)) if k not in (0, 3)]
        u = np.zeros(len(points), complex)
        u[known] = [0, 1]
        u[free] = np.linalg.lstsq(rows[:, free], -rows[:, known] @ u[known], rcond=None)[0]
        assert np.allclose(plain[m], np.stack([u.real, u.imag], 1), atol=1e-6)


def test_slim_lowers_the_energy_each_round_and_flips_nothing(spark):
    vertices, faces = frames(spark, {1: MESHES[1], 3: MESHES[3]})
    rim = P.on_circle(P.ordered_loops(faces), vertices)
    uv = flatten.harmonic(faces, vertices, rim)
    before = {r.mesh: r.energy for r in flatten.energies(faces, vertices, uv).collect()}
    for _ in range(2):
        uv = flatten.slim(faces, vertices, uv, rim, 1)
        now = {r.mesh: r.energy for r in flatten.energies(faces, vertices, uv).collect()}
        assert all(now[m] < before[m] for m in now)
        before = now
    for m, got in by_mesh(uv).items():
        assert (areas(got, MESHES[m][1]) > 0).all()


def test_what_a_method_flips_goes_on_to_the_next(spark, monkeypatch):
    vertices, faces = frames(spark, MESHES)
    harmonic = flatten.harmonic

    def spoilt(f, v, rim):
        # The middle vertex of mesh 2 is pulled over its neighbours.
        return harmonic(f, v, rim).withColumn("u", F.when((F.col("mesh") == 2) & (F.col("vid") == 12), 0.99).otherwise(F.col("u")))

    monkeypatch.setattr(flatten, "harmonic", spoilt)
    got = flatten.flattened(faces, vertices, 0)
    assert {(r.mesh, r.method) for r in got.select("mesh", "method").distinct().collect()} == {(1, "harmonic"), (2, "conformal"), (3, "harmonic")}
    ends = got.groupBy("mesh").agg(*[f(k).alias(f.__name__ + k) for k in "uv" for f in (F.min, F.max)]).collect()
    assert all(abs(r[1 + i] - (i % 2)) < 1e-12 for r in ends for i in range(4))
    for m, uv in by_mesh(got).items():
        assert (areas(uv, MESHES[m][1]) > 0).all()
    quality = {r.mesh: (r.flipped, r.collapsed) for r in M.uv_quality(faces, got).collect()}
    assert set(quality.values()) == {(0.0, 0.0)}
