"""Closed-form fields: what the operators must find is known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacelab.functions import vec as V
from surfacelab.operators import ranking, sampling, stencil
from surfacelab.operators import rounds as G
from surfacelab.plans import search
from surfacelab.sources import chunks, files


def volume(spark, shape, value):
    nz, ny, nx = shape
    i = F.col("id")
    rows = spark.range(nz * ny * nx).select(F.lit(0).cast("long").alias("vol"), F.floor(i / (ny * nx)).cast("int").alias("z"), (F.floor(i / nx) % ny).cast("int").alias("y"), (i % nx).cast("int").alias("x"))
    return rows.withColumn("v", value)


def slab(spark, n=12):
    return volume(spark, (n, n, n), F.exp(-0.5 * F.pow((F.col("z") - 6) / 1.2, 2)))


def test_both_samplers_follow_a_linear_field(spark, tmp_path):
    field = volume(spark, (18, 20, 22), 3.0 * F.col("z") + 2 * F.col("y") + F.col("x")).cache()
    nan = float("nan")
    pts = spark.createDataFrame([(1, 0, 4.25, 5.5, 6.75), (2, 0, 15.1, 12.2, 9.3), (3, 0, nan, nan, nan), (4, 0, -0.5, 3.0, 2.0), (5, 0, 90.0, 0.0, 0.0)], "id long, vol long, x double, y double, z double")
    pts = pts.select("id", "vol", V.vec("x", "y", "z").alias("p"))
    want = {1: 35.5, 2: 67.4, 3: 0.0, 4: 6.0, 5: 0.0}
    got = {r.id: r.sample for r in sampling.sample(pts, field, ["id"]).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    path = str(tmp_path / "chunks")
    chunks.write_chunks(field, path, 8)
    blobs = chunks.read_chunks(spark, path)
    assert {r.id: r.sample for r in chunks.sample_chunks(pts, blobs, 8, ["id"]).collect()} == pytest.approx(want, abs=1e-9)
    box = {"z": (9, 12), "x": (0, 5)}
    crop = chunks.unpack(chunks.read_chunks(spark, path, 0, box, 8), 8, box)
    assert crop.count() == 3 * 20 * 5 and crop.join(field, ["vol", "z", "y", "x", "v"], "left_anti").count() == 0
    plan = chunks.read_chunks(spark, path, 0, box, 8)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(cz,1)" in plan


def test_projection_finds_the_plane(spark):
    field = volume(spark, (24, 8, 8), F.exp(-0.5 * F.pow((F.col("z") - 13.6) / 1.25, 2)))
    pts = spark.createDataFrame([(1, 0)], "id long, vol long").select("id", "vol", V.vec(F.lit(4), F.lit(4), F.lit(8)).alias("p"), V.vec(F.lit(0), F.lit(0), F.lit(1)).alias("n"))
    r = sampling.project(pts, field, ["id"], 8.0, 17).first()
    assert r.sample > 0.5 and abs(8 + r.offset - 13.6) < 2


def test_gaussian_equals_numpy(spark):
    n = 7
    field = volume(spark, (n, n, n), (F.col("z") * 5 + F.col("y") * 3 + F.col("x") * 7) % 11 / 11.0)
    a = np.fromfunction(lambda z, y, x: (z * 5 + y * 3 + x * 7) % 11 / 11.0, (n, n, n))
    w = np.array(stencil.gaussian_weights(0.9))
    r = len(w) // 2
    for axis in range(3):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
        a = sum(w[k] * np.take(p, range(k, k + n), axis=axis) for k in range(len(w)))
    for row in stencil.gaussian(field, ["vol"], ["z", "y", "x"], 0.9).collect():
        assert row.v == pytest.approx(a[row.z, row.y, row.x], abs=1e-12)


def test_hessian_equals_numpy(spark):
    n = 4
    field = volume(spark, (n, n, n), (F.col("z") * 5 + F.col("y") * F.col("x") * 3) % 7 / 7.0)
    a = np.fromfunction(lambda z, y, x: (z * 5 + y * x * 3) % 7 / 7.0, (n, n, n))
    g = np.gradient(a)
    h = np.array([np.gradient(k) for k in g])
    e = np.linalg.eigvalsh(np.moveaxis((h + h.transpose(1, 0, 2, 3, 4)) / 2, (0, 1), (3, 4)))
    for r in stencil.hessian_eigenvalues(field, ["vol"]).collect():
        assert (r.e3, r.e2, r.e1) == pytest.approx(tuple(e[r.z, r.y, r.x]), abs=1e-6)


def test_search_generates_scores_and_suppresses(spark):
    field = slab(spark).cache()
    support = volume(spark, (12, 12, 12), (F.col("x") >= 4).cast("double"))
    found = search.generate(field, 0.6, 50, sigma=0.8, support=support, minimum=1.0, border=3, extent=12)
    rows = found.collect()
    assert rows and all(r.p.x >= 4 and r.p.z == 6 for r in rows)
    ct = volume(spark, (12, 12, 12), (F.col("x") + F.col("y") + F.col("z")).cast("double"))
    scored = search.score(found, ct).cache()
    assert {r.status for r in scored.collect()} == {"scored"}
    assert ranking.remaining(found.select("candidate_id"), scored, "candidate_id", ("scored",)).count() == 0
    kept = ranking.suppress(scored, 50.0).collect()
    assert len(kept) == 1 and kept[0].score == max(r.score for r in scored.collect())


def test_suppression_looks_at_normals(spark):
    rows = [(0, (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), 2.0), (1, (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), 1.0), (2, (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), 1.5)]
    df = spark.createDataFrame(rows, "candidate_id long, p struct<x:double,y:double,z:double>, n struct<x:double,y:double,z:double>, score double")
    assert sorted(r.candidate_id for r in ranking.suppress(df, 4.0).collect()) == [0, 2]
    assert [r.candidate_id for r in ranking.suppress(df, 4.0, limit=1).collect()] == [0]


def test_suppression_equals_the_sequential_pass(spark):
    rng = np.random.default_rng(0)
    pts = [(i, tuple(map(float, rng.uniform(0, 12, 3))), tuple(map(float, rng.normal(size=3))), float(rng.integers(0, 20))) for i in range(200)]
    df = spark.createDataFrame(pts, "candidate_id long, p struct<x:double,y:double,z:double>, n struct<x:double,y:double,z:double>, score double")
    kept = []
    for i, p, n, _ in sorted(pts, key=lambda r: (-r[3], r[0])):
        unit = np.array(n) / np.linalg.norm(n)
        if not any(math.dist(p, q) < 3 and abs(unit @ m) >= 0.5 for q, m in kept):
            kept.append((p, unit))
    for parts in (1, 7):
        got = ranking.suppress(df.repartition(parts), 3.0, 0.5).collect()
        assert {tuple(r.p) for r in got} == {p for p, _ in kept}


def test_components_shortest_paths_and_holes(spark):
    cells = spark.createDataFrame([(0, r, c) for r in range(9) for c in range(9) if (r in (2, 6) and 2 <= c <= 6) or (c in (2, 6) and 2 <= r <= 6) or (r, c) == (0, 0)], "tile int, r int, c int")
    labels = G.label_cells(cells, ["tile"], ["r", "c"], 2).collect()
    assert len({r.label for r in labels}) == 2
    assert G.largest(G.label_cells(cells, ["tile"], ["r", "c"], 2), ["tile"]).count() == 16
    field = spark.range(81).select(F.lit(0).alias("tile"), F.floor(F.col("id") / 9).cast("int").alias("r"), (F.col("id") % 9).cast("int").alias("c"))
    field = field.join(cells.withColumn("m", F.lit(True)), ["tile", "r", "c"], "left").withColumn("m", F.coalesce("m", F.lit(False)))
    assert G.fill_holes(field, ["tile"], ["r", "c"], "m").where("m").count() == 26
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (3, 4, 1.0)], "a long, b long, w double")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.distance for r in G.shortest_paths(start, edges).collect()} == {0: 0.0, 1: 1.0, 2: 2.0}


def test_npy_zarr_metadata_and_manifest(spark, tmp_path):
    a = np.arange(60, dtype=np.uint8).reshape(3, 4, 5)
    np.save(tmp_path / "a.npy", a)
    rows = files.read_npy(spark, str(tmp_path), slab=2).collect()
    assert len(rows) == 60 and all(r.v == a[r.z, r.y, r.x] for r in rows)
    z = tmp_path / "store"
    z.mkdir()
    (z / ".zattrs").write_text('{"multiscales":[{"datasets":[{"path":"0","coordinateTransformations":[{"type":"scale","scale":[1,1,1]}]},{"path":"1","coordinateTransformations":[{"type":"translation","translation":[4,2,2]},{"type":"scale","scale":[2,2,2]}]}]}]}')
    got = files.read_ome_levels(spark, str(z)).collect()
    assert [tuple(r) for r in got] == [(0, "0", [1.0, 1.0, 1.0], [0.0, 0.0, 0.0]), (1, "1", [2.0, 2.0, 2.0], [2.0, 1.0, 1.0])]
    folder = str(tmp_path / "manifest")
    for n in (3, 5):
        files.save_manifest(spark.range(n).withColumn("error", F.lit(None).cast("string")), folder)
    assert files.load_manifest(spark, folder).count() == 5
    doubled = files.normalized(volume(spark, (2, 2, 2), F.lit(4.0)))
    assert {r.v for r in doubled.collect()} == {1.0}


def test_suppression_by_parts_is_the_greedy_pass_and_makes_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 900
    p, d, score, vol = rng.normal(0, 3, (n, 3)), rng.normal(0, 1, (n, 3)), np.round(rng.normal(0, 1, n), 1), rng.integers(0, 2, n)
    unit = d / np.linalg.norm(d, axis=1, keepdims=True)
    kept = []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        if not any(vol[i] == vol[k] and np.linalg.norm(p[i] - p[k]) < 4 and abs(unit[i] @ unit[k]) >= 0.8 for k in kept):
            kept.append(i)
    xyz = "struct<x: double, y: double, z: double>"
    rows = [(i, int(vol[i]), tuple(map(float, p[i])), tuple(map(float, d[i])), float(score[i])) for i in range(n)]
    df = spark.createDataFrame(rows, f"candidate_id long, vol int, p {xyz}, n {xyz}, score double")
    made, greedy = [], ranking.greedy_rounds

    def counted(nodes, pairs):
        made.append(pairs.count())
        return greedy(nodes, pairs)

    monkeypatch.setattr(ranking, "greedy_rounds", counted)
    assert sorted(r.candidate_id for r in ranking.suppress(df, 4.0, within="vol", first=40).collect()) == sorted(kept)
    assert len(made) >= 2 and sum(made) * 10 < ranking.conflicts(df, 4.0, 0.8, within="vol").count()
