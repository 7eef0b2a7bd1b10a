import numpy as np
from pyspark.sql import functions as F

from surfacelab.operators import isosurface, metrics, tracker
from surfacelab.operators import trajectory as T
from surfacelab.plans import unwrap
from tests.test_fields import volume


def test_isosurface_of_a_ball_is_a_sphere(spark):
    c = [F.pow(F.col(k) - 4.0, 2) for k in "zyx"]
    field = volume(spark, (9, 9, 9), 3.1 - F.sqrt(c[0] + c[1] + c[2]))
    faces = isosurface.triangles(field, 0.0, 9)
    r = isosurface.closed(faces).first()
    assert r.open_edges == 0 and r.most == 2 and r.vertices - r.edges + r.faces == 2
    away = [np.linalg.norm(np.array([q.p.x, q.p.y, q.p.z]) - 4) for q in isosurface.mesh(faces)[0].collect()]
    assert max(abs(a - 3.1) for a in away) < 0.2
    banded = isosurface.triangles(field.where("z <= 4").unionByName(field.where("z > 4")).repartition(5), 0.0, 9)
    assert banded.count() == faces.count()


def test_unwrap_fills_a_hole(spark):
    bend = 5 + 0.8 * F.sin(F.col("x") / 4)
    sheet = F.exp(-0.5 * F.pow(F.col("z") - bend, 2))
    hole = F.col("y").between(5, 6) & F.col("x").between(5, 6)
    field = volume(spark, (10, 12, 12), F.when(hole, 0.0).otherwise(F.floor(255 * sheet) / 255)).cache()
    grid = unwrap.unwrap(field, 0.8, iterations=3, passes=1).cache()
    m = unwrap.quality(grid).first()
    cells = grid.where("valid").collect()
    assert m.coverage == 1 and m.jump_fraction < 0.05 and m.folded_fraction == 0 and m.adherence > 0.9
    filled = [r for r in cells if not r.anchor]
    assert filled and len(filled) < len(cells)
    assert all(abs(r.p.z - (5 + 0.8 * np.sin(r.p.x / 4))) < 1 for r in filled)


def test_winners_have_one_status_each(spark):
    field = volume(spark, (10, 12, 12), F.exp(-0.5 * F.pow(F.col("z") - 5.1, 2)))
    winners = spark.createDataFrame([(1, 0, (5.0, 5.0, 5.0)), (2, 0, (60.0, 5.0, 5.0))], "candidate_id long, vol long, p struct<x:double,y:double,z:double>")
    got = {r.candidate_id: r for r in unwrap.unwrap_winners(winners, field, 3, 0.8, iterations=1, passes=1).collect()}
    assert got[1].status in ("unwrapped", "gated") and got[1].cells > 20 and got[1].error is None
    assert got[2].status == "failed" and got[2].error


def test_gru_step_equals_plain_loops():
    w = tracker.plain_weights(3, 4)
    obs, state = np.arange(13) / 10, np.arange(8).reshape(2, 4) / 10
    delta, confidence, logvar, new = tracker.gru_step(w, obs, state)
    sig = lambda v: 1 / (1 + np.exp(-v))
    x = np.array([sum(obs[i] * w["in_w"][i, k] for i in range(13)) + w["in_b"][k] for k in range(4)])
    x = np.array([v * sig(v) for v in x])
    x = (x - x.mean()) / np.sqrt(((x - x.mean()) ** 2).mean() + 1e-5) * w["ln_g"] + w["ln_b"]
    for layer in (0, 1):
        out = []
        for k in range(4):
            a = [sum(x[i] * w[f"w{layer}"][i, k + 4 * g] for i in range(4)) + w[f"bw{layer}"][k + 4 * g] for g in range(3)]
            b = [sum(state[layer][i] * w[f"u{layer}"][i, k + 4 * g] for i in range(4)) + w[f"bu{layer}"][k + 4 * g] for g in range(3)]
            r, z = sig(a[0] + b[0]), sig(a[1] + b[1])
            out.append((1 - z) * np.tanh(a[2] + r * b[2]) + z * state[layer][k])
        x = np.array(out)
        assert np.allclose(new[layer], x)
    assert np.allclose(delta, x @ w["delta"]) and 0 < confidence < 1 and (logvar >= -6).all() and (logvar <= 4).all()


def test_predictions_and_tiles(spark):
    obs = spark.range(6).select(F.lit(1).cast("long").alias("traj"), F.col("id").cast("int").alias("step"), F.array(*[F.col("id") / 10.0 + i for i in range(13)]).alias("obs"))
    got = tracker.predict(obs, tracker.plain_weights(1, 8)).collect()
    assert [r.step for r in sorted(got, key=lambda r: r.step)] == list(range(6)) and all(0 < r.confidence < 1 for r in got)
    pixels = spark.range(2 * 6 * 6).select(F.lit(0).alias("t"), (F.col("id") % 2).cast("int").alias("k"), (F.floor(F.col("id") / 12)).cast("int").alias("row"), (F.floor(F.col("id") / 2) % 6).cast("int").alias("col"), F.col("id").cast("double").alias("v"))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    rows = tracker.infer_tiles(pixels, ["t"], 4, 2, lambda s: s[0], clip=1000.0, divisor=10.0).collect()
    assert len(rows) == 36 and all(abs(r.v - sigmoid(2 * (6 * r.row + r.col) / 10)) < 1e-9 for r in rows) and max(r.n for r in rows) == 4
    turned = tracker.infer_tiles(pixels, ["t"], 4, 2, lambda s: s[0], clip=1000.0, divisor=10.0, reverse_depth=True).collect()
    assert all(abs(r.v - sigmoid((2 * (6 * r.row + r.col) + 1) / 10)) < 1e-9 for r in turned)
    # Tiles of 4 at a stride of 3 leave no partial tile: the last row and column are 0, or an aligned tile covers them.
    part = {(r.row, r.col): r.n for r in tracker.infer_tiles(pixels.where("row < 6 AND col < 5"), ["t"], 4, 3, lambda s: s[0]).collect()}
    assert all((n == 0) == (r > 3 or c > 3) for (r, c), n in part.items())
    whole = {(r.row, r.col): r.n for r in tracker.infer_tiles(pixels.where("row < 6 AND col < 5"), ["t"], 4, 3, lambda s: s[0], align=True).collect()}
    assert all(n > 0 for n in whole.values()) and whole[5, 4] == 1
    assert np.allclose(tracker.upsampled(np.array([[0.0, 1.0], [2.0, 3.0]]), 4)[0], [0, 0.25, 0.75, 1.0])


SEED = "vol long, seed long, p struct<x:double,y:double,z:double>, t struct<x:double,y:double,z:double>"


def plane(spark, shape=(8, 10, 10)):
    return volume(spark, shape, F.exp(-0.5 * F.pow(F.col("z") - 4.1, 2)))


def test_trace_follows_a_plane_from_many_seeds(spark):
    seeds = spark.createDataFrame([(0, k, (1.0, 2.0 + k, 4.2), (1.0, 0.0, 0.3)) for k in range(3)], SEED)
    rows = T.trace(plane(spark), seeds, 5, 1.5, 0.2, 1.0, 9).collect()
    assert {(r.seed, r.step) for r in rows} == {(k, i) for k in range(3) for i in range(5)}
    later = [r for r in rows if r.step]
    assert all(abs(r.p.z - 4) < 0.3 and r.probability > 0.9 and abs(r.p.y - 2 - r.seed) < 0.1 for r in later)
    assert all(abs(r.t.x) > 0.95 for r in later)
    assert T.trace(plane(spark), seeds.where("seed < 0"), 3).count() == 0


def test_generated_trajectories_are_the_same_for_a_seed(spark):
    one, two = (sorted((r.seed, r.step, round(r.p.x, 6)) for r in T.generate(plane(spark), 2, 9, 0.9, 5, step=0.3, radius=1.0, samples=5).collect()) for _ in range(2))
    assert one == two and 1 <= len({k for k, _, _ in one}) <= 2
    assert all(sum(j == k for j, _, _ in one) >= 8 for k, _, _ in one)


def test_free_runs_and_surface_rollout(spark):
    w = tracker.plain_weights(5, 6)
    w["delta"] = w["delta"] * 0.0  # Every step falls back to the tangent.
    seeds = spark.createDataFrame([(0, 7, (4.0, 4.0, 4.0), (1.0, 0.0, 0.0))], SEED)
    field = T.Field(plane(spark))
    run = sorted(tracker.trace_model(field, seeds, w, 3).collect(), key=lambda r: r.step)
    assert [round(r.p.x, 3) for r in run] == [4.0, 5.5, 7.0] and all(abs(r.p.z - 4) < 0.4 and r.valid and 0 < r.confidence < 1 for r in run)
    back = sorted(tracker.trace_model(field, seeds, w, 3, reverse=True).collect(), key=lambda r: r.step)
    assert [round(r.p.x, 3) for r in back] == [4.0, 2.5, 1.0]
    grid = tracker.rollout_surface(field, seeds, w, 3, 3).collect()
    at = {(r.r, r.c): r for r in grid}
    assert set(at) == {(i, j) for i in range(3) for j in range(3)} and all(abs(r.p.z - 4) < 0.5 for r in grid)
    assert abs(at[1, 2].p.x - at[1, 0].p.x) > 2.5 and abs(at[2, 1].p.y - at[0, 1].p.y) > 2.5


def test_bands_give_the_vertices_of_the_whole(spark):
    c = [F.pow(F.col(k) - 8.0, 2) for k in "zyx"]
    field = volume(spark, (17, 17, 17), 6.2 - F.sqrt(c[0] + c[1] + c[2])).cache()
    banded = isosurface.banded_vertices(field, 0.0, 2, 3, 1, 9).collect()
    thin = field.where("z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0").select("vol", *[F.floor(F.col(k) / 2).cast("int").alias(k) for k in "zyx"], "v")
    whole = isosurface.mesh(isosurface.triangles(thin, 0.0, 9))[0].collect()
    assert sorted((round(r.p.x, 6), round(r.p.y, 6), round(r.p.z, 6)) for r in banded) == sorted((round(2 * r.p.x, 6), round(2 * r.p.y, 6), round(2 * r.p.z, 6)) for r in whole)
    assert all(r.value is not None for r in banded)
