import numpy as np
from pyspark.sql import functions as F

from surfacelab.operators import tracker

W = tracker.plain_weights(3, 8)


def unit(v):
    return v / max(np.linalg.norm(v), 1e-6)


def test_states_go_over_from_batch_to_batch(spark):
    rng = np.random.default_rng(1)
    sizes = {k: int(rng.integers(1, 12)) for k in range(9)} | {20: 40}
    obs = {(k, s): rng.normal(size=13) for k, n in sizes.items() for s in range(n)}
    df = spark.createDataFrame([(k, s, [float(x) for x in o]) for (k, s), o in obs.items()], "traj long, step int, obs array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {(r.traj, r.step): r for r in tracker.predict(df, W).collect()}
        short = tracker.predict(df, W, 4).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(obs) and short == sum(min(4, n) for n in sizes.values())
    for k, n in sizes.items():
        state = np.zeros((2, 8))
        for s in range(n):
            delta, c, logvar, state = tracker.gru_step(W, obs[k, s], state)
            r = got[k, s]
            assert np.allclose([r.dx, r.dy, r.dz], delta) and np.allclose([r.lx, r.ly, r.lz], logvar)
            assert np.isclose(r.confidence, c / (1 + np.sqrt(np.exp(logvar).mean()))) and np.isclose(1 / (1 + np.exp(-r.logit)), c)
    assert tracker.predict(df.limit(0), W).count() == 0


def test_gap_errors_equal_plain_loops(spark):
    rng = np.random.default_rng(5)
    start, length = 5, 4
    paths = {k: (np.cumsum(rng.normal(size=(n, 3)), 0), rng.random(n), unit(rng.normal(size=3))) for k, n in ((1, 10), (2, 14), (3, 9), (4, 12))}
    rows = [(k, s, tuple(map(float, p[s])), tuple(map(float, n)), float(q[s])) for k, (p, q, n) in paths.items() for s in range(len(p))]
    p3 = "struct<x: double, y: double, z: double>"
    df = spark.createDataFrame(rows, f"traj long, step int, p {p3}, normal {p3}, probability double")
    got = {r.traj: r for r in tracker.gap_benchmark(df, W, start, length).collect()}
    assert set(got) == {1, 2, 4}
    for k in got:
        truth, seen, normal = paths[k]
        state, previous = np.zeros((2, 8)), truth[1] - truth[0]
        for s in range(start):
            previous = truth[s] - truth[s - 1] if s else previous
            state = tracker.gru_step(W, np.r_[previous, unit(previous), normal, seen[s], 0, 0, 1], state)[3]
        point, away = truth[start].copy(), []
        for s in range(length):
            t = unit(previous)
            local, _, _, state = tracker.gru_step(W, np.r_[previous, t, normal, 0, 0, 1, 1], state)
            delta = t * local[0] + unit(np.cross(normal, t)) * local[1] + normal * local[2]
            delta = -delta if delta @ t < 0 else delta
            previous = unit(delta) * min(1.5, max(0.5, np.linalg.norm(delta)))
            point = point + previous
            away.append(np.linalg.norm(point - truth[start + 1 + s]))
        line = [np.linalg.norm(truth[start] + (s + 1) * (truth[start] - truth[start - 1]) - truth[start + 1 + s]) for s in range(length)]
        r = got[k]
        assert np.allclose([r.model_mean, r.model_end, r.straight_mean, r.straight_end], [np.mean(away), away[-1], np.mean(line), line[-1]])


def test_loss_equals_its_terms(spark):
    rng = np.random.default_rng(2)
    n = 30
    target, d, logvar = rng.normal(size=(n, 3)) * 2, rng.normal(size=(n, 3)), rng.uniform(-1, 1, (n, 3))
    mask, seen, logit = rng.integers(0, 2, n), rng.uniform(-0.5, 1.5, n), rng.normal(size=n) * 4
    p3 = "struct<x: double, y: double, z: double>"
    batch = spark.createDataFrame([(1, k, tuple(map(float, target[k])), int(mask[k]), float(seen[k])) for k in range(n)], f"traj long, step int, target {p3}, mask int, confidence double")
    told = spark.createDataFrame([(1, k, *map(float, d[k]), 0.0, float(logit[k]), *map(float, logvar[k])) for k in range(n)], "traj long, step int, dx double, dy double, dz double, confidence double, logit double, lx double, ly double, lz double")
    r = tracker.training_loss(batch, told).first()
    far = np.abs(d - target)
    far = np.where(far < 1, far**2 / 2, far - 0.5) / np.exp(logvar)
    displacement = (far.mean(1) * mask).sum() / mask.sum()
    p, goal = 1 / (1 + np.exp(-logit)), np.clip(seen, 0, 1)
    entropy = -(goal * np.log(p) + (1 - goal) * np.log(1 - p)).mean()
    assert np.allclose(list(r), [displacement, entropy, logvar.mean(), displacement + 0.1 * entropy + 0.005 * logvar.mean()])


def test_generated_marches_are_long_enough(spark):
    from surfacelab.operators import trajectory as T

    cells = spark.range(8 * 8 * 8).select(F.lit(0).cast("long").alias("vol"), F.floor(F.col("id") / 64).cast("int").alias("z"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"))
    sheet = cells.withColumn("v", F.exp(-0.5 * F.pow((F.col("z") - 3.4) / 1.2, 2)))
    got = T.generate(sheet, 3, 8, 0.5, 7, step=0.5, radius=1.0, samples=5).groupBy("seed").count().collect()
    assert got and all(r["count"] >= 8 for r in got)


def test_blocks_sample_as_joins_of_corners_do_and_a_march_moves_no_voxels(spark):
    from surfacelab.functions.vec import normalize
    from surfacelab.operators import sampling, stencil
    from surfacelab.operators import trajectory as T

    cells = spark.range(9 * 9 * 9).select(F.lit(3).cast("long").alias("vol"), F.floor(F.col("id") / 81).cast("int").alias("z"), (F.floor(F.col("id") / 9) % 9).cast("int").alias("y"), (F.col("id") % 9).cast("int").alias("x"))
    v = F.when(F.col("z") * F.col("y") == 12, F.lit(None)).when(F.col("x") + F.col("y") == 15, float("nan")).otherwise(F.pmod(F.xxhash64("z", "y", "x"), F.lit(1000)) / 1000.0)
    volume = cells.withColumn("v", v).where("(z + 2 * y + 3 * x) % 11 <> 4").cache()
    rng = np.random.default_rng(5)
    rows = [(3, k, tuple(map(float, rng.uniform(-3, 12, 3)))) for k in range(60)] + [(3, 60, (float("nan"), 1.0, 1.0)), (3, 61, (4.0, 3.0, 2.0)), (4, 62, (1.0, 1.0, 1.0))]
    points = spark.createDataFrame(rows, "vol long, seed long, p struct<x:double,y:double,z:double>").withColumn("n", normalize(F.struct((F.col("seed") % 3 - 1.0).alias("x"), (F.col("seed") % 5 - 1.5).alias("y"), F.lit(1.0).alias("z")))).cache()
    keys, field = ["vol", "seed"], T.Field(volume, 1.0, 4)

    def told(df, *names):
        return {r.seed: [x for n in names for x in (r[n] if isinstance(r[n], tuple) else [r[n]])] for r in df.collect()}

    def same(a, b):
        return a.keys() == b.keys() and all(np.allclose(np.array(a[k], float), np.array(b[k], float), atol=1e-9, equal_nan=True) for k in a)

    slopes = stencil.gradient(volume, ["vol"], ["z", "y", "x"])
    extent = volume.groupBy("vol").agg(*[(F.max(k) + 1).alias("n" + k) for k in "zyx"])
    assert same(told(field.sample(points, keys), "probability"), told(sampling.sample(points, volume, keys, value="probability"), "probability"))
    assert same(told(field.normal(points, keys), "normal"), told(sampling.gradient_sample(points, slopes, extent, keys), "normal"))
    best = sampling.project(points, volume, keys, 1.0, 5)
    assert same(told(field.project(points, keys, 1.0, 5), "probability"), told(best, "sample"))
    plan = field.within(points.join(field.extent, "vol"))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
