import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surfacelab.functions.vec import vec
from surfacelab.operators import raster, ridge
from surfacelab.operators.sampling import depth_stack
from surfacelab.streaming.commits import Parts, render_layers, until_enough

P = "struct<x: double, y: double, z: double>"


def surface(spark):
    rows = [(0, r, c, (float(c), float(r), 4.0), (0.0, 0.0, 1.0), (r, c) != (0, 0)) for r in range(3) for c in range(4)]
    return spark.createDataFrame(rows, f"vol long, r int, c int, p {P}, n {P}, valid boolean")


def volume(spark):
    return spark.range(9 * 4 * 5).select(F.lit(0).cast("long").alias("vol"), F.floor(F.col("id") / 20).cast("int").alias("z"), (F.floor(F.col("id") / 5) % 4).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("x"), F.col("id").cast("double").alias("v"))


def test_a_killed_rendering_goes_on_and_equals_one_run(spark, tmp_path):
    offsets = [float(k) for k in range(-3, 4)]
    asked = []

    def layers(some):
        asked.append(list(some))
        if stop and len(asked) > 1:
            # The batch dies while it is written.
            return depth_stack(surface(spark), volume(spark), some, ["vol", "r", "c"]).select("r", "c", "k", F.when(F.col("k") == 1, F.raise_error(F.lit("gone")).cast("double")).otherwise(F.col("sample")).alias("v"))
        return depth_stack(surface(spark), volume(spark), some, ["vol", "r", "c"]).select("r", "c", "k", F.col("sample").alias("v"))

    stop = True
    with pytest.raises(Exception, match="gone"):
        render_layers(layers, offsets, spark, f"{tmp_path}/a", 3)
    assert Parts(spark, f"{tmp_path}/a").done() == [0, 1, 2]
    stop, asked = False, []
    got = {(r.k, r.r, r.c): r.v for r in render_layers(layers, offsets, spark, f"{tmp_path}/a", 3).collect()}
    # What was committed is only asked for its columns, not rendered again.
    assert [-3.0, -2.0, -1.0] not in asked and offsets[3:6] in asked
    whole = {(r.k, r.r, r.c): r.v for r in render_layers(layers, offsets, spark, f"{tmp_path}/b", 3).collect()}
    assert got == whole and len(got) == 7 * 12 and got[3, 1, 2] == 4 * 20 + 5 + 2 and got[3, 0, 0] == 0
    before = Parts(spark, f"{tmp_path}/b").done()
    assert render_layers(layers, offsets, spark, f"{tmp_path}/b", 3).count() == 84 and Parts(spark, f"{tmp_path}/b").done() == before
    assert render_layers(layers, [], spark, f"{tmp_path}/c") is None


def test_rounds_stop_at_enough_and_attempt_what_one_by_one_would(spark, tmp_path):
    good = {2, 3, 5, 8, 9, 12, 13}
    ranked = spark.createDataFrame([(100 + k, k) for k in range(20)], "candidate_id long, rank int")
    seen = []

    def attempt(batch):
        rows = [r.rank for r in batch.collect()]
        seen.extend(rows)
        if limit is not None and len(seen) > limit:
            raise RuntimeError("stopped")
        return spark.createDataFrame([(100 + k, "complete" if k in good else "failed") for k in rows], "candidate_id long, status string")

    limit = 7
    with pytest.raises(RuntimeError):
        until_enough(ranked, attempt, spark, f"{tmp_path}/r", 5)
    assert seen == [0, 1, 2, 3, 4, 5, 6, 7]
    limit, seen = None, []
    got = {r.candidate_id: r.status for r in until_enough(ranked, attempt, spark, f"{tmp_path}/r", 5).collect()}
    # Five successes are 2, 3, 5, 8 and 9: nothing after 9 is read, and what was committed isn't attempted again.
    assert set(got) == {100 + k for k in range(10)} and seen[0] == 5 and max(seen) == 9
    seen = []
    assert until_enough(ranked, attempt, spark, f"{tmp_path}/r", 5).count() == 10 and seen == []
    few = until_enough(ranked, attempt, spark, f"{tmp_path}/all", 99)
    assert few.count() == 20 and sorted(seen) == list(range(20))


def test_an_atlas_is_read_back_and_windows_prune_chunks(spark, tmp_path):
    rng = np.random.default_rng(0)
    sizes = {k: (int(h), int(w)) for k, (h, w) in enumerate(rng.integers(100, 400, (5, 2)))}
    rows = [(0, k, int(r), int(c), (float(k), float(r), float(c)), (0.0, 0.0, 1.0)) for k, (h, w) in sizes.items() for r, c in zip(rng.integers(0, h, 40), rng.integers(0, w, 40))]
    pixels = spark.createDataFrame(list(set(rows)), f"sheet long, chart long, row int, col int, p {P}, normal {P}")
    places = raster.atlas(spark.createDataFrame([(0, k, h, w) for k, (h, w) in sizes.items()], "sheet long, chart long, h int, w int"))
    packed = raster.packed(pixels, places)
    raster.write_atlas(packed, f"{tmp_path}/atlas")
    key = lambda r: (r.row, r.col, r.chart, *r.p, *r.normal)
    want = {key(r) for r in packed.collect()}
    assert {key(r) for r in raster.read_atlas(spark, f"{tmp_path}/atlas").collect()} == want and min(k[0] for k in want) >= 32
    window = (100, 300, 50, 280)
    part = raster.read_atlas(spark, f"{tmp_path}/atlas", window)
    assert {key(r) for r in part.collect()} == {k for k in want if 100 <= k[0] < 300 and 50 <= k[1] < 280}
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = raster.read_atlas(spark, f"{tmp_path}/atlas", window)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(cy,0)" in plan and "LessThanOrEqual(cx,1)" in plan


def test_frames_of_a_plane(spark):
    flat = spark.range(20**3).select(F.lit(3).cast("long").alias("vol"), F.floor(F.col("id") / 400).cast("int").alias("z"), (F.floor(F.col("id") / 20) % 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"))
    plane = flat.withColumn("v", F.when(F.abs(F.col("z") - 0.5 * F.col("x") - 5) < 0.6, 0.9).otherwise(0.1))
    seeds = spark.createDataFrame([(3, 1, (10.0, 9.0, 10.0)), (3, 2, (10.0, 9.0, 0.0)), (7, 1, (1.0, 1.0, 1.0))], f"vol long, seed int, p {P}")
    got = {(r.vol, r.seed): r for r in ridge.estimate_frame(plane, seeds, 5).collect()}
    n = np.array(got[3, 1].normal)
    assert got[3, 1].error is None and got[3, 1].n >= 12 and abs(abs(n @ [-0.5, 0, 1]) / np.sqrt(1.25) - 1) < 0.02
    u, v = np.array(got[3, 1].u), np.array(got[3, 1].v)
    assert max(abs(n @ u), abs(n @ v), abs(u @ v)) < 1e-6 and abs(np.linalg.norm(v) - 1) < 1e-6
    # Around the second seed all is dim, and volume 7 doesn't exist.
    assert got[3, 2].normal is None and got[3, 2].error and got[7, 1].n is None and got[7, 1].error


def test_a_frame_whose_normal_has_no_first_part_is_turned_by_the_next(spark):
    # Mirrored in x, so the normal's x is zero; sums in any order leave some 1e-17 of it, whose sign is chance.
    cells = [(z, y, x) for z in range(8) for y in range(8) for x in range(8) if abs(x - 4) + abs(y - 4) <= 3 and z == 4 + (y - 4) // 2]
    seeds = spark.createDataFrame([(1, 0)], "vol long, seed int").select("vol", "seed", vec(F.lit(4), F.lit(4), F.lit(4)).alias("p"))
    for way in (1, -1):
        v = F.struct(*[F.lit(float(k)).alias(n) for n, k in zip("xyz", (way * 1e-17, -0.6, 0.8))])
        turned = spark.range(1).select(v.alias("n")).select(ridge._first_positive("n").alias("n")).first().n
        assert abs(turned.y - 0.6) < 1e-12 and abs(turned.z + 0.8) < 1e-12
    for order in (cells, cells[::-1], cells[::2] + cells[1::2]):
        volume = spark.createDataFrame([(1, *c, 1.0) for c in order], "vol long, z int, y int, x int, v double").coalesce(1)
        n = ridge.estimate_frame(volume, seeds, 3).first().normal
        assert abs(n.x) < 1e-9 and n.y > 0


def test_a_task_holds_one_chunk_of_an_atlas(spark):
    # Nine chunks of two sheets in batches of seven cells: a batch out is a chunk, wherever the batches in end.
    cells = sorted((s, cy, cx, at) for s in (3, 5) for cy in range(3) for cx in range(3) for at in (0, 9, 700, 65535) if (s, cy) != (5, 2) and (s + cy + cx + at) % 3)
    columns = list(zip(*[(s, cy, cx, at, 10 * s + cx, at, cy, cx, 0, 0, 1) for s, cy, cx, at in cells]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 6]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f"c{i}" for i in range(11)])
    got = list(raster.chunk_bytes(iter([whole.slice(0, 0), *(whole.slice(k, 7) for k in range(0, len(cells), 7))])))
    assert len(got) == len({c[:3] for c in cells}) and all(b.num_rows <= 3 for b in got)
    seen = set()
    for s, cy, cx, line, chart, p, normal in (r for b in got for r in zip(*(c.to_pylist() for c in b.columns))):
        chart, p, normal = np.frombuffer(chart, "<i8"), np.frombuffer(p, "<f4").reshape(-1, 3), np.frombuffer(normal, "<f4").reshape(-1, 3)
        assert len(chart) == raster.CHUNK
        for k in np.nonzero(chart >= 0)[0]:
            at = line * raster.CHUNK + int(k)
            assert chart[k] == 10 * s + cx and p[k].tolist() == [at, cy, cx] and normal[k].tolist() == [0, 0, 1]
            seen.add((s, cy, cx, at))
        assert np.isnan(p[chart < 0]).all()
    assert seen == set(cells)
