"""Queries on stores, neighbours, orientations and runs of the tracker, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from surfacelab.functions import vec as V
from surfacelab.operators import isosurface, metrics, ranking, raster, ridge, scattered, tracker
from surfacelab.operators import mesh as M
from surfacelab.operators import parameterise as P
from surfacelab.operators.rounds import cut, new_path
from surfacelab.plans.meshes import LABELS, MESH, MESH_R, N_, parts
from surfacelab.plans.points import HESSIAN, r6, xyz
from surfacelab.plans.topology import centres
from surfacelab.plans.unwrap import unwrap_winners
from surfacelab.sources import chunks, zarr
from surfacelab.sources.derived import EDGE, SHEET, candidates, grids, sheets, tiles, voxels, with_sql


def q_zarr_box(spark, d):
    """The volumes on top of one another as one stored array, read back where y is 1 or 2 and x below 2."""
    v = voxels(spark, d).withColumn("z", (F.col("vol") * EDGE + F.col("z")).cast("int"))
    path, depth = new_path(spark, "store"), v.agg(F.max("z")).first()[0]
    zarr.write_zarr(v, path, ((depth or 0) + 1, EDGE, EDGE), (64, 2, 2))
    got = zarr.read_volume(spark, path, {"y": (1, 3), "x": (0, 2)}).where("v <> 0")
    return got.groupBy(F.floor(F.col("z") / EDGE).alias("vol")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v"), "total"))


def q_chunk_sample(spark, d):
    """Three places of each volume sampled from its chunk."""
    path = new_path(spark, "chunks")
    chunks.write_chunks(voxels(spark, d), path, EDGE)
    at = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), V.vec(F.lit(x), F.lit(y), F.lit(z)).alias("p")) for k, (x, y, z) in enumerate(((0.5, 1.25, 2.75), (1.5, 1.5, 1.5), (3.5, 0.25, 0.0)))]))
    points = candidates(spark, d).select(F.col("candidate_id").alias("vol"), at)
    got = chunks.sample_chunks(points, chunks.read_chunks(spark, path), EDGE, ["vol", "k"])
    return got.groupBy("vol").agg(*[r6(F.max(F.when(F.col("k") == k, F.col("sample"))), f"s{k}") for k in range(3)])


def q_nearest(spark, d):
    """The nearest candidate of a score that isn't negative, among those of the same label."""
    rows = candidates(spark, d)
    sites = rows.where("score >= 0").select("label", F.col("candidate_id").alias("site"), F.col("p").alias("q"))
    got = scattered.nearest(rows.select("label", F.col("candidate_id").alias("id"), "p"), sites, "label", 2.0)
    return got.select(F.col("id").alias("candidate_id"), "site", r6("distance", "distance"))


def q_scattered(spark, d):
    """The height grids with their holes filled."""
    g = grids(spark, d).select("grid", "r", "c", "p", F.col("valid").alias("known"), F.lit(True).alias("wanted"))
    return scattered.fill_linear(g, "grid").select("grid", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *xyz("p", ["x", "y", "z"]))


def q_dim_faces(spark, d):
    v, f = parts(spark, d)
    return M.prune_dim_faces(f, v.withColumn("probability", F.col("p.z")), 0.0)


def q_reindexed(spark, d):
    f, v = P.reindexed(*reversed(parts(spark, d)))
    return f.select("mesh", "fid", *[F.col(k).cast("long").alias(k) for k in "abc"])


def q_orient(spark, d):
    """Faces of which every third one is turned the wrong way, turned back."""
    f = parts(spark, d)[1]
    wrong = F.col("fid") % 3 == 0
    return P.orient(f.select("mesh", "fid", "a", F.when(wrong, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(wrong, F.col("b")).otherwise(F.col("c")).alias("c")), "mesh")


def q_fill_loops(spark, d):
    """Euler numbers of each grid's largest component before and after its small holes are filled."""
    v, f = parts(spark, d)
    own = cut(P.orient(P.largest_component(f, "mesh"), "mesh"), "mesh")
    whole, _ = P.fill_loops(own, v, key="mesh")
    before, after = (M.topology(x).select("mesh", F.col("euler").alias(n), F.col("faces").alias("faces_" + n)) for x, n in ((own, "before"), (cut(whole, "mesh"), "after")))
    return before.join(after, "mesh")


def q_bands(spark, d):
    """The isosurface's vertices of each sheet, marched in bands of four layers."""
    got = isosurface.banded_vertices(sheets(spark, d), 0.5, 1, 4, 2, SHEET)
    return got.groupBy("vol").agg(F.count(F.lit(1)).alias("n"), *[r6(F.sum(F.col("p")[k]), "s" + k) for k in "xyz"])


def q_sheet_normals(spark, d):
    got = metrics.sheet_normals(grids(spark, d))
    return got.select("grid", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *xyz("normal", ["nx", "ny", "nz"]))


def _middle(spark, d):
    volume = sheets(spark, d)
    return volume, centres(volume).select("vol", F.lit(0).cast("long").alias("seed"), F.col("seed").alias("p"), V.vec(F.lit(1), F.lit(0), F.lit(0)).alias("t"))


def q_trace_model(spark, d):
    """Free runs of a plain tracker of three steps from the middle of each sheet."""
    volume, seeds = _middle(spark, d)
    got = tracker.trace_model(volume, seeds, tracker.plain_weights(7, 16), 3)
    return got.select("vol", F.col("step").cast("long").alias("step"), *xyz("p", ["x", "y", "z"]), r6("confidence", "confidence"), "valid")


def q_rollout(spark, d):
    """Surfaces of three by three cells rolled out from the middle of each sheet."""
    volume, seeds = _middle(spark, d)
    got = tracker.rollout_surface(volume, seeds, tracker.plain_weights(7, 16), 3, 3)
    return got.groupBy("grid.vol").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"), *[r6(F.sum(F.col("p")[k]), "s" + k) for k in "xyz"])


def q_estimate_frame(spark, d):
    """Normals of the bright voxels around the middle of each sheet."""
    volume = sheets(spark, d)
    seeds = centres(volume).select("vol", F.lit(0).alias("seed"), F.col("seed").alias("p"))
    got = ridge.estimate_frame(volume, seeds, 3)
    return got.select("vol", "n", "error", *[(F.round(F.col("normal")[k], 5) + 0.0).alias("n" + k) for k in "xyz"])


def q_final_score(spark, d):
    """First-phase and final scores of each tile, its own pixels taken for the surface and (over 255) for ink."""
    t = tiles(spark, d)
    rows = metrics.texture(t, ["tile"]).join(metrics.ink(t.withColumn("v", F.col("v") / 255), ["tile"]), "tile")
    rows = rows.withColumns({"surface_score": F.col("ct_nonzero") / 2, "fiber_coherence": F.col("ct_nonzero") / 3}).withColumn("combined_score", V.screening_score())
    return rows.select("tile", r6("combined_score", "combined_score"), r6(V.final_score(), "final_score"))


def q_rank_ids(spark, d):
    """Candidates numbered by falling score within their label."""
    return ranking.numbered(candidates(spark, d), ["label"]).select("candidate_id", F.col("number").cast("long").alias("number"))


def q_seed_layer(spark, d):
    """The bright voxels of each sheet within one voxel of the middle's depth."""
    volume = sheets(spark, d)
    points = volume.where("v > 0.5").select("vol", V.vec("x", "y", "z").alias("p"))
    near, told = ridge.seed_layer(points, centres(volume), 1.0, 48)
    sums = near.groupBy("vol").agg(*[r6(F.sum(F.col("p")[k]), "s" + k) for k in "xyz"])
    return told.join(sums, "vol", "left")


def q_ridge_gates(spark, d):
    """Gates of the grid meshes, of eight vertices at least, around the middle of their plane."""
    v, f = parts(spark, d)
    away = M.referenced(v, f).groupBy("mesh").agg(F.min(V.norm(V.sub("p", V.vec(F.lit(3.5), F.lit(3.5), F.lit(0))))).alias("seed_distance"))
    loops = M.boundary_loops(f, v).groupBy("mesh").agg(F.count(F.lit(1)).alias("loops"))
    rows = M.topology(f).select("mesh", "vertices", "euler").join(away, "mesh").join(loops, "mesh").join(M.continuity(f, v), "mesh")
    return metrics.ridge_gates(rows, 8).select("mesh", "vertices", "euler", "loops", *[r6(k, k) for k in ("seed_distance", "normal_p01", "edge_outliers")], "passed")


def q_refine(spark, d):
    """Flat grids moved to the sheets' brightest places."""
    flat = grids(spark, d).withColumn("p", V.vec("c", "r", F.lit(4.0)))
    got = M.refine(M.grid_faces(flat, SHEET), M.grid_vertices(flat, SHEET), sheets(spark, d))
    return got.select("mesh", "vid", *xyz("p", ["x", "y", "z"]), r6("value", "value"))


def q_packed_atlas(spark, d):
    """The valid cells of the height grids as charts of ten sheets, packed, stored in chunks and read back: pixels and sums of each chart."""
    g = grids(spark, d).where("valid").select((F.col("grid") % 10).alias("sheet"), F.col("grid").alias("chart"), F.col("r").alias("row"), F.col("c").alias("col"), "p")
    places = raster.atlas(g.select("sheet", "chart").distinct().select("sheet", "chart", F.lit(SHEET).alias("h"), F.lit(SHEET).alias("w")))
    path = new_path(spark, "atlas")
    raster.write_atlas(raster.packed(g.withColumn("normal", V.vec(F.lit(0), F.lit(0), F.lit(1))), places), path)
    got = raster.read_atlas(spark, path)
    return got.groupBy("sheet", "chart").agg(F.count(F.lit(1)).alias("n"), F.min("row").cast("long").alias("first_row"), F.min("col").cast("long").alias("first_col"), (F.round(F.sum("p.x"), 3) + 0.0).alias("sx"), (F.round(F.sum("p.y"), 3) + 0.0).alias("sy"))


def q_winners(spark, d):
    """The best candidate of each label, its crop unwrapped: quality and status."""
    best = candidates(spark, d).groupBy("label").agg(F.max_by("candidate_id", F.struct("score", "candidate_id")).alias("candidate_id"))
    winners = best.select("candidate_id", F.col("candidate_id").alias("vol"), V.vec(F.lit(4), F.lit(4), F.lit(4)).alias("p"))
    got = unwrap_winners(winners, sheets(spark, d), 3, 0.5, iterations=1, passes=1)
    return got.select("candidate_id", "status", "error", "cells", *[r6(k, k) for k in ("coverage", "adherence", "jump_fraction", "folded_fraction")])


#: Unit eigenvectors w (vol, n, nx, ny, nz) of the least values of the matrices ev: the longest cross product of two rows.
LEAST = """m AS (SELECT vol, v AS n, axx - e3 AS r00, axy AS r01, axz AS r02, ayy - e3 AS r11, ayz AS r12, azz - e3 AS r22 FROM ev),
k AS (SELECT *, r01 * r12 - r02 * r11 AS a_x, r02 * r01 - r00 * r12 AS a_y, r00 * r11 - r01 * r01 AS a_z, r01 * r22 - r02 * r12 AS b_x, r02 * r02 - r00 * r22 AS b_y, r00 * r12 - r01 * r02 AS b_z,
  r11 * r22 - r12 * r12 AS c_x, r12 * r02 - r01 * r22 AS c_y, r01 * r12 - r11 * r02 AS c_z FROM m),
l AS (SELECT *, sqrt(a_x * a_x + a_y * a_y + a_z * a_z) AS la, sqrt(b_x * b_x + b_y * b_y + b_z * b_z) AS lb, sqrt(c_x * c_x + c_y * c_y + c_z * c_z) AS lc FROM k),
w AS (SELECT vol, n, """ + ", ".join(f"CASE WHEN la >= lb AND la >= lc THEN a_{x} / la WHEN lb >= lc THEN b_{x} / lb ELSE c_{x} / lc END AS n{x}" for x in "xyz") + """ FROM l)"""
QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
SQL = {
    "q_zarr_box": with_sql("vox") + " SELECT vol, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM vox WHERE y IN (1, 2) AND x < 2 AND v <> 0 GROUP BY vol",
    "q_chunk_sample": with_sql("vox") + """, p(k, px, py, pz) AS (VALUES (0, 0.5::DOUBLE, 1.25::DOUBLE, 2.75::DOUBLE), (1, 1.5, 1.5, 1.5), (2, 3.5, 0.25, 0.0)),
s AS (SELECT vol, k, sum(v * greatest(0, 1 - abs(x - px)) * greatest(0, 1 - abs(y - py)) * greatest(0, 1 - abs(z - pz))) AS s FROM vox, p GROUP BY vol, k)
SELECT vol, """ + ", ".join(f"round(max(s) FILTER (k = {k}), 6) + 0.0 AS s{k}" for k in range(3)) + " FROM s GROUP BY vol",
    "q_nearest": with_sql("cand") + """, d AS (SELECT a.candidate_id, b.candidate_id AS site, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)) AS d FROM cand a JOIN cand b ON a.label = b.label WHERE b.score >= 0)
SELECT candidate_id, site, round(d, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY d, site) AS i FROM d) WHERE i = 1""",
    "q_dim_faces": MESH + " SELECT f.mesh, f.fid, f.a, f.b, f.c FROM f WHERE (SELECT min(pz) FROM v WHERE v.mesh = f.mesh AND v.vid IN (f.a, f.b, f.c)) >= 0",
    "q_reindexed": MESH + ", n AS (SELECT mesh, vid, row_number() OVER (PARTITION BY mesh ORDER BY vid) - 1 AS i FROM (SELECT DISTINCT mesh, unnest([a, b, c]) AS vid FROM f)) SELECT f.mesh, f.fid, x.i AS a, y.i AS b, z.i AS c FROM f JOIN n x ON x.mesh = f.mesh AND x.vid = f.a JOIN n y ON y.mesh = f.mesh AND y.vid = f.b JOIN n z ON z.mesh = f.mesh AND z.vid = f.c",
    "q_orient": MESH_R + ", " + LABELS + " SELECT f.mesh, f.fid, a, CASE WHEN label % 3 = 0 THEN c ELSE b END AS b, CASE WHEN label % 3 = 0 THEN b ELSE c END AS c FROM f JOIN lb ON lb.mesh = f.mesh AND lb.fid = f.fid",
    "q_estimate_frame": with_sql("sheet") + """, q AS (SELECT vol, greatest(0.35, max(v) * 0.55) AS lim FROM sheet WHERE z BETWEEN 1 AND 7 AND y BETWEEN 1 AND 7 AND x BETWEEN 1 AND 7 GROUP BY vol),
near AS (SELECT s.* FROM sheet s JOIN q ON q.vol = s.vol WHERE v > lim AND sqrt((z - 4) * (z - 4) + (y - 4) * (y - 4) + (x - 4) * (x - 4)) <= 3),
s AS (SELECT vol, 0 AS z, 0 AS y, 0 AS x, count(*) AS v, """ + ", ".join(f"covar_pop({a}, {b}) AS a{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + """, (axx + ayy + azz) / 3 AS q FROM near GROUP BY vol HAVING count(*) >= 12),
t AS""" + HESSIAN.split("t AS", 1)[1].replace("ev AS (SELECT vol, z, y, x, v,", "ev AS (SELECT *,") + ",\n" + LEAST + """
SELECT i.vol, n, CASE WHEN n IS NULL THEN 'not enough local surface support' END AS error, """ + ", ".join(f"round(n{x} * CASE WHEN nx <> 0 THEN sign(nx) WHEN ny <> 0 THEN sign(ny) ELSE sign(nz) END, 5) + 0.0 AS n{x}" for x in "xyz") + """
FROM (SELECT vec_id AS vol FROM embeddings) i LEFT JOIN w ON w.vol = i.vol""",
    "q_final_score": with_sql("tile") + """, m AS (SELECT tile, avg((v > 0)::INT::DOUBLE) AS nz, coalesce(stddev_pop(CASE WHEN v > 0 THEN v END), 0.0) AS sd, stddev_pop(v / 255) AS ik, avg(v / 255) AS mean, quantile_cont(v / 255, 0.99) AS p FROM tile GROUP BY tile),
c AS (SELECT *, 1.5 * (nz / 2) + 2 * nz + 0.02 * sd + 0.5 * (nz / 3) AS s FROM m) SELECT tile, round(s, 6) + 0.0 AS combined_score, round(s + 8 * ik + greatest(0, p - mean), 6) + 0.0 AS final_score FROM c""",
    "q_packed_atlas": with_sql("grid") + """, g AS (SELECT grid % 10 AS sheet, grid AS chart, r, c, px, py FROM grid WHERE valid),
k AS (SELECT sheet, chart, row_number() OVER (PARTITION BY sheet ORDER BY chart) - 1 AS k FROM (SELECT DISTINCT sheet, chart FROM g))
SELECT g.sheet, g.chart, count(*) AS n, min(r) + 32 + (any_value(k) // 3) * 40 AS first_row, min(c) + 32 + (any_value(k) % 3) * 40 AS first_col, round(sum(px), 3) + 0.0 AS sx, round(sum(py), 3) + 0.0 AS sy FROM g JOIN k ON k.chart = g.chart GROUP BY g.sheet, g.chart""",
    "q_rank_ids": with_sql("cand") + " SELECT candidate_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, candidate_id) - 1 AS number FROM cand",
    "q_seed_layer": with_sql("sheet") + """, pts AS (SELECT * FROM sheet WHERE v > 0.5),
s AS (SELECT vol, 0 AS z, 0 AS y, 0 AS x, count(*) AS v, """ + ", ".join(f"covar_pop({a}, {b}) AS a{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + """, (axx + ayy + azz) / 3 AS q FROM pts GROUP BY vol),
t AS""" + HESSIAN.split("t AS", 1)[1].replace("ev AS (SELECT vol, z, y, x, v,", "ev AS (SELECT *,") + ",\n" + LEAST + """,
near AS (SELECT p.* FROM pts p JOIN w ON w.vol = p.vol WHERE abs((p.x - 4) * nx + (p.y - 4) * ny + (p.z - 4) * nz) <= 1),
n AS (SELECT vol, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM near GROUP BY vol)
SELECT i.vol, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < 48 THEN 'the seed''s layer has only ' || coalesce(n, 0) || ' points' END AS error, """ + ", ".join(f"CASE WHEN n >= 48 THEN round(s{k}::DOUBLE, 6) END AS s{k}" for k in "xyz") + """
FROM (SELECT vec_id AS vol FROM embeddings) i LEFT JOIN n ON n.vol = i.vol""",
    "q_ridge_gates": MESH_R + ",\n" + N_ + """, vx AS (SELECT mesh, count(DISTINCT x) AS vertices, count(DISTINCT fid) AS faces FROM (SELECT mesh, fid, unnest([a, b, c]) AS x FROM f) GROUP BY mesh), ex AS (SELECT mesh, count(*) AS edges FROM ec GROUP BY mesh),
ag AS (SELECT s.mesh, quantile_cont(abs(n.x * o.x + n.y * o.y + n.z * o.z), 0.01) AS q FROM fe s JOIN fe t ON s.mesh = t.mesh AND s.lo = t.lo AND s.hi = t.hi AND s.fid < t.fid JOIN fnr n ON n.mesh = s.mesh AND n.fid = s.fid JOIN fnr o ON o.mesh = t.mesh AND o.fid = t.fid GROUP BY s.mesh),
lim AS (SELECT mesh, 2.5 * quantile_cont(w, 0.5) AS lim FROM el GROUP BY mesh), ou AS (SELECT el.mesh, avg((w > lim)::INT::DOUBLE) AS o FROM el JOIN lim ON el.mesh = lim.mesh GROUP BY el.mesh),
bb AS (SELECT mesh, lo AS s, hi AS t FROM ec WHERE n = 1 UNION ALL SELECT mesh, hi, lo FROM ec WHERE n = 1), r(mesh, s, m) AS (SELECT DISTINCT mesh, s, s FROM bb UNION SELECT r.mesh, r.s, bb.t FROM r JOIN bb ON bb.mesh = r.mesh AND bb.s = r.m),
lp AS (SELECT mesh, count(DISTINCT loop) AS loops FROM (SELECT mesh, s, min(m) AS loop FROM r GROUP BY mesh, s) GROUP BY mesh),
aw AS (SELECT v.mesh, min(sqrt((px - 3.5) * (px - 3.5) + (py - 3.5) * (py - 3.5) + pz * pz)) AS d FROM v JOIN (SELECT DISTINCT mesh, unnest([a, b, c]) AS vid FROM f) k ON k.mesh = v.mesh AND k.vid = v.vid GROUP BY v.mesh)
SELECT vx.mesh, vertices, vertices - edges + faces AS euler, loops, round(d, 6) + 0.0 AS seed_distance, round(q, 6) + 0.0 AS normal_p01, round(o, 6) + 0.0 AS edge_outliers,
  coalesce(d <= 5 AND q >= cos(radians(50)) AND o <= 0.01 AND loops = 1 AND vertices - edges + faces = 1 AND vertices >= 8, false) AS passed
FROM vx JOIN ex ON ex.mesh = vx.mesh JOIN aw ON aw.mesh = vx.mesh JOIN lp ON lp.mesh = vx.mesh JOIN ou ON ou.mesh = vx.mesh LEFT JOIN ag ON ag.mesh = vx.mesh""",
    "q_refine": MESH + ",\n" + with_sql("sheet").removeprefix("WITH ") + """, u AS (SELECT DISTINCT mesh, unnest([a, b, c]) AS vid FROM f), o AS (SELECT mesh, vid, k, 4 + (-4 + k * 0.5::DOUBLE) AS z FROM u, range(17) s(k)),
s AS (SELECT o.mesh, o.vid, k, o.z, round(sum(CASE WHEN t.z = floor(o.z) THEN (1 - (o.z - floor(o.z))) * t.v ELSE (o.z - floor(o.z)) * t.v END), 9) AS r, sum(CASE WHEN t.z = floor(o.z) THEN (1 - (o.z - floor(o.z))) * t.v ELSE (o.z - floor(o.z)) * t.v END) AS s
  FROM o JOIN sheet t ON t.vol = o.mesh AND t.y = o.vid // 8 AND t.x = o.vid % 8 AND t.z BETWEEN floor(o.z) AND floor(o.z) + 1 GROUP BY ALL)
SELECT mesh, vid, (vid % 8)::DOUBLE AS x, (vid // 8)::DOUBLE AS y, round(z, 6) + 0.0 AS z, round(s, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY mesh, vid ORDER BY r DESC, k) AS i FROM s) WHERE i = 1""",
    "q_bands": with_sql("sheet").replace("sheet AS (", "vox AS MATERIALIZED (", 1) + ",\n" + isosurface.triangles_sql(0.5, SHEET) + """,
v AS (SELECT vol, q.lo AS lo, q.hi AS hi, any_value(q.px) AS px, any_value(q.py) AS py, any_value(q.pz) AS pz FROM (SELECT vol, unnest([a, b, c]) AS q FROM mface) GROUP BY ALL)
SELECT vol, count(*) AS n, round(sum(px), 6) + 0.0 AS sx, round(sum(py), 6) + 0.0 AS sy, round(sum(pz), 6) + 0.0 AS sz FROM v GROUP BY vol""",
}
