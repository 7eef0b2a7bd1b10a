"""Queries on surface grids, meshes and rasters, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from surfacelab.functions import vec as V
from surfacelab.operators import mesh as M
from surfacelab.operators import metrics, raster
from surfacelab.operators import parameterise as P
from surfacelab.operators import rounds as G
from surfacelab.plans.points import r6, xyz
from surfacelab.sources.derived import SIDE, candidates, grids, table, tiles, with_sql


def parts(spark, d):
    g = grids(spark, d)
    return M.grid_vertices(g, SIDE), M.grid_faces(g, SIDE)


def q_grid_faces(spark, d):
    return parts(spark, d)[1]


def q_prune_faces(spark, d):
    v, f = parts(spark, d)
    return M.prune_long_faces(f, v, 1.5)


def q_nonmanifold(spark, d):
    """Faces of order lines as triangles of keys: an edge of more than two faces removes them."""
    f = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("mesh"), (F.col("l_orderkey") % 5).alias("a"), (F.col("l_suppkey") % 5 + 5).alias("b"), (F.col("l_linenumber") % 4 + 10).cast("long").alias("c"))
    f = f.distinct().select("mesh", (F.col("a") * 10000 + F.col("b") * 100 + F.col("c")).alias("fid"), "a", "b", "c")
    return M.remove_nonmanifold(f, 2)


def q_euler(spark, d):
    return M.topology(parts(spark, d)[1])


def q_subdivide(spark, d):
    v, f = parts(spark, d)
    points, faces = M.subdivide(f, v)
    got = points.groupBy("mesh").agg(F.count(F.lit(1)).alias("n_vertices"), *[r6(F.sum(F.col("p")[k]), "s" + k) for k in "xyz"])
    return got.join(faces.groupBy("mesh").agg(F.count(F.lit(1)).alias("n_faces")), "mesh", "left").withColumn("n_faces", F.coalesce("n_faces", F.lit(0)))


def q_vertex_normals(spark, d):
    v, f = parts(spark, d)
    return M.vertex_normals(f, v).select("mesh", "vid", *xyz("normal", ["nx", "ny", "nz"]))


def q_bridges(spark, d):
    v, f = parts(spark, d)
    n = M.vertex_normals(f, v)
    return M.prune_bridges(f, v.join(n, ["mesh", "vid"]), 2.5, 0.6427876096865394, 0.9).select("mesh", "fid")


def q_continuity(spark, d):
    v, f = parts(spark, d)
    return M.continuity(f, v).select("mesh", r6("normal_p01", "normal_p01"), r6("edge_outliers", "edge_outliers"))


def q_face_components(spark, d):
    got = M.face_components(parts(spark, d)[1], "mesh")
    return got.groupBy("mesh", "label").agg(F.count(F.lit(1)).alias("n"))


def q_boundary_loops(spark, d):
    v, f = parts(spark, d)
    return M.boundary_loops(f, v, "mesh").select("mesh", "loop", "n", r6("perimeter", "perimeter"), "simple")


def q_seed_component(spark, d):
    v, f = parts(spark, d)
    seeds = v.select("mesh").distinct().select("mesh", V.vec(F.lit(3.5), F.lit(3.5), F.lit(0)).alias("seed"))
    return M.seed_component(f, v, seeds, "mesh").groupBy("mesh").agg(F.count(F.lit(1)).alias("n"))


def q_geodesic(spark, d):
    """Distances along edges from the least vertex of each mesh, summed."""
    v, f = parts(spark, d)
    e = M.edge_lengths(f, v).select(F.struct("mesh", F.col("lo").alias("vid")).alias("a"), F.struct("mesh", F.col("hi").alias("vid")).alias("b"), "w")
    start = M.corners(f).groupBy("mesh").agg(F.min("vid").alias("vid")).select(F.struct("mesh", "vid").alias("node"))
    got = G.shortest_paths(start, e, key="mesh")
    return got.groupBy(F.col("node.mesh").alias("mesh")).agg(F.count(F.lit(1)).alias("n"), r6(F.max("distance"), "furthest"), r6(F.sum("distance"), "total"))


def q_tutte(spark, d):
    """The solved map of each mesh's largest component, its small holes filled."""
    _, _, uv = P.parameterised(*reversed(parts(spark, d)), 1e-8, "mesh")
    return uv.select("mesh", "vid", r6("u", "u"), r6("v", "v"))


def q_uv_quality(spark, d):
    faces, _, uv = P.parameterised(*reversed(parts(spark, d)), 1e-8, "mesh")
    return M.uv_quality(faces, uv).select("mesh", r6("flipped", "flipped"), r6("collapsed", "collapsed"))


RADII = [12.0, 9.6, 7.68, 6.144, 4.9152, 3.93216, 3.145728]


def q_geodesic_disk(spark, d):
    """The largest of seven radii around each mesh's vertex nearest the middle that gives a disk once its small holes are filled."""
    v, f = parts(spark, d)
    used = M.referenced(v, f)
    near = F.round(V.norm(V.sub(F.col("p"), V.vec(F.lit(3.5), F.lit(3.5), F.col("p.z")))), 9)
    start = used.groupBy("mesh").agg(F.min_by("vid", F.struct(near, "vid")).alias("vid")).select(F.struct("mesh", "vid").alias("node"))
    e = M.edge_lengths(f, v).select(F.struct("mesh", F.col("lo").alias("vid")).alias("a"), F.struct("mesh", F.col("hi").alias("vid")).alias("b"), "w")
    distance = G.shortest_paths(start, e, RADII[0], "mesh").select("node.mesh", "node.vid", "distance")
    faces, points, told = P.disks(f, v, distance, RADII, 8, key="mesh")
    n = faces.groupBy("mesh").agg(F.count(F.lit(1)).alias("faces")).join(points.groupBy("mesh").agg(F.count(F.lit(1)).alias("vertices")), "mesh")
    return told.join(n, "mesh").select("mesh", r6("radius", "radius"), "filled", "faces", "vertices")


def q_mesh_raster(spark, d):
    """Meshes drawn in the plane of their grid at four pixels a cell, with the height of the first face."""
    v, f = parts(spark, d)
    at = M.with_points(f, v)
    t = at.select("mesh", "fid", *[x for k in "abc" for x in ((F.col("p" + k)["x"] * 4).alias("u" + k), (F.col("p" + k)["y"] * 4).alias("v" + k), F.col("p" + k)["z"].alias("z_" + k))])
    got = raster.rasterize(t, ["mesh"], ["z"])
    return got.groupBy("mesh").agg(F.count(F.lit(1)).alias("pixels"), F.sum("coverage").alias("covered"), F.count_if(F.col("coverage") > 1).alias("overlaps"), r6(F.sum("z"), "height"))


def q_splat(spark, d):
    points = candidates(spark, d).select("label", (F.col("p")["x"] * 2).alias("u"), (F.col("p")["y"] * 2).alias("v"), "p", "score", F.col("candidate_id").alias("ordinal"))
    got = raster.splat(points, ["label"], 2.0)
    return got.select("label", F.col("iu").cast("long").alias("iu"), F.col("iv").cast("long").alias("iv"), r6("x", "x"), r6("y", "y"), r6("z", "z"), "n")


def q_overlap_average(spark, d):
    """Tiles of a label laid at stride 4 by their number; the mean where they overlap."""
    t = tiles(spark, d).select("label", (F.floor(F.col("tile") / 10) % 7).cast("int").alias("i"), (F.col("tile") % 10).cast("int").alias("j"), "r", "c", "v")
    got = raster.overlap_average(t, 8, 4, ["label"])
    return got.select("label", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), r6("v", "v"), "n")


def q_atlas(spark, d):
    """Charts of customers' orders on shelves; a chart's size follows the order count and price."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("h"), F.max(F.floor(F.col("o_totalprice") / 10000)).cast("long").alias("w"))
    return raster.atlas(rows.select((F.col("o_custkey") % 50).alias("sheet"), F.col("o_custkey").alias("chart"), "h", "w"))


def q_jump_flags(spark, d):
    got = metrics.jump_flags(grids(spark, d), 1.5)
    return got.select("grid", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "bad_right", "bad_down", "folded", "defect")


def q_geometry(spark, d):
    """Geometry of the height grids; adherence is the share of valid cells that are higher than the holes' limit by a little."""
    g = grids(spark, d)
    adherence = g.where("valid").groupBy("grid").agg(F.avg((F.col("p.z") > -1.1).cast("double")).alias("adherence"))
    got = metrics.gates(metrics.geometry(metrics.jump_flags(g, 1.5)).join(adherence, "grid", "left"))
    return got.select("grid", *[r6(k, k) for k in ("coverage", "adherence", "jump_fraction", "folded_fraction")], F.coalesce("passed", F.lit(False)).alias("passed"))


V_ = "v AS (SELECT grid AS mesh, r * 8 + c AS vid, px, py, pz FROM grid WHERE valid)"
F_ = """sq AS (SELECT a.grid AS mesh, a.r, a.c FROM grid a JOIN grid b ON a.grid = b.grid AND b.r BETWEEN a.r AND a.r + 1 AND b.c BETWEEN a.c AND a.c + 1 AND b.valid GROUP BY ALL HAVING count(*) = 4),
f AS (SELECT mesh, (r * 8 + c)::BIGINT * 2 + k AS fid, (CASE k WHEN 0 THEN r * 8 + c ELSE r * 8 + c + 1 END)::BIGINT AS a, (CASE k WHEN 0 THEN r * 8 + c + 1 ELSE r * 8 + c + 9 END)::BIGINT AS b, (r * 8 + c + 8)::BIGINT AS c FROM sq, range(2) t(k))"""
E_ = """fe AS (SELECT mesh, fid, least(x, y) AS lo, greatest(x, y) AS hi FROM (SELECT mesh, fid, a AS x, b AS y FROM f UNION ALL SELECT mesh, fid, b, c FROM f UNION ALL SELECT mesh, fid, c, a FROM f)),
el AS (SELECT e.mesh, lo, hi, sqrt((p.px - q.px) * (p.px - q.px) + (p.py - q.py) * (p.py - q.py) + (p.pz - q.pz) * (p.pz - q.pz)) AS w FROM (SELECT DISTINCT mesh, lo, hi FROM fe) e JOIN v p ON p.mesh = e.mesh AND p.vid = lo JOIN v q ON q.mesh = e.mesh AND q.vid = hi),
ec AS (SELECT mesh, lo, hi, count(*) AS n FROM fe GROUP BY ALL)"""
MESH = with_sql("grid") + ",\n" + V_ + ",\n" + F_ + ",\n" + E_
MESH_R = MESH.replace("WITH ", "WITH RECURSIVE ", 1)
N_ = """fp AS (SELECT f.mesh, fid, f.a, f.b, f.c, A.px AS ax, A.py AS ay, A.pz AS az, B.px - A.px AS ux, B.py - A.py AS uy, B.pz - A.pz AS uz, C.px - A.px AS wx, C.py - A.py AS wy, C.pz - A.pz AS wz
  FROM f JOIN v A ON A.mesh = f.mesh AND A.vid = f.a JOIN v B ON B.mesh = f.mesh AND B.vid = f.b JOIN v C ON C.mesh = f.mesh AND C.vid = f.c),
fc AS (SELECT mesh, fid, a, b, c, uy * wz - uz * wy AS x, uz * wx - ux * wz AS y, ux * wy - uy * wx AS z FROM fp),
fnr AS (SELECT mesh, fid, a, b, c, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, greatest(sqrt(x * x + y * y + z * z), 1e-6) AS l FROM fc)),
vs AS (SELECT mesh, vid, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM (SELECT mesh, a AS vid, x, y, z FROM fnr UNION ALL SELECT mesh, b, x, y, z FROM fnr UNION ALL SELECT mesh, c, x, y, z FROM fnr) GROUP BY ALL),
vn AS (SELECT mesh, vid, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, greatest(sqrt(x * x + y * y + z * z), 1e-6) AS l FROM vs))"""
FLAGS = """e AS (SELECT g.grid, g.r, g.c, g.valid AND a.valid AS hr, g.valid AND b.valid AS hd, g.valid AND a.valid AND b.valid AND o.valid AS quad,
  a.px - g.px AS ux, a.py - g.py AS uy, a.pz - g.pz AS uz, b.px - g.px AS wx, b.py - g.py AS wy, b.pz - g.pz AS wz
  FROM grid g LEFT JOIN grid a ON a.grid = g.grid AND a.r = g.r AND a.c = g.c + 1 LEFT JOIN grid b ON b.grid = g.grid AND b.r = g.r + 1 AND b.c = g.c LEFT JOIN grid o ON o.grid = g.grid AND o.r = g.r + 1 AND o.c = g.c + 1),
l AS (SELECT grid, r, c, coalesce(quad, false) AS quad, CASE WHEN hr THEN sqrt(ux * ux + uy * uy + uz * uz) END AS lr, CASE WHEN hd THEN sqrt(wx * wx + wy * wy + wz * wz) END AS ld,
  CASE WHEN quad THEN uy * wz - uz * wy END AS x, CASE WHEN quad THEN uz * wx - ux * wz END AS y, CASE WHEN quad THEN ux * wy - uy * wx END AS z FROM e),
m AS (SELECT grid, quantile_cont(w, 0.5) AS med FROM (SELECT grid, lr AS w FROM l UNION ALL SELECT grid, ld FROM l) WHERE w IS NOT NULL GROUP BY grid),
rf AS (SELECT grid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM l WHERE quad GROUP BY grid),
fl AS (SELECT l.grid, l.r, l.c, quad, lr, ld, coalesce(med > 0 AND lr > 1.5 * med, false) AS bad_right, coalesce(med > 0 AND ld > 1.5 * med, false) AS bad_down,
  coalesce(quad AND l.x * rf.x + l.y * rf.y + l.z * rf.z <= 0, false) AS folded FROM l LEFT JOIN m ON m.grid = l.grid LEFT JOIN rf ON rf.grid = l.grid),
mk AS (SELECT grid, r, c FROM fl WHERE bad_right UNION SELECT grid, r, c + 1 FROM fl WHERE bad_right UNION SELECT grid, r, c FROM fl WHERE bad_down UNION SELECT grid, r + 1, c FROM fl WHERE bad_down
  UNION SELECT grid, r + i, c + j FROM fl, range(2) s(i), range(2) t(j) WHERE folded)"""
LABELS = "nb AS (SELECT DISTINCT s.mesh, s.fid AS s, t.fid AS t FROM fe s JOIN fe t ON s.mesh = t.mesh AND s.lo = t.lo AND s.hi = t.hi), rr(mesh, fid, m) AS (SELECT mesh, fid, fid FROM f UNION SELECT rr.mesh, rr.fid, nb.t FROM rr JOIN nb ON rr.mesh = nb.mesh AND rr.m = nb.s), lb AS (SELECT mesh, fid, min(m) AS label FROM rr GROUP BY mesh, fid)"



def materialised(sql: str) -> str:
    """The statement with each of its common tables worked out once."""
    return re.sub(r"(\b\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", sql)


SQL = {
    "q_grid_faces": MESH + " SELECT mesh, fid, a, b, c FROM f",
    "q_prune_faces": MESH + ", lim AS (SELECT mesh, quantile_cont(w, 0.5) * 1.5 AS lim FROM el GROUP BY mesh), bad AS (SELECT DISTINCT fe.mesh, fid FROM fe JOIN el ON fe.mesh = el.mesh AND fe.lo = el.lo AND fe.hi = el.hi JOIN lim ON lim.mesh = el.mesh WHERE w >= lim) SELECT f.mesh, f.fid, a, b, c FROM f WHERE (mesh, fid) NOT IN (SELECT mesh, fid FROM bad)",
    "q_nonmanifold": "WITH f0 AS (SELECT DISTINCT l_partkey AS mesh, l_orderkey % 5 AS a, l_suppkey % 5 + 5 AS b, (l_linenumber % 4 + 10)::BIGINT AS c FROM lineitem)" + "".join(f""",
e{i} AS (SELECT mesh, x, y FROM (SELECT mesh, a AS x, b AS y FROM f{i} UNION ALL SELECT mesh, b, c FROM f{i} UNION ALL SELECT mesh, a, c FROM f{i}) GROUP BY ALL HAVING count(*) > 2),
f{i + 1} AS (SELECT * FROM f{i} WHERE (mesh, a, b) NOT IN (SELECT mesh, x, y FROM e{i}) AND (mesh, b, c) NOT IN (SELECT mesh, x, y FROM e{i}) AND (mesh, a, c) NOT IN (SELECT mesh, x, y FROM e{i}))""" for i in range(2)) + " SELECT mesh, a * 10000 + b * 100 + c AS fid, a, b, c FROM f2",
    "q_euler": MESH + ", vx AS (SELECT mesh, count(DISTINCT x) AS vertices, count(DISTINCT fid) AS faces FROM (SELECT mesh, fid, unnest([a, b, c]) AS x FROM f) GROUP BY mesh), ex AS (SELECT mesh, count(*) AS edges, count(*) FILTER (n = 1) AS boundary_edges, count(*) FILTER (n > 2) AS violations FROM ec GROUP BY mesh) SELECT vx.mesh, vertices, faces, edges, boundary_edges, violations, vertices - edges + faces AS euler FROM vx JOIN ex ON vx.mesh = ex.mesh",
    "q_subdivide": MESH + ", pts AS (SELECT mesh, px, py, pz FROM v UNION ALL SELECT el.mesh, (p.px + q.px) / 2, (p.py + q.py) / 2, (p.pz + q.pz) / 2 FROM el JOIN v p ON p.mesh = el.mesh AND p.vid = lo JOIN v q ON q.mesh = el.mesh AND q.vid = hi), nf AS (SELECT mesh, count(*) * 4 AS n FROM f GROUP BY mesh) SELECT pts.mesh, count(*) AS n_vertices, round(sum(px), 6) + 0.0 AS sx, round(sum(py), 6) + 0.0 AS sy, round(sum(pz), 6) + 0.0 AS sz, coalesce(any_value(nf.n), 0)::BIGINT AS n_faces FROM pts LEFT JOIN nf ON nf.mesh = pts.mesh GROUP BY pts.mesh",
    "q_vertex_normals": MESH + ",\n" + N_ + " SELECT mesh, vid, round(x, 6) + 0.0 AS nx, round(y, 6) + 0.0 AS ny, round(z, 6) + 0.0 AS nz FROM vn",
    "q_bridges": materialised(MESH + ",\n" + N_) + """, lim AS (SELECT mesh, quantile_cont(w, 0.5) * 2.5 AS lim FROM (SELECT el.* FROM el) GROUP BY mesh),
be AS (SELECT el.mesh, el.lo, el.hi FROM el JOIN lim ON lim.mesh = el.mesh JOIN v p ON p.mesh = el.mesh AND p.vid = lo JOIN v q ON q.mesh = el.mesh AND q.vid = hi JOIN vn n ON n.mesh = el.mesh AND n.vid = lo JOIN vn o ON o.mesh = el.mesh AND o.vid = hi
  WHERE w > lim OR abs(n.x * o.x + n.y * o.y + n.z * o.z) < 0.6427876096865394 OR greatest(abs((q.px - p.px) * n.x + (q.py - p.py) * n.y + (q.pz - p.pz) * n.z), abs((q.px - p.px) * o.x + (q.py - p.py) * o.y + (q.pz - p.pz) * o.z)) / greatest(w, 1e-6) > 0.9)
SELECT mesh, fid FROM f WHERE NOT EXISTS (SELECT 1 FROM fe JOIN be ON fe.mesh = be.mesh AND fe.lo = be.lo AND fe.hi = be.hi WHERE fe.mesh = f.mesh AND fe.fid = f.fid)""",
    "q_continuity": MESH + ",\n" + N_ + ", ag AS (SELECT s.mesh, quantile_cont(abs(n.x * o.x + n.y * o.y + n.z * o.z), 0.01) AS q FROM fe s JOIN fe t ON s.mesh = t.mesh AND s.lo = t.lo AND s.hi = t.hi AND s.fid < t.fid JOIN fnr n ON n.mesh = s.mesh AND n.fid = s.fid JOIN fnr o ON o.mesh = t.mesh AND o.fid = t.fid GROUP BY s.mesh), lim AS (SELECT mesh, 2.5 * quantile_cont(w, 0.5) AS lim FROM el GROUP BY mesh), ou AS (SELECT el.mesh, avg((w > lim)::INT::DOUBLE) AS o FROM el JOIN lim ON el.mesh = lim.mesh GROUP BY el.mesh) SELECT ou.mesh, round(q, 6) + 0.0 AS normal_p01, round(o, 6) + 0.0 AS edge_outliers FROM ou LEFT JOIN ag ON ou.mesh = ag.mesh",
    "q_face_components": MESH_R + ", " + LABELS + " SELECT mesh, label, count(*) AS n FROM lb GROUP BY mesh, label",
    "q_boundary_loops": MESH_R + ", be AS (SELECT mesh, lo, hi FROM ec WHERE n = 1), bb AS (SELECT mesh, lo AS s, hi AS t FROM be UNION ALL SELECT mesh, hi, lo FROM be), r(mesh, s, m) AS (SELECT DISTINCT mesh, s, s FROM bb UNION SELECT r.mesh, r.s, bb.t FROM r JOIN bb ON bb.mesh = r.mesh AND bb.s = r.m), l AS (SELECT mesh, s, min(m) AS loop FROM r GROUP BY mesh, s), dg AS (SELECT mesh, s, count(*) AS d FROM bb GROUP BY mesh, s), pr AS (SELECT l.mesh, loop, sum(w) AS p FROM be JOIN el ON be.mesh = el.mesh AND be.lo = el.lo AND be.hi = el.hi JOIN l ON l.mesh = be.mesh AND l.s = be.lo GROUP BY ALL) SELECT l.mesh, l.loop, count(*) AS n, round(any_value(p), 6) + 0.0 AS perimeter, bool_and(d = 2) AS simple FROM l JOIN dg ON dg.mesh = l.mesh AND dg.s = l.s JOIN pr ON pr.mesh = l.mesh AND pr.loop = l.loop GROUP BY l.mesh, l.loop",
    "q_seed_component": MESH_R + ", " + LABELS + ", aw AS (SELECT lb.mesh, label, round(sqrt((px - 3.5) * (px - 3.5) + (py - 3.5) * (py - 3.5) + pz * pz), 9) AS w FROM lb JOIN (SELECT mesh, fid, unnest([a, b, c]) AS vid FROM f) k ON k.mesh = lb.mesh AND k.fid = lb.fid JOIN v ON v.mesh = k.mesh AND v.vid = k.vid), be AS (SELECT mesh, label FROM (SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY w, label) AS i FROM aw) WHERE i = 1) SELECT lb.mesh, count(*) AS n FROM lb JOIN be ON lb.mesh = be.mesh AND lb.label = be.label GROUP BY lb.mesh",
    "q_geodesic": MESH_R + """, g AS MATERIALIZED (SELECT mesh, lo AS s, hi AS t, w FROM el UNION ALL SELECT mesh, hi, lo, w FROM el),
r(mesh, vid, d) USING KEY (mesh, vid) AS (SELECT mesh, min(x) AS vid, 0.0::DOUBLE AS d FROM (SELECT mesh, unnest([a, b, c]) AS x FROM f) GROUP BY mesh
  UNION SELECT r.mesh, g.t, min(r.d + g.w) FROM r JOIN g ON g.mesh = r.mesh AND g.s = r.vid LEFT JOIN recurring.r AS k ON k.mesh = r.mesh AND k.vid = g.t WHERE k.d IS NULL OR r.d + g.w < k.d - 1e-12 GROUP BY r.mesh, g.t)
SELECT mesh, count(*) AS n, round(max(d), 6) + 0.0 AS furthest, round(sum(d), 6) + 0.0 AS total FROM r GROUP BY mesh""",
    "q_geodesic_disk": MESH_R + """, g AS MATERIALIZED (SELECT mesh, lo AS s, hi AS t, w FROM el UNION ALL SELECT mesh, hi, lo, w FROM el),
u AS (SELECT DISTINCT k.mesh, k.x AS vid, px, py, pz FROM (SELECT mesh, unnest([a, b, c]) AS x FROM f) k JOIN v ON v.mesh = k.mesh AND v.vid = k.x),
st AS (SELECT mesh, arg_min(vid, (round(sqrt((px - 3.5) * (px - 3.5) + (py - 3.5) * (py - 3.5)), 9), vid)) AS vid FROM u GROUP BY mesh),
r(mesh, vid, d) USING KEY (mesh, vid) AS (SELECT mesh, vid, 0.0::DOUBLE AS d FROM st
  UNION SELECT r.mesh, g.t, min(r.d + g.w) FROM r JOIN g ON g.mesh = r.mesh AND g.s = r.vid LEFT JOIN recurring.r AS k ON k.mesh = r.mesh AND k.vid = g.t WHERE r.d + g.w <= 12 AND (k.d IS NULL OR r.d + g.w < k.d - 1e-12) GROUP BY r.mesh, g.t),
fr AS (SELECT f.mesh, f.fid, f.a, f.b, f.c, greatest(x.d, y.d, z.d) AS far FROM f JOIN r x ON x.mesh = f.mesh AND x.vid = f.a JOIN r y ON y.mesh = f.mesh AND y.vid = f.b JOIN r z ON z.mesh = f.mesh AND z.vid = f.c),
pt AS MATERIALIZED (SELECT mesh, radius, fid, a, b, c FROM fr, (SELECT unnest(%s::DOUBLE[]) AS radius) WHERE radius >= far),
pe AS MATERIALIZED (SELECT mesh, radius, least(x, y) AS lo, greatest(x, y) AS hi, count(*) AS n FROM (SELECT mesh, radius, a AS x, b AS y FROM pt UNION ALL SELECT mesh, radius, b, c FROM pt UNION ALL SELECT mesh, radius, c, a FROM pt) GROUP BY ALL),
pv AS (SELECT mesh, radius, count(DISTINCT x) AS vertices, count(DISTINCT fid) AS faces FROM (SELECT mesh, radius, fid, unnest([a, b, c]) AS x FROM pt) GROUP BY ALL),
pc AS (SELECT mesh, radius, count(*) AS edges, count(*) FILTER (n > 2) AS bad FROM pe GROUP BY ALL),
bb AS MATERIALIZED (SELECT mesh, radius, lo AS s, hi AS t FROM pe WHERE n = 1 UNION ALL SELECT mesh, radius, hi, lo FROM pe WHERE n = 1),
q(mesh, radius, s, m) AS (SELECT DISTINCT mesh, radius, s, s FROM bb UNION SELECT q.mesh, q.radius, q.s, bb.t FROM q JOIN bb ON bb.mesh = q.mesh AND bb.radius = q.radius AND bb.s = q.m),
lp AS MATERIALIZED (SELECT mesh, radius, s, min(m) AS loop FROM q GROUP BY ALL),
sz AS (SELECT lp.mesh, lp.radius, loop, sum(w) / 2 AS len, count(*) / 2 AS n, count(DISTINCT lp.s) AS k, max(d) AS most FROM lp JOIN (SELECT *, count(*) OVER (PARTITION BY mesh, radius, s) AS d FROM bb) bb ON bb.mesh = lp.mesh AND bb.radius = lp.radius AND bb.s = lp.s
  JOIN g ON g.mesh = lp.mesh AND g.s = bb.s AND g.t = bb.t GROUP BY lp.mesh, lp.radius, loop),
ls AS (SELECT mesh, radius, count(*) AS loops, max(most) = 2 AS simple, (SELECT count(*) FROM sz i WHERE i.mesh = sz.mesh AND i.radius = sz.radius AND i.loop <> arg_max(sz.loop, (sz.len, -sz.loop)) AND i.len > 0.35 * max(sz.len)) AS torn, sum(k) - arg_max(k, (len, -loop)) AS fans FROM sz GROUP BY mesh, radius),
ok AS (SELECT pv.mesh, pv.radius, loops - 1 AS filled, faces + fans AS faces, vertices + loops - 1 AS vertices FROM pv JOIN pc ON pc.mesh = pv.mesh AND pc.radius = pv.radius JOIN ls ON ls.mesh = pv.mesh AND ls.radius = pv.radius
  WHERE vertices >= 8 AND bad = 0 AND simple AND torn = 0 AND vertices - edges + faces + loops - 1 = 1)
SELECT mesh, round(radius, 6) + 0.0 AS radius, filled, faces::BIGINT AS faces, vertices FROM (SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY radius DESC) AS i FROM ok) WHERE i = 1""" % RADII,
    "q_mesh_raster": MESH + """, t AS (SELECT f.mesh, fid, A.px * 4 AS ua, A.py * 4 AS va, A.pz AS za, B.px * 4 AS ub, B.py * 4 AS vb, B.pz AS zb, C.px * 4 AS uc, C.py * 4 AS vc, C.pz AS zc FROM f JOIN v A ON A.mesh = f.mesh AND A.vid = f.a JOIN v B ON B.mesh = f.mesh AND B.vid = f.b JOIN v C ON C.mesh = f.mesh AND C.vid = f.c),
px AS (SELECT *, (ub - ua) * (vc - va) - (uc - ua) * (vb - va) AS ar FROM (SELECT *, unnest(range(floor(least(ua, ub, uc))::INT, ceil(greatest(ua, ub, uc))::INT + 1)) AS col FROM (SELECT *, unnest(range(floor(least(va, vb, vc))::INT, ceil(greatest(va, vb, vc))::INT + 1)) AS row FROM t))),
w AS (SELECT *, ((uc - ub) * (row + 0.5 - vb) - (col + 0.5 - ub) * (vc - vb)) / ar AS w0, ((ua - uc) * (row + 0.5 - vc) - (col + 0.5 - uc) * (va - vc)) / ar AS w1 FROM px WHERE abs(ar) > 1e-12),
g AS (SELECT mesh, row, col, count(*) AS n, arg_min(w0 * za + w1 * zb + (1 - w0 - w1) * zc, fid) AS z FROM w WHERE w0 >= -1e-7 AND w1 >= -1e-7 AND 1 - w0 - w1 >= -1e-7 GROUP BY mesh, row, col)
SELECT mesh, count(*) AS pixels, sum(n)::BIGINT AS covered, count(*) FILTER (n > 1) AS overlaps, round(sum(z), 6) + 0.0 AS height FROM g GROUP BY mesh""",
    "q_splat": with_sql("cand") + ", lo AS (SELECT label, min(px * 2) AS u0, min(py * 2) AS v0 FROM cand GROUP BY label), s AS (SELECT cand.label, round_even((px * 2 - u0) / 2, 0)::BIGINT AS iu, round_even((py * 2 - v0) / 2, 0)::BIGINT AS iv, px, py, pz, greatest(score, 1e-3) * greatest(score, 1e-3) AS w, score, candidate_id FROM cand JOIN lo ON cand.label = lo.label), b AS (SELECT label, iu, iv, px, py, pz FROM (SELECT *, row_number() OVER (PARTITION BY label, iu, iv ORDER BY score DESC, candidate_id DESC) AS i FROM s) WHERE i = 1) SELECT s.label, s.iu, s.iv, " + ", ".join(f"round((sum(w * s.p{k}) / sum(w) + any_value(b.p{k})) / 2, 6) + 0.0 AS {k}" for k in "xyz") + ", count(*) AS n FROM s JOIN b ON s.label = b.label AND s.iu = b.iu AND s.iv = b.iv GROUP BY s.label, s.iu, s.iv",
    "q_overlap_average": with_sql("tile") + " SELECT label, ((tile // 10) % 7 * 4 + r)::BIGINT AS row, (tile % 10 * 4 + c)::BIGINT AS col, round(avg(v), 6) + 0.0 AS v, count(*) AS n FROM tile GROUP BY ALL",
    "q_atlas": """WITH q AS (SELECT o_custkey % 50 AS sheet, o_custkey AS chart, count(*) AS h, max(floor(o_totalprice / 10000))::BIGINT AS w FROM orders GROUP BY o_custkey),
k AS (SELECT *, (row_number() OVER (PARTITION BY sheet ORDER BY chart) - 1) AS k FROM q), s AS (SELECT *, k // 3 AS shelf, k % 3 AS colm FROM k),
x AS (SELECT sheet, colm, coalesce(sum(w + 32) OVER (PARTITION BY sheet ORDER BY colm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x0 FROM (SELECT sheet, colm, max(w) AS w FROM s GROUP BY ALL)),
y AS (SELECT sheet, shelf, coalesce(sum(h + 32) OVER (PARTITION BY sheet ORDER BY shelf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y0 FROM (SELECT sheet, shelf, max(h) AS h FROM s GROUP BY ALL))
SELECT s.sheet, s.chart, s.h, s.w, x0, y0 FROM s JOIN x ON x.sheet = s.sheet AND x.colm = s.colm JOIN y ON y.sheet = s.sheet AND y.shelf = s.shelf""",
    "q_jump_flags": with_sql("grid") + ",\n" + FLAGS + " SELECT fl.grid, fl.r::BIGINT AS r, fl.c::BIGINT AS c, bad_right, bad_down, folded, mk.r IS NOT NULL AS defect FROM fl LEFT JOIN mk ON mk.grid = fl.grid AND mk.r = fl.r AND mk.c = fl.c",
    "q_geometry": with_sql("grid") + ",\n" + FLAGS + """, o AS (SELECT grid, (count(*) FILTER (bad_right) + count(*) FILTER (bad_down)) / greatest(count(lr) + count(ld), 1) AS j, count(*) FILTER (folded) / greatest(count(*) FILTER (quad), 1) AS k FROM fl GROUP BY grid),
v AS (SELECT grid, count(*) FILTER (valid) / count(*) AS a, avg(CASE WHEN valid THEN (pz > -1.1)::INT::DOUBLE END) AS h FROM grid GROUP BY grid)
SELECT o.grid, round(a, 6) + 0.0 AS coverage, round(h, 6) + 0.0 AS adherence, round(j, 6) + 0.0 AS jump_fraction, round(k, 6) + 0.0 AS folded_fraction, coalesce(a >= 0.99 AND h >= 0.95 AND k < 0.001 AND j < 0.01, false) AS passed FROM o JOIN v ON v.grid = o.grid""",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
