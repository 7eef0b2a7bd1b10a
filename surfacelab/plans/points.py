"""Queries on candidates, volumes and tiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from surfacelab.functions import vec as V
from surfacelab.operators import metrics, ranking, sampling, stencil
from surfacelab.operators import rounds as G
from surfacelab.sources.derived import candidates, tiles, voxels, with_sql

AXES = ["z", "y", "x"]


def r6(x, name):
    return (F.round(x, 6) + 0.0).alias(name)


def xyz(v, names):
    return [r6(F.col(v)[k], n) for k, n in zip("xyz", names)]


def local(spark, d):
    """Candidates in the 4-voxel coordinates of their own volume."""
    return candidates(spark, d).select("candidate_id", F.col("candidate_id").alias("vol"), V.scale("p", F.lit(0.1)).alias("p"), V.normalize("n").alias("n"), "score")


def q_affine(spark, d):
    s, o = (2.0, 4.0, 8.0), (1.0, 2.0, 3.0)
    rows = candidates(spark, d).select("candidate_id", V.to_voxel("p", s, o).alias("q"))
    return rows.withColumn("w", V.to_world("q", s, o)).select("candidate_id", *xyz("q", ["qx", "qy", "qz"]), *xyz("w", ["wx", "wy", "wz"]))


def q_normalize(spark, d):
    rows = candidates(spark, d).select("candidate_id", V.normalize("n").alias("a"), V.normalize_soft("n").alias("b"), V.norm("n").alias("len"))
    return rows.select("candidate_id", *xyz("a", ["ax", "ay", "az"]), *xyz("b", ["bx", "by", "bz"]), r6("len", "len"))


def q_tangent_frame(spark, d):
    rows = candidates(spark, d).select("candidate_id", V.normalize("n").alias("n"))
    return V.tangent_frame(rows, "n").select("candidate_id", *xyz("u", ["ux", "uy", "uz"]), *xyz("v", ["vx", "vy", "vz"]))


def q_local_frame(spark, d):
    rows = V.local_frame(candidates(spark, d), "p", "n")
    return rows.select("candidate_id", *[c for i in (1, 2, 3) for c in xyz(f"e{i}", [f"e{i}{k}" for k in "xyz"])])


def q_trilinear(spark, d):
    got = sampling.sample(local(spark, d), voxels(spark, d), ["candidate_id"])
    return got.select("candidate_id", r6("sample", "sample"))


LOCAL = "loc AS (SELECT candidate_id, px * 0.1 AS px, py * 0.1 AS py, pz * 0.1 AS pz, nx / greatest(l, 1e-6) AS nx, ny / greatest(l, 1e-6) AS ny, nz / greatest(l, 1e-6) AS nz, score FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM cand))"


def sampled(points: str, out: str, keys: str) -> str:
    """CTE out(keys, s): trilinear samples of points(keys, vol, qx, qy, qz)."""
    return f"""{out}_c AS (SELECT {keys}, vol, floor(qz)::INT + b // 4 AS z, floor(qy)::INT + (b // 2) % 2 AS y, floor(qx)::INT + b % 2 AS x,
      (CASE WHEN b // 4 = 1 THEN qz - floor(qz) ELSE 1 - qz + floor(qz) END) * (CASE WHEN (b // 2) % 2 = 1 THEN qy - floor(qy) ELSE 1 - qy + floor(qy) END)
      * (CASE WHEN b % 2 = 1 THEN qx - floor(qx) ELSE 1 - qx + floor(qx) END) AS w FROM {points}, range(8) t(b)),
{out} AS (SELECT {keys}, sum(CASE WHEN v.v IS NULL THEN 0 ELSE w * v.v END) AS s FROM {out}_c c LEFT JOIN vox v ON c.vol = v.vol AND c.z = v.z AND c.y = v.y AND c.x = v.x GROUP BY ALL)"""


def q_ray_argmax(spark, d):
    got = sampling.project(local(spark, d), voxels(spark, d), ["candidate_id"], 1.5, 9)
    return got.select("candidate_id", r6("offset", "offset"), r6("sample", "sample"))


def q_depth_stack(spark, d):
    surface = local(spark, d).withColumn("valid", F.col("score") > -0.1)
    got = sampling.depth_stack(surface, voxels(spark, d), [-1.0, -0.5, 0.0, 0.5, 1.0], ["candidate_id"])
    return got.select("candidate_id", F.col("k").cast("long").alias("k"), r6("sample", "sample"))


def q_interp_normal(spark, d):
    g = stencil.gradient(voxels(spark, d), ["vol"], AXES)
    extent = g.groupBy("vol").agg(*[(F.max(k) + 1).alias("n" + k) for k in AXES])
    got = sampling.gradient_sample(local(spark, d), g, extent, ["candidate_id"])
    return got.select("candidate_id", *xyz("normal", ["nx", "ny", "nz"]))


def q_tile_texture(spark, d):
    """Lattice of 3x3x2 around each candidate, sampled, then its texture; the 20 richest."""
    lattice = sampling.tile_lattice(local(spark, d), 3, 2, 0.5)
    got = sampling.sample(lattice, voxels(spark, d), ["candidate_id", "d", "r", "c"], "q")
    t = metrics.texture(got.withColumn("v", F.when(F.col("sample") > 0.5, F.round("sample", 9)).otherwise(0.0)), ["candidate_id"])
    t = t.withColumn("score", F.round(2.0 * F.col("ct_nonzero") + 0.025 * F.col("ct_std"), 9))
    return ranking.top(t, 20).select("candidate_id", "n", r6("ct_nonzero", "ct_nonzero"), r6("ct_std", "ct_std"), r6("score", "score"))


def q_crop_box(spark, d):
    got = sampling.crop_box(candidates(spark, d), 5, {"z": 32, "y": 32, "x": 32})
    return got.select("candidate_id", *[F.col(f"{e}_{k}").cast("long").alias(f"{e}_{k}") for e in ("lo", "hi") for k in "zyx"])


def q_support(spark, d):
    got = sampling.support_filter(local(spark, d), voxels(spark, d), ["candidate_id"], 0.5)
    return ranking.top(got, 50).select("candidate_id", r6("support", "support"), r6("score", "score"))


def q_gaussian(spark, d):
    got = stencil.gaussian(voxels(spark, d), ["vol"], AXES, 0.6)
    return got.select("vol", *[F.col(k).cast("long").alias(k) for k in AXES], r6("v", "v"))


def gaussian_sql(src: str, out: str, keys: str, axes: list[str], sigma: float, value: str, n: int) -> str:
    w = stencil.gaussian_weights(sigma)
    r = len(w) // 2
    table_ = ", ".join(f"({k - r}, {x!r}::DOUBLE)" for k, x in enumerate(w))
    ctes, now = [f"{out}_w(k, w) AS (VALUES {table_})"], src
    for i, a in enumerate(axes):
        new = out if i == len(axes) - 1 else f"{out}_{a}"
        others = [b for b in axes if b != a]
        m = f"((({n * 2} + (s.{a} + k) % {n * 2}) % {n * 2}))"
        cols = ", ".join(f"s.{x}" for x in [*keys.split(", "), *others])
        on = " AND ".join(f"o.{x} = s.{x}" for x in [*keys.split(", "), *others])
        ctes.append(f"{new} AS (SELECT {cols}, s.{a}, sum(w * o.{value}) AS {value} FROM {now} s, {out}_w JOIN {now} o ON {on} AND o.{a} = CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END GROUP BY ALL)")
        now = new
    return ",\n".join(ctes)


def q_strided(spark, d):
    """Every second voxel of each volume in bands of one layer with a layer around: sizes and sums of the bands."""
    got = stencil.strided_bands(voxels(spark, d), 2, 1, 1)
    return got.groupBy("vol", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("core"), r6(F.sum("v"), "total"))


def q_gradient(spark, d):
    got = stencil.gradient(voxels(spark, d), ["vol"], AXES)
    return got.select("vol", *[F.col(k).cast("long").alias(k) for k in AXES], *[r6("g" + k, "g" + k) for k in AXES])


def q_localmax(spark, d):
    got = stencil.local_maxima(voxels(spark, d), ["vol"], AXES, 1, 0.55)
    return got.select("vol", *[F.col(k).cast("long").alias(k) for k in AXES], r6("v", "v"))


def q_seed_argmax(spark, d):
    """The strongest voxel at least one cell from the border, the first in z, y, x order on ties."""
    inner = voxels(spark, d)
    for k in AXES:
        inner = inner.where(F.col(k).between(1, 2))
    o = F.col("z") * 16 + F.col("y") * 4 + F.col("x")
    best = inner.groupBy("vol").agg(F.max_by(F.struct(*AXES, "v"), F.struct("v", (-o).alias("o"))).alias("b"))
    return best.select("vol", *[F.col("b")[k].cast("long").alias(k) for k in AXES], r6(F.col("b")["v"], "v"))


def q_hessian(spark, d):
    got = stencil.hessian_eigenvalues(voxels(spark, d), ["vol"])
    return got.select("vol", *[F.col(k).cast("long").alias(k) for k in AXES], *[(F.round(k, 5) + 0.0).alias(k) for k in ("e1", "e2", "e3")])


def q_ridge(spark, d):
    v = voxels(spark, d)
    got = stencil.ridge_mask(stencil.hessian_eigenvalues(v, ["vol"]), v, ["vol"])
    return got.groupBy("vol").agg(F.count(F.lit(1)).alias("n"), F.max("curvature").alias("m")).select("vol", "n", (F.round("m", 5) + 0.0).alias("most"))


def q_sobel(spark, d):
    got = stencil.sobel(tiles(spark, d), ["tile"], ["r", "c"])
    return got.select("tile", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), r6("sr", "sr"), r6("sc", "sc"))


def q_coherence(spark, d):
    got = stencil.coherence(tiles(spark, d), ["tile"], ["r", "c"], 0.6)
    return got.groupBy("tile").agg(F.avg("coherence").alias("m")).select("tile", r6("m", "coherence"))


def q_best_focus(spark, d):
    """The four layers of a volume: sharpest layer of each pixel against a blur within the layer."""
    v = voxels(spark, d).withColumnRenamed("z", "k")
    blur = stencil.gaussian(v, ["vol", "k"], ["y", "x"], 0.6).withColumnRenamed("v", "blur")
    got = metrics.best_focus(v, blur, ["vol"], ["y", "x"])
    return got.select("vol", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("v", "v"), r6("focus", "focus"))


def q_depth_reductions(spark, d):
    got = metrics.depth_reductions(voxels(spark, d), ["vol", "y", "x"])
    return got.select("vol", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[r6(k, k) for k in ("mean", "max", "min", "std")])


def q_neighbour_mean(spark, d):
    got = stencil.neighbour_mean(tiles(spark, d), ["tile"], ["r", "c"], F.col("v") > 0)
    return got.select("tile", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), r6("mean4", "mean4"))


def q_closing(spark, d):
    got = stencil.closing(tiles(spark, d).withColumn("m", F.col("v") > 12), ["tile"], ["r", "c"], "m", 1)
    return got.groupBy("tile").agg(F.count_if("m").alias("n"), F.sum(F.when(F.col("m"), F.col("r") * 8 + F.col("c")).otherwise(0)).cast("long").alias("places"))


def q_dilate(spark, d):
    got = stencil.dilate_cross(tiles(spark, d).withColumn("m", F.col("v") > 25), ["tile"], ["r", "c"], "m")
    return got.groupBy("tile").agg(F.count_if("m").alias("n"), F.sum(F.when(F.col("m"), F.col("r") * 8 + F.col("c")).otherwise(0)).cast("long").alias("places"))


def q_stretch(spark, d):
    got = stencil.stretch(tiles(spark, d), ["tile"])
    return got.select("tile", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), r6("stretched", "stretched"))


def q_texture(spark, d):
    got = metrics.texture(tiles(spark, d), ["tile"])
    return got.select("tile", "n", r6("ct_nonzero", "ct_nonzero"), r6("ct_std", "ct_std"))


def q_ink(spark, d):
    got = metrics.ink(tiles(spark, d), ["tile"])
    return got.select("tile", *[r6(k, k) for k in ("ink_mean", "ink_std", "ink_p99")])


def q_components(spark, d):
    """18-connected components of the bright voxels: label, size, of each volume's largest."""
    bright = voxels(spark, d).where("v >= 0.53").select("vol", *AXES)
    big = G.largest(G.label_cells(bright, ["vol"], AXES, 2, "vol"), ["vol"])
    got = big.groupBy("vol", "label").agg(F.count(F.lit(1)).alias("n"))
    return got.select("vol", F.col("n"), (F.col("label.z") * 16 + F.col("label.y") * 4 + F.col("label.x")).cast("long").alias("first"))


def q_fill_holes(spark, d):
    got = G.fill_holes(tiles(spark, d).select("tile", "r", "c", (F.col("v") > 2).alias("m")), ["tile"], ["r", "c"], "m", "tile")
    return got.groupBy("tile").agg(F.count_if("m").alias("n"))


def q_nms_edges(spark, d):
    got = ranking.conflicts(candidates(spark, d), 4.0, 0.8)
    return got.select("a", "b")


def q_nms(spark, d):
    return ranking.suppress(candidates(spark, d), 4.0, 0.8).select("candidate_id", r6("score", "score"))


def q_sheets(spark, d):
    rows = ranking.sheets(candidates(spark, d).withColumn("axis", F.col("p.x")), "label", "axis", 4)
    got = ranking.evenly(rows, ["label", "sheet"], ["axis", "candidate_id"], 5)
    return got.select("label", F.col("sheet").cast("long").alias("sheet"), "candidate_id", r6("axis", "axis"))


def q_covariance(spark, d):
    got = metrics.covariance(candidates(spark, d), ["label"])
    return got.select("label", "n", *[r6(k, k) for k in ("mx", "my", "mz", "cxx", "cyy", "czz", "cxy", "cxz", "cyz")])


def q_slab(spark, d):
    rows = candidates(spark, d).withColumn("depth", F.col("p.z") - 16)
    got = metrics.widening_slab(rows, ["label"], "depth", (0.25, 0.5, 1.0, 2.0, 4.0), 12)
    return got.groupBy("label").agg(F.first("width").alias("width"), F.count(F.lit(1)).alias("n"), r6(F.avg("depth"), "mean_depth"))


def q_multisort(spark, d):
    """The 100 tiles of largest spread, then largest 99th percentile."""
    m = metrics.ink(tiles(spark, d), ["tile"]).withColumns({"s": F.round("ink_std", 6), "p": F.round("ink_p99", 6)})
    return m.orderBy(F.desc("s"), F.desc("p"), "tile").limit(100).select("tile", (F.col("s") + 0.0).alias("s"), (F.col("p") + 0.0).alias("p"))


def q_richness(spark, d):
    """Nonzero share, spread and percentile range of each tile."""
    m = metrics.texture(tiles(spark, d), ["tile"]).join(tiles(spark, d).groupBy("tile").agg(F.percentile("v", F.lit(0.01)).alias("lo"), F.percentile("v", F.lit(0.99)).alias("hi")), "tile")
    return m.select("tile", r6(2.0 * F.col("ct_nonzero") + F.col("ct_std") / 50 + (F.col("hi") - F.col("lo")) / 100, "combined"))


def q_crop_score(spark, d):
    got = metrics.crop_score(voxels(spark, d), ["vol"], 0.5, 4, 1, "vol")
    return got.select("vol", *[r6(k, k) for k in ("occupancy", "interior_fraction", "boundary_fraction", "score")], F.col("largest").cast("long").alias("largest"))


def q_choose(spark, d):
    return ranking.choose(candidates(spark, d), 50, 7).select("candidate_id", r6("score", "score"))


R3 = lambda v, n: ", ".join(f"round({x}, 6) + 0.0 AS {y}" for x, y in zip(v, n))
CELL3 = "vol, z::BIGINT AS z, y::BIGINT AS y, x::BIGINT AS x"
CELL2 = "tile, r::BIGINT AS r, c::BIGINT AS c"
LAGS = lambda k, p, o: f"lag(v) OVER (PARTITION BY {p} ORDER BY {o}) AS b_{k}, lead(v) OVER (PARTITION BY {p} ORDER BY {o}) AS f_{k}"
GRAD = "g AS (SELECT vol, z, y, x, v, " + ", ".join(f"coalesce((f_{k} - b_{k}) / 2, f_{k} - v, v - b_{k}, 0.0) AS g{k}" for k in AXES) + " FROM (SELECT *, " + LAGS("z", "vol, y, x", "z") + ", " + LAGS("y", "vol, z, x", "y") + ", " + LAGS("x", "vol, z, y", "x") + " FROM vox))"
FRAME = "u AS (SELECT candidate_id, nx / g AS nx, ny / g AS ny, nz / g AS nz FROM (SELECT *, greatest(sqrt(nx * nx + ny * ny + nz * nz), 1e-6) AS g FROM cand)),\nk AS (SELECT *, CASE WHEN abs(nx) < 0.8 THEN 0.0 ELSE -nz END AS cx, CASE WHEN abs(nx) < 0.8 THEN nz ELSE 0.0 END AS cy, CASE WHEN abs(nx) < 0.8 THEN -ny ELSE nx END AS cz FROM u),\nm AS (SELECT *, cx / greatest(sqrt(cx * cx + cy * cy + cz * cz), 1e-6) AS ux, cy / greatest(sqrt(cx * cx + cy * cy + cz * cz), 1e-6) AS uy, cz / greatest(sqrt(cx * cx + cy * cy + cz * cz), 1e-6) AS uz FROM k),\nf AS (SELECT *, ny * uz - nz * uy AS wx, nz * ux - nx * uz AS wy, nx * uy - ny * ux AS wz FROM m),\nfr AS (SELECT *, wx / greatest(sqrt(wx * wx + wy * wy + wz * wz), 1e-6) AS vx, wy / greatest(sqrt(wx * wx + wy * wy + wz * wz), 1e-6) AS vy, wz / greatest(sqrt(wx * wx + wy * wy + wz * wz), 1e-6) AS vz FROM f)"
CONFLICTS = "u AS (SELECT candidate_id AS id, px, py, pz, score, nx / g AS nx, ny / g AS ny, nz / g AS nz FROM (SELECT *, greatest(sqrt(nx * nx + ny * ny + nz * nz), 1e-6) AS g FROM cand)),\ne AS (SELECT s.id AS a, t.id AS b FROM u s JOIN u t ON s.id < t.id WHERE sqrt((s.px - t.px) * (s.px - t.px) + (s.py - t.py) * (s.py - t.py) + (s.pz - t.pz) * (s.pz - t.pz)) < 4.0 AND abs(s.nx * t.nx + s.ny * t.ny + s.nz * t.nz) >= 0.8)"
MORPH = lambda src, dst, grow: f"{dst} AS (SELECT a.tile, a.r, a.c, " + ("bool_or(coalesce(b.m, false))" if grow else "bool_and(coalesce(b.m, false))") + f" AS m FROM (SELECT * FROM {src}, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)) a LEFT JOIN {src} b ON a.tile = b.tile AND b.r = a.r + a.dr AND b.c = a.c + a.dc GROUP BY ALL)"

SQL = {
    "q_affine": with_sql("cand") + " SELECT candidate_id, " + R3(["px / 2 - 1", "py / 4 - 2", "pz / 8 - 3", "px", "py", "pz"], ["qx", "qy", "qz", "wx", "wy", "wz"]) + " FROM cand",
    "q_normalize": with_sql("cand") + " SELECT candidate_id, " + R3([f"n{k} / greatest(l, 1e-6)" for k in "xyz"] + [f"n{k} / (l + 1e-6)" for k in "xyz"] + ["l"], ["ax", "ay", "az", "bx", "by", "bz", "len"]) + " FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM cand)",
    "q_tangent_frame": with_sql("cand") + ",\n" + FRAME + " SELECT candidate_id, " + R3(["ux", "uy", "uz", "vx", "vy", "vz"], ["ux", "uy", "uz", "vx", "vy", "vz"]) + " FROM fr",
    "q_local_frame": with_sql("cand") + """, a AS (SELECT candidate_id, px / l AS tx, py / l AS ty, pz / l AS tz, nx, ny, nz FROM (SELECT *, greatest(sqrt(px * px + py * py + pz * pz), 1e-6) AS l FROM cand)),
b AS (SELECT *, nx - tx * s AS mx, ny - ty * s AS my, nz - tz * s AS mz FROM (SELECT *, nx * tx + ny * ty + nz * tz AS s FROM a)),
c AS (SELECT *, mx / l AS ex, my / l AS ey, mz / l AS ez FROM (SELECT *, greatest(sqrt(mx * mx + my * my + mz * mz), 1e-6) AS l FROM b))
SELECT candidate_id, """ + R3(["tx", "ty", "tz", "ey * tz - ez * ty", "ez * tx - ex * tz", "ex * ty - ey * tx", "ex", "ey", "ez"], ["e1x", "e1y", "e1z", "e2x", "e2y", "e2z", "e3x", "e3y", "e3z"]) + " FROM c",
    "q_trilinear": with_sql("cand", "vox") + ",\n" + LOCAL + ", pts AS (SELECT candidate_id, candidate_id AS vol, px AS qx, py AS qy, pz AS qz FROM loc),\n" + sampled("pts", "s", "candidate_id") + " SELECT candidate_id, round(s, 6) + 0.0 AS sample FROM s",
    "q_ray_argmax": with_sql("cand", "vox") + ",\n" + LOCAL + ", pts AS (SELECT candidate_id, candidate_id AS vol, k, -1.5 + k * 0.375 AS o, px + nx * (-1.5 + k * 0.375) AS qx, py + ny * (-1.5 + k * 0.375) AS qy, pz + nz * (-1.5 + k * 0.375) AS qz FROM loc, range(9) t(k)),\n" + sampled("pts", "s", "candidate_id, k, o") + " SELECT candidate_id, round(o, 6) + 0.0 AS \"offset\", round(s, 6) + 0.0 AS sample FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY round(s, 9) DESC, k) AS i FROM s) WHERE i = 1",
    "q_depth_stack": with_sql("cand", "vox") + ",\n" + LOCAL + ", pts AS (SELECT candidate_id, candidate_id AS vol, k, score > -0.1 AS valid, px + nx * (k / 2.0::DOUBLE - 1) AS qx, py + ny * (k / 2.0::DOUBLE - 1) AS qy, pz + nz * (k / 2.0::DOUBLE - 1) AS qz FROM loc, range(5) t(k)),\n" + sampled("pts", "s", "candidate_id, k, valid") + " SELECT candidate_id, k, CASE WHEN valid THEN round(s, 6) + 0.0 ELSE 0.0 END AS sample FROM s",
    "q_interp_normal": with_sql("cand", "vox") + ",\n" + LOCAL + ",\n" + GRAD + """,
c AS (SELECT candidate_id, greatest(0, least(3, floor(pz)::INT + b // 4)) AS z, greatest(0, least(3, floor(py)::INT + (b // 2) % 2)) AS y, greatest(0, least(3, floor(px)::INT + b % 2)) AS x,
  (CASE WHEN b // 4 = 1 THEN pz - floor(pz) ELSE 1 - pz + floor(pz) END) * (CASE WHEN (b // 2) % 2 = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END)
  * (CASE WHEN b % 2 = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS w FROM loc, range(8) t(b)),
s AS (SELECT candidate_id, sum(w * gx) AS sx, sum(w * gy) AS sy, sum(w * gz) AS sz FROM c JOIN g ON g.vol = c.candidate_id AND g.z = c.z AND g.y = c.y AND g.x = c.x GROUP BY ALL)
SELECT candidate_id, """ + R3([f"s{k} / greatest(sqrt(sx * sx + sy * sy + sz * sz), 1e-6)" for k in "xyz"], ["nx", "ny", "nz"]) + " FROM s",
    "q_tile_texture": with_sql("cand", "vox") + ",\n" + LOCAL + ",\n" + FRAME + """,
pts AS (SELECT l.candidate_id, l.candidate_id AS vol, d, r, c, l.px + fr.ux * (c - 1) * 0.5 + fr.vx * (r - 1) * 0.5 + l.nx * (d - 0.5) AS qx,
  l.py + fr.uy * (c - 1) * 0.5 + fr.vy * (r - 1) * 0.5 + l.ny * (d - 0.5) AS qy, l.pz + fr.uz * (c - 1) * 0.5 + fr.vz * (r - 1) * 0.5 + l.nz * (d - 0.5) AS qz
  FROM loc l JOIN fr ON l.candidate_id = fr.candidate_id, range(2) a(d), range(3) b(r), range(3) e(c)),\n""" + sampled("pts", "s", "candidate_id, d, r, c") + """,
v AS (SELECT candidate_id, CASE WHEN s > 0.5 THEN round(s, 9) ELSE 0.0 END AS v FROM s),
t AS (SELECT candidate_id, count(*) AS n, avg((v > 0)::INT::DOUBLE) AS a, coalesce(stddev_pop(CASE WHEN v > 0 THEN v END), 0.0) AS b FROM v GROUP BY ALL)
SELECT candidate_id, n, round(a, 6) + 0.0 AS ct_nonzero, round(b, 6) + 0.0 AS ct_std, round(round(2 * a + 0.025 * b, 9), 6) + 0.0 AS score FROM t ORDER BY round(2 * a + 0.025 * b, 9) DESC, candidate_id LIMIT 20""",
    "q_crop_box": with_sql("cand") + " SELECT candidate_id, " + ", ".join(f"least(greatest(floor(p{k})::BIGINT - 5, 0), 22)::BIGINT AS lo_{k}, least(least(greatest(floor(p{k})::BIGINT - 5, 0), 22) + 10, 32)::BIGINT AS hi_{k}" for k in "zyx") + " FROM cand",
    "q_support": with_sql("cand", "vox") + ",\n" + LOCAL + ", pts AS (SELECT candidate_id, candidate_id AS vol, px AS qx, py AS qy, pz AS qz FROM loc),\n" + sampled("pts", "s", "candidate_id") + " SELECT s.candidate_id, round(s, 6) + 0.0 AS support, round(score, 6) + 0.0 AS score FROM s JOIN cand ON s.candidate_id = cand.candidate_id WHERE s >= 0.5 ORDER BY cand.score DESC, s.candidate_id LIMIT 50",
    "q_gaussian": with_sql("vox") + ",\n" + gaussian_sql("vox", "s", "vol", AXES, 0.6, "v", 4) + f" SELECT {CELL3}, round(v, 6) + 0.0 AS v FROM s",
    "q_gradient": with_sql("vox") + ",\n" + GRAD + f" SELECT {CELL3}, " + R3(["gz", "gy", "gx"], ["gz", "gy", "gx"]) + " FROM g",
    "q_localmax": with_sql("vox") + f" SELECT a.vol, a.z::BIGINT AS z, a.y::BIGINT AS y, a.x::BIGINT AS x, round(a.v, 6) + 0.0 AS v FROM vox a JOIN vox b ON a.vol = b.vol AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.v >= 0.55 GROUP BY a.vol, a.z, a.y, a.x, a.v HAVING max(round(b.v, 9)) = round(a.v, 9)",
    "q_seed_argmax": with_sql("vox") + f" SELECT {CELL3}, round(v, 6) + 0.0 AS v FROM (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY v DESC, z, y, x) AS i FROM vox WHERE z BETWEEN 1 AND 2 AND y BETWEEN 1 AND 2 AND x BETWEEN 1 AND 2) WHERE i = 1",
    "q_sobel": with_sql("tile") + ", n AS (SELECT a.tile, a.r, a.c, dr, dc, b.v FROM tile a, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) JOIN tile b ON b.tile = a.tile AND b.r = greatest(0, least(7, a.r + dr)) AND b.c = greatest(0, least(7, a.c + dc))) " + f"SELECT {CELL2}, round(sum(v * dr * (2 - abs(dc))), 6) + 0.0 AS sr, round(sum(v * dc * (2 - abs(dr))), 6) + 0.0 AS sc FROM n GROUP BY tile, r, c",
    "q_coherence": with_sql("tile") + ", n AS (SELECT a.tile, a.r, a.c, dr, dc, b.v FROM tile a, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) JOIN tile b ON b.tile = a.tile AND b.r = greatest(0, least(7, a.r + dr)) AND b.c = greatest(0, least(7, a.c + dc))),\ns AS (SELECT tile, r, c, sum(v * dr * (2 - abs(dc))) AS sr, sum(v * dc * (2 - abs(dr))) AS sc FROM n GROUP BY tile, r, c),\nj AS (SELECT tile, r, c, sc * sc AS jxx, sr * sr AS jyy, sr * sc AS jxy FROM s),\n" + ",\n".join(gaussian_sql("j", f"o{k}", "tile", ["r", "c"], 0.6, f"j{k}", 8) for k in ("xx", "yy", "xy")) + " SELECT a.tile, round(avg(sqrt((jxx - jyy) * (jxx - jyy) + 4 * jxy * jxy) / (jxx + jyy + 1e-6)), 6) + 0.0 AS coherence FROM oxx a JOIN oyy b ON a.tile = b.tile AND a.r = b.r AND a.c = b.c JOIN oxy d ON a.tile = d.tile AND a.r = d.r AND a.c = d.c GROUP BY a.tile",
    "q_best_focus": with_sql("vox") + ",\n" + gaussian_sql("vox", "s", "vol, z", ["y", "x"], 0.6, "v", 4) + " SELECT vol, y::BIGINT AS y, x::BIGINT AS x, round(v, 6) + 0.0 AS v, round(f, 6) + 0.0 AS focus FROM (SELECT a.vol, a.y, a.x, a.v, round(abs(a.v - s.v), 9) AS f, row_number() OVER (PARTITION BY a.vol, a.y, a.x ORDER BY round(abs(a.v - s.v), 9) DESC, a.z) AS i FROM vox a JOIN s ON a.vol = s.vol AND a.z = s.z AND a.y = s.y AND a.x = s.x) WHERE i = 1",
    "q_depth_reductions": with_sql("vox") + " SELECT vol, y::BIGINT AS y, x::BIGINT AS x, round(avg(v), 6) + 0.0 AS mean, round(max(v), 6) + 0.0 AS max, round(min(v), 6) + 0.0 AS min, round(stddev_pop(v), 6) + 0.0 AS std FROM vox GROUP BY vol, y, x",
    "q_neighbour_mean": with_sql("tile") + f" SELECT a.tile, a.r::BIGINT AS r, a.c::BIGINT AS c, CASE WHEN count(*) FILTER (b.v > 0) > 0 THEN round(sum(b.v) / count(*) FILTER (b.v > 0), 6) + 0.0 END AS mean4 FROM tile a JOIN tile b ON a.tile = b.tile AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY a.tile, a.r, a.c",
    "q_closing": with_sql("tile") + ", m0 AS (SELECT tile, r, c, v > 12 AS m FROM tile),\n" + MORPH("m0", "m1", True) + ",\n" + MORPH("m1", "m2", False) + " SELECT tile, count(*) FILTER (m) AS n, sum(CASE WHEN m THEN r * 8 + c ELSE 0 END)::BIGINT AS places FROM m2 GROUP BY tile",
    "q_dilate": with_sql("tile") + " SELECT tile, count(*) FILTER (m) AS n, sum(CASE WHEN m THEN r * 8 + c ELSE 0 END)::BIGINT AS places FROM (SELECT a.tile, a.r, a.c, bool_or(b.v > 25) AS m FROM tile a JOIN tile b ON a.tile = b.tile AND abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY a.tile, a.r, a.c) GROUP BY tile",
    "q_stretch": with_sql("tile") + f", e AS (SELECT tile, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM tile GROUP BY tile) SELECT tile.tile, r::BIGINT AS r, c::BIGINT AS c, round(greatest(0.0, least(1.0, (v - lo) / greatest(hi - lo, 1e-6))), 6) + 0.0 AS stretched FROM tile JOIN e ON tile.tile = e.tile",
    "q_texture": with_sql("tile") + " SELECT tile, count(*) AS n, round(avg((v > 0)::INT::DOUBLE), 6) + 0.0 AS ct_nonzero, round(coalesce(stddev_pop(CASE WHEN v > 0 THEN v END), 0.0), 6) + 0.0 AS ct_std FROM tile GROUP BY tile",
    "q_ink": with_sql("tile") + " SELECT tile, round(avg(v), 6) + 0.0 AS ink_mean, round(stddev_pop(v), 6) + 0.0 AS ink_std, round(quantile_cont(v, 0.99), 6) + 0.0 AS ink_p99 FROM tile GROUP BY tile",
    "q_components": with_sql("vox").replace("WITH ", "WITH RECURSIVE ", 1) + ", b AS (SELECT vol, z, y, x, z * 16 + y * 4 + x AS o FROM vox WHERE v >= 0.53), e AS (SELECT s.vol, s.o AS s, t.o AS t FROM b s JOIN b t ON s.vol = t.vol AND abs(s.z - t.z) <= 1 AND abs(s.y - t.y) <= 1 AND abs(s.x - t.x) <= 1 AND abs(s.z - t.z) + abs(s.y - t.y) + abs(s.x - t.x) <= 2), r(vol, o, m) AS (SELECT vol, o, o FROM b UNION SELECT r.vol, r.o, e.t FROM r JOIN e ON r.vol = e.vol AND r.m = e.s), l AS (SELECT vol, o, min(m) AS label FROM r GROUP BY vol, o), n AS (SELECT vol, label, count(*) AS n FROM l GROUP BY vol, label) SELECT vol, n, label::BIGINT AS first FROM (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY n DESC, label) AS i FROM n) WHERE i = 1",
    "q_fill_holes": with_sql("tile").replace("WITH ", "WITH RECURSIVE ", 1) + ", b AS (SELECT tile, r, c FROM tile WHERE v <= 2), o(tile, r, c) AS (SELECT * FROM b WHERE r IN (0, 7) OR c IN (0, 7) UNION SELECT b.tile, b.r, b.c FROM o JOIN b ON o.tile = b.tile AND abs(o.r - b.r) + abs(o.c - b.c) = 1) SELECT t.tile, 64 - count(o.r) AS n FROM (SELECT DISTINCT tile FROM tile) t LEFT JOIN o ON t.tile = o.tile GROUP BY t.tile",
    "q_nms_edges": with_sql("cand") + ",\n" + CONFLICTS + " SELECT a, b FROM e",
    "q_nms": with_sql("cand").replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + CONFLICTS + """,
o AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS i FROM u),
x AS (SELECT id, list(other) AS against FROM (SELECT a AS id, b AS other FROM e UNION ALL SELECT b, a FROM e) GROUP BY id),
p(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.i, CASE WHEN len(list_intersect(p.kept, coalesce(x.against, []))) > 0 THEN p.kept ELSE list_append(p.kept, o.id) END FROM p JOIN o ON o.i = p.i + 1 LEFT JOIN x ON x.id = o.id)
SELECT candidate_id, round(score, 6) + 0.0 AS score FROM cand WHERE list_contains((SELECT kept FROM p ORDER BY i DESC LIMIT 1), candidate_id)""",
    "q_sheets": with_sql("cand") + ", s AS (SELECT *, ntile(4) OVER (PARTITION BY label ORDER BY px, candidate_id) - 1 AS sheet FROM cand), n AS (SELECT *, row_number() OVER (PARTITION BY label, sheet ORDER BY px, candidate_id) - 1 AS place, count(*) OVER (PARTITION BY label, sheet) AS n FROM s) SELECT label, sheet::BIGINT AS sheet, candidate_id, round(px, 6) + 0.0 AS axis FROM n WHERE list_contains(list_transform(range(5), lambda k: (k * (n - 1)) // 4), place)",
    "q_covariance": with_sql("cand") + " SELECT label, count(*) AS n, " + R3([f"avg(p{k})" for k in "xyz"] + [f"covar_pop(p{a}, p{b})" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")], ["mx", "my", "mz", "cxx", "cyy", "czz", "cxy", "cxz", "cyz"]) + " FROM cand GROUP BY label",
    "q_slab": with_sql("cand") + ", w AS (SELECT label, list_filter([0.25, 0.5, 1.0, 2.0, 4.0]::DOUBLE[], lambda q: len(list_filter(list(abs(pz - 16)), lambda e: e <= q)) >= 12)[1] AS width FROM cand GROUP BY label) SELECT w.label, width, count(*) AS n, round(avg(pz - 16), 6) + 0.0 AS mean_depth FROM cand JOIN w ON cand.label = w.label WHERE abs(pz - 16) <= width GROUP BY w.label, width",
    "q_multisort": with_sql("tile") + " SELECT tile, round(stddev_pop(v), 6) + 0.0 AS s, round(quantile_cont(v, 0.99), 6) + 0.0 AS p FROM tile GROUP BY tile ORDER BY s DESC, p DESC, tile LIMIT 100",
    "q_richness": with_sql("tile") + " SELECT tile, round(2 * avg((v > 0)::INT::DOUBLE) + coalesce(stddev_pop(CASE WHEN v > 0 THEN v END), 0.0) / 50 + (quantile_cont(v, 0.99) - quantile_cont(v, 0.01)) / 100, 6) + 0.0 AS combined FROM tile GROUP BY tile",
}

HESSIAN = (
    "h AS (SELECT vol, z, y, x, v, " + ", ".join(f"coalesce((fg{a}{b} - bg{a}{b}) / 2, fg{a}{b} - g{a}, g{a} - bg{a}{b}, 0.0) AS h{a}{b}" for a in AXES for b in AXES)
    + " FROM (SELECT *, " + ", ".join(f"lag(g{a}) OVER (PARTITION BY vol, {', '.join(o for o in AXES if o != b)} ORDER BY {b}) AS bg{a}{b}, lead(g{a}) OVER (PARTITION BY vol, {', '.join(o for o in AXES if o != b)} ORDER BY {b}) AS fg{a}{b}" for a in AXES for b in AXES)
    + " FROM g)),\ns AS (SELECT vol, z, y, x, v, hxx AS axx, hyy AS ayy, hzz AS azz, (hxy + hyx) / 2 AS axy, (hxz + hzx) / 2 AS axz, (hyz + hzy) / 2 AS ayz, (hxx + hyy + hzz) / 3 AS q FROM h),\n"
    "t AS (SELECT *, sqrt(((axx - q) * (axx - q) + (ayy - q) * (ayy - q) + (azz - q) * (azz - q) + 2 * (axy * axy + axz * axz + ayz * ayz)) / 6) AS p FROM s),\n"
    "b AS (SELECT *, (axx - q) / greatest(p, 1e-300) AS bxx, (ayy - q) / greatest(p, 1e-300) AS byy, (azz - q) / greatest(p, 1e-300) AS bzz, axy / greatest(p, 1e-300) AS bxy, axz / greatest(p, 1e-300) AS bxz, ayz / greatest(p, 1e-300) AS byz FROM t),\n"
    "c AS (SELECT *, acos(greatest(-1.0, least(1.0, (bxx * (byy * bzz - byz * byz) - bxy * (bxy * bzz - byz * bxz) + bxz * (bxy * byz - byy * bxz)) / 2))) / 3 AS w FROM b),\n"
    "ev AS (SELECT vol, z, y, x, v, q + 2 * p * cos(w) AS e1, q + 2 * p * cos(w + 2 * pi() / 3) AS e3, 3 * q - (q + 2 * p * cos(w)) - (q + 2 * p * cos(w + 2 * pi() / 3)) AS e2 FROM c)"
)
SQL["q_crop_score"] = with_sql("vox").replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT vol, z, y, x, z * 16 + y * 4 + x AS o FROM vox WHERE v > 0.5),
e AS (SELECT s.vol, s.o AS s, t.o AS t FROM b s JOIN b t ON s.vol = t.vol AND abs(s.z - t.z) + abs(s.y - t.y) + abs(s.x - t.x) = 1),
r(vol, o, m) AS (SELECT vol, o, o FROM b UNION SELECT r.vol, r.o, e.t FROM r JOIN e ON r.vol = e.vol AND r.m = e.s),
l AS (SELECT vol, max(n) AS largest FROM (SELECT vol, label, count(*) AS n FROM (SELECT vol, o, min(m) AS label FROM r GROUP BY vol, o) GROUP BY vol, label) GROUP BY vol),
a AS (SELECT vol, avg((v > 0.5)::INT::DOUBLE) AS o, avg(CASE WHEN z IN (1, 2) AND y IN (1, 2) AND x IN (1, 2) THEN (v > 0.5)::INT::DOUBLE END) AS i,
  avg(CASE WHEN z IN (1, 2) AND y IN (1, 2) AND x IN (1, 2) THEN 0.0::DOUBLE ELSE (v > 0.5)::INT::DOUBLE END) AS e, quantile_cont(v, 0.99) - quantile_cont(v, 0.5) AS c FROM vox GROUP BY vol)
SELECT a.vol, round(o, 6) + 0.0 AS occupancy, round(i, 6) + 0.0 AS interior_fraction, round(e, 6) + 0.0 AS boundary_fraction,
  round(4 * least(i, 0.2) + 2 * least(coalesce(largest, 0) / 64, 0.2) + c - 1.5 * e - 2 * greatest(0, o - 0.35), 6) + 0.0 AS score, coalesce(largest, 0)::BIGINT AS largest FROM a LEFT JOIN l ON a.vol = l.vol"""
SQL["q_choose"] = with_sql("cand") + " SELECT candidate_id, round(score, 6) + 0.0 AS score FROM cand ORDER BY md5('7:' || candidate_id), candidate_id LIMIT 50"
SQL["q_strided"] = with_sql("vox") + """, s AS (SELECT vol, z // 2 AS z, y // 2 AS y, x // 2 AS x, v FROM vox WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0),
b AS (SELECT *, z AS own FROM s), k AS (SELECT b.*, o.band FROM b, (SELECT unnest([0, 1]) AS band) o WHERE abs(b.own - o.band) <= 1)
SELECT vol, band::BIGINT AS band, count(*) AS n, count(*) FILTER (own = band) AS core, round(sum(v), 6) + 0.0 AS total FROM k GROUP BY vol, band"""
SQL["q_hessian"] = with_sql("vox") + ",\n" + GRAD + ",\n" + HESSIAN + f" SELECT {CELL3}, round(e1, 5) + 0.0 AS e1, round(e2, 5) + 0.0 AS e2, round(e3, 5) + 0.0 AS e3 FROM ev"
SQL["q_ridge"] = with_sql("vox") + ",\n" + GRAD + ",\n" + HESSIAN + ", l AS (SELECT vol, quantile_cont(CASE WHEN -e3 > 0 THEN -e3 END, 0.15) AS least FROM ev GROUP BY vol) SELECT ev.vol, count(*) AS n, round(max(-e3), 5) + 0.0 AS most FROM ev JOIN l ON ev.vol = l.vol WHERE v >= 0.15 AND (abs(e3) - abs(e2)) / (abs(e3) + 1e-6) >= 0.25 AND -e3 >= least GROUP BY ev.vol"

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
