"""The four-phase search as plans: generate, score, suppress, select. Each phase is a table.

generate: smooth, local maxima above a threshold, support filter, normals, the best k.
score: sample a tile across each candidate's normal, texture (and a user's scorer), status.
suppress: spatial non-maximum suppression by score and normal.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfacelab.functions import vec as V
from surfacelab.operators import metrics, ranking, sampling, stencil
from surfacelab.operators.rounds import cut
from surfacelab.plans.points import r6
from surfacelab.sources.derived import voxels
from surfacelab.streaming.resume import with_status

AXES = ["z", "y", "x"]


#: Layers of z whose maxima are ranked together first.
SLAB = 64


def flat_normals(found: DataFrame, volume: DataFrame, threshold: float, reach: int = 2, least: int = 6) -> DataFrame:
    """vol, z, y, x, flat: the direction in which the bright voxels around a candidate spread least.

    Fewer than least bright voxels give the z axis. Voxels are met by an equi-join of the cube's
    offsets and reduced to means and covariances; only the 3x3 eigenvectors need numpy.
    """
    side = F.sequence(F.lit(-reach), F.lit(reach))
    near = found.select("vol", *[F.col("p")[k].cast("int").alias(k + "0") for k in AXES])
    place = ["vol", *[k + "0" for k in AXES]]
    for k in AXES:
        near = near.select("*", F.explode(side).alias("d" + k)).withColumn(k, F.col(k + "0") + F.col("d" + k)).drop("d" + k)
    bright = volume.where(F.col("v") >= threshold).select("vol", *AXES)
    points = near.join(bright, ["vol", *AXES]).select(*place, V.vec("x", "y", "z").alias("p"))
    cov = metrics.covariance(points, place).where(F.col("n") >= least)

    def axes(batches):
        for b in batches:
            m = np.array([[[r.cxx, r.cxy, r.cxz], [r.cxy, r.cyy, r.cyz], [r.cxz, r.cyz, r.czz]] for r in b.itertuples()]).reshape(-1, 3, 3)
            n = np.linalg.eigh(m)[1][:, :, 0]
            # A vector's sign is free; its largest part is made positive.
            n = n * np.sign(n[np.arange(len(n)), np.abs(n).argmax(axis=1)])[:, None]
            yield b[place].assign(nx=n[:, 0], ny=n[:, 1], nz=n[:, 2])

    return cov.mapInPandas(axes, "vol long, z0 int, y0 int, x0 int, nx double, ny double, nz double").select(F.struct("vol", *[F.col(k + "0").alias(k) for k in AXES]).alias("candidate_id"), V.vec("nx", "ny", "nz").alias("flat"))


def generate(volume: DataFrame, threshold: float, k: int, radius: int = 1, sigma: float = 0.6, support: DataFrame | None = None, minimum: float = 0.5, border: int = 0, extent: int | None = None) -> DataFrame:
    """candidate_id, vol, p, n, score of the k strongest local maxima of each volume; the id is (vol, z, y, x)."""
    smooth = cut(stencil.gaussian(volume, ["vol"], AXES, sigma))
    best = stencil.local_maxima(smooth, ["vol"], AXES, radius, threshold, border, extent)
    grads = stencil.gradient(smooth, ["vol"], AXES).select("vol", *AXES, V.vec("gx", "gy", "gz").alias("g"))
    place = F.struct("vol", *AXES).alias("candidate_id")
    rows = best.join(grads, ["vol", *AXES]).select(place, "vol", V.vec("x", "y", "z").alias("p"), "g", F.round("v", 9).alias("score"))
    if support is not None:
        rows = sampling.support_filter(rows, support, ["candidate_id"], minimum)
    # The best k of each slab first, so that one large volume's maxima are many tasks' work.
    for part in (["vol", F.floor(F.col("p.z") / SLAB)], ["vol"]):
        first = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("score"), "candidate_id"))
        rows = rows.withColumn("rank", first).where(F.col("rank") <= k).drop("rank")
    rows = cut(rows).withColumn("steep", V.norm("g"))
    flat = flat_normals(rows.where("steep < 1e-6"), smooth, threshold)
    up = V.vec(F.lit(0), F.lit(0), F.lit(1))
    n = F.when(F.col("steep") < 1e-6, F.coalesce("flat", up)).otherwise(V.normalize("g"))
    return rows.join(flat, "candidate_id", "left").withColumn("n", n).drop("g", "steep", "flat")


def score(found: DataFrame, volume: DataFrame, size: int = 3, depth: int = 2, spacing: float = 0.5, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """found with texture metrics, score and status; scorer may add ink metrics from the samples.

    Beside the share and spread of what is there: of the layer furthest from its own blur at each place, the spread (focus) and the mean
    coherence of its smoothed structure tensor.
    """
    keys, axes = ["candidate_id"], ["r", "c"]
    lattice = sampling.tile_lattice(found, size, depth, spacing)
    got = cut(sampling.sample(lattice, volume, [*keys, "d", *axes], "q").select(*keys, "d", *axes, F.round("sample", 9).alias("v")))
    blurred = stencil.gaussian(got, [*keys, "d"], axes, 1.2).withColumnRenamed("v", "blur")
    best = cut(metrics.best_focus(got, blurred, keys, axes, "d").select(*keys, *axes, "v"))
    there = F.col("v") > 0
    sharp = stencil.coherence(best, keys, axes, 2.0).groupBy(*keys).agg(
        F.coalesce(F.stddev_pop(F.when(there, F.col("v"))), F.lit(0.0)).alias("focus_std"), F.coalesce(F.avg(F.when(there, F.col("coherence"))), F.lit(0.0)).alias("fiber_coherence")
    )
    rows = found.withColumnRenamed("score", "surface_score").join(metrics.texture(got, keys).drop("n"), "candidate_id").join(sharp, "candidate_id")
    rows = rows.join(scorer(got), "candidate_id") if scorer is not None else rows.withColumns({c: F.lit(0.0) for c in ("ink_mean", "ink_std", "ink_p99")})
    return with_status(rows, V.combined_score(), "score", F.col("ct_nonzero") < 0.05)


def search(volume: DataFrame, threshold: float, k: int, distance: float, similarity: float = 0.8) -> DataFrame:
    """The kept candidates of the whole search; only candidates of one volume suppress each other."""
    found = cut(generate(volume, threshold, k))
    scored = cut(score(found, volume))
    return ranking.suppress(scored.where("status = 'scored'"), distance, similarity, within="vol")


def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = search(voxels(spark, sf_dir), 0.52, 2000, 2.5)
    return got.select("vol", *[F.col("candidate_id")[k].cast("long").alias(k) for k in AXES], r6("score", "score"), "status")


QUERIES = {"q_search": q_search}
