"""Texture, ink, geometry, quality and detection metrics as aggregates."""

from __future__ import annotations

import math

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfacelab.functions.vec import cross, norm, normalize, sub, vec
from surfacelab.operators.ranking import running_sums
from surfacelab.operators.rounds import label_cells
from surfacelab.operators.stencil import gradient


def texture(cells: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """ct_nonzero, ct_std (of nonzero cells, population) and n."""
    v = F.col(value)
    return cells.groupBy(*keys).agg(
        F.avg((v > 0).cast("double")).alias("ct_nonzero"), F.coalesce(F.stddev_pop(F.when(v > 0, v)), F.lit(0.0)).alias("ct_std"), F.count(F.lit(1)).alias("n")
    )


def ink(cells: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    return cells.groupBy(*keys).agg(F.avg(value).alias("ink_mean"), F.stddev_pop(value).alias("ink_std"), F.percentile(value, F.lit(0.99)).alias("ink_p99"))


def best_focus(layers: DataFrame, blurred: DataFrame, keys: list[str], axes: list[str], layer: str = "k") -> DataFrame:
    """For each pixel the value of the layer furthest from its blurred self, the first on ties."""
    far = F.round(F.abs(F.col("v") - F.col("blur")), 9)
    rows = layers.join(blurred, [*keys, layer, *axes])
    return rows.groupBy(*keys, *axes).agg(F.max_by("v", F.struct(far, (-F.col(layer)).alias("o"))).alias("v"), F.max(far).alias("focus"))


def depth_reductions(layers: DataFrame, keys: list[str]) -> DataFrame:
    return layers.groupBy(*keys).agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"), F.stddev_pop("v").alias("std"))


def covariance(points: DataFrame, keys: list[str]) -> DataFrame:
    """Means and population covariances of p: one pass, nine sums."""
    p = F.col("p")
    means = [F.avg(p[k]).alias("m" + k) for k in "xyz"]
    covs = [F.covar_pop(p[a], p[b]).alias("c" + a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *means, *covs)


def widening_slab(points: DataFrame, keys: list[str], depth: str, widths: tuple[float, ...], least: int) -> DataFrame:
    """Points within the first half-width that holds at least so many; all widths are counted in one pass."""
    counts = [F.count_if(F.abs(depth) <= w) for w in widths]
    choice = F.lit(None).cast("double")
    for w, n in list(zip(widths, counts))[::-1]:
        choice = F.when(n >= least, F.lit(float(w))).otherwise(choice)
    return points.join(points.groupBy(*keys).agg(choice.alias("width")), keys).where(F.abs(depth) <= F.col("width"))


def jump_flags(grid: DataFrame, factor: float = 3.0) -> DataFrame:
    """Grid cells with right, down (edges to valid neighbours), bad_right, bad_down, quad, folded and defect.

    An edge is bad beyond factor times its grid's median edge. The square to the lower right of a cell is a quad if its four
    corners are valid, and folded if its area vector doesn't point the way of the grid's mean one. A cell is a defect at either end
    of a bad edge or at any corner of a folded quad.
    """
    across, along = Window.partitionBy("grid", "r").orderBy("c"), Window.partitionBy("grid", "c").orderBy("r")

    def ahead(x, w: Window, axis: str):
        return F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(x).over(w))

    def behind(x: str, w: Window, axis: str):
        return F.coalesce(F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(x).over(w)), F.lit(False))

    def both(x):
        return F.col("valid") & F.coalesce(x, F.lit(False))

    rows = grid.select("*", ahead("p", across, "c").alias("p_right"), ahead("p", along, "r").alias("p_down"), both(ahead("valid", across, "c")).alias("has_right"), both(ahead("valid", along, "r")).alias("has_down"))
    du, dv = sub("p_right", "p"), sub("p_down", "p")
    rows = rows.withColumn("quad", F.col("has_right") & F.col("has_down") & F.coalesce(ahead("has_right", along, "r"), F.lit(False)))
    rows = rows.select("*", F.when(F.col("has_right"), norm(du)).alias("right"), F.when(F.col("has_down"), norm(dv)).alias("down"), F.when(F.col("quad"), cross(du, dv)).alias("area"))
    edges = rows.select("grid", F.explode(F.array("right", "down")).alias("s")).where("s IS NOT NULL").groupBy("grid").agg(F.percentile("s", F.lit(0.5)).alias("median"))
    means = rows.groupBy("grid").agg(*[F.avg(F.col("area")[k]).alias("m" + k) for k in "xyz"])
    rows = rows.join(edges, "grid", "left").join(means, "grid", "left")
    turn = sum((F.col("area")[k] * F.col("m" + k) for k in "xyz"), F.lit(0.0))

    def bad(x: str):
        return F.coalesce((F.col("median") > 0) & (F.col(x) > factor * F.col("median")), F.lit(False))

    rows = rows.select("*", bad("right").alias("bad_right"), bad("down").alias("bad_down"), (F.col("quad") & F.coalesce(turn <= 0, F.lit(False))).alias("folded"))
    rows = rows.withColumn("side", F.col("folded") | behind("folded", across, "c"))
    defect = F.col("bad_right") | F.col("bad_down") | behind("bad_right", across, "c") | behind("bad_down", along, "r") | F.col("side") | behind("side", along, "r")
    return rows.withColumn("defect", defect).drop("p_right", "p_down", "has_right", "has_down", "area", "mx", "my", "mz", "side")


def geometry(flags: DataFrame) -> DataFrame:
    """grid, coverage (valid cells of the sheet), jump_fraction (of edges) and folded_fraction (of quads).

    The sheet is where the column sheet holds; without one it is every cell of the grid.
    """
    sheet = F.count_if("sheet") if "sheet" in flags.columns else F.count(F.lit(1))
    edges = F.count("right") + F.count("down")
    return flags.groupBy("grid").agg(
        (F.count_if("valid") / F.greatest(sheet, F.lit(1))).alias("coverage"),
        ((F.count_if("bad_right") + F.count_if("bad_down")) / F.greatest(edges, F.lit(1))).alias("jump_fraction"),
        (F.count_if("folded") / F.greatest(F.count_if("quad"), F.lit(1))).alias("folded_fraction"),
    )


def gates(metrics: DataFrame) -> DataFrame:
    """metrics with passed: coverage, adherence, folds and jumps within their limits."""
    c = F.col
    return metrics.withColumn("passed", (c("coverage") >= 0.99) & (c("adherence") >= 0.95) & (c("folded_fraction") < 0.001) & (c("jump_fraction") < 0.01))


def ridge_gates(metrics: DataFrame, least: int = 100) -> DataFrame:
    """metrics (seed_distance, normal_p01, edge_outliers, loops, euler, vertices) of ridge patches with passed: near the seed, smooth, a disk and large enough."""
    c = F.col
    smooth = (c("normal_p01") >= math.cos(math.radians(50))) & (c("edge_outliers") <= 0.01)
    return metrics.withColumn("passed", F.coalesce((c("seed_distance") <= 5) & smooth & (c("loops") == 1) & (c("euler") == 1) & (c("vertices") >= least), F.lit(False)))


def auroc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """positives, negatives, auroc and means of scores (label 0 or 1), by average ranks.

    Ranks come from counts of each distinct score, so ties are one row and no group of equal
    scores is sorted; what lies below a score is summed over ranges of scores, so that one key's scores are many tasks' work.
    """
    counts = scored.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    ranked = running_sums(counts, keys, ["score"], "q", "below")
    sums = ranked.groupBy(*keys).agg(
        F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("won"),
        (F.sum(F.col("p") * F.col("score")) / F.nullif(F.sum("p"), F.lit(0))).alias("mean_pos"), (F.sum(F.col("q") * F.col("score")) / F.nullif(F.sum("q"), F.lit(0))).alias("mean_neg"),
    )
    return sums.withColumn("auroc", F.col("won") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).drop("won")


def rates_above(scored: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Share of negatives that score at or above each threshold."""
    at = [F.avg((F.col("score") >= t).cast("double")).alias(f"at_{i}") for i, t in enumerate(thresholds)]
    return scored.where("label = 0").groupBy(*keys).agg(*at)


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def crop_score(cells: DataFrame, keys: list[str], level: float, edge: int, margin: int = 10, key: str | None = None) -> DataFrame:
    """occupancy, largest (cells of the largest component), interior_fraction, boundary_fraction and score of crops.

    cells: (keys, z, y, x, v) with indices from 0 to edge - 1; a cell is occupied above level. The boundary is
    what lies within margin of a face, its fraction is of the whole crop. key: one of keys, where few cells share it.
    """
    axes = ["z", "y", "x"]
    rows = cells.withColumn("on", F.col("v") > level)
    inner = reduce(lambda a, b: a & b, [F.col(k).between(margin, edge - 1 - margin) for k in axes])
    on = F.col("on").cast("double")
    sums = rows.groupBy(*keys).agg(
        F.avg(on).alias("occupancy"), F.coalesce(F.avg(F.when(inner, on)), F.lit(0.0)).alias("interior_fraction"), F.avg(F.when(inner, 0.0).otherwise(on)).alias("boundary_fraction"),
        (F.percentile("v", F.lit(0.99)) - F.percentile("v", F.lit(0.5))).alias("contrast"), F.count(F.lit(1)).alias("cells"),
    )
    sizes = label_cells(rows.where("on").select(*keys, *axes), keys, axes, 1, key).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    got = sums.join(sizes.groupBy(*keys).agg(F.max("n").alias("largest")), keys, "left").withColumn("largest", F.coalesce("largest", F.lit(0)))
    c = F.col
    score = 4 * F.least(c("interior_fraction"), F.lit(0.2)) + 2 * F.least(c("largest") / c("cells"), F.lit(0.2)) + c("contrast") - 1.5 * c("boundary_fraction") - 2 * F.greatest(F.lit(0.0), c("occupancy") - 0.35)
    return got.withColumn("score", score)


def sheet_normals(grid: DataFrame) -> DataFrame:
    """grid, r, c, normal of grids (grid, r, c, p, valid): across the differences of p, each turned to the side of the cell above or else of the one before.

    The differences are window frames. Sides depend on one another from cell to cell, so they are set in one group a grid; a grid is a surface
    of given height and width, whose normals fit a task. Cells that aren't valid have a zero normal; missing places count as zero.
    """
    axes = ["r", "c"]
    rows = grid.select("grid", *axes, "valid", *[F.coalesce(F.nanvl(F.col("p")[k], F.lit(0.0)), F.lit(0.0)).alias(k) for k in "xyz"])
    for k in "xyz":
        rows = gradient(rows, ["grid"], axes, k, "d" + k)
    n = normalize(cross(vec("dxc", "dyc", "dzc"), vec("dxr", "dyr", "dzr")))
    rows = rows.select("grid", *axes, "valid", n.alias("n")).select("grid", *axes, "valid", *[F.col("n")[k].alias(k) for k in "xyz"])

    def turned(normal: np.ndarray, valid: np.ndarray) -> None:
        """Turns the normals (grid, row, column, axis) of grids of one shape, all grids at once."""
        for i in range(normal.shape[1]):
            above = np.zeros(valid[:, i].shape, bool)
            if i:
                above = valid[:, i] & valid[:, i - 1] & ((normal[:, i] * normal[:, i - 1]).sum(axis=2) < 0)
                normal[:, i][above] *= -1
            for j in range(1, normal.shape[2]):
                flip = ~above[:, j] & valid[:, i, j] & valid[:, i, j - 1] & ((normal[:, i, j] * normal[:, i, j - 1]).sum(axis=1) < 0)
                normal[flip, i, j] *= -1

    def run(batches):
        for b in batches:
            lists = b.column("cells")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            r, c, valid = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("r", "c", "valid"))
            valid = np.where(valid == True, True, False)  # noqa: E712 (null counts as not valid)
            place = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in "xyz"], 1) * valid[:, None]
            grid, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            shapes = np.stack([np.maximum.reduceat(x, starts) + 1 for x in (r, c)], 1) if len(sizes) else np.zeros((0, 2), int)
            kinds, kind = np.unique(shapes, axis=0, return_inverse=True)
            for k, (height, width) in enumerate(kinds):
                own = kind.ravel() == k
                rows, number = own[grid], (np.cumsum(own) - 1)[grid]
                at = number[rows], r[rows], c[rows]
                normal, mask = np.zeros((int(own.sum()), height, width, 3)), np.zeros((int(own.sum()), height, width), bool)
                normal[at], mask[at] = place[rows], valid[rows]
                turned(normal, mask)
                place[rows] = normal[at]
            fields = [flat.field("r"), flat.field("c"), *[pa.array(place[:, k]) for k in range(3)]]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("grid"), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["r", "c", *"xyz"]))], ["grid", "cells"])

    # Spark makes a row of each grid, so Python is called for batches of grids; a batch's grids of one shape take a step together.
    lists = rows.groupBy("grid").agg(F.collect_list(F.struct("r", "c", "valid", *"xyz")).alias("cells"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    got = lists.mapInArrow(run, f"grid {kinds['grid']}, cells array<struct<r: {kinds['r']}, c: {kinds['c']}, x: double, y: double, z: double>>")
    return got.select("grid", F.inline("cells")).select("grid", "r", "c", vec("x", "y", "z").alias("normal"))


def gap_summary(errors: DataFrame, recovered: float = 3.0) -> DataFrame:
    """Means and recovered shares (errors below a limit) of straight and, where there is a column model, of model errors, and how often the model wins."""
    c = F.col
    out = [F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"), F.avg((c("error") < recovered).cast("double")).alias("recovered")]
    if "model" in errors.columns:
        out += [F.avg("model").alias("model_error"), F.avg((c("model") < recovered).cast("double")).alias("model_recovered"), F.avg((c("model") < c("error")).cast("double")).alias("model_wins")]
    return errors.agg(*out)
