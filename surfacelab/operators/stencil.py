"""Stencils as window frames: a line of cells is one window partition, so work splits by line.

A field is rows of index columns and v; keys name the volume or tile, axes the index columns.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from surfacelab.operators.ranking import exact_quantile
from surfacelab.operators.rounds import cut, shuffled


def line(keys: list[str], axes: list[str], axis: str) -> WindowSpec:
    """The cells that differ in axis alone, in its order."""
    return Window.partitionBy(*keys, *[a for a in axes if a != axis]).orderBy(axis)


def beside(w: WindowSpec, axis: str, value: str) -> tuple[Column, Column]:
    """The values at axis - 1 and axis + 1 of a line; null where no such cell exists, whatever the rows' neighbours are."""
    before = F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(value).over(w))
    return before, F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(value).over(w))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian(field: DataFrame, keys: list[str], axes: list[str], sigma: float, value: str = "v") -> DataFrame:
    """Separable Gaussian with mirrored edges (the edge cell is repeated): for each axis a line is one row, and its cells again.

    A line with gaps is blurred by runs: a missing cell is an edge, as the volume's end is.
    """
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    columns = field.columns
    for axis in axes:
        fixed = [*keys, *[a for a in axes if a != axis]]
        rest = [c for c in columns if c not in fixed]
        run = F.col(axis) - F.row_number().over(line(keys, axes, axis))
        lines = field.withColumn("run_", run).groupBy(*fixed, "run_").agg(F.array_sort(F.collect_list(F.struct(axis, *[c for c in rest if c != axis]))).alias("line_"))
        n = F.size("line_")

        def blurred(x: Column, i: Column) -> Column:
            terms = []
            for k, w in zip(range(-r, r + 1), weights):
                m = F.pmod(i + k, 2 * n)
                terms.append(F.lit(w) * F.get("line_", F.when(m < n, m).otherwise(2 * n - 1 - m))[value])
            return F.struct(*[reduce(lambda a, b: a + b, terms).alias(c) if c == value else x[c].alias(c) for c in rest])

        field = lines.select(*fixed, F.inline(F.transform("line_", blurred))).select(*columns)
    return field


def strided_bands(volume: DataFrame, stride: int, band: int, pad: int) -> DataFrame:
    """vol, band, z, y, x, v, core: every stride-th voxel, renumbered, in bands of z with pad layers of their neighbours around.

    A voxel is core in its own band alone, so what is worked out in bands with their halo is kept once. The voxels that are left out are filtered in
    the scan; a halo costs 2 * pad / band copies.
    """
    on = [F.col(k) % stride == 0 for k in ("z", "y", "x")]
    rows = volume.where(on[0] & on[1] & on[2]).select("vol", *[F.floor(F.col(k) / stride).cast("int").alias(k) for k in ("z", "y", "x")], "v")
    most = rows.groupBy("vol").agg(F.floor(F.max("z") / band).alias("last"))
    low, high = F.greatest(F.lit(0), F.floor((F.col("z") - pad) / band)), F.least(F.col("last"), F.floor((F.col("z") + pad) / band))
    out = shuffled(rows.join(most, "vol")).select("*", F.explode(F.sequence(low, high)).alias("band"))
    return out.select("vol", "band", "z", "y", "x", "v", (F.floor(F.col("z") / band) == F.col("band")).alias("core"))


def gradient(field: DataFrame, keys: list[str], axes: list[str], value: str = "v", prefix: str = "g", spacing: dict[str, float] | None = None) -> DataFrame:
    """Central differences over the spacing, one-sided where a neighbour is missing; zero where both are."""
    out = field
    for axis in axes:
        before, after = beside(line(keys, axes, axis), axis, value)
        here, h = F.col(value), (spacing or {}).get(axis, 1)
        both = (after - before) / (2 * h)
        one = [after - here, here - before] if h == 1 else [(after - here) / h, (here - before) / h]
        out = out.withColumn(prefix + axis, F.coalesce(both, *one, F.lit(0.0)))
    return out


def gradients(field: DataFrame, keys: list[str], axes: list[str], values: dict[str, str], spacing: dict[str, float] | None = None) -> DataFrame:
    """field with the gradients of several values (name: prefix), a line of cells being sorted once for all of them."""
    out = field
    for axis in axes:
        w, h, found = line(keys, axes, axis), (spacing or {}).get(axis, 1), {}
        for value, prefix in values.items():
            before, after = beside(w, axis, value)
            here = F.col(value)
            one = [after - here, here - before] if h == 1 else [(after - here) / h, (here - before) / h]
            found[prefix + axis] = F.coalesce((after - before) / (2 * h), *one, F.lit(0.0))
        out = out.withColumns(found)
    return out


def _weighed(field: DataFrame, keys: list[str], axes: list[str], axis: str, weights: tuple, value: str, name: str) -> DataFrame:
    """Three-cell weighted sum along an axis; the cell itself stands for a missing neighbour."""
    here = F.col(value)
    before, after = (F.coalesce(x, here) for x in beside(line(keys, axes, axis), axis, value))
    return field.withColumn(name, weights[0] * before + weights[1] * here + weights[2] * after)


def sobel(field: DataFrame, keys: list[str], axes: list[str], value: str = "v") -> DataFrame:
    """field with s<axis> of two axes: the difference along it, smoothed across."""
    for a, b in (axes, axes[::-1]):
        field = _weighed(field, keys, axes, a, (-1.0, 0.0, 1.0), value, "__d")
        field = _weighed(field, keys, axes, b, (1.0, 2.0, 1.0), "__d", "s" + a).drop("__d")
    return field


def local_maxima(field: DataFrame, keys: list[str], axes: list[str], radius: int, threshold: float, border: int = 0, extent: int | None = None, value: str = "v") -> DataFrame:
    """Cells equal to the largest in their cube and at or above the threshold; border cells left out.

    A maximum is separable and mirrored edges never raise it, so frames do. Values are rounded
    first, so that a plateau doesn't depend on the order of sums.
    """
    out = field.withColumn("__r", F.round(value, 9)).withColumn("__m", F.col("__r"))
    for axis in axes:
        out = out.withColumn("__m", F.max("__m").over(line(keys, axes, axis).rangeBetween(-radius, radius)))
    keep = (F.col("__r") == F.col("__m")) & (F.col(value) >= threshold)
    if border and extent is not None:
        for axis in axes:
            keep = keep & F.col(axis).between(border, extent - 1 - border)
    return out.where(keep).drop("__r", "__m")


def coherence(field: DataFrame, keys: list[str], axes: list[str], sigma: float) -> DataFrame:
    """field with coherence of the smoothed structure tensor of a tile."""
    r, c = axes
    s = sobel(field, keys, axes)
    s = s.select(*keys, *axes, "v", (F.col("s" + c) * F.col("s" + c)).alias("jxx"), (F.col("s" + r) * F.col("s" + r)).alias("jyy"), (F.col("s" + c) * F.col("s" + r)).alias("jxy"))
    for j in ("jxx", "jyy", "jxy"):
        s = gaussian(s, keys, axes, sigma, j)
    d = F.col("jxx") - F.col("jyy")
    return s.withColumn("coherence", F.sqrt(d * d + 4 * F.col("jxy") * F.col("jxy")) / (F.col("jxx") + F.col("jyy") + 1e-6))


def hessian_eigenvalues(field: DataFrame, keys: list[str]) -> DataFrame:
    """field with e1 >= e2 >= e3 of the symmetrised second differences, by the trigonometric cubic."""
    axes = ["z", "y", "x"]
    g = gradient(field, keys, axes).select(*keys, *axes, *["g" + a for a in axes])
    # The last axis' lines are sorted already.
    g = gradients(g, keys, axes[::-1], {"g" + a: "h" + a for a in axes})
    h = {(a, b): (F.col("h" + a + b) + F.col("h" + b + a)) / 2 for a in axes for b in axes}
    g = g.select(*keys, *axes, *[h[a, b].alias("a" + a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])
    return symmetric_eigenvalues(g).select(*keys, *axes, "e1", "e2", "e3")


def symmetric_eigenvalues(rows: DataFrame) -> DataFrame:
    """rows with e1 >= e2 >= e3 of the matrices axx, ayy, azz, axy, axz, ayz."""
    c, columns = F.col, rows.columns
    g = rows.withColumn("q", (c("axx") + c("ayy") + c("azz")) / 3)

    def square(x: Column) -> Column:
        return x * x

    spread = sum((square(c(k) - c("q")) for k in ("axx", "ayy", "azz")), F.lit(0.0)) + 2 * sum((square(c(k)) for k in ("axy", "axz", "ayz")), F.lit(0.0))
    g = g.withColumn("p", F.sqrt(spread / 6))
    for k in ("xx", "yy", "zz", "xy", "xz", "yz"):
        g = g.withColumn("b" + k, (c("a" + k) - (c("q") if k[0] == k[1] else F.lit(0.0))) / F.greatest(c("p"), F.lit(1e-300)))
    b = {k: c("b" + k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    g = g.withColumn("t", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3)
    e1 = c("q") + 2 * c("p") * F.cos("t")
    e3 = c("q") + 2 * c("p") * F.cos(c("t") + 2 * math.pi / 3)
    return g.select(*columns, e1.alias("e1"), (3 * c("q") - e1 - e3).alias("e2"), e3.alias("e3"))


def ridge_mask(eigen: DataFrame, field: DataFrame, keys: list[str], floor: float = 0.15, anisotropy_floor: float = 0.25) -> DataFrame:
    """Cells on a ridge: bright, one curvature dominant, and curved above the 15th percentile of positive curvature."""
    axes = ["z", "y", "x"]
    c = F.col
    # Written first: a filter on an eigenvalue would otherwise work its whole expression out again.
    rows = cut(eigen).join(field, [*keys, *axes]).withColumn("curvature", -c("e3"))
    rows = rows.withColumn("anisotropy", (F.abs("e3") - F.abs("e2")) / (F.abs("e3") + 1e-6))
    least = exact_quantile(rows.where("curvature > 0"), keys, "curvature", 0.15, "least")
    return rows.join(least, keys).where((c("v") >= floor) & (c("anisotropy") >= anisotropy_floor) & (c("curvature") >= c("least")))


def neighbour_mean(field: DataFrame, keys: list[str], axes: list[str], mask: Column, value: str = "v") -> DataFrame:
    """field with mean4: the sum of the four neighbours over the number that lie in the mask."""
    total, count = F.lit(0.0), F.lit(0)
    out = field.withColumn("__in", mask.cast("int"))
    for axis in axes:
        w = line(keys, axes, axis)
        for v, inside in zip(beside(w, axis, value), beside(w, axis, "__in")):
            total = total + F.coalesce(v, F.lit(0.0))
            count = count + F.coalesce(inside, F.lit(0))
    return out.withColumn("mean4", F.when(count > 0, total / count)).drop("__in")


def _spread(field: DataFrame, keys: list[str], axes: list[str], name: str, grow: bool) -> DataFrame:
    """One step of a 3-cell square: dilation, or erosion for which outside counts as false."""
    for axis in axes:
        w = line(keys, axes, axis)
        here, edge = F.col(name), F.lit(False)
        near = [F.coalesce(x, edge) for x in beside(w, axis, name)]
        field = field.withColumn(name, here | near[0] | near[1] if grow else here & near[0] & near[1])
    return field


def closing(field: DataFrame, keys: list[str], axes: list[str], name: str, times: int = 2) -> DataFrame:
    """Dilations, then as many erosions, of an 8-connected mask."""
    for grow in [True] * times + [False] * times:
        field = _spread(field, keys, axes, name, grow)
    return field


def dilate_cross(field: DataFrame, keys: list[str], axes: list[str], name: str) -> DataFrame:
    """One dilation by the neighbours along the axes (4 in a tile, 6 in a volume)."""
    near = F.col(name)
    for axis in axes:
        for x in beside(line(keys, axes, axis), axis, name):
            near = near | F.coalesce(x, F.lit(False))
    return field.withColumn(name, near)


def stretch(field: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99, value: str = "v") -> DataFrame:
    """field with stretched: between two percentiles of its tile, clipped to 0..1."""
    ends = field.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("__lo"), F.percentile(value, F.lit(high)).alias("__hi"))
    part = (F.col(value) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-6))
    return field.join(ends, keys).withColumn("stretched", F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))).drop("__lo", "__hi")
