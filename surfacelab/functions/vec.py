"""Vector algebra and scores as Column expressions; a vector is a struct of doubles x, y, z."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vec(x, y, z) -> Column:
    parts = [v for k, c in zip("xyz", (x, y, z)) for v in (F.lit(k), col(c).cast("double"))]
    return F.named_struct(*parts)


def _each(f, *vs) -> Column:
    return F.named_struct(*[x for k in "xyz" for x in (F.lit(k), f(*[col(v)[k] for v in vs]))])


def add(a, b) -> Column:
    return _each(lambda p, q: p + q, a, b)


def sub(a, b) -> Column:
    return _each(lambda p, q: p - q, a, b)


def scale(a, s) -> Column:
    return _each(lambda p: p * s, a)


def dot(a, b) -> Column:
    a, b = col(a), col(b)
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a, b) -> Column:
    a, b = col(a), col(b)
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a, eps: float = EPS) -> Column:
    """a over its length, or over eps if that is larger."""
    return _each(lambda p: p / F.greatest(norm(a), F.lit(eps)), a)


def normalize_soft(a, eps: float = EPS) -> Column:
    """a over its length plus eps."""
    return _each(lambda p: p / (norm(a) + eps), a)


def is_finite(a) -> Column:
    """All components are numbers: not null, NaN or infinite."""
    a = col(a)
    return F.coalesce(F.lit(True) & ~F.isnan(a["x"] + a["y"] + a["z"]) & (F.abs(a["x"] + a["y"] + a["z"]) < float("inf")), F.lit(False))


def zero_nan(x) -> Column:
    return F.coalesce(F.nanvl(col(x).cast("double"), F.lit(0.0)), F.lit(0.0))


def tangent_frame(df: DataFrame, n: str, u: str = "u", v: str = "v") -> DataFrame:
    """df with unit vectors u and v across a unit normal: the reference axis is x, or y where the normal is near x.

    Vectors are built step by step: as one expression each step would hold the last one many times.
    """
    ref = F.when(F.abs(F.col(n)["x"]) < 0.8, vec(F.lit(1), F.lit(0), F.lit(0))).otherwise(vec(F.lit(0), F.lit(1), F.lit(0)))
    df = df.withColumn("__ref", ref).withColumn("__u", cross(n, "__ref")).withColumn(u, normalize("__u"))
    return df.withColumn("__v", cross(n, u)).withColumn(v, normalize("__v")).drop("__ref", "__u", "__v")


def local_frame(df: DataFrame, tangent: str, normal: str) -> DataFrame:
    """df with e1, e2, e3: the tangent, the third axis, and the normal made orthogonal to the tangent."""
    df = df.withColumn("e1", normalize(tangent)).withColumn("__s", dot(normal, "e1")).withColumn("__n", sub(normal, scale("e1", F.col("__s"))))
    return df.withColumn("e3", normalize("__n")).withColumn("e2", cross("e3", "e1")).drop("__s", "__n")


def to_voxel(p, scale_xyz=(1.0, 1.0, 1.0), offset_xyz=(0.0, 0.0, 0.0)) -> Column:
    p = col(p)
    return vec(*[p[k] / s - o for k, s, o in zip("xyz", scale_xyz, offset_xyz)])


def to_world(p, scale_xyz=(1.0, 1.0, 1.0), offset_xyz=(0.0, 0.0, 0.0)) -> Column:
    p = col(p)
    return vec(*[(p[k] + o) * s for k, s, o in zip("xyz", scale_xyz, offset_xyz)])


def area2(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a plane triangle."""
    return (col(bx) - col(ax)) * (col(cy) - col(ay)) - (col(cx) - col(ax)) * (col(by) - col(ay))


def face_normal(a, b, c) -> Column:
    """Normal of a triangle, as long as twice its area."""
    return cross(sub(b, a), sub(c, a))


def combined_score() -> Column:
    c = F.col
    return (
        1.5 * c("surface_score") + 2.0 * c("ct_nonzero") + 0.02 * c("ct_std") + 0.02 * c("focus_std") + c("fiber_coherence")
        + 8.0 * c("ink_std") + F.greatest(F.lit(0.0), c("ink_p99") - c("ink_mean"))
    )


def texture_score() -> Column:
    c = F.col
    return 2.0 * c("ct_nonzero") + 0.025 * c("ct_std") + 0.8 * c("fiber_coherence") + 0.01 * c("focus_mean") + 0.5 * c("surface_probability")


def screening_score() -> Column:
    """Score of a search's first phase, before any ink is looked at."""
    c = F.col
    return 1.5 * c("surface_score") + 2.0 * c("ct_nonzero") + 0.02 * c("ct_std") + 0.5 * c("fiber_coherence")


def final_score() -> Column:
    """combined_score and the spread and excess of ink."""
    c = F.col
    return c("combined_score") + 8.0 * c("ink_std") + F.greatest(F.lit(0.0), c("ink_p99") - c("ink_mean"))


def parse_numbers(text, count: int, kind: str = "double") -> Column:
    """"a,b,c" as an array of count numbers, null where the count differs or a part is no number."""
    parts = F.transform(F.split(col(text), ","), lambda p: F.trim(p).try_cast(kind))
    return F.when((F.size(parts) == count) & ~F.exists(parts, lambda p: p.isNull()), parts)


def folder_name(rank, candidate_id) -> Column:
    return F.format_string("%03d-candidate-%06d", col(rank), col(candidate_id))
