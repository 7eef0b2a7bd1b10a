"""Mesh operators: vertices (mesh, vid, p) and faces (mesh, fid, a, b, c) as tables.

Everything is an equi-join or aggregate on (mesh, vertex) or (mesh, edge); meshes are independent,
so they spread over the cluster and one mesh's edges do too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfacelab.functions.vec import add, dot, face_normal, norm, normalize, scale, sub, vec
from surfacelab.operators.ranking import exact_quantile
from surfacelab.operators.rounds import component_labels, cut, shuffled
from surfacelab.operators.sampling import project


def grid_vertices(grid: DataFrame, width: int) -> DataFrame:
    """Vertices of the valid cells of grids (grid, r, c, p, valid); vid = r * width + c."""
    return grid.where("valid").select(F.col("grid").alias("mesh"), (F.col("r") * width + F.col("c")).cast("long").alias("vid"), "p")


def grid_faces(grid: DataFrame, width: int) -> DataFrame:
    """Two faces for each square of four valid cells: (00, 01, 10) and (01, 11, 10)."""
    cells = grid.where("valid").select(F.col("grid").alias("mesh"), "r", "c")
    # A cell votes for the four squares that it is a corner of; a full vote makes the faces.
    votes = cells.select("mesh", F.inline(F.array(*[F.struct((F.col("r") - i).alias("r"), (F.col("c") - j).alias("c")) for i in (0, 1) for j in (0, 1)])))
    squares = votes.groupBy("mesh", "r", "c").agg(F.count(F.lit(1)).alias("n")).where("n = 4")
    v = {(i, j): ((F.col("r") + i) * width + F.col("c") + j).cast("long") for i in (0, 1) for j in (0, 1)}
    first = (F.col("r") * width + F.col("c")).cast("long") * 2

    def face(fid: Column, a, b, c) -> Column:
        return F.struct(fid.alias("fid"), v[a].alias("a"), v[b].alias("b"), v[c].alias("c"))

    return squares.select("mesh", F.inline(F.array(face(first, (0, 0), (0, 1), (1, 0)), face(first + 1, (0, 1), (1, 1), (1, 0)))))


def corners(faces: DataFrame) -> DataFrame:
    """mesh, fid, corner (0..2), vid."""
    return faces.select("mesh", "fid", F.posexplode(F.array("a", "b", "c")).alias("corner", "vid"))


def face_edges(faces: DataFrame) -> DataFrame:
    """mesh, fid, lo, hi of each face's three undirected edges."""
    pairs = [("a", "b"), ("b", "c"), ("c", "a")]
    return faces.select("mesh", "fid", F.inline(F.array(*[F.struct(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")) for x, y in pairs])))


def with_points(faces: DataFrame, vertices: DataFrame, attribute: str = "p") -> DataFrame:
    """faces with pa, pb, pc: one shuffle by vertex, one back by face."""
    got = corners(faces).join(vertices.select("mesh", "vid", attribute), ["mesh", "vid"])
    at = [F.max(F.when(F.col("corner") == k, F.col(attribute))).alias("p" + "abc"[k]) for k in range(3)]
    return faces.join(got.groupBy("mesh", "fid").agg(*at), ["mesh", "fid"])


def plane_corners(faces: DataFrame, uv: DataFrame) -> DataFrame:
    """mesh, fid, ua, va .. vc: each face's corners in the plane (mesh, vid, u, v)."""
    at = corners(faces).join(uv.select("mesh", "vid", "u", "v"), ["mesh", "vid"]).groupBy("mesh", "fid")
    return at.agg(*[F.max(F.when(F.col("corner") == k, F.col(x))).alias(x + "abc"[k]) for k in range(3) for x in "uv"])


def edge_lengths(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh, lo, hi, w of the distinct edges."""
    edges = face_edges(faces).select("mesh", "lo", "hi").distinct()
    ends = vertices.select("mesh", F.col("vid").alias("lo"), F.col("p").alias("p0")), vertices.select("mesh", F.col("vid").alias("hi"), F.col("p").alias("p1"))
    return edges.join(ends[0], ["mesh", "lo"]).join(ends[1], ["mesh", "hi"]).select("mesh", "lo", "hi", norm(sub("p0", "p1")).alias("w"))


def edge_counts(faces: DataFrame) -> DataFrame:
    """mesh, lo, hi, n: how many faces share each edge."""
    return face_edges(faces).groupBy("mesh", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def prune_long_faces(faces: DataFrame, vertices: DataFrame, factor: float) -> DataFrame:
    """Faces all of whose edges are shorter than factor times the mesh's median edge."""
    lengths = edge_lengths(faces, vertices)
    limit = exact_quantile(lengths, ["mesh"], "w", 0.5, "median").select("mesh", (F.col("median") * factor).alias("limit"))
    long_ = lengths.join(limit, "mesh").where("w >= limit").select("mesh", "lo", "hi")
    bad = face_edges(faces).join(long_, ["mesh", "lo", "hi"]).select("mesh", "fid").distinct()
    return shuffled(faces.join(bad, ["mesh", "fid"], "left_anti"))


def prune_dim_faces(faces: DataFrame, vertices: DataFrame, minimum: float, attribute: str = "probability") -> DataFrame:
    """Faces all of whose vertices reach the minimum of an attribute."""
    dim = vertices.where(~F.coalesce(F.col(attribute) >= minimum, F.lit(False))).select("mesh", "vid")
    bad = corners(faces).join(dim, ["mesh", "vid"]).select("mesh", "fid").distinct()
    return shuffled(faces.join(bad, ["mesh", "fid"], "left_anti"))


def prune_bridges(faces: DataFrame, vertices: DataFrame, edge_factor: float = 2.5, angle_cosine: float = 0.6427876096865394, step: float = 0.55) -> DataFrame:
    """Faces whose edges are short, join normals that agree, and don't leave the normals' plane.

    vertices carry a unit normal; the step is the edge along the mean normal over its length.
    """
    e = edge_lengths(faces, vertices)
    limit = exact_quantile(e, ["mesh"], "w", 0.5, "median").select("mesh", (F.col("median") * edge_factor).alias("limit"))
    ends = [vertices.select("mesh", F.col("vid").alias(k), F.col("p").alias("p" + k), F.col("normal").alias("n" + k)) for k in ("lo", "hi")]
    e = e.join(ends[0], ["mesh", "lo"]).join(ends[1], ["mesh", "hi"]).join(limit, "mesh")
    way = sub("phi", "plo")
    rise = F.greatest(F.abs(dot(way, "nlo")), F.abs(dot(way, "nhi"))) / F.greatest(F.col("w"), F.lit(1e-6))
    bad_edges = e.where((F.col("w") > F.col("limit")) | (F.abs(dot("nlo", "nhi")) < angle_cosine) | (rise > step)).select("mesh", "lo", "hi")
    bad = face_edges(faces).join(bad_edges, ["mesh", "lo", "hi"]).select("mesh", "fid").distinct()
    return shuffled(faces.join(bad, ["mesh", "fid"], "left_anti"))


def remove_nonmanifold(faces: DataFrame, times: int = 3) -> DataFrame:
    """Faces without those on an edge of more than two faces; looked at again at most so often."""
    for _ in range(times):
        bad_edges = edge_counts(faces).where("n > 2").select("mesh", "lo", "hi")
        bad = face_edges(faces).join(bad_edges, ["mesh", "lo", "hi"]).select("mesh", "fid").distinct()
        faces = shuffled(faces.join(bad, ["mesh", "fid"], "left_anti"))
    return faces


def referenced(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return shuffled(vertices.join(corners(faces).select("mesh", "vid").distinct(), ["mesh", "vid"], "left_semi"))


def topology(faces: DataFrame) -> DataFrame:
    """mesh, vertices, faces, edges, euler, boundary_edges, violations."""
    e = edge_counts(faces).groupBy("mesh").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("n") == 1).alias("boundary_edges"), F.count_if(F.col("n") > 2).alias("violations"))
    v = corners(faces).groupBy("mesh").agg(F.countDistinct("vid").alias("vertices"), F.countDistinct("fid").alias("faces"))
    return v.join(e, "mesh").withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh, vid, normal: the normalised sum of the unit normals of the faces around."""
    n = with_points(faces, vertices).select("mesh", "fid", normalize(face_normal("pa", "pb", "pc")).alias("n"))
    sums = corners(faces).join(n, ["mesh", "fid"]).groupBy("mesh", "vid").agg(*[F.sum(F.col("n")[k]).alias(k) for k in "xyz"])
    return sums.select("mesh", "vid", normalize(vec("x", "y", "z")).alias("normal"))


def continuity(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh, normal_p01 (1st percentile of the agreement of faces that share an edge), edge_outliers."""
    n = with_points(faces, vertices).select("mesh", "fid", normalize(face_normal("pa", "pb", "pc")).alias("n"))
    e = face_edges(faces).join(n, ["mesh", "fid"])
    two = e.alias("s").join(e.alias("t"), (F.col("s.mesh") == F.col("t.mesh")) & (F.col("s.lo") == F.col("t.lo")) & (F.col("s.hi") == F.col("t.hi")) & (F.col("s.fid") < F.col("t.fid")))
    agree = exact_quantile(two.select(F.col("s.mesh").alias("mesh"), F.abs(dot(F.col("s.n"), F.col("t.n"))).alias("agree")), ["mesh"], "agree", 0.01, "normal_p01")
    lengths = edge_lengths(faces, vertices)
    limit = exact_quantile(lengths, ["mesh"], "w", 0.5, "median").select("mesh", (2.5 * F.col("median")).alias("limit"))
    out = lengths.join(limit, "mesh").groupBy("mesh").agg(F.avg((F.col("w") > F.col("limit")).cast("double")).alias("edge_outliers"))
    return out.join(agree, "mesh", "left")


def subdivide(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with each face cut into four; a midpoint is keyed by its edge and so shared.

    A vertex is (mesh, lo, hi, p) with lo = hi for an old one; a face's corners are such pairs.
    """
    ends = vertices.select("mesh", F.col("vid").alias("lo"), F.col("p").alias("p0")), vertices.select("mesh", F.col("vid").alias("hi"), F.col("p").alias("p1"))
    mids = face_edges(faces).select("mesh", "lo", "hi").distinct().join(ends[0], ["mesh", "lo"]).join(ends[1], ["mesh", "hi"])
    mids = mids.select("mesh", "lo", "hi", vec(*[(F.col("p0")[k] + F.col("p1")[k]) / 2 for k in "xyz"]).alias("p"))
    points = vertices.select("mesh", F.col("vid").alias("lo"), F.col("vid").alias("hi"), "p").unionByName(mids)

    def key(x: str, y: str) -> Column:
        return F.struct(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))

    a, b, c, ab, bc, ca = key("a", "a"), key("b", "b"), key("c", "c"), key("a", "b"), key("b", "c"), key("c", "a")
    four = [(a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)]
    new = [F.struct((F.col("fid") * 4 + i).alias("fid"), x.alias("a"), y.alias("b"), z.alias("c")) for i, (x, y, z) in enumerate(four)]
    return points, faces.select("mesh", F.inline(F.array(*new)))


def face_components(faces: DataFrame, key: str | None = None) -> DataFrame:
    """mesh, fid, label: components of faces that share an edge, named by their least face. key: mesh, where meshes are small."""
    rows = cut(faces.select("mesh", "fid", "a", "b", "c"), key)
    e = face_edges(rows)
    # A star to the edge's least face joins all faces of an edge without their pairs.
    least = e.groupBy("mesh", "lo", "hi").agg(F.min("fid").alias("first"))
    stars = e.join(least, ["mesh", "lo", "hi"]).where("fid <> first").select(F.struct("mesh", "fid").alias("a"), F.struct("mesh", F.col("first").alias("fid")).alias("b"))
    labels = component_labels(rows.select(F.struct("mesh", "fid").alias("node")), stars, key)
    return labels.select(F.col("node.mesh").alias("mesh"), F.col("node.fid").alias("fid"), F.col("label.fid").alias("label"))


def boundary_loops(faces: DataFrame, vertices: DataFrame, key: str | None = None) -> DataFrame:
    """mesh, loop (least vertex), n, perimeter, simple (every vertex has two boundary edges). key: mesh, where meshes are small."""
    edges = cut(edge_counts(faces).where("n = 1").select("mesh", "lo", "hi"), key)
    one, two = F.struct("mesh", F.col("lo").alias("vid")), F.struct("mesh", F.col("hi").alias("vid"))
    ends = edges.select(one.alias("node")).unionByName(edges.select(two.alias("node")))
    labels = component_labels(ends.distinct(), edges.select(one.alias("a"), two.alias("b")), key)
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    loops = labels.join(degree, "node").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("d") == 2).alias("simple"))
    at = [vertices.select("mesh", F.col("vid").alias(k), F.col("p").alias("p" + k)) for k in ("lo", "hi")]
    long_ = edges.join(at[0], ["mesh", "lo"]).join(at[1], ["mesh", "hi"]).select(F.struct("mesh", F.col("lo").alias("vid")).alias("node"), norm(sub("plo", "phi")).alias("w"))
    perimeter = long_.join(labels, "node").groupBy("label").agg(F.sum("w").alias("perimeter"))
    return loops.join(perimeter, "label").select(F.col("label.mesh").alias("mesh"), F.col("label.vid").alias("loop"), "n", "perimeter", "simple")


def seed_component(faces: DataFrame, vertices: DataFrame, seeds: DataFrame, key: str | None = None) -> DataFrame:
    """The faces of the component nearest to each mesh's seed (mesh, seed). key: mesh, where meshes are small."""
    labels = face_components(faces, key)
    near = corners(faces).join(vertices, ["mesh", "vid"]).join(seeds, "mesh").select("mesh", "fid", norm(sub("p", "seed")).alias("away"))
    best = labels.join(near, ["mesh", "fid"]).groupBy("mesh").agg(F.min_by("label", F.struct(F.round("away", 9), "label")).alias("label"))
    return shuffled(faces.join(labels.join(best, ["mesh", "label"], "left_semi"), ["mesh", "fid"], "left_semi"))


def near_component(faces: DataFrame, vertices: DataFrame, seeds: DataFrame, within: float = 20.0, key: str | None = None) -> DataFrame:
    """mesh, fid, a, b, c of one component of each mesh with a seed (mesh, seed): the one of most faces among those with a vertex within reach of it.

    Where there is none within reach it is the nearest one; of equal ones the first. A nearest component alone is often a fragment.
    """
    labels = cut(face_components(faces, key), key)
    away = corners(faces).join(vertices, ["mesh", "vid"]).join(seeds, "mesh").select("mesh", "fid", norm(sub("p", "seed")).alias("away"))
    each = labels.join(away, ["mesh", "fid"]).groupBy("mesh", "label").agg(F.min("away").alias("away"), F.countDistinct("fid").alias("n"))
    near = F.col("away") <= within
    rank = F.struct(near.alias("near"), F.when(near, F.col("n")).alias("n"), F.when(~near, -F.col("away")).alias("closer"), (-F.col("label")).alias("first"))
    best = each.groupBy("mesh").agg(F.max_by("label", rank).alias("label"))
    return shuffled(faces.join(labels.join(best, ["mesh", "label"], "left_semi"), ["mesh", "fid"], "left_semi"))


def refine(faces: DataFrame, vertices: DataFrame, volume: DataFrame, level: int = 0, radius: float = 4.0, samples: int = 17) -> DataFrame:
    """mesh, vid, p, value: vertices moved along their normals to the brightest of the places within radius, on a pyramid level of volume (vol: the mesh).

    Places and radius count in voxels of that level, of which one is 2 ** level of the vertices' own.
    """
    scaled = vertices.select("mesh", "vid", scale("p", F.lit(1 / 2**level)).alias("p"))
    points = scaled.join(vertex_normals(faces, scaled), ["mesh", "vid"]).select(F.col("mesh").alias("vol"), "vid", "p", F.col("normal").alias("n"))
    best = project(points, volume, ["vol", "vid"], radius, samples)
    moved = points.join(best, ["vol", "vid"]).withColumn("q", add("p", scale("n", F.col("offset"))))
    return moved.select(F.col("vol").alias("mesh"), "vid", scale("q", F.lit(float(2**level))).alias("p"), F.col("sample").alias("value"))


def uv_quality(faces: DataFrame, uv: DataFrame) -> DataFrame:
    """mesh, flipped and collapsed shares of the faces in the plane; the sign of most faces is right."""
    at = corners(faces).join(uv, ["mesh", "vid"])
    k = {n: F.max(F.when(F.col("corner") == i, F.struct("u", "v"))).alias(n) for i, n in enumerate("abc")}
    rows = at.groupBy("mesh", "fid").agg(*k.values())
    area = ((F.col("b.u") - F.col("a.u")) * (F.col("c.v") - F.col("a.v")) - (F.col("c.u") - F.col("a.u")) * (F.col("b.v") - F.col("a.v"))) / 2
    rows = rows.select("mesh", area.alias("area"))
    sign = rows.groupBy("mesh").agg(F.when(F.count_if(F.col("area") < 0) * 2 > F.count(F.lit(1)), -1.0).otherwise(1.0).alias("sign"))
    area = F.col("area") * F.col("sign")
    return rows.join(sign, "mesh").groupBy("mesh").agg(F.avg((area < 0).cast("double")).alias("flipped"), F.avg((F.abs(area) <= 1e-12).cast("double")).alias("collapsed"))
