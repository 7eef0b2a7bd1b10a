"""Volumes in chunks: binary blobs keyed by chunk, written as Parquet and read with pruning.

A chunk row is (vol, level, cz, cy, cx, data): the doubles of an edge^3 cube in z, y, x order, NaN
where there is no voxel. Files are partitioned by level and sorted by chunk, so a crop reads only the row
groups whose chunk keys it meets. Missing chunks and voxels count as zero when sampled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "vol long, cz int, cy int, cx int, data binary, level int"


def write_chunks(voxels: DataFrame, path: str, edge: int, level: int = 0) -> None:
    """voxels (vol, z, y, x, v) as chunks of edge^3; a chunk is one row and one group."""
    keys = [F.floor(F.col(k) / edge).cast("int").alias("c" + k) for k in "zyx"]
    place = ((F.col("z") % edge) * edge + F.col("y") % edge) * edge + F.col("x") % edge
    cells = voxels.select("vol", *keys, place.cast("int").alias("place"), F.col("v").cast("double").alias("v"))

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        cube = np.full(edge**3, np.nan)
        cube[rows.place] = rows.v
        return pd.DataFrame([(*key, cube.astype("<f8").tobytes(), level)], columns=["vol", "cz", "cy", "cx", "data", "level"])

    chunks = cells.groupBy("vol", "cz", "cy", "cx").applyInPandas(pack, SCHEMA)
    chunks.repartitionByRange("vol", "cz", "cy", "cx").sortWithinPartitions("vol", "cz", "cy", "cx").write.partitionBy("level").parquet(path)


def read_chunks(spark: SparkSession, path: str, level: int = 0, bounds: dict[str, tuple[int, int]] | None = None, edge: int | None = None) -> DataFrame:
    """Chunks of a level that meet bounds ({"z": (lo, hi), ...}, hi exclusive): a filter that reaches the scan."""
    rows = spark.read.schema(SCHEMA).parquet(path).where(F.col("level") == level)
    for k, (lo, hi) in (bounds or {}).items():
        rows = rows.where(F.col("c" + k).between(lo // edge, (hi - 1) // edge))
    return rows


def unpack(chunks: DataFrame, edge: int, bounds: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Voxel rows of chunks, cut to the bounds."""

    def cells(batches):
        for b in batches:
            for r in b.itertuples():
                v = np.frombuffer(r.data, "<f8")
                at = np.nonzero(~np.isnan(v))[0]
                z, y, x = np.unravel_index(at, (edge,) * 3)
                yield pd.DataFrame({"vol": r.vol, "z": z + r.cz * edge, "y": y + r.cy * edge, "x": x + r.cx * edge, "v": v[at]}).astype({"z": "int32", "y": "int32", "x": "int32"})

    out = chunks.select("vol", "cz", "cy", "cx", "data").mapInPandas(cells, "vol long, z int, y int, x int, v double")
    for k, (lo, hi) in (bounds or {}).items():
        out = out.where((F.col(k) >= lo) & (F.col(k) < hi))
    return out


#: Points of a chunk that a task takes at once; a chunk of more is sent to several.
GROUP_POINTS = 100_000


def sample_chunks(points: DataFrame, chunks: DataFrame, edge: int, keys: list[str]) -> DataFrame:
    """keys and trilinear sample of points (vol, p): points meet the chunks that their corners lie in, not single voxels.

    A group is a chunk and its points (a share of them, where there are many): the chunk is sent and decoded once, and all points are
    sampled by array operations. Null, NaN and outside give zero.
    """
    low = [F.floor(F.col("p")[k]) for k in "zyx"]
    made = []
    for i in range(8):
        bits = (i >> 2 & 1, i >> 1 & 1, i & 1)
        made.append(F.struct(*[F.floor((f + b) / edge).cast("int").alias("c" + k) for k, f, b in zip("zyx", low, bits)]))
    place = ["vol", "cz", "cy", "cx"]
    fields = [f for f in points.schema.fields if f.name in keys]
    near = points.where("p.x + p.y + p.z < 1e300").select(F.struct(*keys).alias("key"), "vol", F.col("p.z").alias("pz"), F.col("p.y").alias("py"), F.col("p.x").alias("px"), F.explode(F.array_distinct(F.array(*made))).alias("c")).select("key", "vol", "pz", "py", "px", "c.*")
    near = near.withColumn("key", F.to_json("key"))
    shares = near.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / GROUP_POINTS).cast("int").alias("shares"))
    dealt = near.join(shares, place).withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares").cast("long")).cast("int")).drop("shares")
    sent = chunks.select(*place, "data").join(shares, place).select(*place, "data", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def part(chunk: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk) or not len(rows):
            return pd.DataFrame({"key": pd.Series([], dtype=object), "part": pd.Series([], dtype=float)})
        own = chunk.iloc[0]
        cube = np.nan_to_num(np.frombuffer(own.data, "<f8"))
        q = rows[["pz", "py", "px"]].to_numpy() - np.array([own.cz, own.cy, own.cx]) * edge
        lo = np.floor(q).astype(np.int64)
        total = np.zeros(len(rows))
        for i in np.ndindex(2, 2, 2):
            at = lo + i
            inside = ((at >= 0) & (at < edge)).all(axis=1)
            weight = np.where(np.array(i) == 1, q - lo, 1 - (q - lo)).prod(axis=1)
            total[inside] += weight[inside] * cube[(at[inside] @ np.array([edge * edge, edge, 1]))]
        return pd.DataFrame({"key": pd.Series(rows.key.to_numpy(object), dtype=object), "part": total})

    sums = sent.groupBy(*place, "share").cogroup(dealt.groupBy(*place, "share")).applyInPandas(part, "key string, part double").groupBy("key").agg(F.sum("part").alias("sample"))
    asked = points.select(*keys, F.to_json(F.struct(*keys)).alias("key"))
    return asked.join(sums, "key", "left").select(*[F.col(f.name) for f in fields], F.coalesce("sample", F.lit(0.0)).alias("sample"))
