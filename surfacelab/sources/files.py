"""File sources and sinks: .npy arrays, OME-Zarr metadata, manifests, grids and PLY meshes."""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_npy(spark: SparkSession, path: str, slab: int = 16) -> DataFrame:
    """vol (number of the file by name), z, y, x, v of 3-d .npy files; slabs of a file are separate rows of work."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)

    def cells(batches):
        for b in batches:
            for r in b.itertuples():
                a = np.load(io.BytesIO(r.content), allow_pickle=False)
                for z in range(0, a.shape[0], slab):
                    part = a[z : z + slab]
                    i, j, k = np.indices(part.shape)
                    yield pd.DataFrame({"path": r.path, "z": (i + z).ravel(), "y": j.ravel(), "x": k.ravel(), "v": part.ravel().astype(float)})

    return files.select("path", "content").mapInPandas(cells, "path string, z int, y int, x int, v double")


def read_ome_levels(spark: SparkSession, path: str) -> DataFrame:
    """level, dataset, scale and offset (z, y, x, in voxels) of an OME-Zarr store's multiscale metadata.

    A translation is divided by the whole scale, whatever the order of the transforms.
    """
    # Spark's readers skip names that begin with a dot; the file is small and read on the driver.
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/.zattrs")
    stream = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(name)
    try:
        text = spark.createDataFrame([(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"),)], "value string")
    finally:
        stream.close()
    schema = "multiscales array<struct<datasets:array<struct<path:string,coordinateTransformations:array<struct<type:string,scale:array<double>,translation:array<double>>>>>>>"
    sets = text.select(F.from_json("value", schema).alias("m")).select(F.posexplode(F.get("m.multiscales", F.lit(0))["datasets"]).alias("level", "d"))

    def of(kind: str, start: float):
        known = F.filter("d.coordinateTransformations", lambda t: t["type"] == kind)
        return F.slice(F.coalesce(F.get(known, F.lit(0))[kind], F.array(*[F.lit(start)] * 3)), -3, 3)

    rows = sets.select("level", F.col("d.path").alias("dataset"), of("scale", 1.0).alias("scale"), of("translation", 0.0).alias("t"))
    return rows.select("level", "dataset", "scale", F.zip_with("t", "scale", lambda t, s: t / s).alias("offset"))


def normalized(voxels: DataFrame, integer_max: float | None = None) -> DataFrame:
    """Integer types over their largest value; other values over the volume's maximum where it is above one."""
    if integer_max:
        return voxels.withColumn("v", F.col("v") / integer_max)
    top = voxels.groupBy("vol").agg(F.greatest(F.max("v"), F.lit(1.0)).alias("top"))
    return voxels.join(top, "vol").withColumn("v", F.col("v") / F.col("top")).drop("top")


def save_manifest(records: DataFrame, folder: str, version: int = 1) -> str:
    """records as a new JSON table of the folder, then its name as the newest pointer row; readers never see half a table."""
    name = f"manifest-{uuid.uuid4().hex}"
    records.write.json(f"{folder}/{name}")
    spark = records.sparkSession
    pointer = spark.createDataFrame([(name, version, records.schema.json())], "name string, version int, fields string")
    pointer.coalesce(1).withColumn("written", F.current_timestamp()).write.mode("append").json(f"{folder}/pointer")
    return name


def load_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest table; a version other than 1 is refused."""
    from pyspark.sql.types import StructType

    last = spark.read.schema("name string, version int, fields string, written timestamp").json(f"{folder}/pointer").orderBy(F.desc("written"), "name").first()
    if last.version != 1:
        raise ValueError(f"manifest version {last.version} isn't known")
    return spark.read.schema(StructType.fromJson(json.loads(last.fields))).json(f"{folder}/{last.name}")


def save_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One mesh as ASCII PLY lines: header, vertices in vid order, faces; numbered by a sort, written by Spark.

    A PLY file numbers its vertices from zero in one sequence, so one mesh is one file.
    """
    from pyspark.sql.window import Window

    order = vertices.withColumn("i", F.row_number().over(Window.partitionBy("mesh").orderBy("vid")) - 1)
    f = faces
    for k in "abc":
        f = f.join(order.select("mesh", F.col("vid").alias(k), F.col("i").alias("i" + k)), ["mesh", k])
    sizes = order.groupBy("mesh").agg(F.count(F.lit(1)).alias("nv")).join(faces.groupBy("mesh").agg(F.count(F.lit(1)).alias("nf")), "mesh", "left")
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("nv"), F.lit("\nproperty float x\nproperty float y\nproperty float z\nelement face "), F.coalesce("nf", F.lit(0)), F.lit("\nproperty list uchar int vertex_indices\nend_header"))
    lines = sizes.select("mesh", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), head.alias("value"))
    lines = lines.unionByName(order.select("mesh", F.lit(1).alias("part"), F.col("i").cast("long").alias("k"), F.concat_ws(" ", *[F.format_string("%.6f", F.col("p")[c]) for c in "xyz"]).alias("value")))
    lines = lines.unionByName(f.select("mesh", F.lit(2).alias("part"), F.col("fid").alias("k"), F.concat_ws(" ", F.lit(3), "ia", "ib", "ic").alias("value")))
    lines.repartition("mesh").sortWithinPartitions("mesh", "part", "k").select("mesh", "value").write.partitionBy("mesh").text(path)
