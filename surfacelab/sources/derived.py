"""Engine inputs derived from the given tables: candidates, volumes, tiles, grids and trajectories.

An embedding of 64 numbers is read as a candidate (its first seven), as a 4x4x4 volume, as an 8x8
tile or as an 8x8 height grid; a user's events are a trajectory. So every input grows with the
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacelab.functions.vec import vec
from surfacelab.operators.rounds import dealt, shuffled

EDGE, SIDE, SHEET = 4, 8, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shuffled(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_id, label, p (place in a 32-voxel world), n (normal, not unit), score."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(7)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("candidate_id"), "label", vec(*[16 + 20 * x for x in e[:3]]).alias("p"), vec(*e[3:6]).alias("n"), e[6].alias("score")
    )


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, i, e of each embedding's numbers, dealt by vec_id before there is a row a number: stencils and sums of one vector's cells move nothing."""
    rows = dealt(table(spark, sf_dir, "embeddings"), "vec_id").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    return rows.withColumn("e", F.col("e").cast("double"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vol, z, y, x, v of 4x4x4 volumes with v in 0..1."""
    i = F.col("i")
    return _cells(spark, sf_dir).select(
        F.col("vec_id").alias("vol"), F.floor(i / 16).cast("int").alias("z"), (F.floor(i / 4) % 4).cast("int").alias("y"), (i % 4).cast("int").alias("x"), ((F.col("e") + 1) / 2).alias("v")
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, label, r, c, v of 8x8 tiles; v is zero where masked (negative), else up to 200."""
    i = F.col("i")
    return _cells(spark, sf_dir).select(
        F.col("vec_id").alias("tile"), "label", F.floor(i / 8).cast("int").alias("r"), (i % 8).cast("int").alias("c"), F.greatest(F.lit(0.0), F.col("e") * 200).alias("v")
    )


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid, r, c, p, valid of 8x8 height grids; a deep cell is a hole."""
    i, e = F.col("i"), F.col("e")
    r, c = F.floor(i / 8).cast("int"), (i % 8).cast("int")
    return _cells(spark, sf_dir).select(F.col("vec_id").alias("grid"), r.alias("r"), c.alias("c"), vec(c, r, 10 * e).alias("p"), (e > -0.12).alias("valid"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vol, z, y, x, v of 8x8x8 volumes with a bright sheet, whose height above (y, x) is 3.5 and eight times the embedding's number."""
    i, e = F.col("i"), F.col("e")
    rows = _cells(spark, sf_dir).select(F.col("vec_id").alias("vol"), F.explode(F.sequence(F.lit(0), F.lit(SHEET - 1))).alias("z"), F.floor(i / SHEET).cast("int").alias("y"), (i % SHEET).cast("int").alias("x"), (3.5 + 8 * e).alias("h"))
    off = (F.col("z") - F.col("h")) / 1.2
    return rows.select("vol", "z", "y", "x", F.exp(-0.5 * off * off).alias("v"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj, ord (timestamp), tie, p, probability of the users' events."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("traj"), "ts", "event_id", vec(F.col("value"), t % 86400 / 3600, F.col("event_id") % 97).alias("p"), (F.col("event_id") % 11 / 11).alias("probability")
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, score of labelled documents; the score is the text's length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "score", F.col("source").alias("region"))


# The same inputs for the SQL oracle.
SQL = {
    "cand": """cand AS (SELECT vec_id AS candidate_id, label, 16 + 20 * embedding[1]::DOUBLE AS px, 16 + 20 * embedding[2]::DOUBLE AS py,
      16 + 20 * embedding[3]::DOUBLE AS pz, embedding[4]::DOUBLE AS nx, embedding[5]::DOUBLE AS ny, embedding[6]::DOUBLE AS nz,
      embedding[7]::DOUBLE AS score FROM embeddings)""",
    "vox": """vox AS (SELECT vec_id AS vol, (i // 16)::INT AS z, ((i // 4) % 4)::INT AS y, (i % 4)::INT AS x, (embedding[i + 1]::DOUBLE + 1) / 2 AS v
      FROM embeddings, range(64) t(i))""",
    "sheet": """sheet AS (SELECT vec_id AS vol, z::INT AS z, (i // 8)::INT AS y, (i % 8)::INT AS x, exp(-0.5::DOUBLE * ((z - (3.5::DOUBLE + 8 * embedding[i + 1]::DOUBLE)) / 1.2::DOUBLE) * ((z - (3.5::DOUBLE + 8 * embedding[i + 1]::DOUBLE)) / 1.2::DOUBLE)) AS v
      FROM embeddings, range(64) t(i), range(8) s(z))""",
    "tile": """tile AS (SELECT vec_id AS tile, label, (i // 8)::INT AS r, (i % 8)::INT AS c, greatest(0.0::DOUBLE, embedding[i + 1]::DOUBLE * 200) AS v
      FROM embeddings, range(64) t(i))""",
    "grid": """grid AS (SELECT vec_id AS grid, (i // 8)::INT AS r, (i % 8)::INT AS c, (i % 8)::DOUBLE AS px, (i // 8)::DOUBLE AS py,
      10 * embedding[i + 1]::DOUBLE AS pz, embedding[i + 1]::DOUBLE > -0.12 AS valid FROM embeddings, range(64) t(i))""",
    "traj": """traj AS (SELECT user_id AS traj, ts, event_id, value::DOUBLE AS px, (epoch_us(ts) / 1e6) % 86400 / 3600 AS py, (event_id % 97)::DOUBLE AS pz,
      (event_id % 11) / 11.0::DOUBLE AS probability FROM events)""",
    "lab": """lab AS (SELECT d.doc_id AS id, quality AS label, n_chars::DOUBLE AS score, source AS region FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
