"""Connected components of a links table by alternating large and small stars.

Each round is a minimum per node and a join, written to the shared folder; nothing but a checksum
reaches the driver. Stars replace hubs' links by links to the minimum, so the links never grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfacelab.llm.shared import new_path, remove, written_to


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _both(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of a links table; root is the component's smallest node.

    Null ends and links of a node to itself are left out; repeated links count once.
    """
    spark = links.sparkSession
    path = new_path(spark, "links")
    now = written_to(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), path)

    def sign(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    last = sign(now)
    while last[0]:
        ahead = new_path(spark, "links")
        now = written_to(_small_star(_large_star(now)), ahead)
        remove(spark, path)
        path, new = ahead, sign(now)
        if new == last:
            break
        last = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
