"""Tables that grow by committed parts: a part is a folder of rows and, once it is whole, a line that names it.

A part that dies half written has no line and is never read; the next run writes a new folder. So work can be
stopped anywhere and gone on with, and what is read is always whole parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = T.StructType([T.StructField("folder", T.StringType()), T.StructField("units", T.ArrayType(T.LongType()))])


class Parts:
    """The committed parts below a folder; each stands for some units of work."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _lines(self) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema(LINE).json(f"{self.path}/commits") if files.exists(place) else self.spark.createDataFrame([], LINE)

    def done(self) -> list[int]:
        """The units of all committed parts."""
        return sorted(r.unit for r in self._lines().select(F.explode("units").alias("unit")).distinct().collect())

    def add(self, rows: DataFrame, units: list[int]) -> DataFrame:
        """Writes rows as one part that stands for the units, and reads it back."""
        folder = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(folder, [int(u) for u in units])], LINE).coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")

    def read(self, schema: T.StructType) -> DataFrame:
        folders = [f"{self.path}/{r.folder}" for r in self._lines().select("folder").collect()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def render_layers(layers: Callable[[list[float]], DataFrame], offsets: list[float], spark: SparkSession, path: str, batch: int = 5) -> DataFrame | None:
    """The layers of all offsets, those that a former run has committed taken as they are.

    layers(offsets) gives rows with k, the number of the offset in that list; they are stored with the number in the whole list. A batch of offsets is
    one job and one part. None where there are no offsets.
    """
    parts, schema = Parts(spark, path), None
    done = set(parts.done())
    for first in range(0, len(offsets), batch):
        units = [k for k in range(first, min(first + batch, len(offsets))) if k not in done]
        rows = layers([offsets[k] for k in (units or [first])])
        numbers = F.array(*[F.lit(k) for k in (units or [first])])
        rows = rows.withColumn("k", F.get(numbers, F.col("k")))
        schema = rows.schema
        if units:
            parts.add(rows, units)
    return parts.read(schema) if schema is not None else None


def until_enough(ranked: DataFrame, attempt: Callable[[DataFrame], DataFrame], spark: SparkSession, path: str, wanted: int = 5, key: str = "candidate_id", success: str = "complete") -> DataFrame:
    """Records (key, status and more) of the best candidates in rank order until so many are a success; a stopped run goes on where it was.

    ranked has key and rank. Each round attempts as many of the next ones as are still wanted: a run one by one would attempt them all, as not one
    success fewer is missing, so the attempted candidates are exactly those of such a run. attempt gets a round's candidates and gives a record for each.
    """
    parts, schema = Parts(spark, path), attempt(ranked.limit(0)).schema
    while True:
        told = parts.read(schema)
        missing = wanted - told.where(F.col("status") == success).count()
        batch = ranked.join(told.select(key), key, "left_anti").orderBy("rank").limit(max(missing, 0)) if missing > 0 else None
        if batch is None or batch.isEmpty():
            return told
        parts.add(attempt(batch), [max(parts.done(), default=-1) + 1])
