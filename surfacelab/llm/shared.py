"""What the operators share: the shared folder, names of columns, and bounded samples of labelled texts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the vocabulary files' split patterns, as part of a character class (fixed value).
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a local session (tests) that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_to(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet below the shared folder and read again: lineage ends at the files."""
    return written_to(df, new_path(df.sparkSession, name))


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later result reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A top-level column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, names) -> list[str]:
    """The columns of df but those of the given names (in any case), which an operator replaces."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def unused(columns, name: str) -> str:
    """name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain(df: DataFrame, carried: list[str], **more: Column) -> tuple[DataFrame, list[str]]:
    """The carried columns under plain names (also returned), then more: Spark's Arrow functions take no dotted names."""
    names = [f"c{i}_" for i in range(len(carried))]
    return df.select(*[column(c).alias(n) for c, n in zip(carried, names)], *[c.alias(n) for n, c in more.items()]), names


def renamed(df: DataFrame, carried: list[str]) -> DataFrame:
    """df, whose first columns are plain()'s, with the carried columns' own names."""
    rest = df.columns[len(carried) :]
    return df.select(*[F.col(n).alias(c) for c, n in zip(carried, df.columns)], *rest)


def slices(batches, rows: int = 256):
    """Short runs of rows of Arrow batches, so that what Python makes of texts at once stays small."""
    for b in batches:
        for first in range(0, b.num_rows, rows):
            yield b.slice(first, rows)


def labelled_sample(docs: DataFrame, labels: DataFrame | None, most: int, most_bytes: int, total_bytes: int) -> list[tuple]:
    """(label, text) of at most `most` rows and total_bytes bytes of each label, in the order of a hash of the id.

    labels has doc_id and label; without it docs has the label itself. Rows are chosen by id and size
    first, with no text in the shuffle; then the chosen few are looked up. An id counts once however
    often it is repeated (its shortest text is taken); null ids, labels and texts, and texts above most_bytes, are left out.
    """
    own = [] if labels is not None else ["label"]
    sizes = docs.select("doc_id", *own, F.octet_length("text").alias("bytes")).where(F.col("doc_id").isNotNull() & (F.col("bytes") <= most_bytes))
    sizes = (sizes if labels is None else sizes.join(labels.select("doc_id", "label").distinct(), "doc_id")).where("label IS NOT NULL")
    sizes = sizes.groupBy("doc_id", "label").agg(F.min("bytes").alias("bytes"))
    counts = {r.label: r.n for r in sizes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # A draw of about twice as many as wanted, so that no sort sees more than a few times the bound.
    share = F.coalesce(*[F.when(F.col("label") == F.lit(label), F.lit(min(1.0, (2 * most + 100) / n))) for label, n in counts.items()])
    drawn = sizes.where(place < share)
    order = Window.partitionBy("label").orderBy(place, "doc_id")
    ranked = drawn.select("doc_id", "label", "bytes", F.row_number().over(order).alias("k"), F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))
    chosen = ranked.where((F.col("k") <= most) & (F.col("so_far") <= total_bytes)).select("doc_id", "label", "bytes", "k").collect()
    if not chosen:
        return []
    few = docs.sparkSession.createDataFrame(chosen, ranked.select("doc_id", "label", "bytes", "k").schema)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= most_bytes).join(F.broadcast(few), "doc_id").where(F.octet_length("text") == F.col("bytes"))
    texts = rows.groupBy("doc_id", "label", "k").agg(F.min("text").alias("text")).collect()
    return [(r.label, r.text) for r in sorted(texts, key=lambda r: (r.k, str(r.label)))]
