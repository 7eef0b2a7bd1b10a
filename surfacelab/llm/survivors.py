"""One row of each group of copies, without a shuffle of the texts that nobody doubts.

A bitmap of fixed size over hashed ids says which rows may have to go; only those are joined to the
exact verdicts, whatever share of the table they are. The bitmap is broadcast, the verdicts aren't.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surfacelab.llm.shared import column, plain, renamed, unused, written

#: Bits of a bitmap: 2 MB, whatever the table; more rows than bits only mean that more rows are joined.
SLOTS = 1 << 24


def slot(ids: Column | str) -> Column:
    return F.xxhash64(ids).bitwiseAND(F.lit(SLOTS - 1))


def bitmap(slots: DataFrame) -> np.ndarray:
    """The bits of a table of slots; a word of 64 bits a row comes to the driver, SLOTS / 64 rows at most."""
    words = slots.select(F.shiftright("slot", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return bits[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1) == 1


def keep_first(docs: DataFrame, groups: DataFrame, node: Callable[[str | None], int]) -> DataFrame:
    """The row of docs with the smallest (doc_id, node), null ids last, of each root of groups; of equal rows one.

    groups: doc_id, node, root of each row of docs (doc_id, text and more); node(text) gives a text's node again.
    """
    spark = docs.sparkSession
    keys = groups.groupBy("doc_id", "node", "root").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "node")
    best = keys.groupBy("root").agg(F.min(rank).alias("best"))
    judged = keys.join(best, "root").select("doc_id", "node", (rank == F.col("best")).alias("stays"), "n")
    odd = written(judged.where("NOT stays OR n > 1").drop("n"), "survivors")
    bits = spark.sparkContext.broadcast(bitmap(odd.select(slot("doc_id").alias("slot"))))
    columns = docs.columns
    maybe_, node_ = unused(columns, "maybe_"), unused(columns, "node_")
    rows, names = plain(docs, columns, slot=slot(column("doc_id").cast("long")), text=column("text").cast("string"))

    def run(batches):
        for b in batches:
            maybe = has(bits.value, b.column("slot").to_numpy())
            nodes = np.zeros(b.num_rows, np.int64)
            for k in np.nonzero(maybe)[0]:
                nodes[k] = node(b.column("text")[int(k)].as_py())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(maybe), pa.array(nodes)], [*names, maybe_, node_])

    schema = T.StructType([*rows.drop("slot", "text").schema.fields, T.StructField(maybe_, T.BooleanType()), T.StructField(node_, T.LongType())])
    told = renamed(rows.mapInArrow(run, schema), columns)
    clear = told.where(~F.col(maybe_)).select(*map(column, columns))
    verdict = odd.select(F.col("doc_id").alias(unused(docs.columns, "id_")), F.col("node").alias(unused([*docs.columns, node_], "at_")), F.col("stays").alias(unused(docs.columns, "stays_")))
    id_, at_, stays_ = verdict.columns
    doubtful = told.where(F.col(maybe_)).join(verdict, column("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(node_) == F.col(at_)), "left").where(F.coalesce(F.col(stays_), F.lit(True)))
    one = doubtful.dropDuplicates(["doc_id", node_]).select(*map(column, docs.columns))
    return clear.unionByName(one)
