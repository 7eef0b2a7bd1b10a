"""Graphs of many small meshes, each worked out in the task that its rows meet in: what rounds give, without their jobs.

A key's rows become one list, and a batch of lists is one graph for numpy. The key stays a column of the planner's, so what lies dealt by it stays so.
Keys of more than IN_TASK rows are not for this: rounds take them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key that one task takes: about 50 bytes each.
IN_TASK = 1 << 20


def fits(rows: DataFrame, key: str) -> bool:
    """No key has more than IN_TASK of the rows."""
    most = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= IN_TASK


def own_fields(node: T.DataType, key: str) -> list[str] | None:
    """The fields of a node besides its key, all of them whole numbers; None where they aren't."""
    fields = [f for f in node.fields if f.name != key] if isinstance(node, T.StructType) else []
    return [f.name for f in fields] if fields and all(isinstance(f.dataType, T.IntegralType) for f in fields) else None


def listed(rows: DataFrame, key: str, name: str, **columns: Column) -> DataFrame:
    """key and its rows as a list of structs of the columns."""
    return rows.groupBy(key).agg(F.collect_list(F.struct(*[v.alias(n) for n, v in columns.items()])).alias(name))


def lists(run, fields: dict[str, T.DataType]):
    """run as a function of list columns: of each argument it gets (of: the place of each row's list in the batch; the rows' fields as arrays),
    and gives (of, fields) of its rows, ordered by of."""
    kind = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))

    def whole(*args: pa.Array) -> pa.Array:
        given = []
        for x in args:
            x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
            sizes = np.diff(x.offsets.to_numpy()) if len(x) else np.zeros(0, int)
            if x.null_count:
                sizes = np.where(x.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            rows = x.flatten()
            given.append((np.repeat(np.arange(len(x)), sizes), {f.name: rows.field(f.name).to_numpy(zero_copy_only=False) for f in rows.type}))
        of, found = run(*given)
        offsets = np.searchsorted(of, np.arange(len(args[0]) + 1)).astype(np.int32)
        arrays = [pa.array(np.ascontiguousarray(found[n]), pa.int64() if isinstance(t, T.LongType) else pa.float64()) for n, t in fields.items()]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, names=list(fields)))

    return F.arrow_udf(whole, returnType=kind)


def numbered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct row in the rows' order, the number of each row among them)."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of each number's component under the edges a, b."""
    label = np.arange(n)
    while True:
        one, two = label[a], label[b]
        least, now = np.minimum(one, two), label.copy()
        np.minimum.at(now, one, least)
        np.minimum.at(now, two, least)
        while True:
            further = now[now]
            if np.array_equal(further, now):
                break
            now = further
        if np.array_equal(now, label):
            return label
        label = now


def _ends(of: np.ndarray, e: dict[str, np.ndarray], fields: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(columns of both ends of edges, a place of each distinct node among them, the numbers of a and of b)."""
    columns = [np.concatenate([of, of]), *[np.concatenate([e["a_" + f], e["b_" + f]]).astype(np.int64) for f in fields]]
    first, number = numbered(columns)
    return columns, first, number[: len(of)], number[len(of) :]


def component_labels(links: DataFrame, key: str, own: str, fields: list[str]) -> DataFrame:
    """own, node, label of links (own, a, b) whose nodes have the field key, which is own, and the fields given."""

    def run(given):
        of, e = given
        columns, first, a, b = _ends(of, e, fields)
        label = first[roots(len(first), a, b)]
        return columns[0][first], {f"{n}_{f}": c[at] for n, at in (("n", first), ("l", label)) for f, c in zip(fields, columns[1:])}

    packed = listed(links, own, "e", **{f"{n}_{f}": F.col(n)[f] for n in "ab" for f in fields})
    got = packed.select(own, F.inline(lists(run, {f"{n}_{f}": T.LongType() for n in "nl" for f in fields})("e")))
    return got.select(own, *[_node(links.schema["a"].dataType, key, own, n + "_").alias(name) for n, name in (("n", "node"), ("l", "label"))])


def _node(kind: T.StructType, key: str, own: str, prefix: str) -> Column:
    return F.struct(*[(F.col(own) if f.name == key else F.col(prefix + f.name)).cast(f.dataType).alias(f.name) for f in kind.fields])


def shortest_paths(sources: DataFrame, both: DataFrame, most: float, key: str, own: str, fields: list[str]) -> DataFrame:
    """own, node, distance from sources (own, node) over edges (own, a, b, w) given in both directions, up to most."""

    def run(begun, given):
        (at, s), (of, e) = begun, given
        columns = [np.concatenate([of, of, at]), *[np.concatenate([e["a_" + f], e["b_" + f], s["n_" + f]]).astype(np.int64) for f in fields]]
        first, number = numbered(columns)
        a, b = number[: len(of)], number[len(of) : 2 * len(of)]
        distance = np.full(len(first), np.inf)
        distance[number[2 * len(of) :]] = 0.0
        fresh = np.isfinite(distance)
        while fresh.any():
            out = fresh[a]
            new = distance[a[out]] + e["w"][out]
            before, keep = distance.copy(), new <= most
            np.minimum.at(distance, b[out][keep], new[keep])
            fresh = distance < before
        met = first[np.isfinite(distance)]
        return columns[0][met], {**{"n_" + f: c[met] for f, c in zip(fields, columns[1:])}, "distance": distance[np.isfinite(distance)]}

    begun = listed(sources, own, "s", **{"n_" + f: F.col("node")[f] for f in fields})
    packed = listed(both, own, "e", **{f"{n}_{f}": F.col(n)[f] for n in "ab" for f in fields}, w=F.col("w"))
    found = lists(run, {**{"n_" + f: T.LongType() for f in fields}, "distance": T.DoubleType()})
    got = begun.hint("merge").join(packed, own, "left").select(own, F.inline(found("s", "e")))
    return got.select(own, _node(sources.schema["node"].dataType, key, own, "n_").alias("node"), "distance")


def loop_places(loops: DataFrame) -> DataFrame:
    """mesh, vid, pos of loops (mesh, vid, next, loop): the steps from the loop's vertex loop to vid, by doubling."""

    def run(given):
        of, e = given
        vid, ahead, loop = (e[k].astype(np.int64) for k in ("vid", "next", "loop"))
        _, number = numbered([np.concatenate([of, of]), np.concatenate([ahead, vid])])
        here, before = number[: len(of)], number[len(of) :]
        to, pos = np.arange(len(of)), np.zeros(len(of), np.int64)
        to[here], pos[here] = np.where(ahead == loop, here, before), ahead != loop
        while not np.array_equal(far := to[to], to):
            to, pos = far, pos + pos[to]
        return of, {"vid": ahead, "pos": pos[here]}

    packed = listed(loops, "mesh", "e", **{k: F.col(k) for k in ("vid", "next", "loop")})
    return packed.select("mesh", F.inline(lists(run, {"vid": T.LongType(), "pos": T.LongType()})("e")))
