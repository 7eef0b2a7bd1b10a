"""Operator 8, embedding near-duplicates by dual traversal of cover trees.

Equal vectors of a label are one class, joined once. The top of the tree is made in Spark: level by
level a node of more than node_rows classes is dealt to the nearest of some of its own members (drawn by a
hash, its smallest and its furthest one), in salted groups of bounded size, and a child's covering radius is its
furthest member. Then all trees are traversed together with themselves, again level by level: a pair
of nodes whose centres lie further apart than both radii and the threshold allow is pruned, one that
lies wholly within the threshold is counted by its sizes, any other gives way to the pairs of its
children. Only pairs of leaves that remain are dealt to tasks, of at most 2 * node_rows rows; there nested levels of
halving radii are built and traversed together by the same bounds, to the exact cosines at
the end. A task returns for each class its number of links and one link to the smallest class it
reaches there, never the pairs.

Directions that hardly differ (multiples of one another) can't be split: such a node links wholly with
itself, and where it is large it is cut by a hash when it meets another one that neither bound decides.

Cases: a null, empty or zero vector, one with null or non-finite components, and a row of null
label or null vec_id link with nothing (n_links 0, component_id its vec_id); vectors of a label
that differ in length don't link; equal vectors and multiples link with each other; rows that share a vec_id are
taken as one node; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surfacelab.llm.components import components
from surfacelab.llm.shared import table, written

#: Members that a node is split by in expectation, at most (a node of few leaves takes fewer), classes of a leaf, classes of a group that is dealt to them at once.
FANOUT, NODE_ROWS, GROUP_ROWS = 32, 8192, 16_384
#: Rows whose pairs are compared without further levels; nodes of a level and pairs of rows that are worked on at once, links held.
LEAF, BLOCK, PAIRS, HELD = 128, 256, 1 << 15, 1 << 20
#: Allowance for rounding in distances, and the radius below which directions count as one.
SLACK, TIGHT = 1e-6, 1e-6


class Tree:
    """Cover tree of unit rows: levels of halving radii below a root of radius 2."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.root = self._node(np.arange(len(unit)), 0, 2.0)

    def _node(self, rows: np.ndarray, centre: int, radius: float) -> dict:
        d = distance(self.unit[rows], self.unit[centre])
        return {"rows": rows, "centre": centre, "reach": float(d.max()) if len(rows) > 1 else 0.0, "radius": radius, "children": None}

    def children(self, node: dict) -> list[dict]:
        """Members within a smaller radius of a centre, the rest to the next centre; made when first asked for.

        The radius is halved until it is below the reach, so a level splits; directions that are one don't.
        """
        if node["reach"] <= TIGHT:
            return [node]
        if node["children"] is None:
            left, radius, out = node["rows"], node["radius"] / 2, []
            while radius >= node["reach"]:
                radius /= 2
            left = np.concatenate([[node["centre"]], left[left != node["centre"]]])
            taken = np.zeros(len(left), bool)
            for k in range(0, len(left), BLOCK):
                free = np.nonzero(~taken[k : k + BLOCK])[0]
                ahead = distance(self.unit[left[k + free]], self.unit[left[k:]])
                for i, d in zip(free, ahead):
                    if not taken[k + i]:
                        own = (d <= radius) & ~taken[k:]
                        own[i] = True
                        taken[k:] |= own
                        rows = left[k:][own]
                        out.append({"rows": rows, "centre": int(left[k + i]), "reach": float(d[own].max()) if len(rows) > 1 else 0.0, "radius": radius, "children": None})
            node["children"] = out
        return node["children"]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chord between unit rows of a and of b (or one row)."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def level(nodes: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, reaches and whether there is one row alone, of the nodes of a level."""
    return np.array([n["centre"] for n in nodes]), np.array([n["reach"] for n in nodes]), np.array([len(n["rows"]) == 1 for n in nodes])


def traverse(a: Tree, b: Tree, raw_a: np.ndarray, raw_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float, same: bool):
    """Links of each row of a and b, and stars (row of a or, from len(a) on, of b) that connect what links."""
    bound = float(np.sqrt(2.0 - 2.0 * least))
    norm_a, norm_b = np.linalg.norm(raw_a, axis=1), np.linalg.norm(raw_b, axis=1)
    links_a, links_b = np.zeros(len(raw_a), np.int64), np.zeros(len(raw_b), np.int64)
    shift = 0 if same else len(raw_a)
    stars: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def note(i: np.ndarray, j: np.ndarray) -> None:
        """Remembers links; many become stars, so that what is held stays small."""
        nonlocal held
        stars.append((i, j))
        held += len(i)
        if held > HELD:
            stars[:] = [star(*(np.concatenate(c) for c in zip(*stars)))]
            held = len(stars[0][0])

    todo = [(a.root, b.root)]
    while todo:
        x, y = todo.pop()
        own = same and x is y
        if own and 2 * x["reach"] <= bound - SLACK:
            links_a[x["rows"]] += size_a[x["rows"]].sum() - size_a[x["rows"]]
            note(np.full(len(x["rows"]), x["rows"][0]), x["rows"])
            continue
        if len(x["rows"]) * len(y["rows"]) <= LEAF * LEAF or max(x["reach"], y["reach"]) <= TIGHT:
            for k in range(0, len(x["rows"]), 1024):
                part = x["rows"][k : k + 1024]
                linked = (raw_a[part] @ raw_b[y["rows"]].T) / norm_a[part][:, None] / norm_b[y["rows"]][None, :] >= least
                if own:
                    linked[np.arange(len(part)), np.arange(k, k + len(part))] = False
                if linked.any():
                    links_a[part] += linked @ size_b[y["rows"]]
                    if not own:
                        (links_a if same else links_b)[y["rows"]] += linked.T @ size_a[part]
                    i, j = np.nonzero(linked)
                    note(part[i], y["rows"][j] + shift)
            continue
        xs, ys = a.children(x), b.children(y)
        (at_x, reach_x, alone_x), (at_y, reach_y, alone_y) = (level(n) for n in (xs, ys))
        for k in range(0, len(xs), BLOCK):
            part = slice(k, k + BLOCK)
            d = distance(a.unit[at_x[part]], b.unit[at_y])
            reach = reach_x[part, None] + reach_y
            near = d <= bound + reach + SLACK
            if own:
                near &= np.arange(k, k + len(d))[:, None] <= np.arange(len(ys))
            # Pairs of single rows are compared at once.
            one = alone_x[part, None] & alone_y
            i, j = np.nonzero(near & one)
            i += k
            if own:
                i, j = i[i != j], j[i != j]
            for first in range(0, len(i), PAIRS):
                p, q = at_x[i[first : first + PAIRS]], at_y[j[first : first + PAIRS]]
                linked = np.einsum("ij,ij->i", raw_a[p], raw_b[q]) / norm_a[p] / norm_b[q] >= least
                p, q = p[linked], q[linked]
                if len(p):
                    links_a += np.bincount(p, size_b[q], len(links_a)).astype(np.int64)
                    (links_a if same else links_b)[:] += np.bincount(q, size_a[p], len(links_a if same else links_b)).astype(np.int64)
                    note(p, q + shift)
            near &= ~one
            within = near & (d + reach <= bound - SLACK)
            if own:
                within[np.arange(len(d)), np.arange(k, k + len(d))] = False
            for i, j in zip(*np.nonzero(within)):
                p, q = xs[k + i], ys[j]
                links_a[p["rows"]] += size_b[q["rows"]].sum()
                (links_a if same else links_b)[q["rows"]] += size_a[p["rows"]].sum()
                note(np.full(len(q["rows"]), p["rows"][0]), q["rows"] + shift)
                note(p["rows"], np.full(len(p["rows"]), q["rows"][0] + shift))
            todo += [(xs[k + i], ys[j]) for i, j in zip(*np.nonzero(near & ~within))]
    return links_a, links_b, stars


def star(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what (i, j) do, one for each node: labels spread until they stay."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j, label = at[: len(i)], at[len(i) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        if np.array_equal(new, label):
            return nodes[label], nodes
        label = new[new]


def join_parts(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """rep, links, root of the classes that link between the two parts (side 0 and 1) of a group."""
    group = group.sort_values("rep", kind="stable")
    sides = [group[group.side == s] for s in (0, 1)]
    same = len(sides[1]) == 0
    if len(sides[0]) == 0 or (same and group.is_pair.iloc[0]):
        return pd.DataFrame({"rep": [], "links": [], "root": []})
    if same:
        sides[1] = sides[0]
    raw = [np.stack(s.embedding.to_numpy()).astype(float) for s in sides]
    # Scaled first, so that squares of very large or small components stay finite.
    raw = [r / np.abs(r).max(axis=1, keepdims=True) for r in raw]
    trees = [Tree(r / np.linalg.norm(r, axis=1, keepdims=True)) for r in raw[: 1 if same else 2]]
    size = [s.copies.to_numpy() for s in sides]
    links_a, links_b, stars = traverse(trees[0], trees[-1], *raw, *size, least, same)
    reps = sides[0].rep.to_numpy() if same else np.concatenate([s.rep.to_numpy() for s in sides])
    links = links_a if same else np.concatenate([links_a, links_b])
    root = np.arange(len(reps))
    if stars:
        a, b = (np.concatenate(x) for x in zip(*stars))
        one, two = star(a, b)
        # star() names the smallest place of a component; the smallest id is wanted.
        least_id = pd.Series(reps[two]).groupby(one).min()
        found = np.array(reps)
        found[two] = least_id.loc[one].to_numpy()
        root = found
    else:
        root = reps
    keep = links > 0
    return pd.DataFrame({"rep": reps[keep], "links": links[keep], "root": root[keep]})


def classes(vectors: DataFrame) -> DataFrame:
    """label, embedding, rep (smallest vec_id), copies of the vectors that can link."""
    e = F.col("embedding")
    good = (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull()).where(good)
    return rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def to_nearest(pivots: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """rep, embedding, copies, pivot and its distance, of a group's rows."""
    units = []
    for part in (rows, pivots):
        x = np.stack(part.embedding.to_numpy()).astype(float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        units.append(x / np.linalg.norm(x, axis=1, keepdims=True))
    best, away = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for k in range(0, len(rows), 2048):
        d = distance(units[0][k : k + 2048], units[1])
        best[k : k + 2048] = d.argmin(axis=1)
        away[k : k + 2048] = d.min(axis=1)
    return rows[["node", "rep", "embedding", "copies"]].assign(pivot=pivots["pivot"].to_numpy()[best], away=away)


def unit(e: Column) -> Column:
    """A vector's direction in doubles; scaled first, so that squares stay finite."""
    most = F.array_max(F.transform(e, lambda x: F.abs(x.cast("double"))))
    scaled = F.transform(e, lambda x: x.cast("double") / most)
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(scaled, lambda x: x / norm)


def top_levels(reps: DataFrame, node_rows: int, fanout: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(tree, rows): the nodes (node, parent, n, reach, copies, least, far, leaf, centre), and the classes with their leaf."""
    rows = written(reps.select(F.xxhash64("label", F.size("embedding")).alias("node"), "rep", "embedding", "copies", F.lit(2.0).alias("away")), "vector-level")
    centres = None
    tree, closed, level = [], [], 0
    while True:
        stats = rows.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.max("away").alias("reach"), F.sum("copies").alias("copies"), F.min("rep").alias("least"), F.max_by("rep", "away").alias("far")
        )
        leaf = (F.col("n") <= node_rows) | (F.col("reach") <= TIGHT)
        if centres is None:
            stats = stats.select(F.lit(None).cast("long").alias("parent"), "*", leaf.alias("leaf"), F.lit(None).cast("array<double>").alias("centre"))
        else:
            stats = centres.join(stats, "node").select("parent", "node", "n", "reach", "copies", "least", "far", leaf.alias("leaf"), "centre")
        tree.append(written(stats, "vector-nodes"))
        wide = tree[-1].where("NOT leaf").select("node", "n", "least", "far")
        if wide.isEmpty():
            closed.append(rows)
            break
        closed.append(rows.join(wide, "node", "left_anti"))
        level += 1
        opened = rows.join(wide, "node")
        groups = F.ceil(F.col("n") / group_rows)
        draw = F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 40)) / float(1 << 40)
        pivots = written(opened.where((draw < F.least(F.lit(fanout), 2 * F.col("n") / node_rows) / F.col("n")) | F.col("rep").isin(F.col("least"), F.col("far"))).select("node", F.col("rep").alias("pivot"), "embedding", groups.alias("groups")), "vector-pivots")
        sent = pivots.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups").cast("long") - 1)).alias("group"), "pivot", "embedding")
        dealt = opened.select("node", F.pmod(F.xxhash64("rep", F.lit("group")), groups.cast("long")).alias("group"), "rep", "embedding", "copies")
        schema = T.StructType([T.StructField("node", T.LongType()), *reps.select("rep", "embedding", "copies").schema.fields, T.StructField("pivot", T.LongType()), T.StructField("away", T.DoubleType())])
        near = sent.groupBy("node", "group").cogroup(dealt.groupBy("node", "group")).applyInPandas(lambda p, r: to_nearest(p, r) if len(r) else r.assign(pivot=0, away=0.0)[[f.name for f in schema]], schema)
        child = F.xxhash64("node", "pivot")
        centres = pivots.select(child.alias("node"), F.col("node").alias("parent"), unit(F.col("embedding")).alias("centre"))
        rows = written(near.select(child.alias("node"), "rep", "embedding", "copies", "away"), "vector-level")
    whole, leaves = tree[0], closed[0]
    for more in tree[1:]:
        whole = whole.unionByName(more)
    for more in closed[1:]:
        leaves = leaves.unionByName(more)
    return whole, leaves.drop("away")


def node_pairs(tree: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(leaf pairs to compare, pairs wholly linked) as p, q with p = q for a node and itself, by traversing the tree with itself."""
    bound = float(np.sqrt(2.0 - 2.0 * least))
    info = tree.select("node", "reach", "leaf", "centre")
    kids = tree.where("parent IS NOT NULL").select(F.col("parent").alias("of"), *info.columns).unionByName(info.where("leaf").select(F.col("node").alias("of"), "*"))
    x, y = (kids.select(*[F.col(c).alias(c + side) for c in kids.columns]) for side in "xy")
    roots = tree.where("parent IS NULL").select(F.col("node").alias("p"), F.col("node").alias("q"), F.when(F.col("leaf"), "leaf").otherwise("open").alias("state"))
    levels = [written(roots, "vector-pairs")]
    own = F.col("nodex") == F.col("nodey")
    away = F.when(own, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with("centrex", "centrey", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))))
    while not (wide := levels[-1].where("state = 'open'")).isEmpty():
        met = wide.join(x, F.col("p") == F.col("ofx")).join(y, F.col("q") == F.col("ofy")).where("p <> q OR nodex <= nodey")
        met = met.withColumn("away", away).withColumn("radii", F.col("reachx") + F.col("reachy")).where(own | (F.col("away") <= bound + SLACK + F.col("radii")))
        state = F.when(F.col("away") + F.col("radii") <= bound - SLACK, "within").when(F.col("leafx") & F.col("leafy"), "leaf").otherwise("open")
        levels.append(written(met.select(F.col("nodex").alias("p"), F.col("nodey").alias("q"), state.alias("state")), "vector-pairs"))
    pairs = levels[0]
    for more in levels[1:]:
        pairs = pairs.unionByName(more)
    return tuple(pairs.where(F.col("state") == s).select("p", "q") for s in ("leaf", "within"))


def whole_links(tree: DataFrame, rows: DataFrame, within: DataFrame) -> DataFrame:
    """rep, links, root of what the wholly linked pairs of nodes give, by the nodes' sizes."""
    sizes = tree.select("node", "copies", "least")
    p, q = (sizes.select(*[F.col(c).alias(c + side) for c in sizes.columns]) for side in "pq")
    met = within.join(p, F.col("p") == F.col("nodep")).join(q, F.col("q") == F.col("nodeq"))
    one = met.select(F.col("p").alias("node"), F.col("leastp").alias("root"), F.col("copiesq").alias("more"), (F.col("p") == F.col("q")).cast("long").alias("itself"))
    two = met.where("p <> q").select(F.col("q").alias("node"), F.col("leastq").alias("root"), F.col("copiesp").alias("more"), F.lit(0).cast("long").alias("itself"))
    gained = written(one.unionByName(two).groupBy("node").agg(F.min("root").alias("root"), F.sum("more").alias("more"), F.sum("itself").alias("itself")), "vector-whole")
    # A leaf has what its ancestors gained, too.
    line = tree.where("leaf").select("node", F.col("node").alias("above"))
    up = tree.where("parent IS NOT NULL").select(F.col("node").alias("above"), "parent")
    lines = [line]
    while not line.isEmpty():
        line = written(line.join(up, "above").select("node", F.col("parent").alias("above")), "vector-lines")
        lines.append(line)
    every = lines[0]
    for more in lines[1:]:
        every = every.unionByName(more)
    leaves = every.join(gained.withColumnRenamed("node", "above"), "above").groupBy("node").agg(F.min("root").alias("root"), F.sum("more").alias("more"), F.sum("itself").alias("itself"))
    members = rows.join(leaves, "node").select("rep", (F.col("more") - F.col("itself") * F.col("copies")).alias("links"), "root")
    return members.unionByName(met.where("p <> q").select(F.col("leastp").alias("rep"), F.lit(0).cast("long").alias("links"), F.col("leastq").alias("root")))


def links_and_roots(reps: DataFrame, least: float, node_rows: int = NODE_ROWS, fanout: int = FANOUT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """rep, links, root rows of classes: sums of links and the roots' components give the result."""
    tree, rows = top_levels(reps, node_rows, fanout, group_rows)
    pairs, within = node_pairs(tree, least)
    # Only leaves whose directions are one have several parts.
    parts = tree.where("leaf").select("node", F.ceil(F.col("n") / node_rows).cast("int").alias("parts"))
    each = parts.select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    p, q = (each.select(F.col("node").alias(side), F.col("part").alias("part" + side)) for side in "pq")
    tasks = pairs.join(p, "p").join(q, "q").where("p <> q OR partp <= partq")
    is_pair = (F.col("p") != F.col("q")) | (F.col("partp") != F.col("partq"))
    tasks = written(tasks.select("*", F.xxhash64("p", "partp", "q", "partq").alias("task"), is_pair.alias("is_pair")), "vector-tasks")
    one = tasks.select(F.col("p").alias("node"), F.col("partp").alias("part"), "task", F.lit(0).alias("side"), "is_pair")
    two = tasks.where("is_pair").select(F.col("q").alias("node"), F.col("partq").alias("part"), "task", F.lit(1).alias("side"), "is_pair")
    placed = rows.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("rep", F.lit("part")), F.col("parts")).cast("int")).drop("parts")
    sent = placed.join(one.unionByName(two), ["node", "part"]).select("task", "side", "is_pair", "rep", "embedding", "copies")
    found = sent.groupBy("task").applyInPandas(lambda g: join_parts(g, least), "rep long, links long, root long")
    return found if within.isEmpty() else found.unionByName(whole_links(tree, rows, within))


def near_vectors(vectors: DataFrame, least: float = 0.98, **parameters) -> DataFrame:
    """vec_id, n_links, component_id, kept of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding"))
    reps = written(classes(rows), "vector-classes")
    found = written(links_and_roots(reps, least, **parameters), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("rep <> root"), "rep", "root").withColumnRenamed("node", "rep")
    named = reps.join(counts, "rep", "left").join(roots, "rep", "left").select("label", "embedding", "rep", "copies", "links", "root")
    out = rows.join(named, ["label", "embedding"], "left")
    can = F.col("vec_id").isNotNull() & F.col("rep").isNotNull()
    out = out.select(
        "vec_id",
        F.when(can, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(can, F.coalesce("root", "rep")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_sql() -> str:
    return """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
