"""Operator 13, repair of conversation structure by a cost DP and prefix-doubling path ranking.

A conversation's rows, in order of turn, become a conversation of role initials `(s?(ua)+)?` by the
cheapest edits: keep, rerole to user or assistant, delete, insert an empty turn. What has been built so far
is one of four states (nothing, after s, after u, after a), so an edit leads from a node (row, state) to one
other node, and the audit, the string of the edits' initials, decides all roles.

Rows are sorted by range, so a conversation of any length is the work of many tasks. Each task packs its
runs of rows into segments, a byte a row, with a min-plus matrix of the cost between states at both ends. A
suffix product of these small matrices, one conversation at a time, gives every segment the cost from each of
its last states to the end. Then, for each segment:

* cost DP: each node's distance to the end; an arc is optimal if its cost and its target's distance make it up;
* ranking: nodes are ranked by the least string of 1, 2, 4, ... edits over optimal arcs. A node of rank r whose
  pointer leads k edits ahead to a node of rank r' is of rank (r, r') for 2k edits, and its pointer is its pointer's;
* reading: the nodes on a path are doubled likewise, k more by the pointers of k edits.

Which of a segment's four paths holds is the former segment's last state, chained per conversation.

Faults: a row is blank, else a duplicate (role and text seen earlier), else truncated (last character other
than white space not one of .!?). Equal rows of one turn are one row with a count; copies are deleted at once,
as the letter of a deletion is the least.

Cases: null roles and texts are one space; null turns come first; rows of one turn come by role, then by
the SHA-256 of their text; rows of a null conv_id are one conversation; an empty table gives empty results;
a conversation's audit is one string, of a byte an edit; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacelab.llm.shared import new_path, table, written_to

#: Costs of the edits and of keeping a truncated row (fixed values of the contract).
DELETE, REROLE, INSERT, CUT = 4, 3, 3, 3
FAR = 1 << 60
#: States: nothing yet, after s, after u, after a. Initials: s, u, a, others.
NEXT_TURN = np.array([2, 2, 3, 2])
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: Cost and letters of ending a conversation in each state.
CLOSE, CLOSING = np.array([0, 2 * INSERT, INSERT, 0]), ["", "II", "I", ""]
#: Edits in the order of their letters.
EDITS = "DIKR"
#: Rows of segments that are ranked at once.
ROWS = 1 << 15
WHITE = "\\x20\\x09-\\x0D"
ROW = ["untimed", "conv", "timed", "turn", "role", "sha"]


def faults(rows: DataFrame) -> DataFrame:
    """One row for each distinct row of rows (conv_id, turn, role, text), without its text: its key, initial, blank, cut and the number n of its copies."""
    keyed = _keyed(rows).withColumn("blank", ~F.col("text").rlike(f"[^{WHITE}]")).withColumn("cut", ~F.col("text").rlike(f"[.!?][{WHITE}]*\\z"))
    return keyed.groupBy(*ROW, "blank", "cut").agg(F.count(F.lit(1)).alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        conv.isNull().alias("untimed"), F.coalesce(conv, F.lit(0)).alias("conv"), turn.isNotNull().alias("timed"), F.coalesce(turn, F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"),
    )


def ordered(keys: DataFrame) -> DataFrame:
    """keys with duplicate, sorted by conversation and turn over ranges, numbered by at."""
    same = ["untimed", "conv", "role", "sha"]
    first = keys.groupBy(*same).agg(F.min(F.struct("timed", "turn")).alias("first"))
    marked = keys.join(first, same).withColumn("duplicate", F.struct("timed", "turn") > F.col("first"))
    sort = [F.col(c) for c in ROW]
    return marked.repartitionByRange(*sort).sortWithinPartitions(*sort).select(*ROW, "blank", "duplicate", "cut", "n", F.monotonically_increasing_id().alias("at"))


SEGMENT = "untimed boolean, conv long, at long, n long, codes binary, copies binary, matrix array<long>, blank long, duplicate long, cut long, illegal long, first int, last int, timed array<long>"


def segments(rows: DataFrame) -> DataFrame:
    """Runs of rows of one conversation that stand together, packed: four bits of initial and fault a row, copies, costs and counts."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield _packed(b)

    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    flags = [F.when(F.col(c), bit).otherwise(0) for c, bit in (("blank", 4), ("duplicate", 8), ("cut", 16))]
    return rows.select("untimed", "conv", "at", (code + flags[0] + flags[1] + flags[2]).cast("int").alias("code"), "n", "timed", "turn").mapInArrow(run, SEGMENT)


def _packed(b: pa.RecordBatch) -> pa.RecordBatch:
    untimed, conv, at, code, n, timed, turn = (c.to_numpy(zero_copy_only=False) for c in b.columns)
    new = np.ones(len(at), bool)
    new[1:] = (conv[1:] != conv[:-1]) | (untimed[1:] != untimed[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.nonzero(new)[0]
    stop = np.append(start[1:], len(at))
    blank, initial = code & 4 > 0, code & 3
    duplicate = ~blank & (code & 8 > 0)
    # Copies of a row are blank with it, else duplicates.
    counts = [np.where(blank, n, 0), np.where(blank, 0, n - 1 + duplicate), (~blank & ~duplicate & (code & 16 > 0)).astype(np.int64)]
    legal = {(0, 1), (1, 2), (2, 1)}
    allowed = np.array([[(x, y) in legal for y in range(4)] for x in range(4)])
    breaks = n - 1
    breaks[1:] += ~new[1:] & ~allowed[initial[:-1], initial[1:]]
    counts.append(breaks)
    distinct = timed & np.append(True, new[1:] | ~timed[:-1] | (turn[1:] != turn[:-1]))
    sums = [np.add.reduceat(c, start) for c in [*counts, distinct.astype(np.int64)]]
    packed = np.where(blank | duplicate, 4, 0) + np.where(code & 16 > 0, 16, 0) + initial
    matrices = np.zeros((len(start), 16), np.int64)
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    for own, grid in _grids(packed, n - 1, start, stop):
        matrices[own] = distances(*grid, np.broadcast_to(unit, (len(own), 4, 4)))[0].reshape(len(own), 16)
    times = []
    for x, y, d in zip(start, stop, sums[4]):
        seen = np.nonzero(timed[x:y])[0]
        times.append([int(turn[x + seen[0]]), int(turn[x + seen[-1]]), int(d)] if len(seen) else [])
    codes = [packed[x:y].astype(np.uint8).tobytes() for x, y in zip(start, stop)]
    copies = [(n[x:y] - 1).astype(np.int64).tobytes() if (n[x:y] > 1).any() else b"" for x, y in zip(start, stop)]
    arrays = [untimed[start], conv[start], at[start], stop - start, codes, copies, list(matrices), *sums[:4], initial[start].astype(np.int32), initial[stop - 1].astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(times, pa.list_(pa.int64()))], ["untimed", "conv", "at", "n", "codes", "copies", "matrix", "blank", "duplicate", "cut", "illegal", "first", "last", "timed"])


def _grids(codes: np.ndarray, copies: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Segments of about one length as grids (segments x rows), their last rows aligned: their numbers, (codes, copies, lengths)."""
    n = stop - start
    order = np.argsort(n, kind="stable")
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and n[order[last]] <= 2 * n[order[first]] and (last + 1 - first) * n[order[last]] <= ROWS:
            last += 1
        own = order[first:last]
        wide = int(n[own[-1]])
        place = stop[own][:, None] + np.arange(-wide, 0)
        there = place >= start[own][:, None]
        place = np.where(there, place, 0)
        yield own, (np.where(there, codes[place], 3), np.where(there, copies[place], 0), n[own])
        first = last


def _arcs(codes: np.ndarray, copies: np.ndarray):
    """Cost and next state of D, K, R from each state, for rows of these codes: arrays (rows, 4); an edit that can't be has cost FAR."""
    dead, extra = (codes & 4 > 0)[:, None], DELETE * copies[:, None]
    keep = np.where(codes & 16 > 0, CUT, 0)[:, None] + extra
    kept = KEPT[codes & 3]
    delete = np.broadcast_to(DELETE + extra, kept.shape)
    same, turn, rerole = (np.broadcast_to(x, kept.shape) for x in (np.arange(4), NEXT_TURN, np.where(dead, FAR, keep + REROLE)))
    return {"D": (delete, same), "K": (np.where(dead | (kept < 0), FAR, keep), np.maximum(kept, 0)), "R": (rerole, turn)}


def distances(codes: np.ndarray, copies: np.ndarray, n: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost DP: least cost from each state before the first row, and before every row (segments, rows + 1, 4, ends); end is (segments, 4, ends)."""
    width = codes.shape[1]
    all_ = np.zeros((len(n), width + 1, 4, end.shape[2]), np.int64)
    all_[:, width] = now = end
    for k in range(width - 1, -1, -1):
        least = np.full_like(now, FAR)
        for cost, to in _arcs(codes[:, k], copies[:, k]).values():
            least = np.minimum(least, cost[:, :, None] + np.take_along_axis(now, to[:, :, None], 1))
        # An insertion goes on from the next state of the same row; two bring every state to all it may reach.
        for _ in range(2):
            least = np.minimum(least, INSERT + least[:, NEXT_TURN])
        now = np.minimum(np.where((n >= width - k)[:, None, None], least, now), FAR)
        all_[:, k] = now
    return now, all_


def least_paths(codes: np.ndarray, copies: np.ndarray, n: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least optimal audit from each state before the first row: edits (segments, 4, length; 0 after the last), last states, and costs."""
    cost, near = distances(codes, copies, n, end[:, :, None])
    near = near[..., 0]
    s, width = codes.shape
    layers = width + 1
    node = np.arange(s * layers * 4).reshape(s, layers, 4)
    rank = np.zeros(node.shape, np.int64)
    ahead = node.copy()
    arcs = {e: (c.reshape(s, width, 4), t.reshape(s, width, 4)) for e, (c, t) in _arcs(codes.ravel(), copies.ravel()).items()}
    real = (np.arange(width) >= (width - n)[:, None])[:, :, None]
    # Ranks by one edit: the least letter of a node's optimal arcs; a segment's last nodes have none.
    for k, letter in reversed(list(enumerate(EDITS, 1))):
        if letter == "I":
            to = np.broadcast_to(NEXT_TURN, (s, width, 4))
            best = INSERT + np.take_along_axis(near[:, :width], to, 2) == near[:, :width]
            at = np.take_along_axis(node[:, :width], to, 2)
        else:
            c, to = arcs[letter]
            best = c + np.take_along_axis(near[:, 1:], to, 2) == near[:, :width]
            at = np.take_along_axis(node[:, 1:], to, 2)
        best = best & real
        rank[:, :width][best], ahead[:, :width][best] = k, at[best]
    edit, ahead, rank = rank.ravel(), ahead.ravel(), rank.ravel()
    path = node[np.arange(s), width - n].reshape(s, 4, 1)
    while True:
        path = np.concatenate([path, ahead[path]], 2)
        if (rank[path[:, :, -1]] == 0).all():
            break
        # Twice as many edits: by the rank of the first half, then of the node that it leads to.
        _, rank = np.unique(rank * (rank.max() + 1) + rank[ahead], return_inverse=True)
        ahead = ahead[ahead]
    # Nodes without edits are of rank 0 in every round, as an empty audit is the least.
    return edit[path], path[:, :, -1] % 4, cost[..., 0]


def _spelled(audit: str, copies: bytes) -> str:
    """An audit with a D for each copy of a row, after the row's own edit."""
    if not copies:
        return audit
    extra, row, out = np.frombuffer(copies, np.int64), 0, []
    for e in audit:
        out.append(e)
        if e != "I":
            out.append("D" * int(extra[row]))
            row += 1
    return "".join(out)


def _grouped(df: DataFrame, *more: str) -> DataFrame:
    return df.groupBy("untimed", "conv").agg(F.sort_array(F.collect_list(F.struct("at", *more))).alias("parts"))


def exits(found: DataFrame) -> DataFrame:
    """at, end of each segment: the least cost from each state after it to the conversation's end, by a suffix product of matrices."""

    def run(batches):
        for b in batches:
            at, ends = [], []
            for parts in b.column("parts").to_pylist():
                end = CLOSE
                for p in reversed(parts):
                    at.append(p["at"]), ends.append(end.tolist())
                    end = (np.array(p["matrix"], np.int64).reshape(4, 4) + end).min(1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["at", "end"])

    return _grouped(found, "matrix").select("parts").mapInArrow(run, "at long, end array<long>")


def _segment_grids(b: pa.RecordBatch):
    n = b.column("n").to_numpy()
    stop = np.cumsum(n)
    codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).astype(np.int64)
    copies = np.concatenate([np.frombuffer(c, np.int64) if c else np.zeros(k, np.int64) for c, k in zip(b.column("copies").to_pylist(), n)])
    return codes, copies, _grids(codes, copies, stop - n, stop)


def paths(found: DataFrame, ends: DataFrame) -> DataFrame:
    """untimed, conv, at, codes, copies, audits, last, cost, turns of each segment: for each first state the edits, last state, cost to the end, and rows left."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            end = np.array(b.column("end").to_pylist(), np.int64)
            audits, last, cost, turns = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            letters, copies = np.frombuffer(b"." + EDITS.encode(), np.uint8), b.column("copies").to_pylist()
            for own, grid in _segment_grids(b)[2]:
                edits, to, costs = least_paths(*grid, end[own])
                for i, k in enumerate(own):
                    audits[k] = [_spelled(letters[e[e > 0]].tobytes().decode(), copies[k]) for e in edits[i]]
                    turns[k] = [len(a) - a.count("D") for a in audits[k]]
                    last[k], cost[k] = to[i].tolist(), costs[i].tolist()
            longs = pa.list_(pa.int64())
            arrays = [*(b.column(c) for c in ("untimed", "conv", "at", "codes", "copies")), pa.array(audits, pa.list_(pa.string())), pa.array(last, longs), pa.array(cost, longs), pa.array(turns, longs)]
            yield pa.RecordBatch.from_arrays(arrays, ["untimed", "conv", "at", "codes", "copies", "audits", "last", "cost", "turns"])

    joined = found.select("untimed", "conv", "at", "n", "codes", "copies").join(ends, "at").select("untimed", "conv", "at", "n", "codes", "copies", "end")
    return joined.mapInArrow(run, "untimed boolean, conv long, at long, codes binary, copies binary, audits array<string>, last array<long>, cost array<long>, turns array<long>")


def chained(found: DataFrame) -> DataFrame:
    """at, state, place, closing: each segment's first state, the number of turns before it, and what ends the conversation after its last."""

    def run(batches):
        for b in batches:
            rows = []
            for parts in b.column("parts").to_pylist():
                state = place = 0
                for k, p in enumerate(parts):
                    after = p["last"][state]
                    rows.append((p["at"], state, place, CLOSING[after] if k + 1 == len(parts) else ""))
                    place, state = place + p["turns"][state], after
            at, state, place, closing = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(state, pa.int64()), pa.array(place, pa.int64()), pa.array(closing, pa.string())], ["at", "state", "place", "closing"])

    return _grouped(found, "last", "turns").select("parts").mapInArrow(run, "at long, state long, place long, closing string")


def decided(found: DataFrame, chain: DataFrame) -> DataFrame:
    """untimed, conv, at, place, role of each turn of the repaired conversations: at is the row's number (null: inserted), role null where it is kept."""
    roles = {2: "user", 3: "assistant"}

    def run(batches):
        for b in batches:
            out = ([], [], [], [], [])
            for untimed, conv, at, codes, copies, audit, state, place, closing in zip(*(c.to_pylist() for c in b.columns)):
                row, extra, edits = 0, np.frombuffer(copies, np.int64), iter(audit + closing)
                for e in edits:
                    if e != "D":
                        state = int(KEPT[codes[row] & 3][state]) if e == "K" else int(NEXT_TURN[state])
                        for x, v in zip(out, (untimed, conv, None if e == "I" else at + row, place, None if e == "K" else roles[state])):
                            x.append(v)
                        place += 1
                    if e != "I":
                        if copies:
                            next(islice(edits, int(extra[row]), int(extra[row])), None)  # the copies' letters
                        row += 1
            types = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["untimed", "conv", "at", "place", "role"])

    own = found.join(chain, "at").select("untimed", "conv", "at", "codes", "copies", F.get("audits", F.col("state").cast("int")).alias("audit"), "state", "place", "closing")
    return own.mapInArrow(run, "untimed boolean, conv long, at long, place long, role string")


class Repair:
    """Reports and repaired turns of conversations (conv_id, turn, role, text).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has a row.
    turns: conv_id, place (0, 1, ...), role, text of the repaired conversations, in no order.
    remove() deletes the tables they are read from.
    """

    def __init__(self, rows: DataFrame):
        spark, self.paths = rows.sparkSession, []

        def kept(df: DataFrame, name: str) -> DataFrame:
            self.paths.append(new_path(spark, name))
            return written_to(df, self.paths[-1])

        numbered = kept(ordered(faults(rows)), "repair-rows")
        found = kept(segments(numbered), "repair-segments")
        told = kept(paths(found, exits(found)), "repair-paths")
        chain = kept(chained(told), "repair-chain")
        self.report = self._report(found, told, chain)
        choice = decided(told, chain)
        texts = _keyed(rows).groupBy(*ROW).agg(F.first("text").alias("text"))
        own = choice.where("at IS NOT NULL").select("at", "place", F.col("role").alias("new")).join(numbered.select(*ROW, "at"), "at").drop("at")
        conv = F.when(~F.col("untimed"), F.col("conv")).alias("conv_id")
        left = texts.join(own, ROW).select(conv, "place", F.coalesce("new", "role").alias("role"), "text")
        added = choice.where("at IS NULL").select(conv, "place", "role", F.lit("").alias("text"))
        self.turns = left.unionByName(added)

    @staticmethod
    def _report(found: DataFrame, told: DataFrame, chain: DataFrame) -> DataFrame:
        sums = found.groupBy("untimed", "conv").agg(
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "cut", "illegal")],
            F.sort_array(F.collect_list(F.struct("at", "first", "last", "timed"))).alias("parts"),
        )
        # Between segments: an adjacent pair that isn't su, ua or au, and a turn that both hold.
        parts, before = F.col("parts"), F.slice("parts", F.lit(1), F.size("parts") - 1)
        seam = lambda p, q: F.when(~F.array(p["last"], q["first"]).isin(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0, 1), (1, 2), (2, 1))]), 1).otherwise(0)
        seams = F.aggregate(F.zip_with(before, F.slice("parts", F.lit(2), F.size("parts") - 1), seam), F.lit(0).cast("long"), lambda a, x: a + x)
        times = F.filter(F.transform(parts, lambda p: p["timed"]), lambda t: F.size(t) > 0)
        shared = F.aggregate(F.zip_with(F.slice("times", F.lit(1), F.greatest(F.size("times") - 1, F.lit(0))), F.slice("times", F.lit(2), F.greatest(F.size("times") - 1, F.lit(0))), lambda p, q: F.when(p[1] == q[0], 1).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
        turns = F.aggregate("times", F.lit(0).cast("long"), lambda a, t: a + t[2]) - shared
        gaps = F.when(F.size("times") > 0, F.get(F.element_at("times", -1), F.lit(1)) - F.get(F.get("times", F.lit(0)), F.lit(0)) + 1 - turns).otherwise(0)
        counts = sums.withColumn("illegal", F.col("illegal") + F.when(F.size("parts") > 1, seams).otherwise(0)).withColumn("times", times)
        counts = counts.select("untimed", "conv", gaps.alias("gaps"), "blank", "duplicate", F.col("cut").alias("truncated"), "illegal")
        state = F.col("state").cast("int")
        pieces = told.join(chain, "at").select("untimed", "conv", "at", F.concat(F.get("audits", state), "closing").alias("piece"), F.get("cost", state).alias("cost"))
        audits = pieces.groupBy("untimed", "conv").agg(F.min(F.struct("at", "cost"))["cost"].alias("cost"), F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
        audits = audits.select("untimed", "conv", "cost", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("audit"))
        return counts.join(audits, ["untimed", "conv"]).select(F.when(~F.col("untimed"), F.col("conv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of turns (conv_id, place, role, text): the hash of `role:text` lines, fed turn by turn."""

    def run(batches):
        open_, digest, started = None, None, False
        for b in batches:
            ids, hashes = [], []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if not started or conv != open_:
                    if started:
                        ids.append(open_), hashes.append(digest.hexdigest())
                    open_, digest, started = conv, hashlib.sha256(), True
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([open_], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text")
    return placed.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults put in by the crc32 of `conv_id:turn`; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    hit = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return hit.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = Repair(damaged(rows))
    ids = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    # Conversations without a row have no report; those without a repaired turn have no digest.
    report = fixed.report.withColumnRenamed("conv_id", "told")
    digest = digests(fixed.turns).withColumnRenamed("conv_id", "hashed")
    all_ = ids.join(report, F.col("id").eqNullSafe(F.col("told")), "left").join(digest, F.col("id").eqNullSafe(F.col("hashed")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.select(F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_sql() -> str:
    """The contract by a DP over (cost, audit, text) structs, a row of each conversation a round."""

    def edit(state: str, letter: str, cost: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {line}}}"

    def insert(state: str, role: str) -> str:
        return edit(state, "I", "3", f"chr(10) || '{role}:'")

    def least(*found: str) -> str:
        return f"list_min([{', '.join(found)}])"

    def moves(to: int, kept: list[int], initial: str, rerole: list[int], role: str) -> str:
        keep = [f"CASE WHEN NOT dead AND initial = '{initial}' THEN {edit(f'r{k}', 'K', '3 * cut::INT', "chr(10) || role || ':' || text")} END" for k in kept]
        made = [f"CASE WHEN NOT dead THEN {edit(f'r{k}', 'R', '3 + 3 * cut::INT', f"chr(10) || '{role}:' || text")} END" for k in rerole]
        return least(edit(f"r{to}", "D", "4"), *keep, *made)

    ready = f"s0 AS r0, s1 AS r1, {least('s2', *(insert(f's{k}', 'user') for k in (0, 1, 3)))} AS r2, s3"
    relaxed = f"*, {least('s3', insert('r2', 'assistant'))} AS r3"
    start = "{'c': %d::BIGINT, 'a': '', 'o': ''}"
    bits = "list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))"
    bare = "'[^\\x20\\x09-\\x0D]'"
    return f"""
WITH RECURSIVE crc_table AS (SELECT list({bits} ORDER BY b) AS t FROM (SELECT unnest(range(256))::BIGINT AS b)),
filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM filled, crc_table
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, role[1] AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM hurt
), judged AS (
  SELECT *, NOT regexp_matches(text, {bare}) AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS unended, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM numbered
), faulty AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND unended AS cut, blank OR again AS dead FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, {start % 0} AS s0, {start % 10**12} AS s1, {start % 10**12} AS s2, {start % 10**12} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, {edit('r0', 'D', '4')}, {moves(1, [0], 's', [], '')}, {moves(2, [0, 1, 3], 'u', [0, 1, 3], 'user')}, {moves(3, [2], 'a', [2], 'assistant')}
  FROM (SELECT {relaxed} FROM (SELECT dp.conv_id, {ready}, f.i, role, text, initial, dead, cut FROM dp JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1))
), ended AS (
  SELECT conv_id, {least('r0', 'r3')} AS best FROM (SELECT {relaxed} FROM (SELECT dp.conv_id, {ready} FROM dp JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.i))
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id"""
