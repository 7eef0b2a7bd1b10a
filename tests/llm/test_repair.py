import hashlib
import heapq
import zlib
from collections import defaultdict

import numpy as np

from surfacelab.llm import repair as q

WHITE = " \t\n\x0b\x0c\r"
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def brute(rows):
    """Report and repaired lines of one conversation's rows (turn, role, text), nulls filled, by a search for the least (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, fault = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        to = NEXT[state]
        new = {2: "user", 3: "assistant"}[to]
        heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*out, new + ":")))
        if i < len(rows):
            cut = 3 * (fault[i] == "t")
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault[i] not in ("b", "d"):
                heapq.heappush(heap, (cost + 3 + cut, audit + "R", i + 1, to, (*out, f"{new}:{rows[i][2]}")))
                if (state, initials[i]) in KEEP:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, KEEP[state, initials[i]], (*out, f"{rows[i][1]}:{rows[i][2]}")))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [fault.count(x) for x in "bdt"]
    return (gaps, *counts, illegal, cost, audit), hashlib.sha256("\n".join(out).encode()).hexdigest()


def filled(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    return by


def told(fixed):
    report = {r.conv_id: tuple(r)[1:] for r in fixed.report.collect()}
    return report, {r.conv_id: r.repaired_sha256 for r in q.digests(fixed.turns).collect()}


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 0, True) for r in rows], "conv_id long, turn long, role string, text string, at string, place int, blank boolean")
    report, hashes = told(q.Repair(df.repartition(parts)))
    want = {c: brute(r) for c, r in filled(rows).items()}
    assert report == {c: w[0] for c, w in want.items()}
    empty = hashlib.sha256().hexdigest()
    assert {c: hashes.get(c, empty) for c in want} == {c: w[1] for c, w in want.items()}


def odd_rows(seed, conversations, longest):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown"]
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n", None, "A longer answer. \t", "é。", "ok."]
    rows = []
    for c in range(conversations):
        for t in range(int(rng.integers(1, longest))):
            row = (c, None if rng.random() < 0.05 else t + int(rng.integers(0, 2)), roles[int(rng.integers(len(roles)))], texts[int(rng.integers(len(texts)))] if rng.random() < 0.5 else f"Turn {rng.integers(1000)}.")
            rows += [row] * (1 + int(rng.random() < 0.1) * int(rng.integers(1, 4)))
    return rows


def test_reports_and_texts_equal_a_search(spark):
    check(spark, odd_rows(1, 120, 9))
    check(spark, [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (4, None, None, None), (5, 3, "assistant", "x" * 200_000)])


def test_long_conversations_are_cut_into_segments_and_chained(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = odd_rows(2, 4, 120) + [(9, k, "user", "same") for k in range(60)] + [(9, 70, "user", "end.")] * 30
        check(spark, rows)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert q.segments(q.ordered(q.faults(df))).where("conv = 9").count() > 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranked_paths_are_the_least_of_all_optimal_ones():
    rng = np.random.default_rng(4)
    letters = {1: "D", 2: "I", 3: "K", 4: "R"}
    for _ in range(60):
        n = int(rng.integers(1, 7))
        codes = rng.integers(0, 4, (1, n)) + rng.choice([0, 0, 4, 16], (1, n))
        end = rng.integers(0, 7, (1, 4))
        edits, last, cost = q.least_paths(codes, np.zeros((1, n), np.int64), np.array([n]), end)
        for state in range(4):
            found = []

            def walk(i, s, c, audit):
                if i == n:
                    found.append((c + int(end[0, s]), audit, s))
                    return
                if len(audit) - i < 3:
                    walk(i, NEXT[s], c + 3, audit + "I")
                cut = 3 * bool(codes[0, i] & 16)
                walk(i + 1, s, c + 4, audit + "D")
                if not codes[0, i] & 4:
                    walk(i + 1, NEXT[s], c + 3 + cut, audit + "R")
                    if (s, "suax"[codes[0, i] & 3]) in KEEP:
                        walk(i + 1, KEEP[s, "suax"[codes[0, i] & 3]], c + cut, audit + "K")

            walk(0, state, 0, "")
            assert ("".join(letters[x] for x in edits[0, state] if x), int(last[0, state]), int(cost[0, state])) == (lambda b: (b[1], b[2], b[0]))(min(found))


def test_damage_and_query(spark, sf_dir, tmp_path):
    rows = [(c, t, ["user", "assistant"][t % 2], f"Text {t}. More!") for c in range(40) for t in range(6)] + [(None, 1, None, None), (77, None, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x, r = " " if x is None else x, " " if r is None else r
        x = "" if kind == 1 else "".join(k for k in x if k not in ".!?") if kind == 2 else x
        hurt += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, *_ in rows}
    want |= {c: (*w[0], w[1]) for c, w in ((c, brute(r)) for c, r in filled(hurt).items())}
    assert {r.conv_id: tuple(r)[1:] for r in q.op13_repair(spark, str(tmp_path)).collect()} == want


def test_empty_table(spark):
    report, hashes = told(q.Repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    assert report == {} and hashes == {}
