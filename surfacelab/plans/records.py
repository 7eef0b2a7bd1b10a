"""Queries on trajectories, scores, statuses and detection metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from surfacelab.functions import vec as V
from surfacelab.operators import metrics, ranking, tracker
from surfacelab.operators import trajectory as T
from surfacelab.plans.points import r6, xyz
from surfacelab.sources.derived import candidates, scored_labels, sheets, table, tiles, trajectories, voxels, with_sql


def steps(spark, d):
    return T.number(trajectories(spark, d), ["ts", "event_id"])


def q_traj_features(spark, d):
    got = T.observations(T.with_frame(steps(spark, d)))
    return got.select("traj", F.col("step").cast("long").alias("step"), *[r6(F.get("obs", F.lit(i)), f"o{i}") for i in range(13)])


def q_traj_targets(spark, d):
    got = T.targets(T.with_frame(steps(spark, d)))
    return got.select("traj", F.col("step").cast("long").alias("step"), *xyz("target", ["dx", "dy", "dz"]))


def q_traj_padding(spark, d):
    return T.padded(steps(spark, d), 32).select("traj", F.col("step").cast("long").alias("step"), F.col("mask").cast("long").alias("mask"))


def q_straight_gap(spark, d):
    got = T.straight_gap(steps(spark, d), 4, 4)
    return got.select("traj", r6("error", "error"))


def q_gap_summary(spark, d):
    got = T.straight_gap(steps(spark, d), 4, 4)
    return got.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("error"), "mean_error"), r6(F.avg((F.col("error") < 100).cast("double")), "recovered"))


def volume_seeds(spark, d):
    """One seed in the middle of each embedding's volume, towards its candidate's normal."""
    return candidates(spark, d).select(F.col("candidate_id").alias("vol"), F.lit(0).cast("long").alias("seed"), V.vec(F.lit(1.5), F.lit(1.5), F.lit(1.5)).alias("p"), V.normalize("n").alias("t"))


def q_trace(spark, d):
    """Marches of four steps through each embedding's volume."""
    got = T.trace(voxels(spark, d), volume_seeds(spark, d), 4, 0.5, 0.2, 1.0, 5)
    return got.select("vol", F.col("step").cast("long").alias("step"), *xyz("p", ["x", "y", "z"]), r6("probability", "probability"))


def q_generate(spark, d):
    """The lengths of up to three marches of each sheet from bright voxels in random directions, of eight steps."""
    got = T.generate(sheets(spark, d), 3, 8, 0.5, 7, step=0.5, radius=1.0, samples=5)
    return got.groupBy("vol", "seed").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("probability"), "probability"))


def q_gap_benchmark(spark, d):
    """A plain tracker against a straight line over gaps of four steps in the users' events."""
    got = tracker.gap_benchmark(T.with_frame(steps(spark, d)), tracker.plain_weights(7, 16), 4, 4)
    out = [r6(F.avg(k), k) for k in ("model_mean", "straight_mean", "model_end", "straight_end")]
    near = [r6(F.avg((F.col(k + "_end") < 3).cast("double")), k + "_recovered") for k in ("model", "straight")]
    return got.agg(F.count(F.lit(1)).alias("n"), *out, *near, r6(F.avg((F.col("model_end") < F.col("straight_end")).cast("double")), "model_wins"))


def q_training_loss(spark, d):
    """The loss of a plain tracker on the users' events; the confidence to learn is the events' probability."""
    rows = T.with_frame(steps(spark, d))
    batch = T.targets(rows).join(T.padded(rows, 32), ["traj", "step"]).join(rows.select("traj", "step", F.col("probability").alias("confidence")), ["traj", "step"])
    got = tracker.training_loss(batch, tracker.predict(T.observations(rows), tracker.plain_weights(7, 16), 32))
    return got.select(*[r6(k, k) for k in ("displacement", "confidence", "variance", "loss")])


def q_auroc(spark, d):
    got = metrics.auroc(scored_labels(spark, d), ["region"])
    return got.select("region", "positives", "negatives", *[r6(k, k) for k in ("auroc", "mean_pos", "mean_neg")])


def q_auroc_overall(spark, d):
    got = metrics.auroc(scored_labels(spark, d).withColumn("all", F.lit(0)), ["all"])
    return got.select("positives", "negatives", *[r6(k, k) for k in ("auroc", "mean_pos", "mean_neg")])


def q_threshold_rates(spark, d):
    got = metrics.rates_above(scored_labels(spark, d), ["region"], [500.0, 1000.0, 2000.0])
    return got.select("region", *[r6(f"at_{i}", f"at_{i}") for i in range(3)])


def q_percentiles(spark, d):
    return scored_labels(spark, d).groupBy("region").agg(*[r6(F.percentile("score", F.lit(q)), n) for q, n in ((0.01, "p01"), (0.5, "p50"), (0.99, "p99"))])


def records(spark, d):
    """Screened tiles as candidate records: masked ones rejected, faint ones failed, the rest scored."""
    m = metrics.texture(tiles(spark, d), ["tile"]).join(metrics.ink(tiles(spark, d), ["tile"]), "tile")
    status = F.when(F.col("ct_nonzero") < 0.4, "rejected_masked").when(F.col("ct_std") < 14, "failed").otherwise("scored")
    return m.select(F.col("tile").alias("candidate_id"), "ct_nonzero", "ct_std", "ink_mean", "ink_std", "ink_p99", status.alias("status"))


def q_combined_score(spark, d):
    rows = records(spark, d).join(candidates(spark, d).select("candidate_id", F.col("score").alias("surface_score")), "candidate_id")
    rows = rows.withColumn("focus_std", F.col("ct_std") / 2).withColumn("fiber_coherence", F.col("ct_nonzero") / 3)
    score = F.when(F.col("status") == "rejected_masked", -1.0).otherwise(V.combined_score())
    return rows.select("candidate_id", "status", r6(score, "combined_score"))


def q_texture_score(spark, d):
    rows = records(spark, d).join(candidates(spark, d).select("candidate_id", F.col("score").alias("surface_probability")), "candidate_id")
    rows = rows.withColumn("focus_mean", F.col("ct_std") / 2).withColumn("fiber_coherence", F.col("ct_nonzero") / 3)
    return rows.select("candidate_id", r6(V.texture_score(), "texture_score"))


def q_status_counts(spark, d):
    return metrics.status_counts(records(spark, d))


def q_resume(spark, d):
    """Candidates that a resumed run still has to score."""
    return ranking.remaining(candidates(spark, d).select("candidate_id"), records(spark, d), "candidate_id", ("scored", "rejected_masked"))


def q_upsert(spark, d):
    """Customers' balances, replaced by the total of their orders where they have one."""
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.lit("known").alias("status"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("value")).withColumn("status", F.lit("new"))
    return ranking.upsert(known, new, "id").select("id", r6("value", "value"), "status")


def q_ordered_ids(spark, d):
    """Distinct part keys of order lines in the order of their first mention."""
    rows = table(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"))
    return ranking.first_places(rows, "l_partkey", "place")


def q_lookup(spark, d):
    ids = table(spark, d, "events").select((F.col("user_id") * 7).alias("candidate_id")).distinct()
    got = ranking.lookup(ids, candidates(spark, d).select("candidate_id", "score"), "candidate_id")
    return got.select("candidate_id", r6("score", "score"), "error")


def q_select(spark, d):
    return ranking.select_candidates(candidates(spark, d), min_score=0.1).select("candidate_id", r6("score", "score"))


def q_chunk_counts(spark, d):
    got = ranking.chunk_order(candidates(spark, d), 4)
    return got.groupBy("cz", "cy", "cx").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first")).select(*[F.col("c" + k).cast("long").alias("c" + k) for k in "zyx"], "n", "first")


def q_names(spark, d):
    """Folder names of the best 100 candidates."""
    best = ranking.top(candidates(spark, d), 100)
    # A window over the hundred rows of the limit alone.
    w = F.row_number().over(ranking.Window.orderBy(F.desc("score"), "candidate_id"))
    return best.select("candidate_id", V.folder_name(w, "candidate_id").alias("folder"))


def q_parse(spark, d):
    """Bounds written as text from order lines and parsed again; a wrong count gives null."""
    text = F.concat_ws(",", "l_quantity", "l_tax", F.when(F.col("l_linenumber") < 3, F.col("l_discount")))
    rows = table(spark, d, "lineitem").select("l_linenumber", V.parse_numbers(text, 3).alias("b"))
    return rows.groupBy(F.col("l_linenumber").cast("long").alias("line")).agg(F.count("b").alias("n"), r6(F.coalesce(F.sum(F.get("b", F.lit(0)) + F.get("b", F.lit(2))), F.lit(0.0)), "total"))


STEP = with_sql("traj") + """,
n AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY ts, event_id) - 1 AS step FROM traj),
d AS (SELECT *, lead(px) OVER w - px AS ax, lead(py) OVER w - py AS ay, lead(pz) OVER w - pz AS az, px - lag(px) OVER w AS bx, py - lag(py) OVER w AS by_, pz - lag(pz) OVER w AS bz FROM n WINDOW w AS (PARTITION BY traj ORDER BY step)),
t AS (SELECT *, coalesce(ax, bx, 0) AS tx, coalesce(ay, by_, 0) AS ty, coalesce(az, bz, 0) AS tz FROM d),
u AS (SELECT * EXCLUDE (tx, ty, tz), tx / l AS tx, ty / l AS ty, tz / l AS tz FROM (SELECT *, greatest(sqrt(tx * tx + ty * ty + tz * tz), 1e-6) AS l FROM t)),
k AS (SELECT *, CASE WHEN abs(tz) < 0.8 THEN ty ELSE -tz END AS cx, CASE WHEN abs(tz) < 0.8 THEN -tx ELSE 0.0 END AS cy, CASE WHEN abs(tz) < 0.8 THEN 0.0 ELSE tx END AS cz FROM u),
m AS (SELECT *, cx / g AS nx, cy / g AS ny, cz / g AS nz FROM (SELECT *, greatest(sqrt(cx * cx + cy * cy + cz * cz), 1e-6) AS g FROM k))"""
REC = with_sql("tile", "cand") + ", rec AS (SELECT tile AS candidate_id, a AS ct_nonzero, b AS ct_std, m AS ink_mean, s AS ink_std, p AS ink_p99, CASE WHEN a < 0.4 THEN 'rejected_masked' WHEN b < 14 THEN 'failed' ELSE 'scored' END AS status FROM (SELECT tile, avg((v > 0)::INT::DOUBLE) AS a, coalesce(stddev_pop(CASE WHEN v > 0 THEN v END), 0.0) AS b, avg(v) AS m, stddev_pop(v) AS s, quantile_cont(v, 0.99) AS p FROM tile GROUP BY tile))"
AUC = "SELECT {k}, positives, negatives, round(won / nullif(positives * negatives, 0), 6) + 0.0 AS auroc, round(mp, 6) + 0.0 AS mean_pos, round(mn, 6) + 0.0 AS mean_neg FROM (SELECT {k}, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, avg(score) FILTER (label = 1) AS mp, avg(score) FILTER (label = 0) AS mn, sum(CASE WHEN label = 1 THEN rk END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE AS won FROM (SELECT *, avg(i) OVER (PARTITION BY {k}, score) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score) AS i FROM lab)) GROUP BY {k})"
SCORE = "1.5 * c.score + 2 * ct_nonzero + 0.02 * ct_std + 0.02 * (ct_std / 2) + ct_nonzero / 3 + 8 * ink_std + greatest(0.0, ink_p99 - ink_mean)"

SQL = {
    "q_traj_features": STEP + " SELECT traj, step, " + ", ".join(f"round({e}, 6) + 0.0 AS o{i}" for i, e in enumerate(["coalesce(bx, 0.0)", "coalesce(by_, 0.0)", "coalesce(bz, 0.0)", "tx", "ty", "tz", "nx", "ny", "nz", "probability", "coalesce(kp, 0.0)", "0.0", "1.0"])) + " FROM (SELECT *, sqrt((nx - lag(nx) OVER w) * (nx - lag(nx) OVER w) + (ny - lag(ny) OVER w) * (ny - lag(ny) OVER w) + (nz - lag(nz) OVER w) * (nz - lag(nz) OVER w)) AS kp FROM m WINDOW w AS (PARTITION BY traj ORDER BY step))",
    "q_traj_targets": STEP + ", x AS (SELECT traj, step, coalesce(ax, 0.0) AS ax, coalesce(ay, 0.0) AS ay, coalesce(az, 0.0) AS az, tx, ty, tz, nx, ny, nz, ny * tz - nz * ty AS bx, nz * tx - nx * tz AS b_y, nx * ty - ny * tx AS bz FROM m) SELECT traj, step, round(ax * tx + ay * ty + az * tz, 6) + 0.0 AS dx, round(ax * bx + ay * b_y + az * bz, 6) + 0.0 AS dy, round(ax * nx + ay * ny + az * nz, 6) + 0.0 AS dz FROM x",
    "q_traj_padding": with_sql("traj") + " SELECT traj, step, (step < least(n, 32) - 1)::BIGINT AS mask FROM (SELECT traj, count(*) AS n FROM traj GROUP BY traj), range(32) t(step)",
    "q_straight_gap": STEP + ", g AS (SELECT traj, " + ", ".join(f"max(CASE WHEN step = {s} THEN p{k} END) AS {n}_{k}" for n, s in (("a", 2), ("b", 3), ("t", 7)) for k in "xyz") + " FROM n GROUP BY traj) SELECT traj, round(sqrt(" + " + ".join(f"(t_{k} - (b_{k} + 4 * (b_{k} - a_{k}))) * (t_{k} - (b_{k} + 4 * (b_{k} - a_{k})))" for k in "xyz") + "), 6) + 0.0 AS error FROM g WHERE t_x IS NOT NULL",
    "q_gap_summary": STEP + ", g AS (SELECT traj, " + ", ".join(f"max(CASE WHEN step = {s} THEN p{k} END) AS {n}_{k}" for n, s in (("a", 2), ("b", 3), ("t", 7)) for k in "xyz") + " FROM n GROUP BY traj), e AS (SELECT sqrt(" + " + ".join(f"(t_{k} - (b_{k} + 4 * (b_{k} - a_{k}))) * (t_{k} - (b_{k} + 4 * (b_{k} - a_{k})))" for k in "xyz") + ") AS e FROM g WHERE t_x IS NOT NULL) SELECT count(*) AS n, round(avg(e), 6) + 0.0 AS mean_error, round(avg((e < 100)::INT::DOUBLE), 6) + 0.0 AS recovered FROM e",
    "q_auroc": with_sql("lab") + " " + AUC.format(k="region"),
    "q_auroc_overall": with_sql("lab") + ", lab2 AS (SELECT *, 0 AS z FROM lab) SELECT * EXCLUDE (z) FROM (" + AUC.format(k="z").replace("FROM lab)", "FROM lab2)") + ")",
    "q_threshold_rates": with_sql("lab") + " SELECT region, " + ", ".join(f"round(avg((score >= {t})::INT::DOUBLE), 6) + 0.0 AS at_{i}" for i, t in enumerate((500, 1000, 2000))) + " FROM lab WHERE label = 0 GROUP BY region",
    "q_percentiles": with_sql("lab") + " SELECT region, " + ", ".join(f"round(quantile_cont(score, {q}), 6) + 0.0 AS {n}" for q, n in ((0.01, "p01"), (0.5, "p50"), (0.99, "p99"))) + " FROM lab GROUP BY region",
    "q_combined_score": REC + f" SELECT rec.candidate_id, status, round(CASE WHEN status = 'rejected_masked' THEN -1.0 ELSE {SCORE} END, 6) + 0.0 AS combined_score FROM rec JOIN cand c ON c.candidate_id = rec.candidate_id",
    "q_texture_score": REC + " SELECT rec.candidate_id, round(2 * ct_nonzero + 0.025 * ct_std + 0.8 * (ct_nonzero / 3) + 0.01 * (ct_std / 2) + 0.5 * c.score, 6) + 0.0 AS texture_score FROM rec JOIN cand c ON c.candidate_id = rec.candidate_id",
    "q_status_counts": REC + " SELECT status, count(*) AS n FROM rec GROUP BY status",
    "q_resume": REC + " SELECT candidate_id FROM cand WHERE candidate_id NOT IN (SELECT candidate_id FROM rec WHERE status <> 'failed')",
    "q_upsert": "SELECT c_custkey AS id, round(coalesce(o.v, c_acctbal), 6) + 0.0 AS value, CASE WHEN o.v IS NULL THEN 'known' ELSE 'new' END AS status FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey UNION ALL SELECT o_custkey, round(round(sum(o_totalprice), 2), 6) + 0.0, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey",
    "q_ordered_ids": "SELECT l_partkey, min(l_orderkey * 8 + l_linenumber)::BIGINT AS place FROM lineitem GROUP BY l_partkey",
    "q_lookup": with_sql("cand") + " SELECT i.id AS candidate_id, round(score, 6) + 0.0 AS score, CASE WHEN cand.candidate_id IS NULL THEN 'no record ' || i.id END AS error FROM (SELECT DISTINCT user_id * 7 AS id FROM events) i LEFT JOIN cand ON cand.candidate_id = i.id",
    "q_select": with_sql("cand") + " SELECT candidate_id, round(score, 6) + 0.0 AS score FROM cand WHERE score >= 0.1",
    "q_chunk_counts": with_sql("cand") + " SELECT " + ", ".join(f"floor(p{k} / 4)::BIGINT AS c{k}" for k in "zyx") + ", count(*) AS n, min(candidate_id) AS first FROM cand GROUP BY 1, 2, 3",
    "q_names": with_sql("cand") + " SELECT candidate_id, printf('%03d-candidate-%06d', i, candidate_id) AS folder FROM (SELECT candidate_id, row_number() OVER (ORDER BY score DESC, candidate_id) AS i FROM cand) WHERE i <= 100",
    "q_parse": "SELECT l_linenumber::BIGINT AS line, CASE WHEN l_linenumber < 3 THEN count(*) ELSE 0 END AS n, CASE WHEN l_linenumber < 3 THEN round(sum(l_quantity + l_discount), 6) + 0.0 ELSE 0.0 END AS total FROM lineitem GROUP BY l_linenumber",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
