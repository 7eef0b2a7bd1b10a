import numpy as np
from pyspark.sql import functions as F

from surfacelab.operators import trajectory as T
from surfacelab.plans.records import steps
from surfacelab.streaming import resume


def test_stopped_run_goes_on_and_repeats_nothing(spark, tmp_path):
    src, sink, mark = (str(tmp_path / x) for x in ("src", "sink", "mark"))
    part = spark.range(10).select("id", (F.col("id") / 2).alias("v"))
    part.where("id < 6").write.parquet(src)

    def score(batch):
        return resume.with_status(batch, F.when(F.col("id") == 3, float("nan")).otherwise(F.col("v")), "score", F.col("id") == 1)

    for _ in range(2):
        resume.score_stream(spark, src, part.schema, sink, mark, score, "id").awaitTermination()
        assert spark.read.parquet(sink).count() == 6
    part.where("id >= 6").write.mode("append").parquet(src)
    resume.score_stream(spark, src, part.schema, sink, mark, score, "id").awaitTermination()
    got = {r.id: r for r in spark.read.parquet(sink).collect()}
    assert len(got) == 10 and got[1].status == "rejected_masked" and got[1].score == -1.0 and got[3].status == "failed" and got[3].error and got[5].status == "scored"


def test_windowed_counts_of_events(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = resume.windowed_counts(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == events.count()


def test_observations_are_thirteen_numbers(spark, sf_dir):
    rows = T.with_frame(steps(spark, sf_dir))
    got = T.observations(rows).collect()
    assert all(len(r.obs) == 13 for r in got) and all(r.obs[:3] == [0.0] * 3 and r.obs[10] == 0.0 for r in got if r.step == 0)
    t = np.array([r.obs[3:6] for r in got])
    assert ((np.abs(np.linalg.norm(t, axis=1) - 1) < 1e-9) | (np.linalg.norm(t, axis=1) < 1e-9)).all()
    n = rows.count()
    last = T.targets(rows).groupBy("traj").agg(F.max_by("target", "step").alias("t")).collect()
    assert T.targets(rows).count() == n and all(tuple(r.t) == (0.0, 0.0, 0.0) for r in last)
