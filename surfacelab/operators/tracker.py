"""Recurrent tracking: a two-layer GRU over observations, free runs, and tiled model inference.

Weights are a dictionary of arrays given by the user. Observed trajectories stream through the net in one stage; a free run's next
place needs the field, so there a round is one step of all runs. The net's arithmetic is the only numpy helper.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surfacelab.functions.vec import add, cross, dot, is_finite, norm, normalize, scale, sub, vec
from surfacelab.operators.rounds import cut
from surfacelab.operators.trajectory import Field, along, facing

OBSERVED, HIDDEN = 13, 128


def plain_weights(seed: int, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Weights of small random values in the shapes that the tracker reads."""
    rng = np.random.default_rng(seed)
    shapes = {"in_w": (OBSERVED, hidden), "in_b": (hidden,), "ln_g": (hidden,), "ln_b": (hidden,)}
    for layer in (0, 1):
        shapes |= {f"w{layer}": (hidden, 3 * hidden), f"u{layer}": (hidden, 3 * hidden), f"bw{layer}": (3 * hidden,), f"bu{layer}": (3 * hidden,)}
    shapes |= {"delta": (hidden, 3), "confidence": (hidden, 1), "logvar": (hidden, 3)}
    return {k: rng.normal(0, 0.1, s) + (1.0 if k == "ln_g" else 0.0) for k, s in shapes.items()}


def gru_step(weights: dict, obs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(delta, confidence, log variance, state) after one observation; log variance within -6..4."""
    x = obs @ weights["in_w"] + weights["in_b"]
    x = x / (1 + np.exp(-x))
    x = (x - x.mean()) / np.sqrt(x.var() + 1e-5) * weights["ln_g"] + weights["ln_b"]
    new = []
    for layer in (0, 1):
        h = state[layer]
        a, b = x @ weights[f"w{layer}"] + weights[f"bw{layer}"], h @ weights[f"u{layer}"] + weights[f"bu{layer}"]
        k = len(h)
        r, z = 1 / (1 + np.exp(-(a[:k] + b[:k]))), 1 / (1 + np.exp(-(a[k : 2 * k] + b[k : 2 * k])))
        x = (1 - z) * np.tanh(a[2 * k :] + r * b[2 * k :]) + z * h
        new.append(x)
    confidence = 1 / (1 + np.exp(-(x @ weights["confidence"])[0]))
    return x @ weights["delta"], float(confidence), np.clip(x @ weights["logvar"], -6, 4), np.stack(new)


def gru_steps(weights: dict, obs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gru_step of many rows at once: obs [n, 13], state [n, 2, hidden]."""
    x = obs @ weights["in_w"] + weights["in_b"]
    x = x / (1 + np.exp(-x))
    x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5) * weights["ln_g"] + weights["ln_b"]
    new, k = np.empty_like(state), state.shape[2]
    for layer in (0, 1):
        h = state[:, layer]
        a, b = x @ weights[f"w{layer}"] + weights[f"bw{layer}"], h @ weights[f"u{layer}"] + weights[f"bu{layer}"]
        r, z = (1 / (1 + np.exp(-(a[:, i * k : i * k + k] + b[:, i * k : i * k + k]))) for i in (0, 1))
        x = (1 - z) * np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :]) + z * h
        new[:, layer] = x
    return x @ weights["delta"], 1 / (1 + np.exp(-(x @ weights["confidence"])[:, 0])), np.clip(x @ weights["logvar"], -6, 4), new


def predict(observations: DataFrame, weights: dict[str, np.ndarray], length: int | None = None) -> DataFrame:
    """traj, step, dx, dy, dz, confidence for observations (traj, step, obs), and the net's logit and log variances lx, ly, lz; confidence falls with variance.

    One stage: rows stream by trajectory and step, and the state of the last trajectory of a batch goes over to the next batch. The
    trajectories of a batch take each step together. length leaves out later steps.
    """
    shared, hidden = observations.sparkSession.sparkContext.broadcast(weights), len(weights["in_b"])
    rows = observations.select("traj", "step", "obs")
    rows = rows if length is None else rows.where(F.col("step") < length)

    def run(batches):
        last, carried = None, None
        for b in batches:
            if not len(b):
                continue
            traj, obs = b.traj.to_numpy(), np.stack(b.obs.to_numpy()).astype(float)
            start = np.nonzero(np.append(True, traj[1:] != traj[:-1]))[0]
            size = np.diff(np.append(start, len(b)))
            state = np.zeros((len(start), 2, hidden))
            if carried is not None and traj[0] == last:
                state[0] = carried
            delta, logvar, c = np.empty((len(b), 3)), np.empty((len(b), 3)), np.empty(len(b))
            for k in range(int(size.max())):
                on = np.nonzero(size > k)[0]
                at = start[on] + k
                delta[at], c[at], logvar[at], state[on] = gru_steps(shared.value, obs[at], state[on])
            last, carried = traj[-1], state[-1].copy()
            spread = np.sqrt(np.exp(logvar).mean(axis=1))
            yield b[["traj", "step"]].assign(dx=delta[:, 0], dy=delta[:, 1], dz=delta[:, 2], confidence=c / (1 + spread), logit=np.log(c / (1 - c)), lx=logvar[:, 0], ly=logvar[:, 1], lz=logvar[:, 2])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"traj {kinds['traj']}, step {kinds['step']}, " + ", ".join(f"{k} double" for k in ("dx", "dy", "dz", "confidence", "logit", "lx", "ly", "lz"))
    return rows.repartition("traj").sortWithinPartitions("traj", "step").mapInPandas(run, schema)


def gap_benchmark(rows: DataFrame, weights: dict[str, np.ndarray], start: int = 8, length: int = 8) -> DataFrame:
    """traj, model_mean, model_end, straight_mean, straight_end: errors over a hidden gap of trajectories (traj, step, p, normal, probability).

    The net sees the first start steps, then runs freely from the place of step start, each step fed with its own last one and the gap
    flag set; the straight line goes on from there by the last seen step. The normal is that of the trajectory's first place. Trajectories without
    start + length + 1 places are left out. A trajectory is one row of that many places, so a batch of them takes each step together.
    """
    shared, hidden = rows.sparkSession.sparkContext.broadcast(weights), len(weights["in_b"])
    need = start + length + 1
    seen = rows.where(F.col("step") < need).groupBy("traj").agg(F.sort_array(F.collect_list(F.struct("step", F.array("p.x", "p.y", "p.z").alias("p"), "probability"))).alias("s"), F.min_by(F.array("normal.x", "normal.y", "normal.z"), "step").alias("n"))
    packed = seen.where(F.size("s") == need).select("traj", F.flatten(F.transform("s", lambda x: x["p"])).alias("p"), F.transform("s", lambda x: x["probability"].cast("double")).alias("q"), "n")

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            truth, seen, normal = np.stack(b.p.to_numpy()).reshape(len(b), need, 3), np.stack(b.q.to_numpy()), np.stack(b.n.to_numpy())
            state, flags = np.zeros((len(b), 2, hidden)), np.tile([0.0, 0.0, 1.0], (len(b), 1))
            previous = truth[:, 1] - truth[:, 0]
            for k in range(start):
                previous = truth[:, k] - truth[:, k - 1] if k else previous
                state = gru_steps(shared.value, np.hstack([previous, unit(previous), normal, seen[:, k : k + 1], flags]), state)[3]
            point, flags = truth[:, start].copy(), np.tile([0.0, 0.0, 1.0, 1.0], (len(b), 1))
            model = np.empty((len(b), length))
            for k in range(length):
                tangent = unit(previous)
                side = unit(np.cross(normal, tangent))
                local, _, _, state = gru_steps(shared.value, np.hstack([previous, tangent, normal, flags]), state)
                delta = tangent * local[:, :1] + side * local[:, 1:2] + normal * local[:, 2:]
                delta = delta * np.where((delta * tangent).sum(1) < 0, -1.0, 1.0)[:, None]
                delta = unit(delta) * np.clip(np.linalg.norm(delta, axis=1), 0.5, 1.5)[:, None]
                point, previous = point + delta, delta
                model[:, k] = np.linalg.norm(point - truth[:, start + 1 + k], axis=1)
            ahead = truth[:, start, None] + np.arange(1, length + 1)[:, None] * (truth[:, start] - truth[:, start - 1])[:, None]
            straight = np.linalg.norm(ahead - truth[:, start + 1 :], axis=2)
            yield b[["traj"]].assign(model_mean=model.mean(1), model_end=model[:, -1], straight_mean=straight.mean(1), straight_end=straight[:, -1])

    kind = packed.schema["traj"].dataType.simpleString()
    return packed.mapInPandas(run, f"traj {kind}, model_mean double, model_end double, straight_mean double, straight_end double")


def trace_model(volume: DataFrame | Field, seeds: DataFrame, weights: dict[str, np.ndarray], steps: int, reverse: bool = False, stride: float = 1.5, radius: float = 3.0, samples: int = 9) -> DataFrame:
    """vol, seed, step, p, confidence, valid: free runs of the tracker from seeds (vol, seed, p, t), all together.

    A step that isn't finite or is shorter than 0.05 is replaced by stride along the tangent, one that goes back is turned round; the place
    is moved along the normal to the ridge, and a run ends where the ridge is below 0.1 (that last point isn't valid).
    """
    field, keys = volume if isinstance(volume, Field) else Field(volume), ["vol", "seed"]
    hidden = len(weights["in_b"])
    shared = field.volume.sparkSession.sparkContext.broadcast(weights)
    begun = field.normal(seeds.select(*keys, "p", "t"), keys)
    t = along("t", "normal")
    now = begun.select(*keys, "p", (scale(t, F.lit(-1.0)) if reverse else t).alias("t"), F.col("normal").alias("n"), F.lit(0.0).alias("bend"), F.array_repeat(F.lit(0.0), 2 * hidden).alias("state"))
    now = cut(now.withColumn("previous", scale("t", F.lit(stride))))
    kinds = {f.name: f.dataType.simpleString() for f in now.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", dx double, dy double, dz double, confidence double, spread double, state array<double>"
    out = None

    def run(batches):
        for b in batches:
            if len(b):
                delta, c, logvar, new = gru_steps(shared.value, np.stack(b.obs.to_numpy()).astype(float), np.stack(b.state.to_numpy()).reshape(-1, 2, hidden))
                yield b[keys].assign(dx=delta[:, 0], dy=delta[:, 1], dz=delta[:, 2], confidence=c, spread=np.sqrt(np.exp(logvar).mean(axis=1)), state=list(new.reshape(len(b), -1)))

    for k in range(steps):
        here = field.sample(now, keys)
        parts = [F.col(v)[x] for v in ("previous", "t", "n") for x in "xyz"]
        told = here.select(*keys, F.array(*parts, "probability", "bend", F.lit(0.0), F.lit(1.0)).alias("obs"), "state").mapInPandas(run, schema)
        rows = now.drop("state").join(told, keys).withColumn("side", normalize(cross("n", "t")))
        d = vec(*[F.col("t")[x] * F.col("dx") + F.col("side")[x] * F.col("dy") + F.col("n")[x] * F.col("dz") for x in "xyz"])
        rows = rows.withColumn("d", d).withColumn("d", F.when(is_finite("d") & (norm("d") >= 0.05), F.col("d")).otherwise(scale("t", F.lit(stride))))
        rows = cut(rows.withColumn("d", scale("d", F.when(dot("d", "t") < 0, -1.0).otherwise(1.0))).withColumn("from", F.col("p")).withColumn("p", add("p", "d")))
        moved = cut(field.project(rows, keys, radius, samples))
        step = moved.select(*keys, F.lit(k).alias("step"), F.col("from").alias("p"), (F.col("confidence") * F.col("probability") / (1 + F.col("spread"))).alias("confidence"), (F.col("probability") >= 0.1).alias("valid"))
        out = step if out is None else out.unionByName(step)
        live = field.normal(moved.where(F.col("probability") >= 0.1), keys).withColumn("new", facing("normal", "n")).withColumn("previous", sub("p", "from"))
        now = cut(live.select(*keys, "p", along("previous", "new").alias("t"), F.col("new").alias("n"), norm(sub("new", "n")).alias("bend"), "state", "previous"))
        if now.isEmpty():
            break
    return out


def rollout_surface(volume: DataFrame | Field, seeds: DataFrame, weights: dict[str, np.ndarray], height: int, width: int) -> DataFrame:
    """grid (vol, seed), r, c, p, confidence, valid of a surface rolled out from each seed (vol, seed, p, t).

    A column of centres is traced both ways across t, then from each valid centre a row both ways along t. All seeds' columns and
    then all rows are traced together.
    """
    field = volume if isinstance(volume, Field) else Field(volume)
    keys = ["vol", "seed"]
    begun = cut(field.normal(seeds.select(*keys, "p", "t"), keys))

    def both(start: DataFrame, ahead: int, back: int, at: str) -> DataFrame:
        """Runs from start, numbered from the far end of the way back to the end of the way ahead."""
        one = trace_model(field, start, weights, ahead).withColumn(at, F.col("step") + back)
        two = trace_model(field, start, weights, back + 1, reverse=True).where("step > 0").withColumn(at, back - F.col("step"))
        return one.unionByName(two)

    upper = height // 2 + 1
    across = begun.select(*keys, "p", normalize(cross("normal", "t")).alias("t"))
    column = cut(both(across, upper, height - upper, "r").where(F.col("r") < height))
    middle = width // 2
    starts = column.where("valid").join(seeds.select(*keys, "t"), keys).select("vol", F.struct(F.col("seed"), "r").alias("seed"), "p", "t")
    rows = both(cut(starts), width - middle, middle, "c").where(F.col("c") < width)
    scored = rows.select("vol", "seed.seed", "seed.r", "c", "p", "confidence", "valid").join(column.select(*keys, "r", F.col("confidence").alias("whole")), [*keys, "r"])
    return scored.select(F.struct("vol", "seed").alias("grid"), "r", "c", "p", (F.col("confidence") * F.col("whole")).alias("confidence"), "valid")


def training_loss(batch: DataFrame, predictions: DataFrame) -> DataFrame:
    """displacement, confidence, variance and loss of predictions (predict) against batch (traj, step, target, mask, confidence), as one row.

    displacement is the smooth L1 distance over the predicted variance, a mean over the three parts and then over the steps of the mask; confidence the binary
    cross entropy of the logit with the clipped confidence over all steps, padding included; variance the mean log variance. The loss is displacement + 0.1 * confidence + 0.005 * variance.
    """
    rows = batch.withColumnRenamed("confidence", "seen").join(predictions, ["traj", "step"])
    parts = [(F.abs(F.col("target")[k] - F.col("d" + k)), F.col("l" + k)) for k in "xyz"]
    far = sum((F.when(t < 1, 0.5 * t * t).otherwise(t - 0.5) / F.exp(v) for t, v in parts), F.lit(0.0)) / 3
    goal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("seen")))
    x, m = F.col("logit"), F.col("mask").cast("double")
    entropy = F.greatest(x, F.lit(0.0)) - x * goal + F.log1p(F.exp(-F.abs(x)))
    got = rows.agg((F.sum(m * far) / F.greatest(F.sum(m), F.lit(1.0))).alias("displacement"), F.avg(entropy).alias("confidence"), F.avg((F.col("lx") + F.col("ly") + F.col("lz")) / 3).alias("variance"))
    return got.withColumn("loss", F.col("displacement") + 0.1 * F.col("confidence") + 0.005 * F.col("variance"))


def upsampled(logits: np.ndarray, size: int) -> np.ndarray:
    """Bilinear enlargement of a square to size * size, pixel centres aligned, edges held."""
    n = len(logits)
    if n == size:
        return logits
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    weights = np.zeros((size, n))
    weights[np.arange(size), low] += 1 - (at - low)
    weights[np.arange(size), np.minimum(low + 1, n - 1)] += at - low
    return weights @ logits @ weights.T


def infer_tiles(pixels: DataFrame, keys: list[str], size: int, stride: int, model: Callable[[np.ndarray], np.ndarray], clip: float = 200.0, divisor: float = 255.0, reverse_depth: bool = False, align: bool = False) -> DataFrame:
    """keys, row, col, v, n: a model's probabilities over overlapping tiles of a depth stack, averaged over the n tiles of a pixel.

    pixels: keys, k (layer), row, col, v, from row and col 0. A tile is one group of size * size * layers values; the
    model maps an array [layers, size, size] to a square of logits of any size up to the tile's, which is enlarged. Only whole tiles
    count; with align a last one ends at the far edge, without it pixels that no whole tile covers are 0 (n 0).
    """
    ends = pixels.groupBy(*keys).agg(F.max("row").alias("row_end"), F.max("col").alias("col_end"))

    def starts(axis: str) -> Column:
        x, last = F.col(axis), F.col(axis + "_end") + 1 - size
        first, most = F.greatest(F.lit(0), F.ceil((x - size + 1) / stride)), F.least(F.floor(x / stride), F.floor(last / stride))
        whole = F.when((last >= 0) & (first <= most), F.transform(F.sequence(first, most), lambda i: i * stride)).otherwise(F.array().cast("array<bigint>"))
        if not align:
            return whole
        return F.when((last >= 0) & (x >= last), F.array_union(whole, F.array(last.cast("long")))).otherwise(whole)

    placed = pixels.join(ends, keys)
    dealt = placed.select("*", F.explode(starts("row")).alias("i")).select("*", F.explode(starts("col")).alias("j"))
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}

    def run(batches):
        for b in batches:
            cells = b.column("cells")
            ends, flat = cells.offsets.to_numpy() - cells.offsets[0].as_py(), cells.flatten()
            k, row, col, v = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("k", "row", "col", "v"))
            spot, v = row * size + col, np.clip(v, 0, clip) / divisor
            spots, found = [], []
            for first, stop in zip(ends, ends[1:]):
                layers, layer = np.unique(k[first:stop], return_inverse=True)
                stack = np.zeros((len(layers), size * size))
                stack[layer, spot[first:stop]] = v[first:stop]
                stack = stack.reshape(len(layers), size, size)
                got = 1 / (1 + np.exp(-upsampled(model(stack[::-1] if reverse_depth else stack), size)))
                spots.append(np.unique(spot[first:stop]))
                found.append(got.ravel()[spots[-1]])
            counts = np.cumsum([0, *map(len, spots)])
            rows = pa.StructArray.from_arrays([pa.array(np.concatenate(spots or [[]]), pa.int64()), pa.array(np.concatenate(found or [[]]), pa.float64())], ["spot", "p"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(counts, pa.int32()), rows)], [*b.schema.names[:-1], "spots"])

    # Spark makes a row of each tile, so a task's batch holds many tiles and Python is called once for all of them.
    offset = [(F.col(x) - F.col(o)).cast("long").alias(x) for x, o in (("row", "i"), ("col", "j"))]
    lists = dealt.groupBy(*keys, "i", "j").agg(F.collect_list(F.struct("k", *offset, F.col("v").cast("double").alias("v"))).alias("cells"))
    schema = T.StructType([*lists.drop("cells").schema.fields, T.StructField("spots", T.ArrayType(T.StructType([T.StructField("spot", T.LongType()), T.StructField("p", T.DoubleType())])))])
    seen = lists.mapInArrow(run, schema).select(*keys, "i", "j", F.inline("spots"))
    place = [(F.col(o) + e).cast(kinds[x]).alias(x) for x, o, e in (("row", "i", F.floor(F.col("spot") / size)), ("col", "j", F.col("spot") % size))]
    seen = seen.select(*keys, *place, "p").groupBy(*keys, "row", "col").agg(F.avg("p").alias("v"), F.count(F.lit(1)).alias("n"))
    every = pixels.select(*keys, "row", "col").distinct()
    return every.join(seen, [*keys, "row", "col"], "left").select(*keys, "row", "col", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
