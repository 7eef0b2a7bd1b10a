"""Operator 10, mixing to target weights with soft domain membership.

A softmax classifier of word presence, fitted on a labelled table, gives each document a posterior
over domains. Projected least squares then finds nonnegative rates r so that the expected domain
totals sum(r * tokens * posterior) match the targets. A rate is 1 less the posterior times one weight
for each domain, cut at 0, so a few numbers give the rates wherever they are needed: a round is one pass over
the written (tokens, posterior) table that sends back the domains' totals and Gram matrix, and moves
the weights by the preconditioned residuals. Tokens are words separated by white space.

Fitting reads a bounded sample: sample_per_domain labelled documents of each domain, of at most sample_bytes bytes each and
total_bytes a domain. Posteriors, totals and rates cover all documents. The targets hold for the expected totals, which are
sums over rates; copies drawn from the rates meet them but for the draw, which a few very long documents can shift by a percent or two.

Cases: null or empty text has no tokens and the posterior of a text without known words; of a very long text its set of
words is held besides; null ids and domains aren't learned from, and a repeated id counts once; repeated rows and ties get equal rates, the copies of a row
depend on its id alone; with no labelled row there is one domain, "all"; targets of domains that no
label has are left out, the others keep their proportions; an empty table gives an empty result;
columns of the input are carried under their names, except those that the operator adds, which are replaced.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surfacelab.llm.shared import column, labelled_sample, others, plain, renamed, table, unused, written

SAMPLE_PER_DOMAIN, SAMPLE_BYTES, TOTAL_BYTES, VOCABULARY = 1500, 100_000, 24_000_000, 20_000
ROUNDS, TOLERANCE = 80, 1e-5
#: Keeps the solver's matrix regular, as a share of the token total.
PULL = 1e-12
ADDED = ("n_tokens", "posterior", "rate", "copies")


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    words: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray

    def tokens_and_posterior(self, text: str | None) -> tuple[int, np.ndarray]:
        words = (text or "").lower().split()
        known = self.words.keys() & set(words)
        z = self.bias + self.weights[[self.words[w] for w in known]].sum(axis=0) if known else self.bias
        p = np.exp(z - z.max())
        return len(words), p / p.sum()


def fit(rows: list[tuple[str, str]], rounds: int = 80, ridge: float = 1.0) -> Classifier:
    """A softmax regression of (domain, text) rows by Adam; every domain weighs as it occurs."""
    domains = tuple(sorted({d for d, _ in rows}))
    if len(domains) < 2:
        return Classifier(domains or ("all",), {}, np.zeros((0, 1)), np.zeros(1))
    # Words are held as numbers at once: a string object for each word of each text would be many times the sample's bytes.
    number: dict[str, int] = {}
    held = [np.array(sorted({number.setdefault(w, len(number)) for w in t.lower().split()}), np.int64) for _, t in rows]
    often = np.bincount(np.concatenate(held), minlength=len(number))
    chosen = sorted((w for w, i in number.items() if often[i] >= 3), key=lambda w: (-often[number[w]], w))[:VOCABULARY]
    words = {w: i for i, w in enumerate(chosen)}
    place = np.full(len(number), -1)
    place[np.array([number[w] for w in chosen], np.int64)] = np.arange(len(chosen))
    cols = [np.sort(p[p >= 0]) for p in (place[h] for h in held)]
    row, col = np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols)
    y = np.eye(len(domains))[[domains.index(d) for d, _ in rows]]
    w, b = np.zeros((len(words), len(domains))), np.log(y.mean(axis=0))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.stack([np.bincount(row, w[col, k], len(rows)) for k in range(len(domains))], axis=1) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        e = p - y
        g = np.stack([np.bincount(col, e[row, k], len(words)) for k in range(len(domains))], axis=1) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b = b - 0.5 * e.mean(axis=0)
    return Classifier(domains, words, w, b)


def train(docs: DataFrame, labelled: DataFrame, sample_per_domain: int = SAMPLE_PER_DOMAIN, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> Classifier:
    """A classifier from docs (doc_id, text) and a labelled table (doc_id, domain)."""
    labels = labelled.select("doc_id", F.col("domain").alias("label"))
    return fit(labelled_sample(docs, labels, sample_per_domain, sample_bytes, total_bytes))


@dataclass(frozen=True)
class Plan:
    """Weights of the domains in a rate, the targets, and the largest miss as a share of the token total."""

    weights: tuple[float, ...]
    targets: tuple[float, ...]
    miss: float = 0.0

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1 - posterior @ np.array(self.weights))


def _posteriors(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def memberships(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """docs with n_tokens and posterior (array in the order of the model's domains)."""
    carried = others(docs, ADDED)
    rows, names = plain(docs, carried, text=column(text).cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = [shared.value.tokens_and_posterior(t.as_py()) for t in b.column(b.num_columns - 1)]
            n, p = pa.array([x[0] for x in got], pa.int64()), pa.array([x[1].tolist() for x in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n, p], [*names, "n_tokens", "posterior"])

    return renamed(rows.mapInArrow(run, rows.drop("text").schema.add("n_tokens", T.LongType()).add("posterior", T.ArrayType(T.DoubleType()))), carried)


def _totals(members: DataFrame, k: int, weigh) -> np.ndarray:
    """Sum over all rows of tokens * weigh(posterior), a short vector; one row from each batch."""

    def run(batches):
        for b in batches:
            n = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
            total = (n[:, None] * weigh(_posteriors(b.column("posterior"), k))).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "total"])

    parts = members.select("n_tokens", "posterior").mapInArrow(run, "k int, total double")
    found = {r.k: r.total for r in parts.groupBy("k").agg(F.sum("total").alias("total")).collect()}
    return np.array([found[i] for i in sorted(found)])


def _moments(members: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Half the sum of tokens * rate ** 2, the domains' totals, and the Gram matrix of rows of positive rate."""
    k = len(weights)

    def weigh(p: np.ndarray) -> np.ndarray:
        rate = np.maximum(0.0, 1 - p @ weights)
        pairs = (p[:, :, None] * p[:, None, :]).reshape(-1, k * k) * (rate > 0)[:, None]
        return np.concatenate([rate[:, None] ** 2 / 2, rate[:, None] * p, pairs], axis=1)

    got = _totals(members, k, weigh)
    return (float(got[0]), got[1 : k + 1], got[k + 1 :].reshape(k, k)) if len(got) else (0.0, np.zeros(k), np.zeros((k, k)))


def solve(members: DataFrame, domains: tuple[str, ...], targets: dict[str, float] | None = None, factors: dict[str, float] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Plan:
    """Rates for target weights, or for the present weights times factors; the token total stays.

    The nonnegative rates nearest to 1 that meet the targets are max(0, 1 - posterior * weights).
    The residual, divided by the Gram matrix of the rows of positive rate, moves the weights; a move
    is halved until it descends, so the rounds converge however rare a domain is. Rounds end when all totals are
    within tolerance. Targets that no rates meet are warned of, with the miss, which the plan keeps: chasing the least miss
    would leave a few extreme rows, so the rates are those nearest to 1 of at most twice that miss, to a power of ten in the pull.
    """
    k = len(domains)
    start = _moments(members, np.zeros(k))
    now, total = start[1], start[1].sum()
    if total <= 0:
        return Plan((0.0,) * k, (0.0,) * k)
    want = np.array([targets.get(d, 0.0) for d in domains]) if targets else now * np.array([(factors or {}).get(d, 1.0) for d in domains])
    want = want / want.sum() * total if want.sum() > 0 else now

    def descend(pull: float, enough: float) -> tuple[np.ndarray, float]:
        """Weights, and their miss, at the least of the dual with a pull towards 0, or once the miss is small enough."""
        pull *= total
        weights, (half, sums, gram), length = np.zeros(k), start, 1.0
        value = half
        for left in range(rounds, -1, -1):
            slope = want - sums + pull * weights
            miss = float(np.abs(sums - want).max() / total)
            if not left or length < 1e-6 or miss <= enough or np.abs(slope).max() <= 0.01 * tolerance * total:
                break
            move = -np.linalg.solve(gram + pull * np.eye(k), slope)
            ahead = weights + length * move
            new_half, new_sums, new_gram = _moments(members, ahead)
            new = new_half + want @ ahead + pull * (ahead @ ahead) / 2
            if new > value + 1e-4 * length * (slope @ move) + 1e-12 * total:
                length /= 2
                continue
            weights, sums, gram, value, length = ahead, new_sums, new_gram, new, 1.0
        return weights, miss

    weights, miss = descend(PULL, tolerance)
    if miss > tolerance:
        least = miss
        for power in range(1, 12):
            weights, miss = descend(10.0**-power, tolerance)
            if miss <= 2 * least:
                break
        if miss > tolerance:
            warnings.warn(f"mixing: domain totals miss the targets by up to {miss:.3g} of the token total ({least:.3g} at least)", RuntimeWarning, stacklevel=2)
    return Plan(tuple(weights), tuple(want), miss)


def with_rates(members: DataFrame, plan: Plan) -> DataFrame:
    """members with rate, and copies: its whole part, and one more for that share of the ids."""
    k, carried = len(plan.targets), others(members, ("posterior", "rate", "copies"))
    rows, names = plain(members, carried, posterior=F.col("posterior"))

    def run(batches):
        for b in batches:
            rates = plan.rates(_posteriors(b.column("posterior"), k))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates)], [*names, "posterior", "rate"])

    rated = renamed(rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("rate", T.DoubleType())])), carried)
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain of the labels table: toxic, low (quality 0) or clean."""
    rows = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return rows.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))


#: Target weights of the query and factors of the pipeline's stage.
TARGETS = {"clean": 0.90, "low": 0.04, "toxic": 0.06}
FACTORS = {"clean": 1.0, "low": 0.5, "toxic": 0.5}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, domain_labels(spark, sf_dir))
    members = written(memberships(docs, model).drop("text"), "memberships")
    rated = with_rates(members, solve(members, model.domains, TARGETS))
    return rated.select("doc_id", "n_tokens", *[F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", "copies")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, factors: dict[str, float] | None = None, learned: DataFrame | None = None) -> DataFrame:
    """docs, each row as many times as its copies. Texts are scored twice so as not to be shuffled.

    The classifier learns from the texts of learned (doc_id, text), of docs by default.
    """
    model = train(docs if learned is None else learned, labelled)
    members = written(memberships(docs.select("doc_id", "text"), model).drop("text"), "memberships")
    plan = solve(members, model.domains, targets, factors)
    rated = with_rates(memberships(docs, model), plan)
    copy = unused(docs.columns, "copy_")
    return rated.select(*map(column, docs.columns), F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1, copies) ELSE array() END")).alias(copy)).drop(copy)
