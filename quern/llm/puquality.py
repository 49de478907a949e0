"""Quality classifier by positive-unlabelled learning.

The training rows are trusted positives (documents labelled of good quality)
and unlabelled documents; negative labels are used for nothing. The model
minimises the non-negative unbiased risk
p R+(positives) + max(0, R-(unlabelled) - p R-(positives))  under the logistic
loss: where the bracket turns negative, a step goes against its gradient
instead. It is linear in steps of text statistics (is a ratio above a quantile
of the unlabelled rows?), so scores are a Spark expression.

The class prior p is estimated from both kinds of rows alone: a first model
tells positives from unlabelled rows; of any share of the positives that it puts
above a bound, the unlabelled rows have p times as many of their own and some
negatives. So p is at most the ratio of the two shares, and the least ratio, on
rows that the first model hasn't seen, is taken.

At most ``MAX_POSITIVES`` and ``MAX_UNLABELLED`` training rows are taken (chosen
by the hash of their ids); held-out rows (crc32 of the id's text modulo 3 is
1) are neither. Every document is scored, from its whole text. Nulls and empty
texts have statistics of 0 and a score like any other. Where there are no
positives all scores are 0.5. Repeated rows are scored and returned each; an
empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import _io, rules, stats

#: Training rows of either kind that are taken at most.
MAX_POSITIVES, MAX_UNLABELLED = 10_000, 20_000
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99)
FEATURES = (*rules.RATIOS, "n_words")


@dataclass(frozen=True)
class Model:
    steps: tuple[tuple[str, float], ...]
    weights: tuple[float, ...]
    bias: float
    prior: float

    def score(self) -> Column:
        terms = [F.when(F.col(f) > t, F.lit(w)).otherwise(0.0) for (f, t), w in zip(self.steps, self.weights, strict=True) if w]
        z = reduce(lambda a, b: a + b, terms, F.lit(self.bias))
        return 1 / (1 + F.exp(-z))


#: Positives that a share must keep for its ratio to count in the estimate of the prior.
LEAST_SHARE = 0.3


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from scores of both that grow with being positive."""
    bounds = np.quantile(positive, np.linspace(0, 1 - LEAST_SHARE, 100))
    above = lambda x: 1 - np.searchsorted(np.sort(x), bounds, "left") / len(x)
    ratio = (above(unlabelled) + 1 / len(unlabelled)) / np.maximum(above(positive), LEAST_SHARE)
    return float(np.clip(ratio.min(), 0.01, 0.99))


def _log_loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _descend(p: np.ndarray, u: np.ndarray, slopes, bias: float, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias after steps along the derivatives that slopes gives of both kinds' scores."""
    w = np.zeros(p.shape[1])
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        dp, du = slopes(p @ w + bias, u @ w + bias)
        gradient = np.append(dp @ p + du @ u + decay * w, dp.sum() + du.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - float(step[-1])
    return w, bias


def fit(positives: dict[str, np.ndarray], unlabelled: dict[str, np.ndarray], prior: float | None = None, rounds: int = 500, rate: float = 0.05, decay: float = 1e-3, slack: float = 0.0) -> Model:
    """The model of least risk; without a prior it is estimated."""
    steps = tuple((f, float(q)) for f in FEATURES for q in np.unique(np.quantile(unlabelled[f], QUANTILES)) if (unlabelled[f] > q).any())
    p, u = (np.stack([x[f] > q for f, q in steps], 1).astype(float) if steps else np.zeros((len(x["n_words"]), 0)) for x in (positives, unlabelled))

    def apart(zp, zu):
        return (_sigmoid(zp) - 1) / len(zp), _sigmoid(zu) / len(zu)

    def risk(zp, zu):
        negative = _log_loss(-zu).mean() - prior * _log_loss(-zp).mean()
        minus_p, minus_u = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        if negative < -slack:
            return -minus_p, -minus_u
        return prior * (_sigmoid(zp) - 1) / len(zp) + minus_p, minus_u

    if prior is None:
        rng = np.random.default_rng(3)
        half_p, half_u = rng.random(len(p)) < 0.5, rng.random(len(u)) < 0.5
        if min(half_p.sum(), (~half_p).sum(), half_u.sum(), (~half_u).sum()) < 5:
            prior = 0.5  # too few rows to tell
        else:
            w, _ = _descend(p[half_p], u[half_u], apart, 0.0, rounds // 2, rate, decay)
            prior = estimate_prior(p[~half_p] @ w, u[~half_u] @ w)
    w, bias = _descend(p, u, risk, float(np.log(prior / (1 - prior))), rounds, rate, decay)
    return Model(steps, tuple(map(float, w)), bias, prior)


def train(measured: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")).where(_io.crc_fold() != 1)
    rows = rules.with_ratios(measured.where(_io.crc_fold() != 1))

    def sample(df: DataFrame, most: int) -> dict[str, np.ndarray]:
        taken = _io.sampled(df, most).select(*FEATURES).toPandas().sort_values(list(FEATURES), kind="stable")  # rows come in any order
        return {f: taken[f].to_numpy(float) for f in FEATURES}

    trusted = _io.sampled(known.where("quality = 1").select("doc_id"), max_positives)
    positives = sample(rows.join(trusted, "doc_id", "left_semi"), max_positives)
    unlabelled = sample(rows, max_unlabelled)
    if not len(positives["n_words"]) or not len(unlabelled["n_words"]):
        return Model((), (), 0.0, 0.5)
    return fit(positives, unlabelled)


def scored(measured: DataFrame, model: Model) -> DataFrame:
    out = rules.with_ratios(measured).select("doc_id", (_io.crc_fold() == 1).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_pu_quality(spark, sf_dir: str) -> DataFrame:
    measured = _io.checkpoint(stats.measured(_io.table(spark, sf_dir, "documents")))
    return scored(measured, train(measured, _io.table(spark, sf_dir, "labels")))
