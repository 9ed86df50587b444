"""Multinomial logistic regression for a whole grid of settings at once.

Rows hold dense numbers `x`, indices `hot` of zero-one columns that are 1, and the class `target`. One pass over the stored rows gives
loss and gradient of every setting's current coefficients: each part of the table adds up its own, a second step adds parts, and the
driver, which sees one block of numbers, moves every setting by its own L-BFGS step. A setting that has converged is left out of
further passes. Columns are standardised without being filled in: the means enter through the intercept.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.functions.expressions import N_CLASSES, argmax_code, class_name
from tillflow.operators.metrics import CELLS, add_metrics, confusion_cells
from tillflow.sources.session import durable

HISTORY = 12                     # pairs that L-BFGS remembers
LOTS = 64                        # parts' sums are added in so many lots before the driver adds those
TOLERANCE = 1e-6                 # largest component of a converged gradient, of the mean loss


def rows_of(features: DataFrame, numeric, sparse: bool) -> DataFrame:
    """(x, hot, target) and the columns that tell rows apart, written once."""
    keep = [c for c in ("split", "length", "customer_id", "ground_truth") if c in features.columns]
    hot = F.transform("hot", lambda i: i.cast("int")) if sparse else F.array().cast("array<int>")
    return durable(features.select(*keep, F.array(*[F.col(c).cast("double") for c in numeric]).alias("x"), hot.alias("hot"), F.col("target").cast("int").alias("target")))


def _blocks(batches, columns):
    """x, hot as (row, index) pairs, and the other columns of each batch."""
    for b in batches:
        if b.num_rows:
            x = np.asarray(b.column("x").flatten(), np.float64).reshape(b.num_rows, -1)
            hot = b.column("hot")
            row = np.repeat(np.arange(b.num_rows), np.asarray(hot.value_lengths().to_numpy(zero_copy_only=False), np.int64))
            yield (x, row, np.asarray(hot.flatten(), np.int64), *[np.asarray(b.column(c), np.int64) for c in columns])


@dataclass
class Scaling:
    """Means and standard deviations of all columns; a constant column keeps its scale."""

    mean: np.ndarray
    sd: np.ndarray


def scaling(rows: DataFrame, n_numeric: int, n_hot: int) -> tuple[Scaling, np.ndarray]:
    """Of the training rows; and their classes' sizes."""
    one = rows.agg(F.count("*").alias("n"), *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(n_numeric)],
                   *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(n_numeric)], *[F.count_if(F.col("target") == k).alias(f"k{k}") for k in range(N_CLASSES)]).first()
    share = np.zeros(n_hot)
    for r in rows.select(F.explode("hot").alias("i")).groupBy("i").agg(F.count("*").alias("n")).collect() if n_hot else []:        # a row per coefficient
        share[r["i"]] = r["n"] / one["n"]
    mean = np.concatenate([[one[f"m{i}"] for i in range(n_numeric)], share])
    sd = np.concatenate([[one[f"s{i}"] for i in range(n_numeric)], np.sqrt(share * (1 - share))])
    return Scaling(mean, np.where(sd > 0, sd, 1.0)), np.array([one[f"k{k}"] for k in range(N_CLASSES)], float)


def _plain(theta: np.ndarray, s: Scaling) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the columns as they are, and intercepts; theta: (columns + 1) x classes of the standardised ones."""
    w = theta[:-1] / s.sd[:, None]
    return w, theta[-1] - s.mean @ w


def _logits(x, row, hot, w, b):
    out = x @ w[:x.shape[1]] + b
    if len(hot):
        np.add.at(out, row, w[x.shape[1] + hot])
    return out


def _sums(coefficients, weights, n_columns):
    """Per part one row of numbers: for every setting the loss, the residuals' sums, and their products with the columns."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros((len(coefficients), 1 + (n_columns + 1) * N_CLASSES))
        for x, row, hot, y in _blocks(batches, ("target",)):
            for i, ((w, b), class_weight) in enumerate(zip(coefficients, weights)):
                z = _logits(x, row, hot, w, b)
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                sums = p.sum(1)
                weight = class_weight[y]
                total[i, 0] += (weight * (np.log(sums) - z[np.arange(len(y)), y])).sum()
                r = p / sums[:, None]
                r[np.arange(len(y)), y] -= 1
                r *= weight[:, None]
                g = np.zeros((n_columns + 1, N_CLASSES))
                g[:x.shape[1]] = x.T @ r
                np.add.at(g, x.shape[1] + hot, r[row])
                g[-1] = r.sum(0)
                total[i, 1:] += g.ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])
    return run


def _added(rows):
    import pyarrow as pa

    total = sum(np.frombuffer(r.as_py(), np.float64) for r in rows.column("sums"))
    return pa.table({"part": rows.column("part")[:1], "sums": pa.array([np.asarray(total).tobytes()], pa.binary())})


def one_pass(rows: DataFrame, coefficients, weights, n_columns: int, many_parts: bool) -> np.ndarray:
    """Sums over all rows, a line per setting."""
    parts = rows.select("x", "hot", "target").mapInArrow(_sums(coefficients, weights, n_columns), "part long, sums binary")
    if many_parts:
        parts = parts.groupBy(F.pmod("part", F.lit(LOTS)).alias("lot")).applyInArrow(_added, "part long, sums binary")
    lots = parts.sort("part").toArrow().column("sums")                                      # LOTS at most
    return sum(np.frombuffer(x.as_py(), np.float64) for x in lots).reshape(len(coefficients), -1)


class Descent:
    """L-BFGS of one setting, fed with the loss and gradient at `trial`."""

    def __init__(self, start: np.ndarray):
        self.at, self.trial, self.pairs, self.step = None, start, [], 1.0
        self.loss = self.gradient = self.direction = None

    def _towards(self) -> np.ndarray:
        q, used = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            used.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(self.pairs, reversed(used)):
            q += s * (a - (y * q).sum() / (s * y).sum())
        return -q

    def feed(self, loss: float, gradient: np.ndarray) -> None:
        """Takes the trial or halves the step, and sets the next trial."""
        if self.at is not None:
            slope = (self.gradient * self.direction).sum()
            if loss > self.loss + 1e-4 * self.step * slope + 1e-14 * abs(self.loss) and self.step > 1e-10:
                self.step *= 0.5
                self.trial = self.at + self.step * self.direction
                return
            s, y = self.trial - self.at, gradient - self.gradient
            if (s * y).sum() > 1e-12 * (y * y).sum():
                self.pairs = [*self.pairs, (s, y)][-HISTORY:]
        self.at, self.loss, self.gradient = self.trial, loss, gradient
        self.direction = self._towards()
        if (self.direction * gradient).sum() >= 0:
            self.pairs, self.direction = [], -gradient
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / max(np.abs(gradient).sum(), 1e-12))
        self.trial = self.at + self.step * self.direction


@dataclass
class LinearModel:
    """A fitted setting: theta of the standardised columns, and what its fit came to."""

    settings: dict
    theta: np.ndarray
    scale: Scaling
    loss: float
    gradient: float
    passes: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add `p` and `prediction` to rows with x and hot."""
        return _scored(rows, [self]).withColumn("p", F.get("p", F.lit(0))).withColumn("prediction", class_name(argmax_code(F.col("p"))))


def _scored(rows: DataFrame, models) -> DataFrame:
    """Add `p`: class probabilities of every model."""
    plain = [_plain(m.theta, m.scale) for m in models]

    @F.pandas_udf("array<array<double>>")
    def probabilities(x, hot):
        import pandas as pd

        lengths = hot.map(len).to_numpy()
        row, flat = np.repeat(np.arange(len(x)), lengths), (np.concatenate(hot.to_numpy()) if lengths.sum() else np.zeros(0)).astype(np.int64)
        dense, out = np.stack(x.to_numpy()), []
        for w, b in plain:
            z = _logits(dense, row, flat, w, b)
            p = np.exp(z - z.max(1, keepdims=True))
            out.append(p / p.sum(1, keepdims=True))
        return pd.Series(list(map(list, np.stack(out, axis=1).tolist())))

    return rows.withColumn("p", probabilities("x", "hot"))


def fit_grid(rows: DataFrame, settings, n_numeric: int, n_hot: int = 0, tolerance: float = TOLERANCE, most: int = 2000) -> list[LinearModel]:
    """A model per setting (C, weights: "none" or "balanced"). The penalty of a row's mean loss is |coefficients|^2 / (2 C n)."""
    scale, sizes = scaling(rows, n_numeric, n_hot)
    n_columns, n = n_numeric + n_hot, sizes.sum()
    weight = {"none": np.ones(N_CLASSES), "balanced": n / (N_CLASSES * np.maximum(sizes, 1))}
    weights = [weight[s["weights"]] for s in settings]
    totals = [(w * sizes).sum() for w in weights]
    start = np.zeros((n_columns + 1, N_CLASSES))
    paths = [Descent(np.vstack([start[:-1], np.log(np.maximum(w * sizes, 0.5) / np.maximum(w * sizes, 0.5).sum())])) for w in weights]
    active, passes, many_parts = list(range(len(settings))), 0, rows.rdd.getNumPartitions() > LOTS
    used = [0] * len(settings)
    while active and passes < most:
        plain = [_plain(paths[i].trial, scale) for i in active]
        sums = one_pass(rows, plain, [weights[i] for i in active], n_columns, many_parts)
        passes += 1
        still = []
        for i, line in zip(active, sums):
            theta, penalty = paths[i].trial, 1 / (settings[i]["C"] * totals[i])
            g = line[1:].reshape(n_columns + 1, N_CLASSES) / totals[i]
            g[:-1] = (g[:-1] - scale.mean[:, None] * g[-1]) / scale.sd[:, None] + penalty * theta[:-1]
            paths[i].feed(line[0] / totals[i] + penalty / 2 * (theta[:-1] ** 2).sum(), g)
            used[i] = passes
            if np.abs(paths[i].gradient).max() >= tolerance:
                still.append(i)
        active = still
    return [LinearModel(dict(s), p.at, scale, float(p.loss), float(np.abs(p.gradient).max()), k) for s, p, k in zip(settings, paths, used)]


def grid_scores(models, rows: DataFrame, metric: str = "macro_f1") -> list[float]:
    """Every model's score on the same rows, from one pass."""
    return scores_of(_scored(rows, models), metric)


def scores_of(scored: DataFrame, metric: str) -> list[float]:
    """Per model, of rows with `target` and every model's probabilities `p`."""
    codes = scored.select(F.col("target").alias("y"), F.posexplode("p").alias("setting", "p")).withColumn("yhat", argmax_code(F.col("p")))
    scores = add_metrics(confusion_cells(codes, ("setting",))).drop(*CELLS).select("setting", metric).collect()                 # a number per setting
    return [r[metric] for r in sorted(scores, key=lambda r: r["setting"])]


def best_of(models, scores) -> int:
    """Place of the best score, the first one on ties."""
    return max(range(len(models)), key=lambda i: (scores[i], -i))
