"""Logistic regressions, many at once: Newton steps from sums that one aggregation makes for all models.

A row names the models it trains by number.  In a step each task adds up, for each model, the loss,
its gradient and its second derivatives over its rows; their sums, some (features + 1) squared
numbers a model, come to the driver, which solves the small systems.  A fitted model is a row of a
table, and scores are Column arithmetic: no model object is part of a plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_STEPS, TOLERANCE = 100, 1e-9


@dataclass
class Fitted:
    weights: list[float]
    intercept: float


def _sums(rows: DataFrame, at: dict[int, tuple[np.ndarray, np.ndarray]], width: int) -> dict[int, np.ndarray]:
    """For each model: loss, gradient and second derivatives at its weights; at: weights, and the weights of both classes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            x = np.ones((n, width + 1))
            x[:, :width] = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            number = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(n), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            for m in np.unique(number):
                if m not in at:
                    continue
                beta, of_class = at[m]
                own = owner[number == m]
                xm, ym = x[own], y[own]
                w, s = of_class[ym.astype(int)], xm @ beta
                p = 1 / (1 + np.exp(-np.clip(s, -700, 700)))
                loss = (w * (np.logaddexp(0, s) - ym * s)).sum()
                second = (xm * (w * p * (1 - p))[:, None]).T @ xm
                stats = np.concatenate([[loss], xm.T @ (w * (p - ym)), second.ravel()])
                total[m] = total[m] + stats if m in total else stats
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], ["model", "stats"])

    def add(table: pa.Table) -> pa.Table:
        stats = table["stats"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
        return pa.table({"model": table["model"].combine_chunks()[:1], "stats": pa.array([stats.tolist()], pa.list_(pa.float64()))})

    kind = "model int, stats array<double>"
    return {r.model: np.array(r.stats) for r in rows.select("z", "label", "models").mapInArrow(part, kind).groupBy("model").applyInArrow(add, kind).collect()}


def fit(rows: DataFrame, width: int, balanced: bool = True, c: float = 1.0) -> dict[int, Fitted]:
    """The models that rows (z: width numbers, label 0 or 1, models: numbers of those the row trains) determine.

    Each minimises half the squared weights plus c times the losses; balanced: a class's rows
    weigh n / (2 * rows of the class).  The intercept is not penalised.  A model with rows of one
    class only is left out.  rows is read once for each step and should be a table.
    """
    n: dict[int, list[int]] = {}
    for r in rows.select("label", F.explode("models").alias("m")).groupBy("m", "label").agg(F.count("*").alias("n")).collect():
        n.setdefault(r.m, [0, 0])[int(r.label)] = r.n
    of_class = {m: np.array([(a + b) / (2.0 * a), (a + b) / (2.0 * b)]) if balanced else np.ones(2) for m, (a, b) in n.items() if a and b}
    ridge = np.append(np.full(width, 1.0 / c), 0.0)
    beta = {m: np.zeros(width + 1) for m in of_class}
    best: dict[int, tuple[float, np.ndarray]] = {}
    open_models = set(beta)
    for _ in range(MAX_STEPS):
        if not open_models:
            break
        sums = _sums(rows, {m: (beta[m], of_class[m]) for m in open_models}, width)
        for m in sorted(open_models):
            s, b = sums[m], beta[m]
            value = s[0] + (ridge * b * b).sum() / 2
            if m in best and value > best[m][0] * (1 + 1e-12) + 1e-12:
                beta[m] = (b + best[m][1]) / 2  # a step too far: back by half
                if np.abs(beta[m] - best[m][1]).max() < TOLERANCE:
                    beta[m] = best[m][1]
                    open_models.discard(m)
                continue
            best[m] = value, b
            gradient = s[1: width + 2] + ridge * b
            second = s[width + 2:].reshape(width + 1, width + 1) + np.diag(ridge)
            step = np.linalg.lstsq(second, gradient, rcond=None)[0]
            if np.abs(step).max() < TOLERANCE:
                open_models.discard(m)
            else:
                beta[m] = b - step
    return {m: Fitted(b[:width].tolist(), float(b[width])) for m, b in beta.items()}


def table(spark: SparkSession, fitted: dict[int, Fitted]) -> DataFrame:
    """(model, weights, intercept): as many rows as there are models."""
    return spark.createDataFrame([(m, f.weights, f.intercept) for m, f in sorted(fitted.items())], "model int, weights array<double>, intercept double")


def probability(z: Column, weights: Column, intercept: Column) -> Column:
    s = F.aggregate(F.zip_with(z, weights, lambda x, w: x * w), intercept, lambda a, x: a + x)
    return 1 / (1 + F.exp(-s))


def scored(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows (z, model) with p in place of z; rows whose model does not exist go."""
    both = rows.join(F.broadcast(models), "model")
    return both.withColumn("p", probability(F.col("z"), F.col("weights"), F.col("intercept"))).drop("z", "weights", "intercept")
