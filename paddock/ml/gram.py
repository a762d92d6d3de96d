"""Ridge regression from moments that are counted once.

One aggregation gives count, means and covariances of all features and the label for each fold. Moments of folds are merged on the
driver (their size depends on the features alone), so every training part of expanding folds and every penalty
is solved without reading the rows again. Predictions of all folds and penalties are one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.ml.models import LABEL
from paddock.operators import evaluation
from paddock.plans.literals import literal_table


@dataclass(frozen=True)
class Moments:
    """Count, means and centred sums of products; the label is last."""

    n: int
    mean: np.ndarray
    product: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if n == 0:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.product + other.product + np.outer(gap, gap) * (self.n * other.n / n))


@dataclass(frozen=True)
class Linear:
    """A fitted line: the penalty that it was fitted with, intercept and coefficients."""

    alpha: float
    intercept: float
    coefficients: tuple[float, ...]

    def expression(self, features: Sequence[str]) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f) * c for f, c in zip(features, self.coefficients, strict=True)], F.lit(self.intercept))


def moments(rows: DataFrame, features: Sequence[str], key: str | Column, label: str = LABEL) -> dict[int, Moments]:
    """Moments of each of the few values of ``key``; rows without a label do not count."""
    columns = [*features, label]
    size = len(columns)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    doubles = rows.where(F.col(label).isNotNull()).select(
        (F.col(key) if isinstance(key, str) else key).alias("_key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    found = doubles.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f"_{i}") for i in range(size)]).alias("mean"), F.array(*[F.covar_pop(f"_{i}", f"_{j}") for i, j in pairs]).alias("cov")
    )
    out = {}
    # one row per value of the key
    for r in found.collect():
        product = np.zeros((size, size))
        for (i, j), c in zip(pairs, r["cov"], strict=True):
            product[i, j] = product[j, i] = c * r["n"]
        out[r["_key"]] = Moments(r["n"], np.array(r["mean"]), product)
    return out


def total(parts: Iterable[Moments]) -> Moments | None:
    """All moments together; none where there are none."""
    return reduce(lambda a, b: a if b is None else b if a is None else a + b, parts, None)


def ridge(m: Moments, alpha: float = 1.0) -> Linear:
    """Least sum of squares plus ``alpha`` times that of the coefficients; the intercept is free. Where the system is
    singular the shortest solution is taken."""
    left = m.product[:-1, :-1] + alpha * np.eye(len(m.mean) - 1)
    try:
        w = np.linalg.solve(left, m.product[:-1, -1])
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(left, m.product[:-1, -1], rcond=None)[0]
    return Linear(float(alpha), float(m.mean[-1] - m.mean[:-1] @ w), tuple(map(float, w)))


def fit(rows: DataFrame, features: Sequence[str], alpha: float = 1.0, label: str = LABEL) -> Linear:
    """A line through all rows."""
    return ridge(total(moments(rows, features, F.lit(0), label).values()), alpha)


def fold_models(by_fold: dict[int, Moments], alphas: Sequence[float]) -> list[tuple[int, Linear]]:
    """A line for each test fold and penalty, fitted on all earlier folds. Folds without earlier rows have none."""
    folds = sorted(f for f in by_fold if f > 0)
    out = []
    for fold in folds:
        earlier = total(m for f, m in by_fold.items() if f < fold)
        if earlier is not None:
            out += [(fold, ridge(earlier, a)) for a in alphas]
    return out


def fold_predictions(rows: DataFrame, features: Sequence[str], alphas: Sequence[float], fold: str = "test_fold", label: str = LABEL) -> DataFrame:
    """Predictions of each tested row by the line of its fold, for every penalty: rows with alpha, y_true and y_pred."""
    fitted = fold_models(moments(rows, features, fold, label), alphas)
    columns = "fold int, alpha double, intercept double" + "".join(f", w{i} double" for i in range(len(features)))
    # folds times penalties, each with as many numbers as features
    lines = literal_table(rows.sparkSession, [(f, m.alpha, m.intercept, *m.coefficients) for f, m in fitted] or [(-1, 0.0, 0.0, *[0.0] * len(features))], columns)
    tested = rows.where(F.col(fold) > 0).join(F.broadcast(lines), F.col(fold) == F.col("fold"))
    value = reduce(lambda a, b: a + b, [F.col(f"w{i}") * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)], F.col("intercept"))
    return tested.withColumns({"y_true": F.col(label), "y_pred": value})


def cross_validate(rows: DataFrame, features: Sequence[str], alphas: Sequence[float], fold: str = "test_fold", label: str = LABEL) -> DataFrame:
    """MAE, RMSE and share within three places for every penalty and fold: each fold is predicted by a model of the earlier ones."""
    tested = fold_predictions(rows, features, alphas, fold, label)
    named = tested.select(F.col("alpha").cast("string").alias("model"), F.col("fold").alias("test_fold"), "y_true", "y_pred")
    return evaluation.fold_metrics(named).withColumn("alpha", F.col("model").cast("double")).drop("model")


def tune(rows: DataFrame, features: Sequence[str], alphas: Sequence[float], fold: str = "test_fold", label: str = LABEL) -> tuple[Linear, DataFrame]:
    """The line of the best penalty by mean MAE over the folds (the smaller one of equals), fitted on all rows, and a
    row for each penalty with its scores and the line that it gives on all rows."""
    scores = cross_validate(rows, features, alphas, fold, label).groupBy("alpha").agg(F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"))
    found = {r["alpha"]: r for r in scores.collect()}  # one row per penalty
    everything = total(moments(rows, features, F.lit(0), label).values())
    lines = {a: ridge(everything, a) for a in found}
    best = min(found, key=lambda a: (found[a]["mae_mean"], a))
    columns = "alpha double, mae_mean double, mae_std double, chosen int, intercept double" + "".join(f", w{i} double" for i in range(len(features)))
    table = [(a, found[a]["mae_mean"], found[a]["mae_std"], int(a == best), lines[a].intercept, *lines[a].coefficients) for a in sorted(found)]
    return lines[best], literal_table(rows.sparkSession, table, columns)


def stacked(rows: DataFrame, bases: Sequence[str], train: Column, alpha: float = 1.0, label: str = LABEL) -> Linear:
    """Meta model of a stack: a line through the base predictions of the training rows."""
    return fit(rows.where(train), bases, alpha, label)
