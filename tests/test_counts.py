"""Metrics of models follow from counted pairs of outcome and prediction."""

from __future__ import annotations

import random

import pytest

from paddock.operators import evaluation


def _ranks(xs):
    at = {}
    for i, x in enumerate(sorted(xs), 1):
        at.setdefault(x, []).append(i)
    return [sum(at[x]) / len(at[x]) for x in xs]


def _correlation(a, b):
    n, ma, mb = len(a), sum(a) / len(a), sum(b) / len(b)
    va, vb = sum((x - ma) ** 2 for x in a) / n, sum((x - mb) ** 2 for x in b) / n
    return 0.0 if va * vb == 0 else sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / n / (va * vb) ** 0.5


def _median(xs):
    s = sorted(xs)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def _rows(seed=3):
    r = random.Random(seed)
    rows = [(m, r.choice([None, *map(float, range(1, 25))]), r.choice([float(r.randrange(1, 9)), round(r.uniform(1, 20), 3)])) for m in "ab" for _ in range(900)]
    return rows + [("flat", float(i % 7), 0.3) for i in range(50)] + [("tied", 4.0, float(i)) for i in range(50)]


def test_metrics_of_repeated_pairs(spark):
    rows = _rows()
    got = {x.model: x for x in evaluation.core_metrics(spark.createDataFrame(rows, "model string, y_true double, y_pred double").repartition(5)).collect()}
    for m in ("a", "b", "flat", "tied"):
        t, p = zip(*[(t, p) for k, t, p in rows if k == m and t is not None], strict=True)
        size = [abs(a - b) for a, b in zip(t, p, strict=True)]
        assert got[m].n == len(t)
        assert got[m].mae == pytest.approx(sum(size) / len(t))
        assert got[m].rmse == pytest.approx((sum(s * s for s in size) / len(t)) ** 0.5)
        assert got[m].median_absolute_error == pytest.approx(_median(size))
        assert [got[m][f"within_{k}_pct"] for k in (3, 5, 10)] == pytest.approx([sum(s <= k for s in size) * 100 / len(t) for k in (3, 5, 10)])
        assert got[m].exact_pct == pytest.approx(sum(round(b) == a for a, b in zip(t, p, strict=True)) * 100 / len(t))
        assert got[m].spearman_correlation == pytest.approx(_correlation(_ranks(t), _ranks(p)))


def test_missing_predictions_count_as_rows_only(spark):
    rows = [("a", float(i), float(i)) for i in range(1, 9)] + [("a", 3.0, None), ("a", 5.0, None)]
    got = evaluation.core_metrics(spark.createDataFrame(rows, "model string, y_true double, y_pred double")).collect()[0]
    assert (got.n, got.mae, got.median_absolute_error, got.exact_pct) == (10, 0.0, 0.0, 80.0)


def test_only_counts_are_sent(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = spark.createDataFrame(_rows(), "model string, y_true double, y_pred double")
        plan = evaluation.core_metrics(long)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(plan):
        if "Exchange" in line:
            below = [x for x in plan[i + 1 :]]
            end = next((j for j, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            assert any("Aggregate" in x for x in below[:end])
