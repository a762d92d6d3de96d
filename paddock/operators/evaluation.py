"""Evaluation of predictions in long form (model, y_true, y_pred): metrics, comparison, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.plans.blocks import exact_quantiles, framed, histogram, number_rows

BANDS = ((1, 3), (4, 10), (11, 20))
PERCENTILES = (25, 50, 75, 90)


def _scored(long: DataFrame) -> DataFrame:
    """Rows with a known outcome, their error and its size."""
    error = F.col("y_pred") - F.col("y_true")
    return long.where(F.col("y_true").isNotNull()).withColumns({"error": error, "size": F.abs(error)})


def _percent(c: Column) -> Column:
    return F.avg(F.when(c, 100.0).otherwise(0.0))


def outcome_pairs(long: DataFrame) -> DataFrame:
    """Distinct pairs of a known outcome and a prediction of each model, with the number of rows that have them (n)."""
    return long.where(F.col("y_true").isNotNull()).groupBy("model", "y_pred", "y_true").agg(F.count(F.lit(1)).alias("n"))


def spearman(long: DataFrame) -> DataFrame:
    """Rank correlation per model with shared ranks on ties, 0 where it is undefined."""
    return _rank_correlation(outcome_pairs(long))


def _mean_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Mean rank of each distinct value of a model, less the mean of all ranks."""
    placed = histogram(rows, ["model"], value, F.floor(F.col(value) * 64), "n")
    return placed.select("model", F.col("_v").alias(value), (F.col("_start") + (F.col("_n") - F.col("_total")) / 2.0).alias(name))


def _rank_correlation(pairs: DataFrame) -> DataFrame:
    """``spearman`` of counted pairs. The rank of an outcome depends on it alone, so it joins sums by outcome, which are few."""
    n, p, t = F.col("n"), F.col("_rp"), F.col("_rt")
    outcomes = pairs.groupBy("model", "y_true").agg(F.sum("n").alias("n"))
    by_outcome = pairs.join(_mean_ranks(pairs, "y_pred", "_rp"), ["model", "y_pred"]).groupBy("model", "y_true").agg(
        F.sum("n").alias("n"), F.sum(n * p).alias("_p"), F.sum(n * p * p).alias("_pp")
    )
    sums = by_outcome.join(_mean_ranks(outcomes, "y_true", "_rt"), ["model", "y_true"]).groupBy("model").agg(
        F.sum("n").alias("n"), F.sum(n * t).alias("_t"), F.sum(n * t * t).alias("_tt"), F.sum("_p").alias("_p"), F.sum("_pp").alias("_pp"), F.sum(F.col("_p") * t).alias("_tp")
    )
    spread = lambda a, b, ab: F.col(ab) / n - F.col(a) / n * (F.col(b) / n)
    correlation = F.try_divide(spread("_t", "_p", "_tp"), F.sqrt(F.greatest(spread("_t", "_t", "_tt"), F.lit(0.0)) * F.greatest(spread("_p", "_p", "_pp"), F.lit(0.0))))
    return sums.select("model", F.coalesce(correlation, F.lit(0.0)).alias("spearman_correlation"))


def core_metrics(long: DataFrame, within: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """MAE, RMSE, median error, share within k places, exact share and rank correlation per model.

    All of them follow from the distinct pairs of outcome and prediction and their counts, so rows are sent once."""
    pairs = outcome_pairs(long)
    rows, n = _scored(pairs), F.col("n")
    mean = lambda c: F.sum(n * c) / F.sum(F.when(c.isNotNull(), n))
    share = lambda c: F.sum(F.when(c, n * 100.0).otherwise(0.0)) / F.sum(n)
    base = rows.groupBy("model").agg(
        mean(F.col("size")).alias("mae"),
        F.sqrt(mean(F.col("error") * F.col("error"))).alias("rmse"),
        *[share(F.col("size") <= k).alias(f"within_{k}_pct") for k in within],
        share(F.rint("y_pred") == F.col("y_true")).alias("exact_pct"),
        F.sum("n").alias("n"),
    )
    base = base.select("model", "n", *[c for c in base.columns if c not in ("model", "n")])
    median = exact_quantiles(rows, ["model"], "size", {"median_absolute_error": 0.5}, F.floor(F.col("size") * 64), "n").drop("n_values")
    return base.join(median, "model").join(_rank_correlation(pairs), "model")


def error_distribution(long: DataFrame) -> DataFrame:
    """Mean, deviation and population skewness of errors, and MAE by band of true places."""
    e = F.col("error")
    skew = F.when((F.count(F.lit(1)) >= 3) & (F.stddev_pop(e) > 0), F.skewness(e)).otherwise(F.lit(0.0))
    return _scored(long).groupBy("model").agg(
        F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error"), skew.alias("error_skewness"),
        *[F.avg(F.when(F.col("y_true").between(a, b), F.col("size"))).alias(f"mae_positions_{a}_{b}") for a, b in BANDS],
    )


def additional_metrics(long: DataFrame) -> DataFrame:
    """Range and deviation of predictions, largest error, share of errors within their own percentiles."""
    rows = _scored(long)
    limits = exact_quantiles(rows, ["model"], "size", {f"_p{p}": p / 100 for p in PERCENTILES}, F.floor(F.col("size") * 64)).drop("n_values")
    return rows.join(limits, "model").groupBy("model").agg(
        F.min("y_pred").alias("pred_min"), F.max("y_pred").alias("pred_max"), F.stddev_pop("y_pred").alias("pred_std"), F.max("size").alias("max_error"),
        *[_percent(F.col("size") <= F.col(f"_p{p}") + 1e-12).alias(f"accuracy_p{p}") for p in PERCENTILES],
    )


def comparison(metrics: DataFrame) -> DataFrame:
    """Best and worst model per metric: smallest MAE, otherwise the largest value."""
    names = ["mae", "spearman_correlation", "within_3_pct", "exact_pct"]
    long = metrics.unpivot("model", names, "metric", "value")
    quality = F.when(F.col("metric") == "mae", -F.col("value")).otherwise(F.col("value"))
    return long.withColumn("_q", quality).groupBy("metric").agg(
        F.max_by("model", F.struct("_q", "model")).alias("best_model"), F.max_by("value", F.struct("_q", "model")).alias("best_value"),
        F.min_by("model", F.struct("_q", "model")).alias("worst_model"), F.min_by("value", F.struct("_q", "model")).alias("worst_value"),
    )


def ensemble_weights(long: DataFrame) -> DataFrame:
    """Normalised weights of three strategies: accuracy, equal, accuracy times steadiness.

    One row per model, so the totals are taken over the handful of models.
    """
    per_model = _scored(long).groupBy("model").agg((1.0 / (1.0 + F.avg("size"))).alias("accuracy"), (1.0 / (1.0 + F.var_pop("y_pred"))).alias("steadiness"))
    raw = per_model.select("model", F.col("accuracy").alias("weighted_average"), F.lit(1.0).alias("voting"), (F.col("accuracy") * F.col("steadiness")).alias("dynamic"))
    names = ["weighted_average", "voting", "dynamic"]
    rows = raw.unpivot("model", names, "strategy", "raw")
    total = rows.groupBy("strategy").agg(F.sum("raw").alias("total"))
    return rows.join(total, "strategy").select("strategy", "model", (F.col("raw") / F.col("total")).alias("weight"))


def combine(long: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted sums of the model predictions per row and strategy."""
    return long.join(F.broadcast(weights), "model").groupBy(*keys, "strategy").agg(F.sum(F.col("weight") * F.col("y_pred")).alias("y_pred"))


def evaluation_report(metrics: DataFrame) -> DataFrame:
    """One text block per model."""
    lines = [
        F.upper("model"),
        F.format_string("MAE: %.3f", "mae"),
        F.format_string("Spearman Correlation: %.3f", "spearman_correlation"),
        F.format_string("Within 3 places: %.1f%%", "within_3_pct"),
        F.format_string("Exact places: %.1f%%", "exact_pct"),
        F.format_string("RMSE: %.3f", "rmse"),
    ]
    return metrics.select("model", F.concat_ws("\n", *lines).alias("report"))


def text_block(text: Column, start: int, length: int = 4) -> Column:
    """A number that never decreases along texts with a common beginning: the codes of `length` characters from
    place `start` on, as digits."""
    digit = lambda i: F.coalesce(F.nullif(F.ascii(F.substring(text, i, 1)), F.lit(0)), F.lit(0)).cast("long")
    return reduce(lambda acc, i: acc * 128 + F.least(digit(i), F.lit(127)), range(start + 1, start + length), digit(start))


def time_order(rows: DataFrame, date: str, key: str, keys: tuple[str, ...] = (), block: Column | None = None) -> DataFrame:
    """Position ``row_no`` of every row in time order, inside ``keys`` where given. Rows are numbered day by day; a
    ``block`` below 2^28 that never decreases along ``key`` cuts the days further."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).cast("long")
    chunk = day if block is None else day * 2**28 + block
    return number_rows(rows, list(keys), [F.col(date), F.col(key)], chunk, "row_no", upper=day)


def _with_size(ordered: DataFrame, keys: tuple[str, ...], size: Column | None) -> DataFrame:
    """Adds the number of rows, of each of the few ``keys`` or of all, from an aggregate of that many rows. ``size`` may
    say it where it is known, so that the rows are not counted again."""
    if size is not None:
        return ordered.withColumn("_size", size)
    marked = ordered.withColumn("_all", F.lit(0))
    sizes = marked.groupBy("_all", *keys).agg(F.count(F.lit(1)).alias("_size"))
    return marked.join(F.broadcast(sizes), ["_all", *keys]).drop("_all")


def temporal_split(ordered: DataFrame, test_share: float = 0.2, keys: tuple[str, ...] = (), size: Column | None = None) -> DataFrame:
    """Mark the last share of the rows in time order as test."""
    first = F.floor(F.col("_size") * F.lit(1 - test_share))
    return _with_size(ordered, keys, size).withColumn("is_test", F.col("row_no") > first).drop("_size")


def folds(ordered: DataFrame, k: int = 5, keys: tuple[str, ...] = (), size: Column | None = None) -> DataFrame:
    """Expanding folds: each row with the fold it tests; it trains all later folds. 0 is never tested."""
    part = F.floor(F.col("_size") / (k + 1))
    fold = F.ceil((F.col("row_no") - (F.col("_size") - k * part)) / F.greatest(part, F.lit(1)))
    return _with_size(ordered, keys, size).withColumn("test_fold", F.greatest(F.lit(0), fold).cast("int")).drop("_size")


def is_ordered(rows: DataFrame, keys: list[str], number: str, date: str) -> DataFrame:
    """Whether dates never decrease along ``number`` within each key."""
    ok = F.col("_earlier") <= F.col(date)
    pairs = framed(rows, keys, number, {(-1, 0): {"_earlier": lambda w: F.first(date).over(w)}})
    return pairs.groupBy(*keys).agg(F.bool_and(ok).alias("is_ordered"))


def mean_importance(importances: DataFrame) -> DataFrame:
    """Mean importance of each feature over models, largest first."""
    return importances.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.col("importance").desc(), "feature")


def cross_validation_summary(fold_metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean, deviation, minimum and maximum of each metric over the folds."""
    long = fold_metrics.unpivot(["model", "fold"], names, "metric", "value")
    return long.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n_folds")
    )


def fold_metrics(folded: DataFrame) -> DataFrame:
    """Metrics per model and test fold of already predicted rows."""
    rows = _scored(folded.where(F.col("test_fold") > 0))
    return rows.groupBy("model", F.col("test_fold").alias("fold")).agg(
        F.avg("size").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), _percent(F.col("size") <= 3).alias("within_3_pct")
    )
