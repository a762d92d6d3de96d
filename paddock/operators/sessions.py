"""Lap and weather tables of sessions: fastest laps, summaries, qualifying times, series statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock import values
from paddock.plans.blocks import edge_rows, exact_quantiles, number_rows

MIN_SESSION_DRIVERS = 18
KEYS = ["session_id", "driver_code"]


def valid_laps(laps: DataFrame) -> DataFrame:
    """Laps with a time; times in whole milliseconds, cut not rounded."""
    return laps.where(F.col("lap_time_ms").isNotNull())


def session_validity(laps: DataFrame) -> DataFrame:
    """A session counts if it has laps and at least 18 drivers."""
    drivers = F.count_distinct("driver_code")
    return laps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_laps"), drivers.alias("n_drivers"), (drivers >= MIN_SESSION_DRIVERS).alias("is_valid")
    )


def fastest_laps(laps: DataFrame) -> DataFrame:
    """Fastest lap of each driver in each session, the first one on ties."""
    return valid_laps(laps).groupBy(*KEYS).agg(F.min(F.struct("lap_time_ms", "lap_number")).alias("f")).select(*KEYS, "f.*")


def telemetry_summary(laps: DataFrame) -> DataFrame:
    """Lap counts, lap time statistics (sample deviation) and mean sector times."""
    base = laps.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("total_laps"),
        F.count("lap_time_ms").alias("valid_laps"),
        F.min("lap_time_ms").alias("fastest_ms"),
        F.avg("lap_time_ms").alias("mean_ms"),
        F.stddev_samp("lap_time_ms").alias("std_ms"),
        *[F.avg(f"sector{i}_ms").alias(f"mean_sector{i}_ms") for i in (1, 2, 3)],
    )
    median = exact_quantiles(laps, KEYS, "lap_time_ms", {"median_ms": 0.5}, F.floor(F.col("lap_time_ms") / 1000)).drop("n_values")
    return base.join(median, KEYS, "left")


def qualifying_times(laps: DataFrame, session_results: DataFrame, best: bool = False) -> DataFrame:
    """Q1 is the first lap flagged as personal best (or the fastest one with ``best``); Q2, Q3 from results."""
    order = "lap_time_ms" if best else "lap_number"
    flagged = laps.where(F.col("is_personal_best") & F.col("lap_time_ms").isNotNull())
    q1 = flagged.groupBy(*KEYS).agg(F.min_by("lap_time_ms", order).alias("q1_ms"))
    return q1.join(session_results.select(*KEYS, "q2_ms", "q3_ms"), KEYS, "left").withColumn("driver_id", F.lower("driver_code"))


def last_weather(sessions: DataFrame, readings: DataFrame) -> DataFrame:
    """Last weather reading of each session; missing values and sessions get the defaults."""
    names = list(values.DEFAULT_WEATHER)
    last = readings.groupBy("session_id").agg(F.max_by(F.struct(*names), "ordinal").alias("w"))
    return sessions.join(last, "session_id", "left").select(
        "session_id", *[F.coalesce(F.col(f"w.{n}"), F.lit(v)).alias(n) for n, v in values.DEFAULT_WEATHER.items()]
    )


def session_summary(laps: DataFrame) -> DataFrame:
    """Laps and drivers per session; the driver list is one row per driver in ``session_drivers``."""
    return laps.groupBy("session_id").agg(
        F.first("session_type").alias("session_type"), F.count(F.lit(1)).alias("total_laps"), F.count_distinct("driver_code").alias("n_drivers")
    )


def session_drivers(laps: DataFrame) -> DataFrame:
    return laps.select(*KEYS).distinct()


def available_sessions(laps: DataFrame) -> DataFrame:
    """Which session types exist per event day, in alphabetical order."""
    kinds = laps.select("day", "session_type").distinct()
    return kinds.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("session_type")), ",").alias("sessions"))


def source_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Which keys the two sources hold."""
    a = left.select(key).distinct().withColumn("in_results", F.lit(True))
    b = right.select(key).distinct().withColumn("in_sessions", F.lit(True))
    return a.join(b, key, "full_outer").select(
        key, F.coalesce("in_results", F.lit(False)).alias("in_results"), F.coalesce("in_sessions", F.lit(False)).alias("in_sessions")
    )


def numbered(series: DataFrame, key: str, order: list[Column], chunk: Column) -> DataFrame:
    """0-based index of the values of each series."""
    return number_rows(series, [key], order, chunk, "_no").withColumn("idx", F.col("_no") - 1).drop("_no")


def percentiles(series: DataFrame, key: str, percents: tuple[int, ...] = (25, 50, 75)) -> DataFrame:
    """Percentiles with linear interpolation."""
    return exact_quantiles(series, [key], "value", {f"percentile_{p}": p / 100 for p in percents}, F.floor("value"))


def outliers(series: DataFrame, key: str, method: str = "iqr") -> DataFrame:
    """Outlying values with their index; by 1.5 times the quartile range or 2.5 deviations, from 4 values on."""
    if method == "iqr":
        bounds = percentiles(series, key, (25, 75)).where(F.col("n_values") >= 4)
        spread = (F.col("percentile_75") - F.col("percentile_25")) * 1.5
        bounds = bounds.select(key, (F.col("percentile_25") - spread).alias("_lo"), (F.col("percentile_75") + spread).alias("_hi"))
    elif method == "zscore":
        stats = series.groupBy(key).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).where(F.col("n") >= 4)
        bounds = stats.select(key, (F.col("m") - F.col("s") * 2.5).alias("_lo"), (F.col("m") + F.col("s") * 2.5).alias("_hi"))
    else:
        return series.limit(0)
    return series.join(bounds, key).where((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi"))).drop("_lo", "_hi")


def outlier_summary(series: DataFrame, key: str, method: str = "iqr") -> DataFrame:
    """Number and share of outliers per series (zero below four values)."""
    n = series.groupBy(key).agg(F.count("value").alias("n_values"))
    found = outliers(series, key, method).groupBy(key).agg(F.count(F.lit(1)).alias("outlier_count"))
    return n.join(found, key, "left").select(
        key, F.coalesce("outlier_count", F.lit(0)).alias("outlier_count"), (F.coalesce("outlier_count", F.lit(0)) / F.col("n_values")).alias("outlier_rate")
    )


def trend_features(series: DataFrame, key: str) -> DataFrame:
    """Slope, volatility, momentum (from four values) and consistency of each series with two values or more.

    ``series`` carries the 0-based ``idx``.
    """
    n, mean, std = F.count("value"), F.avg("value"), F.stddev_pop("value")
    base = series.groupBy(key).agg(
        n.alias("n_values"),
        F.regr_slope("value", "idx").alias("linear_trend"),
        std.alias("volatility"),
        F.when(mean != 0, 1.0 / (1.0 + F.try_divide(std, F.abs(mean)))).alias("consistency"),
    ).where(F.col("n_values") >= 2)
    edges = edge_rows(series.select(key, "idx", "value").withColumn("_no", F.col("idx") + 1), [key], "_no", 2)
    momentum = edges.groupBy(key).agg(
        (F.avg(F.when(F.col("from_end") <= 2, F.col("value"))) - F.avg(F.when(F.col("from_start") <= 2, F.col("value")))).alias("momentum")
    )
    return base.join(momentum, key).withColumn("momentum", F.when(F.col("n_values") >= 4, F.col("momentum")))
