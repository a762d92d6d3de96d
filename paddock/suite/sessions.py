"""Queries on session laps, taken from the ``events`` table: a user is a driver, a day a weekend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock import values
from paddock.operators import sessions
from paddock.plans import canonical
from paddock.plans.blocks import number_rows
from paddock.suite.base import Query

_KINDS = ("FP1", "FP2", "FP3", "Q", "R")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "event_type", "value", F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("driver_code"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), canonical.pick(_KINDS, hour % 5).alias("session_type"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    ).withColumn("session_id", F.concat_ws("_", "day", "session_type"))


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    rows = number_rows(rows, ["session_id", "driver_code"], [F.col("at"), F.col("event_id")], F.floor(F.col("at") / 60_000_000), "lap_number")
    ms = F.when(F.col("event_type") != "error", (F.col("value") * 1000).cast("long"))
    sector = lambda n: F.when(F.col("event_type") != "click", F.floor(ms * n / 10))
    return rows.select(
        "session_id", "session_type", "day", "driver_code", "lap_number", "at", "event_id", ms.alias("lap_time_ms"), (F.col("event_type") == "purchase").alias("is_personal_best"),
        sector(3).alias("sector1_ms"), sector(4).alias("sector2_ms"), sector(3).alias("sector3_ms"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("driver_code", "at", "event_id", "value")
    return sessions.numbered(rows, "driver_code", [F.col("at"), F.col("event_id")], F.floor(F.col("at") / 3_600_000_000))


def _readings(spark, sf_dir):
    k = F.col("k")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == "view").select("event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    return rows.select(
        F.date_format("ts", "yyyy-MM-dd").alias("session_id"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")), "event_id").alias("ordinal"),
        F.col("value").alias("temperature"), F.when(k % 3 != 0, k.cast("double")).alias("humidity"), (F.lit(950.0) + k).alias("pressure"),
        F.when(k % 4 != 0, k / 2.0).alias("wind_speed"), (k * 3).alias("wind_direction"), (k % 2 == 0).alias("rainfall"), (F.col("value") + 5).alias("track_temp"),
    )


def _weather(spark, sf_dir):
    days = events(spark, sf_dir).select(F.col("day").alias("session_id")).distinct()
    return sessions.last_weather(days, _readings(spark, sf_dir))


def _results(spark, sf_dir):
    return laps(spark, sf_dir).groupBy("session_id", "driver_code").agg(F.count(F.lit(1)).alias("n"), F.min("lap_time_ms").alias("f")).select(
        "session_id", "driver_code", F.when(F.col("n") >= 2, F.col("f") - 500).alias("q2_ms"), F.when(F.col("n") >= 3, F.col("f") - 900).alias("q3_ms")
    )


_EV = f"""ev AS (SELECT event_id, ts, event_type, value, props, 'D' || user_id AS driver_code, strftime(ts, '%Y-%m-%d') AS day,
    ['FP1', 'FP2', 'FP3', 'Q', 'R'][hour(ts) % 5 + 1] AS session_type FROM events),
  laps AS (SELECT *, day || '_' || session_type AS session_id, row_number() OVER (PARTITION BY day, session_type, driver_code ORDER BY ts, event_id) AS lap_number,
    CASE WHEN event_type <> 'error' THEN CAST(trunc(value * 1000) AS BIGINT) END AS lap_time_ms, event_type = 'purchase' AS is_personal_best,
    CASE WHEN event_type NOT IN ('error', 'click') THEN CAST(trunc(value * 1000) AS BIGINT) * 3 // 10 END AS sector1_ms,
    CASE WHEN event_type NOT IN ('error', 'click') THEN CAST(trunc(value * 1000) AS BIGINT) * 4 // 10 END AS sector2_ms FROM ev),
  series AS (SELECT driver_code, value, row_number() OVER (PARTITION BY driver_code ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY driver_code) AS n FROM ev)"""
_IQR = """b AS (SELECT driver_code, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM series GROUP BY 1 HAVING count(*) >= 4),
  out_ AS (SELECT s.driver_code, idx, value FROM series s JOIN b USING (driver_code) WHERE value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5)"""
_W = values.DEFAULT_WEATHER
QUERIES = {
    "session_valid_laps": Query(
        lambda s, d: sessions.valid_laps(laps(s, d)), f"WITH {_EV} SELECT * FROM laps WHERE lap_time_ms IS NOT NULL", "session_id:s driver_code:s lap_number:b lap_time_ms:b"
    ),
    "session_validity": Query(
        lambda s, d: sessions.session_validity(laps(s, d)),
        f"WITH {_EV} SELECT session_id, count(*) AS n_laps, count(DISTINCT driver_code) AS n_drivers, count(DISTINCT driver_code) >= 18 AS is_valid FROM laps GROUP BY 1",
        "session_id:s n_laps:b n_drivers:b is_valid:l",
    ),
    "session_fastest_laps": Query(
        lambda s, d: sessions.fastest_laps(laps(s, d)),
        f"WITH {_EV} SELECT session_id, driver_code, min(lap_time_ms) AS lap_time_ms, arg_min(lap_number, (lap_time_ms, lap_number)) FILTER (WHERE lap_time_ms IS NOT NULL) AS lap_number FROM laps WHERE lap_time_ms IS NOT NULL GROUP BY ALL",
        "session_id:s driver_code:s lap_time_ms:b lap_number:b",
    ),
    "session_telemetry": Query(
        lambda s, d: sessions.telemetry_summary(laps(s, d)),
        f"""WITH {_EV} SELECT session_id, driver_code, count(*) AS total_laps, count(lap_time_ms) AS valid_laps, min(lap_time_ms) AS fastest_ms, avg(lap_time_ms) AS mean_ms, stddev_samp(lap_time_ms) AS std_ms,
          quantile_cont(lap_time_ms, 0.5) AS median_ms, avg(sector1_ms) AS mean_sector1_ms, avg(sector2_ms) AS mean_sector2_ms FROM laps GROUP BY ALL""",
        "session_id:s driver_code:s total_laps:b valid_laps:b fastest_ms:b mean_ms:d std_ms:d median_ms:d mean_sector1_ms:d mean_sector2_ms:d",
    ),
    "session_qualifying_times": Query(
        lambda s, d: sessions.qualifying_times(laps(s, d), _results(s, d)),
        f"""WITH {_EV}, r AS (SELECT session_id, driver_code, CASE WHEN count(*) >= 2 THEN min(lap_time_ms) - 500 END AS q2_ms, CASE WHEN count(*) >= 3 THEN min(lap_time_ms) - 900 END AS q3_ms FROM laps GROUP BY ALL)
        SELECT session_id, driver_code, lower(driver_code) AS driver_id, arg_min(lap_time_ms, lap_number) AS q1_ms, any_value(q2_ms) AS q2_ms, any_value(q3_ms) AS q3_ms
        FROM laps LEFT JOIN r USING (session_id, driver_code) WHERE is_personal_best AND lap_time_ms IS NOT NULL GROUP BY ALL""",
        "session_id:s driver_code:s driver_id:s q1_ms:b q2_ms:b q3_ms:b",
    ),
    "session_weather": Query(
        _weather,
        f"""WITH {_EV}, last AS (SELECT day, arg_max(value, (ts, event_id)) AS value, arg_max(CAST(props::JSON->>'k' AS INT), (ts, event_id)) AS k FROM ev WHERE event_type = 'view' GROUP BY 1)
        SELECT day AS session_id, coalesce(value, {_W['temperature']}) AS temperature, coalesce(CASE WHEN k % 3 <> 0 THEN k END, {_W['humidity']}) AS humidity, coalesce(950 + k, {_W['pressure']}) AS pressure,
          coalesce(CASE WHEN k % 4 <> 0 THEN k / 2 END, {_W['wind_speed']}) AS wind_speed, coalesce(k * 3, {_W['wind_direction']}) AS wind_direction, coalesce(k % 2 = 0, false) AS rainfall,
          coalesce(value + 5, {_W['track_temp']}) AS track_temp FROM (SELECT DISTINCT day FROM ev) LEFT JOIN last USING (day)""",
        "session_id:s temperature:d humidity:d pressure:d wind_speed:d wind_direction:b rainfall:l track_temp:d",
    ),
    "session_summary": Query(
        lambda s, d: sessions.session_summary(laps(s, d)),
        f"WITH {_EV} SELECT session_id, any_value(session_type) AS session_type, count(*) AS total_laps, count(DISTINCT driver_code) AS n_drivers FROM laps GROUP BY 1",
        "session_id:s session_type:s total_laps:b n_drivers:b",
    ),
    "session_drivers": Query(lambda s, d: sessions.session_drivers(laps(s, d)), f"WITH {_EV} SELECT DISTINCT session_id, driver_code FROM laps", "session_id:s driver_code:s"),
    "sessions_available": Query(
        lambda s, d: sessions.available_sessions(laps(s, d)),
        f"WITH {_EV} SELECT day, string_agg(DISTINCT session_type, ',' ORDER BY session_type) AS sessions FROM laps GROUP BY 1", "day:s sessions:s",
    ),
    "source_availability": Query(
        lambda s, d: sessions.source_report(
            canonical.tables(s, d).race.select(F.date_format("race_date", "MM-dd").alias("calendar_day")), events(s, d).select(F.substring("day", 6, 5).alias("calendar_day")), "calendar_day"
        ),
        f"""WITH {_EV}, a AS (SELECT DISTINCT strftime(race_date, '%m-%d') AS calendar_day, true AS x FROM race), b AS (SELECT DISTINCT day[6:10] AS calendar_day, true AS y FROM ev)
        SELECT calendar_day, coalesce(x, false) AS in_results, coalesce(y, false) AS in_sessions FROM a FULL JOIN b USING (calendar_day)""",
        "calendar_day:s in_results:l in_sessions:l",
    ),
    "series_percentiles": Query(
        lambda s, d: sessions.percentiles(series(s, d), "driver_code"),
        f"WITH {_EV} SELECT driver_code, count(*) AS n_values, quantile_cont(value, 0.25) AS percentile_25, quantile_cont(value, 0.5) AS percentile_50, quantile_cont(value, 0.75) AS percentile_75 FROM series GROUP BY 1",
        "driver_code:s n_values:b percentile_25:d percentile_50:d percentile_75:d",
    ),
    "series_outliers": Query(
        lambda s, d: sessions.outliers(series(s, d), "driver_code"), f"WITH {_EV}, {_IQR} SELECT * FROM out_", "driver_code:s idx:b value:d"
    ),
    "series_outlier_summary": Query(
        lambda s, d: sessions.outlier_summary(series(s, d), "driver_code"),
        f"WITH {_EV}, {_IQR} SELECT driver_code, count(o.idx) AS outlier_count, count(o.idx) / count(*) AS outlier_rate FROM series s LEFT JOIN out_ o USING (driver_code, idx) GROUP BY 1",
        "driver_code:s outlier_count:b outlier_rate:d",
    ),
    "series_outliers_zscore": Query(
        lambda s, d: sessions.outliers(series(s, d), "driver_code", "zscore"),
        f"""WITH {_EV}, b AS (SELECT driver_code, avg(value) AS m, stddev_pop(value) AS s FROM series GROUP BY 1 HAVING count(*) >= 4)
        SELECT driver_code, idx, value FROM series JOIN b USING (driver_code) WHERE abs(value - m) / s > 2.5""",
        "driver_code:s idx:b value:d",
    ),
    "series_trends": Query(
        lambda s, d: sessions.trend_features(series(s, d), "driver_code"),
        f"""WITH {_EV} SELECT driver_code, regr_slope(value, idx) AS linear_trend, stddev_pop(value) AS volatility, 1 / (1 + stddev_pop(value) / abs(avg(value))) AS consistency,
          CASE WHEN count(*) >= 4 THEN avg(value) FILTER (WHERE idx >= n - 2) - avg(value) FILTER (WHERE idx < 2) END AS momentum FROM series GROUP BY 1 HAVING count(*) >= 2""",
        "driver_code:s linear_trend:d volatility:d consistency:d momentum:d",
    ),
}
