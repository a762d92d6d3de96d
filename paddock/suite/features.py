"""Queries on careers, races, tracks, and head-to-head comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock import values
from paddock.operators import careers, head_to_head, races, tracks
from paddock.suite.base import Query, on_tables

_LADDER = "CASE " + " ".join(f"WHEN points_total >= {p} THEN {k}" for p, k in values.LADDER) + " ELSE least(20, greatest(11, CAST(trunc(21 - points_total) AS INT))) END"

_CAREER_SQL = f"""WITH f AS (SELECT driver_id, final_position, row_number() OVER (PARTITION BY driver_id ORDER BY start_no) AS a,
      row_number() OVER (PARTITION BY driver_id ORDER BY start_no DESC) AS z, count(*) OVER (PARTITION BY driver_id) AS n FROM race_result WHERE finished),
    trend AS (SELECT driver_id, CASE WHEN max(n) >= 3 THEN avg(final_position) FILTER (WHERE a <= 3) - avg(final_position) FILTER (WHERE z <= 3) ELSE 0 END AS t FROM f GROUP BY 1),
    base AS (SELECT driver_id, count(*) AS starts, coalesce(avg(final_position) FILTER (WHERE finished), 20) AS avg_finish_position,
      coalesce(quantile_cont(final_position, 0.5) FILTER (WHERE finished), 20) AS median_finish_position,
      coalesce(min(final_position) FILTER (WHERE finished), 20) AS best_finish, coalesce(max(final_position) FILTER (WHERE finished), 20) AS worst_finish,
      coalesce(stddev_pop(final_position) FILTER (WHERE finished), 0) AS finish_consistency, avg(grid_position) AS avg_grid_position,
      stddev_pop(grid_position) AS grid_consistency, sum(points) AS points_total, avg(points) AS points_per_race, stddev_pop(points) AS points_consistency,
      count(*) FILTER (WHERE finished) / count(*) AS finish_rate, count(*) FILTER (WHERE final_position <= 3) / count(*) AS podium_rate,
      count(*) FILTER (WHERE final_position = 1) / count(*) AS win_rate, 1 - count(*) FILTER (WHERE finished) / count(*) AS dnf_rate
      FROM race_result GROUP BY driver_id)
    SELECT base.*, coalesce(t, 0) AS performance_trend, {_LADDER} AS championship_position FROM base LEFT JOIN trend USING (driver_id)"""

_SCORE = "CASE WHEN finished THEN greatest((21 - final_position) / 20, 0) * 0.7 + least(points / 25, 1) * 0.3 ELSE 0.1 END"
_BASE_SQL = f"""WITH tail AS (SELECT driver_id, {_SCORE} AS score, row_number() OVER (PARTITION BY driver_id ORDER BY start_no DESC) AS z,
      count(*) OVER (PARTITION BY driver_id) AS n FROM race_result),
    form AS (SELECT driver_id, sum(score * w) / sum(w) AS recent_form FROM (SELECT *, 0.5 + 0.5 * (least(n, 5) - z) / greatest(least(n, 5) - 1, 1) AS w FROM tail WHERE z <= 5) GROUP BY 1),
    seat AS (SELECT driver_id, max_by(constructor_id, start_no) AS constructor_id, count(*) AS track_experience, sum(points) AS points_total FROM race_result GROUP BY 1),
    car AS (SELECT driver_id, avg(CASE WHEN finished THEN greatest((21 - final_position) / 20, 0) ELSE 0.1 END) AS constructor_performance
      FROM race_result JOIN seat USING (driver_id, constructor_id) GROUP BY 1),
    quali AS (SELECT driver_id, coalesce(greatest(-1, least(1, (10.5 - avg(position) FILTER (WHERE position <> 0)) / 10)), 0) AS qualifying_delta FROM qualifying_result GROUP BY 1)
    SELECT *, 0.5 AS weather_performance, {_LADDER} AS championship_position FROM (
      SELECT driver_id, constructor_id, track_experience, points_total, recent_form, constructor_performance, coalesce(qualifying_delta, 0) AS qualifying_delta
      FROM seat JOIN form USING (driver_id) JOIN car USING (driver_id) LEFT JOIN quali USING (driver_id))"""

_OPTIMAL = "greatest(1 - (CASE WHEN temperature < 20 THEN 20 - temperature WHEN temperature > 30 THEN temperature - 30 ELSE 0 END) / 20, 0)"
_BASIC = """race_id, temperature, humidity, pressure, wind_speed, wind_direction, track_temp, CAST(rainfall AS INT) AS rainfall,
      track_temp - temperature AS temp_track_diff"""
_WEATHER_SQL = f"""SELECT {_BASIC}, {_OPTIMAL} AS temp_optimal, CAST(humidity > 70 AS INT) AS humidity_high, CAST(wind_speed > 15 AS INT) AS wind_strong,
      CASE WHEN pressure BETWEEN 1000 AND 1020 THEN 1 ELSE greatest(1 - least(abs(pressure - 1000), abs(pressure - 1020)) / 50, 0) END AS pressure_normal,
      CAST(NOT rainfall AS INT) AS weather_dry, CAST(rainfall AS INT) AS weather_wet,
      (1 - {_OPTIMAL} + abs(humidity - 50) / 50 + least(wind_speed / 30, 1) + CAST(rainfall AS INT)) / (3 + CAST(rainfall AS INT)) AS weather_extreme FROM race"""
_BASIC_COLUMNS = "temperature:d humidity:d pressure:d wind_speed:d wind_direction:b track_temp:d rainfall:d temp_track_diff:d"
_META = """race_id, season, round, circuit_id, strftime(race_date, '%Y-%m-%d') AS race_date, dayofyear(race_date) AS day_of_year, month(race_date) AS month,
      isodow(race_date) >= 6 AS is_weekend"""
_META_COLUMNS = "race_id:s season:b round:b circuit_id:s race_date:s day_of_year:b month:b is_weekend:l"
_GRID = """SELECT race_id, max(position) - min(position) AS grid_spread, avg(position) AS avg_grid_position, stddev_pop(position) AS grid_competitiveness
      FROM qualifying_result GROUP BY race_id"""
_TRACK_CASE = {
    c: "CASE circuit_id " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in values.TRACKS.items()) + f" ELSE {values.DEFAULT_TRACK[i]} END"
    for i, c in enumerate(values.TRACK_COLUMNS)
}
_DRIVER_TRACK = """count(*) AS races_at_track, coalesce(avg(final_position) FILTER (WHERE finished), 20) AS avg_position,
      coalesce(min(final_position) FILTER (WHERE finished), 20) AS best_position, avg(points) AS avg_points, sum(points) AS total_points,
      count(*) FILTER (WHERE finished) / count(*) AS finish_rate, count(*) FILTER (WHERE final_position <= 3) / count(*) AS podium_rate,
      count(*) FILTER (WHERE points > 0) / count(*) AS points_rate FROM race_result"""
_DRIVER_TRACK_COLUMNS = "races_at_track:b avg_position:d best_position:b avg_points:d total_points:d finish_rate:d podium_rate:d points_rate:d"
_TEAM_TRACK = """count(*) AS races_at_track, avg(total_points) AS avg_points_per_race, sum(total_points) AS total_points,
      avg(coalesce(best_finish, 20)) AS avg_best_position, min(coalesce(best_finish, 20)) AS best_ever_position,
      sum(drivers_finished) / sum(total_drivers) AS reliability_rate, count(*) FILTER (WHERE best_finish <= 3) / count(*) AS podium_rate FROM constructor_race"""
_TEAM_TRACK_COLUMNS = "races_at_track:b avg_points_per_race:d total_points:d avg_best_position:d best_ever_position:b reliability_rate:d podium_rate:d"
_PAIRS = """e AS (SELECT race_id AS target_id, race_date AS target_date, driver_id, result_idx FROM race_result WHERE result_idx < 10),
    pairs AS (SELECT a.target_id, a.target_date, a.driver_id AS d1, b.driver_id AS d2 FROM e a JOIN e b ON a.target_id = b.target_id AND a.result_idx < b.result_idx)"""
_BOTH = """x.race_id, x.race_date, x.points AS points1, y.points AS points2, x.finished AND y.finished AS bothf,
        x.finished AND y.finished AND x.final_position < y.final_position AS win1, x.finished AND y.finished AND y.final_position < x.final_position AS win2"""
_COMMON = f"""{_PAIRS}, common AS (SELECT p.target_id, p.d1, p.d2, {_BOTH}
      FROM pairs p JOIN race_result x ON x.driver_id = p.d1 AND x.race_date < p.target_date JOIN race_result y ON y.driver_id = p.d2 AND y.race_id = x.race_id)"""
_SERIES = f"""{_PAIRS}, common AS (SELECT p.d1, p.d2, {_BOTH} FROM (SELECT DISTINCT least(d1, d2) AS d1, greatest(d1, d2) AS d2 FROM pairs) p
      JOIN race_result x ON x.driver_id = p.d1 JOIN race_result y ON y.driver_id = p.d2 AND y.race_id = x.race_id)"""
_OVERALL = """SELECT target_id, d1, d2, count(*) AS total_races, count(*) FILTER (WHERE bothf) AS races_both_finished, count(*) FILTER (WHERE win1) AS driver1_wins,
      count(*) FILTER (WHERE win2) AS driver2_wins, coalesce(count(*) FILTER (WHERE win1) * 100 / nullif(count(*) FILTER (WHERE bothf), 0), 0) AS driver1_win_percentage,
      coalesce(count(*) FILTER (WHERE win2) * 100 / nullif(count(*) FILTER (WHERE bothf), 0), 0) AS driver2_win_percentage,
      sum(points1) AS total_points_driver1, sum(points2) AS total_points_driver2, sum(points1 - points2) AS points_advantage_driver1
    FROM common GROUP BY ALL HAVING count(*) >= 2"""


def _overall(t):
    return head_to_head.overall(head_to_head.key_pairs(t.race_result, 10), t.race_result, first=10)


def _suitability(t):
    per_driver = careers.career(t.race_result).select("driver_id", "finish_rate", "win_rate", "podium_rate")
    rows = tracks.driver_track_stats(t.race_result).select("driver_id", "circuit_id", "races_at_track").join(per_driver, "driver_id")
    skill = lambda c, ok: F.when(ok, F.col(c))
    value = tracks.suitability(
        skill("podium_rate", F.col("podium_rate") > 0.12), skill("win_rate", F.col("win_rate") > 0.04), skill("finish_rate", F.col("finish_rate") > 0.7)
    )
    return tracks.with_track(rows, t.race_result.sparkSession).withColumn("suitability", value)


_OVERT, _SENS, _SAFE = (_TRACK_CASE[c] for c in ("overtaking_difficulty", "weather_sensitivity", "safety_car_probability"))

QUERIES = {
    "driver_career": Query(
        on_tables(lambda t: careers.career(t.race_result)),
        _CAREER_SQL,
        "driver_id:s starts:b avg_finish_position:d median_finish_position:d best_finish:b worst_finish:b finish_consistency:d avg_grid_position:d "
        "grid_consistency:d points_total:d points_per_race:d points_consistency:d finish_rate:d podium_rate:d win_rate:d dnf_rate:d "
        "performance_trend:d championship_position:b",
    ),
    "driver_base_features": Query(
        on_tables(lambda t: careers.base_features(t.race_result, t.qualifying_result)),
        _BASE_SQL,
        "driver_id:s constructor_id:s track_experience:b points_total:d recent_form:d constructor_performance:d qualifying_delta:d "
        "weather_performance:d championship_position:b",
    ),
    "race_metadata": Query(on_tables(lambda t: races.metadata(t.race)), f"SELECT {_META} FROM race", _META_COLUMNS),
    "race_weather_basic": Query(
        on_tables(lambda t: races.basic_weather(t.race)),
        f"SELECT {_BASIC}, CASE WHEN rainfall THEN 'wet' ELSE 'dry' END AS weather_condition FROM race",
        f"race_id:s {_BASIC_COLUMNS} weather_condition:s",
    ),
    "race_weather_advanced": Query(
        on_tables(lambda t: races.advanced_weather(t.race)),
        _WEATHER_SQL,
        f"race_id:s {_BASIC_COLUMNS} temp_optimal:d humidity_high:d wind_strong:d pressure_normal:d weather_dry:d weather_wet:d weather_extreme:d",
    ),
    "race_grid_features": Query(
        on_tables(lambda t: races.grid_features(t.qualifying_result)),
        _GRID,
        "race_id:s grid_spread:b avg_grid_position:d grid_competitiveness:d",
    ),
    "race_bundle": Query(
        on_tables(lambda t: races.bundle(t.race, t.qualifying_result)),
        f"SELECT * FROM (SELECT {_META} FROM race) JOIN (SELECT {_BASIC}, CASE WHEN rainfall THEN 'wet' ELSE 'dry' END AS weather_condition FROM race) USING (race_id) LEFT JOIN ({_GRID}) USING (race_id)",
        f"{_META_COLUMNS} {_BASIC_COLUMNS} weather_condition:s grid_spread:b avg_grid_position:d grid_competitiveness:d",
    ),
    "weather_comparison": Query(
        on_tables(lambda t: races.weather_comparison(t.race)),
        """WITH h AS (SELECT t.race_id, avg(h.temperature) AS t, quantile_cont(h.temperature, 0.5) AS q, avg(h.humidity) AS h, avg(h.wind_speed) AS w
          FROM race t JOIN race h ON h.race_date < t.race_date GROUP BY t.race_id)
        SELECT race_id, temperature - t AS temp_vs_avg, q AS temp_percentile, humidity - h AS humidity_vs_avg, wind_speed - w AS wind_vs_avg
        FROM h JOIN race USING (race_id)""",
        "race_id:s temp_vs_avg:d temp_percentile:d humidity_vs_avg:d wind_vs_avg:d",
    ),
    "field_strength": Query(
        on_tables(lambda t: races.field_strength(t.race, t.race_result)),
        """WITH recent AS (SELECT t.race_id AS target_id, h.race_id FROM race t JOIN race h ON h.race_date < t.race_date
            QUALIFY row_number() OVER (PARTITION BY t.race_id ORDER BY h.race_date DESC, h.race_id DESC) <= 10),
          a AS (SELECT target_id, count(DISTINCT driver_id) AS field_size FROM recent JOIN race_result USING (race_id) GROUP BY 1),
          b AS (SELECT race_id AS target_id, count(DISTINCT constructor_id) AS constructor_diversity FROM race_result GROUP BY 1)
        SELECT target_id AS race_id, field_size, least(field_size, 8) AS championship_contenders, constructor_diversity,
          least(constructor_diversity / 10, 1) AS competitive_balance FROM a JOIN b USING (target_id)""",
        "race_id:s field_size:b championship_contenders:b constructor_diversity:b competitive_balance:d",
    ),
    "feature_importance": Query(
        on_tables(lambda t: races.feature_importance(t.race_result, t.race)),
        """WITH f AS (SELECT final_position AS y, grid_position, points, temperature, humidity, CAST(rainfall AS INT) AS rainfall
            FROM race_result JOIN race USING (race_id) WHERE finished)
        """ + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS importance FROM f" for c in ("grid_position", "points", "temperature", "humidity", "rainfall")),
        "feature:s importance:d",
    ),
    "race_track_features": Query(
        on_tables(lambda t: tracks.with_track(t.race.select("race_id", "circuit_id"), t.race.sparkSession)),
        "SELECT race_id, circuit_id, " + ", ".join(f"{e} AS {c}" for c, e in _TRACK_CASE.items()) + " FROM race",
        "race_id:s circuit_id:s " + " ".join(f"{c}:d" for c in values.TRACK_COLUMNS),
    ),
    "track_suitability": Query(
        on_tables(_suitability),
        f"""WITH d AS (SELECT driver_id, count(*) FILTER (WHERE final_position <= 3) / count(*) AS o, count(*) FILTER (WHERE final_position = 1) / count(*) AS w,
            count(*) FILTER (WHERE finished) / count(*) AS c FROM race_result GROUP BY 1),
          f AS (SELECT DISTINCT driver_id, circuit_id, CASE WHEN o > 0.12 THEN 1 - {_OVERT} * (1 - o) END AS f1, CASE WHEN w > 0.04 THEN 1 - {_SENS} * (1 - w) END AS f2,
            CASE WHEN c > 0.7 THEN 1 - {_SAFE} * (1 - c) END AS f3 FROM race_result JOIN d USING (driver_id))
        SELECT driver_id, circuit_id, coalesce(list_avg(list_filter([f1, f2, f3], lambda x: x IS NOT NULL)), 0.5) AS suitability FROM f""",
        "driver_id:s circuit_id:s suitability:d",
    ),
    "driver_track_stats": Query(
        on_tables(lambda t: tracks.driver_track_stats(t.race_result)),
        f"SELECT driver_id, circuit_id, {_DRIVER_TRACK} GROUP BY ALL",
        f"driver_id:s circuit_id:s {_DRIVER_TRACK_COLUMNS}",
    ),
    "driver_track_stats_at_monaco": Query(
        on_tables(lambda t: tracks.track_form("driver", t.race_result, t.constructor_race, "monaco")),
        f"SELECT driver_id, circuit_id, {_DRIVER_TRACK} WHERE circuit_id = 'monaco' GROUP BY ALL",
        f"driver_id:s circuit_id:s {_DRIVER_TRACK_COLUMNS}",
    ),
    "driver_stats_all_tracks": Query(
        on_tables(lambda t: tracks.track_form("driver", t.race_result, t.constructor_race)),
        f"SELECT driver_id, {_DRIVER_TRACK} GROUP BY ALL",
        f"driver_id:s {_DRIVER_TRACK_COLUMNS}",
    ),
    "constructor_track_stats": Query(
        on_tables(lambda t: tracks.constructor_track_stats(t.constructor_race)),
        f"SELECT constructor_id, circuit_id, {_TEAM_TRACK} GROUP BY ALL",
        f"constructor_id:s circuit_id:s {_TEAM_TRACK_COLUMNS}",
    ),
    "constructor_stats_all_tracks": Query(
        on_tables(lambda t: tracks.track_form("constructor", t.race_result, t.constructor_race)),
        f"SELECT constructor_id, {_TEAM_TRACK} GROUP BY ALL",
        f"constructor_id:s {_TEAM_TRACK_COLUMNS}",
    ),
    "constructor_race_totals": Query(
        on_tables(lambda t: t.constructor_race.withColumn("best_position", F.coalesce("best_finish", F.lit(values.NOT_CLASSIFIED)))),
        "SELECT *, coalesce(best_finish, 999) AS best_position FROM constructor_race",
        "constructor_id:s race_id:s total_points:d best_position:b drivers_finished:b total_drivers:b race_no:b prior_races:b",
    ),
    "head_to_head_overall": Query(
        on_tables(_overall),
        f"WITH {_COMMON} {_OVERALL}",
        "target_id:s d1:s d2:s total_races:b races_both_finished:b driver1_wins:b driver2_wins:b driver1_win_percentage:d driver2_win_percentage:d "
        "total_points_driver1:d total_points_driver2:d points_advantage_driver1:d",
    ),
    "head_to_head_rolling": Query(
        on_tables(lambda t: head_to_head.rolling(head_to_head.key_pairs(t.race_result, 10), t.race_result, first=10)),
        f"""WITH {_SERIES} SELECT * FROM (SELECT d1, d2, race_id, count(*) OVER w AS window_size, count(*) FILTER (WHERE bothf) OVER w AS races_both_finished,
          count(*) FILTER (WHERE win1) OVER w AS driver1_wins, count(*) FILTER (WHERE win2) OVER w AS driver2_wins,
          coalesce(count(*) FILTER (WHERE win1) OVER w / nullif(count(*) FILTER (WHERE bothf) OVER w, 0), 0) AS driver1_win_rate,
          coalesce(count(*) FILTER (WHERE win2) OVER w / nullif(count(*) FILTER (WHERE bothf) OVER w, 0), 0) AS driver2_win_rate,
          sum(points1) OVER w AS driver1_points_total, sum(points2) OVER w AS driver2_points_total, avg(points1) OVER w AS driver1_avg_points,
          avg(points2) OVER w AS driver2_avg_points, sum(points1 - points2) OVER w AS points_advantage_driver1
          FROM common WINDOW w AS (PARTITION BY d1, d2 ORDER BY race_date, race_id ROWS 4 PRECEDING)) WHERE window_size >= 2""",
        "d1:s d2:s race_id:s window_size:b races_both_finished:b driver1_wins:b driver2_wins:b driver1_win_rate:d driver2_win_rate:d "
        "driver1_points_total:d driver2_points_total:d driver1_avg_points:d driver2_avg_points:d points_advantage_driver1:d",
    ),
    "comparative_features": Query(
        on_tables(lambda t: head_to_head.comparative_features(_overall(t))),
        f"""WITH {_COMMON}, o AS ({_OVERALL})
        SELECT target_id, d1 || '_vs_' || d2 || '_total_races' AS feature, total_races::DOUBLE AS value FROM o
        UNION ALL SELECT target_id, d1 || '_vs_' || d2 || '_driver1_win_rate', driver1_win_percentage / 100 FROM o
        UNION ALL SELECT target_id, d1 || '_vs_' || d2 || '_points_advantage', points_advantage_driver1 FROM o""",
        "target_id:s feature:s value:d",
    ),
}
