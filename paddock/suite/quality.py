"""Queries on validation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from paddock.operators import quality
from paddock.suite.base import Query, on_tables

_AS_OF = date(2024, 12, 31)
_HEADER = [
    ("season < 1950 OR season > 2025", "error", "'season'", "'Invalid season: ' || season"),
    ("round < 1 OR round > 30", "warning", "'round'", "'Unusual round number: ' || round"),
    ("length(circuit_id) < 3", "error", "'circuit_id'", "'Invalid circuit_id'"),
    ("length(race_name) < 5", "error", "'race_name'", "'Invalid race_name'"),
    ("race_date < DATE '1950-01-01' OR race_date > DATE '2025-12-31'", "warning", "'race_date'", "'Unusual race date: ' || strftime(race_date, '%Y-%m-%d')"),
    ("temperature < -20 OR temperature > 60", "warning", "'weather.temperature'", "'Unusual air temperature: ' || printf('%.2f', temperature)"),
    ("track_temp < -20 OR track_temp > 80", "warning", "'weather.track_temp'", "'Unusual track temperature: ' || printf('%.2f', track_temp)"),
    ("humidity < 0 OR humidity > 100", "error", "'weather.humidity'", "'Invalid humidity: ' || printf('%.2f', humidity)"),
    ("pressure < 900 OR pressure > 1100", "warning", "'weather.pressure'", "'Unusual pressure: ' || printf('%.2f', pressure)"),
    ("wind_speed < 0 OR wind_speed > 100", "warning", "'weather.wind_speed'", "'Unusual wind speed: ' || printf('%.2f', wind_speed)"),
    ("wind_direction < 0 OR wind_direction > 360", "error", "'weather.wind_direction'", "'Invalid wind direction: ' || wind_direction"),
]
_TOTALS = [
    ("num_drivers = 0", "error", "'results'", "'No race results found'"),
    ("num_drivers BETWEEN 1 AND 17", "error", "'results'", "'Too few drivers: ' || num_drivers || ' (minimum: 18)'"),
    ("num_drivers > 22", "warning", "'results'", "'Too many drivers: ' || num_drivers || ' (maximum: 22)'"),
    ("num_qualifying = 0", "warning", "'qualifying'", "'No qualifying results found'"),
    ("num_drivers > 0 AND points_awarded = 0", "warning", "'statistics'", "'No points awarded in race'"),
    ("points_awarded > 200", "warning", "'statistics'", "'Unusually high total points: ' || printf('%.2f', points_awarded)"),
    ("num_drivers > 0 AND finish_rate < 0.5", "warning", "'statistics'", "'Low finish rate: ' || printf('%.1f%%', finish_rate * 100 + 1e-9)"),
    ("num_drivers > 0 AND max_laps < 30", "warning", "'statistics'", "'Unusually short race: ' || max_laps || ' laps'"),
    ("max_laps > 100", "warning", "'statistics'", "'Unusually long race: ' || max_laps || ' laps'"),
]
_RESULT = [
    ("length(driver_id) < 3", "error", "'results[' || result_idx || '].driver_id'", "'Invalid driver_id: ' || driver_id"),
    ("length(constructor_id) < 3", "error", "'results[' || result_idx || '].constructor_id'", "'Invalid constructor_id: ' || constructor_id"),
    ("grid_position < 1 OR grid_position > 30", "warning", "'results[' || result_idx || '].grid_position'", "'Unusual grid position: ' || grid_position"),
    ("(final_position < 1 OR final_position > 30) AND final_position <> 999", "warning", "'results[' || result_idx || '].final_position'", "'Unusual final position: ' || final_position"),
    ("points < 0 OR points > 30", "warning", "'results[' || result_idx || '].points'", "'Unusual points: ' || printf('%.2f', points)"),
    ("laps_completed < 0 OR laps_completed > 100", "warning", "'results[' || result_idx || '].laps_completed'", "'Unusual laps completed: ' || laps_completed"),
]
_QUALIFYING = [("position < 1 OR position > 30", "warning", "'qualifying[' || driver_id || '].position'", "'Unusual qualifying position: ' || position")] + [
    (f"{q}_ms / 1000 < 60 OR {q}_ms / 1000 > 150", "warning", f"'qualifying[' || driver_id || '].{q}_time'", f"'Unusual {q.upper()} time: ' || printf('%.3f', {q}_ms / 1000) || 's'")
    for q in ("q1", "q2", "q3")
]


def _rules(rules: list[tuple], source: str) -> str:
    return " UNION ALL ".join(f"SELECT race_id, '{s}' AS severity, {f} AS field, {m} AS message FROM {source} WHERE {c}" for c, s, f, m in rules)


_BASE = """totals AS (SELECT race.*, coalesce(num_drivers, 0) AS num_drivers, coalesce(num_qualifying, 0) AS num_qualifying, coalesce(points_awarded, 0) AS points_awarded,
      coalesce(finish_rate, 0) AS finish_rate, coalesce(max_laps, 0) AS max_laps, temperature <> 25 OR humidity <> 60 OR pressure <> 1013.25 AS weather_enhanced
    FROM race LEFT JOIN (SELECT race_id, count(*) AS num_drivers, sum(points) AS points_awarded, count(*) FILTER (WHERE finished) / count(*) AS finish_rate,
      max(laps_completed) AS max_laps FROM race_result GROUP BY 1) USING (race_id)
    LEFT JOIN (SELECT race_id, count(*) AS num_qualifying FROM qualifying_result GROUP BY 1) USING (race_id)),
  diff AS (SELECT * FROM (SELECT race_id, driver_id, r.constructor_id AS race_team, q.constructor_id AS q_team, CASE WHEN q.constructor_id IS NULL THEN 'not_in_qualifying'
      WHEN r.constructor_id IS NULL THEN 'not_in_results' WHEN r.constructor_id <> q.constructor_id THEN 'constructor_mismatch' END AS kind
    FROM race_result r FULL JOIN qualifying_result q USING (race_id, driver_id)) WHERE kind IS NOT NULL)"""
_ISSUES = f"""{_BASE}, issues AS ({_rules(_HEADER, 'race')} UNION ALL {_rules(_TOTALS, 'totals')} UNION ALL {_rules(_RESULT, 'race_result')} UNION ALL {_rules(_QUALIFYING, 'qualifying_result')}
  UNION ALL SELECT race_id, 'warning', 'consistency', CASE kind WHEN 'not_in_qualifying' THEN 'Drivers in results but not in qualifying: ' ELSE 'Drivers in qualifying but not in results: ' END || count(*)
    FROM diff WHERE kind <> 'constructor_mismatch' GROUP BY race_id, kind
  UNION ALL SELECT race_id, 'error', 'consistency', 'Constructor mismatch for ' || driver_id || ': qualifying=' || q_team || ', race=' || race_team FROM diff WHERE kind = 'constructor_mismatch')"""
_PER_RACE = """per_race AS (SELECT race.*, coalesce(e, 0) AS error_count, coalesce(w, 0) AS warning_count, 0 AS info_count, coalesce(e, 0) = 0 AS is_valid
  FROM race LEFT JOIN (SELECT race_id, count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w FROM issues GROUP BY 1) USING (race_id))"""


def _issues(t):
    return quality.issues(t.race, t.race_result, t.qualifying_result, _AS_OF)


_ISSUE_COLUMNS = "race_id:s severity:s field:s message:s"
QUERIES = {
    "validation_issues": Query(on_tables(_issues), f"WITH {_ISSUES} SELECT * FROM issues", _ISSUE_COLUMNS),
    "validation_header_issues": Query(on_tables(lambda t: quality.header_issues(t.race, _AS_OF)), _rules(_HEADER, "race"), _ISSUE_COLUMNS),
    "validation_result_issues": Query(on_tables(lambda t: quality.result_row_issues(t.race_result)), _rules(_RESULT, "race_result"), _ISSUE_COLUMNS),
    "validation_qualifying_issues": Query(on_tables(lambda t: quality.qualifying_row_issues(t.qualifying_result)), _rules(_QUALIFYING, "qualifying_result"), _ISSUE_COLUMNS),
    "validation_statistical_issues": Query(
        on_tables(lambda t: quality.total_issues(quality.race_totals(t.race, t.race_result, t.qualifying_result))),
        f"WITH {_BASE} {_rules(_TOTALS, 'totals')}", _ISSUE_COLUMNS,
    ),
    "validation_entry_differences": Query(
        on_tables(lambda t: quality.entry_differences(t.race_result, t.qualifying_result)),
        f"WITH {_BASE} SELECT * FROM diff", "race_id:s driver_id:s race_team:s q_team:s kind:s",
    ),
    "validation_statistics": Query(
        on_tables(lambda t: quality.race_totals(t.race, t.race_result, t.qualifying_result)),
        f"WITH {_BASE} SELECT * FROM totals", "race_id:s num_drivers:b num_qualifying:b finish_rate:d points_awarded:d max_laps:b weather_enhanced:l",
    ),
    "validation_summary": Query(
        on_tables(lambda t: quality.summary(t.race, _issues(t))),
        f"WITH {_ISSUES}, {_PER_RACE} SELECT * FROM per_race", "race_id:s season:b error_count:b warning_count:b info_count:b is_valid:l",
    ),
    "validation_season_report": Query(
        on_tables(lambda t: quality.season_report(quality.summary(t.race, _issues(t)))),
        f"""WITH {_ISSUES}, {_PER_RACE} SELECT season, count(*) AS races, count(*) FILTER (WHERE is_valid) AS valid_races, count(*) FILTER (WHERE warning_count > 0) AS races_with_warnings,
          sum(error_count) AS total_errors, sum(warning_count) AS total_warnings, sum(field_size) AS total_drivers FROM per_race GROUP BY ROLLUP (season)""",
        "season:b races:b valid_races:b races_with_warnings:b total_errors:b total_warnings:b total_drivers:b",
    ),
    "validation_common_issues": Query(
        on_tables(lambda t: quality.common_issues(_issues(t))),
        f"WITH {_ISSUES} SELECT severity, message, count(*) AS occurrences FROM issues GROUP BY ALL", "severity:s message:s occurrences:b",
    ),
    "validation_acceptance": Query(
        on_tables(lambda t: quality.acceptance(quality.race_totals(t.race, t.race_result, t.qualifying_result))),
        f"""WITH {_BASE} SELECT race_id, num_drivers > 0 AS results_valid, num_drivers > 0 AND temperature BETWEEN -50 AND 60 AND track_temp BETWEEN -50 AND 80
          AND humidity BETWEEN 0 AND 100 AS race_valid FROM totals""",
        "race_id:s results_valid:l race_valid:l",
    ),
    "duplicate_grid_positions": Query(
        on_tables(lambda t: quality.duplicates(t.race_result, "grid_position")),
        "SELECT race_id, grid_position, count(*) AS occurrences FROM race_result GROUP BY ALL HAVING count(*) > 1",
        "race_id:s grid_position:b occurrences:b",
    ),
    "weather_enrichment": Query(
        on_tables(
            lambda t: quality.race_totals(t.race, t.race_result, t.qualifying_result).select("race_id", "weather_enhanced")
            .join(t.qualifying_result.groupBy("race_id").agg(F.bool_or(F.coalesce("q1", "q2", "q3").isNotNull()).alias("any_qualifying_time")), "race_id", "left")
            .join(t.race_result.groupBy("race_id").agg(F.count("fastest_lap").alias("fastest_laps")), "race_id", "left")
        ),
        f"""WITH {_BASE} SELECT race_id, weather_enhanced, any_qualifying_time, fastest_laps FROM totals
          LEFT JOIN (SELECT race_id, bool_or(coalesce(q1_ms, q2_ms, q3_ms) IS NOT NULL) AS any_qualifying_time FROM qualifying_result GROUP BY 1) USING (race_id)
          LEFT JOIN (SELECT race_id, count(fastest_ms) AS fastest_laps FROM race_result GROUP BY 1) USING (race_id)""",
        "race_id:s weather_enhanced:l any_qualifying_time:l fastest_laps:b",
    ),
}
