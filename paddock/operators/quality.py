"""Validation of races as issue rows (race_id, severity, field, message) and reports on them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock import values

MIN_DRIVERS, MAX_DRIVERS = 18, 22


def _rule(bad: Column, severity: str, field: Column | str, *message) -> Column:
    text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    where = field if isinstance(field, Column) else F.lit(field)
    return F.when(bad, F.struct(F.lit(severity).alias("severity"), where.alias("field"), text.alias("message")))


def _issues(df: DataFrame, rules: list[Column]) -> DataFrame:
    return df.select("race_id", F.explode(F.array_compact(F.array(*rules))).alias("i")).select("race_id", "i.*")


def _number(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def _outside(c: Column, lo: float, hi: float) -> Column:
    return (c < lo) | (c > hi)


def header_issues(race: DataFrame, as_of: date) -> DataFrame:
    """Required fields, season, round, names, date and weather ranges of a race."""
    w = F.col("weather")
    required = ("season", "round", "circuit_id", "race_name", "race_date", "weather")
    rules = [_rule(F.col(c).isNull(), "error", c, f"Missing required field: {c}") for c in required]
    rules += [
        _rule(_outside(F.col("season"), 1950, as_of.year + 1), "error", "season", "Invalid season: ", F.col("season").cast("string")),
        _rule(_outside(F.col("round"), 1, 30), "warning", "round", "Unusual round number: ", F.col("round").cast("string")),
        _rule(F.length("circuit_id") < 3, "error", "circuit_id", "Invalid circuit_id"),
        _rule(F.length("race_name") < 5, "error", "race_name", "Invalid race_name"),
        _rule(
            (F.col("race_date") < F.lit("1950-01-01").cast("date")) | (F.col("race_date") > F.date_add(F.lit(as_of), 365)),
            "warning", "race_date", "Unusual race date: ", F.date_format("race_date", "yyyy-MM-dd"),
        ),
        _rule(_outside(w["temperature"], -20, 60), "warning", "weather.temperature", "Unusual air temperature: ", _number(w["temperature"])),
        _rule(_outside(w["track_temp"], -20, 80), "warning", "weather.track_temp", "Unusual track temperature: ", _number(w["track_temp"])),
        _rule(_outside(w["humidity"], 0, 100), "error", "weather.humidity", "Invalid humidity: ", _number(w["humidity"])),
        _rule(_outside(w["pressure"], 900, 1100), "warning", "weather.pressure", "Unusual pressure: ", _number(w["pressure"])),
        _rule(_outside(w["wind_speed"], 0, 100), "warning", "weather.wind_speed", "Unusual wind speed: ", _number(w["wind_speed"])),
        _rule(_outside(w["wind_direction"], 0, 360), "error", "weather.wind_direction", "Invalid wind direction: ", w["wind_direction"].cast("string")),
    ]
    return _issues(race, rules)


def result_row_issues(results: DataFrame) -> DataFrame:
    """Range rules on single results."""
    at = lambda name: F.concat(F.lit("results["), F.col("result_idx").cast("string"), F.lit(f"].{name}"))
    text = lambda c: F.col(c).cast("string")
    place = F.col("final_position")
    return _issues(
        results,
        [
            _rule(F.col("driver_id").isNull() | (F.length("driver_id") < 3), "error", at("driver_id"), "Invalid driver_id: ", text("driver_id")),
            _rule(F.col("constructor_id").isNull() | (F.length("constructor_id") < 3), "error", at("constructor_id"), "Invalid constructor_id: ", text("constructor_id")),
            _rule(_outside(F.col("grid_position"), 1, 30), "warning", at("grid_position"), "Unusual grid position: ", text("grid_position")),
            _rule(_outside(place, 1, 30) & (place != values.NOT_CLASSIFIED), "warning", at("final_position"), "Unusual final position: ", text("final_position")),
            _rule(_outside(F.col("points"), 0, 30), "warning", at("points"), "Unusual points: ", _number(F.col("points"))),
            _rule(_outside(F.col("laps_completed"), 0, 100), "warning", at("laps_completed"), "Unusual laps completed: ", text("laps_completed")),
        ],
    )


def qualifying_row_issues(qualifying: DataFrame) -> DataFrame:
    """Range rules on single qualifying entries: place and the three session times."""
    at = lambda name: F.concat(F.lit("qualifying["), F.col("driver_id"), F.lit(f"].{name}"))
    rules = [_rule(_outside(F.col("position"), 1, 30), "warning", at("position"), "Unusual qualifying position: ", F.col("position").cast("string"))]
    for q in ("q1", "q2", "q3"):
        seconds = F.col(f"{q}.time_ms") / 1000
        rules.append(_rule(_outside(seconds, 60, 150), "warning", at(f"{q}_time"), f"Unusual {q.upper()} time: ", F.format_string("%.3f", seconds), "s"))
    return _issues(qualifying, rules)


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that occur more than once in a race, one row each."""
    return rows.groupBy("race_id", column).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def _duplicate_counts(rows: DataFrame, column: str, name: str) -> DataFrame:
    return duplicates(rows, column).groupBy("race_id").agg(F.count(F.lit(1)).alias(name))


def race_totals(race: DataFrame, results: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Counts of a race that rules and statistics need; races without results are kept."""
    per_race = results.groupBy("race_id").agg(
        F.count(F.lit(1)).alias("num_drivers"),
        F.sum("points").alias("points_awarded"),
        F.avg(F.when(F.col("finished"), 1.0).otherwise(0.0)).alias("finish_rate"),
        F.max("laps_completed").alias("max_laps"),
    )
    per_qualifying = qualifying.groupBy("race_id").agg(F.count(F.lit(1)).alias("num_qualifying"))
    w, default = F.col("weather"), values.DEFAULT_WEATHER
    out = (
        race.join(per_race, "race_id", "left")
        .join(per_qualifying, "race_id", "left")
        .join(_duplicate_counts(results, "driver_id", "duplicate_drivers"), "race_id", "left")
        .join(_duplicate_counts(results.where("finished"), "final_position", "duplicate_positions"), "race_id", "left")
        .join(_duplicate_counts(qualifying, "driver_id", "duplicate_q_drivers"), "race_id", "left")
        .join(_duplicate_counts(qualifying, "position", "duplicate_q_positions"), "race_id", "left")
    )
    zero = ["num_drivers", "num_qualifying", "duplicate_drivers", "duplicate_positions", "duplicate_q_drivers", "duplicate_q_positions", "max_laps"]
    return out.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in zero}
        | {c: F.coalesce(c, F.lit(0.0)) for c in ("points_awarded", "finish_rate")}
        | {
            "weather_enhanced": (w["temperature"] != default["temperature"])
            | (w["humidity"] != default["humidity"])
            | (w["pressure"] != default["pressure"])
        }
    )


def total_issues(totals: DataFrame) -> DataFrame:
    """Field size, duplicates and statistical patterns."""
    n, points, laps = F.col("num_drivers"), F.col("points_awarded"), F.col("max_laps")
    some = n > 0
    text = lambda c: c.cast("string")
    dup = lambda c, field, label: _rule(F.col(c) > 0, "error", field, f"{label}: ", text(F.col(c)))
    return _issues(
        totals,
        [
            _rule(n == 0, "error", "results", "No race results found"),
            _rule(some & (n < MIN_DRIVERS), "error", "results", "Too few drivers: ", text(n), f" (minimum: {MIN_DRIVERS})"),
            _rule(n > MAX_DRIVERS, "warning", "results", "Too many drivers: ", text(n), f" (maximum: {MAX_DRIVERS})"),
            dup("duplicate_drivers", "results", "Duplicate drivers found"),
            dup("duplicate_positions", "results", "Duplicate finishing positions"),
            _rule(F.col("num_qualifying") == 0, "warning", "qualifying", "No qualifying results found"),
            dup("duplicate_q_drivers", "qualifying", "Duplicate drivers in qualifying"),
            dup("duplicate_q_positions", "qualifying", "Duplicate qualifying positions"),
            _rule(some & (points == 0), "warning", "statistics", "No points awarded in race"),
            _rule(points > 200, "warning", "statistics", "Unusually high total points: ", _number(points)),
            _rule(some & (F.col("finish_rate") < 0.5), "warning", "statistics", "Low finish rate: ", F.format_string("%.1f%%", F.col("finish_rate") * 100 + 1e-9)),
            _rule(some & (laps < 30), "warning", "statistics", "Unusually short race: ", text(laps), " laps"),
            _rule(laps > 100, "warning", "statistics", "Unusually long race: ", text(laps), " laps"),
        ],
    )


def entry_differences(results: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Drivers present on one side only and constructor mismatches, from one full join."""
    r = results.groupBy("race_id", "driver_id").agg(F.max("constructor_id").alias("race_team"))
    q = qualifying.select("race_id", "driver_id", F.col("constructor_id").alias("q_team"))
    kind = (
        F.when(F.col("q_team").isNull(), "not_in_qualifying")
        .when(F.col("race_team").isNull(), "not_in_results")
        .when(F.col("q_team") != F.col("race_team"), "constructor_mismatch")
    )
    return r.join(q, ["race_id", "driver_id"], "full_outer").withColumn("kind", kind).where(F.col("kind").isNotNull())


def consistency_issues(differences: DataFrame) -> DataFrame:
    """One warning per race and missing side, one error per constructor mismatch."""
    sides = {"not_in_qualifying": "Drivers in results but not in qualifying: ", "not_in_results": "Drivers in qualifying but not in results: "}
    label = F.when(F.col("kind") == "not_in_qualifying", sides["not_in_qualifying"]).otherwise(sides["not_in_results"])
    missing = (
        differences.where(F.col("kind").isin(*sides))
        .groupBy("race_id", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("race_id", F.lit("warning").alias("severity"), F.lit("consistency").alias("field"), F.concat(label, F.col("n").cast("string")).alias("message"))
    )
    mismatch = differences.where(F.col("kind") == "constructor_mismatch").select(
        "race_id", F.lit("error").alias("severity"), F.lit("consistency").alias("field"),
        F.concat(F.lit("Constructor mismatch for "), "driver_id", F.lit(": qualifying="), "q_team", F.lit(", race="), "race_team").alias("message"),
    )
    return missing.unionByName(mismatch)


def issues(race: DataFrame, results: DataFrame, qualifying: DataFrame, as_of: date) -> DataFrame:
    """All issues of all races."""
    return (
        header_issues(race, as_of)
        .unionByName(total_issues(race_totals(race, results, qualifying)))
        .unionByName(result_row_issues(results))
        .unionByName(qualifying_row_issues(qualifying))
        .unionByName(consistency_issues(entry_differences(results, qualifying)))
    )


def summary(race: DataFrame, found: DataFrame) -> DataFrame:
    """Error and warning counts per race; a race is valid without errors."""
    counts = found.groupBy("race_id").agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.count_if(F.col("severity") == "info").alias("info_count"),
    )
    names = ("error_count", "warning_count", "info_count")
    return (
        race.join(counts, "race_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
        .withColumn("is_valid", F.col("error_count") == 0)
    )


def season_report(per_race: DataFrame) -> DataFrame:
    """Races, valid races, races with warnings and totals per season, and over all (season NULL)."""
    return per_race.rollup("season").agg(
        F.count(F.lit(1)).alias("races"),
        F.count_if("is_valid").alias("valid_races"),
        F.count_if(F.col("warning_count") > 0).alias("races_with_warnings"),
        F.sum("error_count").alias("total_errors"),
        F.sum("warning_count").alias("total_warnings"),
        F.sum("field_size").alias("total_drivers"),
    )


def common_issues(found: DataFrame) -> DataFrame:
    """How often each message occurs."""
    return found.groupBy("severity", "message").agg(F.count(F.lit(1)).alias("occurrences"))


def acceptance(totals: DataFrame) -> DataFrame:
    """Whether a race may be stored: results without duplicates, and weather inside physical ranges."""
    w = F.col("weather")
    usable = (F.col("num_drivers") > 0) & (F.col("duplicate_drivers") == 0) & (F.col("duplicate_positions") == 0)
    weather = w["temperature"].between(-50, 60) & w["track_temp"].between(-50, 80) & w["humidity"].between(0, 100)
    return totals.select("race_id", usable.alias("results_valid"), (usable & weather).alias("race_valid"))
