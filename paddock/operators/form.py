"""Rolling form of drivers and constructors over their own last starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock import values
from paddock.functions import scores
from paddock.plans.blocks import BLOCK, edge_rows, framed, number_rows


def classified_place() -> Column:
    """Finishing place, NULL when not classified."""
    return F.when(F.col("finished"), F.col("final_position"))



def enough(number: str) -> Column:
    """Rows with at least two entries in the window, of entities with at least three."""
    return (F.col(number) >= values.MIN_STARTS) | ((F.col(number) == 2) & (F.col("_ahead") == 2))


def _stats(value: Column, prefix: str, ordinal: str) -> dict:
    """Window statistics of a value; quartiles from four values on, slope from three."""
    n = lambda w: F.count(value).over(w)
    quantile = lambda q: lambda w: F.when(n(w) >= 4, F.percentile(value, q).over(w))
    return {
        f"{prefix}_n": n,
        f"{prefix}_mean": lambda w: F.avg(value).over(w),
        f"{prefix}_median": lambda w: F.percentile(value, 0.5).over(w),
        f"{prefix}_std": lambda w: F.stddev_pop(value).over(w),
        f"{prefix}_min": lambda w: F.min(value).over(w),
        f"{prefix}_max": lambda w: F.max(value).over(w),
        f"{prefix}_q25": quantile(0.25),
        f"{prefix}_q75": quantile(0.75),
        f"{prefix}_trend": lambda w: F.when(n(w) >= 3, F.regr_slope(value, F.col(ordinal)).over(w)),
    }


def _windowed(results: DataFrame, columns: dict, window: int, block: int, extra: dict | None = None) -> DataFrame:
    frames = {
        (None, 0): {"_finish_ord": lambda w: F.count(classified_place()).over(w), **(extra or {})},
        (0, 1): {"_ahead": lambda w: F.count(F.lit(1)).over(w)},
        (1 - window, 0): {"window_size": lambda w: F.count(F.lit(1)).over(w), **columns},
    }
    return framed(results, ["driver_id"], "start_no", frames, block)


def position_stats(results: DataFrame, window: int = values.FORM_WINDOW, block: int = BLOCK) -> DataFrame:
    """Finishing-place statistics of the last ``window`` starts, where one of them was classified."""
    out = _windowed(results, _stats(classified_place(), "position", "_finish_ord"), window, block)
    return (
        out.where(enough("start_no") & (F.col("position_n") > 0))
        .withColumn("position_range", F.col("position_max") - F.col("position_min"))
        .withColumn("position_iqr", F.col("position_q75") - F.col("position_q25"))
        .withColumn("finish_rate", F.col("position_n") / F.col("window_size"))
    )


def points_stats(results: DataFrame, window: int = values.FORM_WINDOW, block: int = BLOCK) -> DataFrame:
    """Points statistics of the last ``window`` starts."""
    points = F.col("points")
    columns = _stats(points, "points", "start_no") | {"total_points": lambda w: F.sum(points).over(w)}
    out = _windowed(results, columns, window, block)
    return (
        out.where(enough("start_no"))
        .withColumn("points_range", F.col("points_max") - F.col("points_min"))
        .withColumn("points_iqr", F.col("points_q75") - F.col("points_q25"))
    )


def consistency(results: DataFrame, window: int = values.FORM_WINDOW, block: int = BLOCK) -> DataFrame:
    """Place consistency, share of classified finishes and variation of points (infinite without points)."""
    points = F.col("points")
    columns = {
        "_n": lambda w: F.count(classified_place()).over(w),
        "_std": lambda w: F.stddev_pop(classified_place()).over(w),
        "_mean": lambda w: F.avg(points).over(w),
        "_points_std": lambda w: F.stddev_pop(points).over(w),
    }
    out = _windowed(results, columns, window, block).where(enough("start_no") & (F.col("_n") > 0))
    return out.withColumns(
        {
            "position_consistency": 1.0 / (1.0 + F.col("_std")),
            "finish_consistency": F.col("_n") / F.col("window_size"),
            "points_cv": F.when(F.col("_mean") > 0, F.try_divide("_points_std", "_mean")).otherwise(
                F.lit(float("inf"))
            ),
        }
    ).drop("_n", "_std", "_mean", "_points_std")


def trends(results: DataFrame, window: int = values.FORM_WINDOW, block: int = BLOCK) -> DataFrame:
    """Slopes and momentum of places (positive is better) and points, from three starts on."""
    points = F.col("points")
    columns = {
        "_slope": lambda w: F.regr_slope(classified_place(), F.col("_finish_ord")).over(w),
        "points_trend": lambda w: F.regr_slope(points, F.col("start_no")).over(w),
        "_places": lambda w: F.collect_list(classified_place()).over(w),
        "_points": lambda w: F.collect_list(points).over(w),
    }
    out = _windowed(results, columns, window, block).where(F.col("window_size") >= 3)
    early, recent = scores.edge_means(F.col("_places"))
    early_points, recent_points = scores.edge_means(F.col("_points"))
    usable = F.size("_places") >= 3
    return out.withColumns(
        {
            "position_trend": F.when(usable, -F.col("_slope")),
            "position_momentum": F.when(usable, early - recent),
            "points_momentum": recent_points - early_points,
        }
    ).drop("_slope", "_places", "_points")


def constructor_form(teams: DataFrame, window: int = values.FORM_WINDOW, block: int = BLOCK) -> DataFrame:
    """Rolling performance, reliability and competitiveness of constructors over their last races.

    ``teams`` has one row per (race, constructor), numbered by ``race_no``.
    """
    best, total = F.col("best_finish"), F.col("total_points")
    columns = {
        "window_size": lambda w: F.count(F.lit(1)).over(w),
        "avg_points_per_race": lambda w: F.avg(total).over(w),
        "window_points": lambda w: F.sum(total).over(w),
        "points_consistency": lambda w: F.stddev_pop(total).over(w),
        "avg_best_position": lambda w: F.avg(best).over(w),
        "podium_races": lambda w: F.count_if(best <= 3).over(w),
        "points_scoring_races": lambda w: F.count_if(total > 0).over(w),
        "_cars": lambda w: F.sum("total_drivers").over(w),
        "_finishes": lambda w: F.sum("drivers_finished").over(w),
        "all_cars_finished": lambda w: F.count_if(F.col("drivers_finished") == F.col("total_drivers")).over(w),
        "no_car_finished": lambda w: F.count_if(F.col("drivers_finished") == 0).over(w),
        "points_trend": lambda w: F.when(
            F.count(F.lit(1)).over(w) >= 3, F.regr_slope(total, F.col("race_no")).over(w)
        ).otherwise(0.0),
        "top5_rate": lambda w: F.avg(F.when(best <= 5, 1.0).when(best.isNotNull(), 0.0)).over(w),
        "podium_rate": lambda w: F.avg(F.when(best <= 3, 1.0).when(best.isNotNull(), 0.0)).over(w),
    }
    frames = {(0, 1): {"_ahead": lambda w: F.count(F.lit(1)).over(w)}, (1 - window, 0): columns}
    out = framed(teams, ["constructor_id"], "race_no", frames, block).where(enough("race_no"))
    return out.withColumns(
        {
            "best_avg_position": F.coalesce("avg_best_position", F.lit(20.0)),
            "reliability_rate": F.coalesce(F.try_divide(F.col("_finishes"), F.col("_cars")), F.lit(0.0)),
            "avg_finishers_per_race": F.col("_finishes") / F.col("window_size"),
        }
    )


def latest(stats: DataFrame, columns: list[str], key: str = "driver_id", number: str = "start_no") -> DataFrame:
    """Per entity, the given columns of its last row in ``stats``."""
    return stats.groupBy(key).agg(F.max_by(F.struct(number, *columns), number).alias("_last")).select(key, "_last.*")


def number_races(race: DataFrame) -> DataFrame:
    """Dense calendar number of races over all seasons (ties by id); one piece per calendar day."""
    day = F.datediff("race_date", F.lit("1970-01-01").cast("date"))
    return number_rows(race, [], [F.col("race_date"), F.col("race_id")], day, "race_seq")


def calendar_form(results: DataFrame, race: DataFrame, window: int = values.FORM_WINDOW) -> DataFrame:
    """Form over the last ``window`` calendar races; a driver appears while one start is inside."""
    starts, ends = _calendar(results, race, window)
    score = scores.race_score(F.col("final_position"), F.col("points"), F.col("finished"))
    return (
        starts.withColumn("score", score)
        .groupBy("driver_id", "at")
        .agg(F.array_sort(F.collect_list(F.struct("race_seq", "score"))).alias("_starts"))
        .select(
            "driver_id",
            F.col("at").alias("race_seq"),
            scores.weighted_form(F.col("_starts.score")).alias("form"),
            F.size("_starts").alias("races_in_window"),
        )
        .join(ends, "race_seq")
    )


def calendar_constructor_score(results: DataFrame, race: DataFrame, window: int = values.FORM_WINDOW) -> DataFrame:
    """Mean place score of a constructor over the last ``window`` calendar races, 0.1 without finisher."""
    teams = results.groupBy("race_id", "constructor_id").agg(
        F.sum(classified_place()).alias("places"), F.count(classified_place()).alias("finishes"), F.count(F.lit(1)).alias("cars")
    )
    starts, ends = _calendar(teams, race, window)
    mean = F.try_divide(F.sum("places"), F.sum("finishes"))
    return (
        starts.groupBy("constructor_id", F.col("at").alias("race_seq"))
        .agg(
            F.coalesce(scores.position_score(mean) + mean * 0, F.lit(0.1)).alias("performance"),
            F.sum("cars").alias("results_count"),
        )
        .join(ends, "race_seq")
    )


def _calendar(rows: DataFrame, race: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    numbered = number_races(race.select("race_id", "race_date"))
    ends = numbered.select("race_seq", F.col("race_id").alias("at_race_id"), F.col("race_date").alias("at_date"))
    spread = F.explode(F.sequence(F.col("race_seq"), F.col("race_seq") + (window - 1)))
    return rows.join(numbered.select("race_id", "race_seq"), "race_id").withColumn("at", spread), ends


def last_values(df: DataFrame, key: str, number: str, value: str, sizes: tuple[int, ...], lags: tuple[int, ...]) -> DataFrame:
    """Averages over the last n values of a series for several n (all values if fewer), and lags."""
    depth = max(*sizes, *(lag + 1 for lag in lags))
    tail = edge_rows(df.select(key, number, value), [key], number, depth)
    age = F.col("from_end") - 1
    tail = tail.where(age < depth)
    return tail.groupBy(key).agg(
        *[F.avg(F.when(age < n, F.col(value))).alias(f"rolling_avg_{n}") for n in sizes],
        *[F.max(F.when(age == lag, F.col(value))).alias(f"lag_{lag}") for lag in lags],
    )


def standings(results: DataFrame, entity: str) -> DataFrame:
    """Cumulative points and rank of each entity after each round held in a season.

    Ranks come from the histogram of points totals, so no season is sorted as a whole.
    """
    scored = results.groupBy("season", "round", entity).agg(F.sum("points").alias("_points"))
    # seasons times rounds held: a calendar, so small whatever the number of results
    rounds = results.select("season", "round").distinct()
    last_round = rounds.groupBy("season").agg(F.max("round").alias("_final"))
    own = Window.partitionBy("season", entity).orderBy("round")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    totals = (
        scored.withColumns({"points": F.sum("_points").over(upto), "_next": F.lead("round").over(own)})
        .join(F.broadcast(last_round), "season")
        .withColumn("round", F.explode(F.sequence("round", F.coalesce(F.col("_next") - 1, F.col("_final")))))
        .join(F.broadcast(rounds), ["season", "round"], "left_semi")
        .select("season", "round", entity, "points")
    )
    ahead = Window.partitionBy("season", "round").orderBy(F.col("points").desc())
    places = (
        totals.groupBy("season", "round", "points")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("rank", F.coalesce(F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
        .drop("_n")
    )
    return totals.join(places, ["season", "round", "points"])


def first_results(results: DataFrame) -> DataFrame:
    """The first result of a driver in a race, in the order of the list, where a race lists a driver more than once."""
    rest = [c for c in results.columns if c not in ("race_id", "driver_id")]
    first = results.groupBy("race_id", "driver_id").agg(F.min_by(F.struct(*rest), "result_idx").alias("_r"))
    return first.select("race_id", "driver_id", "_r.*").select(*results.columns)
