"""Career aggregates of drivers and the base feature row built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions import scores
from paddock.operators.form import classified_place
from paddock.plans.blocks import BLOCK, edge_rows, exact_quantiles


def career(results: DataFrame, block: int = BLOCK) -> DataFrame:
    """Place, grid and points statistics of every driver; 20 and 0 stand in for missing finishes."""
    place, points = classified_place(), F.col("points")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    base = results.groupBy("driver_id").agg(
        F.count(F.lit(1)).alias("starts"),
        F.coalesce(F.avg(place), F.lit(20.0)).alias("avg_finish_position"),
        F.coalesce(F.min(place), F.lit(20)).alias("best_finish"),
        F.coalesce(F.max(place), F.lit(20)).alias("worst_finish"),
        F.coalesce(F.stddev_pop(place), F.lit(0.0)).alias("finish_consistency"),
        F.avg("grid_position").alias("avg_grid_position"),
        F.stddev_pop("grid_position").alias("grid_consistency"),
        F.sum(points).alias("points_total"),
        F.avg(points).alias("points_per_race"),
        F.stddev_pop(points).alias("points_consistency"),
        share(F.col("finished")).alias("finish_rate"),
        share(F.col("finished") & (F.col("final_position") <= 3)).alias("podium_rate"),
        share(F.col("finished") & (F.col("final_position") == 1)).alias("win_rate"),
    )
    median = exact_quantiles(
        results.where("finished").select("driver_id", "final_position"),
        ["driver_id"], "final_position", {"median_finish_position": 0.5}, F.floor(F.col("final_position") / 256),
    ).drop("n_values")
    return (
        base.join(median, "driver_id", "left")
        .join(performance_trend(results, block), "driver_id", "left")
        .withColumns(
            {
                "median_finish_position": F.coalesce("median_finish_position", F.lit(20.0)),
                "performance_trend": F.coalesce("performance_trend", F.lit(0.0)),
                "dnf_rate": 1.0 - F.col("finish_rate"),
                "championship_position": scores.championship_place(F.col("points_total")),
            }
        )
    )


def performance_trend(results: DataFrame, block: int = BLOCK) -> DataFrame:
    """Mean of the first three classified places minus mean of the last three (0 below three)."""
    edges = edge_rows(results.where("finished").select("driver_id", "start_no", "final_position"), ["driver_id"], "start_no", 3, block)
    early = F.avg(F.when(F.col("from_start") <= 3, F.col("final_position")))
    recent = F.avg(F.when(F.col("from_end") <= 3, F.col("final_position")))
    return edges.groupBy("driver_id").agg(
        F.when(F.count(F.lit(1)) >= 3, early - recent).otherwise(0.0).alias("performance_trend")
    )


def recent_form(results: DataFrame, window: int = 5) -> DataFrame:
    """Form score of the last ``window`` starts, later starts weighing more."""
    score = scores.race_score(F.col("final_position"), F.col("points"), F.col("finished"))
    rows = results.select("driver_id", "start_no", score.alias("score"))
    tail = edge_rows(rows, ["driver_id"], "start_no", window).where(F.col("from_end") <= window)
    starts = F.array_sort(F.collect_list(F.struct("start_no", "score")))
    return tail.groupBy("driver_id").agg(
        scores.weighted_form(F.transform(starts, lambda x: x["score"])).alias("recent_form")
    )


def constructor_score(results: DataFrame) -> DataFrame:
    """Mean place score of each driver in the cars of the latest constructor, 0.1 when not classified."""
    score = F.when(F.col("finished"), scores.position_score(F.col("final_position"))).otherwise(F.lit(0.1))
    seats = results.groupBy("driver_id", "constructor_id").agg(
        F.sum(score).alias("total"), F.count(F.lit(1)).alias("starts"), F.max("start_no").alias("last")
    )
    return (
        seats.groupBy("driver_id")
        .agg(F.max_by(F.struct("constructor_id", (F.col("total") / F.col("starts")).alias("score")), "last").alias("seat"))
        .select("driver_id", "seat.constructor_id", F.col("seat.score").alias("constructor_performance"))
    )


def qualifying_form(qualifying: DataFrame) -> DataFrame:
    """Clipped distance of the mean qualifying place from midfield; place 0 counts as missing."""
    place = F.when(F.col("position") != 0, F.col("position"))
    return qualifying.groupBy("driver_id").agg(scores.qualifying_delta(F.avg(place)).alias("qualifying_delta"))


def base_features(results: DataFrame, qualifying: DataFrame) -> DataFrame:
    """The seven base features of every driver with at least one result."""
    return (
        results.groupBy("driver_id")
        .agg(F.count(F.lit(1)).alias("track_experience"), F.sum("points").alias("points_total"))
        .join(recent_form(results), "driver_id")
        .join(constructor_score(results), "driver_id")
        .join(qualifying_form(qualifying), "driver_id", "left")
        .withColumns(
            {
                "qualifying_delta": F.coalesce("qualifying_delta", F.lit(0.0)),
                "weather_performance": F.lit(0.5),
                "championship_position": scores.championship_place(F.col("points_total")),
            }
        )
    )
