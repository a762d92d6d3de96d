"""The stored training matrix of the derived race tables: features and places of classified finishers in time order."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.ml import models
from paddock.operators import evaluation, prediction
from paddock.plans import canonical
from paddock.plans.predictions import entry_rows, request_rows

FEATURES = (
    "qualifying_position", "constructor_championship_points", "track_temperature", "air_temperature", "humidity", "wind_speed", "weather_dry",
    "car_performance_rating", "driver_skill_rating", "consistency_rating", "wet_weather_skill", "circuit_overtaking_factor", "qualifying_importance",
)
#: two features whose models have closed forms in SQL, and binary ones of trees of one split
PAIR = ("qualifying_position", "car_performance_rating")
BINARY = {"front": "qualifying_position <= 5", "fast": "car_performance_rating >= 0.8D"}
FOLDS, TUNING_FOLDS = 5, 3

_built: dict[tuple[str, str], DataFrame] = {}


def with_twins(entries: DataFrame, seen: Sequence[str], where: str = "true") -> DataFrame:
    """Every row with the ``seen`` columns (``twin``) of each row of its race and driver that ``where`` holds for, which is
    itself where no driver stands twice in a race: a join of the entries with themselves that sends them by race once."""
    twins = F.collect_list(F.when(F.expr(where), F.struct(*seen))).over(Window.partitionBy("race_id", "driver_id"))
    return entries.withColumn("_twins", twins).withColumn("twin", F.explode("_twins")).drop("_twins")


def features(entries: DataFrame, *more: str) -> DataFrame:
    """Model input of entries, as doubles, with the binary features; ``more`` columns are kept."""
    rows = prediction.model_input(request_rows(entries), *more)
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES}).withColumns({n: F.expr(c).cast("double") for n, c in BINARY.items()}).select(
        "race_id", "driver_id", *FEATURES, *BINARY, *more
    )


def numbered_races(t: canonical.Tables) -> DataFrame:
    """Races with the training rows of earlier ones in time order (``_earlier``) and of all (``_rows``). Days are added up first, then
    the races of a day, so no window holds more than either."""
    number = F.substring_index("race_id", "_", -1).cast("long")
    # a row is an entry with the outcome of a finisher of the same race and driver
    pairs = t.race_result.groupBy("race_id", "driver_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("finished").alias("f"))
    # races without a date have no place in time
    sizes = t.race.where(F.col("race_date").isNotNull()).select("race_id", "race_date").join(pairs.groupBy("race_id").agg(F.sum(F.col("n") * F.col("f")).alias("n")), "race_id", "left")
    sizes = sizes.select("race_id", "race_date", F.coalesce("n", F.lit(0)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = sizes.groupBy("race_date").agg(F.sum("n").alias("n"))
    days = days.select("race_date", before(Window.orderBy("race_date")).alias("_days"), F.sum("n").over(Window.partitionBy()).alias("_rows"))
    at = sizes.withColumn("_inner", before(Window.partitionBy("race_date").orderBy(number, "race_id"))).join(F.broadcast(days), "race_date")
    return t.race.join(at.select("race_id", (F.col("_inner") + F.col("_days")).alias("_earlier"), "_rows"), "race_id")


def _matrix(t: canonical.Tables) -> DataFrame:
    rows = with_twins(entry_rows(t, numbered_races(t)), ["final_position"], "finished")
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("race_id").orderBy("driver_id")) + F.col("_earlier"))
    rows = rows.withColumn(models.LABEL, F.col("twin.final_position").cast("double"))
    rows = features(rows, "race_date", models.LABEL, "row_no", "_rows")
    tuned = evaluation.folds(rows, TUNING_FOLDS, size=F.col("_rows")).withColumnRenamed("test_fold", "tuning_fold")
    return evaluation.temporal_split(evaluation.folds(tuned, FOLDS, size=F.col("_rows")), size=F.col("_rows")).drop("_rows")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """race_id, driver_id, race_date, features, target, row_no, test_fold, tuning_fold, is_test; built on first use."""
    key = (spark.sparkContext.applicationId, os.path.normpath(sf_dir))
    if key not in _built:
        t = canonical.tables(spark, sf_dir)
        _built[key] = canonical.write_table(_matrix(t), f"{canonical.store(spark, sf_dir)}/training", spark, False)
    return _built[key]


#: the same rows for DuckDB; needs the SQL of predictions
SQL = f"""
training AS MATERIALIZED (SELECT *, greatest(0, ceil((row_no - (n - {FOLDS} * (n // {FOLDS + 1}))) / greatest(n // {FOLDS + 1}, 1)))::INT AS test_fold,
    greatest(0, ceil((row_no - (n - {TUNING_FOLDS} * (n // {TUNING_FOLDS + 1}))) / greatest(n // {TUNING_FOLDS + 1}, 1)))::INT AS tuning_fold
  FROM (SELECT race_id, driver_id, race_date, grid::DOUBLE AS x1, car AS x2, final_position::DOUBLE AS y, grid <= 5 AS front, car >= 0.8 AS fast,
      row_number() OVER (ORDER BY race_date, CAST(string_split(race_id, '_')[2] AS BIGINT), driver_id) AS row_no, count(*) OVER () AS n FROM rated WHERE finished))"""
