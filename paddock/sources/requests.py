"""Race requests from CSV files with JSON columns, and exports of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock import schemas


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Request rows of CSV files with a header."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schemas.REQUEST_CSV).csv(path)


def row_errors() -> Column:
    """Messages of a CSV row (empty array when valid)."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    kind = lambda c: F.substring(F.trim(c), 1, 1)
    parsed = lambda c: F.try_parse_json(c)
    drivers, weather = F.coalesce("drivers", F.lit("[]")), F.coalesce("weather", F.lit("{}"))
    n = F.json_array_length(drivers)
    return F.array_compact(
        F.array(
            F.when(blank("race_name"), F.lit("race_name is required")),
            F.when(blank("circuit"), F.lit("circuit is required")),
            F.when(F.try_to_timestamp("date").isNull(), F.lit("date must be in valid date format")),
            F.when(parsed(drivers).isNull(), F.lit("drivers must be valid JSON")).when(
                F.coalesce(n, F.lit(0)) == 0, F.lit("drivers must be a non-empty JSON array")
            ),
            F.when(parsed(weather).isNull(), F.lit("weather must be valid JSON")).when(kind(weather) != "{", F.lit("weather must be a JSON object")),
        )
    )


def checked(rows: DataFrame) -> DataFrame:
    """CSV rows with their error text, NULL when valid."""
    errors = row_errors()
    return rows.withColumn("errors", F.when(F.size(errors) > 0, F.concat_ws("; ", errors)))


def requests(rows: DataFrame) -> DataFrame:
    """Typed requests of the valid CSV rows."""
    return checked(rows).where(F.col("errors").isNull()).select(
        F.trim("race_name").alias("race_name"), F.trim("circuit").alias("circuit"), F.try_to_timestamp("date").alias("race_date"),
        F.from_json("drivers", schemas.REQUEST_DRIVERS).alias("drivers"), F.from_json("weather", schemas.REQUEST_WEATHER).alias("weather"),
    )


def export_rows(predictions: DataFrame, confidence: DataFrame) -> DataFrame:
    """Flat export: one row per race and driver."""
    return predictions.join(confidence.select("race_id", F.col("overall_confidence").alias("overall_confidence")), "race_id").select(
        "race_id", "race_name", "circuit", F.date_format("race_date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "overall_confidence",
        F.col("list_no").alias("position"), "driver_id", "driver_name", "predicted_position", "expected_points", "confidence_score",
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON document that keeps NULL fields."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def write_json_export(predictions: DataFrame, path: str) -> None:
    """JSON lines with the export time and the number of predictions in a small envelope beside them."""
    predictions.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/predictions")
    head = predictions.agg(F.count(F.lit(1)).alias("total_predictions")).withColumn("export_timestamp", F.current_timestamp())
    head.write.mode("overwrite").json(f"{path}/envelope")
