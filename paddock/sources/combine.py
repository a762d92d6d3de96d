"""Enrichment of races from a second source; values already present are never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.plans.canonical import weather_or_default
from paddock.sources import stored


def fill_weather(race: DataFrame, readings: DataFrame, key: str = "race_id") -> DataFrame:
    """Weather of the second source (key, reading) where there is one, else the defaults. Of several readings the
    smallest counts, so that no race is repeated."""
    one = readings.groupBy(key).agg(F.min("reading").alias("_reading"))
    return race.drop("weather").join(one, key, "left").withColumn(
        "weather", weather_or_default(F.col("_reading"))
    ).drop("_reading")


def fill_qualifying(qualifying: DataFrame, times: DataFrame, codes: DataFrame) -> DataFrame:
    """Missing Q1 to Q3 from ``times`` (race_id, driver_code, q1, q2, q3), matched by driver code. Of several times
    the fastest counts, so that no entry is repeated."""
    known = times.join(codes.distinct(), "driver_code").drop("driver_code")
    second = known.groupBy("race_id", "driver_id").agg(*[F.min(f"q{i}").alias(f"_q{i}") for i in (1, 2, 3)])
    out = qualifying.join(second, ["race_id", "driver_id"], "left")
    return out.withColumns({f"q{i}": F.coalesce(f"q{i}", f"_q{i}") for i in (1, 2, 3)}).drop("_q1", "_q2", "_q3")


def fill_fastest_laps(results: DataFrame, laps: DataFrame) -> DataFrame:
    """Missing fastest laps from ``laps`` (race_id, driver_code, lap), the fastest of a driver; the code is the
    start of the id."""
    code = F.upper(F.substring("driver_id", 1, 3))
    second = laps.groupBy("race_id", F.col("driver_code").alias("_code")).agg(F.min("lap").alias("_lap"))
    out = results.withColumn("_code", code).join(second, ["race_id", "_code"], "left")
    return out.withColumn("fastest_lap", F.coalesce("fastest_lap", "_lap")).drop("_code", "_lap")


def collected(race: DataFrame, results: DataFrame, qualifying: DataFrame, readings: DataFrame, times: DataFrame, codes: DataFrame, laps: DataFrame) -> DataFrame:
    """Race documents from header, results and qualifying of all races, with weather, qualifying times and fastest
    laps of the second source where the first has none."""
    return stored.documents(fill_weather(race, readings), fill_fastest_laps(results, laps), fill_qualifying(qualifying, times, codes))


def union_seasons(*parts: DataFrame) -> DataFrame:
    """One race list from several sources or seasons; absent columns become NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
