"""Landed JSON payloads of a results service as rows: results, qualifying, headers, standings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock import schemas, values
from paddock.functions import parse

_QUARANTINE = "_corrupt_record"


def read_payloads(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """One row per payload file, or per line of the files with ``lines``; unreadable payloads keep their text in
    ``_corrupt_record``."""
    parsed = F.from_json("value", schemas.RACE_PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _QUARANTINE})
    return spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), parsed.alias("p")).select("file", "p.*")


def quarantine(payloads: DataFrame) -> DataFrame:
    """Unreadable payloads with file and text, and whether any race could be read from them."""
    partly = F.col("MRData").isNotNull().alias("partly_read")
    return payloads.where(F.col(_QUARANTINE).isNotNull()).select("file", partly, _QUARANTINE)


def races(payloads: DataFrame) -> DataFrame:
    """Race structs of the payloads with the payload's `offset`, the place of its first entry in the race;
    payloads without races give no rows."""
    rows = payloads.where(F.col(_QUARANTINE).isNull()).select(F.col("MRData.offset").alias("offset"), F.explode("MRData.RaceTable.Races").alias("r"))
    return rows.select("r.*", "offset")


def race_key() -> list:
    return [F.col("season").try_cast("int").alias("season"), F.col("round").try_cast("int").alias("round")]


def headers(payload_races: DataFrame) -> DataFrame:
    """Typed race headers with default weather, one per race; races that share season and round stay apart."""
    default = F.struct(*[F.lit(v).alias(n) for n, v in values.DEFAULT_WEATHER.items()])
    return payload_races.select(
        *race_key(), F.col("Circuit.circuitId").alias("circuit_id"), F.col("raceName").alias("race_name"),
        parse.race_time(F.col("date"), F.col("time")).alias("race_date"),
    ).distinct().withColumn("weather", default)


def results(payload_races: DataFrame) -> DataFrame:
    """Typed result rows in payload order."""
    start = F.coalesce(F.col("offset").try_cast("int"), F.lit(0))
    rows = payload_races.select(*race_key(), start.alias("_start"), F.posexplode("Results").alias("_i", "r")).withColumn("result_idx", F.col("_start") + F.col("_i"))
    final = parse.place(F.col("r.position"))
    return rows.select(
        "season", "round", "result_idx", F.col("r.Driver.driverId").alias("driver_id"), F.col("r.Constructor.constructorId").alias("constructor_id"),
        F.col("r.grid").try_cast("int").alias("grid_position"), final.alias("final_position"), (final < values.NOT_CLASSIFIED).alias("finished"),
        F.col("r.points").try_cast("double").alias("points"), parse.lap(F.col("r.FastestLap.Time.time"), F.lit(0)).alias("fastest_lap"),
        parse.race_status(F.col("r.status")).alias("status"), F.col("r.laps").try_cast("int").alias("laps_completed"),
    )


def qualifying(payload_races: DataFrame) -> DataFrame:
    """Typed qualifying rows in payload order."""
    rows = payload_races.select(*race_key(), F.posexplode("QualifyingResults").alias("qual_idx", "q"))
    return rows.select(
        "season", "round", "qual_idx", F.col("q.Driver.driverId").alias("driver_id"), F.col("q.Constructor.constructorId").alias("constructor_id"),
        F.col("q.position").try_cast("int").alias("position"),
        *[parse.lap(F.col(f"q.Q{i}"), F.lit(0)).alias(f"q{i}") for i in (1, 2, 3)],
    )


def between(rows: DataFrame, start_season: int, end_season: int) -> DataFrame:
    """Rows of a range of seasons."""
    return rows.where(F.col("season").between(start_season, end_season))


def standings(spark: SparkSession, path: str | list[str], entity: str) -> DataFrame:
    """Standings rows of landed payloads; ``entity`` is 'driver' or 'constructor'."""
    kind = {"driver": ("DriverStandings", "Driver.driverId"), "constructor": ("ConstructorStandings", "Constructor.constructorId")}
    if entity not in kind:
        raise ValueError(f"unknown entity type: {entity}")
    field, key = kind[entity]
    lists = (
        spark.read.schema(schemas.STANDINGS_PAYLOAD).option("multiLine", True).json(path)
        .select(F.explode("MRData.StandingsTable.StandingsLists").alias("l"))
        .select("l.season", "l.round", F.explode(f"l.{field}").alias("s"))
    )
    return lists.select(
        *race_key(), F.col(f"s.{key}").alias(f"{entity}_id"), F.col("s.position").try_cast("int").alias("position"),
        F.col("s.points").try_cast("double").alias("points"), F.col("s.wins").try_cast("int").alias("wins"),
    )
