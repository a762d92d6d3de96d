"""Stored races as nested JSON documents partitioned by season, named feature sets, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from paddock import schemas

# entries per document: a race with a larger field is stored as several documents, which say where they start
PART = 5000


def documents(race: DataFrame, results: DataFrame, qualifying: DataFrame, part: int = PART) -> DataFrame:
    """Nested documents of races; each holds at most ``part`` results and qualifying entries."""
    entry = F.struct(
        "result_idx", "driver_id", "constructor_id", "grid_position", "final_position", "points", "fastest_lap", "status", "laps_completed"
    )
    quali = F.struct("position", "driver_id", "constructor_id", F.col("q1").alias("q1_time"), F.col("q2").alias("q2_time"), F.col("q3").alias("q3_time"))
    # results and qualifying entries are sent by race, as the join with the headers asks for, so that lists are made where they are joined
    rows = results.select("race_id", F.floor(F.col("result_idx") / part).alias("part"), entry.alias("result")).unionByName(
        qualifying.select("race_id", F.floor((F.col("position") - 1) / part).alias("part"), quali.alias("entry")), allowMissingColumns=True
    )
    both = rows.repartition("race_id").groupBy("race_id", "part").agg(
        F.transform(F.array_sort(F.collect_list("result")), lambda x: x.dropFields("result_idx")).alias("results"),
        F.array_sort(F.collect_list("entry")).alias("qualifying"),
    )
    empty = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    return race.join(both, "race_id", "left").select(
        "season", "round", "race_id", F.coalesce("part", F.lit(0)).alias("part"), (F.coalesce("part", F.lit(0)) * part).alias("first_result"), "circuit_id", "race_name",
        F.date_format("race_date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), empty("results"), empty("qualifying"), "weather",
    )


def write_races(docs: DataFrame, path: str) -> None:
    """Write documents below ``season=``; only the seasons present are replaced."""
    docs.write.partitionBy("season").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def read_races(spark: SparkSession, path: str) -> DataFrame:
    """Stored documents with explicit types; ``season`` comes from the folder and prunes reads."""
    return spark.read.schema(schemas.STORED_RACE).json(path).withColumn("race_date", F.to_timestamp("date"))


def race(spark: SparkSession, path: str, season: int, round_: int) -> DataFrame:
    """Documents of one race; empty when it is not stored."""
    return read_races(spark, path).where((F.col("season") == season) & (F.col("round") == round_))


def result_rows(docs: DataFrame) -> DataFrame:
    """Result rows of stored documents."""
    rows = docs.select("race_id", "season", "round", "first_result", F.posexplode("results").alias("_i", "r"))
    return rows.select("race_id", "season", "round", (F.coalesce("first_result", F.lit(0)) + F.col("_i")).alias("result_idx"), "r.*")


def qualifying_rows(docs: DataFrame) -> DataFrame:
    return docs.select("race_id", "season", "round", F.explode("qualifying").alias("q")).select("race_id", "season", "round", "q.*")


def catalogue(docs: DataFrame, season: int | None = None) -> DataFrame:
    """Stored races with numbers of drivers and qualifiers, by season and round."""
    rows = docs if season is None else docs.where(F.col("season") == season)
    return rows.groupBy("season", "round", "race_id").agg(
        F.first("circuit_id").alias("circuit_id"), F.first("race_name").alias("race_name"), F.first("date").alias("date"),
        F.sum(F.size("results")).alias("num_drivers"), F.sum(F.size("qualifying")).alias("num_qualifying"),
    ).orderBy("season", "round", "race_id")


def storage_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Files, megabytes, seasons and last change of a stored table, from file metadata."""
    rows = read_races(spark, path).select("season", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = rows.groupBy("file_path", "season", "file_size", "file_modification_time").agg(F.count(F.lit(1)).alias("documents"))
    return files.agg(
        F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("files"), (F.sum("file_size") / 1024 / 1024).alias("megabytes"),
        F.array_sort(F.collect_set("season")).alias("seasons"), F.max("file_modification_time").alias("last_update"),
    )


def keep_newest(rows: DataFrame, keep_seasons: int = 5) -> DataFrame:
    """Rows of the newest seasons; write them to a new path, nothing is deleted in place."""
    seasons = rows.select("season").distinct()
    newest = seasons.withColumn("_n", F.dense_rank().over(Window.orderBy(F.col("season").desc()))).where(F.col("_n") <= keep_seasons)
    return rows.join(newest.select("season"), "season", "left_semi")


def save_features(features: DataFrame, root: str, name: str) -> None:
    features.write.mode("overwrite").parquet(f"{root}/features/{name}")


def load_features(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A named feature set, None when it is not stored."""
    try:
        return spark.read.parquet(f"{root}/features/{name}")
    except AnalysisException:
        return None


def append_log(rows: DataFrame, path: str) -> None:
    """Append predictions to the history; a missing time becomes the current one."""
    stamped = rows if "logged_at" in rows.columns else rows.withColumn("logged_at", F.lit(None).cast("timestamp"))
    stamped.withColumn("logged_at", F.coalesce("logged_at", F.current_timestamp())).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def confidence_over_time(log: DataFrame) -> DataFrame:
    """Confidence of logged predictions in time order."""
    return log.select("logged_at", "race_name", "overall_confidence").orderBy("logged_at")
