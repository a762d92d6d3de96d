"""Race tables derived from the TPC-H-like tables ``orders``, ``lineitem``, ``supplier``.

Six consecutive orders make one race, the distinct suppliers of their lines are the entrants. The
derivation runs once per session and input folder; its result is written as Parquet into the
shared folder of ``spark.checkpoint.dir``, and every operator reads it from there.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock import values
from paddock.plans.blocks import PIECE, by_field, number_rows

ORDERS_PER_RACE = 6
CIRCUITS = (
    "monaco", "monza", "silverstone", "spa", "suzuka", "interlagos", "singapore", "bahrain",
    "saudi_arabia", "australia", "imola", "miami", "spain", "azerbaijan", "canada", "austria",
    "france", "hungary", "netherlands", "japan", "qatar", "usa", "mexico", "abu_dhabi",
)


@dataclass(frozen=True)
class Tables:
    race: DataFrame
    race_result: DataFrame
    qualifying_result: DataFrame
    constructor_race: DataFrame


def pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def points_for(position: Column) -> Column:
    """Championship points of a finishing place, zero outside the top ten."""
    return reduce(
        lambda acc, item: acc.when(position == item[0], F.lit(float(item[1]))),
        list(values.POINTS.items())[1:],
        F.when(position == 1, F.lit(float(values.POINTS[1]))),
    ).otherwise(F.lit(0.0))


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="paddock-"))
    return _local[0]


def days(column: str) -> Column:
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))


def _cents(column: str) -> Column:
    return F.rint(F.col(column) * 100).cast("long")


def circuit_of(race_key: Column) -> Column:
    return pick(CIRCUITS, race_key % len(CIRCUITS))


def race_name(circuit: Column) -> Column:
    return F.concat(F.initcap(F.replace(circuit, F.lit("_"), F.lit(" "))), F.lit(" Grand Prix"))


def _race_columns() -> dict[str, Column]:
    """What follows from key and date of a race, so that it is not sent through shuffles."""
    return {
        "race_id": F.concat(F.lit("race_"), "race_key"),
        "season": F.year("race_date"),
        "round": (F.floor((F.dayofyear("race_date") - 1) / 15) + 1).cast("int"),
        "circuit_id": circuit_of(F.col("race_key")),
        "distance": F.when(F.col("race_key") % 50 == 0, 25).otherwise(40 + F.col("race_key") % 30).cast("int"),
    }


def _race_headers(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    key = F.floor(F.col("o_orderkey") / ORDERS_PER_RACE)
    header = (
        orders.groupBy(key.alias("race_key"))
        .agg(F.max_by("o_orderdate", "o_orderkey").alias("at"), F.sum(_cents("o_totalprice")).alias("cents"))
        .withColumn("race_date", F.to_date("at"))
    )
    lines = lineitem.groupBy(F.floor(F.col("l_orderkey") / ORDERS_PER_RACE).alias("race_key")).agg(
        F.count(F.lit(1)).alias("lines")
    )
    c = F.col("cents")
    weather = F.struct(
        ((c % 6000) / 100.0 - 10).alias("temperature"),
        ((F.floor(c / 7) % 10100) / 100.0).alias("humidity"),
        (F.lit(950) + (F.floor(c / 11) % 1000) / 10.0).alias("pressure"),
        ((F.floor(c / 13) % 600) / 10.0).alias("wind_speed"),
        (F.floor(c / 17) % 370).cast("int").alias("wind_direction"),
        (c % 5 == 0).alias("rainfall"),
        ((c % 6000) / 100.0 - 10 + (F.floor(c / 19) % 2000) / 100.0).alias("track_temp"),
    )
    known = _race_columns()
    return header.join(lines, "race_key").select(
        "race_key", *[known[n].alias(n) for n in ("race_id", "season", "round", "circuit_id")],
        race_name(known["circuit_id"]).alias("race_name"),
        "race_date",
        F.when(c % 10 != 7, weather).alias("reading"),
        known["distance"].alias("distance"),
        "lines",
    )


def _entrants(headers: DataFrame, lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Entries by their keys; names and teams follow from these and are added where a table is written."""
    lines = lineitem.select(
        F.floor(F.col("l_orderkey") / ORDERS_PER_RACE).alias("race_key"), F.col("l_suppkey").alias("driver_key"),
        _cents("l_extendedprice").alias("score"), F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_returnflag") == "R").alias("retired"),
    )
    # hardly any line shares race and supplier with another, so lines are dealt by race, as the join with the races asks for
    return (
        lines.repartition("race_key")
        .groupBy("race_key", "driver_key")
        .agg(F.sum("score").alias("score"), F.sum("quantity").alias("quantity"), F.min("retired").alias("retired"))
        .join(supplier.select(F.col("s_suppkey").alias("driver_key"), "s_nationkey"), "driver_key")
        .join(headers.select("race_key", "race_date", "lines"), "race_key")
    )


def _seat(shift: int = 0) -> Column:
    """Number of the team of an entry; with a shift, of another one."""
    n = len(values.CATEGORIES["constructor_id"])
    seat = (F.col("s_nationkey") + F.floor(F.year("race_date") / 3)) % n
    return (seat + shift) % n if shift else seat


def _team(number: Column) -> Column:
    return pick(values.CATEGORIES["constructor_id"], number)


def _entries(entrant: DataFrame) -> DataFrame:
    # a field is cut into bands of scores, the finer the more lines its race has, so that no sort holds a whole large field;
    # fields of one piece need no shift and are sent by race once for both numbers
    band = lambda c: F.floor(F.log2(c + 1) * 1000)
    piece = lambda at: F.floor(F.coalesce(at, F.lit(-(2**30))) * F.floor(F.col("lines") / PIECE) / 64)
    withdrawn = F.col("score") % 41 == 0
    at_place = (withdrawn.cast("int") * 2 + F.col("retired").cast("int")) * 100_000 - band(F.col("score"))
    at_slot = -band(F.col("quantity"))
    by_place = [at_place.isNotNull(), withdrawn, F.col("retired"), F.col("score").desc(), F.col("driver_key")]
    by_slot = [at_slot.isNotNull(), F.col("quantity").desc(), F.col("driver_key")]

    def numbered(rows: DataFrame, short: bool) -> DataFrame:
        entry = number_rows(rows, ["race_key"], by_place, piece(at_place), "place", count_from=rows, one_chunk=short)
        return number_rows(entry, ["race_key"], by_slot, piece(at_slot), "slot", count_from=rows, one_chunk=short)

    return by_field(entrant, numbered).withColumn("withdrawn", withdrawn)


def write_table(df: DataFrame, path: str, spark: SparkSession, partitions: bool = True) -> DataFrame:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partitions:
        writer = writer.partitionBy("season")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_built: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Canonical race tables of an input folder, built on first use."""
    key = (spark.sparkContext.applicationId, os.path.normpath(sf_dir))
    if key not in _built:
        _built[key] = build(spark, sf_dir)
    return _built[key]


def store(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the derived tables of an input folder in this session."""
    tag = hashlib.sha256(os.path.normpath(sf_dir).encode()).hexdigest()[:12]
    return f"{shared_folder(spark)}/paddock/{spark.sparkContext.applicationId}/{tag}"


def build(spark: SparkSession, sf_dir: str) -> Tables:
    root = store(spark, sf_dir)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders, lineitem, supplier = read("orders"), read("lineitem"), read("supplier")

    headers = _race_headers(orders, lineitem)
    headers = write_table(headers, f"{root}/header", spark, False)
    entrants = write_table(_entrants(headers, lineitem, supplier), f"{root}/entrant", spark, False)
    entries = write_table(_entries(entrants), f"{root}/entry", spark, False)

    named = _race_columns() | {"driver_id": F.concat(F.lit("driver_"), "driver_key"), "constructor_id": _team(_seat())}
    finished = ~F.col("retired")
    position = F.when(finished, F.col("place").cast("int")).otherwise(F.lit(values.NOT_CLASSIFIED))
    running = entries.where(~F.col("withdrawn"))

    # race ids are in order of their text
    order = [F.col("race_date"), F.col("race_key").cast("string")]
    month = F.year("race_date") * 12 + F.month("race_date")
    result = number_rows(
        running.select("race_key", "race_date", "lines", "driver_key", "s_nationkey", "score", "quantity", "retired", "place", "slot"),
        ["driver_key"], order, month, "start_no", "prior_starts", prior_of=F.col("race_date"),
        count_from=running.select("driver_key", "race_date"),
    ).withColumns(named)
    rowlaps = F.when(finished, F.col("distance")).otherwise((F.col("quantity") % F.col("distance")).cast("int"))
    result = result.withColumn("final_position", position).select(
        "race_id", "season", "round", "circuit_id", "race_date",
        (F.col("place") - 1).cast("int").alias("result_idx"),
        "driver_id", "constructor_id",
        F.when(F.col("quantity") % 29 == 0, 0).otherwise(F.col("slot")).cast("int").alias("grid_position"),
        "final_position",
        finished.alias("finished"),
        points_for(F.col("final_position")).alias("points"),
        F.when(
            finished & (F.col("score") % 11 != 0),
            F.struct(
                (80000 + F.col("score") % 20000).alias("time_ms"),
                (1 + F.col("quantity") % F.col("distance")).cast("int").alias("lap_number"),
            ),
        ).alias("fastest_lap"),
        F.when(finished, "finished")
        .when(F.col("quantity") % 7 == 0, "disqualified")
        .when(F.col("quantity") % 7 == 1, "dns")
        .otherwise("dnf")
        .alias("status"),
        rowlaps.alias("laps_completed"),
        "lines", "start_no", "prior_starts",
    )
    result = write_table(result, f"{root}/race_result", spark)

    q1 = 82000 + F.col("score") % 9000
    lap = lambda ms, n: F.struct(ms.alias("time_ms"), F.lit(n).alias("lap_number"))
    qualifying = entries.where(F.col("score") % 17 != 0).withColumns(named).select(
        "race_id", "season", "round", "circuit_id", "race_date", "driver_id",
        F.when(F.col("score") % 97 == 0, _team(_seat(1))).otherwise(F.col("constructor_id")).alias("constructor_id"),
        F.col("slot").cast("int").alias("position"),
        F.when(F.col("score") % 23 != 0, lap(q1, 3)).alias("q1"),
        F.when(F.col("slot") <= 15, lap(q1 - 500 - F.col("score") % 300, 7)).alias("q2"),
        F.when(F.col("slot") <= 10, lap(q1 - 1000 - F.col("score") % 500, 11)).alias("q3"),
        "lines",
    )
    qualifying = write_table(qualifying, f"{root}/qualifying_result", spark)

    race = headers.join(running.groupBy("race_key").agg(F.count(F.lit(1)).alias("field_size")), "race_key", "left").select(
        "race_id", "season", "round", "circuit_id", "race_name", "race_date", "reading",
        weather_or_default(F.col("reading")).alias("weather"), "distance",
        F.coalesce("field_size", F.lit(0)).alias("field_size"),
    )
    race = write_table(race, f"{root}/race", spark)

    team = running.withColumns({"constructor_id": _team(_seat()), "final_position": position}).groupBy("race_key", "race_date", "constructor_id").agg(
        F.sum(points_for(F.col("final_position"))).alias("total_points"),
        F.min(F.when(finished, F.col("final_position"))).alias("best_finish"),
        F.count_if(finished).alias("drivers_finished"),
        F.count(F.lit(1)).alias("total_drivers"),
    )
    team = write_table(team, f"{root}/constructor_rows", spark, False)
    team = number_rows(team, ["constructor_id"], order, days("race_date"), "race_no", "prior_races")
    team = team.withColumns(_race_columns()).select(
        "race_id", "season", "round", "circuit_id", "race_date", "constructor_id",
        "total_points", "best_finish", "drivers_finished", "total_drivers", "race_no", "prior_races",
    )
    team = write_table(team, f"{root}/constructor_race", spark)
    return Tables(race, result, qualifying, team)


def weather_or_default(reading: Column) -> Column:
    """A weather struct with the default value for every missing field."""
    types = {"wind_direction": "int", "rainfall": "boolean"}
    return F.struct(
        *[
            F.coalesce(reading[name], F.lit(v).cast(types.get(name, "double"))).alias(name)
            for name, v in values.DEFAULT_WEATHER.items()
        ]
    )


# The same derivation for DuckDB, used by the oracle queries.
_sql_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_sql_points = "CASE final_position " + " ".join(f"WHEN {k} THEN {v}.0" for k, v in values.POINTS.items()) + " ELSE 0.0 END"
_TEAMS = _sql_list(values.CATEGORIES["constructor_id"])
_W = values.DEFAULT_WEATHER
SQL = f"""
header AS (
  SELECT o_orderkey // {ORDERS_PER_RACE} AS race_key, CAST(arg_max(o_orderdate, o_orderkey) AS DATE) AS race_date,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c
  FROM orders GROUP BY 1),
race_base AS (
  SELECT race_key, 'race_' || race_key AS race_id, year(race_date) AS season, (dayofyear(race_date) - 1) // 15 + 1 AS round,
         {_sql_list(CIRCUITS)}[race_key % {len(CIRCUITS)} + 1] AS circuit_id, race_date, c, c % 10 <> 7 AS has_reading,
         CASE WHEN race_key % 50 = 0 THEN 25 ELSE 40 + race_key % 30 END AS distance
  FROM header WHERE race_key IN (SELECT l_orderkey // {ORDERS_PER_RACE} FROM lineitem)),
grouped AS (
  SELECT l_orderkey // {ORDERS_PER_RACE} AS race_key, l_suppkey AS driver_key,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS score,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, bool_and(l_returnflag = 'R') AS retired
  FROM lineitem GROUP BY 1, 2),
entry AS MATERIALIZED (
  SELECT g.*, r.race_id, r.season, r.round, r.circuit_id, r.race_date, r.distance, 'driver_' || g.driver_key AS driver_id,
         {_TEAMS}[(s_nationkey + r.season // 3) % 10 + 1] AS constructor_id,
         {_TEAMS}[((s_nationkey + r.season // 3) % 10 + 1) % 10 + 1] AS other_team,
         g.score % 41 = 0 AS withdrawn, g.score % 17 <> 0 AS in_qualifying,
         row_number() OVER (PARTITION BY g.race_key ORDER BY g.score % 41 = 0, retired, score DESC, driver_key) AS place,
         row_number() OVER (PARTITION BY g.race_key ORDER BY quantity DESC, driver_key) AS slot
  FROM grouped g JOIN supplier ON s_suppkey = g.driver_key JOIN race_base r ON r.race_key = g.race_key),
placed AS (
  SELECT *, CASE WHEN retired THEN {values.NOT_CLASSIFIED} ELSE place END AS final_position FROM entry WHERE NOT withdrawn),
race_result AS MATERIALIZED (
  SELECT race_id, season, round, circuit_id, race_date, place - 1 AS result_idx, driver_id, constructor_id,
         CASE WHEN quantity % 29 = 0 THEN 0 ELSE slot END AS grid_position, final_position, NOT retired AS finished,
         CAST({_sql_points} AS DOUBLE) AS points,
         CASE WHEN NOT retired AND score % 11 <> 0 THEN 80000 + score % 20000 END AS fastest_ms,
         CASE WHEN NOT retired THEN 'finished' WHEN quantity % 7 = 0 THEN 'disqualified' WHEN quantity % 7 = 1 THEN 'dns' ELSE 'dnf' END AS status,
         CASE WHEN NOT retired THEN distance ELSE quantity % distance END AS laps_completed,
         row_number() OVER (PARTITION BY driver_id ORDER BY race_date, race_id) AS start_no,
         rank() OVER (PARTITION BY driver_id ORDER BY race_date) - 1 AS prior_starts
  FROM placed),
qualifying_result AS MATERIALIZED (
  SELECT race_id, season, round, circuit_id, race_date, driver_id,
         CASE WHEN score % 97 = 0 THEN other_team ELSE constructor_id END AS constructor_id, slot AS position,
         CASE WHEN score % 23 <> 0 THEN 82000 + score % 9000 END AS q1_ms,
         CASE WHEN slot <= 15 THEN 82000 + score % 9000 - 500 - score % 300 END AS q2_ms,
         CASE WHEN slot <= 10 THEN 82000 + score % 9000 - 1000 - score % 500 END AS q3_ms
  FROM entry WHERE in_qualifying),
race AS MATERIALIZED (
  SELECT race_id, season, round, circuit_id, race_date, distance, has_reading, race_key,
         array_to_string(list_transform(string_split(circuit_id, '_'), lambda x: upper(x[1]) || x[2:]), ' ') || ' Grand Prix' AS race_name,
         CASE WHEN has_reading THEN (c % 6000) / 100.0 - 10 ELSE {_W['temperature']} END::DOUBLE AS temperature,
         CASE WHEN has_reading THEN ((c // 7) % 10100) / 100.0 ELSE {_W['humidity']} END::DOUBLE AS humidity,
         CASE WHEN has_reading THEN 950 + ((c // 11) % 1000) / 10.0 ELSE {_W['pressure']} END::DOUBLE AS pressure,
         CASE WHEN has_reading THEN ((c // 13) % 600) / 10.0 ELSE {_W['wind_speed']} END::DOUBLE AS wind_speed,
         CASE WHEN has_reading THEN (c // 17) % 370 ELSE {_W['wind_direction']} END AS wind_direction,
         CASE WHEN has_reading THEN c % 5 = 0 ELSE false END AS rainfall,
         CASE WHEN has_reading THEN (c % 6000) / 100.0 - 10 + ((c // 19) % 2000) / 100.0 ELSE {_W['track_temp']} END::DOUBLE AS track_temp,
         (SELECT count(*) FROM race_result x WHERE x.race_id = race_base.race_id) AS field_size
  FROM race_base),
constructor_race AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY constructor_id ORDER BY race_date, race_id) AS race_no,
         rank() OVER (PARTITION BY constructor_id ORDER BY race_date) - 1 AS prior_races
  FROM (SELECT race_id, season, round, circuit_id, race_date, constructor_id, sum(points) AS total_points,
               min(final_position) FILTER (WHERE finished) AS best_finish, count(*) FILTER (WHERE finished) AS drivers_finished,
               count(*) AS total_drivers
        FROM race_result GROUP BY ALL))
"""
