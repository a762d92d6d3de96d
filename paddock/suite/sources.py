"""Queries on sources: parsing, stored documents, enrichment, CSV requests, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock import schemas, values
from paddock.functions import parse
from paddock.operators import form, prediction, report
from paddock.plans import canonical
from paddock.sources import combine, payloads, requests, stored
from paddock.suite.base import Query, on_tables, predicted_query
from paddock.suite.report import DIFFICULTY



def _lap_texts(t):
    ms = F.col("q1.time_ms")
    text = F.format_string("%d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)
    odd = (
        F.when(ms % 11 == 0, F.lit(" "))
        .when(ms % 7 == 0, F.format_string("%d:%02d", F.floor(ms / 60000), F.floor(ms / 1000) % 60))
        .when(ms % 13 == 0, F.format_string("%d:%02d.%d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 10))
        .when(ms % 17 == 0, F.lit("no time"))
        .otherwise(text)
    )
    return t.qualifying_result.where(F.col("q1").isNotNull()).select("race_id", "driver_id", odd.alias("text")).withColumn("time_ms", parse.lap_time_ms(F.col("text")))


def _status_texts(t):
    r = F.col("result_idx")
    text = F.when(F.col("status") == "finished", F.when(r % 3 == 0, "Finished").when(r % 3 == 1, r.cast("string")).otherwise("+1 Lap")).when(
        F.col("status") == "disqualified", "Disqualified"
    ).when(F.col("status") == "dns", "Did not start").otherwise("Accident")
    rows = t.race_result.select("race_id", "driver_id", text.alias("text"), F.when(F.col("finished"), F.col("final_position").cast("string")).otherwise("R").alias("position_text"))
    return rows.withColumns({"status": parse.race_status(F.col("text")), "final_position": parse.place(F.col("position_text"))})


def _documents(spark, sf_dir):
    """Write the nested documents once and read them back."""
    t = canonical.tables(spark, sf_dir)
    path = f"{canonical.store(spark, sf_dir)}/documents"
    key = (spark.sparkContext.applicationId, path)
    if key not in _written:
        stored.write_races(stored.documents(t.race, t.race_result, t.qualifying_result), path)
        _written.add(key)
    return stored.read_races(spark, path)


_written: set = set()


def _payloads(spark, sf_dir):
    """Service payloads made of the race tables, in parts of bounded size, written and read back."""
    t = canonical.tables(spark, sf_dir)
    path = f"{canonical.store(spark, sf_dir)}/payloads"
    key = (spark.sparkContext.applicationId, path)
    if key not in _written:
        ms = F.col("fastest_lap.time_ms")
        result = F.struct(
            "result_idx", F.struct(F.col("driver_id").alias("driverId")).alias("Driver"), F.struct(F.col("constructor_id").alias("constructorId")).alias("Constructor"),
            F.col("grid_position").cast("string").alias("grid"), F.when(F.col("finished"), F.col("final_position").cast("string")).otherwise("R").alias("position"),
            F.col("points").cast("string").alias("points"), F.when(F.col("finished"), "Finished").otherwise("Accident").alias("status"), F.col("laps_completed").cast("string").alias("laps"),
            F.struct(F.struct(F.format_string("%d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000).alias("time")).alias("Time")).alias("FastestLap"),
        )
        # entries are sent by race, as the join with the headers asks for, and lists are made where they are joined
        parts = t.race_result.repartition("race_id").groupBy("race_id", F.floor(F.col("result_idx") / stored.PART).alias("part")).agg(
            F.transform(F.array_sort(F.collect_list(result)), lambda x: x.dropFields("result_idx")).alias("Results")
        )
        race = parts.join(t.race.select("race_id", "season", "round", "circuit_id", "race_name", "race_date"), "race_id")
        body = F.struct(
            F.col("season").cast("string").alias("season"), F.col("round").cast("string").alias("round"), F.col("race_id").alias("raceName"),
            F.date_format("race_date", "yyyy-MM-dd").alias("date"), F.struct(F.col("circuit_id").alias("circuitId")).alias("Circuit"), "Results",
        )
        race.select(F.struct((F.col("part") * stored.PART).cast("string").alias("offset"), F.struct(F.array(body).alias("Races")).alias("RaceTable")).alias("MRData")).write.mode("overwrite").option("compression", "gzip").json(path)
        _written.add(key)
    return spark.read.schema(schemas.RACE_PAYLOAD).json(path)


def _payload_results(spark, sf_dir):
    rows = payloads.races(_payloads(spark, sf_dir))
    named = payloads.results(rows.withColumn("round", F.regexp_extract("raceName", r"(\d+)$", 1)))
    return named.withColumn("race_id", F.concat(F.lit("race_"), F.col("round").cast("string"))).withColumn("fastest_ms", F.col("fastest_lap.time_ms"))


def _times(t):
    """Qualifying times of the second source, some of them twice, and the codes of the drivers."""
    code = F.concat(F.lit("C"), F.substring_index("driver_id", "_", -1)).alias("driver_code")
    times = t.qualifying_result.select(
        "race_id", code, *[F.struct((F.lit(90000 + i) + F.col("position")).cast("long").alias("time_ms"), F.lit(1).alias("lap_number")).alias(f"q{i}") for i in (1, 2, 3)]
    )
    return times.unionByName(times.where(F.pmod(F.xxhash64("race_id"), F.lit(2)) == 0)), t.qualifying_result.select("driver_id", code).distinct()


def _laps(t):
    """Two laps of one driver code in every race."""
    lap = lambda more: F.struct((F.lit(70000) + F.col("distance") + more).cast("long").alias("time_ms"), F.lit(1).alias("lap_number"))
    return t.race.select("race_id", F.lit("DRI").alias("driver_code"), F.explode(F.array(lap(5), lap(0))).alias("lap"))


def _readings(t):
    return t.race.select("race_id", "reading").where(F.col("reading").isNotNull())


def _combined(t):
    return combine.fill_qualifying(t.qualifying_result, *_times(t)).select("race_id", "driver_id", *[F.col(f"q{i}.time_ms").alias(f"q{i}_ms") for i in (1, 2, 3)])


def _fastest(t):
    return combine.fill_fastest_laps(t.race_result, _laps(t)).select("race_id", "driver_id", F.col("fastest_lap.time_ms").alias("fastest_ms"))


def _collected(t):
    docs = combine.collected(t.race, t.race_result, t.qualifying_result, _readings(t), *_times(t), _laps(t))
    lap, first = F.array_min(F.transform("results", lambda r: r["fastest_lap"]["time_ms"])), F.array_min(F.transform("qualifying", lambda q: q["q1_time"]["time_ms"]))
    return docs.groupBy("race_id", "season", "round", "circuit_id", "weather.temperature").agg(
        F.sum(F.size("results")).alias("n_results"), F.sum(F.size("qualifying")).alias("n_qualifying"), F.min(lap).alias("fastest_ms"), F.min(first).alias("q1_ms")
    )


def _quarantined(spark, sf_dir):
    """Payload lines of which those of every thirteenth race are cut off, written and read back."""
    rows = _payloads(spark, sf_dir).select("MRData.*")
    path = f"{canonical.store(spark, sf_dir)}/payload_lines"
    key = (spark.sparkContext.applicationId, path)
    if key not in _written:
        text, k = F.to_json(F.struct(F.struct("*").alias("MRData"))), F.regexp_extract(F.col("RaceTable.Races")[0]["raceName"], r"(\d+)$", 1).cast("long")
        rows.select(F.when(k % 13 == 0, F.substring(text, F.lit(1), F.length(text) - 9)).otherwise(text)).write.mode("overwrite").text(path)
        _written.add(key)
    bad = payloads.quarantine(payloads.read_payloads(spark, path, lines=True))
    return bad.select(F.regexp_extract("_corrupt_record", '"raceName":"([^"]*)"', 1).alias("race_id")).distinct()


def _csv_rows(t):
    """Request rows as a CSV file would hold them, with faults sprinkled in by race number."""
    k = F.substring_index("race_id", "_", -1).cast("long")
    drivers = t.race_result.groupBy("race_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("result_idx", "driver_id", "grid_position"))), lambda x: x.dropFields("result_idx"))).alias("drivers")
    )
    rows = t.race.join(drivers, "race_id", "left")
    return rows.select(
        "race_id", F.when(k % 19 == 0, " ").otherwise(F.col("race_name")).alias("race_name"), F.when(k % 23 != 0, F.col("circuit_id")).alias("circuit"),
        F.when(k % 29 == 0, "someday").otherwise(F.date_format("race_date", "yyyy-MM-dd")).alias("date"),
        F.when(k % 31 == 0, "[").when(k % 37 == 0, "[]").otherwise(F.col("drivers")).alias("drivers"),
        F.when(k % 41 == 0, "{").when(k % 43 == 0, "[1]").otherwise(F.to_json("weather")).alias("weather"),
    )


def _requests(p):
    """Nested requests made of the predicted races, with faults sprinkled in by race number."""
    k = F.substring_index("race_id", "_", -1).cast("long")
    d = F.struct("list_no", "driver_id", F.when((k % 41 == 0) & (F.col("list_no") > 1), 1).otherwise(F.col("list_no")).cast("int").alias("grid_position"))
    lists = p.predictions.groupBy("race_id", "race_name", "circuit").agg(F.transform(F.array_sort(F.collect_list(d)), lambda x: x.dropFields("list_no")).alias("drivers"))
    repeated = F.concat("drivers", F.transform(F.slice("drivers", 1, 1), lambda x: x.withField("grid_position", F.lit(0).cast("int"))))
    return lists.select(
        "race_id", F.when(k % 19 == 0, " ").otherwise(F.col("race_name")).alias("race_name"), F.when(k % 23 != 0, F.col("circuit")).alias("circuit"),
        F.when(k % 29 != 0, F.when(k % 37 == 0, repeated).otherwise(F.col("drivers"))).alias("drivers"), F.when(k % 31 != 0, "fair").alias("weather"),
    )


def _batch(p):
    return prediction.batch(_requests(p), p.predictions, p.confidence)


def _lookup(p):
    """Entries that have an id, a name or both, and some without an entry."""
    kind = F.col("list_no") % 4
    entries = p.predictions.where(F.col("list_no") % 7 != 0).select(
        "race_id", F.col("list_no").alias("entry_no"), F.when(kind != 1, F.col("driver_id")).alias("driver_id"), F.when(kind != 2, F.col("driver_name")).alias("name"), F.col("grid").alias("grid_position")
    )
    again = entries.withColumns({"entry_no": F.col("entry_no") + 1000, "grid_position": F.lit(99)})
    return prediction.grid_lookup(p.predictions, entries.unionByName(again))


def _first_results(t):
    """Every second race lists its drivers twice."""
    twice = t.race_result.where(F.substring_index("race_id", "_", -1).cast("long") % 2 == 0).withColumns({"result_idx": F.col("result_idx") + 100000, "points": F.col("points") + 1})
    return form.first_results(t.race_result.unionByName(twice.select(*[F.col(c).cast(t.race_result.schema[c].dataType) for c in t.race_result.columns])))


_E = values.REQUEST_ERRORS
_C = "CAST(string_split(race_id, '_')[2] AS BIGINT)"
QUERIES = {
    "parse_lap_times": Query(
        on_tables(_lap_texts),
        """SELECT race_id, driver_id, CASE WHEN q1_ms % 11 = 0 THEN NULL WHEN q1_ms % 7 = 0 THEN q1_ms - q1_ms % 1000 WHEN q1_ms % 13 = 0 THEN q1_ms - q1_ms % 1000 + q1_ms % 10
          WHEN q1_ms % 17 = 0 THEN NULL ELSE q1_ms END AS time_ms FROM qualifying_result WHERE q1_ms IS NOT NULL""",
        "race_id:s driver_id:s time_ms:b",
    ),
    "parse_statuses": Query(
        on_tables(_status_texts),
        "SELECT race_id, driver_id, CASE WHEN status = 'finished' AND result_idx % 3 = 2 THEN 'dnf' ELSE status END AS status, final_position FROM race_result",
        "race_id:s driver_id:s status:s final_position:b",
    ),
    "payload_results": Query(
        _payload_results,
        "SELECT race_id, result_idx, season, driver_id, constructor_id, grid_position, final_position, points, fastest_ms, CASE WHEN finished THEN 'finished' ELSE 'dnf' END AS status, laps_completed FROM race_result",
        "race_id:s season:b result_idx:b driver_id:s constructor_id:s grid_position:b final_position:b points:d fastest_ms:b status:s laps_completed:b",
    ),
    "payload_headers": Query(
        lambda s, d: payloads.races(_payloads(s, d)).select(*payloads.race_key(), F.col("Circuit.circuitId").alias("circuit_id"), F.col("raceName").alias("race_id"),
            F.date_format(parse.race_time(F.col("date"), F.lit(None).cast("string")), "yyyy-MM-dd HH:mm").alias("race_date")).distinct(),
        "SELECT season, round, circuit_id, race_id, strftime(race_date, '%Y-%m-%d') || ' 00:00' AS race_date FROM race WHERE field_size > 0", "season:b round:b circuit_id:s race_id:s race_date:s",
    ),
    "stored_results": Query(
        lambda s, d: stored.result_rows(_documents(s, d)).withColumn("fastest_ms", F.col("fastest_lap.time_ms")),
        "SELECT * FROM race_result",
        "race_id:s season:b round:b result_idx:b driver_id:s constructor_id:s grid_position:b final_position:b points:d fastest_ms:b status:s laps_completed:b",
    ),
    "stored_qualifying": Query(
        lambda s, d: stored.qualifying_rows(_documents(s, d)).select("*", *[F.col(f"q{i}_time.time_ms").alias(f"q{i}_ms") for i in (1, 2, 3)]),
        "SELECT * FROM qualifying_result", "race_id:s season:b driver_id:s constructor_id:s position:b q1_ms:b q2_ms:b q3_ms:b",
    ),
    "stored_catalogue": Query(
        lambda s, d: stored.catalogue(_documents(s, d)),
        """SELECT season, round, race_id, circuit_id, race_name, strftime(race_date, '%Y-%m-%dT00:00:00') AS date, field_size AS num_drivers,
          (SELECT count(*) FROM qualifying_result q WHERE q.race_id = race.race_id) AS num_qualifying FROM race""",
        "season:b round:b race_id:s circuit_id:s race_name:s date:s num_drivers:b num_qualifying:b",
    ),
    "stored_retention": Query(
        lambda s, d: stored.keep_newest(_documents(s, d), 5).groupBy("season").agg(F.count_distinct("race_id").alias("races")),
        "SELECT season, count(*) AS races FROM race WHERE season IN (SELECT DISTINCT season FROM race ORDER BY season DESC LIMIT 5) GROUP BY 1", "season:b races:b",
    ),
    "collected_races": Query(
        on_tables(_collected),
        """SELECT r.race_id, r.season, r.round, r.circuit_id, temperature, field_size AS n_results, (SELECT count(*) FROM qualifying_result q WHERE q.race_id = r.race_id) AS n_qualifying,
          (SELECT min(coalesce(fastest_ms, 70000 + distance)) FROM race_result x WHERE x.race_id = r.race_id) AS fastest_ms,
          (SELECT min(coalesce(q1_ms, 90001 + position)) FROM qualifying_result q WHERE q.race_id = r.race_id) AS q1_ms FROM race r""",
        "race_id:s season:b round:b circuit_id:s temperature:d n_results:b n_qualifying:b fastest_ms:b q1_ms:b",
    ),
    "collected_quarantine": Query(_quarantined, f"SELECT race_id FROM race WHERE field_size > 0 AND {_C} % 13 = 0", "race_id:s"),
    "combined_qualifying_times": Query(
        on_tables(_combined),
        "SELECT race_id, driver_id, coalesce(q1_ms, 90001 + position) AS q1_ms, coalesce(q2_ms, 90002 + position) AS q2_ms, coalesce(q3_ms, 90003 + position) AS q3_ms FROM qualifying_result",
        "race_id:s driver_id:s q1_ms:b q2_ms:b q3_ms:b",
    ),
    "combined_fastest_laps": Query(
        on_tables(_fastest), "SELECT race_id, driver_id, coalesce(fastest_ms, 70000 + distance) AS fastest_ms FROM race_result JOIN race USING (race_id)", "race_id:s driver_id:s fastest_ms:b"
    ),
    "combined_weather": Query(
        on_tables(lambda t: combine.fill_weather(t.race, _readings(t)).select("race_id", "weather.*")),
        "SELECT * FROM race", "race_id:s temperature:d humidity:d pressure:d wind_speed:d wind_direction:b rainfall:l track_temp:d",
    ),
    "csv_request_errors": Query(
        on_tables(lambda t: requests.checked(_csv_rows(t)).where(F.col("errors").isNotNull())),
        f"""SELECT race_id, concat_ws('; ', CASE WHEN {_C} % 19 = 0 THEN 'race_name is required' END, CASE WHEN {_C} % 23 = 0 THEN 'circuit is required' END,
          CASE WHEN {_C} % 29 = 0 THEN 'date must be in valid date format' END, CASE WHEN {_C} % 31 = 0 THEN 'drivers must be valid JSON' WHEN {_C} % 37 = 0 OR field_size = 0 THEN 'drivers must be a non-empty JSON array' END,
          CASE WHEN {_C} % 41 = 0 THEN 'weather must be valid JSON' WHEN {_C} % 43 = 0 THEN 'weather must be a JSON object' END) AS errors FROM race
          WHERE {_C} % 19 = 0 OR {_C} % 23 = 0 OR {_C} % 29 = 0 OR {_C} % 31 = 0 OR {_C} % 37 = 0 OR {_C} % 41 = 0 OR {_C} % 43 = 0 OR field_size = 0""",
        "race_id:s errors:s",
    ),
    "csv_requests": Query(
        on_tables(lambda t: requests.requests(_csv_rows(t)).select("race_name", "circuit", F.date_format("race_date", "yyyy-MM-dd").alias("date"), F.explode("drivers").alias("d"), "weather").select("race_name", "circuit", "date", "d.driver_id", "d.grid_position", "weather.humidity")),
        f"""SELECT race_name, r.circuit_id AS circuit, strftime(r.race_date, '%Y-%m-%d') AS date, driver_id, grid_position, humidity FROM race r JOIN race_result x USING (race_id)
          WHERE {_C} % 19 <> 0 AND {_C} % 23 <> 0 AND {_C} % 29 <> 0 AND {_C} % 31 <> 0 AND {_C} % 37 <> 0 AND {_C} % 41 <> 0 AND {_C} % 43 <> 0""",
        "race_name:s circuit:s date:s driver_id:s grid_position:b humidity:d",
    ),
    "export_rows": predicted_query(
        lambda p: requests.export_rows(p.predictions, p.confidence),
        "SELECT race_id, race_name, circuit, strftime(race_date, '%Y-%m-%dT00:00:00') AS date, overall_confidence, list_no AS position, driver_id, driver_name, predicted_position, expected_points, confidence_score FROM prediction JOIN confidence USING (race_id)",
        "race_id:s race_name:s circuit:s date:s overall_confidence:d position:b driver_id:s driver_name:s predicted_position:b expected_points:d confidence_score:d",
    ),
    "export_json": predicted_query(
        lambda p: requests.as_json(p.predictions.select("race_id", "driver_id", "list_no", "predicted_position", "team", F.col("grip_level").alias("grip_level"))),
        """SELECT '{"race_id":"' || race_id || '","driver_id":"' || driver_id || '","list_no":' || list_no || ',"predicted_position":' || predicted_position || ',"team":"' || team || '","grip_level":null}' AS document FROM prediction""",
        "document:s",
    ),
    "batch_results": predicted_query(
        _batch,
        f"""WITH q AS (SELECT *, concat_ws('; ', CASE WHEN {_C} % 19 = 0 THEN '{_E[0]}' END, CASE WHEN {_C} % 23 = 0 THEN '{_E[1]}' END, CASE WHEN {_C} % 29 = 0 THEN '{_E[2]}' END,
            CASE WHEN {_C} % 29 <> 0 AND {_C} % 41 = 0 AND n_drivers > 1 THEN '{_E[3]}' END, CASE WHEN {_C} % 29 <> 0 AND {_C} % 37 = 0 THEN '{_E[4]}' END, CASE WHEN {_C} % 31 = 0 THEN '{_E[5]}' END) AS e
          FROM prediction JOIN confidence USING (race_id) WHERE list_no = 1)
        SELECT race_id, CASE WHEN {_C} % 23 <> 0 THEN circuit END AS circuit, CASE WHEN e = '' THEN overall_confidence ELSE 0 END AS confidence, CASE WHEN e = '' THEN driver_name END AS winner, nullif(e, '') AS error FROM q""",
        "race_id:s circuit:s confidence:d winner:s error:s",
    ),
    "request_lookup": predicted_query(
        _lookup, "SELECT race_id, driver_id, CASE WHEN list_no % 7 = 0 THEN list_no ELSE grid END AS request_grid FROM prediction", "race_id:s driver_id:s request_grid:b"
    ),
    "first_results": Query(
        on_tables(_first_results), "SELECT * FROM race_result", "race_id:s driver_id:s result_idx:b grid_position:b final_position:b points:d status:s"
    ),
    "display_labels": predicted_query(
        lambda p: p.predictions.select(
            "race_id", "driver_id", parse.confidence_text(F.col("confidence_score")).alias("level"), parse.overtaking_label(report.overtaking_factor(F.col("circuit"))).alias("label"),
            parse.percentage(F.element_at("probability_distribution", 1)).alias("percent"), parse.duration(F.col("list_no") * 37.5).alias("took"),
            *[c.alias(n) for n, c in parse.weather_summary(F.col("conditions"), F.col("air_temp"), F.col("humidity"), F.col("grip_level")).items()],
            F.element_at(parse.supporting_text(F.create_map(F.lit("predicted_position"), F.col("predicted_position").cast("double"), F.lit("confidence"), F.lit(0.5))), "predicted_position").alias("place_text"),
        ),
        f"""SELECT race_id, driver_id, CASE WHEN confidence_score > 0.8 THEN 'High' WHEN confidence_score > 0.6 THEN 'Medium' ELSE 'Low' END AS level,
          CASE WHEN 1.0::DOUBLE - {DIFFICULTY} > 0.7 THEN 'Easy' WHEN 1.0::DOUBLE - {DIFFICULTY} > 0.4 THEN 'Moderate' ELSE 'Difficult' END AS label,
          printf('%.1f%%', dist[1] * 100 + 2e-9) AS percent, CASE WHEN list_no * 37.5 < 60 THEN printf('%.0f seconds', list_no * 37.5::DOUBLE + 2e-9) WHEN list_no * 37.5 < 3600 THEN printf('%.1f minutes', list_no * 37.5::DOUBLE / 60 + 2e-9)
            ELSE printf('%.1f hours', list_no * 37.5::DOUBLE / 3600 + 2e-9) END AS took, CASE conditions WHEN 'dry' THEN 1 WHEN 'mixed' THEN 0.5 ELSE 0 END AS dryness,
          air_temp AS temperature, humidity, 0.9 AS grip, 'P' || predicted_position AS place_text FROM prediction""",
        "race_id:s driver_id:s level:s label:s percent:s took:s dryness:d temperature:d humidity:d grip:d place_text:s",
    ),
}
