"""Operators on small hand-made inputs with known answers."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from paddock import schemas, values
from paddock.functions import parse, scores, transforms, weather
from paddock.operators import evaluation, form, head_to_head, prediction, quality, report, sessions, tracks
from paddock.plans.canonical import weather_or_default
from paddock.sources import combine, payloads, requests, stored


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("text", "ms"), [("1:31.447", 91447), ("1:31.4", 91004), ("1:31", 91000), ("", None), ("abc", None), ("1:xx.1", None)])
def test_lap_time(spark, text, ms):
    assert one(spark, ms=parse.lap_time_ms(F.lit(text))).ms == ms


@pytest.mark.parametrize(
    ("text", "status"), [("Finished", "finished"), ("1", "finished"), ("Disqualified", "disqualified"), ("Did not start", "dns"), ("Accident", "dnf"), ("+1 Lap", "dnf")]
)
def test_status(spark, text, status):
    assert one(spark, s=parse.race_status(F.lit(text))).s == status


def test_race_time_and_place(spark):
    r = one(spark, a=parse.race_time(F.lit("2024-03-02"), F.lit("15:00:00Z")).cast("string"), b=parse.race_time(F.lit("2024-03-02"), F.lit(None)).cast("string"), p=parse.place(F.lit("R")))
    assert (r.a, r.b, r.p) == ("2024-03-02 15:00:00", "2024-03-02 00:00:00", values.NOT_CLASSIFIED)


@pytest.mark.parametrize(("points", "place"), [(350, 1), (250, 2), (150, 4), (50, 8), (10, 10), (5, 16), (0, 20), (9.5, 11)])
def test_ladder(spark, points, place):
    assert one(spark, p=scores.championship_place(F.lit(float(points)))).p == place


@pytest.mark.parametrize(("t", "value"), [(25, 1.0), (-10, 0.0), (60, 0.0), (10, 0.5), (40, 0.5)])
def test_temperature(spark, t, value):
    assert one(spark, v=weather.temperature_optimality(F.lit(float(t)))).v == pytest.approx(value)


def test_place_distribution_and_points(spark):
    r = one(spark, d=scores.place_distribution(F.lit(3.0)), p=scores.expected_points(F.lit(2.5)), q=scores.expected_points(F.lit(10.5)))
    assert sum(r.d) == pytest.approx(1.0) and max(range(20), key=lambda i: r.d[i]) == 2
    assert (r.p, r.q) == (16.5, 0.0)


def test_weighted_form(spark):
    r = one(spark, a=scores.weighted_form(F.array(F.lit(0.4))), b=scores.weighted_form(F.array(F.lit(0.0), F.lit(1.0))))
    assert (r.a, r.b) == (pytest.approx(0.4), pytest.approx(1.0 / 1.5))


def test_place_range(spark):
    dist = [0.0, 0.0, 0.4, 0.3, 0.2, 0.1] + [0.0] * 14
    r = one(spark, **report.place_range(F.array(*[F.lit(x) for x in dist])))
    assert (r.range_min, r.range_max, r.most_likely) == (3, 6, 3)


def test_transforms(spark):
    df = spark.createDataFrame([(0.7, 100.0, 30.0, 1.0)], "recent_form double, track_experience double, temperature double, rainfall double")
    n = transforms.normalise(df).first()
    assert (n.recent_form, n.track_experience) == (0.7, 1.0) and n.temperature == pytest.approx(40 / 60)
    assert transforms.interactions(df).first().weather_interaction == 30.0
    assert transforms.polynomial(df, 3).first().temperature_poly_3 == pytest.approx(27000.0)
    b = transforms.binned(df).first()
    assert (b.recent_form_bin_2, b.track_experience_bin_2, b.track_experience_bin_0) == (1.0, 1.0, 0.0)


def test_one_hot_scalar_list_unknown(spark):
    df = spark.createDataFrame([("mercedes", ["dry", "wet"]), ("none", [])], "constructor_id string, weather_condition array<string>")
    a, b = transforms.one_hot(df).collect()
    assert a.constructor_id_mercedes == 1.0 and a.weather_condition_dry == a.weather_condition_wet == 1.0 and a.weather_condition_mixed == 0.0
    assert sum(b) == 0.0


def test_category_weights_sum():
    assert sum(values.CATEGORY_WEIGHTS.values()) == pytest.approx(1.0)


def test_series_statistics(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 100])] + [("b", 0, 1.0)], "k string, idx int, value double")
    assert [(r.k, r.idx) for r in sessions.outliers(df, "k").collect()] == [("a", 9)]
    assert {r.k: r.outlier_rate for r in sessions.outlier_summary(df, "k").collect()} == {"a": 0.1, "b": 0.0}
    t = {r.k: r for r in sessions.trend_features(df.where("value < 100"), "k").collect()}
    assert set(t) == {"a"} and t["a"].linear_trend == pytest.approx(1.0) and t["a"].momentum == pytest.approx(7.0)
    assert sessions.outliers(df, "k", "other").count() == 0


def test_metrics(spark):
    exact = [("m", float(t), float(p)) for t, p in zip((1, 2, 3, 4, 5), (1, 2, 4, 4, 5))]
    perfect = [("p", float(i), float(i)) for i in range(1, 11)]
    flat = [("c", float(i), 5.0) for i in range(1, 6)]
    got = {r.model: r for r in evaluation.core_metrics(spark.createDataFrame(exact + perfect + flat, "model string, y_true double, y_pred double")).collect()}
    assert got["m"].exact_pct == pytest.approx(80.0)
    assert got["p"].mae == 0.0 and got["p"].spearman_correlation == pytest.approx(1.0)
    assert got["c"].spearman_correlation == 0.0


def test_fill_never_overwrites(spark):
    lap = "struct<time_ms:bigint,lap_number:int>"
    q = spark.createDataFrame([("r", "hamilton", None, (2, 1), None)], f"race_id string, driver_id string, q1 {lap}, q2 {lap}, q3 {lap}")
    s = spark.createDataFrame([("r", "HAM", (90123, 1), (89456, 1), (88789, 1))], f"race_id string, driver_code string, q1 {lap}, q2 {lap}, q3 {lap}")
    codes = spark.createDataFrame([("hamilton", "HAM")], "driver_id string, driver_code string")
    r = combine.fill_qualifying(q, s, codes).first()
    assert (r.q1.time_ms, r.q2.time_ms, r.q3.time_ms) == (90123, 2, 88789)


def test_weather_defaults(spark):
    r = spark.range(1).select(weather_or_default(F.struct(*[F.lit(26.0 if n == "temperature" else None).alias(n) for n in values.DEFAULT_WEATHER])).alias("w")).first().w
    assert r.temperature == 26.0 and r.humidity == 60.0 and r.rainfall is False


def test_first_personal_best(spark):
    laps = spark.createDataFrame([("s", "HAM", 1, 92000, True), ("s", "HAM", 2, 91000, True), ("s", "HAM", 3, 90000, False)], "session_id string, driver_code string, lap_number int, lap_time_ms long, is_personal_best boolean")
    results = spark.createDataFrame([("s", "HAM", 1, 2)], "session_id string, driver_code string, q2_ms long, q3_ms long")
    assert sessions.qualifying_times(laps, results).first().q1_ms == 92000
    assert sessions.qualifying_times(laps, results, best=True).first().q1_ms == 91000


def _payload(tmp_path):
    (tmp_path / "a.json").write_text(
        '{"MRData": {"RaceTable": {"Races": [{"season": "2024", "round": "1", "raceName": "Bahrain Grand Prix", "date": "2024-03-02", "Circuit": {"circuitId": "bahrain"},'
        ' "Results": [{"Driver": {"driverId": "hamilton"}, "Constructor": {"constructorId": "mercedes"}, "grid": "2", "position": "1", "points": "25", "status": "Finished", "laps": "57",'
        ' "FastestLap": {"Time": {"time": "1:31.447"}}}, {"Driver": {"driverId": "x"}, "Constructor": {"constructorId": "y"}, "grid": "3", "position": "R", "points": "0", "status": "Accident", "laps": "3"}],'
        ' "QualifyingResults": [{"Driver": {"driverId": "hamilton"}, "Constructor": {"constructorId": "mercedes"}, "position": "1", "Q1": "1:32.123", "Q2": "1:31.456", "Q3": ""}]}]}}}'
    )
    (tmp_path / "b.json").write_text('{"MRData": {"RaceTable": {"Races": []}}}')
    (tmp_path / "c.json").write_text("{not json")
    return str(tmp_path)


def test_payloads(spark, tmp_path):
    raw = payloads.read_payloads(spark, _payload(tmp_path))
    races = payloads.races(raw)
    rows = payloads.results(races).orderBy("result_idx").collect()
    assert [(r.driver_id, r.final_position, r.status, r.finished) for r in rows] == [("hamilton", 1, "finished", True), ("x", 999, "dnf", False)]
    assert rows[0].fastest_lap.time_ms == 91447 and rows[1].fastest_lap is None
    q = payloads.qualifying(races).first()
    assert (q.q1.time_ms, q.q2.time_ms, q.q3) == (92123, 91456, None)
    h = payloads.headers(races).first()
    assert (h.season, h.circuit_id, h.weather.pressure) == (2024, "bahrain", 1013.25)
    assert payloads.quarantine(raw).count() == 1
    assert payloads.between(payloads.results(races), 2020, 2023).count() == 0


def test_standings_payload(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"MRData": {"StandingsTable": {"StandingsLists": [{"season": "2024", "round": "5", "DriverStandings": [{"position": "1", "points": "110.5", "wins": "3", "Driver": {"driverId": "d"}}]}]}}}'
    )
    r = payloads.standings(spark, str(tmp_path), "driver").first()
    assert (r.season, r.round, r.driver_id, r.points, r.wins) == (2024, 5, "d", 110.5, 3)
    with pytest.raises(ValueError):
        payloads.standings(spark, str(tmp_path), "team")


def test_documents_split_large_fields(spark, tmp_path):
    from paddock.plans import canonical

    t = canonical.tables(spark, "/root/testdata/sf0.001")
    docs = stored.documents(t.race, t.race_result, t.qualifying_result, part=3)
    assert docs.agg(F.max(F.size("results"))).first()[0] <= 3
    assert docs.agg(F.sum(F.size("results"))).first()[0] == t.race_result.count()
    path = str(tmp_path / "raw")
    stored.write_races(docs, path)
    assert stored.race(spark, path, 1, 1).count() == 0
    stats = stored.storage_statistics(spark, path).first()
    assert stats.documents == docs.count() and stats.megabytes > 0 and stats.seasons == sorted(stats.seasons)


def test_features_and_log(spark, tmp_path):
    root = str(tmp_path)
    assert stored.load_features(spark, root, "none") is None
    stored.save_features(spark.range(3), root, "f")
    assert stored.load_features(spark, root, "f").count() == 3
    log = spark.createDataFrame([("a", 0.5)], "race_name string, overall_confidence double")
    stored.append_log(log, f"{root}/log")
    stored.append_log(log, f"{root}/log")
    assert stored.confidence_over_time(stored.read_log(spark, f"{root}/log")).where("logged_at IS NOT NULL").count() == 2


def test_csv_requests(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        'race_name,circuit,date,drivers,weather\nA,Monaco,2024-05-26,"[{""driver_id"": ""VER"", ""grid_position"": 1}]","{""conditions"": ""dry""}"\n ,Spa,someday,"[]","[1]"\n'
    )
    rows = requests.checked(requests.read_csv(spark, str(tmp_path / "r.csv"))).collect()
    assert rows[0].errors is None
    assert rows[1].errors == "race_name is required; date must be in valid date format; drivers must be a non-empty JSON array; weather must be a JSON object"
    good = requests.requests(requests.read_csv(spark, str(tmp_path / "r.csv"))).first()
    assert good.drivers[0].driver_id == "VER" and good.weather.conditions == "dry"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "x string, y int")
    requests.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().x == "a"
    requests.write_json_export(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j/envelope")).first().total_predictions == 1
    assert requests.as_json(df).first().document == '{"x":"a","y":null}'


def test_request_errors(spark):
    rows = spark.createDataFrame(
        [("A", "Spa", [("x", 1), ("y", 1)], {"c": "dry"}), (" ", None, [], None)],
        "race_name string, circuit string, drivers array<struct<driver_id:string,grid_position:int>>, weather map<string,string>",
    )
    a, b = [r.e for r in rows.select(prediction.request_errors(rows).alias("e")).collect()]
    assert a == ["Duplicate grid positions detected"] and len(b) == 4


def test_duplicate_rules(spark):
    w = "struct<temperature:double,humidity:double,pressure:double,wind_speed:double,wind_direction:int,rainfall:boolean,track_temp:double>"
    race = spark.createDataFrame([("r", 2024, 1, "spa", "Spa GP", date(2024, 7, 1), (25.0, 160.0, 1013.25, 5.0, 180, False, 30.0), 20)],
                                 f"race_id string, season int, round int, circuit_id string, race_name string, race_date date, weather {w}, field_size int")
    results = spark.createDataFrame([("r", i, f"driver{i % 19}", "team", 1 + i, 1 + i % 18, True, 1.0, 57) for i in range(20)],
                                    "race_id string, result_idx int, driver_id string, constructor_id string, grid_position int, final_position int, finished boolean, points double, laps_completed int")
    lap = "struct<time_ms:bigint,lap_number:int>"
    q = spark.createDataFrame([("r", "driver0", "other", 1, (30000, 1), None, None)], f"race_id string, driver_id string, constructor_id string, position int, q1 {lap}, q2 {lap}, q3 {lap}")
    found = {r.message for r in quality.issues(race, results, q, date(2024, 12, 31)).collect()}
    assert {"Duplicate drivers found: 1", "Duplicate finishing positions: 2", "Invalid humidity: 160.00", "Unusual Q1 time: 30.000s"} <= found
    assert "Constructor mismatch for driver0: qualifying=other, race=team" in found
    assert quality.acceptance(quality.race_totals(race, results, q)).first().race_valid is False
    assert quality.summary(race, quality.issues(race, results, q, date(2024, 12, 31))).first().is_valid is False


def test_unknown_entity():
    with pytest.raises(ValueError):
        tracks.track_form("car", None, None)


def test_driver_list(spark):
    rows = prediction.driver_list(spark).collect()
    assert len(rows) == 20 and rows[0].season_points == 0


def test_few_starts_give_no_form(spark):
    df = spark.createDataFrame([("a", 1, 1, True, 25.0), ("a", 2, 2, True, 18.0)], "driver_id string, start_no int, final_position int, finished boolean, points double")
    assert form.position_stats(df).count() == 0


def test_head_to_head_needs_two_races(spark):
    rows = [(d, r, i, i, k, k + 1, 10.0 / (k + 1), True) for i, r in enumerate(("x", "y", "z")) for k, d in enumerate(("a", "b"))]
    results = spark.createDataFrame(rows, "driver_id string, race_id string, prior_starts int, start_no int, result_idx int, final_position int, points double, finished boolean")
    results = results.withColumns({"start_no": F.col("start_no") + 1, "race_date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("start_no"))})
    o = head_to_head.overall(head_to_head.key_pairs(results), results).collect()
    assert [(x.target_id, x.total_races, x.driver1_wins, x.driver1_win_percentage, x.points_advantage_driver1) for x in o] == [("z", 2, 2, 100.0, 10.0)]


def test_places_of_a_race_in_several_documents(spark, tmp_path):
    lap, weather = "named_struct('time_ms', cast(null as bigint), 'lap_number', cast(null as int))", schemas.WEATHER
    race = spark.sql(f"select 'r1' race_id, 2020 season, 1 round, 'c' circuit_id, 'n' race_name, timestamp'2020-01-01' race_date, cast(null as {weather}) weather")
    results = spark.sql(f"""select 'r1' race_id, cast(id as int) result_idx, concat('d', id) driver_id, 't' constructor_id, cast(id as int) grid_position, cast(id as int) final_position,
        0D points, {lap} fastest_lap, 'finished' status, 1 laps_completed from range(7)""")
    qualifying = spark.sql(f"select 'r1' race_id, cast(id + 1 as int) position, concat('d', id) driver_id, 't' constructor_id, {lap} q1, {lap} q2, {lap} q3 from range(7)")
    for part in (3, 5000):
        path = f"{tmp_path}/{part}"
        stored.write_races(stored.documents(race, results, qualifying, part), path)
        rows = stored.result_rows(stored.read_races(spark, path)).collect()
        assert sorted((r.result_idx, r.driver_id) for r in rows) == [(i, f"d{i}") for i in range(7)]


def test_second_source_does_not_repeat_rows(spark):
    lap = lambda ms: f"named_struct('time_ms', {ms}L, 'lap_number', 1)"
    results = spark.sql("select 'r' race_id, 'driver_1' driver_id, cast(null as struct<time_ms:bigint,lap_number:int>) fastest_lap")
    laps = spark.sql(f"select 'r' race_id, 'DRI' driver_code, {lap(5)} lap union all select 'r', 'DRI', {lap(3)}")
    assert [r.fastest_lap.time_ms for r in combine.fill_fastest_laps(results, laps).collect()] == [3]


def test_day_with_most_rows_is_cut(spark):
    rows = spark.range(3000).selectExpr("date_add(date'2020-01-01', cast(if(id % 10 = 0, id, 5) as int)) race_date", "concat('race_', id) race_id")
    block = evaluation.text_block(F.col("race_id"), 6)
    ordered = evaluation.time_order(rows, "race_date", "race_id", block=block).collect()
    assert [r.row_no for r in sorted(ordered, key=lambda r: (r.race_date, r.race_id))] == list(range(1, 3001))
    assert rows.groupBy("race_date", block).count().agg(F.max("count")).first()[0] <= 2


def test_duration_and_percentage(spark):
    r = spark.range(1).select(parse.duration(F.lit(12.4)), parse.duration(F.lit(90.0)), parse.duration(F.lit(5400.0)), parse.percentage(F.lit(0.256), 0)).first()
    assert tuple(r) == ("12 seconds", "1.5 minutes", "1.5 hours", "26%")
