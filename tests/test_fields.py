"""Races of one piece are sent by race alone and give the same rows as those that are cut into pieces."""

from __future__ import annotations

import random
from glob import glob

from pyspark.sql import functions as F

from paddock import values
from paddock.operators import prediction, report
from paddock.plans import canonical
from paddock.plans.predictions import predicted
from paddock.sources import stored
from tests.test_volume import _exchanges

FOLDER = "/root/testdata/sf0.001"


def _same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def _both(spark):
    rows = predicted(spark, FOLDER).predictions
    return rows, rows.withColumn("lines", F.lit(5000))


def test_entries_of_short_and_long_races(spark):
    canonical.tables(spark, FOLDER)
    entrant = spark.read.parquet(f"{canonical.store(spark, FOLDER)}/entrant")
    long = canonical._entries(entrant.withColumn("_lines", F.col("lines")).withColumn("lines", F.lit(5000)))
    short, columns = canonical._entries(entrant), ["race_key", "driver_key", "place", "slot", "withdrawn"]
    assert _same(short.select(*columns), long.select(*columns))


def test_positions_of_short_and_long_races(spark):
    r = random.Random(8)
    rows = [(f"r{i % 9}", i, r.choice([None, *range(1, 30)])) for i in range(700)]
    field = spark.createDataFrame(rows, "race_id string, result_idx int, place int").withColumns({"lines": F.lit(90), "n_drivers": F.lit(60)})
    assert _same(prediction.field_positions(field, "place"), prediction.unique_positions(field, "place"))
    mixed = field.withColumn("lines", F.when(F.col("race_id") < "r4", 3))
    assert _same(prediction.field_positions(mixed, "place", 10).drop("lines"), prediction.unique_positions(field, "place").drop("lines"))


def test_reports_of_short_and_long_races(spark):
    short, long = _both(spark)
    for work in (
        lambda p: report.team_battles(p, 5).select("race_id", "driver_id", "next_driver_id", "next_at", "rank"),
        report.key_insights, report.advanced_insights,
        lambda p: prediction.closest_battles(p).select("race_id", "driver_id", "next_driver_id", "rank"),
    ):
        assert work(short).count() > 10 and _same(work(short), work(long))


def test_overtakes_of_short_and_long_races(spark):
    r = random.Random(6)
    rows = []
    for race in "abcdef":
        grid, place = r.sample(range(1, 31), 30), r.sample(range(1, 31), 30)
        rows += [(race, "Circuit Monza", f"d{i}", f"D{i}", place[i], place[i], r.choice([grid[i], grid[i], 20, None]), 0.8) for i in range(30)]
    short = spark.createDataFrame(
        rows, "race_id string, circuit string, driver_id string, driver_name string, list_no int, predicted_position int, grid int, confidence_score double"
    ).withColumn("lines", F.lit(40))
    long, bare = short.withColumn("lines", F.lit(5000)), short.drop("lines")
    found = report.likely_overtakes(short)
    assert found.count() == 30 and _same(found, report.likely_overtakes(long)) and _same(found, report.likely_overtakes(bare))
    want = []
    for race in "abcdef":
        here = [x for x in rows if x[0] == race and x[6] is not None]
        pairs = [(-min(0.9, (a[6] - a[5]) * 0.2 * (1 - values.OVERTAKING_DIFFICULTY.get("Monza", values.DEFAULT_DIFFICULTY))), a[4], b[4], a[2], b[2])
                 for a in here for b in here if a[6] - a[5] > 2 and b[6] < a[6] and b[5] > a[5]]
        want += [(race, i, x[3], x[4]) for i, x in enumerate(sorted(pairs)[:5], 1)]
    assert sorted((x.race_id, x["rank"], x.overtaker_id, x.target_id) for x in found.collect()) == want


def test_short_races_are_sent_once(spark):
    rows = predicted(spark, FOLDER).predictions
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = [_exchanges(df) for df in (report._team_battles(rows, 5, True), report._likely_overtakes(rows, 5, True), prediction.neighbours(rows, ["driver_id"], True))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [len(x) for x in sent] == [1, 2, 1]


def test_lookup_sends_requests_by_race_once(spark):
    p = spark.createDataFrame([("r", "a", "A", 1), ("r", "b", "B", 2), ("r", None, "C", 3), ("r", "d", None, 4), (None, "a", "A", 5), ("s", "a", "A", 6)], "race_id string, driver_id string, driver_name string, list_no int")
    e = spark.createDataFrame(
        [("r", 2, "a", None, 12), ("r", 1, "a", None, 11), ("r", 3, None, "A", 13), ("r", 9, None, "B", 19), ("r", 5, None, None, 15), (None, 6, "a", "A", 16), ("t", 7, "a", "A", 17)],
        "race_id string, entry_no int, driver_id string, name string, grid_position int",
    )
    found = prediction.grid_lookup(p, e)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert found.columns == [*p.columns, "request_grid"]
    assert sorted((x.list_no, x.request_grid) for x in found.collect()) == [(1, 11), (2, 19), (3, 3), (4, 4), (5, 5), (6, 6)]


def test_documents_send_entries_by_race_once(spark, tmp_path):
    t = canonical.tables(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = stored.documents(t.race, t.race_result, t.qualifying_result, 7)
        sent = _exchanges(docs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sent) == 2 and all(" part#" not in line for line in sent)
    stored.write_races(docs, str(tmp_path / "races"))
    assert glob(f"{tmp_path}/races/season=*/*.json.gz") and not glob(f"{tmp_path}/races/season=*/*.json")
    back = stored.read_races(spark, str(tmp_path / "races"))
    columns = ["race_id", "result_idx", "driver_id", "final_position", "points"]
    assert _same(stored.result_rows(back).select(*columns), t.race_result.select(*columns))
    assert stored.qualifying_rows(back).count() == t.qualifying_result.count()
