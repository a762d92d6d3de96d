"""What goes through the shuffles of the derived tables and predictions."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from paddock.operators import head_to_head, prediction
from paddock.plans import canonical, training
from paddock.plans.blocks import number_rows
from paddock.plans.predictions import MODELS, long_predictions, predicted
from paddock.suite import evaluation as evaluation_suite

FOLDER = "/root/testdata/sf0.001"


def test_entrants_hold_keys_only(spark):
    canonical.tables(spark, FOLDER)
    stored = spark.read.parquet(f"{canonical.store(spark, FOLDER)}/entrant")
    assert set(stored.columns) == {"race_key", "driver_key", "score", "quantity", "retired", "s_nationkey", "race_date", "lines"}


def test_prior_rows_inside_a_chunk(spark):
    rows = spark.createDataFrame([("a", d, i) for i, d in enumerate([1, 1, 2, 11, 11, 12, 25])] + [("b", None, 0), ("b", 3, 1)], "k string, day int, id int")
    got = number_rows(rows, ["k"], [F.col("day"), F.col("id")], F.floor(F.col("day") / 10), "no", "prior", prior_of=F.col("day")).orderBy("k", "no").collect()
    assert [(r.no, r.prior) for r in got] == [(1, 0), (2, 0), (3, 2), (4, 3), (5, 3), (6, 5), (7, 6), (1, 0), (2, 1)]


def test_places_shuffle_wide_rows_once(spark):
    rows = spark.range(100).select(
        F.concat(F.lit("r"), F.col("id") % 5).alias("race_id"), F.col("id").cast("int").alias("result_idx"), F.lit(20).alias("n_drivers"),
        (F.col("id") % 7 + 1).cast("int").alias("place"), F.lit(20).alias("lines"), F.rand(1).alias("carried"),
    ).localCheckpoint()
    plan = prediction.unique_positions(rows, "place")._jdf.queryExecution().optimizedPlan().toString()
    # one window over the rows, two over counts of places
    assert plan.count("Window [row_number()") == 1 and plan.count("carried") > 0
    assert sum(line.count("Window [") for line in plan.splitlines()) <= 3


def test_confidence_of_models_side_by_side(spark):
    rows = predicted(spark, FOLDER).predictions
    want = {r.race_id: r for r in prediction.race_confidence(long_predictions(rows)).collect()}
    got = prediction.joint_confidence(rows, [f"m_{m}" for m in MODELS]).collect()
    assert len(got) == len(want) > 10
    for r in got:
        assert list(r)[1:] == pytest.approx(list(want[r.race_id])[1:])


def _exchanges(df):
    """Exchanges of the physical plan, with the columns that are sent."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]


def test_models_are_numbered_side_by_side(spark):
    p = predicted(spark, FOLDER)
    plan = evaluation_suite._folded(p)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert explode < next(i for i, line in enumerate(plan) if "row_number()" in line)
    assert not any("Join" in line for line in plan[:explode])


def test_training_rows_are_sent_once(spark):
    t = canonical.tables(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = _exchanges(training._matrix(t))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the count of rows by race is planned twice and done once
    assert sum("race_id" in line and "driver_id" in line for line in sent) <= 2
    assert len(sent) <= 12


def test_twins_are_a_join_of_entries_with_themselves(spark):
    rows = spark.createDataFrame([("r", "a", 1, True), ("r", "a", 2, True), ("r", "b", 3, True), ("r", "c", 4, False), ("s", "a", 5, True), ("s", "a", 6, False)], "race_id string, driver_id string, place int, ok boolean")
    got = sorted((x.race_id, x.driver_id, x.place, x.twin.place) for x in training.with_twins(rows, ["place"], "ok").collect())
    other = rows.where("ok").select("race_id", "driver_id", F.col("place").alias("seen"))
    assert got == sorted((x.race_id, x.driver_id, x.place, x.seen) for x in rows.join(other, ["race_id", "driver_id"]).collect())


def test_training_rows_are_numbered_in_time_order(spark):
    rows = training.matrix(spark, FOLDER).select("race_id", "driver_id", "race_date", "row_no", "test_fold", "tuning_fold", "is_test").collect()
    key = lambda r: (r.race_date, int(r.race_id.split("_")[1]), r.driver_id)
    assert [r.row_no for r in sorted(rows, key=key)] == list(range(1, len(rows) + 1))
    n = len(rows)
    assert {r.row_no for r in rows if r.is_test} == set(range(int(n * 0.8) + 1, n + 1))
    for name, k in (("test_fold", 5), ("tuning_fold", 3)):
        size = n // (k + 1)
        assert all(r[name] == max(0, -(-(r.row_no - (n - k * size)) // size)) for r in rows)


def test_pairs_are_dealt_once_without_long_careers(spark):
    t = canonical.tables(spark, FOLDER)
    pairs = head_to_head.key_pairs(t.race_result)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = [_exchanges(df) for df in (head_to_head.overall(pairs, t.race_result), head_to_head.rolling(pairs, t.race_result))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the common races are dealt once: by pair and block, or by pair with the pairs that are asked for
    assert sum("_block" in line for line in sent[0]) == 1
    assert sum("hashpartitioning(lo" in line and "hi" in line for line in sent[0]) <= 4
    assert not any("_block" in line or "_chunk" in line for line in sent[1])


def test_rows_without_a_date_do_not_count(spark):
    t = canonical.tables(spark, FOLDER)
    lost = F.substring_index("race_id", "_", -1).cast("int") % 5 == 0
    undated = lambda df: df.withColumn("race_date", F.when(~lost, F.col("race_date")))
    some = canonical.Tables(undated(t.race), undated(t.race_result), t.qualifying_result, t.constructor_race)
    rows = training._matrix(some).select("row_no", "test_fold").collect()
    n = t.race_result.where(~lost & F.col("finished")).count()
    assert sorted(r.row_no for r in rows) == list(range(1, n + 1))
    assert all((r.test_fold > 0) == (r.row_no > n - 5 * (n // 6)) for r in rows)
    p = predicted(spark, FOLDER)
    folded = evaluation_suite._folded(replace(p, predictions=undated(p.predictions))).select("row_no", "test_fold").distinct().collect()
    n = p.predictions.where(~lost).count()
    assert len(folded) == n and all((r.test_fold > 0) == (r.row_no > n - 5 * (n // 6)) for r in folded)
