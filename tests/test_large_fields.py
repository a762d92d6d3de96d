"""Places and ranks inside races of any size, which are always numbered in pieces."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paddock.operators import prediction, report
from paddock.plans import canonical

FOLDER = "/root/testdata/sf0.001"


def test_places_of_derived_races(spark):
    canonical.tables(spark, FOLDER)
    entry = spark.read.parquet(f"{canonical.store(spark, FOLDER)}/entry")
    over = lambda *order: F.row_number().over(Window.partitionBy("race_key").orderBy(*order))
    place = over("withdrawn", "retired", F.desc("score"), "driver_key")
    wrong = entry.withColumns({"a": place, "b": over(F.desc("quantity"), "driver_key")}).where("a <> place OR b <> slot")
    assert entry.count() > 1000 and wrong.count() == 0


def test_ranks_of_small_and_large_fields(spark):
    """One race with most rows, ties, and rows without a score or a place."""
    r = random.Random(4)
    rows = [
        ("big" if i % 10 else f"small_{i % 7}", i, None if i % 97 == 0 else r.choice([50.0, round(r.uniform(0, 300), 4)]), None if i % 89 == 0 else r.randrange(1, 30))
        for i in range(4000)
    ]
    field = spark.createDataFrame(rows, "race_id string, result_idx int, score double, place int").withColumns({"lines": F.lit(4000), "n_drivers": F.lit(4000)}).repartition(6)
    got = {(x.race_id, x.result_idx): x.predicted_position for x in prediction.score_ranking(field).collect()}
    listed = {(x.race_id, x.result_idx): (x.list_no, x.predicted_position) for x in prediction.unique_positions(field, "place").collect()}
    for race in {x[0] for x in rows}:
        here = [x for x in rows if x[0] == race]
        by_score = sorted(here, key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))
        assert [got[race, x[1]] for x in by_score] == list(range(1, len(here) + 1))
        last = 0
        for no, x in enumerate(sorted(here, key=lambda x: (x[3] or -1, x[1])), 1):
            if x[3]:
                last = max(x[3], last + 1)
                assert listed[race, x[1]][1] == min(4000, last)
            else:
                last = 0
            assert listed[race, x[1]][0] == no


def test_battles_of_small_and_large_fields(spark):
    r = random.Random(5)
    rows = [("big" if i % 10 else f"small_{i % 7}", f"d{i}", i, 4000, [r.choice([0.3, r.random()]), 0.0, 0.0]) for i in range(3000)]
    field = spark.createDataFrame(rows, "race_id string, driver_id string, list_no int, lines int, probability_distribution array<double>").repartition(6)
    got = {(x.race_id, x.driver_id): x.next_driver_id for x in report.podium_battles(field).collect()}
    want = {}
    for race in {x[0] for x in rows}:
        here = sorted((x for x in rows if x[0] == race and x[4][0] > 0.1), key=lambda x: (-x[4][0], x[2]))
        want |= {(race, a[1]): b[1] for a, b in zip(here, here[1:], strict=False) if a[4][0] - b[4][0] < 0.1 and a[4][0] > 0.2}
    assert got == want


class _Bare:
    """A session without a checkpoint folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:  # noqa: N801
        getCheckpointDir = staticmethod(lambda: None)
        master = "local[2]"


class _Cluster(_Bare):
    class sparkContext(_Bare.sparkContext):  # noqa: N801
        master = "spark://somewhere:7077"


def test_folder_of_session(spark):
    assert canonical.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert canonical.shared_folder(_Bare) == canonical.shared_folder(_Bare)
    with pytest.raises(ValueError):
        canonical.shared_folder(_Cluster)
