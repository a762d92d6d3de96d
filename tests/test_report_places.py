"""Places read off distributions, and hotspots and podium battles of races that are sent once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paddock.functions import scores
from paddock.operators import report
from paddock.plans.dominance import dominance_sums
from tests.test_fields import _both, _same
from tests.test_volume import _exchanges


def test_places_of_distributions(spark):
    r = random.Random(3)
    made = [[r.random() for _ in range(n)] for n in (1, 3, 20, 20, 33, 60)] + [[0.05] * 20, [0.2, 0.4, 0.4], [0.03] * 30 + [0.1], []]
    rows = [(i, [p / max(sum(d), 1e-9) for p in d] if i < 6 else d) for i, d in enumerate(made)]
    df = spark.createDataFrame(rows, "id int, probability_distribution array<double>")
    got = {x.id: x for x in df.select("id", report._head(3).alias("head"), *[c.alias(n) for n, c in report.place_range(F.col("probability_distribution")).items()]).collect()}
    for i, d in rows:
        order = sorted(range(len(d)), key=lambda k: (-d[k], k))
        used = [k + 1 for k in range(len(d)) if d[k] > 0.05] or [k + 1 for k in order[:3]]
        want = (min(used), max(used), order[0] + 1) if d else (None, None, None)
        assert (got[i].range_min, got[i].range_max, got[i].most_likely) == want
        assert got[i].head == pytest.approx(sum(d[:3]))


def test_distribution_of_a_place(spark):
    import math

    got = spark.createDataFrame([(p,) for p in (-3.0, 1.0, 7.25, 40.0)], "p double").select("p", scores.place_distribution(F.col("p")).alias("d")).collect()
    for x in got:
        raw = [math.exp((i - x.p) ** 2 * -0.125) for i in range(1, 21)]
        assert list(x.d) == pytest.approx([v / sum(raw) for v in raw])


def test_dominance_of_short_groups(spark):
    r = random.Random(4)
    rows = [(f"k{i % 7}", i, r.choice([None, *range(25)]), r.choice([None, *range(25)]), float(r.choice([0, 1, 3]))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, id int, x int, y int, w double").localCheckpoint()
    work = lambda short: dominance_sums(df, ["k"], "id", F.col("x"), F.col("y"), {"w": F.col("w")}, F.lit(25), one_block=short)
    got = {x.id: x.w for x in work(True).collect()}
    for i, (k, n, x, y, _) in enumerate(rows):
        want = sum(b[4] for b in rows if b[0] == k and None not in (x, y, b[2], b[3]) and b[2] > x and b[3] < y)
        assert got.get(n, 0.0) == want
    assert _same(work(True), work(False)) and len(_exchanges(work(True))) == 1


def test_sections_of_short_and_long_races(spark):
    # grids that differ from the prediction
    short, long = (p.withColumn("grid", (F.crc32(F.concat("race_id", "driver_id")) % 25 + 1).cast("int")) for p in _both(spark))
    near = lambda df: {tuple(x)[:2]: [v if not isinstance(v, float) else round(v, 9) for v in x] for x in df.collect()}
    hot = lambda p: near(report.overtaking_hotspots(p).select("race_id", "driver_id", "overtake_count", "total_probability"))
    assert hot(short) == hot(long) and len(hot(short)) > 10
    battles = lambda p: report.podium_battles(p).select("race_id", "driver_id", "next_driver_id", "closeness")
    assert _same(battles(short), battles(long)) and battles(short).count() > 0
