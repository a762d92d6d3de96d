"""Block-wise computations equal plain ones, with one key holding most rows and tiny blocks."""

from __future__ import annotations

import random
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.operators import assembly, form, prediction
from paddock.plans.blocks import average_ranks, edge_rows, exact_quantiles, framed, number_rows, running, trailing
from paddock.plans.dominance import dominance_sums

R = random.Random(7)
ROWS = [("hot" if R.random() < 0.7 else f"k{R.randrange(5)}", R.randrange(40), i, float(R.randrange(-20, 20))) for i in range(600)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k string, day int, id int, v double").repartition(7).persist()


@pytest.fixture(scope="module")
def groups():
    out: dict = {}
    for k, day, i, v in sorted(ROWS, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(k, []).append((day, i, v))
    return out


@pytest.fixture(scope="module")
def numbered(rows):
    return number_rows(rows, ["k"], [F.col("day"), F.col("id")], F.col("day"), "no", "prior").persist()


def test_number_rows(numbered, groups):
    for r in numbered.collect():
        g = groups[r.k]
        assert g[r.no - 1][1] == r.id
        assert r.prior == sum(1 for x in g if x[0] < r.day)


def test_framed_across_blocks(numbered, groups):
    out = framed(
        numbered, ["k"], "no",
        {(-4, 0): {"m": lambda w: F.avg("v").over(w)}, (0, 2): {"ahead": lambda w: F.collect_list("v").over(w)}}, block=16,
    ).collect()
    assert len(out) == len(ROWS)
    for r in out:
        v = [x[2] for x in groups[r.k]]
        assert r.m == pytest.approx(mean(v[max(0, r.no - 5) : r.no]))
        assert r.ahead == v[r.no - 1 : r.no + 2]


def test_running_across_blocks(numbered, groups):
    out = running(numbered, ["k"], "no", {"s": F.col("v")}, {"m": F.when(F.col("v") > 15, F.struct("no", "v"))}, block=16).collect()
    assert len(out) == len(ROWS)
    for r in out:
        v = [x[2] for x in groups[r.k]][: r.no]
        assert r.s == pytest.approx(sum(v))
        last = [i + 1 for i, x in enumerate(v) if x > 15]
        assert (r.m.no if r.m else None) == (last[-1] if last else None)


def test_trailing_across_blocks(numbered, groups):
    out = trailing(numbered, ["k"], "no", (3, 10), [{"s": F.col("v")}], 16, {"v": 2}).collect()
    for r in out:
        v = [x[2] for x in groups[r.k]][: r.no]
        assert r.s - r.s_3 == pytest.approx(sum(v[-3:]))
        assert r.s - r.s_10 == pytest.approx(sum(v[-10:]))
        assert r.v_2 == (v[-3] if len(v) > 2 else None)


def test_edge_rows(numbered, groups):
    out = edge_rows(numbered, ["k"], "no", 3, block=16)
    got = {k: sorted(r.no for r in out.collect() if r.k == k and r.from_end <= 3) for k in groups}
    assert got == {k: list(range(max(1, len(g) - 2), len(g) + 1)) for k, g in groups.items()}


def test_quantiles_and_ranks(rows, groups):
    q = exact_quantiles(rows, ["k"], "v", {"q25": 0.25, "q50": 0.5}, F.floor(F.col("v") / 4))
    for r in q.collect():
        v = [x[2] for x in groups[r.k]]
        assert r.q25 == pytest.approx(np.percentile(v, 25))
        assert r.q50 == pytest.approx(np.percentile(v, 50))
    for r in average_ranks(rows, ["k"], "v", "rank", F.floor(F.col("v") / 4)).collect():
        v = [x[2] for x in groups[r.k]]
        assert r["rank"] == sum(x < r.v for x in v) + (sum(x == r.v for x in v) + 1) / 2


def test_dominance_sums(spark):
    points = [("hot" if i < 80 else "b", i, R.randrange(30), R.randrange(30), float(R.randrange(3))) for i in range(110)]
    df = spark.createDataFrame(points, "k string, id int, x int, y int, w double")
    got = {(r.k, r.id): r.w for r in dominance_sums(df, ["k"], "id", F.col("x"), F.col("y"), {"w": F.col("w")}, F.lit(30), block=8).collect()}
    for k, i, x, y, _ in points:
        want = sum(w for k2, _, x2, y2, w in points if k2 == k and x2 > x and y2 < y)
        assert got.get((k, i), 0.0) == want


def _results(spark, n=90):
    rows, points = [], {1: 25.0, 2: 18.0, 3: 15.0, 4: 12.0, 5: 10.0}
    for i in range(n):
        done = R.random() < 0.6
        place = R.randrange(1, 15) if done else 999
        rows.append(("hot", i + 1, i, place, done, points.get(place, 0.0)))
    return rows, spark.createDataFrame(rows, "driver_id string, start_no int, race_id int, final_position int, finished boolean, points double")


def test_rolling_state_across_blocks(spark):
    rows, df = _results(spark)
    got = {r.start_no: r for r in assembly.rolling_state(df, block=16).collect()}
    for i in range(3, len(rows) + 1):
        for n in (3, 5, 10):
            window = rows[max(0, i - n) : i]
            r = got[i]
            assert r[f"rolling_{n}_avg_points"] == pytest.approx(mean(x[5] for x in window))
            assert r[f"rolling_{n}_points_trend"] == pytest.approx(np.polyfit(range(len(window)), [x[5] for x in window], 1)[0], abs=1e-9)
            j = next((j for j in range(i, 1, -1) if any(x[4] for x in rows[max(0, j - n) : j])), None)
            if j:
                places = [x[3] for x in rows[max(0, j - n) : j] if x[4]]
                assert r[f"rolling_{n}_avg_position"] == pytest.approx(mean(places))
                assert r[f"rolling_{n}_position_std"] == pytest.approx(np.std(places), abs=1e-9)


def test_position_stats_across_blocks(spark):
    rows, df = _results(spark)
    for r in form.position_stats(df, 5, block=16).collect():
        places = [x[3] for x in rows[max(0, r.start_no - 5) : r.start_no] if x[4]]
        assert r.position_mean == pytest.approx(mean(places))
        assert r.position_median == pytest.approx(np.median(places))
        if len(places) >= 3:
            assert r.position_trend == pytest.approx(np.polyfit(range(len(places)), places, 1)[0], abs=1e-9)


def test_unique_positions_equal_bumping(spark):
    rows = []
    for race in range(40):
        n = R.randrange(1, 22)
        rows += [(f"r{race}", i, n, R.randrange(1, n + 1), 25) for i in range(n)]
    df = spark.createDataFrame(rows, "race_id string, result_idx int, n_drivers int, place int, lines int")
    got = {(r.race_id, r.result_idx): r.predicted_position for r in prediction.unique_positions(df, "place").collect()}
    for race in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == race), key=lambda r: (r[3], r[1]))
        used: set = set()
        for _, i, n, p, _ in mine:
            while p in used:
                p += 1
                if p > n:
                    p = n
                    break
            used.add(p)
            assert got[(race, i)] == p
