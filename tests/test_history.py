"""Weather history and field strength of every race against brute force, with a day and a driver that hold most rows."""

from __future__ import annotations

import datetime
import random
import statistics

import pytest

from paddock.operators import races

DAY = datetime.date(2020, 1, 1)


def calendar(seed):
    """Races on few days, one of which holds a third; repeated temperatures and one outlier; some without a reading."""
    r = random.Random(seed)
    days = sorted(r.sample(range(400), 40))
    rows = []
    for i in range(150):
        day = DAY + datetime.timedelta(days=days[20] if i % 3 == 0 else r.choice(days))
        t = None if i % 17 == 5 else 1e6 if i == 7 else round(r.uniform(-10, 30), r.choice([0, 2]))
        rows.append((f"race_{r.randrange(10**6)}", day, (t, r.uniform(0, 100), r.uniform(0, 60))))
    return list({x[0]: x for x in rows}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_weather(spark, seed):
    rows = calendar(seed)
    race = spark.createDataFrame(rows, "race_id string, race_date date, weather struct<temperature:double,humidity:double,wind_speed:double>").repartition(4)
    got = {x["race_id"]: x for x in races.weather_comparison(race).collect()}
    for race_id, day, (t, h, w) in rows:
        before = [x for _, d, x in rows if d < day]
        temps = [x[0] for x in before if x[0] is not None]
        if not temps:
            assert race_id not in got
            continue
        g = got[race_id]
        assert g["temp_percentile"] == pytest.approx(statistics.median(temps))
        assert g["temp_vs_avg"] == (None if t is None else pytest.approx(t - statistics.fmean(temps)))
        assert g["humidity_vs_avg"] == pytest.approx(h - statistics.fmean(x[1] for x in before))
        assert g["wind_vs_avg"] == pytest.approx(w - statistics.fmean(x[2] for x in before))


def test_median_of_many_values(spark, monkeypatch):
    """A tree of several levels gives the same medians."""
    r = random.Random(5)
    rows = [(DAY + datetime.timedelta(days=r.randrange(30)), r.choice([r.gauss(0, 1), 0.5, -0.0, 3.25])) for _ in range(1500)]
    monkeypatch.setattr(races, "_BITS", 3)
    df = spark.createDataFrame(rows, "day date, value double")
    got = {x["day"]: x["median"] for x in races.earlier_medians(df, "day", "value").collect()}
    want = {d: statistics.median(b) for d in {d for d, _ in rows} if (b := [v for e, v in rows if e < d])}
    assert got == pytest.approx(want)


def test_nothing(spark):
    race = spark.createDataFrame([], "race_id string, race_date date, weather struct<temperature:double,humidity:double,wind_speed:double>")
    results = spark.createDataFrame([], "race_id string, driver_id string, start_no int, constructor_id string")
    assert races.weather_comparison(race).count() == 0 == races.field_strength(race, results).count()


@pytest.mark.parametrize("last", [1, 4, 10])
def test_field_strength(spark, last):
    rows = calendar(3)
    order = sorted((d, i) for i, d, _ in rows)
    r = random.Random(9)
    drivers = [f"d{k}" for k in range(60)]
    fields = {i: ["hot", *r.sample(drivers, r.randrange(0, 9))] for _, i in order}  # one driver in every race
    starts, results = {}, []
    for _, i in order:
        for d in fields[i]:
            starts[d] = starts.get(d, 0) + 1
            results.append((i, d, starts[d], f"team{len(d) + starts[d] % 4}"))
    race = spark.createDataFrame([(i, d) for i, d, _ in rows], "race_id string, race_date date").repartition(3)
    table = spark.createDataFrame(results, "race_id string, driver_id string, start_no int, constructor_id string").repartition(5)
    got = {x["race_id"]: x for x in races.field_strength(race, table, last).collect()}
    for day, i in order:
        recent = [j for e, j in order if e < day][-last:]
        if not recent:
            assert i not in got
            continue
        size = len({d for j in recent for d in fields[j]})
        teams = len({t for j, _, _, t in results if j == i})
        assert (got[i]["field_size"], got[i]["constructor_diversity"], got[i]["championship_contenders"]) == (size, teams, min(size, 8))
