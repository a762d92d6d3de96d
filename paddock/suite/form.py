"""Queries on rolling form and standings."""

from __future__ import annotations

from paddock.operators import form
from paddock.suite.base import Query, on_tables

_FRAMES = """
  rr AS (SELECT *, count(*) FILTER (WHERE finished) OVER (PARTITION BY driver_id ORDER BY start_no) AS ford,
                count(*) OVER (PARTITION BY driver_id) AS starts,
                CASE WHEN finished THEN final_position END AS pos FROM race_result)"""


def _win(n: int, key: str = "driver_id", order: str = "start_no") -> str:
    return f"WINDOW w AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _stats_sql(value: str, prefix: str, ordinal: str) -> str:
    return f"""count({value}) OVER w AS {prefix}_n, avg({value}) OVER w AS {prefix}_mean, quantile_cont({value}, 0.5) OVER w AS {prefix}_median,
      stddev_pop({value}) OVER w AS {prefix}_std, min({value}) OVER w AS {prefix}_min, max({value}) OVER w AS {prefix}_max,
      max({value}) OVER w - min({value}) OVER w AS {prefix}_range,
      CASE WHEN count({value}) OVER w >= 4 THEN quantile_cont({value}, 0.25) OVER w END AS {prefix}_q25,
      CASE WHEN count({value}) OVER w >= 4 THEN quantile_cont({value}, 0.75) OVER w END AS {prefix}_q75,
      CASE WHEN count({value}) OVER w >= 4 THEN quantile_cont({value}, 0.75) OVER w - quantile_cont({value}, 0.25) OVER w END AS {prefix}_iqr,
      CASE WHEN count({value}) OVER w >= 3 THEN regr_slope({value}, {ordinal}) OVER w END AS {prefix}_trend"""


_STAT_COLUMNS = (
    "{p}_mean:d {p}_median:d {p}_std:d {p}_min:d {p}_max:d {p}_range:d {p}_q25:d {p}_q75:d {p}_iqr:d {p}_trend:d"
)


def _position_sql(n: int) -> str:
    return f"""WITH {_FRAMES}
    SELECT * FROM (SELECT driver_id, race_id, starts, count(*) OVER w AS window_size, count(pos) OVER w / count(*) OVER w AS finish_rate,
      {_stats_sql('pos', 'position', 'ford')} FROM rr {_win(n)})
    WHERE starts >= 3 AND window_size >= 2 AND position_n > 0"""


QUERIES = {
    f"rolling_position_stats_{n}": Query(
        on_tables(lambda t, n=n: form.position_stats(t.race_result, n)),
        _position_sql(n),
        "driver_id:s race_id:s window_size:b position_n:b finish_rate:d " + _STAT_COLUMNS.format(p="position"),
    )
    for n in (3, 5, 10)
}
QUERIES["rolling_points_stats"] = Query(
    on_tables(lambda t: form.points_stats(t.race_result)),
    f"""WITH {_FRAMES}
    SELECT * FROM (SELECT driver_id, race_id, starts, count(*) OVER w AS window_size, sum(points) OVER w AS total_points,
      {_stats_sql('points', 'points', 'start_no')} FROM rr {_win(5)})
    WHERE starts >= 3 AND window_size >= 2""",
    "driver_id:s race_id:s window_size:b total_points:d " + _STAT_COLUMNS.format(p="points"),
)
QUERIES["rolling_consistency"] = Query(
    on_tables(lambda t: form.consistency(t.race_result)),
    f"""WITH {_FRAMES}
    SELECT * FROM (SELECT driver_id, race_id, starts, count(*) OVER w AS window_size, 1 / (1 + stddev_pop(pos) OVER w) AS position_consistency,
      count(pos) OVER w / count(*) OVER w AS finish_consistency,
      CASE WHEN avg(points) OVER w > 0 THEN stddev_pop(points) OVER w / avg(points) OVER w ELSE 'infinity'::DOUBLE END AS points_cv
      FROM rr {_win(5)})
    WHERE starts >= 3 AND window_size >= 2 AND position_consistency IS NOT NULL""",
    "driver_id:s race_id:s position_consistency:d finish_consistency:d points_cv:d",
)
QUERIES["rolling_trends"] = Query(
    on_tables(lambda t: form.trends(t.race_result)),
    f"""WITH {_FRAMES},
    lists AS (SELECT driver_id, race_id, starts, count(*) OVER w AS window_size, list(pos) FILTER (WHERE finished) OVER w AS places, list(points) OVER w AS pts,
      regr_slope(pos, ford) OVER w AS slope, regr_slope(points, start_no) OVER w AS points_trend FROM rr {_win(5)})
    SELECT driver_id, race_id, CASE WHEN len(places) >= 3 THEN -slope END AS position_trend, points_trend,
      CASE WHEN len(places) >= 4 THEN (places[1] + places[2]) / 2 - (places[-1] + places[-2]) / 2
           WHEN len(places) = 3 THEN places[1] - places[3] END AS position_momentum,
      CASE WHEN len(pts) >= 4 THEN (pts[-1] + pts[-2]) / 2 - (pts[1] + pts[2]) / 2 ELSE pts[3] - pts[1] END AS points_momentum
    FROM lists WHERE window_size >= 3""",
    "driver_id:s race_id:s position_trend:d points_trend:d position_momentum:d points_momentum:d",
)

_TEAM = f"""SELECT * FROM (SELECT constructor_id, race_id, count(*) OVER (PARTITION BY constructor_id) AS races, count(*) OVER w AS window_size,
      avg(total_points) OVER w AS avg_points_per_race, sum(total_points) OVER w AS window_points, stddev_pop(total_points) OVER w AS points_consistency,
      coalesce(avg(best_finish) OVER w, 20) AS best_avg_position, count(*) FILTER (WHERE best_finish <= 3) OVER w AS podium_races,
      count(*) FILTER (WHERE total_points > 0) OVER w AS points_scoring_races,
      sum(drivers_finished) OVER w / sum(total_drivers) OVER w AS reliability_rate, sum(drivers_finished) OVER w / count(*) OVER w AS avg_finishers_per_race,
      count(*) FILTER (WHERE drivers_finished = total_drivers) OVER w AS all_cars_finished,
      count(*) FILTER (WHERE drivers_finished = 0) OVER w AS no_car_finished,
      CASE WHEN count(*) OVER w >= 3 THEN regr_slope(total_points, race_no) OVER w ELSE 0 END AS points_trend,
      avg(best_finish) OVER w AS avg_best_position,
      avg(CASE WHEN best_finish <= 5 THEN 1.0 WHEN best_finish IS NOT NULL THEN 0.0 END) OVER w AS top5_rate,
      avg(CASE WHEN best_finish <= 3 THEN 1.0 WHEN best_finish IS NOT NULL THEN 0.0 END) OVER w AS podium_rate
    FROM constructor_race {_win(5, 'constructor_id', 'race_no')}) WHERE races >= 3 AND window_size >= 2"""
for _name, _cols in {
    "constructor_rolling_performance": "avg_points_per_race:d window_points:d points_consistency:d best_avg_position:d podium_races:b points_scoring_races:b",
    "constructor_rolling_reliability": "reliability_rate:d avg_finishers_per_race:d all_cars_finished:b no_car_finished:b",
    "constructor_rolling_competitiveness": "avg_points_per_race:d points_trend:d avg_best_position:d top5_rate:d podium_rate:d",
}.items():
    QUERIES[_name] = Query(
        on_tables(lambda t: form.constructor_form(t.constructor_race)),
        _TEAM,
        "constructor_id:s race_id:s window_size:b " + _cols,
    )

_CALENDAR = """
    seq AS (SELECT race_id, race_date, row_number() OVER (ORDER BY race_date, race_id) AS race_seq FROM race)"""
QUERIES["calendar_driver_form"] = Query(
    on_tables(lambda t: form.calendar_form(t.race_result, t.race)),
    f"""WITH {_CALENDAR},
    spread AS (SELECT driver_id, race_seq, race_seq + k AS upto_seq,
        CASE WHEN finished THEN greatest((21 - final_position) / 20, 0) * 0.7 + least(points / 25, 1) * 0.3 ELSE 0.1 END AS score
      FROM race_result JOIN seq USING (race_id), range(5) r(k)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY driver_id, upto_seq ORDER BY race_seq) - 1 AS i, count(*) OVER (PARTITION BY driver_id, upto_seq) AS n FROM spread)
    SELECT driver_id, e.race_id AS at_race_id, sum(score * (0.5 + 0.5 * i / greatest(n - 1, 1))) / sum(0.5 + 0.5 * i / greatest(n - 1, 1)) AS form,
      count(*) AS races_in_window
    FROM ranked JOIN seq e ON e.race_seq = upto_seq GROUP BY driver_id, e.race_id""",
    "driver_id:s at_race_id:s form:d races_in_window:b",
)
QUERIES["calendar_constructor_score"] = Query(
    on_tables(lambda t: form.calendar_constructor_score(t.race_result, t.race)),
    f"""WITH {_CALENDAR},
    spread AS (SELECT constructor_id, race_seq + k AS upto_seq, CASE WHEN finished THEN final_position END AS pos
      FROM race_result JOIN seq USING (race_id), range(5) r(k))
    SELECT constructor_id, e.race_id AS at_race_id, CASE WHEN count(pos) > 0 THEN greatest((21 - avg(pos)) / 20, 0) ELSE 0.1 END AS performance,
      count(*) AS results_count
    FROM spread JOIN seq e ON e.race_seq = upto_seq GROUP BY constructor_id, e.race_id""",
    "constructor_id:s at_race_id:s performance:d results_count:b",
)
QUERIES["latest_averages_and_lags"] = Query(
    on_tables(lambda t: form.last_values(t.race_result, "driver_id", "start_no", "points", (3, 5, 10), (1, 2, 3))),
    """WITH v AS (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY start_no DESC) - 1 AS age FROM race_result)
    SELECT driver_id, avg(points) FILTER (WHERE age < 3) AS rolling_avg_3, avg(points) FILTER (WHERE age < 5) AS rolling_avg_5,
      avg(points) FILTER (WHERE age < 10) AS rolling_avg_10, max(points) FILTER (WHERE age = 1) AS lag_1,
      max(points) FILTER (WHERE age = 2) AS lag_2, max(points) FILTER (WHERE age = 3) AS lag_3
    FROM v GROUP BY driver_id""",
    "driver_id:s rolling_avg_3:d rolling_avg_5:d rolling_avg_10:d lag_1:d lag_2:d lag_3:d",
)


def _latest(t):
    out = None
    for n in (3, 5, 10):
        place = form.latest(form.position_stats(t.race_result, n), ["position_mean", "position_std", "finish_rate"])
        names = {"position_mean": f"rolling_{n}_avg_position", "position_std": f"rolling_{n}_position_std", "finish_rate": f"rolling_{n}_finish_rate"}
        place = place.withColumnsRenamed(names).drop("start_no")
        out = place if out is None else out.join(place, "driver_id", "full_outer")
    return out


QUERIES["latest_rolling_form"] = Query(
    on_tables(_latest),
    "SELECT driver_id, " + ", ".join(
        f"p{n}.position_mean AS rolling_{n}_avg_position, p{n}.position_std AS rolling_{n}_position_std, p{n}.finish_rate AS rolling_{n}_finish_rate"
        for n in (3, 5, 10)
    ) + " FROM " + " FULL JOIN ".join(
        f"(SELECT driver_id, max_by(position_mean, start_no) AS position_mean, max_by(position_std, start_no) AS position_std, max_by(finish_rate, start_no) AS finish_rate "
        f"FROM ({_position_sql(n)}) s{n} JOIN (SELECT race_id, driver_id, start_no FROM race_result) USING (race_id, driver_id) GROUP BY driver_id) p{n}"
        + ("" if n == 3 else " USING (driver_id)")
        for n in (3, 5, 10)
    ),
    "driver_id:s " + " ".join(f"rolling_{n}_avg_position:d rolling_{n}_position_std:d rolling_{n}_finish_rate:d" for n in (3, 5, 10)),
)
for _entity in ("driver_id", "constructor_id"):
    QUERIES[f"standings_{_entity.removesuffix('_id')}"] = Query(
        on_tables(lambda t, e=_entity: form.standings(t.race_result, e)),
        f"""WITH cells AS (SELECT DISTINCT season, {_entity} FROM race_result), rounds AS (SELECT DISTINCT season, round FROM race_result),
        upto AS (SELECT c.season, r.round, c.{_entity}, sum(x.points) AS points
          FROM cells c JOIN rounds r ON r.season = c.season JOIN race_result x ON x.season = c.season AND x.{_entity} = c.{_entity} AND x.round <= r.round
          GROUP BY ALL)
        SELECT *, rank() OVER (PARTITION BY season, round ORDER BY points DESC) AS rank FROM upto""",
        f"season:b round:b {_entity}:s points:d rank:b",
    )
