"""Queries on report sections and prediction history."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock import values
from paddock.operators import report
from paddock.suite.base import Query, on_tables, predicted_query

_POD, _PTS = "list_sum(dist[1:3])", "list_sum(dist[1:10])"
DIFFICULTY = "CASE string_split(circuit, ' ')[-1] " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.OVERTAKING_DIFFICULTY.items()) + f" ELSE {values.DEFAULT_DIFFICULTY} END"
_OVER = f"""o AS (SELECT *, least(0.9, (grid - predicted_position) * 0.2::DOUBLE * (1.0::DOUBLE - ({DIFFICULTY})::DOUBLE)) AS probability FROM prediction WHERE grid - predicted_position > 2),
  pairs AS (SELECT o.race_id, o.driver_id AS overtaker_id, o.driver_name AS overtaker_name, o.list_no AS a, b.driver_id AS target_id, b.driver_name AS target_name, b.list_no AS b, o.probability
    FROM o JOIN prediction b ON b.race_id = o.race_id AND b.grid < o.grid AND b.predicted_position > o.predicted_position)"""
_TOP = "SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY probability DESC, a, b) AS rank FROM pairs QUALIFY rank <= 5"
_NEXT = """nb AS (SELECT *, lead(driver_id) OVER w AS nd, lead(driver_name) OVER w AS nn, lead(predicted_position) OVER w AS np, lead(confidence_score) OVER w AS nc
  FROM prediction WINDOW w AS (PARTITION BY race_id ORDER BY list_no))"""
def _text(kind: str, *args: str) -> str:
    """printf of an insight text; doubles get a nudge, so that both engines round ties up."""
    return f"printf('{values.INSIGHT_TEXTS[kind]}', {', '.join(args)})"


def _data(**pairs: str) -> str:
    return "concat_ws(';', " + ", ".join(f"'{k}=' || {v}" for k, v in sorted(pairs.items())) + ")"


def _n(x: str) -> str:
    return f"printf('%.4f', ({x})::DOUBLE + 2e-9)"


_KEY = f"""{_NEXT}, key_insights AS (
  SELECT race_id, 'winner' AS insight_type, driver_name || ' Predicted to Win' AS title, {_text('winner', 'driver_name', 'confidence_score + 2e-9', 'predicted_position', 'expected_points')} AS description,
    confidence_score AS confidence, driver_id AS drivers, {_data(predicted_position='predicted_position', expected_points=_n('expected_points'), win_probability=_n('dist[1]'))} AS data FROM prediction WHERE list_no = 1
  UNION ALL SELECT race_id, 'surprise', 'Surprise Performance: ' || driver_name, {_text('surprise', 'driver_name', "CASE WHEN grid > predicted_position THEN 'outperform' ELSE 'underperform' END", 'grid', 'predicted_position')},
    confidence_score, driver_id, {_data(grid_position='grid', predicted_position='predicted_position', position_change='(grid - predicted_position)', surprise_type="CASE WHEN grid > predicted_position THEN 'positive' ELSE 'negative' END")}
    FROM prediction WHERE abs(grid - predicted_position) > 5
  UNION ALL SELECT race_id, 'weather', 'Weather Impact on Race', {_text('weather', 'humidity::DOUBLE + 2e-9')}, 0.8, '',
    {_data(conditions='conditions', humidity=_n('humidity'), track_temp=_n('track_temp'), grip_level="'1.0000'")} FROM prediction WHERE list_no = 1 AND conditions <> 'dry'
  UNION ALL (SELECT race_id, 'battle', 'Close Battle: ' || driver_name || ' vs ' || nn, {_text('battle', 'driver_name', 'predicted_position::DOUBLE', 'nn', 'np::DOUBLE')}, least(confidence_score, nc), driver_id || ',' || nd,
    {_data(driver1_position='predicted_position', driver2_position='np', position_difference='abs(np - predicted_position)', combined_confidence=_n('(confidence_score + nc) / 2'))} FROM nb WHERE abs(np - predicted_position) < 1.5
    QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY list_no) = 1))"""
_TEAM = """conf AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY list_no) AS at FROM prediction WHERE confidence_score > 0.7),
  tb AS (SELECT a.race_id, a.driver_id, a.driver_name, a.confidence_score AS c1, a.predicted_position AS p1, a.expected_points AS e1, a.at, b.at AS next_at, b.driver_id AS next_driver_id,
      b.driver_name AS next_driver_name, b.confidence_score AS c2, b.predicted_position AS p2, b.expected_points AS e2
    FROM conf a JOIN conf b ON a.race_id = b.race_id AND a.at < b.at AND abs(a.predicted_position - b.predicted_position) < 3
    QUALIFY row_number() OVER (PARTITION BY a.race_id ORDER BY a.at, b.at) <= %d)"""
_ADVANCED = f"""{_OVER}, topo AS ({_TOP}), {_TEAM % 2}, advanced AS (
  SELECT race_id, 'championship' AS insight_type, 'Championship Impact' AS title, {_text('championship', 'driver_name')} AS description, 0.8 AS confidence, driver_id AS drivers,
    {_data(expected_points=_n('expected_points'), position='predicted_position')} AS data FROM prediction WHERE list_no = 1 AND expected_points > 20
  UNION ALL SELECT race_id, 'team_battle', 'Intra-Team Battle: ' || driver_name || ' vs ' || next_driver_name, {_text('team_battle', 'driver_name', 'p1', 'next_driver_name', 'p2')}, least(c1, c2), driver_id || ',' || next_driver_id,
    {_data(position_gap='abs(p1 - p2)', points_difference=_n('abs(e1 - e2)'))} FROM tb
  UNION ALL SELECT race_id, 'rookie_performance', 'Impressive Rookie Performance: ' || driver_name, {_text('rookie_performance', 'driver_name', 'predicted_position')}, confidence_score, driver_id,
    {_data(predicted_position='predicted_position', expected_points=_n('expected_points'))} FROM prediction
    WHERE predicted_position <= 8 AND confidence_score > 0.7 AND contains(lower(driver_name), 'rookie')
  UNION ALL SELECT race_id, 'strategy', 'Key Strategic Opportunity', {_text('strategy', 'overtaker_name', 'probability * 100 + 2e-9', 'target_name')}, probability, overtaker_id || ',' || target_id,
    {_data(overtaker_id='overtaker_id', overtaker_name='overtaker_name', target_id='target_id', target_name='target_name', probability=_n('probability'))} FROM topo WHERE rank = 1)"""
_STATS = """SELECT race_id, count(*) AS total_drivers, avg(predicted_position) AS mean_position, stddev_pop(predicted_position) AS position_spread, median(predicted_position) AS median_position,
  sum(expected_points) AS total_expected_points, avg(expected_points) AS mean_expected_points, count(*) FILTER (WHERE expected_points > 0) AS points_scoring_drivers,
  avg(confidence_score) AS mean_confidence, stddev_pop(confidence_score) AS confidence_spread, count(*) FILTER (WHERE confidence_score > 0.8) AS high_confidence_predictions,
  count(*) FILTER (WHERE confidence_score < 0.5) AS low_confidence_predictions, any_value(overall_confidence) AS overall_confidence,
  CASE WHEN any_value(overall_confidence) > 0.8 THEN 'high' WHEN any_value(overall_confidence) > 0.6 THEN 'medium' ELSE 'low' END AS prediction_certainty
  FROM prediction JOIN confidence USING (race_id) GROUP BY race_id"""
_STATS_COLUMNS = (
    "total_drivers:b mean_position:d position_spread:d median_position:d total_expected_points:d mean_expected_points:d points_scoring_drivers:b "
    "mean_confidence:d confidence_spread:d high_confidence_predictions:b low_confidence_predictions:b overall_confidence:d prediction_certainty:s"
)
_INFO = """SELECT race_id, race_name, circuit, strftime(race_date, '%Y-%m-%d') AS date, 'race' AS session_type, conditions AS weather_conditions, 'ensemble' AS prediction_model, overall_confidence
  FROM prediction JOIN confidence USING (race_id) WHERE list_no = 1"""
_INFO_COLUMNS = "race_id:s race_name:s circuit:s date:s session_type:s weather_conditions:s prediction_model:s overall_confidence:d"
_LOG = """log AS (SELECT race_id, race_name, circuit, season, race_date, driver_name AS winner, confidence_score AS winner_confidence, expected_points AS winner_points, n_drivers AS total_drivers, overall_confidence
  FROM prediction JOIN confidence USING (race_id) WHERE list_no = 1)"""
_STRENGTH = """list_filter([CASE WHEN confidence_score > 0.8 THEN 'Strong overall performance indicators' END,
  CASE WHEN expected_points > 15 THEN 'Excellent championship position potential' WHEN expected_points > 8 THEN 'Good points scoring opportunity' END,
  CASE WHEN predicted_position <= 3 THEN 'Podium contender' WHEN predicted_position <= 6 THEN 'Top 6 finish likely' WHEN predicted_position <= 10 THEN 'Points finish expected' END], lambda x: x IS NOT NULL)"""
_RISK = """list_filter([CASE WHEN confidence_score < 0.5 THEN 'High prediction uncertainty' WHEN confidence_score < 0.7 THEN 'Moderate prediction uncertainty' END,
  CASE WHEN predicted_position > 15 THEN 'Risk of non-finish' WHEN predicted_position > 10 THEN 'Outside points positions' END,
  CASE WHEN expected_points < 1 THEN 'Low points scoring probability' END], lambda x: x IS NOT NULL)"""
_RANGE = """list_filter(range(1, 21), lambda i: dist[i] > 0.05)"""


def _flat(insights):
    """Insights with drivers and supporting data as text."""
    pairs = F.transform(F.array_sort(F.map_entries("supporting_data")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return insights.withColumn("drivers", F.array_join("drivers_involved", ",")).withColumn("data", F.array_join(pairs, ";"))


_INSIGHT_COLUMNS = "race_id:s insight_type:s title:s description:s confidence:d drivers:s data:s"


def _joined(df, *names):
    return df.withColumns({n: F.array_join(n, ",") for n in names})


def _log(p):
    return report.prediction_log(p.predictions, p.confidence)


QUERIES = {
    "report_predictions": predicted_query(
        lambda p: _joined(report.formatted(p.predictions), "key_strengths", "risk_factors"),
        f"""SELECT *, {_POD} AS podium_probability, {_PTS} AS points_probability, list_min(places) AS range_min, list_max(places) AS range_max,
          list_position(dist, list_max(dist)) AS most_likely, array_to_string({_STRENGTH}, ',') AS key_strengths, array_to_string({_RISK}, ',') AS risk_factors
        FROM (SELECT *, CASE WHEN len({_RANGE}) > 0 THEN {_RANGE} ELSE list_transform(list_reverse_sort(list_zip(dist, list_transform(range(1, 21), lambda i: -i)))[1:3], lambda x: -x[2]) END AS places FROM prediction)""",
        "race_id:s driver_id:s list_no:b predicted_position:b podium_probability:d points_probability:d range_min:b range_max:b most_likely:b key_strengths:s risk_factors:s",
    ),
    "report_podium": predicted_query(
        lambda p: report.podium_candidates(p.predictions),
        f"SELECT race_id, driver_id, {_POD} AS podium_probability, row_number() OVER (PARTITION BY race_id ORDER BY {_POD} DESC, list_no) AS podium_rank FROM prediction QUALIFY podium_rank <= 3",
        "race_id:s driver_id:s podium_probability:d podium_rank:b",
    ),
    "report_podium_battles": predicted_query(
        lambda p: report.podium_battles(p.predictions),
        f"""SELECT *, probability - next_probability AS closeness FROM (SELECT race_id, driver_id, {_POD} AS probability, lead(driver_id) OVER w AS next_driver_id, lead({_POD}) OVER w AS next_probability
          FROM prediction WINDOW w AS (PARTITION BY race_id ORDER BY {_POD} DESC, list_no)) WHERE probability - next_probability < 0.1 AND probability > 0.2""",
        "race_id:s driver_id:s next_driver_id:s probability:d next_probability:d closeness:d",
    ),
    "report_podium_surprises": predicted_query(
        lambda p: report.podium_surprises(p.predictions),
        f"SELECT race_id, driver_id, predicted_position, {_POD} AS podium_probability FROM prediction WHERE predicted_position > 6 AND {_POD} > 0.15",
        "race_id:s driver_id:s predicted_position:b podium_probability:d",
    ),
    "report_overtakes": predicted_query(
        lambda p: report.likely_overtakes(p.predictions), f"WITH {_OVER} {_TOP}", "race_id:s rank:b overtaker_id:s target_id:s probability:d"
    ),
    "report_overtaking_hotspots": predicted_query(
        lambda p: report.overtaking_hotspots(p.predictions),
        f"WITH {_OVER} SELECT race_id, target_id AS driver_id, count(*) AS overtake_count, sum(probability) AS total_probability FROM pairs GROUP BY ALL HAVING count(*) > 1",
        "race_id:s driver_id:s overtake_count:b total_probability:d",
    ),
    "report_key_insights": predicted_query(
        lambda p: _flat(report.key_insights(p.predictions)), f"WITH {_KEY} SELECT * FROM key_insights", _INSIGHT_COLUMNS,
    ),
    "report_advanced_insights": predicted_query(
        lambda p: _flat(report.advanced_insights(p.predictions)), f"WITH {_ADVANCED} SELECT * FROM advanced", _INSIGHT_COLUMNS,
    ),
    "report_team_battles": predicted_query(
        lambda p: report.team_battles(p.predictions), f"WITH {_TEAM % 2} SELECT * FROM tb", "race_id:s driver_id:s next_driver_id:s next_at:b"
    ),
    "report_team_battles_first_5": predicted_query(
        lambda p: report.team_battles(p.predictions, 5), f"WITH {_TEAM % 5} SELECT * FROM tb", "race_id:s driver_id:s next_driver_id:s next_at:b"
    ),
    "report_insight_summary": predicted_query(
        lambda p: report.insight_summary(report.key_insights(p.predictions).unionByName(report.advanced_insights(p.predictions))),
        f"""WITH {_KEY}, {_ADVANCED} SELECT insight_type, count(*) AS n, avg(confidence) AS mean_confidence, count(*) FILTER (WHERE confidence > 0.8) AS high_confidence
          FROM (SELECT * FROM key_insights UNION ALL SELECT * FROM advanced) GROUP BY 1""",
        "insight_type:s n:b mean_confidence:d high_confidence:b",
    ),
    "report_insight_phases": predicted_query(
        lambda p: report.key_insights(p.predictions).groupBy("race_id", report.race_phase(F.col("description")).alias("phase")).agg(F.count(F.lit(1)).alias("n")),
        f"""WITH {_KEY} SELECT race_id, CASE WHEN contains(lower(description), 'start') OR contains(lower(description), 'early') THEN 'start' WHEN contains(lower(description), 'strategy') OR contains(lower(description), 'pit') THEN 'middle'
          WHEN contains(lower(description), 'late') OR contains(lower(description), 'final') THEN 'end' ELSE 'general' END AS phase, count(*) AS n FROM key_insights GROUP BY ALL""",
        "race_id:s phase:s n:b",
    ),
    "report_statistics": predicted_query(lambda p: report.statistics(p.predictions, p.confidence), _STATS, f"race_id:s {_STATS_COLUMNS}"),
    "report_confidence_distribution": predicted_query(
        lambda p: report.confidence_distribution(p.predictions),
        """SELECT race_id, count(*) FILTER (WHERE c > 0.8) AS high_count, count(*) FILTER (WHERE c > 0.8) * 100 / count(*) AS high_percentage, coalesce(avg(c) FILTER (WHERE c > 0.8), 0) AS high_average,
          count(*) FILTER (WHERE c BETWEEN 0.5 AND 0.8) AS medium_count, count(*) FILTER (WHERE c BETWEEN 0.5 AND 0.8) * 100 / count(*) AS medium_percentage,
          coalesce(avg(c) FILTER (WHERE c BETWEEN 0.5 AND 0.8), 0) AS medium_average, count(*) FILTER (WHERE c < 0.5) AS low_count, count(*) FILTER (WHERE c < 0.5) * 100 / count(*) AS low_percentage,
          coalesce(avg(c) FILTER (WHERE c < 0.5), 0) AS low_average, avg(c) AS mean_confidence, var_pop(c) AS confidence_variance, min(c) AS min_confidence, max(c) AS max_confidence,
          count(*) FILTER (WHERE c > 0.8) > count(*) * 0.6 AS consistent_predictions, count(*) FILTER (WHERE c < 0.5) > count(*) * 0.3 AS uncertain_predictions,
          CASE WHEN avg(c) > 0.75 THEN 'high' WHEN avg(c) > 0.5 THEN 'medium' ELSE 'low' END AS prediction_reliability
        FROM (SELECT race_id, confidence_score AS c FROM prediction) GROUP BY race_id""",
        "race_id:s high_count:b high_percentage:d high_average:d medium_count:b medium_percentage:d medium_average:d low_count:b low_percentage:d low_average:d "
        "mean_confidence:d confidence_variance:d min_confidence:d max_confidence:d consistent_predictions:l uncertain_predictions:l prediction_reliability:s",
    ),
    "report_header": predicted_query(lambda p: report.race_info(p.predictions, p.confidence), _INFO, _INFO_COLUMNS),
    "report_full": predicted_query(
        lambda p: report.race_report(p.predictions, p.confidence),
        f"""WITH {_OVER}, topo AS ({_TOP}), {_KEY}, pod AS (SELECT *, {_POD} AS pp FROM prediction),
        near AS (SELECT *, lead(driver_id) OVER w AS nd2, lead(pp) OVER w AS np2 FROM pod WINDOW w AS (PARTITION BY race_id ORDER BY pp DESC, list_no))
        SELECT race_id, 'race_info' AS section, 0 AS ordinal, race_name AS subject, overall_confidence AS value FROM ({_INFO})
        UNION ALL SELECT race_id, 'position_predictions', list_no, driver_id, pp FROM pod
        UNION ALL SELECT race_id, 'podium_candidates', row_number() OVER (PARTITION BY race_id ORDER BY pp DESC, list_no) AS r, driver_id, pp FROM pod QUALIFY r <= 3
        UNION ALL SELECT race_id, 'podium_battles', 0, driver_id || '/' || nd2, pp - np2 FROM near WHERE pp - np2 < 0.1 AND pp > 0.2
        UNION ALL SELECT race_id, 'podium_surprises', predicted_position, driver_id, pp FROM pod WHERE predicted_position > 6 AND pp > 0.15
        UNION ALL SELECT race_id, 'likely_overtakes', rank, overtaker_id || '/' || target_id, probability FROM topo
        UNION ALL SELECT race_id, 'overtaking_hotspots', count(*), target_id, sum(probability) FROM pairs GROUP BY race_id, target_id HAVING count(*) > 1
        UNION ALL SELECT race_id, 'key_insights', 0, title, confidence FROM key_insights
        UNION ALL SELECT race_id, 'statistical_summary', total_drivers, prediction_certainty, mean_position FROM ({_STATS})
        UNION ALL SELECT race_id, 'confidence_analysis', count(*) FILTER (WHERE confidence_score > 0.8), CASE WHEN avg(confidence_score) > 0.75 THEN 'high' WHEN avg(confidence_score) > 0.5 THEN 'medium' ELSE 'low' END, avg(confidence_score)
          FROM prediction GROUP BY race_id""",
        "race_id:s section:s ordinal:b subject:s value:d",
    ),
    "report_notable_drivers": predicted_query(
        lambda p: report.notable_drivers(p.predictions),
        f"""SELECT race_id, driver_id, reason FROM (
          SELECT race_id, driver_id, list_no, 0 AS no, '{values.NOTABLE_REASONS[0]}' AS reason FROM prediction WHERE confidence_score > 0.9 AND list_no > 1
          UNION ALL SELECT race_id, driver_id, list_no, 1, '{values.NOTABLE_REASONS[1]}' FROM prediction WHERE {_POD} > 0.3 AND predicted_position > 5)
          QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY list_no, no) <= 3""",
        "race_id:s driver_id:s reason:s",
    ),
    "report_place_matrix": predicted_query(
        lambda p: p.predictions.where(F.col("list_no") <= 10).select("race_id", "driver_id", F.posexplode(F.slice("probability_distribution", 1, 10)).alias("at", "probability")).withColumn("place", F.col("at") + 1),
        "SELECT race_id, driver_id, unnest(range(1, 11)) AS place, unnest(dist[1:10]) AS probability FROM prediction WHERE list_no <= 10", "race_id:s driver_id:s place:b probability:d",
    ),
    "report_result_table": predicted_query(
        lambda p: report.formatted(p.predictions).where(F.col("list_no") <= 10),
        f"SELECT *, {_POD} AS podium_probability, {_PTS} AS points_probability FROM prediction WHERE list_no <= 10",
        "race_id:s list_no:b driver_id:s driver_name:s predicted_position:b expected_points:d confidence_score:d podium_probability:d points_probability:d",
    ),
    "report_team_comparison": predicted_query(
        lambda p: report.team_comparison(p.predictions),
        "SELECT race_id, constructor_id AS team, avg(predicted_position) AS mean_position, sum(expected_points) AS total_points, avg(confidence_score) AS mean_confidence FROM prediction GROUP BY ALL",
        "race_id:s team:s mean_position:d total_points:d mean_confidence:d",
    ),
    "report_confidence_histogram": predicted_query(
        lambda p: report.confidence_histogram(p.predictions),
        """SELECT race_id, least(14, floor((confidence_score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 15)) AS bin, count(*) AS n
          FROM prediction JOIN (SELECT race_id, min(confidence_score) AS lo, max(confidence_score) AS hi FROM prediction GROUP BY 1) USING (race_id) GROUP BY ALL""",
        "race_id:s bin:b n:b",
    ),
    "history_log": predicted_query(
        _log, f"WITH {_LOG} SELECT * FROM log", "race_id:s race_name:s circuit:s winner:s winner_confidence:d winner_points:d total_drivers:b overall_confidence:d"
    ),
    "history_statistics": predicted_query(
        lambda p: report.log_statistics(_log(p)),
        f"""WITH {_LOG} SELECT count(*) AS total_predictions, avg(overall_confidence) AS mean_confidence, stddev_pop(overall_confidence) AS std_confidence, min(overall_confidence) AS min_confidence,
          max(overall_confidence) AS max_confidence, avg(winner_confidence) AS mean_winner_confidence, avg(total_drivers) AS mean_drivers FROM log""",
        "total_predictions:b mean_confidence:d std_confidence:d min_confidence:d max_confidence:d mean_winner_confidence:d mean_drivers:d",
    ),
    "history_session_statistics": predicted_query(
        lambda p: report.session_statistics(_log(p)),
        f"""WITH {_LOG} SELECT count(*) AS predictions, avg(overall_confidence) AS mean_confidence, date_diff('day', min(race_date), max(race_date)) AS days_covered,
          (SELECT winner FROM log GROUP BY winner ORDER BY count(*) DESC, winner DESC LIMIT 1) AS top_winner FROM log""",
        "predictions:b mean_confidence:d days_covered:b top_winner:s",
    ),
    "history_variety": predicted_query(
        lambda p: report.variety(p.predictions, _log(p)),
        f"""WITH {_LOG}, pod AS (SELECT season, race_id, string_agg(driver_id, ',' ORDER BY list_no) AS podium FROM prediction WHERE list_no <= 3 GROUP BY ALL)
        SELECT season, winners, podiums FROM (SELECT season, count(DISTINCT winner) AS winners FROM log GROUP BY 1) JOIN (SELECT season, count(DISTINCT podium) AS podiums FROM pod GROUP BY 1) USING (season)""",
        "season:b winners:b podiums:b",
    ),
    "points_concentration": Query(
        on_tables(lambda t: report.points_concentration(t.race_result)),
        """WITH d AS (SELECT season, driver_id, sum(points) AS points FROM race_result GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY points DESC, driver_id) AS rn FROM d)
        SELECT season, sum(points) AS total_points, avg(points) AS mean_points, sum(points) FILTER (WHERE rn <= 3) AS top_points, sum(points) FILTER (WHERE rn <= 3) / sum(points) AS top_share FROM r GROUP BY 1""",
        "season:b total_points:d mean_points:d top_points:d top_share:d",
    ),
    "race_podium": Query(
        on_tables(lambda t: report.top_of_race(t.race_result.where("finished"), "final_position")),
        "SELECT * FROM race_result WHERE finished QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY final_position, driver_id) <= 3", "race_id:s driver_id:s final_position:b points:d",
    ),
    "qualifying_podium": Query(
        on_tables(lambda t: report.top_of_race(t.qualifying_result, "position")),
        "SELECT * FROM qualifying_result QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY position, driver_id) <= 3", "race_id:s driver_id:s position:b",
    ),
}
