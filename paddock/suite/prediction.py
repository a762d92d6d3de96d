"""Queries on ratings, scores and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.functions import scores
from paddock.operators import prediction
from paddock.plans.predictions import MODELS, SQL, long_predictions, requests
from paddock.suite.base import Query, on_tables, predicted_query

_INPUT = (
    "qualifying_position:b driver_championship_points:b constructor_championship_points:b driver_wins_season:b constructor_wins_season:b track_temperature:d "
    "air_temperature:d humidity:d wind_speed:d weather_dry:b track_grip:d fuel_load:d tire_compound:b driver_experience:b car_performance_rating:d engine_power:d "
    "aerodynamic_efficiency:d driver_skill_rating:d consistency_rating:d wet_weather_skill:d reliability_rating:d strategy_rating:d "
    "circuit_overtaking_factor:d qualifying_importance:d"
)
_RANK = """ranked AS (SELECT *, row_number() OVER w AS predicted_position, lead(score) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY race_id ORDER BY score DESC, result_idx)),
  ranking AS (SELECT *, CASE WHEN predicted_position = 1 THEN least(0.95, 0.7 + (score - coalesce(nxt, score)) / 100) ELSE greatest(0.3, 0.8 - (predicted_position - 1) * 0.05::DOUBLE) END AS confidence_score FROM ranked)"""
_LIST = "race_id:s driver_id:s"

QUERIES = {
    "driver_ratings": Query(
        on_tables(lambda t: prediction.with_ratings(requests(t), (0.75, 0.70, 0.70))),
        "SELECT * FROM rated", f"{_LIST} rating_id:s team:s skill:d steady:d wet_skill:d car:d reliability:d strategy:d", f",\n{SQL}",
    ),
    "circuit_factors": Query(
        on_tables(lambda t: requests(t).select("race_id", "circuit", *[prediction.circuit_factor(F.col("circuit"), i).alias(n) for i, n in ((1, "overtaking_factor"), (2, "qualifying_importance"))]).distinct()),
        "SELECT DISTINCT race_id, circuit, overtaking_factor, qualifying_importance FROM rated", "race_id:s circuit:s overtaking_factor:d qualifying_importance:d", f",\n{SQL}",
    ),
    "model_input": Query(
        on_tables(lambda t: prediction.model_input(requests(t))),
        """SELECT race_id, driver_id, grid AS qualifying_position, 0 AS driver_championship_points, CAST(trunc(car * 600) AS BIGINT) AS constructor_championship_points, 0 AS driver_wins_season,
          0 AS constructor_wins_season, track_temp AS track_temperature, air_temp AS air_temperature, humidity, wind_speed, CAST(conditions = 'dry' AS INT) AS weather_dry,
          CASE WHEN conditions = 'dry' THEN 0.9 ELSE 0.6 END AS track_grip, 100 AS fuel_load, 2 AS tire_compound, 100 AS driver_experience, car AS car_performance_rating, 900 AS engine_power,
          car * 0.95 AS aerodynamic_efficiency, coalesce(known_skill, 0.70) AS driver_skill_rating, steady AS consistency_rating, wet_skill AS wet_weather_skill, reliability AS reliability_rating,
          strategy AS strategy_rating, overtaking_factor AS circuit_overtaking_factor, qualifying_importance FROM rated""",
        f"{_LIST} {_INPUT}", f",\n{SQL}",
    ),
    "race_scores": Query(on_tables(lambda t: prediction.race_scores(requests(t))), "SELECT * FROM scored", f"{_LIST} score:d", f",\n{SQL}"),
    "score_ranking": Query(
        on_tables(lambda t: prediction.score_ranking(prediction.race_scores(requests(t)))),
        f"WITH {_RANK} SELECT * FROM ranking", f"{_LIST} predicted_position:b confidence_score:d", f",\n{SQL}",
    ),
    "score_predictions": Query(
        on_tables(lambda t: prediction.score_predictions(prediction.score_ranking(prediction.race_scores(requests(t))))),
        f"WITH {_RANK} SELECT *, CASE WHEN predicted_position <= 10 THEN round_even([25.0, 18, 15, 12, 10, 8, 6, 4, 2, 1][predicted_position]::DOUBLE * confidence_score, 1) ELSE 0 END AS expected_points FROM ranking",
        f"{_LIST} predicted_position:b confidence_score:d expected_points:d", f",\n{SQL}",
    ),
    "race_predictions": predicted_query(
        lambda p: p.predictions,
        "SELECT * FROM prediction", f"{_LIST} list_no:b predicted_position:b adjusted:d expected_points:d confidence_score:d",
    ),
    "place_distribution": predicted_query(
        lambda p: p.predictions.select("race_id", "driver_id", F.posexplode("probability_distribution").alias("at", "probability")).withColumn("place", F.col("at") + 1),
        "SELECT race_id, driver_id, unnest(range(1, 21)) AS place, unnest(dist) AS probability FROM prediction", f"{_LIST} place:b probability:d",
    ),
    "expected_points": predicted_query(
        lambda p: p.predictions.select("race_id", "driver_id", scores.expected_points(F.col("adjusted")).alias("interpolated")),
        """SELECT race_id, driver_id, CASE WHEN adjusted BETWEEN 1 AND 10 THEN t[floor(adjusted)::INT] * (1 - (adjusted - floor(adjusted))) + t[least(floor(adjusted)::INT + 1, 10)] * (adjusted - floor(adjusted)) ELSE 0 END AS interpolated
          FROM (SELECT *, [25.0, 18, 15, 12, 10, 8, 6, 4, 2, 1]::DOUBLE[] AS t FROM prediction)""",
        f"{_LIST} interpolated:d",
    ),
    "model_agreement": predicted_query(
        lambda p: prediction.model_agreement(long_predictions(p.predictions)), "SELECT * FROM agreement", "race_id:s model_1:s model_2:s agreement:d"
    ),
    "race_confidence": predicted_query(
        lambda p: p.confidence, "SELECT * FROM confidence",
        "race_id:s model_agreement:d prediction_variance:d historical_accuracy:d data_quality:d overall_confidence:d",
    ),
    "race_confidence_single_model": predicted_query(
        lambda p: prediction.race_confidence(long_predictions(p.predictions).where(F.col("model") == MODELS[1]), 0.8, 0.9),
        """SELECT race_id, 0.5 AS model_agreement, greatest(0, 1 - var_pop(y_pred) / 100) AS prediction_variance,
          0.5 * 0.3 + greatest(0, 1 - var_pop(y_pred) / 100) * 0.25 + 0.8 * 0.25 + 0.9 * 0.2 AS overall_confidence FROM long_prediction WHERE model = 'grid' GROUP BY race_id""",
        "race_id:s model_agreement:d prediction_variance:d overall_confidence:d",
    ),
    "predicted_winners": predicted_query(
        lambda p: prediction.winners(p.predictions), "SELECT * FROM prediction WHERE list_no = 1", "race_id:s driver_id:s driver_name:s confidence_score:d"
    ),
    "biggest_surprises": predicted_query(
        lambda p: prediction.surprises(p.predictions),
        """SELECT *, abs(grid - predicted_position) AS surprise_factor FROM prediction WHERE abs(grid - predicted_position) > 5
          QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY abs(grid - predicted_position) DESC, list_no) <= 3""",
        f"{_LIST} surprise_factor:b",
    ),
    "closest_battles": predicted_query(
        lambda p: prediction.closest_battles(p.predictions),
        """SELECT * FROM (SELECT *, lead(driver_id) OVER w AS next_driver_id, 1.5 - abs(lead(predicted_position) OVER w - predicted_position) AS closeness FROM prediction
          WINDOW w AS (PARTITION BY race_id ORDER BY list_no)) WHERE closeness > 0 QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY closeness DESC, list_no) <= 3""",
        f"{_LIST} next_driver_id:s closeness:d",
    ),
    "prediction_insights": predicted_query(
        lambda p: prediction.insights(p.predictions, p.confidence),
        """WITH s AS (SELECT race_id, string_agg(driver_id, ',' ORDER BY r) AS surprises FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY abs(grid - predicted_position) DESC, list_no) AS r
            FROM prediction WHERE abs(grid - predicted_position) > 5) WHERE r <= 3 GROUP BY 1),
          b AS (SELECT race_id, string_agg(driver_id, ',' ORDER BY r) AS battles FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY closeness DESC, list_no) AS r FROM (
            SELECT *, 1.5 - abs(lead(predicted_position) OVER (PARTITION BY race_id ORDER BY list_no) - predicted_position) AS closeness FROM prediction) WHERE closeness > 0) WHERE r <= 3 GROUP BY 1)
        SELECT race_id, count(*) AS total_drivers, CASE WHEN any_value(overall_confidence) > 0.8 THEN 'high' WHEN any_value(overall_confidence) > 0.6 THEN 'medium' ELSE 'low' END AS confidence_level,
          min_by(driver_name, list_no) AS winner, min_by(confidence_score, list_no) AS winner_confidence, count(*) FILTER (WHERE confidence_score > 0.8) AS high,
          count(*) FILTER (WHERE confidence_score <= 0.8 AND confidence_score > 0.6) AS medium, count(*) FILTER (WHERE confidence_score <= 0.6) AS low,
          any_value(surprises) AS surprises, any_value(battles) AS battles
        FROM prediction JOIN confidence USING (race_id) LEFT JOIN s USING (race_id) LEFT JOIN b USING (race_id) GROUP BY race_id""",
        "race_id:s total_drivers:b confidence_level:s winner:s winner_confidence:d high:b medium:b low:b surprises:s battles:s",
    ),
}
