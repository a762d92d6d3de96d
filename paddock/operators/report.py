"""Report sections on predictions: formatted rows, podium, overtaking, insights, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock import values
from paddock.operators.prediction import confidence_label, neighbours, top_rows
from paddock.plans.blocks import by_field, framed, number_rows
from paddock.plans.dominance import dominance_sums, largest_before

_DIST = "probability_distribution"


#: distributions of so many places are read place by place
PLACES = 20


def _head(k: int) -> Column:
    # names the distribution once, as filters are moved to where it is computed
    return F.aggregate(F.slice(_DIST, 1, k), F.lit(0.0), lambda a, x: a + x)


def place_range(dist: Column) -> dict[str, Column]:
    """Smallest, largest and most likely place among those above 5 percent (else the best three)."""
    pairs = F.transform(dist, lambda p, i: F.struct(p.alias("p"), (-(i + 1)).alias("place")))
    likely = F.filter(pairs, lambda x: x["p"] > 0.05)
    best = F.slice(F.reverse(F.array_sort(pairs)), 1, 3)
    places = F.transform(F.when(F.size(likely) > 0, likely).otherwise(best), lambda x: -x["place"])
    # hardly any distribution is so flat, or has so many places, that the lists are made
    first, last = (F.coalesce(*[F.when(F.get(dist, F.lit(i)) > 0.05, i + 1) for i in order]) for order in (range(PLACES), reversed(range(PLACES))))
    seen = (F.size(dist) <= PLACES) & first.isNotNull()
    return {
        "range_min": F.when(seen, first).otherwise(F.array_min(places)),
        "range_max": F.when(seen, last).otherwise(F.array_max(places)),
        "most_likely": F.array_position(dist, F.array_max(dist)).cast("int"),
    }


def strengths() -> Column:
    c, e, p = F.col("confidence_score"), F.col("expected_points"), F.col("predicted_position")
    return F.array_compact(
        F.array(
            F.when(c > 0.8, F.lit("Strong overall performance indicators")),
            F.when(e > 15, F.lit("Excellent championship position potential")).when(e > 8, F.lit("Good points scoring opportunity")),
            F.when(p <= 3, F.lit("Podium contender")).when(p <= 6, F.lit("Top 6 finish likely")).when(p <= 10, F.lit("Points finish expected")),
        )
    )


def risks() -> Column:
    c, e, p = F.col("confidence_score"), F.col("expected_points"), F.col("predicted_position")
    return F.array_compact(
        F.array(
            F.when(c < 0.5, F.lit("High prediction uncertainty")).when(c < 0.7, F.lit("Moderate prediction uncertainty")),
            F.when(p > 15, F.lit("Risk of non-finish")).when(p > 10, F.lit("Outside points positions")),
            F.when(e < 1, F.lit("Low points scoring probability")),
        )
    )


def formatted(predictions: DataFrame) -> DataFrame:
    """Podium and points probability, place range, strengths and risks of every prediction."""
    return predictions.withColumns(
        {"podium_probability": _head(3), "points_probability": _head(10)}
        | place_range(F.col(_DIST))
        | {"key_strengths": strengths(), "risk_factors": risks()}
    )


def podium_candidates(predictions: DataFrame) -> DataFrame:
    """Most likely podium of each race: the three highest podium probabilities."""
    rows = predictions.withColumn("podium_probability", _head(3))
    return top_rows(rows, ["race_id"], [F.col("podium_probability").desc(), F.col("list_no")], 3, "podium_rank")


def podium_battles(predictions: DataFrame) -> DataFrame:
    """Neighbours by podium probability less than 0.1 apart, the first above 0.2."""
    second = lambda c: lambda w: F.when(F.count(F.lit(1)).over(w) == 2, F.last(c).over(w))
    following = {"next_driver_id": second("driver_id"), "next_probability": second("probability")}

    def neighbouring(rows: DataFrame, short: bool) -> DataFrame:
        rows = rows.select("race_id", "driver_id", "list_no", "lines", _head(3).alias("probability")).where(F.col("probability") > 0.1)
        order = [F.col("probability").desc(), F.col("list_no")]
        ranked = number_rows(rows, ["race_id"], order, -F.floor(F.col("probability") * 1e6), "at", one_chunk=short)
        return framed(ranked, ["race_id"], "at", {(0, 1): following}, one_block=short)

    pairs = by_field(predictions, neighbouring)
    return pairs.withColumn("closeness", F.col("probability") - F.col("next_probability")).where(
        (F.col("closeness") < 0.1) & (F.col("probability") > 0.2)
    )


def podium_surprises(predictions: DataFrame) -> DataFrame:
    """Drivers below place six with more than 15 percent podium probability."""
    return predictions.withColumn("podium_probability", _head(3)).where(
        (F.col("predicted_position") > 6) & (F.col("podium_probability") > 0.15)
    )


def overtaking_factor(circuit: Column) -> Column:
    """1 minus the difficulty found by the last word of the circuit name."""
    word = F.try_element_at(F.split(circuit, r"\s+"), F.lit(-1))
    names = list(values.OVERTAKING_DIFFICULTY.items())
    first = F.when(word == names[0][0], F.lit(names[0][1]))
    difficulty = reduce(lambda acc, kv: acc.when(word == kv[0], F.lit(kv[1])), names[1:], first)
    return F.lit(1.0) - difficulty.otherwise(F.lit(values.DEFAULT_DIFFICULTY))


def _overtakers(predictions: DataFrame) -> DataFrame:
    gain = F.col("grid") - F.col("predicted_position")
    return predictions.withColumn("gain", gain).withColumn(
        "probability",
        F.when(gain > 2, F.least(F.lit(0.9), gain * 0.2 * overtaking_factor(F.col("circuit")))),
    )


def overtaking_hotspots(predictions: DataFrame) -> DataFrame:
    """Drivers that more than one other is likely to overtake, with count and total probability.

    An overtaker gains more than two places, starts behind the target and is predicted ahead.
    """
    hit = F.col("probability").isNotNull()

    def sums(rows: DataFrame, short: bool) -> DataFrame:
        return dominance_sums(
            rows, ["race_id"], "driver_id", F.col("grid"), F.col("predicted_position"),
            {"overtake_count": hit.cast("double"), "total_probability": F.coalesce("probability", F.lit(0.0))},
            F.greatest(F.col("lines"), F.lit(20)), one_block=short,
        )

    return by_field(_overtakers(predictions), sums).where(F.col("overtake_count") > 1)


def likely_overtakes(predictions: DataFrame, k: int = 5) -> DataFrame:
    """The k most likely overtakes of each race.

    Overtakers come by probability, then list order, and each has the same probability for all its
    targets; so the first k overtakers with a target are enough, and each needs k targets.
    """
    return by_field(predictions, lambda rows, short: _likely_overtakes(rows, k, short))


def _likely_overtakes(predictions: DataFrame, k: int, short: bool) -> DataFrame:
    # a target starts ahead and is predicted behind: look at the last place among all starting ahead
    rows = largest_before(_overtakers(predictions), ["race_id"], F.col("grid"), F.col("predicted_position"), "_last", one_block=short)
    able = rows.where(F.col("probability").isNotNull() & (F.col("_last") > F.col("predicted_position")))
    best = top_rows(able, ["race_id"], [F.col("probability").desc(), F.col("list_no")], k)
    a = best.select(
        "race_id", "circuit", F.col("driver_id").alias("overtaker_id"), F.col("driver_name").alias("overtaker_name"), F.col("list_no").alias("_a"),
        F.col("grid").alias("_ga"), F.col("predicted_position").alias("_pa"), "probability",
    )
    b = predictions.select(
        "race_id", F.col("driver_id").alias("target_id"), F.col("driver_name").alias("target_name"), F.col("list_no").alias("_b"),
        F.col("grid").alias("_gb"), F.col("predicted_position").alias("_pb"),
    )
    pairs = b.join(a, "race_id").where((F.col("_gb") < F.col("_ga")) & (F.col("_pb") > F.col("_pa")))
    return top_rows(pairs, ["race_id"], [F.col("probability").desc(), F.col("_a"), F.col("_b")], k).drop("_a", "_b", "_gb", "_pb")


def _insight(kind: str, title: Column, text: Column, confidence: Column, drivers: Column, data: dict[str, Column]) -> list[Column]:
    pairs = [x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]
    return [
        F.col("race_id"), F.lit(kind).alias("insight_type"), title.alias("title"), text.alias("description"),
        confidence.cast("double").alias("confidence"), drivers.alias("drivers_involved"), F.create_map(*pairs).alias("supporting_data"),
    ]


def _drivers(*names: str) -> Column:
    return F.array(*[F.col(n) for n in names]) if names else F.array().cast("array<string>")


def _number(c: Column) -> Column:
    return F.format_string("%.4f", c.cast("double"))


def key_insights(predictions: DataFrame) -> DataFrame:
    """Winner, surprises against the grid, weather and the first close battle, as insight rows."""
    p, text = predictions, values.INSIGHT_TEXTS
    name, place, c = F.col("driver_name"), F.col("predicted_position"), F.col("confidence_score")
    winner = p.where(F.col("list_no") == 1).select(
        *_insight(
            "winner", F.concat(name, F.lit(" Predicted to Win")), F.format_string(text["winner"], name, c, place, F.col("expected_points")), c, _drivers("driver_id"),
            {"predicted_position": place, "expected_points": _number(F.col("expected_points")), "win_probability": _number(F.element_at(_DIST, 1))},
        )
    )
    change = F.col("grid") - place
    better = change > 0
    surprise = p.where(F.abs(change) > 5).select(
        *_insight(
            "surprise", F.concat(F.lit("Surprise Performance: "), name),
            F.format_string(text["surprise"], name, F.when(better, "outperform").otherwise("underperform"), F.col("grid"), place), c, _drivers("driver_id"),
            {"grid_position": F.col("grid"), "predicted_position": place, "position_change": change, "surprise_type": F.when(better, "positive").otherwise("negative")},
        )
    )
    weather = p.where((F.col("list_no") == 1) & (F.col("conditions") != "dry")).select(
        *_insight(
            "weather", F.lit("Weather Impact on Race"), F.format_string(text["weather"], F.coalesce(F.col("humidity"), F.lit(0.0))), F.lit(0.8), _drivers(),
            {
                "conditions": F.col("conditions"), "humidity": _number(F.col("humidity")), "track_temp": _number(F.col("track_temp")),
                "grip_level": _number(F.coalesce(F.col("grip_level"), F.lit(1.0))),
            },
        )
    )
    gap = F.abs(F.col("next_predicted_position") - place)
    pairs = lambda rows, short: neighbours(rows, ["driver_id", "driver_name", "predicted_position", "confidence_score"], short).where(gap < 1.5)
    next_place, next_c = F.col("next_predicted_position"), F.col("next_confidence_score")
    battle = by_field(p, lambda rows, short: top_rows(pairs(rows, short), ["race_id"], [F.col("list_no")], 1)).select(
        *_insight(
            "battle", F.concat(F.lit("Close Battle: "), name, F.lit(" vs "), F.col("next_driver_name")),
            F.format_string(text["battle"], name, place.cast("double"), F.col("next_driver_name"), next_place.cast("double")),
            F.least(c, next_c), _drivers("driver_id", "next_driver_id"),
            {"driver1_position": place, "driver2_position": next_place, "position_difference": gap, "combined_confidence": _number((c + next_c) / 2)},
        )
    )
    return reduce(DataFrame.unionByName, [winner, surprise, weather, battle])


def advanced_insights(predictions: DataFrame) -> DataFrame:
    """Championship, teammate-style battles, rookies and strategy, as insight rows."""
    p, text = predictions, values.INSIGHT_TEXTS
    name, place, c, points = F.col("driver_name"), F.col("predicted_position"), F.col("confidence_score"), F.col("expected_points")
    title = p.where((F.col("list_no") == 1) & (points > 20)).select(
        *_insight(
            "championship", F.lit("Championship Impact"), F.format_string(text["championship"], name), F.lit(0.8), _drivers("driver_id"),
            {"expected_points": _number(points), "position": place},
        )
    )
    battle = team_battles(p).select(
        *_insight(
            "team_battle", F.concat(F.lit("Intra-Team Battle: "), name, F.lit(" vs "), F.col("next_driver_name")),
            F.format_string(text["team_battle"], name, place, F.col("next_driver_name"), F.col("next_predicted_position")),
            F.least(c, F.col("next_confidence_score")), _drivers("driver_id", "next_driver_id"),
            {"position_gap": F.abs(F.col("next_predicted_position") - place), "points_difference": _number(F.abs(F.col("next_expected_points") - points))},
        )
    )
    rookie = p.where((place <= 8) & (c > 0.7) & F.lower(name).contains("rookie")).select(
        *_insight(
            "rookie_performance", F.concat(F.lit("Impressive Rookie Performance: "), name), F.format_string(text["rookie_performance"], name, place), c, _drivers("driver_id"),
            {"predicted_position": place, "expected_points": _number(points)},
        )
    )
    top = likely_overtakes(p).where(F.col("rank") == 1)
    strategy = top.select(
        *_insight(
            "strategy", F.lit("Key Strategic Opportunity"),
            F.format_string(text["strategy"], F.col("overtaker_name"), F.col("probability") * 100, F.col("target_name")), F.col("probability"), _drivers("overtaker_id", "target_id"),
            {**{k: F.col(k) for k in ("overtaker_id", "overtaker_name", "target_id", "target_name")}, "probability": _number(F.col("probability"))},
        )
    )
    return reduce(DataFrame.unionByName, [title, battle, rookie, strategy])


def team_battles(predictions: DataFrame, k: int = 2) -> DataFrame:
    """The first k pairs of confident drivers (above 0.7) less than three places apart.

    The first k pairs in list order can only join a driver with the next k confident ones.
    """
    return by_field(predictions.where(F.col("confidence_score") > 0.7), lambda rows, short: _team_battles(rows, k, short))


def _team_battles(rows: DataFrame, k: int, short: bool) -> DataFrame:
    ranked = number_rows(rows, ["race_id"], [F.col("list_no")], F.floor(F.col("list_no") / 1024), "at", one_chunk=short)
    names = ("at", "driver_id", "driver_name", "predicted_position", "confidence_score", "expected_points")
    later = F.struct(*names)
    pairs = framed(ranked, ["race_id"], "at", {(1, k): {"_later": lambda w: F.collect_list(later).over(w)}}, one_block=short).withColumn("_next", F.explode("_later"))
    pairs = pairs.select(
        "*", *[F.col(f"_next.{c}").alias(f"next_{c}") for c in names]
    ).where(F.abs(F.col("next_predicted_position") - F.col("predicted_position")) < 3)
    return top_rows(pairs, ["race_id"], [F.col("at"), F.col("next_at")], k).drop("_later", "_next")


def statistics(predictions: DataFrame, confidence: DataFrame) -> DataFrame:
    """Position, points and confidence statistics of a race, its overall confidence and how certain that is. Places are listed without gaps but for
    the cap, so the median comes from the two middle list entries."""
    c, place, n = F.col("confidence_score"), F.col("predicted_position"), F.col("n_drivers")
    middle = (F.col("list_no") == F.floor((n + 1) / 2)) | (F.col("list_no") == F.floor((n + 2) / 2))
    overall = F.col("overall_confidence")
    certainty = F.when(overall > 0.8, "high").when(overall > 0.6, "medium").otherwise("low")
    found = predictions.groupBy("race_id").agg(
        F.count(F.lit(1)).alias("total_drivers"),
        F.avg(place).alias("mean_position"),
        F.stddev_pop(place).alias("position_spread"),
        F.avg(F.when(middle, place)).alias("median_position"),
        F.sum("expected_points").alias("total_expected_points"),
        F.avg("expected_points").alias("mean_expected_points"),
        F.count_if(F.col("expected_points") > 0).alias("points_scoring_drivers"),
        F.avg(c).alias("mean_confidence"),
        F.stddev_pop(c).alias("confidence_spread"),
        F.count_if(c > 0.8).alias("high_confidence_predictions"),
        F.count_if(c < 0.5).alias("low_confidence_predictions"),
    )
    return found.join(confidence.select("race_id", "overall_confidence"), "race_id").withColumn("prediction_certainty", certainty)


def confidence_distribution(predictions: DataFrame) -> DataFrame:
    """Counts, shares and means of confidence in three buckets, and reliability of the whole."""
    c = F.col("confidence_score")
    buckets = {"high": c > 0.8, "medium": (c >= 0.5) & (c <= 0.8), "low": c < 0.5}
    n = F.count(F.lit(1))
    aggs = []
    for name, inside in buckets.items():
        aggs += [
            F.count_if(inside).alias(f"{name}_count"),
            (F.count_if(inside) * 100.0 / n).alias(f"{name}_percentage"),
            F.coalesce(F.avg(F.when(inside, c)), F.lit(0.0)).alias(f"{name}_average"),
        ]
    return predictions.groupBy("race_id").agg(
        *aggs,
        F.avg(c).alias("mean_confidence"), F.var_pop(c).alias("confidence_variance"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"),
        (F.count_if(c > 0.8) > n * 0.6).alias("consistent_predictions"),
        (F.count_if(c < 0.5) > n * 0.3).alias("uncertain_predictions"),
        confidence_label(F.avg(c), 0.75, 0.5).alias("prediction_reliability"),
    )


def race_info(predictions: DataFrame, confidence: DataFrame) -> DataFrame:
    """Header of the report."""
    head = predictions.where(F.col("list_no") == 1).select(
        "race_id", "race_name", "circuit", F.date_format("race_date", "yyyy-MM-dd").alias("date"), F.lit("race").alias("session_type"),
        F.col("n_drivers").alias("total_drivers"), F.col("conditions").alias("weather_conditions"), F.lit("ensemble").alias("prediction_model"),
    )
    return head.join(confidence.select("race_id", "overall_confidence"), "race_id")


def race_report(predictions: DataFrame, confidence: DataFrame) -> DataFrame:
    """Whole report in long form: race_id, section, ordinal, subject, value and the row as a JSON document.

    Every section has all its rows, of all drivers; a reader takes the ordinals it shows.
    """

    def section(rows: DataFrame, name: str, ordinal: Column, subject: Column, value: Column) -> DataFrame:
        plain = [c for c in rows.columns if c not in ("lines", _DIST)]
        return rows.select(
            "race_id", F.lit(name).alias("section"), ordinal.cast("long").alias("ordinal"), subject.alias("subject"), value.cast("double").alias("value"),
            F.to_json(F.struct(*plain)).alias("document"),
        )

    pair = lambda a, b: F.concat(F.col(a), F.lit("/"), F.col(b))
    none = F.lit(0)
    return reduce(
        DataFrame.unionByName,
        [
            section(race_info(predictions, confidence), "race_info", none, F.col("race_name"), F.col("overall_confidence")),
            section(formatted(predictions), "position_predictions", F.col("list_no"), F.col("driver_id"), F.col("podium_probability")),
            section(podium_candidates(predictions), "podium_candidates", F.col("podium_rank"), F.col("driver_id"), F.col("podium_probability")),
            section(podium_battles(predictions), "podium_battles", none, pair("driver_id", "next_driver_id"), F.col("closeness")),
            section(podium_surprises(predictions), "podium_surprises", F.col("predicted_position"), F.col("driver_id"), F.col("podium_probability")),
            section(likely_overtakes(predictions), "likely_overtakes", F.col("rank"), pair("overtaker_id", "target_id"), F.col("probability")),
            section(overtaking_hotspots(predictions), "overtaking_hotspots", F.col("overtake_count"), F.col("driver_id"), F.col("total_probability")),
            section(key_insights(predictions), "key_insights", none, F.col("title"), F.col("confidence")),
            section(statistics(predictions, confidence), "statistical_summary", F.col("total_drivers"), F.col("prediction_certainty"), F.col("mean_position")),
            section(confidence_distribution(predictions), "confidence_analysis", F.col("high_count"), F.col("prediction_reliability"), F.col("mean_confidence")),
        ],
    )


def notable_drivers(predictions: DataFrame, k: int = 3) -> DataFrame:
    """First k entries of: confidence above 0.9 (not the winner), then podium chance above 0.3 from below place
    five. A driver with both reasons takes two entries."""
    rows = predictions.withColumn("podium_probability", _head(3))
    sure = (F.col("confidence_score") > 0.9) & (F.col("list_no") > 1)
    dark = (F.col("podium_probability") > 0.3) & (F.col("predicted_position") > 5)
    reasons = F.array_compact(F.array(F.when(sure, values.NOTABLE_REASONS[0]), F.when(dark, values.NOTABLE_REASONS[1])))
    kept = rows.select("*", F.posexplode(reasons).alias("reason_no", "reason"))
    return top_rows(kept, ["race_id"], [F.col("list_no"), F.col("reason_no")], k)


def team_comparison(predictions: DataFrame) -> DataFrame:
    """Mean place, points and mean confidence of each team of a race."""
    return predictions.groupBy("race_id", F.col("constructor_id").alias("team")).agg(
        F.avg("predicted_position").alias("mean_position"), F.sum(F.col("expected_points").cast("decimal(18,6)")).cast("double").alias("total_points"), F.avg("confidence_score").alias("mean_confidence"),
    )


def confidence_histogram(predictions: DataFrame, bins: int = 15) -> DataFrame:
    """Equal-width histogram of the confidence of a race between its smallest and largest value."""
    c = F.col("confidence_score")
    edges = predictions.groupBy("race_id").agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    slot = F.least(F.lit(bins - 1), F.floor((c - F.col("_lo")) / width * bins))
    return predictions.join(edges, "race_id").groupBy("race_id", slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def insight_summary(found: DataFrame) -> DataFrame:
    """Insights per type with mean confidence and the number of confident ones."""
    return found.groupBy("insight_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") > 0.8).alias("high_confidence")
    )


def race_phase(text: Column) -> Column:
    """Phase of the race an insight text speaks of."""
    low = F.lower(text)
    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return F.when(has("start", "early"), "start").when(has("strategy", "pit"), "middle").when(has("late", "final"), "end").otherwise("general")


def prediction_log(predictions: DataFrame, confidence: DataFrame) -> DataFrame:
    """One log row per race: winner with confidence and points, number of drivers; `append_log` adds the time."""
    head = predictions.where(F.col("list_no") == 1).select(
        "race_id", "race_name", "circuit", "season", "race_date", F.col("driver_name").alias("winner"), F.col("confidence_score").alias("winner_confidence"),
        F.col("expected_points").alias("winner_points"), F.col("n_drivers").alias("total_drivers"),
    )
    return head.join(confidence.select("race_id", "overall_confidence"), "race_id")


def log_statistics(log: DataFrame) -> DataFrame:
    """Statistics over many predictions."""
    return log.agg(
        F.count(F.lit(1)).alias("total_predictions"), F.avg("overall_confidence").alias("mean_confidence"), F.stddev_pop("overall_confidence").alias("std_confidence"),
        F.min("overall_confidence").alias("min_confidence"), F.max("overall_confidence").alias("max_confidence"),
        F.avg("winner_confidence").alias("mean_winner_confidence"), F.avg("total_drivers").alias("mean_drivers"),
    )


def session_statistics(log: DataFrame) -> DataFrame:
    """Count, mean confidence and most often predicted winner (last by name on ties)."""
    per_winner = log.groupBy("winner").agg(
        F.count(F.lit(1)).alias("n"), F.sum("overall_confidence").alias("c"), F.min("race_date").alias("first"), F.max("race_date").alias("last")
    )
    return per_winner.agg(
        F.sum("n").alias("predictions"),
        (F.sum("c") / F.sum("n")).alias("mean_confidence"),
        F.max_by("winner", F.struct("n", "winner")).alias("top_winner"),
        F.datediff(F.max("last"), F.min("first")).alias("days_covered"),
    )


def variety(predictions: DataFrame, log: DataFrame) -> DataFrame:
    """Distinct winners and podiums per season."""
    podium = predictions.where(F.col("list_no") <= 3).groupBy("season", "race_id").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("list_no", "driver_id")))).alias("podium")
    )
    return log.groupBy("season").agg(F.count_distinct("winner").alias("winners")).join(
        podium.groupBy("season").agg(F.count_distinct("podium").alias("podiums")), "season"
    )


def points_concentration(results: DataFrame, k: int = 3) -> DataFrame:
    """Share of the k best drivers in the points of a season."""
    totals = results.groupBy("season", "driver_id").agg(F.sum("points").alias("points"))
    best = top_rows(totals, ["season"], [F.col("points").desc(), F.col("driver_id")], k).groupBy("season").agg(F.sum("points").alias("top_points"))
    return totals.groupBy("season").agg(F.sum("points").alias("total_points"), F.avg("points").alias("mean_points")).join(best, "season").withColumn(
        "top_share", F.try_divide("top_points", "total_points")
    )


def top_of_race(results: DataFrame, column: str, k: int = 3) -> DataFrame:
    """First k of each race by place."""
    return top_rows(results, ["race_id"], [F.col(column), F.col("driver_id")], k)
