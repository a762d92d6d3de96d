"""From race requests to ranked predictions: ratings, scores, place distribution, confidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock import values
from paddock.functions import scores
from paddock.operators.races import guarded_correlation
from paddock.plans.literals import literal_table
from paddock.plans.blocks import PIECE, by_field, framed, number_rows



def driver_table(spark: SparkSession) -> DataFrame:
    """Ratings of the known drivers (20 rows)."""
    return literal_table(
        spark,
        [(*d, 0, 0) for d in values.DRIVERS],
        "rating_id string, known_name string, team string, avg_finish double, skill double, steady double, wet_skill double, season_points int, season_wins int",
    )


def team_table(spark: SparkSession) -> DataFrame:
    """Ratings of the known teams (10 rows)."""
    return literal_table(spark, [(k, *v) for k, v in values.TEAMS.items()], "team string, car double, reliability double, strategy double")


def driver_list(spark: SparkSession) -> DataFrame:
    """Drivers for selection, by points descending."""
    return driver_table(spark).orderBy(F.col("season_points").desc(), "rating_id")


def with_ratings(requests: DataFrame, unknown: tuple[float, float, float]) -> DataFrame:
    """Add driver and team ratings; unknown drivers get the given skill, consistency and wet skill."""
    spark = requests.sparkSession
    out = requests.join(F.broadcast(driver_table(spark)), "rating_id", "left").join(F.broadcast(team_table(spark)), "team", "left")
    defaults = dict(zip(("skill", "steady", "wet_skill"), unknown)) | dict(zip(("car", "reliability", "strategy"), values.DEFAULT_TEAM))
    return out.withColumns(
        {c: F.coalesce(c, F.lit(float(v))) for c, v in defaults.items()}
        | {c: F.coalesce(c, F.lit(0)) for c in ("season_points", "season_wins")}
        | {"team": F.coalesce("team", F.lit("Unknown"))}
    )


def circuit_factor(name: Column, field: int) -> Column:
    """Factor of the first known circuit contained in ``name`` (1 overtaking, 2 qualifying, 3 reliability)."""
    *known, default = values.CIRCUIT_FACTORS
    low = F.lower(name)
    first = F.when(low.contains(known[0][0].lower()), F.lit(known[0][field]))
    return reduce(lambda acc, row: acc.when(low.contains(row[0].lower()), F.lit(row[field])), known[1:], first).otherwise(
        F.lit(default[field])
    )


def model_input(requests: DataFrame, *more: str) -> DataFrame:
    """The 24 model input columns of every driver of every request; ``more`` columns are kept."""
    wet = F.col("conditions") != "dry"
    rows = with_ratings(requests, (0.70, 0.70, 0.70))
    return rows.select(
        "race_id", "driver_id", "result_idx",
        F.coalesce("grid", F.col("result_idx") + 1).alias("qualifying_position"),
        F.col("season_points").alias("driver_championship_points"),
        (F.col("car") * 600).cast("int").alias("constructor_championship_points"),
        F.col("season_wins").alias("driver_wins_season"),
        F.greatest(F.lit(0), "season_wins").alias("constructor_wins_season"),
        F.coalesce("track_temp", F.lit(25.0)).alias("track_temperature"),
        F.coalesce("air_temp", F.lit(20.0)).alias("air_temperature"),
        F.coalesce("humidity", F.lit(60.0)).alias("humidity"),
        F.coalesce("wind_speed", F.lit(5.0)).alias("wind_speed"),
        F.when(wet, 0).otherwise(1).alias("weather_dry"),
        F.coalesce("grip_level", F.when(wet, 0.6).otherwise(0.9)).alias("track_grip"),
        F.coalesce("fuel_load", F.lit(100.0)).alias("fuel_load"),
        F.coalesce("tire_compound", F.lit(2)).alias("tire_compound"),
        F.least(F.lit(400), F.col("season_points") + 100).alias("driver_experience"),
        F.col("car").alias("car_performance_rating"),
        F.coalesce("engine_power", F.lit(900.0)).alias("engine_power"),
        (F.col("car") * 0.95).alias("aerodynamic_efficiency"),
        F.col("skill").alias("driver_skill_rating"),
        F.col("steady").alias("consistency_rating"),
        F.col("wet_skill").alias("wet_weather_skill"),
        F.col("reliability").alias("reliability_rating"),
        F.col("strategy").alias("strategy_rating"),
        circuit_factor(F.col("circuit"), 1).alias("circuit_overtaking_factor"),
        circuit_factor(F.col("circuit"), 2).alias("qualifying_importance"),
        *more,
    )


def race_scores(requests: DataFrame) -> DataFrame:
    """Deterministic race score of every driver."""
    rows = with_ratings(requests, (0.75, 0.70, 0.70))
    score = (
        F.col("skill") * 100
        + F.col("car") * 80
        + (F.lit(21) - F.col("grid")) * circuit_factor(F.col("circuit"), 2) * 3
        + F.when(F.col("conditions") != "dry", F.col("wet_skill") * 30).otherwise(15.0)
        + F.col("reliability") * 20
        + F.col("strategy") * 10
    )
    return rows.withColumn("score", score)


def score_ranking(scored: DataFrame) -> DataFrame:
    """Rank by score; the winner's confidence grows with the gap, others lose 0.05 per place."""
    band = F.coalesce(-F.floor(F.col("score") * 1000), F.lit(2**62))  # no score comes last
    ranked = number_rows(scored, ["race_id"], [F.col("score").desc(), F.col("result_idx")], band, "predicted_position")
    ranked = framed(ranked, ["race_id"], "predicted_position", {(0, 1): {"_next": lambda w: F.min("score").over(w)}})
    first = F.least(F.lit(0.95), F.lit(0.7) + (F.col("score") - F.col("_next")) / 100)
    other = F.greatest(F.lit(0.3), F.lit(0.8) - (F.col("predicted_position") - 1) * 0.05)
    confidence = F.when(F.col("predicted_position") == 1, first).otherwise(other)
    return ranked.withColumn("confidence_score", confidence).drop("_next")


def score_predictions(ranking: DataFrame) -> DataFrame:
    """Expected points of a score ranking: points of the place times confidence, one decimal."""
    points = scores.expected_points(F.col("predicted_position").cast("double"))
    return ranking.withColumn("expected_points", F.bround(points * F.col("confidence_score"), 1))


def model_agreement(long: DataFrame) -> DataFrame:
    """Absolute correlation of each pair of models per race (model_1 < model_2).

    ``long`` has one row per race, driver and model; models are few, drivers stay apart.
    """
    wide = long.groupBy("race_id", "driver_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "y_pred"))).alias("p"))
    names = F.array_sort(F.map_keys("p"))
    pairs = F.flatten(
        F.transform(names, lambda a: F.transform(F.filter(names, lambda b: a < b), lambda b: F.struct(a.alias("model_1"), b.alias("model_2"))))
    )
    rows = wide.withColumn("m", F.explode(pairs)).select(
        "race_id", "m.model_1", "m.model_2",
        F.try_element_at("p", F.col("m.model_1")).alias("a"), F.try_element_at("p", F.col("m.model_2")).alias("b"),
    )
    return rows.groupBy("race_id", "model_1", "model_2").agg(F.abs(guarded_correlation(F.col("a"), F.col("b"))).alias("agreement"))


def race_confidence(long: DataFrame, accuracy: float | None = None, quality: float = 1.0) -> DataFrame:
    """Confidence of a race from model agreement, variance across models, accuracy and data quality."""
    agreement = model_agreement(long).groupBy("race_id").agg(F.avg("agreement").alias("agreement"))
    spread = long.groupBy("race_id", "driver_id").agg(F.var_pop("y_pred").alias("v"), F.count(F.lit(1)).alias("m"), F.first("y_pred").alias("y"))
    variance = spread.groupBy("race_id").agg(F.avg("v").alias("v"), F.max("m").alias("models"), F.var_pop("y").alias("single"))
    w = values.CONFIDENCE_WEIGHTS
    return (
        variance.join(agreement, "race_id", "left")
        .select(
            "race_id",
            F.when(F.col("models") > 1, F.coalesce("agreement", F.lit(0.5))).otherwise(0.5).alias("model_agreement"),
            F.greatest(
                F.lit(0.0), F.lit(1.0) - F.when(F.col("models") > 1, F.col("v") / 50.0).otherwise(F.col("single") / 100.0)
            ).alias("prediction_variance"),
            F.lit(0.7 if accuracy is None else accuracy).alias("historical_accuracy"),
            F.lit(float(quality)).alias("data_quality"),
        )
        .withColumn("overall_confidence", reduce(lambda a, b: a + b, [F.col(n) * x for n, x in w.items()]))
    )


def joint_confidence(rows: DataFrame, models: Sequence[str], accuracy: float | None = None, quality: float = 1.0) -> DataFrame:
    """``race_confidence`` of rows that hold the outputs of two models or more side by side, one row per race and driver;
    a race is one row of sums."""
    y = [F.col(m) for m in models]
    mean = reduce(lambda a, b: a + b, y) / len(y)
    spread = reduce(lambda a, b: a + b, [(m - mean) * (m - mean) for m in y]) / len(y)
    pairs = [guarded_correlation(a, b) for a, b in combinations(y, 2)]
    sums = rows.groupBy("race_id").agg(F.avg(spread).alias("v"), F.array(*[F.abs(p) for p in pairs]).alias("agreements"))
    known = F.filter("agreements", lambda a: a.isNotNull())
    agreement = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known))
    w = values.CONFIDENCE_WEIGHTS
    return sums.select(
        "race_id",
        F.coalesce(agreement, F.lit(0.5)).alias("model_agreement"),
        F.greatest(F.lit(0.0), F.lit(1.0) - F.col("v") / 50.0).alias("prediction_variance"),
        F.lit(0.7 if accuracy is None else accuracy).alias("historical_accuracy"),
        F.lit(float(quality)).alias("data_quality"),
    ).withColumn("overall_confidence", reduce(lambda a, b: a + b, [F.col(n) * x for n, x in w.items()]))


def predict(base: DataFrame) -> DataFrame:
    """Ranked predictions from base predictions of every (race, driver).

    ``base`` holds race_id, driver_id, result_idx, lines (an upper bound of the field), n_drivers,
    adjusted (the model output) and spread (deviation across models).
    """
    return outcome(unique_positions(base.withColumn("_place", predicted_place()), "_place")).withColumn("probability_distribution", scores.place_distribution(F.col("adjusted"))).drop("_place")


def predicted_place() -> Column:
    """The place that the model output is rounded to, inside the field."""
    return F.least(F.col("n_drivers"), F.greatest(F.lit(1), F.rint("adjusted").cast("int")))


def outcome(rows: DataFrame) -> DataFrame:
    """Points and confidence of predictions with their rounded place (_place)."""
    return rows.withColumns(
        {
            "expected_points": scores.expected_points(F.col("_place").cast("double")),
            "confidence_score": F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.lit(1.0) - F.col("spread") / 5.0)),
        }
    )


def unique_positions(rows: DataFrame, place: str) -> DataFrame:
    """Move ties to the next free place, capped at the field size; ``list_no`` is the list order.

    Rows of one place stand together in the list, and the first of them is pushed furthest, so numbers of earlier rows and
    pushes follow from the counts of each place; the rows are shuffled once.
    """
    rows = rows.withColumn("_chunk", F.coalesce(F.col(place), F.lit(-1)).cast("long"))
    upto = Window.partitionBy("race_id").orderBy("_chunk")
    before = F.coalesce(F.sum("_rows").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = rows.groupBy("race_id", "_chunk").agg(F.count(F.lit(1)).alias("_rows"), F.max(place).alias("_at")).withColumn("_shift", before)
    places = places.withColumn("_push", F.max(F.col("_at") - F.col("_shift") - 1).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    local = F.row_number().over(Window.partitionBy("race_id", "_chunk").orderBy(F.col(place), F.col("result_idx")))
    listed = rows.withColumn("_local", local).join(places.drop("_rows", "_at"), ["race_id", "_chunk"], "left")
    listed = listed.withColumn("list_no", F.col("_local") + F.coalesce("_shift", F.lit(0)))
    return listed.withColumn("predicted_position", F.least(F.col("n_drivers"), F.col("list_no") + F.col("_push"))).drop("_chunk", "_local", "_shift", "_push")


def field_positions(rows: DataFrame, place: str, largest: int = PIECE) -> DataFrame:
    """``unique_positions`` that sends races of fewer than ``largest`` lines by race alone: in the list of a race, the push
    of a row is the largest distance of a place from its number so far."""
    order = Window.partitionBy("race_id").orderBy(F.coalesce(F.col(place), F.lit(-1)), F.col(place), F.col("result_idx"))
    push = F.max(F.col(place) - F.col("list_no")).over(order.rowsBetween(Window.unboundedPreceding, 0))

    def listed(some: DataFrame, short: bool) -> DataFrame:
        if not short:
            return unique_positions(some, place)
        numbered = some.withColumn("list_no", F.row_number().over(order).cast("long"))
        return numbered.withColumn("predicted_position", F.least(F.col("n_drivers"), F.col("list_no") + push))

    return by_field(rows, listed, largest)


def winners(predictions: DataFrame) -> DataFrame:
    """Most likely winner of each race."""
    return predictions.groupBy("race_id").agg(
        F.min_by(F.struct("driver_id", "driver_name", "confidence_score"), "list_no").alias("w")
    ).select("race_id", "w.*")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def surprises(predictions: DataFrame, k: int = 3) -> DataFrame:
    """The k drivers of a race predicted more than five places away from the grid, largest first."""
    gap = F.abs(F.col("grid") - F.col("predicted_position"))
    rows = predictions.withColumn("surprise_factor", gap).where(F.col("surprise_factor") > 5)
    return top_rows(rows, ["race_id"], [F.col("surprise_factor").desc(), F.col("list_no")], k)


def neighbours(predictions: DataFrame, columns: list[str], short: bool = False) -> DataFrame:
    """Each driver with the next one in the list (``next_`` columns); ``short`` says that no field is larger than a block."""
    following = {f"next_{c}": (lambda c: lambda w: F.when(F.count(F.lit(1)).over(w) == 2, F.last(c).over(w)))(c) for c in columns}
    return framed(predictions, ["race_id"], "list_no", {(0, 1): following}, one_block=short).where(F.col(f"next_{columns[0]}").isNotNull())


def closest_battles(predictions: DataFrame, k: int = 3) -> DataFrame:
    """The k closest neighbours in the list with a gap below 1.5 places."""
    gap = F.abs(F.col("next_predicted_position") - F.col("predicted_position"))

    def closest(rows: DataFrame, short: bool) -> DataFrame:
        pairs = neighbours(rows, ["driver_id", "predicted_position", "confidence_score", "driver_name"], short).withColumn("closeness", F.lit(1.5) - gap)
        return top_rows(pairs.where(F.col("closeness") > 0), ["race_id"], [F.col("closeness").desc(), F.col("list_no")], k)

    return by_field(predictions, closest)


def confidence_label(c: Column, high: float = 0.8, medium: float = 0.6) -> Column:
    return F.when(c > high, "high").when(c > medium, "medium").otherwise("low")


def insights(predictions: DataFrame, confidence: DataFrame) -> DataFrame:
    """Per race: drivers, confidence level, winner, numbers of confident drivers, surprises and battles."""
    c = F.col("confidence_score")
    levels = predictions.groupBy("race_id").agg(
        F.count(F.lit(1)).alias("total_drivers"),
        F.count_if(c > 0.8).alias("high"),
        F.count_if((c <= 0.8) & (c > 0.6)).alias("medium"),
        F.count_if(c <= 0.6).alias("low"),
    )
    lists = lambda df, name: df.groupBy("race_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "driver_id"))), lambda s: s["driver_id"]), ",").alias(name)
    )
    return (
        levels.join(confidence.select("race_id", confidence_label(F.col("overall_confidence")).alias("confidence_level")), "race_id", "left")
        .join(winners(predictions).select("race_id", F.col("driver_name").alias("winner"), F.col("confidence_score").alias("winner_confidence")), "race_id")
        .join(lists(surprises(predictions), "surprises"), "race_id", "left")
        .join(lists(closest_battles(predictions), "battles"), "race_id", "left")
    )


def request_errors(requests: DataFrame) -> Column:
    """Messages of an invalid nested request (empty array when valid)."""
    d = F.col("drivers")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    repeated = lambda f: F.size(F.array_distinct(F.transform(d, f))) < F.size(d)
    empty = d.isNull() | (F.size(d) == 0)
    return F.array_compact(
        F.array(
            *[
                F.when(wrong, F.lit(text))
                for wrong, text in zip(
                    (blank("race_name"), blank("circuit"), empty, ~empty & repeated(lambda x: x["grid_position"]), ~empty & repeated(lambda x: x["driver_id"]), F.col("weather").isNull()),
                    values.REQUEST_ERRORS,
                    strict=True,
                )
            ]
        )
    )


def batch(requests: DataFrame, predictions: DataFrame, confidence: DataFrame) -> DataFrame:
    """One row per nested request: winner and confidence of its prediction, or no winner, confidence 0 and the
    messages of the rules that it breaks. A request without a prediction says so."""
    errors = request_errors(requests)
    checked = requests.select("race_id", "race_name", "circuit", F.when(F.size(errors) > 0, F.array_join(errors, "; ")).alias("_error"))
    head = winners(predictions).select("race_id", F.col("driver_name").alias("_winner"))
    done = head.join(confidence.select("race_id", "overall_confidence"), "race_id")
    out = checked.join(done, "race_id", "left").withColumn("error", F.coalesce("_error", F.when(F.col("_winner").isNull(), F.lit("No prediction"))))
    good = F.col("error").isNull()
    return out.select("race_id", "race_name", "circuit", F.when(good, F.col("overall_confidence")).otherwise(0.0).alias("confidence"), F.when(good, F.col("_winner")).alias("winner"), "error")


def grid_lookup(predictions: DataFrame, entries: DataFrame) -> DataFrame:
    """Grid place of every prediction from request entries (race_id, entry_no, driver_id, name, grid_position): the first
    entry that has its id or its name, else its place in the list. Predictions and entries are sent by race together, once."""
    given = entries.select("race_id", "driver_id", F.col("name").alias("driver_name"), F.struct("entry_no", "grid_position").alias("_entry"))
    both = predictions.withColumn("_asked", F.lit(True)).unionByName(given, allowMissingColumns=True).repartition("race_id")
    first = lambda key: F.when(F.col("race_id").isNotNull() & F.col(key).isNotNull(), F.min("_entry").over(Window.partitionBy("race_id", key)))
    found = both.withColumns({f"_{key}": first(key) for key in ("driver_id", "driver_name")}).where("_asked")
    return found.withColumn("request_grid", F.coalesce(F.least("_driver_id", "_driver_name")["grid_position"], "list_no")).drop("_driver_id", "_driver_name", "_asked", "_entry")


def accuracy_track(history: DataFrame, entity: str = "model") -> DataFrame:
    """Running accuracy per model: 1 - MAE/10 per evaluation, 0.7 old + 0.3 new.

    The recursion equals 0.7^age weights, so it is a sum of powers with the first value kept whole.
    ``history`` has one row per evaluation, numbered by ``eval_no``.
    """
    last = history.groupBy(entity).agg(F.max("eval_no").alias("_last"))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("mae") / 10.0)
    weight = F.pow(F.lit(0.7), F.col("_last") - F.col("eval_no")) * F.when(F.col("eval_no") == 1, 1.0).otherwise(0.3)
    return history.join(last, entity).groupBy(entity).agg(F.sum(score * weight).alias("accuracy"), F.max("eval_no").alias("evaluations"))


#: evaluations that still count in a running accuracy: 0.7^MEMORY is below the last bit of a double
MEMORY = 128


def accuracy_history(history: DataFrame, entity: str = "model") -> DataFrame:
    """Accuracy of each model after every evaluation and before it: 1 - MAE/10, 0.7 old + 0.3 new, the first one whole.

    ``history`` has one row per evaluation, numbered by ``eval_no``. The recursion forgets: after `MEMORY` evaluations the state
    no longer shows in a double, so a moving frame of that many rows gives all of it and no state is carried from task to task."""
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("mae") / 10.0)
    rows = history.withColumn("score", score)
    seen = framed(rows, [entity], "eval_no", {(1 - MEMORY, 0): {"_seen": lambda w: F.collect_list("score").over(w)}, (-MEMORY, -1): {"_before": lambda w: F.collect_list("score").over(w)}})
    state = lambda c: F.when(F.size(c) > 0, F.aggregate(F.slice(c, 2, MEMORY), F.element_at(c, 1), lambda old, new: old * 0.7 + new * 0.3))
    return seen.withColumns({"accuracy": state(F.col("_seen")), "accuracy_before": F.when(F.size("_before") > 0, state(F.col("_before")))}).drop("_seen", "_before")


def confidence_as_of(confidence: DataFrame, history: DataFrame) -> DataFrame:
    """Confidence of races with the mean accuracy that the models had before each race; races before the first
    evaluation keep the default."""
    known = history.groupBy("race_id").agg(F.avg("accuracy_before").alias("_accuracy"))
    w = values.CONFIDENCE_WEIGHTS
    joined = confidence.join(known, "race_id", "left").withColumn("historical_accuracy", F.coalesce("_accuracy", "historical_accuracy")).drop("_accuracy")
    return joined.withColumn("overall_confidence", reduce(lambda a, b: a + b, [F.col(n) * x for n, x in w.items()]))


def fitted(requests: DataFrame, scored: DataFrame, bases: list[str]) -> DataFrame:
    """Ranked predictions of requests from a fitted ensemble: ``scored`` has race_id, driver_id, y_pred and a column of each base
    model; the deviation across them gives the confidence."""
    rows = scored.select("race_id", "driver_id", F.col("y_pred").alias("adjusted"), deviation(bases).alias("spread"), *bases)
    return predict(requests.join(rows, ["race_id", "driver_id"]))


def deviation(bases: Sequence[str]) -> Column:
    """Deviation across the outputs of base models."""
    mean = reduce(lambda a, b: a + b, [F.col(b) for b in bases]) / len(bases)
    square = reduce(lambda a, b: a + b, [(F.col(b) - mean) * (F.col(b) - mean) for b in bases]) / len(bases)
    return F.sqrt(square)


def base_rows(predictions: DataFrame, bases: dict[str, str]) -> DataFrame:
    """Predictions of the base models in long form: race_id, driver_id, model, y_pred."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("y_pred")) for n, c in bases.items()]))
    return predictions.select("race_id", "driver_id", each.alias("m")).select("race_id", "driver_id", "m.*")
