"""Race-level features: calendar, weather, grid, history of weather, field strength, importance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions import weather
from paddock.plans.blocks import framed, number_rows


def metadata(race: DataFrame) -> DataFrame:
    """Calendar features of a race."""
    return race.select(
        "race_id", "season", "round", "circuit_id",
        F.date_format("race_date", "yyyy-MM-dd").alias("race_date"),
        F.dayofyear("race_date").alias("day_of_year"),
        F.month("race_date").alias("month"),
        (F.weekday("race_date") >= 5).alias("is_weekend"),
    )


def basic_weather(race: DataFrame) -> DataFrame:
    return race.select("race_id", *[c.alias(n) for n, c in weather.basic(F.col("weather")).items()])


def advanced_weather(race: DataFrame) -> DataFrame:
    return race.select("race_id", *[c.alias(n) for n, c in weather.advanced(F.col("weather")).items()])


def grid_features(qualifying: DataFrame) -> DataFrame:
    """Spread, mean and deviation of the qualifying places of a race."""
    return qualifying.groupBy("race_id").agg(
        (F.max("position") - F.min("position")).alias("grid_spread"),
        F.avg("position").alias("avg_grid_position"),
        F.stddev_pop("position").alias("grid_competitiveness"),
    )


def bundle(race: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Calendar, weather and grid features of every race side by side."""
    return (
        metadata(race)
        .join(basic_weather(race), "race_id")
        .join(grid_features(qualifying), "race_id", "left")
    )


def weather_comparison(race: DataFrame) -> DataFrame:
    """Weather of every race against the mean of all races before its day, and their median temperature; races of the
    first day have no row. History depends on the day alone: means come from running totals of days, of which there
    is one row per calendar day at most."""
    names = ("temperature", "humidity", "wind_speed")
    rows = race.select("race_id", "race_date", *[F.col(f"weather.{n}").alias(n) for n in names])
    totals = rows.groupBy("race_date").agg(*[F.sum(n).alias(f"_{n}") for n in names], *[F.count(n).alias(f"_n_{n}") for n in names])
    before = Window.orderBy("race_date").rowsBetween(Window.unboundedPreceding, -1)
    means = totals.select("race_date", *[F.try_divide(F.sum(f"_{n}").over(before), F.sum(f"_n_{n}").over(before)).alias(f"_{n}") for n in names])
    days = means.join(earlier_medians(rows, "race_date", "temperature").withColumnRenamed("median", "temp_percentile"), "race_date")
    gap = lambda n, to: (F.col(n) - F.col(f"_{n}")).alias(to)
    return rows.join(F.broadcast(days), "race_date").select(
        "race_id", gap("temperature", "temp_vs_avg"), "temp_percentile", gap("humidity", "humidity_vs_avg"), gap("wind_speed", "wind_vs_avg")
    )


#: children of a node of the tree of values, as bits
_BITS = 8


def earlier_medians(rows: DataFrame, day: str, value: str) -> DataFrame:
    """Median of all values before each day, exact: rows (day, median) for days with an earlier value.

    Distinct values are numbered, and their numbers are the leaves of a tree with 256 children to a node. Counts by node and day are summed
    up over the days, and each day goes down the tree by rank, to the value in the middle and the one before it. Days meet only the
    children of the node that they stand at, so rows are days times 256 at each level and no day is paired with its history."""
    known = rows.where(F.col(value).isNotNull()).select(F.col(day).alias("day"), F.col(value).cast("double").alias("v"))
    leaves = number_rows(known.select("v").distinct(), [], [F.col("v")], F.floor("v"), "leaf").withColumn("leaf", F.col("leaf") - 1)
    counts = known.groupBy("day", "v").agg(F.count(F.lit(1)).alias("n")).join(leaves, "v").select("day", "leaf", "n")
    most = leaves.agg(F.max("leaf")).first()[0] or 0  # one number: the height of the tree
    levels = max(1, -(-int(most).bit_length() // _BITS))
    per_day = rows.groupBy(F.col(day).alias("day")).agg(F.count(value).alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("size")
    asked = per_day.select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("size")).where("size > 0")
    rank = lambda side, k: F.struct(F.lit(side).alias("side"), F.floor(k).alias("k"))
    asked = asked.select("day", F.lit(0).cast("long").alias("node"), F.explode(F.array(rank(0, (size - 1) / 2), rank(1, size / 2))).alias("q"))
    asked = asked.select("day", "node", "q.side", "q.k")
    for level in range(levels):
        child = F.shiftright("leaf", _BITS * (levels - 1 - level))
        used = asked.select("node").distinct()
        at_level = counts.groupBy("day", child.alias("child")).agg(F.sum("n").alias("n")).withColumn("node", F.shiftright("child", _BITS)).join(used, "node")
        visits = asked.select("day", "node").distinct().join(at_level.select("node", "child").distinct(), "node")
        both = at_level.select("day", "child", "node", "n", F.lit(False).alias("asked")).unionByName(visits.select("day", "child", "node", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
        earlier = Window.partitionBy("child").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)
        seen = both.withColumn("seen", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("asked").select("day", "node", "child", "seen")
        upto = Window.partitionBy("day", "node").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
        placed = seen.withColumn("less", F.coalesce(F.sum("seen").over(upto), F.lit(0)))
        asked = asked.join(placed, ["day", "node"]).where((F.col("less") <= F.col("k")) & (F.col("k") < F.col("less") + F.col("seen")))
        asked = asked.select("day", F.col("child").alias("node"), "side", (F.col("k") - F.col("less")).alias("k"))
    found = asked.join(leaves, asked["node"] == leaves["leaf"])
    return found.groupBy(F.col("day").alias(day)).agg(F.avg("v").alias("median"))


def field_strength(race: DataFrame, results: DataFrame, last: int = 10) -> DataFrame:
    """Distinct drivers of the ``last`` races before the day of every race, and its constructor diversity; races of the first day
    have no row.

    Races are numbered in time order. A driver of race n is the newest start of that driver for the races up to the next
    one, so race n adds the drivers whose next start is more than d races on to the count that holds d races later:
    ``last`` numbers per race, whatever the field."""
    numbered = time_numbers(race.select("race_id", "race_date"))
    starts = results.select("race_id", "driver_id", "start_no").join(numbered.select("race_id", "race_no"), "race_id")
    following = framed(starts, ["driver_id"], "start_no", {(1, 1): {"_next": lambda w: F.first("race_no").over(w)}})
    lasts = F.coalesce(F.col("_next") - F.col("race_no"), F.lit(last))
    adds = following.groupBy("race_no").agg(*[F.count_if(lasts > d).alias(f"_{d}") for d in range(last)])
    spread = adds.select(F.explode(F.array(*[F.struct((F.col("race_no") + d).alias("at"), F.col(f"_{d}").alias("n")) for d in range(last)])).alias("s"))
    sizes = spread.groupBy("s.at").agg(F.sum("s.n").alias("field_size"))
    first = numbered.groupBy("race_date").agg((F.min("race_no") - 1).alias("at"))  # one row per calendar day
    teams = results.groupBy("race_id").agg(F.count_distinct("constructor_id").alias("constructor_diversity"))
    by_day = first.join(sizes, "at")
    return (
        race.select("race_id", "race_date").join(F.broadcast(by_day.select("race_date", "field_size")), "race_date").join(teams, "race_id")
        .select(
            "race_id", "field_size", "constructor_diversity", F.least("field_size", F.lit(8)).alias("championship_contenders"),
            F.least(F.col("constructor_diversity") / 10.0, F.lit(1.0)).alias("competitive_balance"),
        )
    )


def time_numbers(race: DataFrame) -> DataFrame:
    """Number of every race in the order of dates and ids, counted day by day and by the beginning of the id inside a day."""
    day = F.datediff("race_date", F.lit("1970-01-01").cast("date")).cast("long")
    begin = reduce(lambda acc, i: acc * 128 + F.least(F.coalesce(F.ascii(F.substring("race_id", i, 1)).cast("long"), F.lit(0)), F.lit(127)), range(len("race_") + 1, len("race_") + 5), F.lit(0))
    return number_rows(race, [], [F.col("race_date"), F.col("race_id")], day * 2**28 + begin, "race_no", upper=day)


def guarded_correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL when one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def feature_importance(results: DataFrame, race: DataFrame) -> DataFrame:
    """Absolute correlation of numeric columns with the place of classified finishers (10 rows or more)."""
    rows = results.where("finished").join(race.select("race_id", "weather"), "race_id")
    names = {
        "grid_position": F.col("grid_position"),
        "points": F.col("points"),
        "temperature": F.col("weather.temperature"),
        "humidity": F.col("weather.humidity"),
        "rainfall": F.col("weather.rainfall").cast("double"),
    }
    y = F.col("final_position").cast("double")
    row = rows.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.abs(guarded_correlation(x.cast("double"), y)).alias(n) for n, x in names.items()],
    ).where(F.col("_n") >= 10)
    return row.unpivot("_n", list(names), "feature", "importance").where(F.col("importance").isNotNull()).drop("_n")
