"""Column functions: position scores, ladders, probabilities and expected points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paddock import values


def position_score(position: Column) -> Column:
    """1 for a win, falling by 1/20 per place, never below 0."""
    return F.greatest((F.lit(21.0) - position) / 20.0, F.lit(0.0))


def race_score(position: Column, points: Column, finished: Column) -> Column:
    """Form score of one start: place and points, 0.1 when not classified."""
    return F.when(
        finished, position_score(position) * 0.7 + F.least(points / 25.0, F.lit(1.0)) * 0.3
    ).otherwise(F.lit(0.1))


def weighted_form(scores: Column) -> Column:
    """Mean of an array of scores, oldest first, with weights rising linearly from 0.5 to 1."""
    n = F.size(scores)
    weight = lambda i: F.lit(0.5) + F.lit(0.5) * i / F.greatest(n - 1, F.lit(1))
    total = F.aggregate(F.transform(scores, lambda s, i: s * weight(i)), F.lit(0.0), lambda a, x: a + x)
    weights = F.aggregate(F.transform(scores, lambda s, i: weight(i)), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, total / weights)


def championship_place(points: Column) -> Column:
    """Estimated championship place from a points total."""
    ladder = reduce(
        lambda acc, step: acc.when(points >= step[0], F.lit(step[1])),
        values.LADDER[1:],
        F.when(points >= values.LADDER[0][0], F.lit(values.LADDER[0][1])),
    )
    return ladder.otherwise(F.least(F.lit(20), F.greatest(F.lit(11), (F.lit(21) - points).cast("int"))))


def qualifying_delta(mean_position: Column) -> Column:
    """Distance of the mean qualifying place from midfield, clipped to [-1, 1]; 0 without data."""
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.lit(10.5) - mean_position) / 10.0)), F.lit(0.0))


def mean_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x) / F.size(array)


def edge_means(array: Column) -> tuple[Column, Column]:
    """Means of the first and of the last entries: two each from four entries on, else one each."""
    n = F.size(array)
    first = F.when(n >= 4, (array[0] + array[1]) / 2.0).when(n >= 1, array[0])
    last = F.when(
        n >= 4, (F.try_element_at(array, F.lit(-1)) + F.try_element_at(array, F.lit(-2))) / 2.0
    ).when(n >= 1, F.try_element_at(array, F.lit(-1)))
    return first, last


def place_distribution(position: Column) -> Column:
    """Probabilities of places 1..20: a Gaussian of deviation 2 around the prediction, normalised."""
    raw = [F.exp((F.lit(i) - position) * (F.lit(i) - position) * -0.125) for i in range(1, 21)]
    # the total is bound once per row; inside the inner lambda it would be summed for every place
    bound = F.array(F.struct(F.array(*raw).alias("raw"), reduce(lambda a, b: a + b, raw).alias("total")))
    return F.transform(bound, lambda s: F.transform(s["raw"], lambda x: x / s["total"]))[0]


def expected_points(position: Column) -> Column:
    """Points of a (fractional) place, linear between places, 0 outside 1..10."""
    table = F.array(*[F.lit(float(p)) for p in values.POINTS.values()])
    low = F.floor(position).cast("int")
    part = position - low
    at = lambda i: F.try_element_at(table, F.greatest(F.least(i, F.lit(10)), F.lit(1)))
    return F.when(
        (position >= 1) & (position <= 10), at(low) * (1 - part) + at(low + 1) * part
    ).otherwise(F.lit(0.0))
