"""Parsing of source texts: lap times, statuses, places, dates, and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paddock import values


def lap_time_ms(text: Column) -> Column:
    """Milliseconds of "m:ss.fff"; the fraction is read as a whole number, NULL when malformed."""
    pattern = r"^\s*(\d+):(\d+)(?:\.(\d+))?\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    whole = (part(1).try_cast("long") * 60 + part(2).try_cast("long")) * 1000
    return F.when(text.rlike(pattern), whole + F.coalesce(part(3).try_cast("long"), F.lit(0)))


def lap(text: Column, number: Column) -> Column:
    """A lap struct, NULL without a readable time."""
    ms = lap_time_ms(text)
    return F.when(ms.isNotNull(), F.struct(ms.alias("time_ms"), number.cast("int").alias("lap_number")))


def race_status(text: Column) -> Column:
    """finished, disqualified, dns or dnf; everything unknown counts as dnf."""
    low = F.lower(text)
    return (
        F.when(low.contains("finished") | text.rlike(r"^[0-9]+$"), "finished")
        .when(low.contains("disqualified"), "disqualified")
        .when(low.contains("did not start"), "dns")
        .otherwise("dnf")
    )


def place(text: Column) -> Column:
    """A finishing place; anything but digits means not classified."""
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).otherwise(F.lit(values.NOT_CLASSIFIED))


def race_time(date: Column, time: Column) -> Column:
    """Timestamp of a date and an optional UTC time."""
    clock = F.regexp_replace(F.coalesce(time, F.lit("00:00:00Z")), "Z$", "")
    return F.try_to_timestamp(F.concat_ws(" ", date, clock), F.lit("yyyy-MM-dd HH:mm:ss"))


def confidence_text(c: Column) -> Column:
    return F.when(c > 0.8, "High").when(c > 0.6, "Medium").otherwise("Low")


def percentage(v: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", v * 100)


def duration(seconds: Column) -> Column:
    """Seconds as text in seconds, minutes or hours."""
    return (
        F.when(seconds < 60, F.format_string("%.0f seconds", seconds))
        .when(seconds < 3600, F.format_string("%.1f minutes", seconds / 60))
        .otherwise(F.format_string("%.1f hours", seconds / 3600))
    )


def overtaking_label(factor: Column) -> Column:
    return F.when(factor > 0.7, "Easy").when(factor > 0.4, "Moderate").otherwise("Difficult")


def supporting_text(data: Column) -> Column:
    """Values of a map formatted by their names: shares as percent, places as P-n."""
    share = lambda k: k.contains("probability") | k.contains("confidence")
    return F.transform_values(
        data,
        lambda k, v: F.when(share(k), F.format_string("%.1f%%", v * 100))
        .when(k.contains("position"), F.format_string("P%d", v.cast("int")))
        .otherwise(v.cast("string")),
    )


def weather_summary(conditions: Column, temperature: Column, humidity: Column, grip: Column) -> dict[str, Column]:
    """Dryness of the conditions and the values shown beside it, with defaults."""
    return {
        "dryness": F.when(conditions == "dry", 1.0).when(conditions == "mixed", 0.5).otherwise(0.0),
        "temperature": F.coalesce(temperature, F.lit(25.0)),
        "humidity": F.coalesce(humidity, F.lit(60.0)),
        "grip": F.coalesce(grip, F.lit(0.9)),
    }
