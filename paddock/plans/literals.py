"""Small fixed tables as literal relations, planned without any Python worker."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def literal_table(spark: SparkSession, rows: Iterable[tuple], columns: str) -> DataFrame:
    """A table of strings and numbers written out in the plan; ``columns`` is DDL text."""
    text = lambda v: "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)
    values = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    names = [c.split() for c in columns.split(",")]
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in names)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(n for n, _ in names)})")
