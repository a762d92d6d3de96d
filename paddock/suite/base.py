"""Registration of a query with its DuckDB counterpart and its result columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.plans import canonical, predictions

# keeps decimal ties such as 0.1612625 from being rounded by the last bit of a sum
_NUDGE = 2e-9
_SPARK = {"b": "bigint", "d": "double", "s": "string", "l": "boolean"}
_DUCK = {"b": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "l": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    columns: str
    extra: str = ""

    def _columns(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The result with plain types; doubles are rounded so that both engines agree."""
        out = []
        for name, kind in self._columns():
            column = F.col(name).cast(_SPARK[kind])
            out.append((F.rint((column + _NUDGE) * 1e6) * 1e-6 + F.lit(0.0) if kind == "d" else column).alias(name))
        return self.build(spark, sf_dir).select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self._columns():
            column = f"CAST({name} AS {_DUCK[kind]})"
            out.append(f"{f'round(({column} + {_NUDGE}::DOUBLE) * 1e6::DOUBLE) * 1e-6::DOUBLE + 0.0::DOUBLE' if kind == 'd' else column} AS {name}")
        return f"WITH {canonical.SQL}{self.extra}\nSELECT {', '.join(out)} FROM (\n{self.sql}\n) AS answer"


def on_tables(build: Callable[[canonical.Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Adapt a function of the canonical tables to (spark, sf_dir)."""
    return lambda spark, sf_dir: build(canonical.tables(spark, sf_dir))


def predicted_query(build: Callable[[predictions.Predicted], DataFrame], sql: str | None, columns: str) -> Query:
    """A query over the stored predictions; its SQL may also use the prediction tables."""
    return Query(lambda spark, sf_dir: build(predictions.predicted(spark, sf_dir)), sql, columns, f",\n{predictions.SQL}")
