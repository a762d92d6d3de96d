"""Ordered computations that stay exact when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` sorts a whole key group in a single task. The helpers here
cut every group into bounded pieces with a rule that depends on the data alone, so a piece is the
same after a lost executor is replaced, and then put the pieces together through small tables of
per-piece totals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536
#: lines of a race for each piece that its field is numbered in
PIECE = 4096


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    name: str,
    prior: str | None = None,
    count_from: DataFrame | None = None,
    upper: Column | None = None,
    prior_of: Column | None = None,
    one_chunk: bool = False,
) -> DataFrame:
    """Dense 1-based row number ``name`` inside each key group, following ``order``.

    ``chunk`` must never decrease along ``order``; rows are numbered inside (keys, chunk) and
    shifted by the number of rows in earlier chunks. ``prior`` names a column that keeps this
    shift, i.e. the number of rows in strictly earlier chunks; with ``prior_of``, the first part of
    ``order``, it is the number of rows where that is strictly smaller. ``count_from`` may name an
    earlier, cheaper frame with the same rows (a stored table) for counting the chunks. ``upper``, a
    coarser value that never decreases along ``chunk``, makes the shifts in two levels: where a group has
    very many chunks, no window sees more than those of one upper value, or all upper values.
    ``one_chunk`` says that every group is short: rows are sent by ``keys`` alone and nothing is shifted.
    """
    if one_chunk:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    rows = df.withColumn("_chunk", chunk.cast("long"))
    sizes = rows if count_from is None else count_from.withColumn("_chunk", chunk.cast("long"))
    if upper is not None:
        return _numbered_in_levels(rows, sizes.withColumn("_upper", upper), keys, order, name)
    shifts = (
        sizes.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_shift",
            F.sum("_rows").over(
                Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_rows")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    out = rows.withColumn("_local", local)
    if prior_of is not None:
        out = out.withColumn("_smaller", F.rank().over(Window.partitionBy(*keys, "_chunk").orderBy(prior_of)) - 1)
    out = out.join(shifts, [*keys, "_chunk"], "left")
    shift = F.coalesce("_shift", F.lit(0))
    out = out.withColumn(name, F.col("_local") + shift)
    if prior:
        out = out.withColumn(prior, shift if prior_of is None else F.col("_smaller") + shift)
    return out.drop("_chunk", "_local", "_shift", "_smaller")


def _numbered_in_levels(rows: DataFrame, sizes: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    before = lambda by, *parts: F.coalesce(F.sum("_rows").over(Window.partitionBy(*parts).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = sizes.groupBy(*keys, "_upper", "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    uppers = chunks.groupBy(*keys, "_upper").agg(F.sum("_rows").alias("_rows")).select(*keys, "_upper", before("_upper", *keys).alias("_outer"))
    shifts = chunks.select(*keys, "_upper", "_chunk", before("_chunk", *keys, "_upper").alias("_inner")).join(uppers, [*keys, "_upper"])
    shifts = shifts.select(*keys, "_chunk", (F.col("_inner") + F.col("_outer")).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    out = rows.withColumn("_local", local).join(shifts, [*keys, "_chunk"])
    return out.withColumn(name, F.col("_local") + F.col("_shift")).drop("_chunk", "_local", "_shift")


def with_blocks(
    df: DataFrame, number: str, before: int = 0, after: int = 0, block: int = BLOCK
) -> DataFrame:
    """Assign rows to blocks of ``block`` consecutive numbers, with copies at the edges.

    A frame of ``before`` rows back and ``after`` rows ahead over (keys, ``_block``) then sees the
    same rows as over the whole group. Keep only ``_own`` rows afterwards (see ``framed``).
    """
    at = (F.col(number) - 1).cast("long")
    home = F.floor(at / block)
    targets = [home]
    if before:
        targets.append(F.when(F.pmod(at, F.lit(block)) >= block - before, home + 1))
    if after:
        targets.append(F.when((F.pmod(at, F.lit(block)) < after) & (home > 0), home - 1))
    if len(targets) == 1:
        return df.withColumn("_block", home).withColumn("_own", F.lit(True))
    return df.withColumn("_block", F.explode(F.array_compact(F.array(*targets)))).withColumn(
        "_own", F.col("_block") == home
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    number: str,
    frames: dict[tuple[int | None, int], dict],
    block: int = BLOCK,
    keep_block: bool = False,
    one_block: bool = False,
) -> DataFrame:
    """Add window columns over row frames, e.g. ``{(-4, 0): {"mean": lambda w: F.avg("x").over(w)}}``.

    A lower bound of None starts at the first row of the block; use it only for values whose
    offset does not matter, such as the abscissa of a slope. ``keep_block`` leaves ``_block`` in
    place, so that ``running`` can go on without another shuffle. ``one_block`` says that every group is short:
    rows are sent by ``keys`` alone and none is copied.
    """
    before = max(0, -min(lo for lo, _ in frames if lo is not None))
    after = max(0, max(hi for _, hi in frames))
    out = df if one_block else with_blocks(df, number, before, after, block)
    base = Window.partitionBy(*keys, *([] if one_block else ["_block"])).orderBy(number)
    for (lo, hi), columns in frames.items():
        window = base.rowsBetween(Window.unboundedPreceding if lo is None else lo, hi)
        out = out.withColumns({name: build(window) for name, build in columns.items()})
    return out if one_block else out.where("_own").drop("_own", *([] if keep_block else ["_block"]))


def by_field(rows: DataFrame, work: Callable[[DataFrame, bool], DataFrame], largest: int = PIECE) -> DataFrame:
    """``work(rows, short)`` on the races of fewer than ``largest`` lines (``short``), whose rows may be sent by race alone and once
    for several windows, and on the others, which are cut into pieces. Rows that do not say their ``lines`` count as the latter."""
    if "lines" not in rows.columns:
        return work(rows, False)
    short = F.coalesce(F.col("lines") < largest, F.lit(False))
    return work(rows.where(short), True).unionByName(work(rows.where(~short), False))


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    number: str,
    sizes: Sequence[int],
    steps: Sequence[dict],
    block: int = BLOCK,
    lags: dict[str, int] | None = None,
    one_block: bool = False,
) -> DataFrame:
    """Sums over the last n rows for several n, as differences of running totals.

    Each step adds running totals from expressions over the row and over totals of earlier steps.
    For every total ``x`` and size n the result holds ``x`` (up to the row) and ``x_n`` (up to the
    row n places back, 0 where there is none); the cost per row does not grow with n. ``lags``
    adds earlier values of a column, ``column_1``, ``column_2``, ... ``_block`` stays in place. ``one_block`` says that
    every group is short: none is cut, and rows that lie by ``keys`` are not sent again.
    """
    lags = lags or {}
    out = df.withColumn("_block", F.lit(0)) if one_block else with_blocks(df, number, before=max(*sizes, *lags.values(), 1), block=block)
    base = Window.partitionBy(*keys, "_block").orderBy(number)
    upto = base.rowsBetween(Window.unboundedPreceding, 0)
    for step in steps:
        out = out.withColumns({name: F.sum(c).over(upto) for name, c in step.items()})
    totals = [name for step in steps for name in step]
    out = out.withColumns(
        {f"{x}_{n}": F.coalesce(F.lag(x, n).over(base), F.lit(0.0)) for x in totals for n in sizes}
        | {f"{c}_{i}": F.lag(c, i).over(base) for c, depth in lags.items() for i in range(1, depth + 1)}
    )
    return out if one_block else out.where("_own").drop("_own")


def running(
    df: DataFrame,
    keys: Sequence[str],
    number: str,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    block: int = BLOCK,
    long: DataFrame | None = None,
    one_block: bool = False,
) -> DataFrame:
    """Running sums and maxima from the start of each group up to the row itself.

    Only groups longer than one block need totals of earlier blocks. ``long`` may list their keys
    (or the first few key columns) from a stored table, which is cheaper than finding them in
    ``df``. ``one_block`` says that there are none: the totals inside blocks are all there is, and no row is sent again.
    """
    sums, maxima = sums or {}, maxima or {}
    rows = df if "_block" in df.columns else with_blocks(df, number, block=block).drop("_own")
    upto = (
        Window.partitionBy(*keys, "_block").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = {**{n: F.sum(c).over(upto) for n, c in sums.items()}, **{n: F.max(c).over(upto) for n, c in maxima.items()}}
    if one_block:
        return rows.withColumns(inside).drop("_block")
    if long is None:
        long = df.where(F.col(number) > block).select(*keys).distinct()
    totals = rows.join(long, long.columns, "left_semi").groupBy(*keys, "_block").agg(
        *[F.sum(c).alias(f"_c_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_c_{n}") for n, c in maxima.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_block",
        *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in maxima],
    ).where(F.col("_block") > 0)
    out = rows.withColumns(inside).join(carry, [*keys, "_block"], "left")
    fixed = {
        n: F.when(F.col(f"_c_{n}").isNull(), F.col(n))
        .when(F.col(n).isNull(), F.col(f"_c_{n}"))
        .otherwise(F.col(n) + F.col(f"_c_{n}"))
        for n in sums
    }
    fixed |= {n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in maxima}
    return out.withColumns(fixed).drop("_block", *[f"_c_{n}" for n in [*sums, *maxima]])


def histogram(df: DataFrame, keys: Sequence[str], value: str, chunk: Column, count: str | None = None) -> DataFrame:
    """Distinct values of each group with counts and positions: _v, _n, _start, _end, _total. ``count`` names the column that
    says how many rows a row stands for.

    ``_start`` is the 0-based position of the first row with that value in the sorted group.
    ``chunk`` must never decrease in the value.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"), chunk.cast("long").alias("_chunk"))
        .agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("_n"))
    )
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        counts.groupBy(*keys, "_chunk")
        .agg(F.sum("_n").alias("_rows"))
        .select(
            *keys, "_chunk", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"), F.sum("_rows").over(by_key).alias("_total")
        )
    )
    upto = Window.partitionBy(*keys, "_chunk").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("_end", F.sum("_n").over(upto))
        .join(shifts, [*keys, "_chunk"])
        .withColumn("_end", F.col("_end") + F.col("_shift"))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .drop("_chunk", "_shift")
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, chunk: Column) -> DataFrame:
    """Add the 1-based rank of ``value`` in its group; equal values share their mean rank."""
    ranks = histogram(df, keys, value, chunk).select(
        *keys, F.col("_v").alias(value), (F.col("_start") + (F.col("_n") + 1) / 2.0).alias(name)
    )
    return df.join(ranks, [*keys, value])


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    chunk: Column,
    count: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key group.

    Works on the histogram of distinct values, cut by ``chunk`` (never decreasing in the value),
    so no group of values is held in one aggregation buffer.
    """
    placed = histogram(df, keys, value, chunk, count)
    aggs = []
    for name, q in quantiles.items():
        at = (F.col("_total") - 1) * F.lit(float(q))
        low, part = F.floor(at), at - F.floor(at)
        holds = lambda i: (F.col("_start") <= i) & (i < F.col("_end"))
        aggs.append(F.max(F.when(holds(low), F.col("_v"))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when(holds(F.least(low + 1, F.col("_total") - 1)), F.col("_v"))).alias(f"_hi_{name}"))
        aggs.append(F.max(part).alias(f"_part_{name}"))
    out = placed.groupBy(*keys).agg(F.max("_total").alias("n_values"), *aggs)
    return out.select(
        *keys,
        "n_values",
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n)
            for n in quantiles
        ],
    )


def edge_rows(df: DataFrame, keys: Sequence[str], number: str, k: int, block: int = BLOCK) -> DataFrame:
    """The first ``k`` and last ``k`` rows of each group as ``from_start`` / ``from_end`` (1-based).

    Every block passes on at most 2k rows, so the last step sees few rows per group.
    """
    up = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(number)))
    down = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(number).desc()))
    inner = [*keys, "_block"]
    few = (
        with_blocks(df, number, block=block)
        .withColumns({"from_start": up(inner), "from_end": down(inner)})
        .where((F.col("from_start") <= k) | (F.col("from_end") <= k))
        .drop("_block", "_own")
    )
    return few.withColumns({"from_start": up(keys), "from_end": down(keys)}).where(
        (F.col("from_start") <= k) | (F.col("from_end") <= k)
    )
