"""Exact quantiles with linear interpolation, for groups of any size.

Groups below ``min_rows`` use the built-in ``percentile``, which keeps the distinct values of a
group in one task. For the heavy groups a sketch first brackets every wanted rank; a second pass
counts what lies below a bracket and ranks only the values inside it. Both passes combine on the
map side, so no group is ever gathered in one place and the result is still exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.functions.scalars import round4
from usagelens.operators.heavy import heavy_keys, rows_of, same_keys, staged

_ACCURACY = 10_000
_GROUP = "_group"


def label(q: float) -> str:
    return f"p{round(q * 100)}"


def _with_quantiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    qs: Sequence[float],
    extra: Sequence[Column],
    min_rows: int,
) -> DataFrame:
    """(keys.., extra.., _q): one aggregate for everything, heavy groups filled in from brackets."""
    v = F.col(value).cast("double")
    wanted = [float(q) for q in qs]
    heavy = heavy_keys(rows.where(F.col(value).isNotNull()), keys, min_rows)
    if heavy is None:
        return rows.groupBy(*keys).agg(*extra, F.percentile(v, wanted).alias("_q"))
    names = [f"_h_{k}" for k in keys]
    listed = heavy.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_n"))
    match = same_keys([F.col(k) for k in keys], [F.col(n) for n in names])
    light = F.percentile(F.when(F.col("_n").isNull(), v), wanted).alias("_light")
    marked = rows.join(listed, match, "left")
    table = marked.groupBy(*keys).agg(*extra, light)
    # Three times the error of the sketch, and two ranks for the interpolation.
    margin = 3 / _ACCURACY + 2 / min_rows
    found = _bracketed(rows.select(*keys, v.alias("_v")), keys, heavy, qs, margin)
    return table.join(found, match, "left").select(
        *keys, *table.columns[len(keys) : -1], F.coalesce("_heavy", "_light").alias("_q")
    )


def _bracketed(
    values: DataFrame, keys: list[str], heavy: DataFrame, qs: Sequence[float], margin: float
) -> DataFrame:
    """(_h_ keys.., _heavy): the quantiles of the heavy groups."""
    values = values.where(F.col("_v").isNotNull())
    marks = [min(max(q + d, 0.0), 1.0) for q in qs for d in (-margin, margin)]
    sketches = (
        rows_of(values, keys, heavy)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("_n"), F.percentile_approx("_v", marks, _ACCURACY).alias("_marks")
        )
    )
    # Written, so that every use sees the same brackets: one short row per heavy group.
    sketches = staged(sketches, "sketches")
    names = [f"_h_{k}" for k in keys]
    brackets = sketches.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)],
        "_n",
        F.posexplode(F.array(*[_bracket(i, q, margin) for i, q in enumerate(qs)])).alias("_i", "_b"),
    )
    above = F.col("_b.lo").isNull() | (F.col("_v") >= F.col("_b.lo"))
    kept = (
        values.join(brackets, same_keys([F.col(k) for k in keys], [F.col(n) for n in names]))
        .where(F.col("_b.hi").isNull() | (F.col("_v") <= F.col("_b.hi")))
        .groupBy(*names, "_n", "_i", F.col("_b.q").alias("_p"), F.when(above, F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    running = Window.partitionBy(*names, "_i").orderBy(F.col("_v").asc_nulls_first())
    ranked = kept.withColumn("_end", F.sum("_c").over(running)).withColumn(
        "_start", F.col("_end") - F.col("_c")
    )
    rank = F.col("_p") * (F.col("_n") - 1)

    def at(position: Column) -> Column:
        hit = (F.col("_start") <= position) & (position < F.col("_end"))
        return F.max(F.when(hit, F.col("_v")))

    ends = ranked.groupBy(*names, "_i", "_n", "_p").agg(
        at(F.floor(rank)).alias("_low"), at(F.ceil(rank)).alias("_high")
    )
    found = F.when(F.floor(rank) == F.ceil(rank), F.col("_low")).otherwise(
        (F.ceil(rank) - rank) * F.col("_low") + (rank - F.floor(rank)) * F.col("_high")
    )
    checked = F.coalesce(found, F.raise_error(F.lit("a quantile lies outside its bracket")))
    by_place = [F.max(F.when(F.col("_i") == i, checked)) for i in range(len(qs))]
    return ends.groupBy(*names).agg(F.array(*by_place).alias("_heavy"))


def _bracket(i: int, q: float, margin: float) -> Column:
    """struct(q, lo, hi); a bracket that reaches an end of the range is open there."""
    none = F.lit(None).cast("double")
    lo = F.col("_marks")[2 * i] if q > margin else none
    hi = F.col("_marks")[2 * i + 1] if q < 1 - margin else none
    return F.struct(F.lit(float(q)).alias("q"), lo.alias("lo"), hi.alias("hi"))


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    qs: Sequence[float] = settings.QUANTILES,
    min_rows: int = settings.HEAVY_ROWS,
) -> DataFrame:
    """(by.., p10, p25, ..): quantiles of the non-null values; null keys form a group."""
    keys = list(by) or [_GROUP]
    rows = df if by else df.withColumn(_GROUP, F.lit("all"))
    table = _with_quantiles(rows.select(*keys, value), keys, value, qs, [], min_rows)
    cells = [F.col("_q")[i].alias(label(q)) for i, q in enumerate(qs)]
    return table.select(*by, *cells)


def quantile_table(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    qs: Sequence[float] = settings.QUANTILES,
    extra: Sequence[Column] = (),
    min_rows: int = settings.HEAVY_ROWS,
) -> DataFrame:
    """(by.., n, extra.., quantiles.., max), numbers to four decimals.

    Every group of ``df`` has a row, with null quantiles if it has no value. Without ``by`` there
    is one row.
    """
    keys = list(by) or [_GROUP]
    rows = df if by else df.withColumn(_GROUP, F.lit("all"))
    top = round4(F.max(F.col(value).cast("double"))).alias("max")
    table = _with_quantiles(rows, keys, value, qs, [F.count(value).alias("n"), *extra, top], min_rows)
    names = [c for c in table.columns if c not in (*keys, "max", "_q")]
    cells = [round4(F.col("_q")[i]).alias(label(q)) for i, q in enumerate(qs)]
    return table.select(*by, *[F.col(f"`{n}`") for n in names], *cells, "max")
