"""Finding and splitting keys that hold too many rows for one task.

Keys are found by counting. The list of heavy keys stays a distributed table in the shared folder and is joined by its
size, so any number of keys can be heavy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens import settings
from usagelens.sources.paths import scratch_dir

PIECE = "_piece"


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """The rows, written to the shared folder: for a result that several passes are about to read."""
    folder = scratch_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def heavy_keys(df: DataFrame, keys: Sequence[str], min_rows: int = settings.HEAVY_ROWS) -> DataFrame | None:
    """(keys.., _n): all keys with at least ``min_rows`` rows, or None. Runs one counting job over the key columns."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
    found = staged(counts, "heavy")
    return None if found.isEmpty() else found


def same_keys(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Join condition on key columns in which null equals null."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def rows_of(df: DataFrame, by: Sequence[str], keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose ``by`` columns are (left_semi) or are not (left_anti) in a key table."""
    renamed = keys.select(*[F.col(b).alias(f"_k_{b}") for b in by])
    match = same_keys([F.col(b) for b in by], [F.col(f"_k_{b}") for b in by])
    return df.join(renamed, match, how)


def _number(df: DataFrame, order: str) -> Column:
    """The order column as a number, instants as microseconds."""
    if isinstance(df.schema[order].dataType, T.TimestampType):
        return F.unix_micros(order)
    return F.col(order)


def _cuts(df: DataFrame, key: str, order: Column, heavy: DataFrame, splits: int) -> DataFrame:
    """Values of the order column that cut every heavy key into about equal pieces.

    Written, so that every later use of the cuts sees the same ones.
    """
    marks = [i / splits for i in range(1, splits)]
    cuts = (
        rows_of(df, [key], heavy)
        .groupBy(key)
        .agg(F.percentile_approx(order, marks, 20 * splits).alias("_cuts"))
    )
    return staged(cuts, "cuts")


def with_piece(
    df: DataFrame,
    key: str,
    order: str,
    min_rows: int = settings.HEAVY_ROWS,
    splits: int = settings.HEAVY_SPLITS,
) -> tuple[DataFrame, bool]:
    """Add a piece number that never decreases along ``order`` inside a key; tell if any key is cut.

    Light keys have the single piece 0. Rows with equal ``order`` share a piece, so a window over
    (key, piece) sees the rows in the right order and a later step over the pieces joins them up.
    """
    heavy = heavy_keys(df, [key], min_rows)
    if heavy is None:
        return df.withColumn(PIECE, F.lit(0)), False
    number = _number(df, order)
    cuts = _cuts(df, key, number, heavy, splits)
    below = F.size(F.filter("_cuts", lambda c: c < number))
    piece = F.when(F.col("_cuts").isNull(), 0).otherwise(below)
    return df.join(cuts, key, "left").withColumn(PIECE, piece).drop("_cuts"), True
