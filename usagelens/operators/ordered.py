"""Operators that follow the time order inside a key: drops, positions, gaps.

Each runs its window over (key, piece), see ``heavy.with_piece``, and then joins the pieces of a
key up again from one summary row per piece. Pass ``min_rows=None`` when the keys are known to be
small: the window is then over the key alone and no job is run up front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.operators.heavy import PIECE, staged, with_piece


def pieces(df: DataFrame, key: str, ts: str, min_rows: int | None) -> tuple[DataFrame, bool]:
    if min_rows is None:
        return df.withColumn(PIECE, F.lit(0)), False
    return with_piece(df, key, ts, min_rows)


def inside(key: str, *order: str):
    return Window.partitionBy(key, PIECE).orderBy(*order)


def drop_flag(counter: str, key: str, *order: str) -> Column:
    """1 where the counter is below the previous row of the piece; comparing with null is no drop."""
    previous = F.lag(counter).over(inside(key, *order))
    return F.when(F.col(counter) < previous, 1).otherwise(0)


def seam_aggregates(counter: str, ts: str, tie: str) -> list[Column]:
    """Counter at both ends of a piece, to look for a drop between two pieces."""
    at = F.struct(ts, tie)
    return [F.min_by(counter, at).alias("_first"), F.max_by(counter, at).alias("_last")]


def seam_flag(key: str) -> Column:
    """1 where a piece starts below the end of the piece before it."""
    before = F.lag("_last").over(Window.partitionBy(key).orderBy(PIECE))
    return F.when(F.col("_first") < before, 1).otherwise(0)


def compaction_stats(
    df: DataFrame,
    key: str,
    counter: str,
    ts: str,
    tie: str,
    min_rows: int | None = settings.HEAVY_ROWS,
) -> DataFrame:
    """Per key, how often a counter that should only grow falls: n_segments, has_compaction."""
    rows, _ = pieces(
        df.where(F.col(key).isNotNull()).select(key, counter, ts, tie), key, ts, min_rows
    )
    per_piece = (
        rows.withColumn("_drop", drop_flag(counter, key, ts, tie))
        .groupBy(key, PIECE)
        .agg(F.sum("_drop").alias("_drops"), *seam_aggregates(counter, ts, tie))
    )
    drops = F.sum(F.col("_drops") + F.col("_seam"))
    return (
        per_piece.withColumn("_seam", seam_flag(key))
        .groupBy(key)
        .agg((drops + 1).alias("n_segments"), (drops > 0).alias("has_compaction"))
    )


def position_in(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    out: str = "position",
    min_rows: int | None = settings.HEAVY_ROWS,
) -> DataFrame:
    """Add the 1-based position of a row inside its key. Rows without a key are dropped."""
    rows, split = pieces(df.where(F.col(key).isNotNull()), key, ts, min_rows)
    placed = rows.withColumn(out, F.row_number().over(inside(key, ts, tie)).cast("bigint"))
    if not split:
        return placed.drop(PIECE)
    before = Window.partitionBy(key).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per later piece of a heavy key, written so that a heavy key can be split in the join.
    offsets = staged(
        rows.groupBy(key, PIECE)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(before))
        .where(F.col("_before").isNotNull())
        .select(key, PIECE, "_before")
    )
    return (
        placed.join(offsets, [key, PIECE], "left")
        .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
        .drop(PIECE, "_before")
    )


def gaps(
    df: DataFrame, by: str, ts: str, min_rows: int | None = settings.HEAVY_ROWS
) -> DataFrame:
    """(by, gap_seconds): time since the previous row of the same ``by``, first rows left out."""
    present = df.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(by, ts)
    rows, split = pieces(present, by, ts, min_rows)
    micros = F.unix_micros(ts)
    within = rows.select(
        by, PIECE, ts, (micros - F.lag(micros).over(inside(by, ts))).alias("_gap")
    )
    found = within.where(F.col("_gap").isNotNull()).select(by, "_gap")
    if split:
        ends = rows.groupBy(by, PIECE).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
        before = F.lag("_to").over(Window.partitionBy(by).orderBy(PIECE))
        seams = ends.select(by, (F.unix_micros("_from") - F.unix_micros(before)).alias("_gap"))
        found = found.unionByName(seams.where(F.col("_gap").isNotNull()))
    return found.select(by, (F.col("_gap") / F.lit(1e6)).alias("gap_seconds"))
