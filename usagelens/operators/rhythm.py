"""How regular the requests of a user are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.functions.aggregates import share_true
from usagelens.operators.heavy import staged
from usagelens.operators.ordered import gaps
from usagelens.operators.quantiles import exact_quantiles

MIN_GAPS = 3


def cadence(
    df: DataFrame, by: str, ts: str, min_rows: int | None = settings.HEAVY_ROWS
) -> DataFrame:
    """(by, n_gaps, median_gap, tight_share): typical gap and the share within half to twice it.

    Fewer than three gaps say nothing about rhythm: median and share are then null.
    """
    # The gaps are read once for their number, for the medians and for the shares.
    between = staged(gaps(df, by, ts, min_rows))
    counts = between.groupBy(by).agg(F.count("*").alias("n_gaps"))
    medians = exact_quantiles(
        between, [by], "gap_seconds", (0.5,), min_rows or settings.HEAVY_ROWS
    ).withColumnRenamed("p50", "_median")
    # Written before the join: joined where it was aggregated, a hot key could not be split.
    medians = staged(medians, "medians")
    near = F.col("gap_seconds").between(0.5 * F.col("_median"), 2 * F.col("_median"))
    tight = between.join(medians, by).groupBy(by).agg(
        F.max("_median").alias("_median"), share_true(near).alias("_tight")
    )
    enough = F.col("n_gaps") >= MIN_GAPS
    return counts.join(tight, by).select(
        by,
        "n_gaps",
        F.when(enough, F.col("_median")).alias("median_gap"),
        F.when(enough, F.col("_tight")).alias("tight_share"),
    )
