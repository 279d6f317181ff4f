"""Hiding the ratios of groups that are too small or that one user dominates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.operators.concentration import flagged_groups

REASON = "suppression_reason"
EXEMPT = "exempt by policy: this dimension groups requests, not people"
TOTAL_NOTE = "the total row of this table is shown, so this row can be derived"


def ratio_columns(columns: Sequence[str], declared: Sequence[str] | None) -> list[str]:
    """Columns that suppression blanks: the declared ones, else those with a ratio suffix."""
    if declared is not None:
        return [c for c in declared if c in columns]
    return [c for c in columns if c.endswith(settings.RATIO_SUFFIXES)]


def policy_warnings(
    columns: Sequence[str], group_by: Sequence[str], declared: Sequence[str] | None
) -> list[str]:
    """What a reader must be told about a declaration that cannot take full effect."""
    found = []
    if declared is None and not ratio_columns(columns, None):
        found.append("grouped, but no ratio column was found: nothing is suppressed")
    for d in group_by:
        if d not in columns:
            found.append(f"dimension {d} is not in the output")
        elif d not in settings.CONCENTRATION_DIMENSIONS and "n_users" not in columns:
            found.append(f"dimension {d} is exempt, but the output has no n_users to judge it by")
    return found


def rule_warnings(rules: DataFrame | None, group_by: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Dimensions that should be suppressed but have no rules. Reads the small rule table."""
    covered = [d for d in group_by if d in settings.CONCENTRATION_DIMENSIONS and d in columns]
    if not covered:
        return []
    present = set()
    if rules is not None:
        wanted = rules.where(F.col("dimension").isin(covered)).select("dimension").distinct()
        present = {r.dimension for r in wanted.collect()}
    return [f"dimension {d} has no suppression rules: not suppressed" for d in covered if d not in present]


def suppress(
    data: DataFrame,
    group_by: Sequence[str],
    declared: Sequence[str] | None,
    rules: DataFrame | None,
    total_row: bool = False,
    min_group: int = settings.MIN_GROUP_SIZE,
    dominant: float = settings.DOMINANT_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(data with hidden ratios and a reason column, the groups that were hidden).

    Each dimension is judged on its own. A flagged group keeps its counts and loses its ratios.
    The thresholds are those the rules were made with; they only appear in the reasons.
    """
    spark = data.sparkSession
    columns = ("dimension", "group_value", "reason", "suppressed_columns")
    nothing = spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in columns])
    ratios = ratio_columns(data.columns, declared)
    if not group_by:
        return data, nothing
    names = data.columns
    reasons: list[Column] = []
    hits: list[Column] = []
    hidden = []
    flagged = flagged_groups(rules, min_group, dominant) if rules is not None else None
    for d in group_by:
        if d not in names:
            continue
        if d not in settings.CONCENTRATION_DIMENSIONS:
            reasons.append(F.lit(EXEMPT))
            continue
        if flagged is None or not ratios:
            continue
        rule = flagged.where(F.col("dimension") == d).select(
            F.col("group_value").alias(f"_v_{d}"), F.col("reason").alias(f"_r_{d}")
        )
        data = data.join(rule, F.col(d).cast("string") == F.col(f"_v_{d}"), "left")
        hits.append(F.col(f"_r_{d}").isNotNull())
        reasons.append(F.concat(F.lit(f"{d}: "), F.col(f"_r_{d}")))
        hidden.append(d)
    hit = reduce(lambda a, b: a | b, hits, F.lit(False))
    if total_row:
        reasons.append(F.when(hit, F.lit(TOTAL_NOTE)))
    listed = nothing
    for d in hidden:
        groups = data.where(F.col(f"_r_{d}").isNotNull()).select(
            F.lit(d).alias("dimension"),
            F.col(d).cast("string").alias("group_value"),
            F.col(f"_r_{d}").alias("reason"),
            F.lit(",".join(ratios)).alias("suppressed_columns"),
        )
        listed = listed.unionByName(groups.distinct())
    shown = data.select(
        *[F.when(~hit, F.col(c)).alias(c) if c in ratios else F.col(c) for c in names],
        F.concat_ws("; ", *reasons).alias(REASON),
    )
    return shown, listed
