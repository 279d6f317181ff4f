"""How much of each group belongs to one user, and hiding the groups where that is too much."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.functions.aggregates import sum0
from usagelens.functions.scalars import percent1, round4


def concentration(
    df: DataFrame,
    dimensions: Sequence[str],
    user: str,
    weight: str | None = None,
    requests: str | None = None,
    min_group: int = settings.MIN_GROUP_SIZE,
    dominant: float = settings.DOMINANT_THRESHOLD,
) -> DataFrame:
    """One row per (dimension, value) with its users, volume and the share of the largest user.

    ``df`` holds rows, or counts per user when ``requests`` names their column. Rows are first
    summed per (dimensions.., user); only those sums are unpivoted.
    """
    n = F.sum(requests) if requests else F.count("*")
    tokens = sum0(F.col(weight)) if weight else F.lit(0).cast("bigint")
    base = df.groupBy(*dimensions, user).agg(n.alias("_n"), tokens.alias("_t"))
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group_value"))
                for d in dimensions
            ]
        )
    )
    per_user = (
        base.select(user, "_n", "_t", pairs.alias("_p"))
        .where(F.col("_p.group_value").isNotNull() & F.col(user).isNotNull())
        .groupBy("_p.dimension", "_p.group_value", user)
        .agg(F.sum("_n").alias("_n"), F.sum("_t").alias("_t"))
    )
    groups = per_user.groupBy("dimension", "group_value").agg(
        F.count("*").alias("n_users"),
        F.sum("_n").alias("n_requests"),
        F.sum("_t").alias("n_tokens"),
        F.max("_n").alias("_top_n"),
        F.max("_t").alias("_top_t"),
    )
    top = F.col("_top_n").cast("double") / F.col("n_requests")
    top_tokens = F.when(F.col("n_tokens") != 0, F.col("_top_t").cast("double") / F.col("n_tokens"))
    return groups.select(
        "dimension",
        "group_value",
        "n_users",
        "n_requests",
        "n_tokens",
        round4(top).alias("top1_user_share"),
        round4(top_tokens).alias("top1_user_token_share"),
        (F.col("n_users") < min_group).alias("below_min_group_size"),
        (top > dominant).alias("dominant"),
    )


def flagged() -> Column:
    return F.col("below_min_group_size") | F.col("dominant")


def concentration_summary(rules: DataFrame) -> DataFrame:
    """Per dimension, how many groups may show ratios, and which, largest first."""
    usable = ~flagged()
    ranked = F.array_sort(
        F.collect_list(F.when(usable, F.struct(-F.col("n_requests"), F.col("group_value").alias("v"))))
    )
    listed = F.array_join(F.transform(ranked, lambda r: r["v"]), ",")
    return rules.groupBy("dimension").agg(
        F.count("*").alias("n_groups"),
        F.count_if(usable).alias("n_usable"),
        F.count_if("below_min_group_size").alias("n_below_min_group_size"),
        F.count_if("dominant").alias("n_dominant"),
        F.when(listed != "", listed).otherwise(F.lit("(none)")).alias("usable_values"),
        F.every(usable).alias("all_usable"),
    ).orderBy(F.desc("all_usable"), F.desc("n_usable"), "dimension")


def reason_text(
    min_group: int = settings.MIN_GROUP_SIZE, dominant: float = settings.DOMINANT_THRESHOLD
) -> Column:
    """Why a group is flagged; empty when it is not."""
    small = F.concat(F.lit("n_users "), F.col("n_users").cast("string"), F.lit(f" < {min_group}"))
    single = F.concat(
        F.lit("top user "), percent1(F.col("top1_user_share")), F.lit(f"% > {round(100 * dominant)}%")
    )
    return F.concat_ws(
        ", ", F.when(F.col("below_min_group_size"), small), F.when(F.col("dominant"), single)
    )


def flagged_groups(
    rules: DataFrame,
    min_group: int = settings.MIN_GROUP_SIZE,
    dominant: float = settings.DOMINANT_THRESHOLD,
) -> DataFrame:
    """(dimension, group_value, reason) of the groups that must not show ratios."""
    reason = reason_text(min_group, dominant).alias("reason")
    return rules.where(flagged()).select("dimension", "group_value", reason)
