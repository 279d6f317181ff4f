"""Value counts, shares, dominant owners and other counted summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.scalars import null_label, share
from usagelens.operators.literals import value_rows


def value_counts_long(
    df: DataFrame,
    columns: Sequence[str],
    user: str | None = None,
    labelled_nulls: bool = True,
) -> DataFrame:
    """(category, value, n[, n_users]) of several columns in one pass.

    Columns are unpivoted and counted together, with values as text. Nulls are counted under
    '<null>', or dropped when ``labelled_nulls`` is off.
    """
    kept = [user] if user else []
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("category"),
                    (null_label(F.col(c)) if labelled_nulls else F.col(c).cast("string")).alias("value"),
                )
                for c in columns
            ]
        )
    )
    long = df.select(*kept, pairs.alias("_p")).select(*kept, "_p.category", "_p.value")
    if not labelled_nulls:
        long = long.where(F.col("value").isNotNull())
    if user is None:
        return long.groupBy("category", "value").agg(F.count("*").alias("n"))
    # Counting per user first makes the distinct count a plain count of pre-aggregated rows.
    per_user = long.groupBy("category", "value", user).agg(F.count("*").alias("_n"))
    return per_user.groupBy("category", "value").agg(
        F.sum("_n").alias("n"), F.count(user).alias("n_users")
    )


def group_users(df: DataFrame, by: Sequence[str], user: str, n: str = "n_requests") -> DataFrame:
    """(by.., n, n_users): rows and distinct users, pre-aggregated per user."""
    per_user = df.groupBy(*by, user).agg(F.count("*").alias("_n"))
    return per_user.groupBy(*by).agg(F.sum("_n").alias(n), F.count(user).alias("n_users"))


def with_watched(counts: DataFrame, value: str, watched: Sequence[str], zeros: Sequence[str]) -> DataFrame:
    """Add rows with zero counts for watched values that did not occur."""
    listed = value_rows(counts.sparkSession, [value], [(str(w),) for w in watched])
    absent = listed.join(counts.select(value), value, "left_anti").select(
        value, *[F.lit(0).cast("bigint").alias(z) for z in zeros]
    )
    return counts.unionByName(absent, allowMissingColumns=True)


def with_share(df: DataFrame, count: str, out: str, total: Column | None = None) -> DataFrame:
    """Add count / total; the total is the column sum of this (small) report by default."""
    denominator = F.sum(count).over(Window.partitionBy()) if total is None else total
    return df.withColumn(out, share(F.col(count), denominator))


def with_share_exact(df: DataFrame, count: str, key: str, out: str) -> DataFrame:
    """Shares that add up to exactly 1: the rounding residual goes to the largest group.

    Works in whole ten-thousandths; ties for the largest go to the smallest key.
    """
    everything = Window.partitionBy()
    total = F.sum(count).over(everything).cast("double")
    units = F.floor(F.col(count) * F.lit(10000.0) / total + F.lit(0.5)).cast("bigint")
    largest = F.row_number().over(Window.orderBy(F.desc(count), F.asc_nulls_first(key))) == 1
    report = df.withColumn("_units", units)
    residual = F.lit(10000) - F.sum("_units").over(everything)
    fixed = F.col("_units") + F.when(largest, residual).otherwise(0)
    return report.withColumn(out, fixed.cast("double") / F.lit(10000.0)).drop("_units")


def top1_share(df: DataFrame, by: Sequence[str], user: str) -> DataFrame:
    """(by.., n, n_users, top_user, top_n, top_share): the largest user of each group.

    Rows without a user are not counted; ties go to the smallest user.
    """
    per_user = (
        df.where(F.col(user).isNotNull()).groupBy(*by, user).agg(F.count("*").alias("_n"))
    )
    best = F.struct(-F.col("_n"), F.col(user))
    return (
        per_user.groupBy(*by)
        .agg(
            F.sum("_n").alias("n"),
            F.count("*").alias("n_users"),
            F.min_by(user, best).alias("top_user"),
            F.max("_n").alias("top_n"),
        )
        .withColumn("top_share", F.col("top_n").cast("double") / F.col("n").cast("double"))
    )


def owner_rows(df: DataFrame, owner: DataFrame, user: str) -> DataFrame:
    """Rows of the users named in the column ``top_user`` of ``owner``.

    Without a hint: the single owner of an ungrouped ``top1_share`` is known to be one row and is
    broadcast, a longer list is joined by size.
    """
    names = owner.select(F.col("top_user").alias(user))
    return df.join(names, user, "left_semi")


def unseen_values(df: DataFrame, known: dict[str, Sequence[str]]) -> DataFrame:
    """(category, value): values of categorical columns outside the known lists."""
    rows = [(c, v) for c, values in known.items() for v in values]
    listed = value_rows(df.sparkSession, ["category", "value"], rows)
    seen = value_counts_long(df, list(known), labelled_nulls=False).select("category", "value")
    return seen.join(F.broadcast(listed), ["category", "value"], "left_anti")


def mode_of(df: DataFrame, by: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """(by.., out, n): most frequent value of each group, ties to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out), F.max("_n").alias("n")
    )


def constant_violations(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, n_violations): keys in which a supposedly constant column has two values.

    Nulls beside a value are no violation. Comparing min with max needs no distinct count.
    """
    varies = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns])
    )
    counts = varies.agg(*[F.count_if(c).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n_violations")


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key. Equal orders are settled by the row's other columns."""
    last = F.max(F.struct(F.col(order).alias("_order"), F.struct(*df.columns).alias("_row")))
    return df.groupBy(key).agg(last.alias("_last")).select("_last._row.*")


def head_with_annotations(
    df: DataFrame, head: int, order: Sequence[Column], is_annotation: Column
) -> DataFrame:
    """The first rows of a report and every annotation row, with ``row_number`` of the data rows."""
    marked = df.withColumn("_note", F.coalesce(is_annotation, F.lit(False)))
    data = marked.where(~F.col("_note")).orderBy(*order).limit(head)
    numbered = data.withColumn("row_number", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    notes = marked.where("_note").withColumn("row_number", F.lit(None).cast("bigint"))
    return numbered.unionByName(notes).drop("_note")
