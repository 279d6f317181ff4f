"""A short description of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.aggregates import join_unique
from usagelens.plans.metrics.model import LEVELS, Tables


def overview(t: Tables) -> DataFrame:
    """(item, value): rows and columns, covered time, partitions, level sizes and versions."""
    requests = t["request"]
    facts = requests.agg(
        F.count("*").cast("string").alias("request"),
        F.lit(str(len(requests.columns))).alias("columns"),
        F.min("ts_local").cast("string").alias("ts_first"),
        F.max("ts_local").cast("string").alias("ts_last"),
        F.count_distinct("date_local").cast("string").alias("partitions"),
        F.coalesce(join_unique(F.col("pipeline_version")), F.lit("")).alias("pipeline_version"),
    )
    rows = facts.unpivot([], facts.columns, "item", "value")
    for level in LEVELS[1:]:
        size = t[level].agg(F.count("*").cast("string").alias("value"))
        rows = rows.unionByName(size.select(F.lit(level).alias("item"), "value"))
    return rows
