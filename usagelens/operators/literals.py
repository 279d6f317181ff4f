"""Tiny constant tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def value_rows(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A few literal rows; all values of a column must have one type."""
    structs = [
        F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows
    ]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")
