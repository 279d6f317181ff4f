"""Removing repeated records, inside a batch and against what is already stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the first row per key in ``order`` (unique per row); rows without a key all stay.

    Only keys and order are aggregated; the keys that really repeat are few, and are joined by their size. Rows without a
    key take no part in it. ``df`` is read twice.
    """
    keyed = df.where(F.col(key).isNotNull())
    firsts = keyed.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    again = firsts.where(F.col("_n") > 1).drop("_n")
    first = F.col("_first").isNull() | (F.col(order) == F.col("_first"))
    kept = keyed.join(again, F.col(key) == F.col("_key"), "left").where(first).select(*df.columns)
    return kept.unionByName(df.where(F.col(key).isNull()))


#: Rows without a key are spread over so many join keys that match nothing.
_SPREAD = 1024


def drop_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``keys`` (_k); rows without a key stay, spread evenly. ``df`` is read once."""
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(_SPREAD))).otherwise(-1)
    named = df.withColumn("_spread", spread).join(keys.select("_k", F.lit(-1).cast("bigint").alias("_s")), (F.col(key) == F.col("_k")) & (F.col("_spread") == F.col("_s")), "left_anti")
    return named.select(*df.columns)


def dedupe_against(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Drop rows whose key is stored already; rows without a key stay and take no part in the join.

    The stored keys are first cut down to those of the batch, so that the cost follows the batch: they are read, but only
    what the batch has again is joined with its rows. ``df`` is read twice. See ``keys`` for stored keys in buckets.
    """
    fresh = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct()
    hits = existing.select(F.col(key).alias("_k")).join(fresh, "_k", "left_semi").distinct()
    return drop_keys(df, hits, key)


def replace_rows(existing: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """Rows of the stored table whose source was not read again, then the fresh rows."""
    again = fresh.select(source).distinct()
    return existing.join(again, source, "left_anti").unionByName(fresh)
