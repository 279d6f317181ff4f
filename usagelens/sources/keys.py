"""Stored record ids in hash buckets, so that a batch is held against them without moving them.

    folder/_keys/<first commit>/keys/part-*_<bucket>.c000.parquet       (key, source, commit), bucketed and sorted by key
    folder/_keys/<first commit>/dropped/commit=<id>/part-*.parquet      sources whose earlier ids no longer count

An index only ever grows; one that took many commits is followed by a new one. Which commits count, and in which order, is
said by the table's snapshot, so the index changes in the same atomic step as the rows, and what a stopped writer left counts
for nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.operators.literals import value_rows
from usagelens.sources.paths import exists, file_system

#: Least number of buckets of an index. It has as many for good as shuffles had partitions when it began, if that is more:
#: with fewer, Spark would deal both sides of a join anew.
BUCKETS = 32
_INDEX = "_keys"


def _buckets(commit: str) -> int:
    """An index's first commit begins with its number of buckets."""
    return int(commit.split("-")[0])


def _table(spark: SparkSession, home: str, key: T.DataType) -> str:
    """The bucketed table over an index's files, declared for this session; no metastore has to remember it."""
    buckets = _buckets(home.rsplit("/", 1)[1])
    fs, path = file_system(spark, f"{home}/keys")
    place = fs.makeQualified(path).toString()
    name = f"keys_{hashlib.md5(place.encode()).hexdigest()}"
    quoted = place.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (key {key.simpleString()}, source STRING, commit STRING) USING parquet "
        f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{quoted}'"
    )
    spark.catalog.refreshTable(name)
    return name


def add_keys(
    rows: DataFrame, folder: str, key: str, source: str, commits: Sequence[str] = (), dropped: DataFrame | None = None, buckets: int | None = None
) -> str:
    """Store the ids of ``rows`` and the sources ``dropped`` as a commit that no snapshot lists yet; returns its id.

    They go to the index that ``commits`` made, or to a new one. Rows without an id are left out. One file for each bucket
    that is touched.
    """
    spark = rows.sparkSession
    buckets = _buckets(commits[0]) if commits else buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    commit = f"{buckets}-{uuid.uuid4().hex}"
    home = f"{folder}/{_INDEX}/{commits[0] if commits else commit}"
    table = _table(spark, home, rows.schema[key].dataType)
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.lit(commit).alias("commit"))
    keyed.repartition(buckets, "key").sortWithinPartitions("key").write.insertInto(table)
    if dropped is not None:
        dropped.select(F.col(source).cast("string").alias("source")).distinct().write.parquet(f"{home}/dropped/commit={commit}")
    return commit


def stored_keys(spark: SparkSession, folder: str, keys: DataFrame, commits: Sequence[str], dropped: DataFrame | None = None) -> DataFrame:
    """(_k): those of ``keys`` (_k, without null) that the index holds, by its ``commits`` (ascending).

    Only the keys asked for are shuffled; the index is read where its buckets lie. An id counts unless its source was
    dropped by a later commit, or is in ``dropped`` (source) now.
    """
    if not commits:
        return keys.select("_k").limit(0)
    home = f"{folder}/{_INDEX}/{commits[0]}"
    table = spark.table(_table(spark, home, keys.schema["_k"].dataType))
    turns = value_rows(spark, ["commit", "turn"], list(zip(commits, range(len(commits)))))
    met = table.join(keys.select(F.col("_k").alias("key")), "key", "left_semi").join(turns, "commit")
    gone = [place for place in (f"{home}/dropped/commit={c}" for c in commits) if exists(spark, place)]
    if gone:
        fs, path = file_system(spark, f"{home}/dropped")
        later = spark.read.schema("source string, commit string").option("basePath", fs.makeQualified(path).toString()).parquet(*gone)
        later = later.join(turns, "commit").groupBy("source").agg(F.max("turn").alias("dropped_at"))
        met = met.join(later, "source", "left").where(F.col("dropped_at").isNull() | (F.col("turn") >= F.col("dropped_at")))
    if dropped is not None:
        met = met.join(dropped.select(F.col("source").cast("string")).distinct(), "source", "left_anti")
    return met.select(F.col("key").alias("_k")).distinct()


def vacuum_keys(spark: SparkSession, folder: str, live: set[str]) -> None:
    """Delete all indexes but those whose first commit is in ``live``."""
    fs, pattern = file_system(spark, f"{folder}/{_INDEX}/*")
    for status in fs.globStatus(pattern) or ():
        if status.getPath().getName() not in live:
            fs.delete(status.getPath(), True)
