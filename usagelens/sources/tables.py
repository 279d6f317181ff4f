"""The stored tables: requests, levels, registry, rules and run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.contract import PARTITION_COLUMN, REQUEST_SCHEMA
from usagelens.functions.scalars import percent1
from usagelens.operators.counts import latest_by
from usagelens.sources.keys import add_keys, stored_keys
from usagelens.sources.paths import exists
from usagelens.sources.snapshots import Snapshot, adopt, current, is_snapshot_table, read_snapshot, rewrite

REGISTRY_SCHEMA = (
    "username string, account_type string, account_masked string, degree string, entry_year string, "
    "dept_code string, first_seen timestamp_ntz, last_seen timestamp_ntz, n_requests bigint, n_accounts bigint"
)
LEVELS = ("turn", "thread", "user")


def write_requests(df: DataFrame, folder: str) -> None:
    """Add rows to the request table in one atomic commit. An index of ids that the table may have no longer counts."""
    base = current(df.sparkSession, folder)
    rewrite(df.sparkSession, folder, REQUEST_SCHEMA, PARTITION_COLUMN, fresh=df, base=base, notes=_batches(base))


def requests_at(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The request table as of its newest snapshot or an older one; no rows if there is none yet.

    A table that was written without snapshots is read as it lies.
    """
    if is_snapshot_table(spark, folder):
        return read_snapshot(spark, folder, REQUEST_SCHEMA, PARTITION_COLUMN, version)
    if not exists(spark, folder):
        return spark.createDataFrame([], REQUEST_SCHEMA)
    return spark.read.schema(REQUEST_SCHEMA).parquet(folder).select(*REQUEST_SCHEMA.names)


def read_requests(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The request table with its declared types; the date stays text."""
    if not exists(spark, folder):
        raise FileNotFoundError(f"there is no request table at {folder}: ingest raw logs first")
    table = requests_at(spark, folder, version)
    if table.isEmpty():
        raise FileNotFoundError(f"the request table at {folder} has no rows: ingest raw logs first")
    return table


#: Commits that the index of stored ids takes before it is built anew.
INDEX_COMMITS = 100
_BATCH = "batch"


def _key_commits(base: Snapshot) -> tuple[str, ...]:
    return tuple(n for n in base.notes if not n.startswith(f"{_BATCH} "))


def _batches(base: Snapshot, but: str | None = None) -> tuple[str, ...]:
    """Notes (batch, number, stream) of the last micro-batch of each stream."""
    return tuple(n for n in base.notes if n.startswith(f"{_BATCH} ") and n.split(" ", 2)[2] != but)


def last_batch(base: Snapshot, stream: str) -> int:
    """Number of the last micro-batch of a stream that the table holds; -1 if none."""
    return max((int(n.split(" ", 2)[1]) for n in _batches(base) if n.split(" ", 2)[2] == stream), default=-1)


def prepare_requests(spark: SparkSession, folder: str) -> Snapshot:
    """The state that a commit starts from. A table without snapshots is taken over first."""
    if not is_snapshot_table(spark, folder) and exists(spark, folder):
        return adopt(spark, folder, PARTITION_COLUMN)
    return current(spark, folder)


def stored_ids(spark: SparkSession, folder: str, base: Snapshot, ids: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """(_k): those of ``ids`` that the table holds in rows of other sources than ``again`` (source_path).

    They are looked up in the index of stored ids; a table without one is read.
    """
    commits = _key_commits(base)
    if base.folders and not commits:
        table = requests_at(spark, folder, base.version)
        if again is not None:
            table = table.join(again.select("source_path"), "source_path", "left_anti")
        return table.select(F.col("request_id").alias("_k")).join(ids, "_k", "left_semi").distinct()
    return stored_keys(spark, folder, ids, commits, None if again is None else again.select(F.col("source_path").alias("source")))


def commit_requests(
    spark: SparkSession, folder: str, base: Snapshot, fresh: DataFrame | None, again: DataFrame | None = None, batch: tuple[str, int] | None = None
) -> int:
    """Add ``fresh`` and delete the rows of ``again`` (source_path), rows and stored ids in one step; returns how many were deleted.

    The index of ids starts with the first commit, or with all stored rows where it is missing, and is built anew when it has
    taken many commits. ``batch`` (stream, number) is noted with it.
    """
    if fresh is None and again is None:
        return 0
    commits = _key_commits(base)
    indexed = fresh if fresh is not None else spark.createDataFrame([], REQUEST_SCHEMA)
    whole = bool(base.folders) and not 0 < len(commits) < INDEX_COMMITS
    if whole:
        kept = requests_at(spark, folder, base.version)
        kept = kept if again is None else kept.join(again.select("source_path"), "source_path", "left_anti")
        indexed = indexed.select("request_id", "source_path").unionByName(kept.select("request_id", "source_path"))
    before = () if whole else commits
    notes = (*before, add_keys(indexed, folder, "request_id", "source_path", before, again if before else None))
    notes += _batches(base, batch and batch[0])
    notes += (f"{_BATCH} {batch[1]} {batch[0]}",) if batch else ()
    return rewrite(spark, folder, REQUEST_SCHEMA, PARTITION_COLUMN, fresh, again, base=base, notes=notes)


def row_count(spark: SparkSession, folder: str) -> DataFrame:
    """One row n_rows, answered from the file footers."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return spark.read.parquet(folder).agg(F.count("*").alias("n_rows"))


def replace_by_source(
    spark: SparkSession,
    folder: str,
    paths: DataFrame,
    fresh: DataFrame | None = None,
    source: str = "source_path",
    column: str = PARTITION_COLUMN,
    schema: T.StructType = REQUEST_SCHEMA,
) -> int:
    """Delete the rows of re-read files and add ``fresh`` in one atomic commit; returns how many rows were deleted.

    Only the partitions that hold such rows are rewritten, beside those that are still read; see ``snapshots``.
    """
    if not exists(spark, folder):
        return 0
    if not is_snapshot_table(spark, folder):
        adopt(spark, folder, column)
    base = current(spark, folder)
    return rewrite(spark, folder, schema, column, fresh, paths, source, base, _batches(base))


def write_levels(tables: dict[str, DataFrame], folder: str) -> None:
    for level in LEVELS:
        tables[level].write.mode("overwrite").parquet(f"{folder}/{level}")


def read_levels(spark: SparkSession, requests_dir: str, folder: str) -> dict[str, DataFrame]:
    """request, turn, thread and user; a missing level is an error, not an empty table."""
    missing = [level for level in LEVELS if not exists(spark, f"{folder}/{level}")]
    if missing:
        raise FileNotFoundError(f"missing level tables {missing} in {folder}: aggregate first")
    tables = {level: spark.read.parquet(f"{folder}/{level}") for level in LEVELS}
    return {"request": read_requests(spark, requests_dir), **tables}


# CSV keeps milliseconds unless told otherwise.
_CSV = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_registry(registry: DataFrame, folder: str) -> None:
    registry.write.mode("overwrite").options(**_CSV).csv(folder)


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The registry with its codes as text: 08 must not become 8."""
    if not exists(spark, folder):
        raise FileNotFoundError(f"there is no registry at {folder}: validate first")
    return spark.read.schema(REGISTRY_SCHEMA).options(**_CSV).csv(folder)


def write_run(df: DataFrame, folder: str, run_id: str) -> None:
    """Keep a result of one run beside those of the other runs."""
    df.write.mode("overwrite").parquet(f"{folder}/run_id={run_id}")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs kept in a folder. Run ids are text, whatever they look like: 007 is not 7, and 1.10 is not 1.1."""
    found = spark.read.parquet(folder).schema
    typed = T.StructType([T.StructField(f.name, T.StringType() if f.name == "run_id" else f.dataType) for f in found])
    return spark.read.schema(typed).parquet(folder)


def latest_snapshot(runs: DataFrame, run_id: str, column: str = "run_id") -> DataFrame:
    """Rows of this run, else of the newest run before it."""
    newest = runs.where(F.col(column) <= run_id).agg(F.max(column)).scalar()
    return runs.where(F.col(column) == newest)


def snapshot_id(runs: DataFrame, run_id: str, column: str = "run_id") -> str | None:
    """Which run ``latest_snapshot`` takes; None if there is none up to this one."""
    return runs.where(F.col(column) <= run_id).agg(F.max(column)).first()[0]


def latest_per_metric(summaries: DataFrame) -> DataFrame:
    """The newest summary row of each metric: a run may have covered only some of them."""
    return latest_by(summaries, "name", "run_id")


def coverage_lookup(summaries: DataFrame) -> DataFrame:
    """(name, coverage_text): newest coverage of each metric as a percentage, or 'failed'."""
    good = (F.col("status") == "success") & F.col("coverage").isNotNull()
    text = F.when(good, F.concat(percent1(F.col("coverage")), F.lit("%"))).otherwise(F.lit("failed"))
    return latest_per_metric(summaries).select("name", text.alias("coverage_text"))
