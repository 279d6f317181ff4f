"""Incremental ingest: raw files to the request table."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.contract import REQUEST_SCHEMA
from usagelens.operators.dedupe import dedupe, drop_keys
from usagelens.sources import manifest as M
from usagelens.sources import raw as R
from usagelens.sources import tables as T
from usagelens.sources.flatten import flatten
from usagelens.sources.paths import delete, scratch_dir
from usagelens.sources.snapshots import vacuum


@dataclass(frozen=True)
class Places:
    """Where a data set lives."""

    raw: str
    requests: str
    manifest: str
    quarantine: str


def _stage(spark: SparkSession, places: Places, manifest: DataFrame, pending: DataFrame, at: datetime.datetime, tz: str):
    """Parse the pending files once and park the typed rows, good and bad, in the shared folder, counted as they are written.

    Whatever is newer than all recorded files is pending, so a bound on the time is enough to list it. Pending files from
    before that are late, were touched or could not be read last time; they stay a table, see ``read_raw``.
    """
    bound = R.after_newest(manifest)
    keep = ("file_mtime", "file_size", "_error")
    records = R.read_raw(spark, places.raw, bound)
    if bound is not None:
        late = pending.where(F.col("file_mtime") <= F.lit(bound).cast("timestamp"))
        if not late.isEmpty():
            records = records.union(R.read_raw(spark, places.raw, only=late))
    rows = flatten(R.with_error(records), F.lit(at), tz=tz, keep=keep)
    return write_read(rows)


def ingest(
    spark: SparkSession,
    places: Places,
    run_id: str,
    at: datetime.datetime | None = None,
    tz: str = settings.TIMEZONE,
    keep_snapshots: int = 1,
) -> DataFrame:
    """Bring the request table up to date with the raw folder and report what was done.

    Old rows of a changed file go and new rows come in one atomic commit of the table, with the ids that it stores; a file
    that cannot be read now keeps its old rows. Stored ids are looked up as if the old rows were gone already, else they
    would block their replacement. The manifest is written last: after a crash the same files are read again, and rows that
    were already stored are recognised by their request id. Older snapshots than the last ``keep_snapshots`` are removed.
    """
    at = at or datetime.datetime.now()
    files = R.list_files(spark, places.raw)
    manifest = M.read_manifest(spark, places.manifest)
    pending = M.select_pending(files, manifest)
    n_files, n_pending = files.count(), pending.count()
    if n_pending == 0:
        return _report(spark, scanned=n_files, skipped=n_files)

    staged = _stage(spark, places, manifest, pending, at, tz)
    return store_batch(spark, places, staged, run_id, manifest, keep_snapshots, scanned=n_files, skipped=n_files - n_pending)


def store_batch(
    spark: SparkSession, places: Places, staged: Written, run_id: str, manifest: DataFrame, keep_snapshots: int = 1,
    batch: tuple[str, int] | None = None, **facts: int,
) -> DataFrame:
    """Bring parked records into the tables: quarantine, request table in one commit, manifest; then the report.

    A ``batch`` (stream, number) that the request table holds already changes nothing there.
    """
    good = staged.rows.where(F.col("_error").isNull())
    T.write_run(R.quarantined(staged.rows), places.quarantine, run_id)

    entries = M.manifest_entries(good)
    again = entries.join(manifest.select("source_path"), "source_path", "left_semi")
    n_again = again.count()
    again = again if n_again else None

    base = T.prepare_requests(spark, places.requests)
    rows = dedupe(good.select(*REQUEST_SCHEMA.names), "request_id", "source_path")
    ids = good.where(F.col("request_id").isNotNull()).select(F.col("request_id").alias("_k")).distinct()
    ready = write_kept(drop_keys(rows, T.stored_ids(spark, places.requests, base, ids, again), "request_id"))
    replaced = 0
    if batch is None or T.last_batch(base, batch[0]) < batch[1]:
        replaced = T.commit_requests(spark, places.requests, base, ready.rows if ready.facts["rows"] else None, again, batch)
    M.write_manifest(M.upsert_manifest(manifest, entries), places.manifest)
    for part in (staged, ready):
        delete(spark, part.folder)
    vacuum(spark, places.requests, keep_snapshots)
    return ingest_summary(staged, ready, reprocessed=n_again, replaced_rows=replaced, **facts)


_COUNTS = (
    "scanned", "processed", "skipped", "failed", "rows", "partitions", "reprocessed", "replaced_rows", "duplicates",
)


def _report(spark: SparkSession, **facts) -> DataFrame:
    schema = ", ".join(f"{c} bigint" for c in _COUNTS) + ", ts_min string, ts_max string"
    row = tuple(facts.get(c, 0) for c in _COUNTS) + (facts.get("ts_min"), facts.get("ts_max"))
    return spark.createDataFrame([row], schema)


class Written(NamedTuple):
    """Rows in the shared folder, and what was observed while they were written."""

    folder: str
    rows: DataFrame
    facts: dict


def _written(df: DataFrame, name: str, **facts: Column) -> Written:
    """Write rows and gather facts on them in the same job."""
    spark = df.sparkSession
    seen, folder = Observation(f"{name}-{uuid.uuid4().hex}"), scratch_dir(spark, name)
    df.observe(seen, *[c.alias(n) for n, c in facts.items()]).write.parquet(folder)
    return Written(folder, spark.read.schema(df.schema).parquet(folder), seen.get)


def write_read(rows: DataFrame) -> Written:
    """Park typed records, good and bad (``_error``), and count them."""
    bad = F.col("_error").isNotNull()
    return _written(rows, "ingest", processed=F.count_if(~bad), failed=F.count_if(bad))


def write_kept(rows: DataFrame) -> Written:
    """Park the rows to be stored; the dates are counted as the set of them, which is small."""
    return _written(
        rows,
        "ready",
        rows=F.count(F.lit(1)),
        partitions=F.size(F.collect_set(F.coalesce("date_local", F.lit("")))).cast("bigint"),
        ts_min=F.min("ts_local").cast("string"),
        ts_max=F.max("ts_local").cast("string"),
    )


def ingest_summary(staged: Written, kept: Written, **facts: int) -> DataFrame:
    """The report of a batch, from what was observed while it was written. Nothing is read again."""
    facts |= {**staged.facts, **kept.facts, "duplicates": staged.facts["processed"] - kept.facts["rows"]}
    return _report(staged.rows.sparkSession, **facts)
