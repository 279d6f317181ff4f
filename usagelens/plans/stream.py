"""New raw files as a stream of micro-batches into the same tables that ``ingest`` fills."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelens import settings
from usagelens.plans.ingest import Places, ingest, store_batch, write_read
from usagelens.sources import manifest as M
from usagelens.sources import raw as R
from usagelens.sources.flatten import flatten


def apply_batch(spark: SparkSession, records: DataFrame, number: int, places: Places, stream: str, at: datetime.datetime, tz: str) -> DataFrame:
    """Store one micro-batch of parsed records; returns its report.

    The number of the last batch of the stream changes with the rows in one commit, so a batch that comes again after a
    crash adds nothing to the table, wherever the first attempt stopped; the manifest is written either way.
    """
    rows = flatten(R.with_error(records), F.lit(at), tz=tz, keep=("file_mtime", "file_size", "_error"))
    staged = write_read(rows)
    manifest = M.read_manifest(spark, places.manifest)
    return store_batch(spark, places, staged, f"{stream}-{number:09d}", manifest, batch=(stream, number), scanned=sum(staged.facts.values()))


def follow(
    spark: SparkSession,
    places: Places,
    checkpoint: str,
    stream: str = "raw",
    at: datetime.datetime | None = None,
    tz: str = settings.TIMEZONE,
    files_per_batch: int = 100_000,
    **trigger: object,
) -> StreamingQuery:
    """Start a query that stores files as they arrive; ``trigger`` as for ``writeStream.trigger``, else all there is, once.

    A file stream knows paths, so it does not see files that change; ``catch_up`` reads these again.
    """
    found = R.stream_raw(spark, places.raw, files_per_batch)

    def store(batch: DataFrame, number: int) -> None:
        apply_batch(spark, R.parsed(batch), number, places, stream, at or datetime.datetime.now(), tz)

    return found.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def catch_up(spark: SparkSession, places: Places, run_id: str, at: datetime.datetime | None = None, tz: str = settings.TIMEZONE) -> DataFrame:
    """Read again what the stream can't see: files that changed, or could not be read. No stream may be writing meanwhile."""
    return ingest(spark, places, run_id, at, tz)
