"""Which raw files were read, and in which state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.sources.paths import exists, file_system

SCHEMA = (
    "source_path string, file_mtime timestamp, file_size bigint, "
    "ingested_at timestamp, pipeline_version string"
)


def select_pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new, or whose time or size differ from the recorded ones."""
    return files.join(
        manifest.select("source_path", "file_mtime", "file_size"),
        ["source_path", "file_mtime", "file_size"],
        "left_anti",
    )


def upsert_manifest(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries of files that were not read now, then the fresh entries."""
    kept = manifest.join(fresh.select("source_path"), "source_path", "left_anti")
    return kept.unionByName(fresh)


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Complete versions of the manifest, oldest first; an interrupted write has no marker."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    return [n for n in names if n.startswith("v-") and exists(spark, f"{folder}/{n}/_SUCCESS")]


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    versions = _versions(spark, folder)
    if not versions:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/{versions[-1]}")


def write_manifest(manifest: DataFrame, folder: str) -> None:
    """Write the next version beside the one that may still be read."""
    versions = _versions(manifest.sparkSession, folder)
    number = int(versions[-1][2:]) + 1 if versions else 1
    typed = manifest.select("source_path", "file_mtime", "file_size", "ingested_at", "pipeline_version")
    typed.write.mode("overwrite").parquet(f"{folder}/v-{number:09d}")


def manifest_entries(records: DataFrame) -> DataFrame:
    """Manifest rows of records that were read successfully."""
    return records.select(
        "source_path", "file_mtime", F.col("file_size").cast("bigint").alias("file_size"),
        "ingested_at", "pipeline_version",
    )
