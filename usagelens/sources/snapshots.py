"""A partitioned table whose state is a list of live folders, replaced in one atomic step.

    folder/<column>=<value>/commit=<id>/part-*.parquet     rows that one commit wrote for one partition
    folder/_snapshots/000000007                            the live folders after commit 7

Rows are written to folders that nobody reads yet. What makes them part of the table is one rename of a small file, so a
reader sees the table before a commit or after it, wherever a writer stops. Two writers that start from one snapshot can't
both win: the second finds its number taken.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.sources.keys import vacuum_keys
from usagelens.sources.paths import delete, exists, file_system

COMMIT = "commit"
_LOG = "_snapshots"
_WIDTH = 9
#: How Spark names the folder of a null.
_NULL = "__HIVE_DEFAULT_PARTITION__"


class ConcurrentCommit(RuntimeError):
    """Another writer committed first; read the table again and repeat."""


class Snapshot(NamedTuple):
    """State of a table: its number (0 before the first commit), its live folders, relative to the table's, and notes of its
    writer that change with it, such as the commits of its key index that count."""

    version: int = 0
    folders: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()


def is_snapshot_table(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/{_LOG}")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the snapshots that are kept, ascending."""
    fs, path = file_system(spark, f"{folder}/{_LOG}")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit())


def current(spark: SparkSession, folder: str, version: int | None = None) -> Snapshot:
    """The newest snapshot, or the one of that number."""
    if version is None:
        kept = versions(spark, folder)
        if not kept:
            return Snapshot()
        version = kept[-1]
    fs, path = file_system(spark, _entry(folder, version))
    if not fs.exists(path):
        raise FileNotFoundError(f"{folder} has no snapshot {version}")
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    state = json.loads(text)
    return Snapshot(version, tuple(state["folders"]), tuple(state["notes"]))


def _entry(folder: str, version: int) -> str:
    return f"{folder}/{_LOG}/{version:0{_WIDTH}d}"


def publish(
    spark: SparkSession, folder: str, base: Snapshot, drop: Iterable[str] = (), add: Iterable[str] = (), notes: tuple[str, ...] | None = None
) -> Snapshot:
    """Make ``base`` without the folders ``drop`` and with ``add`` the table's state: the atomic step of every commit.

    ``notes`` are those from now on; without it they stay as they are.
    """
    gone = set(drop)
    live = tuple(sorted({f for f in base.folders if f not in gone} | set(add)))
    after = Snapshot(base.version + 1, live, base.notes if notes is None else notes)
    draft = f"{folder}/{_LOG}/.draft-{uuid.uuid4().hex}"
    fs, path = file_system(spark, draft)
    stream = fs.create(path, False)
    try:
        stream.write(bytearray(json.dumps({"folders": after.folders, "notes": after.notes}, indent=0).encode()))
    finally:
        stream.close()
    _rename_new(spark, draft, _entry(folder, after.version))
    return after


def _rename_new(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file to a name that must be free."""
    jvm = spark._jvm
    to, options = jvm.org.apache.hadoop.fs.Path(target), spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(file_system(spark, target)[0].getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(jvm.org.apache.hadoop.fs.Path(source), to, options)
    except Exception as error:
        if exists(spark, target):
            delete(spark, source)
            raise ConcurrentCommit(f"{target} was written by another commit") from error
        raise


def read_folders(spark: SparkSession, folder: str, folders: Iterable[str], schema: T.StructType, column: str) -> DataFrame:
    """Rows of some live folders, with the partition column as text. Partition values prune as usual."""
    typed = T.StructType([T.StructField(f.name, T.StringType() if f.name == column else f.dataType) for f in schema])
    if column not in typed.names:
        typed = typed.add(column, "string")
    # Commit ids are text; without a declared type an id such as 00012345 would turn into a number.
    typed = T.StructType([*typed.fields, T.StructField(COMMIT, T.StringType())])
    places = [f"{folder}/{f}" for f in folders]
    if not places:
        return spark.createDataFrame([], typed)
    fs, path = file_system(spark, folder)
    return spark.read.schema(typed).option("basePath", fs.makeQualified(path).toString()).parquet(*places)


def read_snapshot(spark: SparkSession, folder: str, schema: T.StructType, column: str, version: int | None = None) -> DataFrame:
    """The table's rows as of its newest snapshot, or of an older one that is kept. Only live folders are listed."""
    found = read_folders(spark, folder, current(spark, folder, version).folders, schema, column)
    return found.select(*schema.names)


def write_partitioned(df: DataFrame, folder: str, *columns: str) -> None:
    """Add rows by partition columns with files of even size, however uneven the partitions of the first one are."""
    df.hint("rebalance", columns[0]).write.partitionBy(*columns).mode("append").parquet(folder)


def write_commit(df: DataFrame, folder: str, column: str) -> list[str]:
    """Write rows as a new commit that no snapshot lists yet; returns its folders."""
    spark, commit = df.sparkSession, uuid.uuid4().hex
    write_partitioned(df.withColumn(COMMIT, F.lit(commit)), folder, column, COMMIT)
    fs, pattern = file_system(spark, f"{folder}/*/{COMMIT}={commit}")
    return [f"{s.getPath().getParent().getName()}/{s.getPath().getName()}" for s in fs.globStatus(pattern) or ()]


def folders_of(rows: DataFrame) -> DataFrame:
    """(folder, n): live folders that rows of a snapshot table come from, and how many do."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    parts = F.split(path, "/")
    folder = F.concat_ws("/", F.element_at(parts, -3), F.element_at(parts, -2))
    return rows.select(folder.alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


def rewrite(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    column: str,
    fresh: DataFrame | None = None,
    again: DataFrame | None = None,
    source: str = "source_path",
    base: Snapshot | None = None,
    notes: tuple[str, ...] | None = None,
) -> int:
    """Delete the rows whose ``source`` is in ``again`` and add ``fresh``, in one commit. Returns how many were deleted.

    Only folders that hold deleted rows are written again. A writer that stops anywhere before the last step leaves the old
    table, and folders that ``vacuum`` removes. ``base`` is the snapshot that the caller decided by (else the newest one), and
    ``notes`` what ``publish`` takes.
    """
    base = current(spark, folder) if base is None else base
    touched, rows = {}, []
    if again is not None and base.folders:
        again = again.select(source).distinct()
        table = read_folders(spark, folder, base.folders, schema, column)
        placed = table.select(source, "_metadata").join(again, source, "left_semi")
        # One small row for each folder, never for each file or row.
        touched = {r["folder"]: r["n"] for r in folders_of(placed).collect()}
        if touched:
            rows.append(read_folders(spark, folder, touched, schema, column).select(*schema.names).join(again, source, "left_anti"))
    if fresh is not None:
        rows.append(fresh.select(*schema.names))
    added = write_commit(rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]), folder, column) if rows else []
    if touched or added or notes is not None:
        publish(spark, folder, base, touched, added, notes)
    return sum(touched.values())


def compact(spark: SparkSession, folder: str, schema: T.StructType, column: str, commits: int = 8) -> int:
    """Merge the folders of each partition that has ``commits`` of them or more, in one commit. Returns how many were merged."""
    base = current(spark, folder)
    by_value: dict[str, list[str]] = {}
    for f in base.folders:
        by_value.setdefault(f.split("/")[0], []).append(f)
    merged = [f for group in by_value.values() if len(group) >= max(2, commits) for f in group]
    if merged:
        added = write_commit(read_folders(spark, folder, merged, schema, column).select(*schema.names), folder, column)
        publish(spark, folder, base, merged, added)
    return len(merged)


def vacuum(spark: SparkSession, folder: str, keep: int = 2, depth: int = 1) -> list[str]:
    """Forget all but the newest ``keep`` snapshots, and delete the folders that none of these lists. Returns the folders.

    Commits lie ``depth`` folders below: one for a table, two for a set of tables with one snapshot. Folders of stopped writers go too, so no writer may be at work. Readers of a snapshot that is forgotten fail on the
    next file they open; they never read a mixture.
    """
    kept = versions(spark, folder)
    states = [current(spark, folder, v) for v in kept[-keep:]]
    live = {f for state in states for f in state.folders}
    vacuum_keys(spark, folder, {state.notes[0] for state in states if state.notes})
    for version in kept[:-keep]:
        delete(spark, _entry(folder, version))
    fs, pattern = file_system(spark, f"{folder}/{'*/' * depth}{COMMIT}=*")
    dead = []
    for status in fs.globStatus(pattern) or ():
        path = status.getPath()
        name = "/".join(path.toString().split("/")[-depth - 1 :])
        if name not in live:
            fs.delete(path, True)
            dead.append(name)
            if not fs.listStatus(path.getParent()):
                fs.delete(path.getParent(), False)
    return sorted(dead)


def partition_folders(spark: SparkSession, folder: str, column: str) -> dict[str | None, list[str]]:
    """Folders that hold each value of the partition column, of a table with snapshots or without; null is None."""
    if is_snapshot_table(spark, folder):
        live = current(spark, folder).folders
    else:
        live = [s.getPath().getName() for s in file_system(spark, folder)[0].globStatus(file_system(spark, f"{folder}/{column}=*")[1]) or ()]
    found: dict[str | None, list[str]] = {}
    for name in sorted(live):
        found.setdefault(partition_value(name), []).append(f"{folder}/{name}")
    return found


def partition_value(name: str) -> str | None:
    """The value that a folder's name stands for."""
    value = unquote(name.split("/")[0].split("=", 1)[1])
    return None if value == _NULL else value


def adopt(spark: SparkSession, folder: str, column: str) -> Snapshot:
    """Turn a plain table, folder/<column>=<value>/*.parquet, into a snapshot table by moving its files.

    A stop half way leaves files at both places; adopt it again.
    """
    fs, pattern = file_system(spark, f"{folder}/{column}=*/*.parquet")
    commit = f"{COMMIT}=plain"
    for status in fs.globStatus(pattern) or ():
        path = status.getPath()
        home = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), commit)
        fs.mkdirs(home)
        fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(home, path.getName()))
    moved = fs.globStatus(file_system(spark, f"{folder}/{column}=*/{commit}")[1]) or ()
    return publish(spark, folder, Snapshot(), add=[f"{s.getPath().getParent().getName()}/{commit}" for s in moved])
