"""The data contract of the request table: violations stop a run, warnings ask for a look."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.contract import PARTITION_COLUMN, PREDICATES, REQUEST_FIELDS, Field
from usagelens.functions.scalars import client_type
from usagelens.functions.times import wall_clock
from usagelens.operators.counts import unseen_values
from usagelens.operators.literals import value_rows
from usagelens.operators.quantiles import exact_quantiles
from usagelens.sources.snapshots import partition_folders

ROW = "(row)"
KNOWN = {
    "endpoint": settings.KNOWN_ENDPOINTS,
    "provider": settings.KNOWN_PROVIDERS,
    "originator": settings.KNOWN_ORIGINATORS,
}


class ContractError(ValueError):
    """The table breaks its contract; the message lists what, how often and samples."""


def row_checks(tz: str) -> dict[str, Column]:
    """Conditions across columns that every row must meet; unknown counts as broken."""
    return {
        "ts_local is the local time of ts_utc": F.col("ts_local") == wall_clock(F.col("ts_utc"), tz),
        "date_local is the date of ts_local": F.col("date_local")
        == F.to_date("ts_local").cast("string"),
        "client_type agrees with thread_id": F.col("client_type") == client_type(F.col("thread_id")),
    }


def _checks(df: DataFrame, fields: Sequence[Field], tz: str) -> list[tuple[str, str, Column, Column]]:
    """(column, check, broken, value) for every check whose columns are there."""
    present = set(df.columns)
    found = []
    for f in fields:
        if f.name not in present:
            continue
        value = F.col(f.name).cast("string")
        if f.required:
            found.append((f.name, "not null", F.col(f.name).isNull(), value))
        if f.check and f.check != "unique":
            predicate = F.expr(f"`{f.name}` {PREDICATES.get(f.check, f.check)}")
            found.append((f.name, f.check, ~F.coalesce(predicate, F.lit(True)), value))
    if {"ts_local", "ts_utc", "date_local", "client_type", "thread_id"} <= present:
        for name, condition in row_checks(tz).items():
            found.append((ROW, name, ~F.coalesce(condition, F.lit(False)), F.lit(None).cast("string")))
    return found


def _broken(df: DataFrame, fields: Sequence[Field], tz: str, key: str) -> DataFrame:
    """(column, check, value, key) of every broken check; rows without any produce nothing."""
    tests = F.array(
        *[
            F.when(
                broken,
                F.struct(F.lit(c).alias("column"), F.lit(name).alias("check"), value.alias("value")),
            )
            for c, name, broken, value in _checks(df, fields, tz)
        ]
    )
    # The outer form: for the inner one the optimizer repeats all checks in a filter on their number.
    broken = F.explode_outer(F.array_compact(tests)).alias("t")
    found = df.select(F.col(key).alias("key"), broken).where(F.col("t").isNotNull())
    return found.select("t.*", "key")


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """(value, n): values of a unique column that occur more than once."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )


def schema_violations(df: DataFrame, fields: Sequence[Field] = REQUEST_FIELDS) -> list[tuple[str, str]]:
    """Columns that are undeclared, absent or of another type. Needs no data."""
    declared = {f.name: f.spark_type for f in fields}
    actual = {f.name: f.dataType for f in df.schema}
    found = [(c, "undeclared column") for c in sorted(actual.keys() - declared.keys())]
    found += [(c, "missing column") for c in sorted(declared.keys() - actual.keys())]
    found += [
        (c, f"type is {actual[c].simpleString()}, expected {t.simpleString()}")
        for c, t in declared.items()
        if c in actual and actual[c] != t
    ]
    return found


def _folder_violations(spark: SparkSession, places: Sequence[str], fields: Sequence[Field]) -> set[tuple[str, str]]:
    """What is wrong with the columns of the files in some folders. Spark merges their footers; rows are not read."""
    reader = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true")
    try:
        return set(schema_violations(reader.parquet(*places), fields))
    except Exception as error:  # noqa: BLE001 - any failure to merge has the same answer
        if "MERGE" not in str(error).upper():
            raise
        # Files that contradict each other are looked at one by one.
        files = [r.file for r in reader.format("binaryFile").load(list(places)).select(F.col("path").alias("file")).collect()]
        return {v for f in files if f.endswith(".parquet") for v in schema_violations(spark.read.parquet(f), fields)}


def schema_drift(
    spark: SparkSession, folder: str, fields: Sequence[Field] = REQUEST_FIELDS, column: str = PARTITION_COLUMN, at_once: int = 8
) -> DataFrame:
    """(partition_value, column, check): partitions of a stored table whose files have other columns than declared.

    The schema of a DataFrame tells only what was asked for; this compares the footers of each partition's files. Partitions
    are looked at ``at_once`` at a time. The partition column is not in the files and is not compared. An empty table has no
    rows.
    """
    inside = [f for f in fields if f.name != column]
    by_value = partition_folders(spark, folder, column)
    with ThreadPoolExecutor(at_once) as pool:
        found = pool.map(lambda places: _folder_violations(spark, places, inside), by_value.values())
        rows = [(value, c, check) for value, wrong in zip(by_value, found) for c, check in sorted(wrong)]
    return spark.createDataFrame(rows, "partition_value string, column string, check string")


def violations(
    df: DataFrame,
    fields: Sequence[Field] = REQUEST_FIELDS,
    tz: str = settings.TIMEZONE,
    key: str = "source_path",
) -> DataFrame:
    """(column, check, n): how many rows break each check. All checks share one pass."""
    counted = _broken(df, fields, tz, key).groupBy("column", "check").agg(F.count("*").alias("n"))
    present = set(df.columns)
    for f in fields:
        if f.check == "unique" and f.name in present:
            repeated = duplicates(df, f.name).agg(F.sum("n").alias("n")).where(F.col("n") > 0)
            counted = counted.unionByName(
                repeated.select(F.lit(f.name).alias("column"), F.lit("unique").alias("check"), "n")
            )
    shape = schema_violations(df, fields)
    if shape:
        rows = value_rows(df.sparkSession, ["column", "check"], shape)
        counted = counted.unionByName(rows.withColumn("n", F.lit(1).cast("bigint")))
    return counted


def failure_samples(
    df: DataFrame,
    fields: Sequence[Field] = REQUEST_FIELDS,
    tz: str = settings.TIMEZONE,
    key: str = "source_path",
    n: int = 3,
) -> DataFrame:
    """(column, check, samples, keys): values and keys of the first few broken rows per check.

    The rank limit is applied before the shuffle, so a check that every row breaks costs no more.
    """
    first = Window.partitionBy("column", "check").orderBy("key")
    picked = _broken(df, fields, tz, key).withColumn("_rank", F.row_number().over(first)).where(
        F.col("_rank") <= n
    )
    ordered = F.array_sort(
        F.collect_list(F.struct("_rank", F.coalesce("value", F.lit("<null>")).alias("v"), "key"))
    )
    return picked.groupBy("column", "check").agg(
        F.array_join(F.transform(ordered, lambda s: s["v"]), ", ").alias("samples"),
        F.array_join(F.transform(ordered, lambda s: s["key"]), ", ").alias("keys"),
    )


def lag_drift(
    df: DataFrame,
    expected: int = settings.LOG_LAG_EXPECTED_MS,
    tolerance: int = settings.LOG_LAG_TOLERANCE_MS,
) -> DataFrame:
    """(median, drift) of the log lag if it left its tolerance; upstream clocks may have changed."""
    median = exact_quantiles(df, [], "log_lag_ms", (0.5,)).withColumnRenamed("p50", "median")
    drift = median.withColumn("drift", F.col("median") - expected)
    return drift.where(F.abs("drift") > tolerance)


def warnings(df: DataFrame) -> DataFrame:
    """(column, warning, detail): lag drift and category values never seen before."""
    drift = lag_drift(df).select(
        F.lit("log_lag_ms").alias("column"),
        F.lit("median drifted").alias("warning"),
        F.rint("median").cast("bigint").cast("string").alias("detail"),
    )
    unseen = unseen_values(df, KNOWN).select(
        F.col("category").alias("column"), F.lit("unseen value").alias("warning"), F.col("value").alias("detail")
    )
    return drift.unionByName(unseen)


def validate(df: DataFrame, tz: str = settings.TIMEZONE) -> DataFrame:
    """Raise ContractError on any violation, with counts and samples; return the warnings."""
    broken = violations(df, tz=tz).orderBy("column", "check").collect()
    if broken:
        samples = {}
        if not schema_violations(df):
            samples = {(r.column, r.check): r for r in failure_samples(df, tz=tz).collect()}
        lines = []
        for r in broken:
            s = samples.get((r.column, r.check))
            lines.append(
                f"{r.column}: {r.check}: {r.n}" + (f", values {s.samples}, in {s['keys']}" if s else "")
            )
        raise ContractError("the request table breaks its contract:\n" + "\n".join(lines))
    return warnings(df)
