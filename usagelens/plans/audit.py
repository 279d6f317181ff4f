"""Comparing the fields that occur in raw records with the fields that are read."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.contract import source_map
from usagelens.functions.scalars import round4
from usagelens.functions.variant import is_object, kind, to_text
from usagelens.operators.heavy import staged
from usagelens.operators.literals import value_rows
from usagelens.sources.raw import hash_sample, split_bad

# Levels that are expanded in one pass; what is deeper goes on from the shared folder.
LEVELS_AT_ONCE = 8


def walk_paths(df: DataFrame, key: str, v: str = "v", levels: int | None = None) -> DataFrame:
    """(key, path, kind, is_container, text): every path of every record, however deep.

    Objects are expanded, lists are leaves, {} is a container without leaves. Each step replaces an
    object by itself as a container and its entries. A record stays one row while its levels are opened, eight at once and
    no more than it has; then its entries become rows. The entries that are still open then are walked on until none is
    left. ``levels`` asks for a shallow overview instead: objects below are shown as leaves of kind 'object'.
    """
    root = F.struct(F.lit("").alias("path"), F.col(v).alias("node"), F.lit(True).alias("open"))
    rows = df.select(F.col(key).alias("key"), root.alias("e"))
    found = []
    while True:
        entries = rows.select("key", _opened(F.array("e"), levels or LEVELS_AT_ONCE).alias("_entries"))
        flat = entries.select("key", F.explode("_entries").alias("e")).select("key", "e.*")
        # What is done goes to the folder as text and kind, not as a document to be read again.
        done = F.lit(True) if levels else ~F.col("open")
        leaf = done & F.col("node").isNotNull()
        named = flat.select(
            "key", "path", F.when(~done, F.col("node")).alias("node"), (~done).alias("open"), F.col("node").isNull().alias("is_container"),
            F.when(leaf, kind(F.col("node"))).alias("_type"), F.when(leaf, F.coalesce(to_text(F.col("node")), F.lit("null"))).alias("text"),
        )
        parked = staged(named, "paths")
        found.append(parked.where(~F.col("open")).drop("node", "open"))
        if levels:
            break
        deeper = parked.where("open")
        if deeper.isEmpty():
            break
        rows = deeper.select("key", F.struct("path", "node", "open").alias("e"))
    return reduce(DataFrame.union, found).where(F.col("path") != "").select(
        "key", "path", F.when(~F.col("is_container"), _kind_label(F.col("_type"))).alias("kind"), "is_container", "text"
    )


def _opened(entries: Column, levels: int) -> Column:
    """Entries with the objects among them opened so many times; what has none left is passed on as it is."""

    def step(found: Column, _: Column) -> Column:
        return F.when(F.exists(found, lambda e: e["open"]), F.flatten(F.transform(found, _expand))).otherwise(found)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), entries, step)


def _expand(e: Column) -> Column:
    entries = F.map_entries(F.try_variant_get(e["node"], "$", "map<string,variant>"))
    prefix = F.when(e["path"] == "", F.lit("")).otherwise(F.concat(e["path"], F.lit(".")))
    # A JSON null comes out of the map as SQL null, which is how containers are marked.
    null = F.parse_json(F.lit("null"))
    children = F.transform(
        entries,
        lambda c: F.struct(
            F.concat(prefix, c["key"]).alias("path"),
            F.coalesce(c["value"], null).alias("node"),
            is_object(c["value"]).alias("open"),
        ),
    )
    closed = F.struct(
        e["path"].alias("path"), F.lit(None).cast("variant").alias("node"), F.lit(False).alias("open")
    )
    itself = F.struct(e["path"].alias("path"), e["node"].alias("node"), e["open"].alias("open"))
    return F.when(e["open"], F.concat(F.array(closed), children)).otherwise(F.array(itself))


def _kind_label(k: Column) -> Column:
    return (
        F.when(k == "STRING", F.lit("string"))
        .when(k == "BIGINT", F.lit("integer"))
        .when(k.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit("number"))
        .when(k == "BOOLEAN", F.lit("boolean"))
        .when(k.startswith("ARRAY"), F.lit("list"))
        .when(k.startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lit("null"))
    )


def is_redacted(path: Column, prefixes: Sequence[str] = settings.REDACTED_PATHS) -> Column:
    """Paths that carry user content: neither they nor anything below them may show samples."""
    found = F.lit(False)
    for p in prefixes:
        found = found | (path == p) | path.startswith(p + ".")
    return found


def sample_text(text: Column) -> Column:
    """What a report may show of a value: its start, or only its length when it is long."""
    long = F.concat(F.lit("<"), F.length(text).cast("string"), F.lit(" characters, not shown>"))
    return F.when(F.length(text) > settings.SAMPLE_MAX_CHARS, long).otherwise(
        F.substring(text, 1, settings.SAMPLE_TRUNCATE)
    )


def path_stats(
    paths: DataFrame,
    n_records: Column,
    prefixes: Sequence[str] = settings.REDACTED_PATHS,
    max_samples: int = settings.MAX_SAMPLES,
) -> DataFrame:
    """One row per leaf path: how often, which types, how varied, how long, and a few samples.

    Every record repeats the common paths, so values are first counted per (path, kind, length) and
    per (path, value); only those counts are grouped by path.
    """
    leaves = paths.where(~F.col("is_container"))
    by_length = leaves.groupBy("path", "kind", F.length("text").alias("length")).agg(
        F.count("*").alias("c")
    )
    kinds = by_length.groupBy("path", "kind").agg(F.sum("c").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct(-F.col("c"), F.col("kind").alias("kind"), "c")))
    labelled = F.transform(ordered, lambda k: F.concat(k["kind"], F.lit(":"), k["c"].cast("string")))
    types = kinds.groupBy("path").agg(
        F.sum("c").alias("n_records"), F.array_join(labelled, ",").alias("types")
    )
    running = Window.partitionBy("path").orderBy("length")
    lengths = by_length.groupBy("path", "length").agg(F.sum("c").alias("c"))
    ranked = lengths.withColumn("_end", F.sum("c").over(running)).withColumn(
        "_n", F.sum("c").over(Window.partitionBy("path"))
    )
    # The lower median: position floor((n - 1) / 2) of the sorted lengths.
    middle = F.floor((F.col("_n") - 1) / F.lit(2))
    at_middle = (F.col("_end") - F.col("c") <= middle) & (middle < F.col("_end"))
    sizes = ranked.groupBy("path").agg(
        F.sum(F.when(F.col("length") > 0, F.col("c")).otherwise(0)).alias("n_non_empty"),
        F.max(F.when(at_middle, F.col("length"))).cast("bigint").alias("length_p50"),
        F.max("length").cast("bigint").alias("length_max"),
    )
    values = (
        leaves.groupBy("path", F.xxhash64("text").alias("_h"))
        .agg(F.lit(1).alias("_one"))
        .groupBy("path")
        .agg(F.count("*").alias("n_values"))
    )
    samples = _samples(leaves.where(~is_redacted(F.col("path"), prefixes)), max_samples)
    redacted = is_redacted(F.col("path"), prefixes)
    return (
        types.join(sizes, "path")
        .join(values, "path")
        .join(samples, "path", "left")
        .select(
            "path",
            "n_records",
            round4(F.col("n_records").cast("double") / n_records).alias("share"),
            "types",
            "n_values",
            "n_non_empty",
            "length_p50",
            "length_max",
            redacted.alias("redacted"),
            F.coalesce("samples", F.lit("")).alias("samples"),
        )
    )


def _samples(leaves: DataFrame, n: int) -> DataFrame:
    """The first distinct values of each path, in the order of the records they come from."""
    first = (
        leaves.groupBy("path", sample_text(F.col("text")).alias("value"))
        .agg(F.min("key").alias("_at"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("path").orderBy("_at", "value")))
        .where(F.col("_rank") <= n)
    )
    listed = F.array_sort(F.collect_list(F.struct("_rank", "value")))
    joined = F.array_join(F.transform(listed, lambda s: s["value"]), " | ")
    return first.groupBy("path").agg(joined.alias("samples"))


def declared_paths(df: DataFrame, declared: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(column, path) the request table is read from."""
    rows = source_map() if declared is None else list(declared)
    return value_rows(df.sparkSession, ["column", "path"], rows)


def unmapped(stats: DataFrame, declared: DataFrame) -> DataFrame:
    """Paths that occur and are not read."""
    found = stats.join(declared.select("path"), "path", "left_anti")
    return found.orderBy(F.desc("n_records"), "path")


def missing(paths: DataFrame, declared: DataFrame) -> DataFrame:
    """(column, path) declared but absent, both as a value and as a container.

    Only a full scan can tell: a sample misses rare paths.
    """
    present = paths.select("path").distinct()
    return declared.join(present, "path", "left_anti").select("column", "path").orderBy("column", "path")


def catalogue(stats: DataFrame, declared: DataFrame) -> DataFrame:
    """Every path with the flag whether it is read."""
    read = declared.select("path").distinct().withColumn("mapped", F.lit(True))
    return (
        stats.join(read, "path", "left")
        .withColumn("mapped", F.coalesce("mapped", F.lit(False)))
        .orderBy(F.desc("n_records"), "path")
    )


def run_audit(raw: DataFrame, folder: str, write_all: bool = False, sample_rate: float = 1.0) -> None:
    """Walk the records once into the given folder and write the reports beside the paths.

    ``raw`` is as ``read_raw`` gives it. Files that hold no JSON object are left out, of the number of records too, and
    listed under ``unreadable``. With a ``sample_rate`` below 1 the same part of the files is taken on every run; rare
    paths can then seem to be missing.
    """
    good, bad = split_bad(hash_sample(raw, "source_path", sample_rate))
    bad.write.mode("overwrite").parquet(f"{folder}/unreadable")
    walk_paths(good, "source_path").write.mode("overwrite").parquet(f"{folder}/paths")
    paths = raw.sparkSession.read.parquet(f"{folder}/paths")
    n_records = good.select("source_path").count()
    stats = path_stats(paths, F.lit(n_records))
    declared = declared_paths(raw)
    unmapped(stats, declared).write.mode("overwrite").parquet(f"{folder}/unmapped_fields")
    missing(paths, declared).write.mode("overwrite").parquet(f"{folder}/missing_sources")
    if write_all:
        catalogue(stats, declared).write.mode("overwrite").parquet(f"{folder}/all_fields")
