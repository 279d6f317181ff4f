"""Raw logs: a folder tree with one JSON document per file."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.sources.paths import file_system

_JSON = "*.json"
#: Marks of a set of paths: at most so many bits, and so many for each path while that is less.
_MARKS, _MARKS_EACH = 1 << 22, 16
_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Listing tasks for each core; Spark's own default is a task for each folder, up to 10,000.
_LISTERS_EACH = 4


def source_path(root_path: str, file_path: Column | str = "_metadata.file_path") -> Column:
    """Path below the root, decoded, with / separators: the key of a raw file."""
    path = F.regexp_replace(file_path, r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substr(decoded, F.lit(len(root_path.rstrip("/")) + 2))


def _root(spark: SparkSession, root: str) -> str:
    fs, path = file_system(spark, root)
    return fs.makeQualified(path).toUri().getPath()


@contextmanager
def _few_listers(spark: SparkSession) -> Iterator[None]:
    """While a reader lists a tree, a task takes many folders: of a folder for each file, a task each costs more than it lists."""
    before, wanted = spark.conf.get(_LISTERS, None), spark.sparkContext.defaultParallelism * _LISTERS_EACH
    spark.conf.set(_LISTERS, str(wanted))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LISTERS)
        else:
            spark.conf.set(_LISTERS, before)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, file_mtime, file_size) of every raw file; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _JSON)
    with _few_listers(spark):
        files = reader.load(root)
    return files.select(
        source_path(_root(spark, root)).alias("source_path"),
        F.col("modificationTime").alias("file_mtime"),
        F.col("length").alias("file_size"),
    )


def after_newest(manifest: DataFrame) -> str | None:
    """The first whole second after every file of the manifest, in the session's zone; None if it has no file.

    The listing filter takes no fractions and excludes the bound itself.
    """
    second = F.date_trunc("second", F.max("file_mtime")) + F.expr("interval 1 second")
    return manifest.agg(F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss")).first()[0]


# Strings of any length that a VARIANT holds, and NaN, are read.
_PARSE = {"maxStringLen": str(2**31 - 1), "allowNonNumericNumbers": "true"}


def parse(text: Column | str) -> Column:
    """A document as VARIANT, null where the text is not JSON."""
    return F.from_json(text, "variant", _PARSE)


def marks(paths: DataFrame) -> np.ndarray:
    """A bit for the hash of each source path, as bytes: a set of any number of paths in bounded space."""
    wanted = paths.count() * _MARKS_EACH
    bits = 64
    while bits < min(wanted, _MARKS):
        bits *= 2
    words = paths.select(F.expr(f"cast(pmod(xxhash64(source_path), {bits}) as int)").alias("at")).selectExpr("at div 64 as word", "shiftleft(1L, at % 64) as bit")
    found = np.zeros(bits // 64, "<i8")
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        found[r["word"]] = r["bits"]
    return found.view(np.uint8)


def _marked(path: Column, found: np.ndarray) -> Column:
    """Whether the bit of a path is set. It only looks at the path, so that Spark decides it while listing files."""
    at = F.pmod(F.xxhash64(path), F.lit(len(found) * 8))
    byte = F.substring(F.lit(bytearray(found.tobytes())), F.floor(at / 8).cast("int") + 1, F.lit(1))
    return F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) % 2 == 1


def read_raw(spark: SparkSession, root: str, modified_after: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """(source_path, file_mtime, file_size, text, v): every raw file as one parsed record.

    Files up to ``modified_after`` are skipped while listing and never opened. With ``only`` (source_path), just the files of
    these paths are read: bits of their hashes decide while listing which files are opened, and a join before parsing, by
    the size of ``only``, removes the few others that share a bit. The paths stay a table, however many there are; the
    driver holds half a megabyte of bits at most. ``v`` is null where the text is not JSON. Of a key that an object repeats,
    the last value counts; for this the session setting for repeated keys is switched on.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _JSON)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    # wholetext has to be an argument: as an option the argument's default overrides it.
    with _few_listers(spark):
        files = reader.text(root, wholetext=True)
    if only is not None:
        files = files.where(_marked(source_path(_root(spark, root)), marks(only)))
    files = _described(files, root)
    if only is not None:
        files = files.join(only.select("source_path"), "source_path", "left_semi")
    return parsed(files)


def _described(files: DataFrame, root: str) -> DataFrame:
    return files.select(
        source_path(_root(files.sparkSession, root)).alias("source_path"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").alias("text"),
    )


def parsed(files: DataFrame) -> DataFrame:
    """Texts of files with ``v``, the parsed document."""
    return files.withColumn("v", parse("text"))


def stream_raw(spark: SparkSession, root: str, files_per_batch: int) -> DataFrame:
    """(source_path, file_mtime, file_size, text) of the files of a folder tree as a stream, each once."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", _JSON).option("maxFilesPerTrigger", files_per_batch)
    return _described(reader.text(root, wholetext=True), root)


def with_error(raw: DataFrame) -> DataFrame:
    """Add ``_error`` struct(error_type, error_message), null for a record that is a JSON object."""
    # The text parsed, so its first character tells an object from anything else.
    is_object = F.col("text").rlike(r"^\s*\{")
    size = F.length("text").cast("string")

    def error(kind: str, message: Column) -> Column:
        return F.struct(F.lit(kind).alias("error_type"), message.alias("error_message"))

    unreadable = F.concat(F.lit("not a JSON document, "), size, F.lit(" characters"))
    other = F.lit("the top level of the document is not an object")
    return raw.withColumn(
        "_error",
        F.when(F.col("v").isNull(), error("invalid JSON", unreadable)).when(
            ~is_object, error("not an object", other)
        ),
    )


def split_bad(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable files): one bad file never stops the others."""
    checked = with_error(raw)
    good = checked.where(F.col("_error").isNull()).drop("_error")
    return good, quarantined(checked)


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("_error").isNotNull()).select("source_path", "_error.*")


def hash_sample(df: DataFrame, key: str, rate: float) -> DataFrame:
    """The same part of the keys on every run: a hash of the key is below the rate."""
    if rate >= 1:
        return df
    digest = F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.where(digest < int(rate * 2**32))
