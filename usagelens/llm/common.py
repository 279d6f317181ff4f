"""What several operators share: row numbers, stored intermediates, splits by id, connected components."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import usagelens
from usagelens.sources.paths import delete, scratch_dir

#: White space is these six characters and no others, in every operator.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A near duplicate of the corpus pipeline: shingles of five words, similarity of 0.8 or more.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Number of a row within its stored table; tells rows apart whose doc_id repeats or is null.
ROW = "_row"
#: Of a row number, the bits that count within a file.
_FILE_BITS = 40


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, whatever folder the driver was started in.

    Executors on other machines need it installed, or sent along with --py-files.
    """
    root = str(Path(usagelens.__file__).resolve().parents[1])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns asked for, and the row number.

    ``docs`` must read stored Parquet files: the number is made of the file's place among their paths and the row's place
    in the file, so that every pass numbers alike, however the files are split among tasks. The driver gets a path for each
    file that has rows, as it does when it plans the scan.
    """
    path = F.col("_metadata.file_path")
    files = sorted(r[0] for r in docs.select(path.alias("path")).distinct().collect())
    firsts = docs.sparkSession.createDataFrame([(f, i << _FILE_BITS) for i, f in enumerate(files)], "_path string, _first bigint")
    here = docs.select(*columns)
    placed = docs.select(F.struct(*columns).alias("_doc"), path.alias("_at_path"), F.col("_metadata.row_index").alias("_at"))
    placed = placed.join(F.broadcast(firsts), F.col("_at_path") == F.col("_path"))
    return placed.select((F.col("_first") + F.col("_at")).alias(ROW), *(F.col("_doc")[c].alias(c) for c in here.columns))


def keep_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number is in ``rows``, once for each time it is there. All columns stay as they are."""
    return numbered(docs, F.struct("*").alias("doc")).join(rows.select(ROW), ROW).select("doc.*")


class Stored:
    """Intermediates kept as Parquet in the folder that all executors share, so that a lost executor costs no rerun."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folders: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        folder = scratch_dir(self._spark, name)
        df.write.parquet(folder, **options)
        kept = self._spark.read.schema(df.schema).parquet(folder)
        self._folders[id(kept)] = (kept, folder)
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Delete an intermediate that nothing reads any more."""
        delete(self._spark, self._folders.pop(id(kept))[1])


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def even_parts(df: DataFrame, rows_each: int, rows: int) -> DataFrame:
    """Spread few small rows that cost much time each over enough tasks."""
    return df.repartition(max(2, math.ceil(rows / rows_each)))


def components(edges: DataFrame, store: Stored) -> DataFrame:
    """Connected components: (node, component) for every node of ``edges`` (a, b), component the smallest node reached.

    Large-star and small-star in turn. A round links every larger neighbour of a node to its smallest neighbour, and then
    every smaller neighbour too, until the links no longer change; the number of rounds grows with the logarithm of the
    longest path. Links are written after each round. A node's neighbours are only ever aggregated (min), never gathered, and
    the minima are written before they are joined, so that the links of a node that very many share can be split.
    """
    links = store.keep(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = None
    while True:
        both = links.union(links.select("b", "a"))
        lows = store.keep(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "lows")
        large = store.keep(
            both.filter("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large"
        )
        store.drop(links)
        lows = store.keep(large.groupBy("a").agg(F.min("b").alias("low")), "lows")
        down = large.join(lows, "a")
        links = store.keep(
            down.filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(lows.select("a", F.col("low").alias("b")))
            .distinct(),
            "links",
        )
        store.drop(large)
        # Order-free sums over all links: they stay the same exactly when a round changed nothing.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
