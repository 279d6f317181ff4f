"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, SPACE, Stored, numbered

BLOCK_CHARS = 1024


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """(row, idx, n, block) for each block of the normalised text; the first one also carries what is kept of its row."""
    text = F.coalesce("text", F.lit(""))
    rows = numbered(docs, "doc_id", F.length(text).alias("n_chars"), F.regexp_replace(text, SPACE, "").alias("norm"))
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    rows = rows.select(ROW, "doc_id", "n_chars", F.sha2("norm", 256).alias("sha"), cut.alias("blocks")).withColumn(
        "blocks", F.when(F.size("blocks") == 0, F.array(F.lit(""))).otherwise(F.col("blocks"))
    )
    first = F.col("idx") == 0
    return rows.select(ROW, "doc_id", "n_chars", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("idx", "block")).select(
        ROW, "idx", "n", "block", *(F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_chars", "sha"))
    )


def _named(rows: DataFrame, keys: list[str], store: Stored) -> DataFrame:
    """Integer names of the key values that occur more than once: their place in sorted order, partition by partition.

    Values are counted before the exchange, so a value that a third of the rows hold is one row per task. Names are
    written before use, so that they stay the same whatever is lost later.
    """
    again = rows.groupBy(keys).agg(F.count("*").alias("times")).filter("times > 1")
    return store.keep(again.sortWithinPartitions(*keys).select(*keys, F.monotonically_increasing_id().alias("name")), "names")


def exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ..): which rows have equal texts, and which of them stays.

    Texts are equal when they are identical without white space. The normalised text is cut into blocks of ``block_chars``
    code points. Sorted blocks get integer names, then adjacent pairs of names get names of their own, and so on until one
    name is left for each document: equal names mean equal texts, with no hashing in between. What occurs once needs no
    name: a document that holds it equals no other and leaves the recursion there.

    Of equal texts the row with most code points stays, then the smallest doc_id (null last), then the first row.
    Null text counts as empty; all empty texts are equal. Rows that repeat a doc_id are rows of their own. An empty table
    gives no rows. Other columns of ``docs`` are not read.

    Returns _row, doc_id, n_chars, text_sha256 (of the normalised text), n_blocks, group_size, keep_id, kept.
    """
    store = Stored(docs.sparkSession)
    blocks = _blocks(docs, block_chars)
    names = _named(blocks, ["block"], store)
    level = store.keep(blocks.join(names, "block", "left").drop("block"), "level")
    rows = level.filter("idx = 0").select(ROW, "doc_id", "n_chars", "sha", F.col("n").alias("n_blocks"))

    level = level.filter("name is not null").select(ROW, "idx", "n", "name")
    done, depth = [], 0
    while True:
        done.append(level.filter("n = 1").select(ROW, F.lit(depth).alias("depth"), "name"))
        rest = level.filter("n > 1")
        if rest.isEmpty():
            break
        place = F.col("idx") % 2
        pairs = rest.groupBy(ROW, F.expr("idx div 2").cast("int").alias("idx")).agg(
            F.max("n").alias("before"),
            F.max(F.when(place == 0, F.col("name"))).alias("left"),
            F.max(F.when(place == 1, F.col("name"))).alias("right"),
        )
        # The last of an odd number of names pairs with -1, which is no name. Half a pair has lost its document.
        pairs = pairs.select(
            ROW,
            "idx",
            F.expr("cast((before + 1) div 2 as int)").alias("n"),
            "left",
            F.when(F.col("idx") * 2 + 1 >= F.col("before"), F.lit(-1).cast("long")).otherwise(F.col("right")).alias("right"),
        ).filter("left is not null and right is not null")
        pairs = store.keep(pairs, "pairs")
        names = _named(pairs, ["left", "right"], store)
        level = store.keep(pairs.join(names, ["left", "right"]).select(ROW, "idx", "n", "name"), "level")
        depth += 1

    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    members = store.keep(found.join(rows.select(ROW, "doc_id", "n_chars"), ROW), "members")
    best = F.min(F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW))
    groups = members.groupBy("depth", "name").agg(F.count("*").alias("size"), best.alias("best")).filter("size > 1")
    joined = members.select(ROW, "depth", "name").join(groups, ["depth", "name"])
    copies = joined.select(ROW, "size", F.col("best.doc_id").alias("best_id"), F.col(f"best.{ROW}").alias("best_row"))
    alone = F.col("best_row").isNull()
    return rows.join(copies, ROW, "left").select(
        ROW,
        "doc_id",
        "n_chars",
        F.col("sha").alias("text_sha256"),
        "n_blocks",
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        (alone | (F.col("best_row") == F.col(ROW))).alias("kept"),
    )
