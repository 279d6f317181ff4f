"""Token ids in binary files: frequency-ranked, byte-aligned, with control bytes of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.common import Stored
from usagelens.llm.tokens import ID_TYPE, batch_slices, encoder
from usagelens.sources.paths import scratch_dir

END_ID = 2
#: Ids of a block: what is coded and decoded at a time. A longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: Largest number of bytes of a value: a control byte has two bits for each of four values.
_WIDEST = 4

# Lengths of the four values of each control byte, lowest bits first.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values. A last group of less than four is filled up with zeros."""
    v = np.zeros(-(-len(values) // 4) * 4, np.uint32)
    v[: len(values)] = values
    lengths = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = (lengths - 1).reshape(-1, 4).astype(np.uint8)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.cumsum(lengths)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = ends - lengths
    for k in range(_WIDEST):
        has = lengths > k
        data[first[has] + k] = (v[has] >> (8 * k)) & 0xFF
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` values: lengths by table lookup, places by running sums."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    first = np.cumsum(lengths) - lengths
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(_WIDEST, np.uint8)])
    values = np.zeros(len(lengths), np.uint32)
    for k in range(_WIDEST):
        values |= np.where(lengths > k, raw[first + k].astype(np.uint32) << np.uint32(8 * k), np.uint32(0))
    return values[:n]


def _in_ranges(docs: DataFrame) -> DataFrame:
    """chunk, doc_id, text in ascending order of doc_id: chunks are ranges, in order, and each lies in one partition, sorted.

    Rows that share a doc_id are told apart by their place in their file, so that one id that many rows share does not fill
    one range, and no text is looked at for it.
    """
    placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_at_path"), F.col("_metadata.row_index").alias("_at"))
    order = (F.col("doc_id").asc_nulls_first(), "_at_path", "_at")
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select(F.spark_partition_id().alias("chunk"), "doc_id", "text")


def _token_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int) -> DataFrame:
    """Blocks of whole documents in ascending order of doc_id: (chunk, before, doc_ids, lengths, ids, counts).

    Chunks are ranges of ids, in order; ``before`` counts the ids of earlier blocks of the chunk. A last row of each chunk,
    without ids, says how often it has each id.
    """
    ordered = _in_ranges(docs)
    kind = dict(docs.dtypes)["doc_id"]
    end = np.array([end_id], ID_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        ids_of, docs_of, size, before, chunk, out_schema = [], [], 0, 0, None, None
        total = np.zeros(0, np.int64)

        def row(*values: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out_schema)], schema=out_schema)

        def block() -> pa.RecordBatch:
            nonlocal total
            ids = np.concatenate(ids_of)
            counts = np.bincount(ids, minlength=len(total))
            counts[: len(total)] += total
            total = counts
            return row(chunk, before, docs_of, [len(x) for x in ids_of], ids.tobytes(), None)

        for batch in batches:
            out_schema = pa.schema([
                ("chunk", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)),
                ("lengths", pa.list_(pa.int32())), ("ids", pa.binary()), ("counts", pa.list_(_COUNT)),
            ])
            for part in batch_slices(batch):
                chunk = part["chunk"][0]
                for doc_id, ids in zip(part["doc_id"], encode(part["text"])):
                    if size and size + len(ids) >= block_ids:
                        yield block()
                        before, ids_of, docs_of, size = before + size, [], [], 0
                    ids_of.append(np.concatenate([ids, end]))
                    docs_of.append(doc_id)
                    size += len(ids) + 1
        if size:
            yield block()
            seen = np.flatnonzero(total)
            yield row(chunk, None, None, None, None, [{"id": i, "n": n} for i, n in zip(seen.tolist(), total[seen].tolist())])

    schema = f"chunk int, before bigint, doc_ids array<{kind}>, lengths array<int>, ids binary, counts array<struct<id:bigint,n:bigint>>"
    return ordered.mapInArrow(run, schema)


_COUNT = pa.struct([("id", pa.int64()), ("n", pa.int64())])


def frequency_ranks(counts: DataFrame) -> np.ndarray:
    """Ids by falling frequency (ids that never occur are left out); equal ones by id. ``counts`` (counts) has those of parts.

    At most one number for each id of the vocabulary reaches the driver.
    """
    counted = counts.select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n"))
    rows = sorted(counted.collect(), key=lambda r: (-r["n"], r["id"]))
    return np.array([r["id"] for r in rows], ID_TYPE)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the token ids of all of ``docs`` (doc_id, text, ..) to ``folder``, in ascending order of doc_id.

    ``folder``/blocks holds one row per block: (chunk, before, doc_ids, lengths, control, data). Each id is written as its
    rank by frequency in 1 to 4 bytes, and the lengths of four of them in a control byte apart. ``folder``/ranks has the
    ids by rank, one row. Parquet is the container, so that any store that Spark writes will do and a lost task's output
    is never seen.

    Each document ends with ``end_id``; null and empty texts are that id alone. Null doc_ids come first; rows that repeat a
    doc_id are written each, in the order in which they are stored. ``docs`` must read stored Parquet files. An empty table
    gives no block. Other columns are not read.
    """
    spark = docs.sparkSession
    store = Stored(spark)
    tokens = store.keep(_token_blocks(docs, tokenizer, end_id, block_ids), "tokens", compression="zstd")
    by_rank = frequency_ranks(tokens.filter("counts is not null"))
    blocks = tokens.filter("ids is not null").drop("counts")
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1]
                control, data = encode_values(rank_of[np.frombuffer(row["ids"].iloc[0], ID_TYPE)])
                yield row.drop(columns="ids").assign(control=[control], data=[data])

    kept = [f"{n} {t}" for n, t in blocks.dtypes if n != "ids"]
    coded = blocks.mapInPandas(run, ", ".join([*kept, "control binary", "data binary"]))
    coded.write.option("compression", "zstd").parquet(f"{folder}/blocks")
    ranks = spark.createDataFrame([(by_rank.astype(np.int64).tolist(),)], "ids array<bigint>")
    ranks.coalesce(1).write.parquet(f"{folder}/ranks")
    store.drop(tokens)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): start counts the ids of all documents before, ids are little-endian unsigned 32-bit integers."""
    ranks = spark.read.parquet(f"{folder}/ranks").first()
    by_rank = np.array(ranks["ids"], ID_TYPE)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One row for each chunk: as many as the writer had partitions.
    sizes = blocks.groupBy("chunk").agg(F.max(F.col("before") + F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    upto = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = {r["chunk"]: r["at"] for r in sizes.select("chunk", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("at")).collect()}
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = np.asarray(row.lengths, np.int64)
                ids = by_rank[decode_values(row.control, row.data, int(lengths.sum()))]
                ends = np.cumsum(lengths)
                parts = [part.tobytes() for part in np.split(ids, ends[:-1])]
                yield pd.DataFrame({"doc_id": list(row.doc_ids), "start": starts[row.chunk] + row.before + ends - lengths, "ids": parts})

    return blocks.mapInPandas(run, f"doc_id {kind}, start bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "token-files")
    write_token_files(docs, tokenizer, folder, end_id)
    read = read_token_files(spark, folder)
    return read.select("doc_id", "start", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
