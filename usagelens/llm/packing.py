"""Packing of documents into sequences by best-fit decreasing."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.llm.common import ROW, Stored, numbered
from usagelens.llm.tokens import ID_TYPE, batch_slices, encoder

CAPACITY = 1024
END_ID = 0


class OpenWindows:
    """Open windows by remaining capacity: ranges of window numbers, and a segment tree of which capacities have any."""

    def __init__(self, capacity: int):
        self._size = 1 << capacity.bit_length()
        self._tree = [False] * (2 * self._size)
        self._ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, remaining: int) -> None:
        i = self._size + remaining
        self._tree[i] = bool(self._ranges[remaining])
        while i > 1:
            i //= 2
            self._tree[i] = self._tree[2 * i] or self._tree[2 * i + 1]

    def put(self, remaining: int, first: int, count: int) -> None:
        if remaining and count:
            self._ranges[remaining].append((first, count))
            self._mark(remaining)

    def take_tightest(self, length: int) -> tuple[int, int, int] | None:
        """(remaining, first, count) of a range of windows with the least capacity that is enough, taken out."""
        i = self._size + length
        while i > 1 and not self._tree[i]:
            # Up to the next subtree on the right.
            while i > 1 and i % 2:
                i //= 2
            i = i + 1 if i > 1 else 0
        if i <= 1:
            return None
        while i < self._size:
            i = 2 * i if self._tree[2 * i] else 2 * i + 1
        remaining = i - self._size
        first, count = self._ranges[remaining].pop()
        self._mark(remaining)
        return remaining, first, count


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over all pieces, given how many there are of each length (1 to capacity).

    Returns rows (length, low, high, each, first, offset): pieces ranked low to high - 1 among those of that length go to
    windows first, first + 1, .., ``each`` to a window, from place ``offset`` on. Windows in the same state are handled
    together, as ranges of numbers, so that the work depends on the capacity only, not on the number of pieces.
    """
    windows, plan, numbered_to = OpenWindows(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            found = windows.take_tightest(length)
            if found is None:
                # No window is open to this length: open as many as it takes.
                each = capacity // length
                found = (capacity, numbered_to, -(-left // each))
                numbered_to += found[2]
            remaining, first, count = found
            # The window just filled is the tightest again, so it takes all it can before the next one.
            each = remaining // length
            full = min(count, left // each)
            if full:
                plan.append((length, rank, rank + full * each, each, first, capacity - remaining))
                rank, left = rank + full * each, left - full * each
                windows.put(remaining - each * length, first, full)
            if left and full < count:
                plan.append((length, rank, rank + left, left, first + full, capacity - remaining))
                windows.put(remaining - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            windows.put(remaining, first + full, count - full)
    return plan


_PIECE_FIELDS = [
    ("start", pa.int64()),
    ("length", pa.int32()),
    ("doc_tokens", pa.int64()),
    ("ids", pa.binary()),
    ("part", pa.int32()),
    ("within", pa.int64()),
]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Texts as pieces of at most ``capacity`` ids: full windows from the start on, then what is left.

    _row, doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), and the piece's number among those of its
    length in its task: part, within. Store the rows before they are read, so that these stay as they are.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"{ROW} bigint, doc_id {kind}, start bigint, length int, doc_tokens bigint, ids binary, part int, within bigint"
    end = np.array([end_id], ID_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        part_id, met = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out_schema = pa.schema([(ROW, pa.int64()), ("doc_id", batch.schema.field("doc_id").type), *_PIECE_FIELDS])
            for part in batch_slices(batch):
                out = []
                for row, doc_id, ids in zip(part[ROW], part["doc_id"], encode(part["text"])):
                    ids = np.concatenate([ids, end])
                    for start in range(0, len(ids), capacity):
                        data = ids[start : start + capacity].tobytes()
                        n = len(data) // 4
                        out.append((row, doc_id, start, n, len(ids), data, part_id, met[n]))
                        met[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), out_schema)], schema=out_schema)

    return numbered(docs, "doc_id", "text").mapInArrow(run, schema)


_PLAN = T.StructType(
    [T.StructField(c, T.LongType(), False) for c in ("of_length", "low", "high", "each", "first_window", "first_offset")]
)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The stored rows of ``token_pieces`` with sequence_id and offset instead of part and within.

    Best-fit decreasing over all pieces at once: the decisions depend only on how many pieces have each length, at most
    ``capacity`` numbers, whatever the number of documents. They are made once, from those counts; pieces then find their
    place by their rank among the pieces of their length: how many the parts before theirs have, and their own number within
    it. So only counts for each (part, length) are shuffled and summed up; they are joined with the pieces by their size, and
    ids stay where they are while that is small. Sequences are numbered from 0 without gaps, and filled from place 0 without
    gaps.
    """
    spark = pieces.sparkSession
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    store = Stored(spark)
    sizes = store.keep(sizes, "piece_counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    plan = best_fit_decreasing(counts, capacity)
    ranked = pieces.join(sizes.drop("n"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("within"))
    # At most four rows for each length up to the capacity.
    places = F.broadcast(spark.createDataFrame([tuple(map(int, p)) for p in plan], _PLAN))
    rank = F.col("rank")
    placed = ranked.join(places, (F.col("length") == F.col("of_length")) & (rank >= F.col("low")) & (rank < F.col("high")))
    turn = rank - F.col("low")
    return placed.select(
        *(c for c in pieces.columns if c not in ("part", "within")),
        (F.col("first_window") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + turn % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All of ``docs`` (doc_id, text, ..) as token ids, packed into sequences of at most ``capacity``.

    One row per piece: _row, doc_id, start, length, doc_tokens, ids, ids_crc32, sequence_id, offset. Each id lies in
    exactly one piece, and each document ends with ``end_id``: null and empty texts are that id alone. Overlong documents
    are first cut into full windows. Rows that repeat a doc_id, or are equal, are packed each by itself. An empty table
    gives no rows. Other columns are not read. Texts are encoded once; the pieces are written before they are placed, and
    again with their places. ids_crc32 is that of the ids as they are stored there.
    """
    store = Stored(docs.sparkSession)
    pieces = store.keep(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    packed = store.keep(pack(pieces, capacity), "packed")
    store.drop(pieces)
    return packed.select(ROW, "doc_id", "start", "length", "doc_tokens", "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, used, padded, ids): whole sequences, padded to the capacity unless their length is a power of two."""
    entry = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").cast("int").alias("used"), F.concat(F.array_join(F.transform(entry, lambda x: F.hex(x["ids"])), "")).alias("hex"))
    padded = F.when(F.bit_count("used") == 1, F.col("used")).otherwise(capacity)
    pad = int(pad_id).to_bytes(4, "little").hex()
    return whole.select(
        "sequence_id", "used", padded.alias("padded"), F.unhex(F.concat("hex", F.repeat(F.lit(pad), padded - F.col("used")))).alias("ids")
    )
