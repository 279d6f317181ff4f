"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, SHINGLE_WORDS, SIMILARITY, Stored, components, numbered

HASH_SEED = 42
#: Bits that are counted at a time: bounds the memory of very long texts.
_CHUNK_BITS = 1 << 22
_STEP = 0x9E3779B97F4A7C15


def _spread(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit hashes from one: the hash itself, then mixes of it (the splitmix64 finaliser)."""
    out = [h]
    for k in range(1, words):
        z = h + np.uint64(_STEP * k % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(text: str | None, shingle_words: int, words: int = 1) -> bytes:
    """64 bits a word, highest first; a bit is set if it is in over half of the shingle hashes. No word: all zero.

    A shingle is ``shingle_words`` words with A-Z lower-cased, joined by one space; a shorter text is one shingle.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return bytes(8 * words)
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda end, n: end + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[shingle_words - 1 :] or ends[-1:]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64 * words, np.int64)
    step = _CHUNK_BITS // (64 * words)
    for lo in range(0, len(last), step):
        hashes = b"".join([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[lo:], last[lo : lo + step])])
        spread = _spread(np.frombuffer(hashes, ">u8").astype(np.uint64), words)
        counts += np.unpackbits(spread.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(last)).tobytes()


def fingerprints(docs: DataFrame, shingle_words: int, words: int = 1) -> DataFrame:
    """_row, doc_id and the fingerprint, as ``words`` 64-bit words (bits array<bigint>), of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.frombuffer(fingerprint(t, shingle_words, words), ">i8").astype(np.int64) for t in batch["text"]]
            yield pd.DataFrame({ROW: batch[ROW], "doc_id": batch["doc_id"], "bits": found})

    kind = dict(docs.dtypes)["doc_id"]
    return numbered(docs, "doc_id", "text").mapInPandas(run, f"{ROW} bigint, doc_id {kind}, bits array<bigint>")


def _segments(bits: Column, words: int, segment_bits: int) -> Column:
    """The fingerprint cut into segments from the highest bit on, each as a number with the segment's place above it."""
    parts = []
    for i in range(64 * words // segment_bits):
        top = i * segment_bits
        value = F.lit(0).cast("long")
        for w in range(top // 64, (top + segment_bits - 1) // 64 + 1):
            lo, hi = max(top, 64 * w), min(top + segment_bits, 64 * w + 64)
            piece = F.shiftrightunsigned(bits[w], 64 * w + 64 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            value = F.shiftleft(value, hi - lo).bitwiseOR(piece)
        parts.append(value.bitwiseOR(F.lit(i << segment_bits)))
    return F.array(*parts)


def near_links(nodes: DataFrame, words: int, segment_bits: int, ball: int, max_distance: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, bits; bits are distinct) that differ in at most ``max_distance`` bits.

    Multi-index hashing: every fingerprint is stored under each of its segments, and looks up, for each segment, the
    values within ``ball`` (0 or 1) bits; complete distances of what it meets are then verified. Of two values that differ
    in one bit, one has it zero, so it is enough to look up the values with one more bit set. All links are found if
    ``max_distance`` is under (ball + 1) * number of segments.
    """
    head = F.col("bits")[0]
    at = nodes.select("node", head.alias("head"), F.explode(_segments(F.col("bits"), words, segment_bits)).alias("key"))
    raised = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(segment_bits - 1)), lambda i: F.expr("key").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) == 0),
        lambda i: F.expr("key").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    values = F.concat(F.array("key"), raised) if ball else F.array("key")
    probes = at.select(F.col("node").alias("a"), F.col("head").alias("head_a"), F.explode(values).alias("key"))
    table = at.select(F.col("key").alias("key_b"), F.struct("node", "head").alias("b"))
    # A fingerprint of one word is decided here, so that chance meetings in a bucket end inside the join.
    near = F.bit_count(F.col("head_a").bitwiseXOR(F.col("b.head"))) <= (max_distance if words == 1 else 64)
    met = probes.join(table, (F.col("key") == F.col("key_b")) & (F.col("a") != F.col("b.node")) & near)
    pairs = met.select(F.least("a", "b.node").alias("a"), F.greatest("a", "b.node").alias("b")).distinct()
    if words == 1:
        return pairs
    left = nodes.select(F.col("node").alias("a"), F.col("bits").alias("bits_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("bits").alias("bits_b"))
    differing = (F.bit_count(F.col("bits_a")[w].bitwiseXOR(F.col("bits_b")[w])) for w in range(words))
    distance = reduce(lambda x, y: x + y, differing)
    return pairs.join(left, "a").join(right, "b").filter(distance <= max_distance).select("a", "b")


def near_groups(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    words: int = 9,
    segment_bits: int = 24,
    ball: int = 1,
    max_distance: int | None = None,
    matches: None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ..) with its fingerprint and its class of near duplicates.

    Equal fingerprints are one node; nodes link by ``near_links``; a class is a connected component. Without
    ``max_distance`` it is the number of bits in which texts of similarity 0.8 (shared shingles by all shingles) differ on
    average, and one standard deviation: 64 bits a word, each different with probability acos(2 s / (1 + s)) / pi. That is
    an estimate; ``similar_groups`` decides by the similarity itself. All members of a bucket are compared; ``matches``
    can be nothing else.

    Null and empty texts have the fingerprint zero and are linked like any other. Rows that repeat a doc_id are rows of
    their own; component_id is the smallest doc_id of the class (null if it has none). An empty table gives no rows. Other
    columns are not read.

    Returns _row, doc_id, bits array<bigint>, component (smallest row number of the class), component_id.
    """
    if max_distance is None:
        p = np.arccos(2 * SIMILARITY / (1 + SIMILARITY)) / np.pi
        max_distance = int(64 * words * p + np.sqrt(64 * words * p * (1 - p)))
    store = Stored(docs.sparkSession)
    rows = store.keep(fingerprints(docs, shingle_words, words), "fingerprints")
    nodes = store.keep(rows.groupBy("bits").agg(F.min(ROW).alias("node")), "nodes")
    links = store.keep(near_links(nodes, words, segment_bits, ball, max_distance), "links")
    linked = components(links, store)
    classes = store.keep(
        nodes.join(linked, "node", "left").select("bits", F.coalesce("component", "node").alias("component")), "classes"
    )
    members = store.keep(rows.join(classes, "bits"), "members")
    # Written before the join: what is only aggregated would be joined where it lies, a large class in one task.
    ids = store.keep(members.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ids")
    return members.join(ids, "component").select(ROW, "doc_id", "bits", "component", "component_id")
