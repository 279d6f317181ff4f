"""Near duplicates: SimHash proposes, the exact similarity of the shingles decides, MinHash and a prefix filter find the rest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, SHINGLE_WORDS, SIMILARITY, Stored, components, numbered
from usagelens.llm.simhash import fingerprints, near_links

#: SimHash as operator 6 has it: shingles of three words, 64 bits in two segments, balls of one bit, links of up to two bits.
_PRINT_WORDS, _SEGMENT_BITS, _BALL, _DISTANCE = 3, 32, 1, 2
#: A pair of similarity s shares no bucket with probability (1 - s ** _EACH) ** _BANDS: 3 in a million at 0.8.
_BANDS, _EACH = 32, 5
#: Rounds in which a bucket answers with one member, before what is left open is compared by its rarest shingles.
_HUB_ROUNDS = 2
_HASH_SEED = 42
#: Shingles whose minima are taken together: bounds the memory of very long texts.
_TOGETHER = 4096
#: Sets that leave a task together.
_TOGETHER_SETS = 256

_random = np.random.default_rng(20)
_FLIP = _random.integers(0, 1 << 64, (_BANDS * _EACH, 1), np.uint64)
_TIMES = _random.integers(0, 1 << 64, (_BANDS * _EACH, 1), np.uint64) | np.uint64(1)
_JOIN = _random.integers(0, 1 << 64, (_BANDS, _EACH), np.uint64) | np.uint64(1)
_BAND = _random.integers(0, 1 << 64, _BANDS, np.uint64)


def shingles(text: str | None, k: int = SHINGLE_WORDS) -> set[bytes]:
    """All of ``k`` words with A-Z lower-cased, joined by one space; a shorter text is one shingle, no word none."""
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def bucket_keys(found: set[bytes]) -> np.ndarray:
    """One 64-bit key for each band: a hash of the least shingles in ``_EACH`` orders."""
    if not found:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, _HASH_SEED) for s in found]), ">u8").astype(np.uint64)
    least = np.full(len(_FLIP), np.iinfo(np.uint64).max)
    for lo in range(0, len(hashes), _TOGETHER):
        least = np.minimum(least, ((hashes[lo : lo + _TOGETHER] ^ _FLIP) * _TIMES).min(axis=1))
    least ^= least >> np.uint64(29)
    keys = (least.reshape(_BANDS, _EACH) * _JOIN).sum(axis=1, dtype=np.uint64) ^ _BAND
    return ((keys ^ (keys >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """_row, doc_id, digest of the set of shingles, its size n, bucket keys."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, keys = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), shingle_words)
                digests.append(hashlib.sha256(b"\n".join(sorted(found))).digest())
                sizes.append(len(found))
                keys.append(bucket_keys(found))
            new = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), *new], [ROW, "doc_id", "digest", "n", "keys"])

    return numbered(docs, "doc_id", "text").mapInArrow(run, f"{ROW} bigint, doc_id {kind}, digest binary, n bigint, keys array<bigint>")


def shingle_hashes(found: set[bytes]) -> np.ndarray:
    """64-bit hashes of shingles, each once."""
    digests = b"".join(xxhash.xxh64_digest(s, _HASH_SEED) for s in found)
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64)).view(np.int64)


def _sets(texts: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """node, hashes: the shingles of the whole texts of ``nodes`` (node) as sets of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _TOGETHER_SETS):
                part = batch.slice(lo, _TOGETHER_SETS)
                hashes = [shingle_hashes(shingles(text.as_py(), shingle_words)) for text in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column(ROW), pa.array(hashes, pa.list_(pa.int64()))], ["node", "hashes"])

    wanted = nodes.select(F.col("node").alias(ROW)).distinct()
    return texts.join(wanted, ROW, "left_semi").select(ROW, "text").mapInArrow(run, "node bigint, hashes array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets share ``similarity`` of all their shingles."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return joined.filter(shared >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _classes(members: DataFrame, links: DataFrame, store: Stored) -> DataFrame:
    """``members`` of buckets (key, node, n) with the class that the links give them so far."""
    linked = components(links, store)
    return store.keep(
        members.join(linked, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component")), "members"
    )


def _pair(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _at_least(share: float, n: Column) -> Column:
    """The least whole number that is ``share`` of ``n``; rounding never makes it greater."""
    return F.ceil(F.lit(share) * n - F.lit(1e-6))


def prefix_pairs(nodes: DataFrame, sets: DataFrame, store: Stored, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, component) in different classes that may be similar: all that are, and few others.

    Prefix filter: shingles are ordered by how many sets have them, the rarest first. Of two sets with ``similarity`` of all their
    shingles in common, the first shingles of the one are among the first of the other: a fifth of the larger and a ninth of the
    smaller will do at 0.8. Sizes, and how much can still be shared from the two places on, decide in the join already. Texts that
    only share a template or a passage do not meet, as what they share is not rare. A shingle whose sets are all of one class is left
    out; else those outside its largest class are joined with all, so that a large class is never joined with itself.
    """
    t = similarity
    own = nodes.join(sets, "node").select("node", "component", F.size("hashes").alias("n"), F.explode("hashes").alias("shingle"))
    own = store.keep(own, "shingles")
    # Written before it is joined, so that the sets of a frequent shingle can be split.
    shared = store.keep(own.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1"), "shared")
    # A set's shingles that no other has come first; of the others, by rank.
    lists = own.join(shared, "shingle").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("ordered"))
    alone = F.col("n") - F.size("ordered")
    longest = F.col("n") - _at_least(t, F.col("n")) + 1
    first = F.slice("ordered", 1, F.greatest(longest - alone, F.lit(0)).cast("int"))
    entries = lists.select("node", "component", "n", alone.alias("alone"), F.posexplode(first).alias("i", "s"))
    short = F.col("n") - _at_least(2 * t / (1 + t), F.col("n")) + 1
    entries = entries.select("node", "component", "n", (F.col("alone") + F.col("i")).alias("at"), F.col("s.shingle").alias("shingle"), short.alias("short"))
    entries = store.keep(entries, "entries")
    classes = entries.groupBy("shingle", "component").agg(F.count("*").alias("size")).groupBy("shingle")
    classes = classes.agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("classes"))
    classes = store.keep(classes.filter("classes > 1").drop("classes"), "classes")
    met = store.keep(entries.join(classes, "shingle").withColumn("outside", F.col("component") != F.col("largest")).drop("largest"), "met")
    store.drop(own)
    store.drop(entries)
    other = met.select("shingle", *(F.col(c).alias(f"other_{c}") for c in ("node", "component", "n", "at", "short", "outside")))
    smaller = F.struct("n", "node") < F.struct("other_n", "other_node")
    found = met.filter("outside").join(other, "shingle").filter(
        (F.col("component") != F.col("other_component"))
        & (~F.col("other_outside") | (F.col("node") < F.col("other_node")))
        & (F.least("n", "other_n") >= F.lit(t) * F.greatest("n", "other_n") - F.lit(1e-6))
        & F.when(smaller, F.col("at") < F.col("short")).otherwise(F.col("other_at") < F.col("other_short"))
        & (F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at")) >= _at_least(t / (1 + t), F.col("n") + F.col("other_n")))
    )
    return _pair(found.select("node", F.col("other_node").alias("other")))


def print_pairs(nodes: DataFrame, docs: DataFrame, store: Stored) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node) that SimHash proposes: fingerprints that differ in two bits at most.

    Of nodes with one fingerprint the smallest stands for all; each of the others meets it, and these meet by multi-index
    hashing. So a fingerprint that very many nodes share costs what it has nodes.
    """
    prints = fingerprints(docs, _PRINT_WORDS).join(nodes.select(F.col("node").alias(ROW)), ROW, "left_semi")
    prints = store.keep(prints.select(F.col(ROW).alias("node"), "bits"), "prints")
    first = store.keep(prints.groupBy("bits").agg(F.min("node").alias("node")), "firsts")
    same = prints.join(first.select("bits", F.col("node").alias("a")), "bits").filter("a != node").select("a", F.col("node").alias("b"))
    return same.union(near_links(first, 1, _SEGMENT_BITS, _BALL, _DISTANCE))


def similar_links(nodes: DataFrame, docs: DataFrame, store: Stored, shingle_words: int, similarity: float) -> DataFrame:
    """Verified pairs (a, b) of ``nodes`` (node, n, keys) whose components are those of all similar pairs in a bucket.

    The pairs that SimHash proposes (see ``print_pairs``) are verified first, and their classes are the start. Copies with
    small changes meet there; fingerprints of texts that are just similar enough differ in more bits, so the rest is sought
    by MinHash. There, first each bucket answers with one member, so that a group of thousands of near copies costs what it has members. What
    that leaves open, members of buckets with several classes, is then compared by an exact prefix filter (see
    ``prefix_pairs``). Two members of one class need no comparison, as a link between them would change no class.
    """
    ratio = F.lit(similarity)
    proposed = store.keep(print_pairs(nodes, docs, store), "proposed")
    at = store.keep(nodes.select(F.explode("keys").alias("key"), "node", "n"), "buckets")
    crowded = at.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    alone = store.keep(at.join(crowded, "key").select("key", "node", "n"), "members")
    store.drop(at)
    wanted = alone.select("node").union(proposed.select("a")).union(proposed.select("b"))
    sets = store.keep(_sets(numbered(docs, "text"), wanted, shingle_words), "sets")
    links = store.keep(_verified(proposed, sets, similarity), "similar")
    members = _classes(alone, links, store)
    store.drop(alone)
    for round_ in range(_HUB_ROUNDS):
        open_ = members.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            F.min(F.struct(F.xxhash64(F.lit(round_), "node").alias("h"), "node", "n", "component")).alias("hub"),
        ).filter("low != high")
        met = members.join(open_.select("key", "hub"), "key").filter(F.col("component") != F.col("hub.component"))
        # Sets whose sizes differ more can't be similar.
        met = met.filter(F.least("n", "hub.n") >= ratio * F.greatest("n", "hub.n"))
        pairs = store.keep(_pair(met.select("node", F.col("hub.node").alias("other"))), "pairs")
        found = store.keep(_verified(pairs, sets, similarity), "similar")
        store.drop(pairs)
        links = links.union(found)
        before, members = members, _classes(members.drop("component"), links, store)
        store.drop(before)
    several = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    left = store.keep(members.join(several.select("key"), "key").select("node", "component").distinct(), "open")
    pairs = store.keep(prefix_pairs(left, sets, store, similarity), "pairs")
    return links.union(store.keep(_verified(pairs, sets, similarity), "similar"))


def similar_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ..) with its class of near duplicates.

    Two texts are linked if the shingles they share are at least ``similarity`` of the shingles of both, counted over the
    whole texts as sets of 64-bit hashes; a class is a connected component. But for equal hashes of different shingles no pair
    below is ever linked; a pair at 0.8 is missed with probability 3e-6, more similar ones less (see ``_BANDS``).

    Texts with equal shingles are one node; null and empty texts are one. Rows that repeat a doc_id are rows of their own;
    component_id is the smallest doc_id of the class (null if it has none). An empty table gives no rows. Other columns are
    not read.

    Returns _row, doc_id, component (smallest row number of the class), component_id.
    """
    store = Stored(docs.sparkSession)
    rows = store.keep(_signatures(docs, shingle_words), "signatures")
    same = store.keep(rows.groupBy("digest").agg(F.min(ROW).alias("node")), "nodes")
    nodes = rows.join(same.select(F.col("node").alias(ROW)), ROW).select(F.col(ROW).alias("node"), "n", "keys")
    links = similar_links(nodes, docs, store, shingle_words, similarity)
    linked = components(links, store)
    classes = store.keep(same.join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("component")), "classes")
    members = store.keep(rows.select(ROW, "doc_id", "digest").join(classes, "digest").drop("digest"), "classed")
    # Written before the join: what is only aggregated would be joined where it lies, a large class in one task.
    ids = store.keep(members.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ids")
    return members.join(ids, "component").select(ROW, "doc_id", "component", "component_id")
