"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore."""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import Stored

TOP = 20
#: Documents join a shard until their texts reach so many bytes; bounds the memory of a task that builds or searches one.
SHARD_BYTES = 16_000_000
#: Postings of a block: what is decompressed at once, and has a maximum of its own.
BLOCK = 64
#: Documents of a shard whose candidates are settled first; each range after it is twice as long, as the threshold rises ever less.
_RANGE = 256
#: Items that are searched together in one task.
ITEMS = 256
#: Bytes of a text that are split into terms at once.
_SLICE = 4_000_000
#: Rows of the index that leave a task together.
_ROWS = 5_000

# A byte of a term, with A-Z lower-cased, or a blank. Bytes from 128 on belong to characters beyond ASCII: all are term characters.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in slices that bound memory. A-Z are lower-cased, no other letters."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        to = len(data) if len(data) - at <= _SLICE else data.find(b" ", at + _SLICE)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def _numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number in seven bits a byte, the lowest first; the high bit says that more follows. Also where each one ends."""
    values = values.astype(np.uint64)
    sizes = np.maximum(1, (np.frexp(values.astype(np.float64))[1] + 6) // 7)
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        more = (sizes[has] > k + 1).astype(np.uint8) << 7
        out[(ends - sizes)[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, ends


def _decoded(data: np.ndarray) -> np.ndarray:
    """The numbers of ``_numbers``."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        has = last - first >= k
        out[has] |= (data[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


class _Shard:
    """Postings of some documents, gathered to be written."""

    def __init__(self) -> None:
        self.bytes = 0
        self._terms: dict[bytes, int] = {}
        self._term, self._doc, self._tf = array("q"), array("q"), array("q")
        self.lengths, self.ids = array("q"), []

    def add(self, doc_id: object, text: str | None) -> None:
        counts: Counter[bytes] = Counter()
        for found in terms(text):
            counts.update(found)
        self.bytes += len(text or "") + 64
        known = self._terms
        self._term.extend([known.setdefault(t, len(known)) for t in counts])
        self._tf.extend(counts.values())
        self._doc.extend([len(self.ids)] * len(counts))
        self.lengths.append(sum(counts.values()))
        self.ids.append(doc_id)

    def rows(self, shard: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A row without a term for the documents, and one for each term. Documents are numbered by ascending id, null last."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, 0 if self.ids[i] is None else self.ids[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.frombuffer(self.lengths, np.int64)[order]
        names = sorted(self._terms)
        rank = np.zeros(len(names), np.int64)
        rank[np.array([self._terms[t] for t in names], np.int64)] = np.arange(len(names))
        term, doc, tf = (np.frombuffer(a, np.int64) if len(a) else np.zeros(0, np.int64) for a in (self._term, self._doc, self._tf))
        term, doc = rank[term], place[doc]
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        ids = [self.ids[i] for i in order]
        yield _batch(kind, [shard], [None], [0], ids=pa.array([ids], pa.list_(kind)), lengths=pa.array([lengths], _LONGS))
        if not names:
            return
        # Blocks: postings starts[b] .. stops[b] of the term owners[b].
        cuts = np.searchsorted(term, np.arange(len(names) + 1))
        n_blocks = -(-np.diff(cuts) // BLOCK)
        offsets = np.concatenate([[0], np.cumsum(n_blocks)])
        owners = np.repeat(np.arange(len(names)), n_blocks)
        starts = cuts[owners] + BLOCK * (np.arange(offsets[-1]) - offsets[owners])
        stops = np.minimum(starts + BLOCK, cuts[owners + 1])
        gaps = np.diff(doc, prepend=-1) - 1
        gaps[starts] = doc[starts]
        # A block's gaps come first, then its frequencies.
        sizes = stops - starts
        at = np.arange(len(doc)) + np.repeat(starts, sizes)
        mixed = np.empty(2 * len(doc), np.int64)
        mixed[at], mixed[at + np.repeat(sizes, sizes)] = gaps, tf
        data, ends = _numbers(mixed)
        ends = ends[2 * stops - 1]
        bytes_at = np.concatenate([[0], ends[offsets[1:] - 1]])

        def listed(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))

        blob = pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(bytes_at.astype(np.int32)), pa.py_buffer(data.tobytes())])
        batch = _batch(
            kind, [shard] * len(names), names, np.diff(cuts), ends=listed(ends - bytes_at[owners]), last=listed(doc[stops - 1]),
            most_tf=listed(np.maximum.reduceat(tf, starts)), least_n=listed(np.minimum.reduceat(lengths[doc], starts)), blocks=blob,
        )
        for lo in range(0, len(names), _ROWS):
            yield batch.slice(lo, _ROWS)


_LONGS = pa.list_(pa.int64())


def _batch(kind: pa.DataType, shard: list, term: list, df: list, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of the index; columns that are not given are null."""
    types = dict.fromkeys(("ends", "last", "most_tf", "least_n"), _LONGS) | {"blocks": pa.binary(), "ids": pa.list_(kind), "lengths": _LONGS}
    arrays = [pa.array(shard, pa.int64()), pa.array(term, pa.binary()), pa.array(df, pa.int64())]
    arrays += [columns[c] if c in columns else pa.nulls(len(shard), t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, ["shard", "term", "df", *types])


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """An inverted index of all terms of all whole texts of ``docs`` (doc_id, text, ..). Write it before it is searched.

    Each task turns its documents into shards of ``shard_bytes`` of text (at least one document each); no posting is
    shuffled. A shard has one row for each term (shard, term, df: its documents there, blocks of postings, each with its
    last document, greatest tf and least document length), and one row without a term for its documents (ids, lengths).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = "shard bigint, term binary, df bigint, ends array<bigint>, last array<bigint>, most_tf array<bigint>, least_n array<bigint>, "
    schema += f"blocks binary, ids array<{kind}>, lengths array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers of tasks are told apart by what was written: the index holds one attempt of each.
        number, shard, type_ = TaskContext.get().partitionId() << 32, _Shard(), None
        for batch in batches:
            type_ = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                shard.add(doc_id, text.as_py())
                if shard.bytes >= shard_bytes:
                    yield from shard.rows(number, type_)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.rows(number, type_)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score, before its weight. Grows with tf and falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Postings:
    """The blocks of one term in a shard; a block is decompressed when it is first asked for."""

    def __init__(self, weight_: int, ends: np.ndarray, last: np.ndarray, most_tf: np.ndarray, least_m: np.ndarray, blocks: bytes, norms: np.ndarray):
        self.last, self._weight, self._norms = last, weight_, norms
        self.first = np.concatenate([[0], last[:-1] + 1])
        self._ends = np.concatenate([[0], ends])
        self._data = np.frombuffer(blocks, np.uint8)
        self.block_max = weight_ * gains(most_tf, least_m)
        self.bound = int(self.block_max.max())
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @property
    def opened(self) -> int:
        return len(self._open)

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block, and what the term adds to each."""
        if i not in self._open:
            numbers = _decoded(self._data[self._ends[i] : self._ends[i + 1]])
            docs = np.cumsum(numbers[: len(numbers) // 2] + np.arange(len(numbers) // 2).clip(max=1))
            self._open[i] = docs, self._weight * gains(numbers[len(numbers) // 2 :], self._norms[docs])
        return self._open[i]

    def between(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Postings of documents lo <= doc < hi, block by block."""
        i = int(np.searchsorted(self.last, lo))
        while i < len(self.last) and self.first[i] < hi:
            docs, scores = self.block(i)
            a, b = np.searchsorted(docs, (lo, hi))
            if a < b:
                yield docs[a:b], scores[a:b]
            i += 1


List = tuple[Postings, int]


def _settled(lists: list[List], docs: np.ndarray, score: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``docs`` that reach the threshold when the gains by ``lists`` are added, and their scores.

    Documents are first held against the maxima of just the blocks that they would lie in; only blocks that still have
    candidates are decompressed, the lists that promise most first.
    """
    # A document beyond a list's last block gains nothing.
    at = [np.searchsorted(p.last, docs) for p, _ in lists]
    above = np.array([np.append(p.block_max, 0)[a] * t for (p, t), a in zip(lists, at)])
    rest = above.sum(axis=0)
    live = score + rest >= threshold
    for k in range(len(lists) - 1, -1, -1):
        postings, times = lists[k]
        rest = rest - above[k]
        for i in np.unique(at[k][live & (above[k] > 0)]):
            has = np.flatnonzero(live & (at[k] == i))
            block_docs, block_scores = postings.block(int(i))
            place = np.searchsorted(block_docs, docs[has]).clip(max=len(block_docs) - 1)
            score[has] += np.where(block_docs[place] == docs[has], block_scores[place] * times, 0)
        live &= score + rest >= threshold
    return docs[live], score[live]


def _first_threshold(lists: list[List], top: int) -> int:
    """The score of some document that ``top`` documents reach; 1 if there are too few. No best document scores less.

    They are sought where the lists that promise most begin.
    """
    docs = np.zeros(0, np.int64)
    for postings, _ in reversed(lists):
        docs = np.union1d(docs, postings.block(0)[0])
        if len(docs) >= 2 * top:
            break
    scores = _settled(lists, docs, np.zeros(len(docs), np.int64), 1)[1]
    return int(np.sort(scores)[-top]) if len(scores) >= top else 1


def search_shard(lists: list[List], n_docs: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that may be among the best ``top`` (all that tie with the last included), and their scores.

    ``lists`` are the postings of the item's terms and how often the item has each. MaxScore: lists whose bounds add up to
    less than the threshold are non-essential, as no document becomes a candidate by them alone; the others are
    accumulated, a range of documents at a time. A candidate is then held against the bounds of the non-essential lists, and
    then against the maxima of their blocks, see ``_settled``.
    """
    lists = sorted(lists, key=lambda p: p[0].bound * p[1])
    upto = np.cumsum([0] + [p.bound * times for p, times in lists])
    threshold = _first_threshold(lists, top)
    best: list[int] = []
    docs_out, scores_out = [], []
    hi = 0
    while hi < n_docs:
        lo, hi = hi, min(2 * hi + _RANGE, n_docs)
        # upto[k] bounds the lists before k together.
        essential = int(np.searchsorted(upto[1:], threshold))
        if essential == len(lists):
            break  # no document can reach the threshold any more
        total = np.zeros(hi - lo, np.int64)
        for postings, times in lists[essential:]:
            for docs, scores in postings.between(lo, hi):
                total[docs - lo] += scores * times
        found = np.flatnonzero((total > 0) & (total + upto[essential] >= threshold))
        docs, scores = found + lo, total[found]
        if len(docs) and essential:
            docs, scores = _settled(lists[:essential], docs, scores, threshold)
        for s in scores[scores >= threshold].tolist():
            if len(best) < top:
                heapq.heappush(best, s)
            elif s > best[0]:
                heapq.heapreplace(best, s)
        docs_out.append(docs)
        scores_out.append(scores)
        threshold = max(threshold, best[0]) if len(best) == top else threshold
    docs, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs_out, scores_out))
    keep = scores >= threshold
    return docs[keep], scores[keep]


def _item_terms(items: DataFrame) -> DataFrame:
    """term, block of items, uses: which items of the block (by number) have the term, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column("number").to_pylist(), batch.column("text")):
                counts: Counter[bytes] = Counter()
                for found in terms(text.as_py()):
                    counts.update(found)
                if counts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                        ["number", "term", "times"],
                    )

    found = items.select("number", "text").mapInArrow(run, "number bigint, term binary, times bigint")
    uses = F.sort_array(F.collect_list(F.struct("number", "times"))).alias("uses")
    return found.groupBy("term", F.expr(f"number div {ITEMS}").alias("part")).agg(uses)


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of ``index`` for each row of ``items`` (item_id, text, ..) by ascending rank.

    A score sums, over the item's terms (repeats included), the term's weight times its gain in the document, all in whole
    numbers (see ``weight`` and ``gains``); the greatest score comes first, then the smallest doc_id (null last). Documents
    without a term of the item are no result. Items are searched in blocks of ITEMS against every shard by Block-Max
    MaxScore (see ``search_shard``), and the best of all shards are merged. Only rows of the items' terms are read further
    than their term; terms are joined by size, without a hint, so that a list of items of any length will do.

    Items without a term, with null text, or without any match have no rows; items that repeat an item_id each have their
    rows. Equal documents tie and go by doc_id; rows that repeat a doc_id are documents of their own. An empty index or
    list of items gives no rows. Other columns are not read.

    Returns item_id, rank, doc_id, score.
    """
    spark = index.sparkSession
    store = Stored(spark)
    # Numbers of items: a window over all of them would be one task, so each hash bucket is numbered apart.
    buckets = 64
    hashed = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets)).alias("bucket"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("item_id", "text")) - 1
    numbered = store.keep(hashed.withColumn("number", within * buckets + F.col("bucket")).select("number", "item_id", "text"), "items")
    wanted = store.keep(_item_terms(numbered), "item_terms")

    documents = index.filter("term is null")
    sizes = documents.select(F.expr("aggregate(lengths, 0L, (a, n) -> a + n)").alias("total"), F.expr("size(filter(lengths, n -> n > 0))").alias("docs"))
    n_docs, total = sizes.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    postings = store.keep(index.drop("ids", "lengths").filter("term is not null").join(wanted.select("term").distinct(), "term", "left_semi"), "postings")
    frequency = postings.groupBy("term").agg(F.sum("df").alias("docs_with"))
    asked = wanted.join(frequency, "term")
    lists = postings.join(asked, "term").drop("term", "df")
    # The lengths of a shard's documents go to it once for each block of items that has terms there.
    parts = lists.select("shard", "part").distinct()
    both = lists.unionByName(documents.select("shard", "lengths").join(parts, "shard"), allowMissingColumns=True)

    def norm(lengths: np.ndarray) -> np.ndarray:
        return np.array([75 + 25 * n * n_docs // total for n in lengths.tolist()], np.int64)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        norms = norm(group["lengths"].dropna().iloc[0])
        by_item: dict[int, list[List]] = {}
        for r in group[group["lengths"].isna()].itertuples(index=False):
            found = Postings(weight(n_docs, int(r.docs_with)), r.ends, r.last, r.most_tf, norm(r.least_n), r.blocks, norms)
            for use in r.uses:
                by_item.setdefault(use["number"], []).append((found, use["times"]))
        out = [np.zeros((0, 3), np.int64)]
        for number, item_lists in by_item.items():
            docs, scores = search_shard(item_lists, len(norms), top)
            best = np.lexsort((docs, -scores))[:top]
            out.append(np.column_stack([np.full(len(best), number), docs[best], scores[best]]))
        return pd.DataFrame(np.concatenate(out), columns=["number", "doc", "score"]).assign(shard=key[0])

    found = store.keep(both.groupBy("shard", "part").applyInPandas(run, "number bigint, doc bigint, score bigint, shard bigint"), "shard_tops")
    named = found.join(documents.select("shard", "ids"), "shard").select("number", "score", F.expr("ids[cast(doc as int)]").alias("doc_id"))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``search`` of ``items`` in an index of ``docs`` that is built for it and kept in the shared folder.

    Null and empty texts are documents without a term. An empty table of documents or items gives no rows.
    """
    index = Stored(docs.sparkSession).keep(build_index(docs, shard_bytes), "index")
    return search(index, items, top)
