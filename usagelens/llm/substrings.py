"""Repeated passages across documents, by suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, Stored, numbered

WINDOW_WORDS = 35
#: Words of an anchor; a window's anchor is the one with the least hash in it, the first of equal ones.
ANCHOR_WORDS = 8
#: Reference pieces in a shard, on average; an anchor with more different pieces than ANCHOR_PIECES is counted by window.
SHARD_PIECES = 500
ANCHOR_PIECES = 500
#: Window starts that are searched together: bounds the memory of very long texts.
_CHUNK = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        m = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(m, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)


class Spans:
    """Hashes of all spans of a sequence of words, from running sums."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        powers, self._inverse = _powers(self.n + 1)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])

    def hash(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self._sums[end] - self._sums[first]) * self._inverse[first])


def anchored(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window, number of windows, hash of the anchor, hash of the words of the run).

    Equal windows have equal anchors at the same place in them, wherever they are. Each window is in exactly one run.
    """
    spans = Spans(hashes)
    at = np.arange(spans.n - anchor + 1)
    grams = spans.hash(at, at + anchor)
    width = window - anchor + 1
    places = []
    for lo in range(0, len(grams) - width + 1, _CHUNK):
        view = np.lib.stride_tricks.sliding_window_view(grams[lo : lo + _CHUNK + width - 1], width)
        places.append(view.argmin(axis=1) + np.arange(lo, lo + len(view)))
    place = np.concatenate(places)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    count = np.diff(first, append=len(place))
    return first, count, grams[place[first]], spans.hash(first, first + count + window - 1)


class SuffixAutomaton:
    """Suffix automaton of several sequences, each with a weight: how often it occurs."""

    def __init__(self) -> None:
        self._longest, self._link, self._next, self._times = [0], [-1], [{}], [0]

    def _state(self, longest: int, link: int, following: dict) -> int:
        self._longest.append(longest)
        self._link.append(link)
        self._next.append(following)
        self._times.append(0)
        return len(self._longest) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of state q for the words that reach it from p with c."""
        copy = self._state(self._longest[p] + 1, self._link[q], dict(self._next[q]))
        self._link[q] = copy
        while p >= 0 and self._next[p].get(c) == q:
            self._next[p][c] = copy
            p = self._link[p]
        return copy

    def add(self, sequence: Sequence[int], times: int) -> None:
        following, longest, link = self._next, self._longest, self._link
        last = 0
        for c in sequence:
            q = following[last].get(c)
            if q is not None:
                last = q if longest[q] == longest[last] + 1 else self._split(last, c, q)
            else:
                new = self._state(longest[last] + 1, 0, {})
                p = last
                while p >= 0 and c not in following[p]:
                    following[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = following[p][c]
                    link[new] = q if longest[q] == longest[p] + 1 else self._split(p, c, q)
                last = new
            self._times[last] += times

    def finish(self) -> None:
        """Count occurrences: those of a state are those of the states that end in it."""
        for s in sorted(range(1, len(self._longest)), key=self._longest.__getitem__, reverse=True):
            self._times[self._link[s]] += self._times[s]

    def repeated(self, sequence: Sequence[int], window: int) -> list[int]:
        """Starts of the windows of ``sequence`` that occur twice or more, by matching statistics cut to the window."""
        state, matched, found = 0, 0, []
        for i, c in enumerate(sequence):
            while state and c not in self._next[state]:
                state = self._link[state]
                matched = self._longest[state]
            if c in self._next[state]:
                state, matched = self._next[state][c], matched + 1
            while self._longest[self._link[state]] >= window:
                state = self._link[state]
                matched = self._longest[state]
            if matched >= window and self._times[state] > 1:
                found.append(i - window + 1)
        return found


def _runs(starts: Sequence[int]) -> list[tuple[int, int]]:
    """Ascending numbers as ranges (first, last)."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and out[-1][1] + 1 == s:
            out[-1] = (out[-1][0], s)
        else:
            out.append((s, s))
    return out


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def _anchor_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text in zip(batch[ROW].tolist(), batch["text"].tolist()):
                words = (text or "").encode().split()
                if len(words) >= window:
                    first, count, h, content = anchored(word_hashes(words), window, anchor)
                    out.append((np.full(len(first), row), first, count, _signed(h), _signed(content)))
            if out:
                yield pd.DataFrame(dict(zip([ROW, "at", "n", "h", "content"], map(np.concatenate, zip(*out)))))

    return rows.select(ROW, "text").mapInPandas(run, f"{ROW} bigint, at int, n int, h bigint, content bigint")


def _with_words(pieces: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """The word hashes of each piece, from the text of the row that stands for it."""
    wanted = pieces.groupBy(ROW).agg(F.collect_list(F.struct("h", "content", "times", "contents", "at", "n")).alias("pieces"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, pieces_ in zip(batch["text"], batch["pieces"]):
                hashes = _signed(word_hashes((text or "").encode().split()))
                yield pd.DataFrame(
                    [(p["h"], p["content"], p["times"], p["contents"], hashes[p["at"] : p["at"] + p["n"] + window - 1]) for p in pieces_],
                    columns=["h", "content", "times", "contents", "words"],
                )

    joined = rows.select(ROW, "text").join(wanted, ROW).select("text", "pieces")
    return joined.mapInPandas(run, "h bigint, content bigint, times bigint, contents bigint, words array<bigint>")


def _by_automaton(pieces: DataFrame, window: int, shards: int) -> DataFrame:
    """(h, content, runs): repeated windows of each piece, from one suffix automaton for each shard of anchors."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        sequences = [words.tolist() for words in shard["words"]]
        for sequence, times in zip(sequences, shard["times"].tolist()):
            automaton.add(sequence, times)
        automaton.finish()
        runs = [_runs(automaton.repeated(sequence, window)) for sequence in sequences]
        return pd.DataFrame({"h": shard["h"], "content": shard["content"], "runs": runs})

    sharded = pieces.withColumn("shard", F.pmod("h", F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(run, "h bigint, content bigint, runs array<struct<first:int,last:int>>")


def _by_window(pieces: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many different pieces: equal windows meet by two independent hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, content, times, words in zip(batch["h"], batch["content"], batch["times"], batch["words"]):
                hashes = np.asarray(words, np.int64).view(np.uint64)
                at = np.arange(len(hashes) - window + 1)
                one, two = (_signed(Spans(x).hash(at, at + window)) for x in (hashes, _mix(hashes)))
                yield pd.DataFrame({"h": h, "content": content, "times": times, "at": at.astype(np.int32), "one": one, "two": two})

    # Pieces lie unevenly in their files, and each makes many windows.
    spread = pieces.repartition("h", "content")
    windows = spread.mapInPandas(run, "h bigint, content bigint, times bigint, at int, one bigint, two bigint")
    again = windows.groupBy("one", "two").agg(F.sum("times").alias("all_times")).filter("all_times > 1")
    found = windows.join(again, ["one", "two"]).groupBy("h", "content").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    return found.select("h", "content", F.transform("starts", lambda s: F.struct(s.alias("first"), s.alias("last"))).alias("runs"))


def repeated_spans(docs: DataFrame, store: Stored, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """(_row, first, last): words first to last of a row are covered by windows that also start elsewhere."""
    rows = numbered(docs, "text")
    anchors = store.keep(_anchor_rows(rows, window, anchor), "anchors", compression="zstd")
    contents = anchors.groupBy("h", "content").agg(
        F.count("*").alias("times"), F.first(ROW).alias(ROW), F.first("at").alias("at"), F.first("n").alias("n")
    )
    contents = store.keep(contents, "contents", compression="zstd")
    again = contents.groupBy("h").agg(F.sum("times").alias("all_times"), F.count("*").alias("contents")).filter("all_times > 1")
    again = store.keep(again.select("h", "contents"), "again", compression="zstd")

    # Runs whose anchor occurs again. All windows of a run are repeated if the anchor stands in equal runs only.
    runs = anchors.join(again, "h")
    whole = runs.filter("contents = 1").select(ROW, F.col("at").alias("first"), (F.col("at") + F.col("n") + window - 2).alias("last"))

    pieces = contents.join(again.filter("contents > 1"), "h").select(ROW, "h", "content", "times", "contents", "at", "n")
    pieces = store.keep(_with_words(pieces, rows, window), "pieces", compression="zstd")
    shards = max(1, pieces.filter(F.col("contents") <= ANCHOR_PIECES).count() // SHARD_PIECES)
    verdicts = _by_automaton(pieces.filter(F.col("contents") <= ANCHOR_PIECES), window, shards).union(
        _by_window(pieces.filter(F.col("contents") > ANCHOR_PIECES), window)
    )
    verdicts = store.keep(verdicts.filter(F.size("runs") > 0), "verdicts")
    parts = runs.filter("contents > 1").select(ROW, "at", "h", "content").join(verdicts, ["h", "content"])
    parts = parts.select(ROW, "at", F.explode("runs").alias("run"))
    parts = parts.select(ROW, (F.col("at") + F.col("run.first")).alias("first"), (F.col("at") + F.col("run.last") + window - 1).alias("last"))
    return whole.union(parts)


def substring_dedup(docs: DataFrame, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ..) without the words that a repeated window covers.

    A window is ``window`` consecutive words; it is repeated if its words also start anywhere else in the corpus, the same
    document included. All copies go, the first one too; windows are judged on the input.

    References are the passages that can repeat: runs of windows around an anchor (least hash among the windows' word
    groups) that the corpus has again. They fall into shards by anchor, which all windows with equal words share; each
    shard gets a suffix automaton, weighted by how often a passage occurs, and the runs are streamed through it for the
    longest match at each word. An automaton of all references would grow with the corpus, so none is sent to every task:
    each is built where its shard is. Runs of equal words are streamed once. An anchor with very many different runs (a
    common passage with different surroundings) does not go to one task: its windows are counted one by one.

    Words are compared by 64-bit hashes of the words in sequence. Null and empty texts have no words; texts shorter than a
    window stay whole. Rows that repeat a doc_id, or are equal, are texts of their own, so both lose what they share. An
    empty table gives no rows. Other columns are not read.

    Returns _row, doc_id, n_words, n_removed, text (kept words joined by one space), spans array<struct<first,last>>
    (removed words, merged).
    """
    store = Stored(docs.sparkSession)
    spans = repeated_spans(docs, store, window, anchor)
    spans = store.keep(spans.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")), "spans")
    rows = numbered(docs, "doc_id", "text").join(spans, ROW, "left")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, doc_id, text, spans_ in zip(batch[ROW].tolist(), batch["doc_id"].astype(object).tolist(), batch["text"], batch["spans"]):
                words = (text or "").encode().split()
                kept, merged, at = [], [], 0
                for s in [] if spans_ is None else spans_:
                    if merged and s["first"] <= merged[-1][1] + 1:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], s["last"]))
                    else:
                        merged.append((s["first"], s["last"]))
                for first, last in merged:
                    kept += words[at:first]
                    at = last + 1
                kept += words[at:]
                out.append((row, doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode(), merged))
            yield pd.DataFrame(out, columns=[ROW, "doc_id", "n_words", "n_removed", "text", "spans"])

    schema = f"{ROW} bigint, doc_id {kind}, n_words bigint, n_removed bigint, text string, spans array<struct<first:int,last:int>>"
    return rows.mapInPandas(run, schema)
