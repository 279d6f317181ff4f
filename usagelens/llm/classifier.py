"""Quality scores by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, numbered
from usagelens.llm.tokens import in_slices

#: Labelled documents that the classifier is fitted on, at most: those whose ids have the least hashes.
SAMPLE = 4_096
LATENT = 48
NEIGHBOURS = 40
THRESHOLD = 0.3
_CHARS = 300_000
_DOCS = 64

# Terms are groups of three signs. A sign is a character class, or a mark of its own; runs of letters, digits and white
# space count as one sign. Further terms say how large the parts of distinct words and lines are.
_LOWER, _UPPER, _LETTER, _DIGIT, _BLANK, _BREAK, _SYMBOL = range(1, 8)
_MARKS = [i for i in range(33, 127) if not chr(i).isalnum()]
_SIGNS = 8 + len(_MARKS)
_SHARES = 16
#: A share counts as a term that occurs so often.
_SHARE_COUNT = 100
TERMS = _SIGNS**3 + 2 * _SHARES
_TABLE: list[np.ndarray] = []


def _signs() -> np.ndarray:
    """The sign of each code point."""
    if not _TABLE:

        def sign(c: str) -> int:
            if c.isspace():
                return _BREAK if c == "\n" else _BLANK
            if c.isalpha():
                return _LOWER if c.islower() else _UPPER if c.isupper() else _LETTER
            return _DIGIT if c.isdigit() else _SYMBOL

        table = np.array([sign(chr(i)) for i in range(0x110000)], np.int64)
        table[_MARKS] = np.arange(8, _SIGNS)
        _TABLE.append(table)
    return _TABLE[0]


def _share(parts: list) -> int:
    """Which of _SHARES equal classes the share of distinct parts is in."""
    return min(_SHARES - 1, len(set(parts)) * _SHARES // len(parts)) if parts else _SHARES - 1


def term_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Terms that occur in some of the texts, ascending, and how often in which (texts x terms). Null is empty."""
    texts, n = [t or "" for t in texts], len(texts)
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(n), [len(t) + 1 for t in texts])
    signs = _signs()[codes]
    inside = np.ones(len(codes), bool)
    inside[np.cumsum([len(t) + 1 for t in texts]) - 1] = False
    again = (signs == np.concatenate([[0], signs[:-1]])) & (signs < _SYMBOL) & (owner == np.concatenate([[-1], owner[:-1]]))
    signs, owner = signs[inside & ~again], owner[inside & ~again]
    same = owner[2:] == owner[:-2]
    terms = [((signs[:-2] * _SIGNS + signs[1:-1]) * _SIGNS + signs[2:])[same]]
    owners = [owner[2:][same]]
    for k, parts in enumerate((str.split, str.splitlines)):
        some = [i for i, t in enumerate(texts) if t]
        shares = np.array([_SIGNS**3 + k * _SHARES + _share(parts(texts[i])) for i in some], np.int64)
        terms.append(np.repeat(shares, _SHARE_COUNT))
        owners.append(np.repeat(np.array(some, np.int64), _SHARE_COUNT))
    term, owner = np.concatenate(terms), np.concatenate(owners)
    present = np.flatnonzero(np.bincount(term, minlength=TERMS))
    column = np.zeros(TERMS, np.int64)
    column[present] = np.arange(len(present))
    counts = np.bincount(owner * len(present) + column[term], minlength=n * len(present)).reshape(n, len(present))
    return present, counts


class Voter:
    """Labelled latent-semantic vectors, and votes of the nearest ones."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, latent: int, neighbours: int):
        used = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.int64)
        matrix = np.zeros((len(terms), len(used)), np.float32)
        for row, (t, c) in enumerate(zip(terms, counts)):
            matrix[row, np.searchsorted(used, t)] = c
        # Terms of one document in the sample say nothing about others.
        often = (matrix > 0).sum(axis=0) > 1
        self._column = np.full(TERMS, -1, np.int64)
        self._column[used[often]] = np.arange(often.sum())
        matrix = matrix[:, often]
        self._weight = np.log1p(len(matrix) / np.maximum(1, (matrix > 0).sum(axis=0))).astype(np.float32)
        weighted = self._weighted(matrix, self._weight)
        self._project = self._axes(weighted, latent)
        self.vectors = self._unit(weighted @ self._project)
        self.labels = labels.astype(np.float32)
        self._neighbours = min(neighbours, len(labels))
        self.base_rate = float(labels.mean()) if len(labels) else 0.5

    @staticmethod
    def _unit(m: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norms > 0, norms, 1)

    @classmethod
    def _weighted(cls, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return cls._unit(np.log1p(counts).astype(np.float32) * weight)

    @staticmethod
    def _axes(matrix: np.ndarray, latent: int) -> np.ndarray:
        """Leading right singular vectors, by subspace iteration from a fixed start."""
        latent = min(latent, *matrix.shape)
        start = np.random.default_rng(7).standard_normal((matrix.shape[1], latent)).astype(np.float32)
        for _ in range(12 if latent else 0):
            start, _ = np.linalg.qr(matrix.T @ (matrix @ start))
        return start

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighed by its cosine; the base rate if none is near."""
        if not len(self.labels):
            return np.full(len(texts), self.base_rate)
        present, counts = term_counts(texts)
        column = self._column[present]
        known = column >= 0
        weighted = self._weighted(counts[:, known], self._weight[column[known]])
        vectors = self._unit(weighted @ self._project[column[known]])
        cosines = vectors @ self.vectors.T
        k = self._neighbours
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        # Close neighbours count most: the fourth power spreads cosines that are all high.
        votes = np.clip(np.take_along_axis(cosines, near, axis=1), 0, 1).astype(np.float64) ** 4
        total = votes.sum(axis=1)
        yes = (votes * self.labels[near]).sum(axis=1)
        return np.where(total > 0, np.clip(yes / np.where(total > 0, total, 1), 0, 1), self.base_rate)


def labelled_sample(labels: DataFrame, train: Column, sample: int) -> DataFrame:
    """At most ``sample`` rows (doc_id, label) of ``labels`` (doc_id, quality) in ``train``: those with the least hashes."""
    usable = labels.filter(train & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    return usable.select("doc_id", F.col("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, latent: int = LATENT, neighbours: int = NEIGHBOURS) -> Voter:
    """A voter from at most ``sample`` labelled documents: the bound of what is collected and of what each task holds.

    Only the labels are sorted for it. The ids are broadcast, since there are at most ``sample`` of them; texts become term
    counts on the executors.
    """
    chosen = F.broadcast(labelled_sample(labels, train, sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                terms, counts = term_counts([row.text])
                yield pd.DataFrame({"h": [row.h], "label": [row.label], "terms": [terms], "counts": [counts[0]]})

    found = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", "label")
    rows = found.mapInPandas(run, "h bigint, label int, terms array<bigint>, counts array<bigint>").orderBy("h", "label").limit(sample).collect()
    terms, counts = ([np.array(r[c], np.int64) for r in rows] for c in ("terms", "counts"))
    return Voter(terms, counts, np.array([r["label"] for r in rows], np.float64), latent, neighbours)


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, *columns: str | Column, threshold: float = THRESHOLD, **fitting: int) -> DataFrame:
    """Scores of all texts of ``docs`` (doc_id, text, ..), learned from ``labels`` (doc_id, quality, ..) in ``train``.

    Documents are counts of sign groups (character classes and punctuation marks) of the whole text, weighed and projected
    on the leading singular vectors of a bounded labelled sample. The sample's vectors are broadcast with the task; exact
    cosines of a block of documents with all of them are one matrix product, and the nearest vote for their label.

    Null, empty and unlike texts have the share of label 1 in the sample, 0.5 without labels. Rows that repeat a doc_id are
    rows of their own. An empty table gives no rows. Labels other than 0 and 1, and labels without an id, are left out.
    Other columns are not read.

    Returns _row, doc_id, ``columns``, score, predicted.
    """
    voter = fit(docs, labels, train, **fitting)
    rows = numbered(docs, "doc_id", *columns, "text")
    out = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            scores = np.zeros(len(texts))
            for lo, hi in in_slices(texts, _CHARS):
                for a in range(lo, hi, _DOCS):
                    b = min(a + _DOCS, hi)
                    scores[a:b] = voter.scores(texts[a:b])
            yield batch.drop(columns="text").assign(score=scores, predicted=(scores >= threshold).astype(np.int32))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out] + ["score double", "predicted int"])
    return rows.mapInPandas(run, schema)
