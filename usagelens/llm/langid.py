"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, numbered
from usagelens.llm.tokens import in_slices

DIMENSIONS = 1024
UNKNOWN = "und"
#: More languages than this are taken for an error in the lang column: prototypes are held by every task.
MAX_LANGUAGES = 5_000
#: Characters that are counted together, and documents whose profiles are bundled together.
_CHARS = 300_000
_DOCS = 64
#: Alphabets up to this size are counted in a table of all trigrams.
_SMALL = 80
_SEED = 3
_NO_LETTER = re.compile(r"[\W\d_]")
_LETTERS: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter (an alphabetic character)."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0][codes]


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """A random vector of -1 and 1 for each code point, the same in every process."""
    return np.array([np.random.default_rng([_SEED, int(c)]).integers(0, 2, dimensions, np.int8) * 2 - 1 for c in codes], np.int8)


class Trigrams:
    """Trigram counts of some texts: ``counts`` (texts x trigrams) and ``vectors`` (trigrams x dimensions).

    Texts are lower-cased; what is not a letter becomes one blank, at both ends too. A trigram's vector binds (multiplies)
    the vectors of its letters, each permuted (rotated) by its place.
    """

    def __init__(self, texts: list[str], dimensions: int, vectors_of: dict[int, np.ndarray]):
        texts, n = [t.lower() for t in texts], len(texts)
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) + 1 for t in texts])
        owner = np.repeat(np.arange(n), lengths)
        letter = _is_letter(codes)
        self.letters = np.bincount(owner, letter, n)
        codes = np.where(letter, codes, 0)
        blank = ~letter
        keep = ~(blank & np.concatenate([[True], blank[:-1]]) & (owner == np.concatenate([[-1], owner[:-1]])))
        codes, owner = codes[keep], owner[keep]
        alphabet, place = np.unique(codes, return_inverse=True) if len(codes) else (codes, codes.astype(np.int64))
        # A text that begins with a letter lacks its first blank; the last character of each text is a blank.
        if len(codes) < 3:
            self.counts, self.vectors = np.zeros((n, 0), np.float32), np.zeros((0, dimensions), np.int8)
            return
        size = len(alphabet)
        same = (owner[2:] == owner[:-2]) & (codes[1:-1] != 0)
        tri = ((place[:-2] * size + place[1:-1]) * size + place[2:])[same]
        owner = owner[2:][same]
        if size <= _SMALL:
            present = np.flatnonzero(np.bincount(tri, minlength=size**3))
            column = np.empty(size**3, np.int64)
            column[present] = np.arange(len(present))
            column = column[tri]
        else:
            present, column = np.unique(tri, return_inverse=True)
        width = len(present)
        self.counts = np.bincount(owner * width + column, minlength=n * width).reshape(n, width) if width else np.zeros((n, 0))
        for c in alphabet.tolist():
            if c not in vectors_of:
                vectors_of[c] = letter_vectors(np.array([c]), dimensions)[0]
        table = np.stack([vectors_of[c] for c in alphabet.tolist()])
        first, second = np.roll(table, 2, axis=1), np.roll(table, 1, axis=1)
        self.vectors = first[present // size // size] * second[present // size % size] * table[present % size]


def _cut(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Long texts in parts, cut before a character that is no letter, and the text that each part is of."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        text, lo = text or "", 0
        while len(text) - lo > 2 * _CHARS:
            found = _NO_LETTER.search(text, lo + _CHARS, lo + 2 * _CHARS)
            hi = found.start() if found else lo + 2 * _CHARS
            parts.append(text[lo:hi])
            owner.append(i)
            lo = hi
        parts.append(text[lo:])
        owner.append(i)
    return parts, np.array(owner, np.int64)


def _in_groups(parts: list[str]) -> Iterator[tuple[int, int]]:
    for lo, hi in in_slices(parts, _CHARS):
        for a in range(lo, hi, _DOCS):
            yield a, min(a + _DOCS, hi)


def prototypes(docs: DataFrame, train: Column, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The languages in ``docs`` (text, lang) and the bundle of all trigram vectors of each, from the rows in ``train``.

    Tasks bundle what they read, one integer vector for each language; sums of those are exact in any order. The result
    has ``dimensions`` numbers for each language, whatever the size of the input.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundles: dict[str, np.ndarray] = {}
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            parts, owner = _cut(batch["text"].tolist())
            langs = batch["lang"].to_numpy(object)[owner]
            for lo, hi in _in_groups(parts):
                grams = Trigrams(parts[lo:hi], dimensions, known)
                for lang in set(langs[lo:hi]):
                    counts = grams.counts[langs[lo:hi] == lang].sum(axis=0)
                    # Exact: single-precision sums of products stay under 2 ** 24 within a group.
                    bundle = counts.astype(np.float32) @ grams.vectors.astype(np.float32)
                    bundles[lang] = bundles.get(lang, 0) + bundle.astype(np.int64)
        for lang, bundle in bundles.items():
            yield pd.DataFrame({"lang": lang, "dimension": np.arange(dimensions), "total": bundle})

    learned = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = learned.mapInPandas(run, "lang string, dimension int, total bigint")
    sums = parts.groupBy("lang", "dimension").agg(F.sum("total").alias("total"))
    vectors = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dimension", "total"))).alias("v"))
    rows = sorted(vectors.select("lang", "v.total").limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [r["lang"] for r in rows], np.array([r["total"] for r in rows], np.float64).reshape(len(rows), dimensions)


def identify(docs: DataFrame, languages: list[str], bundles: np.ndarray, *columns: str | Column) -> DataFrame:
    """_row, doc_id, ``columns``, lang_pred and score (cosine with the prototype, from 0 to 1) of each text.

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned; of equal cosines the
    first language in code point order wins.
    """
    dimensions = bundles.shape[1]
    norms = np.linalg.norm(bundles, axis=1, keepdims=True)
    units = (bundles / np.where(norms > 0, norms, 1)).astype(np.float32)
    rows = numbered(docs, "doc_id", *columns, "text")
    out = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            n = len(batch)
            parts, owner = _cut(batch["text"].tolist())
            profiles, letters = np.zeros((n, dimensions), np.float32), np.zeros(n)
            for lo, hi in _in_groups(parts):
                grams = Trigrams(parts[lo:hi], dimensions, known)
                np.add.at(profiles, owner[lo:hi], grams.counts.astype(np.float32) @ grams.vectors.astype(np.float32))
                np.add.at(letters, owner[lo:hi], grams.letters)
            names, scores = np.full(n, UNKNOWN, object), np.zeros(n)
            if languages:
                length = np.linalg.norm(profiles, axis=1)
                cosines = (profiles @ units.T) / np.where(length > 0, length, 1)[:, None]
                best, found = cosines.argmax(axis=1), letters > 0
                names = np.where(found, np.array(languages, object)[best], UNKNOWN)
                scores = np.where(found, np.clip(cosines[np.arange(n), best].astype(np.float64), 0, 1), 0.0)
            yield batch.drop(columns="text").assign(lang_pred=names, score=scores)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out] + ["lang_pred string", "score double"])
    return rows.mapInPandas(run, schema)


def language_id(docs: DataFrame, train: Column, *columns: str | Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """The language of each text of ``docs`` (doc_id, text, lang, ..), learned from the rows in ``train``.

    Every letter has a random vector. Letter vectors, permuted by place, are bound into trigram vectors; those of a text
    are bundled (added up) into its profile, and those of all training texts of a language into its prototype. A text has
    the language whose prototype has the largest cosine with its profile. Whole texts count, in both steps. Predictions
    use the text alone.

    Training leaves out null texts and null lang. Texts without a letter (null and empty ones too) are ``und``, score 0.
    Rows that repeat a doc_id are rows of their own. An empty table gives no rows. Other columns are not read.

    Returns _row, doc_id, ``columns``, lang_pred, score.
    """
    languages, bundles = prototypes(docs, train, dimensions)
    return identify(docs, languages, bundles, *columns)
