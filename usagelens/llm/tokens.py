"""Token ids of whole texts by the public tokenizers, as bytes."""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces whose ids a worker remembers; when there are more, it forgets those it met in one slice only.
REMEMBERED = 300_000
#: Pieces that are encoded together, and characters that are split together.
_TOGETHER = 10_000
SLICE_CHARS = 1_500_000
ID_TYPE = "<u4"
#: A byte that UTF-8 does not use.
_MARK = b"\xff"

# The pre-tokenizer patterns of the two vocabularies, for texts in Latin-1. Letters and white space of
# Latin-1 are spelled out, as the standard module knows no classes of letters.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_BYTE_LEVEL = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_WORD_LEVEL = f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"

_SPACE, _LETTER, _DIGIT, _OTHER, _BETWEEN = range(5)
_EDGE = np.array([_BETWEEN], np.uint8)


def _class_table() -> np.ndarray:
    """Class of each Latin-1 character."""
    table = np.full(256, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, _L), (_DIGIT, _N), (_SPACE, _S)):
        table[[i for i in range(256) if re.fullmatch(f"[{pattern}]", chr(i))]] = kind
    return table


def _byte_alphabet() -> str:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in prints else chr(next(others)) for b in range(256))


class Encoder:
    """Ids of texts, with what a piece of text encodes to remembered.

    Both vocabularies split a text by a pattern and encode each piece by itself, so that equal pieces have equal ids.
    Latin-1 texts are split here, by class of character, many texts at a time; those with an apostrophe by the pattern, as
    it knows contractions. New pieces are encoded by the tokenizer, many at a time. Texts beyond Latin-1 are encoded by
    the tokenizer as a whole, and so are texts that hold the string of an added token, which is that token's id there.
    Without ``added_tokens`` such strings are ordinary text.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not added_tokens
        decoder = self._tokenizer.get_added_tokens_decoder() if added_tokens else {}
        #: Content of each added token, and whether it is sought in the normalized (lower-cased) text.
        self._added = [(t.content, t.normalized) for t in decoder.values()]
        self._model = self._tokenizer.model
        self._alphabet = _byte_alphabet()
        #: A vocabulary with word ends drops white space and lower-cases.
        self._by_word = bool(self._model.end_of_word_suffix)
        self._split = re.compile(_WORD_LEVEL if self._by_word else _BYTE_LEVEL).findall
        self._class = _class_table()
        self._forget()

    def _forget(self) -> None:
        #: Pieces in the order in which they were learned; where their ids lie, and in how many slices they occurred.
        self._known: dict[bytes, int] = {}
        self._flat = np.zeros(1 << 16, ID_TYPE)
        self._first = np.zeros(1 << 14, np.int64)
        self._count = np.zeros(1 << 14, np.int64)
        self._slices = np.zeros(1 << 14, np.int64)
        self._used = 0

    def _forget_rare(self) -> None:
        """Keep what occurred in several slices, if that is at most half of what is remembered; else start anew."""
        n = len(self._known)
        often = self._slices[:n] > 1
        pieces, first, count, flat = list(compress(self._known, often)), self._first[:n][often], self._count[:n][often], self._flat
        self._forget()
        if len(pieces) <= REMEMBERED // 2:
            upto = np.cumsum(count)
            places = np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - count), count)
            self._remember(pieces, flat[places], count)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, ID_TYPE)

    def _remember(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self._known), len(pieces)
        while self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while n + m > len(self._first):
            self._first = np.concatenate([self._first, np.zeros_like(self._first)])
            self._count = np.concatenate([self._count, np.zeros_like(self._count)])
            self._slices = np.concatenate([self._slices, np.zeros_like(self._slices)])
        self._flat[self._used : self._used + len(ids)] = ids
        self._first[n : n + m] = self._used + np.cumsum(counts) - counts
        self._count[n : n + m] = counts
        self._used += len(ids)
        self._known.update(zip(pieces, range(n, n + m)))

    def _learn(self, new: list[bytes]) -> None:
        """Encode new pieces by the vocabulary's model. It takes bytes as characters, one for each byte of UTF-8."""
        for lo in range(0, len(new), _TOGETHER):
            part = new[lo : lo + _TOGETHER]
            utf8 = _MARK.join([p.decode("latin-1").encode() for p in part])
            texts = codecs.charmap_decode(utf8, "strict", self._alphabet)[0].split(self._alphabet[_MARK[0]])
            ids = [[t.id for t in tokens] for tokens in map(self._model.tokenize, texts)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self._remember(part, np.fromiter(chain.from_iterable(ids), ID_TYPE, counts.sum()), counts)

    def _bounds(self, data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of each piece of texts that lie in ``data`` with one character of kind _BETWEEN after each."""
        before = np.concatenate([_EDGE, kind[:-1]])
        changes = kind != before
        if self._by_word:
            starts = changes | (kind == _DIGIT)
            wanted = (kind != _SPACE) & (kind != _BETWEEN)
        else:
            after = np.concatenate([kind[1:], _EDGE])
            is_space = kind == _SPACE
            # Of white space before a word, the last character stands alone, or with the word if it is a blank.
            last = is_space & (after != _SPACE) & (after != _BETWEEN)
            joins = np.concatenate([[False], last[:-1] & (data[:-1] == 0x20)])
            starts = np.where(is_space, changes | last, changes & ~joins)
            wanted = kind != _BETWEEN
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], len(kind))
        keep = wanted[at]
        return at[keep], ends[keep]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit integers; null is empty."""
        out: list[np.ndarray | None] = [None] * len(texts)
        simple, blocks, listed = [], [], []
        for i, t in enumerate(texts):
            if t and any(c in t or (normalized and c.lower() in t.lower()) for c, normalized in self._added):
                out[i] = self._ids(t)
                continue
            try:
                data = (t or "").encode("latin-1")
            except UnicodeEncodeError:
                out[i] = self._ids(t)
                continue
            if self._by_word:
                data = data.decode("latin-1").lower().encode("latin-1")
            if b"'" in data:
                listed.append((i, [p.encode("latin-1") for p in self._split(data.decode("latin-1"))]))
            else:
                simple.append(i)
                blocks.append(data)
        arrays, owners = [], []
        if simple:
            lengths = np.array([len(b) + 1 for b in blocks])
            data = np.frombuffer(b" ".join([*blocks, b""]), np.uint8)
            kind = self._class[data]
            kind[np.cumsum(lengths) - 1] = _BETWEEN
            first, end = self._bounds(data, kind)
            sizes = end - first
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            # The pieces one after another; what lies between them (white space, ends of texts) is left out.
            packed = data[(kind != _BETWEEN) & ((kind != _SPACE) | (not self._by_word))]
            arrays.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]))
            owners.append(np.searchsorted(np.cumsum(lengths), first, side="right"))
        for k, (_, pieces) in enumerate(listed):
            arrays.append(pa.array(pieces, pa.large_binary()))
            owners.append(np.full(len(pieces), len(simple) + k))
        order = simple + [i for i, _ in listed]
        if order:
            for i, ids in zip(order, self._gather(pa.chunked_array(arrays, pa.large_binary()).combine_chunks(), np.concatenate(owners), len(order))):
                out[i] = ids
        return out

    def _gather(self, pieces: pa.LargeBinaryArray, owner: np.ndarray, n: int) -> list[np.ndarray]:
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = np.array(list(map(self._known.get, distinct, repeat(-1))), np.int64)
        missing = known < 0
        if missing.any():
            new, learned = list(compress(distinct, missing)), len(self._known)
            if learned + len(new) > REMEMBERED:
                self._forget_rare()
                self._learn([p for p in distinct if p not in self._known])
                known = np.array(list(map(self._known.__getitem__, distinct)), np.int64)
            else:
                # New pieces are numbered on, in order.
                self._learn(new)
                known[missing] = np.arange(learned, learned + len(new))
        self._slices[known] += 1
        codes = known[coded.indices.to_numpy()]
        counts = self._count[codes]
        upto = np.cumsum(counts)
        places = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self._first[codes] - (upto - counts), counts)
        ids = self._flat[places]
        ends = np.cumsum(np.bincount(owner, counts, n)).astype(np.int64)
        return np.split(ids, ends[:-1])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process: ids are those of the library as it is, without the tokens it puts around a text."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, added_tokens=True)
    return _ENCODERS[path]


def in_slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts with about so many characters together: bounds the memory of a step."""
    return _cut_by_size([len(t or "") for t in texts], chars)


def _cut_by_size(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def batch_slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[dict[str, list]]:
    """The columns of a batch as lists, cut so that no more than a slice of text is in Python at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    for lo, hi in _cut_by_size(sizes, SLICE_CHARS):
        yield batch.slice(lo, hi - lo).to_pydict()
