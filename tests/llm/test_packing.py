import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, stored
from tokenizers import Tokenizer

from usagelens.llm.common import Stored
from usagelens.llm.packing import best_fit_decreasing, pack_documents, sequences
from usagelens.llm import queries  # noqa: F401
from usagelens.llm.registry import QUERIES
from usagelens.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_best_fit_decreasing_one_by_one(seed):
    random.seed(seed)
    capacity = random.choice([7, 16, 50, 1024])
    lengths = [min(capacity, int(random.expovariate(3 / capacity)) + 1) for _ in range(random.randint(0, 300))]
    remaining = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in remaining if r >= n), default=None)
        if best is None:
            remaining.append(capacity - n)
        else:
            remaining[remaining.index(best)] = best - n
    windows, placed = defaultdict(list), Counter()
    for n, low, high, each, first, offset in best_fit_decreasing(Counter(lengths), capacity):
        for r in range(low, high):
            windows[first + (r - low) // each].append((offset + (r - low) % each * n, n))
            placed[n] += 1
    assert placed == Counter(lengths)
    assert sorted(windows) == list(range(len(windows)))
    assert sorted(capacity - sum(n for _, n in w) for w in windows.values()) == sorted(remaining)
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:i]) for i in range(len(w))]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_tokenizer(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    random.seed(3)
    signs = "ab'sT 1é²\xa0\x85\n\t.!$\x1cÀß\x00"
    texts = ["".join(random.choice(signs) for _ in range(50)) for _ in range(800)]
    texts += ["", " ", "\n", "<|endoftext|> x<|endoftext|>", "日本語 テスト", "ΑΣ ΣΑΣ", "it's I'LL don't", "x" * 5000, "a\n\n  b  "]
    encoder = Encoder(path)
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_are_those_of_the_library(spark, tmp_path, path):
    tokenizer = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|startoftext|>it's<|endoftext|><|endoftext|>", "日本 <|endoftext|> é", "<|ENDOFTEXT|> x", "<|endoftext", "plain"]
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert path == WORDS or want[0] == [64, 220, 50256, 275]
    docs = stored(spark, tmp_path, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in pack_documents(docs, path).collect()}
    assert got == {i: [*ids, 0] for i, ids in want.items()}


def check(rows, got, capacity):
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc_id, text, *_ in rows:
        want[doc_id, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    docs, windows = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        docs[r.doc_id, r._row].append((r.start, ids, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    whole = Counter()
    for (doc_id, _), parts in docs.items():
        ids = [i for _, part, _ in sorted(parts) for i in part]
        assert {n for *_, n in parts} == {len(ids)}
        whole[doc_id, tuple(ids)] += 1
    assert whole == want
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:i]) for i in range(len(w))]
        assert sum(n for _, n in w) <= capacity


def test_awkward_rows(spark, tmp_path):
    packed = pack_documents(stored(spark, tmp_path, AWKWARD), BYTES, capacity=64)
    got = packed.collect()
    check(AWKWARD, got, 64)
    whole = sequences(packed, 64).collect()
    assert len(whole) == len({r.sequence_id for r in got})
    for s in whole:
        assert len(s.ids) == 4 * s.padded and s.padded == (s.used if s.used & (s.used - 1) == 0 else 64)


def test_empty_table(spark, tmp_path):
    assert pack_documents(stored(spark, tmp_path, []), BYTES).collect() == []


@pytest.mark.parametrize("name", ["op5_packing", "pipeline"])
def test_queries_write_the_ids_that_they_sum_up(name, spark, sf, tmp_path, monkeypatch):
    """The last table written holds the ids, which fill whole sequences; the checksums returned are theirs."""
    kept, keep = [], Stored.keep
    monkeypatch.setattr(Stored, "keep", lambda store, df, *a, **o: kept.append(keep(store, df, *a, **o)) or kept[-1])
    if name == "pipeline":
        docs = stored(spark, tmp_path, AWKWARD)
        out = corpus_pipeline.pack_sequences(spark, docs, None)
    else:
        out = QUERIES[name](spark, sf)
    packed = kept[-1]
    rows = packed.collect()
    assert all(len(r.ids) == 4 * r.length for r in rows)
    want = Counter((r.doc_id, r.start, zlib.crc32(r.ids), r.sequence_id, r.offset) for r in rows)
    assert want == Counter((r.doc_id, r.start, r.ids_crc32, r.sequence_id, r.offset) for r in out.collect())
    assert sum(r.used for r in sequences(packed).collect()) == sum(r.length for r in rows)
