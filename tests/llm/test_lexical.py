import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, prose, stored

from usagelens.llm import lexical
from usagelens.llm.lexical import Postings, _decoded, _numbers, build_index, ranked_search, search, search_shard, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    """(item_id, rank, doc_id, score) of every item, all documents scored."""
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total if total else 0
            score = 0
            for t in plain_terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def test_terms_and_numbers():
    text = "Ab-c9é ÀZ\x7f_z ß^ \x00日本1"
    assert [t.decode() for s in terms(text) for t in s] == plain_terms(text) and list(terms(None)) == []
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 5])
    data, ends = _numbers(values)
    assert _decoded(np.frombuffer(data, np.uint8)).tolist() == values.tolist() and ends[-1] == len(data)


def test_long_texts_are_split_at_terms(monkeypatch):
    monkeypatch.setattr(lexical, "_SLICE", 10)
    text = "abc defghij klmnopqrstuvwxyz " * 20 + "x" * 50
    assert [t.decode() for s in terms(text) for t in s] == plain_terms(text)


def postings(rng, n_docs, df, norms, weight):
    docs = np.sort(rng.choice(n_docs, df, replace=False))
    tf = rng.integers(1, 9, df)
    blocks, last, most, least = [], [], [], []
    for lo in range(0, df, lexical.BLOCK):
        d, f = docs[lo : lo + lexical.BLOCK], tf[lo : lo + lexical.BLOCK]
        blocks.append(_numbers(np.concatenate([np.diff(d, prepend=d[0] - 1) - 1 + np.where(np.arange(len(d)) == 0, d[0], 0), f]))[0].tobytes())
        last.append(d[-1])
        most.append(f.max())
        least.append(norms[d].min())
    list_ = Postings(weight, np.cumsum([len(b) for b in blocks]), np.array(last), np.array(most), np.array(least), b"".join(blocks), norms)
    return list_, docs, tf


@pytest.mark.parametrize("seed", range(12))
def test_search_of_a_shard_equals_scoring_all(seed):
    rng = np.random.default_rng(seed)
    n_docs = int(rng.integers(1, 6000))
    norms = rng.integers(75, 400, n_docs)
    lists, scores = [], np.zeros(n_docs, np.int64)
    for _ in range(rng.integers(1, 12)):
        weight, times = int(rng.integers(0, 9000)), int(rng.integers(1, 3))
        list_, docs, tf = postings(rng, n_docs, int(rng.integers(1, n_docs + 1)), norms, weight)
        lists.append((list_, times))
        scores[docs] += times * weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * norms[docs]))
    docs, got = search_shard(lists, n_docs, 20)
    order = np.lexsort((docs, -got))[:20]
    best = [d for d in np.lexsort((np.arange(n_docs), -scores))[:20] if scores[d] > 0]
    assert docs[order].tolist() == best and got[order].tolist() == scores[best].tolist()


def test_block_maxima_spare_decompression():
    rng = np.random.default_rng(1)
    n_docs = 20_000
    norms = rng.integers(75, 400, n_docs)
    common, _, _ = postings(rng, n_docs, 18_000, norms, 90)
    rare, _, _ = postings(rng, n_docs, 60, norms, 8000)
    search_shard([(common, 1), (rare, 1)], n_docs, 20)
    assert common.opened < 0.5 * len(common.last) and rare.opened == len(rare.last)


@pytest.mark.parametrize("shard_bytes", [300, 20_000, lexical.SHARD_BYTES])
def test_search_equals_brute_force(spark, tmp_path, shard_bytes):
    random.seed(shard_bytes)
    words = [f"w{i}" for i in range(60)] + ["Été", "the", "The", "of"] * 10
    docs = [(i, " ".join(random.choices(words, k=random.choice((0, 3, 20, 90)))), "en", "a") for i in range(300)]
    docs += [(i, docs[5][1] + " w1 w2", "en", "b") for i in range(1000, 1100)]  # equal documents: ties go by id
    items = [(i, " ".join(random.choices(words, k=random.choice((1, 4, 12))))) for i in range(30)] + [(5, docs[5][1] + " w1 w1 w2")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = found(ranked_search(stored(spark, tmp_path, docs), asked, 7, shard_bytes))
    assert got == brute([d[:2] for d in docs], items, 7)


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    docs = stored(spark, tmp_path, AWKWARD)
    items = [(1, None), (2, ""), (3, "the no id"), (None, "id HERE"), (3, "the no id"), (4, "!!"), (5, "unknownterm"), (6, prose(60, 1))]
    asked = spark.createDataFrame([(i, t, 9, "x") for i, t in items], "item_id long, text string, shard int, term string")
    assert found(ranked_search(docs, asked)) == brute([r[:2] for r in AWKWARD], items, 20)
    assert ranked_search(docs, asked.limit(0)).collect() == []
    assert ranked_search(stored(spark, tmp_path, []), asked).collect() == []
    assert ranked_search(stored(spark, tmp_path, AWKWARD[:3]), asked).collect() == []


def test_many_items_and_an_index_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 4)
    docs = [(i, prose(30, i), "en", "a") for i in range(50)]
    items = [(i, prose(5, i)) for i in range(40)]
    folder = str(tmp_path / "index")
    build_index(stored(spark, tmp_path, docs), 2000).write.parquet(folder)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(search(spark.read.parquet(folder), asked, 3)) == brute([d[:2] for d in docs], items, 3)
