import random
from unittest import mock

import corpus_pipeline
from helpers import stored

from usagelens.llm import similar
from usagelens.llm.common import Stored, numbered
from usagelens.llm.simhash import fingerprint


def lists():
    random.seed(21)
    rows = []
    for i in range(30):
        words = [f"w{random.randint(0, 5000)}" for _ in range(300)]
        copy = list(words)
        copy[random.randrange(300)] = "changed"
        rows += [(2 * i, " ".join(words), "en", "a"), (2 * i + 1, " ".join(copy), "en", "a")]
    return rows


def test_simhash_proposes_and_multi_index_hashing_finds(spark, tmp_path):
    rows = lists()
    docs = stored(spark, tmp_path, rows)
    at = {r._row: r.doc_id for r in numbered(docs, "doc_id").collect()}
    nodes = numbered(docs, "doc_id").selectExpr("_row as node")
    got = {frozenset((at[r.a], at[r.b])) for r in similar.print_pairs(nodes, docs, Stored(spark)).collect()}
    prints = {d: int.from_bytes(fingerprint(t, 3), "big") for d, t, *_ in rows}
    first = {}
    for d in sorted(prints):
        first.setdefault(prints[d], d)
    heads = sorted(first.values())
    want = {frozenset((first[p], d)) for d, p in prints.items() if first[p] != d}
    want |= {frozenset((a, b)) for a in heads for b in heads if a < b and (prints[a] ^ prints[b]).bit_count() <= 2}
    assert len(want) >= 10 and got == want


def test_near_copies_leave_by_simhash_alone(spark, tmp_path):
    """Without a single bucket of MinHash, copies whose fingerprints are close still leave."""
    rows = lists()
    prints = {d: int.from_bytes(fingerprint(t, 3), "big") for d, t, *_ in rows}
    close = [2 * i + 1 for i in range(30) if (prints[2 * i] ^ prints[2 * i + 1]).bit_count() <= 2]
    docs = stored(spark, tmp_path, rows)
    plain = similar._signatures

    def no_buckets(d, words):
        return plain(d, words).selectExpr("_row", "doc_id", "digest", "n", "filter(keys, k -> false) as keys")

    with mock.patch.object(similar, "_signatures", no_buckets):
        kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect()}
    assert close and kept == {d for d, *_ in rows} - set(close)
