import random

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, prose, stored

from usagelens.llm.common import Stored, components
from usagelens.llm.simhash import fingerprint, near_groups, near_links

CONTRACT = {"shingle_words": 3, "words": 1, "segment_bits": 32, "ball": 1, "max_distance": 2, "matches": None}


def plain(text, k):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", "one", "Two WORDS", "The cat  sat on\tthe MAT é É", prose(500)])
def test_fingerprint_equals_a_plain_one(text):
    assert int.from_bytes(fingerprint(text, 3), "big") == plain(text, 3)
    assert fingerprint(text, 3, 4)[:8] == fingerprint(text, 3)


def test_all_links_are_found(spark):
    random.seed(4)
    prints = [random.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for flips in (1, 2, 2, 3):
            prints.append(p ^ sum(1 << b for b in random.sample(range(64), flips)))
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(i, [p - (1 << 64) if p >> 63 else p]) for i, p in enumerate(prints)], "node long, bits array<long>")
    got = {(r.a, r.b) for r in near_links(nodes, 1, 32, 1, 2).collect()}
    assert got == {(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 2}


def test_components(spark):
    random.seed(5)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Stored(spark)).collect()}
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in label.items() if k in got} == got and set(label) - set(got) <= loops


def test_contract_on_awkward_rows(spark, tmp_path):
    got = near_groups(stored(spark, tmp_path, AWKWARD), **CONTRACT).collect()
    prints = [plain(t, 3) for _, t, *_ in AWKWARD]
    groups = {}
    for i, c in enumerate(classes(prints, 2)):
        groups.setdefault(c, []).append(AWKWARD[i][0])
    want = [(str(d), min((x for x in groups[c] if x is not None), default=None)) for (d, *_), c in zip(AWKWARD, classes(prints, 2))]
    assert sorted(map(str, ((str(r.doc_id), r.component_id) for r in got))) == sorted(map(str, want))
    assert sorted(r.bits[0] % (1 << 64) for r in got) == sorted(prints)


def test_near_copies_of_the_pipeline(spark, tmp_path):
    random.seed(6)
    rows, similar = [], []
    for i in range(40):
        words = [f"w{random.randint(0, 5000)}" for _ in range(300)]
        copy = list(words)
        for _ in range(2 + i % 5):
            copy[random.randrange(300)] = "changed"
        rows += [(2 * i, " ".join(words), "en", "a"), (2 * i + 1, " ".join(copy), "en", "a")]
        sets = [{tuple(w[j : j + 5]) for j in range(296)} for w in (words, copy)]
        similar.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    got = {r.doc_id: r.component_id for r in near_groups(stored(spark, tmp_path, rows)).collect()}
    joined = [got[2 * i] == got[2 * i + 1] for i in range(40)]
    assert np.mean([j for j, s in zip(joined, similar) if s >= 0.8]) > 0.9
    assert len(set(got.values())) >= 40


def test_empty_table(spark, tmp_path):
    assert near_groups(stored(spark, tmp_path, [])).collect() == []
