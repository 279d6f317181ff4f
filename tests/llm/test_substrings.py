import random
from collections import Counter

import pytest
from helpers import AWKWARD, prose, stored

from usagelens.llm import substrings
from usagelens.llm.substrings import SuffixAutomaton, substring_dedup


def check(rows, got, window):
    split = [(text or "").encode().split() for _, text, *_ in rows]
    starts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    want = []
    for (doc_id, *_), w in zip(rows, split):
        covered = {j for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        want.append((str(doc_id), len(w), len(covered), b" ".join(x for j, x in enumerate(w) if j not in covered).decode()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == sorted(want)
    for r in got:
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed


def test_matching_statistics():
    automaton = SuffixAutomaton()
    automaton.add([1, 2, 3, 1, 2, 4], 1)
    automaton.add([2, 3, 1, 5], 1)
    automaton.add([7, 8, 9], 2)
    automaton.finish()
    assert automaton.repeated([9, 1, 2, 3, 1, 5], 2) == [1, 2, 3]
    assert automaton.repeated([2, 3, 1, 9], 3) == [0]
    assert automaton.repeated([7, 8, 9], 3) == [0] and automaton.repeated([4, 4], 1) == []


@pytest.mark.parametrize("anchor_pieces", [500, 0, 3])
def test_random_texts(spark, tmp_path, monkeypatch, anchor_pieces):
    # No, all or some anchors are counted window by window.
    monkeypatch.setattr(substrings, "ANCHOR_PIECES", anchor_pieces)
    monkeypatch.setattr(substrings, "SHARD_PIECES", 20)
    random.seed(anchor_pieces)
    rows = [(i, " ".join(random.choice("abc") for _ in range(random.randint(0, 60))), "en", "a") for i in range(60)]
    rows += [(100, rows[0][1], "en", "a"), (101, "a " * 50, "en", "a"), (102, "z " + rows[3][1], "en", "a")]
    check(rows, substring_dedup(stored(spark, tmp_path, rows), window=9, anchor=3).collect(), 9)


def test_awkward_rows(spark, tmp_path):
    shared = prose(50, 77)
    rows = AWKWARD + [(30, prose(20, 8) + " " + shared, "en", "a"), (31, shared + " " + prose(40, 9), "en", "a"), (32, prose(34, 3) + "\t" + prose(34, 3), "en", "a")]
    check(rows, substring_dedup(stored(spark, tmp_path, rows)).collect(), 35)


def test_empty_table(spark, tmp_path):
    assert substring_dedup(stored(spark, tmp_path, [])).collect() == []
