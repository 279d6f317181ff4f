import random
from collections import Counter, defaultdict

import corpus_pipeline
from helpers import AWKWARD, stored

from usagelens.llm.similar import shingles, similar_groups


def plain_classes(texts, similarity=0.8, words=5):
    sets = [shingles(t, words) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= similarity * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def first_of_class(rows):
    label = plain_classes([r[1] for r in rows])
    return sorted(min(r[0] for r, x in zip(rows, label) if x == c) for c in set(label))


def test_links_between_members_that_stand_for_no_bucket(spark, tmp_path):
    """Texts of one template fill buckets; each has a partner, and the template joins them with neither."""
    random.seed(8)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        text = base[:240] + [f"own{i}x{j}" for j in range(60)]
        for k in range(2):
            copy = list(text)
            for _ in range(3):
                copy[random.randrange(300)] = f"c{i}x{k}"
            rows.append((2 * i + k, " ".join(copy), "en", "a"))
    kept = corpus_pipeline.drop_near_copies(spark, stored(spark, tmp_path, rows), None)
    wanted = first_of_class(rows)
    assert 60 < len(wanted) < 240 and sorted(r.doc_id for r in kept.collect()) == wanted


def test_both_sides_of_the_threshold(spark, tmp_path):
    """Pairs just above 0.8 are joined, pairs just below are not."""
    random.seed(9)
    rows = []
    for i in range(150):
        words = [f"w{random.randint(0, 5000)}" for _ in range(300)]
        n = 296 - (28 + i % 14)
        rows += [(2 * i, " ".join(words), "en", "a"), (2 * i + 1, " ".join(words[: n + 4] + [f"new{i}x{j}" for j in range(296 - n)]), "en", "a")]
    got = {r.doc_id: r.component_id for r in similar_groups(stored(spark, tmp_path, rows)).collect()}
    sets = [shingles(r[1]) for r in rows]
    close = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert 30 < sum(close) < 120
    assert [got[2 * i] == got[2 * i + 1] for i in range(150)] == close


def test_awkward_rows(spark, tmp_path):
    got = similar_groups(stored(spark, tmp_path, AWKWARD)).collect()
    label = plain_classes([r[1] for r in AWKWARD])
    ids = {c: min((AWKWARD[i][0] for i in range(len(label)) if label[i] == c and AWKWARD[i][0] is not None), default=None) for c in label}
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == sorted(str((d, ids[c])) for (d, *_), c in zip(AWKWARD, label))


def test_recall_on_a_larger_table(spark):
    """Every 50th document of 10,000 against all of them: no pair at 0.8 may be in two classes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r.component for r in similar_groups(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    asked = {i: shingles(t) for i, t in texts.items() if i % 50 == 0}
    having = defaultdict(list)
    for i, found in asked.items():
        for s in found:
            having[s].append(i)
    pairs = 0
    for j, text in texts.items():
        mine = shingles(text)
        for i, n in Counter(i for s in mine for i in having.get(s, ())).items():
            if i != j and mine != asked[i] and n >= 0.8 * (len(mine) + len(asked[i]) - n):
                pairs += 1
                assert got[i] == got[j], (i, j)
    assert pairs >= 20


def test_empty_table(spark, tmp_path):
    assert similar_groups(stored(spark, tmp_path, [])).collect() == []
