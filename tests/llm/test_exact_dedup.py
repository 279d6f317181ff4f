import hashlib
import random
import re

from helpers import AWKWARD, stored

from usagelens.llm.exact_dedup import exact_duplicates


def check(rows, got):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(norm(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert len(by) == len(groups)
    for text, members in groups.items():
        mine = by[hashlib.sha256(text.encode()).hexdigest()]
        best = min(members)[3]
        assert len(mine) == len(members)
        assert {(r.group_size, r.keep_id) for r in mine} == {(len(members), best)}
        assert sum(r.kept for r in mine) == 1
        assert next(r for r in mine if r.kept).doc_id == best


def test_awkward_rows(spark, tmp_path):
    check(AWKWARD, exact_duplicates(stored(spark, tmp_path, AWKWARD), block_chars=64).collect())


def test_random_texts_of_few_letters_and_small_blocks(spark, tmp_path):
    random.seed(1)
    rows = [(i, "".join(random.choice("ab ") for _ in range(random.choice([0, 1, 2, 3, 4, 5, 8, 9, 16, 17]))), "en", "a") for i in range(400)]
    check(rows, exact_duplicates(stored(spark, tmp_path, rows), block_chars=2).collect())


def test_empty_table(spark, tmp_path):
    assert exact_duplicates(stored(spark, tmp_path, [])).collect() == []
