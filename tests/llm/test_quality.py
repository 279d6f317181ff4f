from collections import Counter

from helpers import AWKWARD, prose, stored

from usagelens.llm.quality import base_counts, quality_rules


def counts(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_a_plain_count(spark, tmp_path):
    rows = AWKWARD + [
        (20, "a b c d e f g h " * 5, "en", "a"),
        (21, "x x x x x x x x x x y " + prose(30), "en", "a"),
        (22, "l1 # * $\nl1 # * $\n\n \n<b>\nl2|l2", "en", "a"),
        (23, prose(12) + " " + prose(12) + " q " + prose(9), "de", "a"),
    ]
    got = base_counts(stored(spark, tmp_path, rows), "lang").collect()
    mine = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert mine == sorted((str(d), *counts(t)) for d, t, *_ in rows)


def test_outliers_of_their_group_fail_and_clean_ones_stay(spark, tmp_path):
    rows = [(i, prose(40 + i % 30, i), "en", "a") for i in range(300)]
    # Code-like text is normal in this source.
    rows += [(1000 + i, " ".join(f"{w} $ | #" for w in prose(40 + i % 30, i).split()), "en", "code") for i in range(300)]
    rows += [(5000, " ".join(f"{w} $ | #" for w in prose(60, 3).split()), "en", "a"), (5001, prose(60, 3).upper(), "en", "a")]
    rows += [(5002, prose(60, 4), None, "small"), (5003, prose(5), "en", "a"), (5004, prose(10) + " " + prose(10) + " " + prose(10), "en", "a")]
    got = {r.doc_id: r for r in quality_rules(stored(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    assert not got[5000].kept and got[5000].failed[:2] == ["symbols", "marks"]
    assert not got[5001].kept and "upper" in got[5001].failed
    assert got[5002].kept and not got[5003].kept and got[5003].base_failed
    assert got[5004].base_failed
    assert all(got[i].kept for i in range(300)) and all(got[1000 + i].kept for i in range(300))


def test_awkward_rows_and_empty_table(spark, tmp_path):
    got = quality_rules(stored(spark, tmp_path, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 20)
    assert quality_rules(stored(spark, tmp_path, [])).collect() == []
