import numpy as np
from helpers import AWKWARD, LONG, stored
from pyspark.sql import functions as F

from usagelens.llm import langid
from usagelens.llm.common import documents, id_remainder
from usagelens.llm.langid import Trigrams, language_id


def test_held_out_accuracy(spark, sf):
    docs = documents(spark, "/root/testdata/sf0.01")
    held_out = id_remainder("doc_id", 3) == 1
    got = language_id(docs, ~held_out, "lang", held_out.alias("held_out")).filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_profile_is_the_bundle_of_bound_permuted_letters():
    grams = Trigrams(["Ab a", "", "1 2"], 64, known := {})
    a, b, blank = known[ord("a")], known[ord("b")], known[0]
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    want = bind(a, b, blank).astype(int) + bind(blank, a, blank)
    assert ((grams.counts @ grams.vectors)[0] == want).all()
    assert grams.letters.tolist() == [3, 0, 0] and not grams.counts[1:].any()


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(langid, "_CHARS", 100)
    parts, owner = langid._cut([LONG, None, "ab"])
    assert "".join(p for p, o in zip(parts, owner) if o == 0) == LONG and list(owner[-2:]) == [1, 2]
    assert max(map(len, parts)) <= 200
    monkeypatch.undo()
    known = {}
    one, many = Trigrams([LONG], 32, known), Trigrams(parts[:-2], 32, known)
    assert ((one.counts @ one.vectors)[0] == (many.counts @ many.vectors).sum(axis=0)).all()


def test_awkward_rows(spark, tmp_path):
    got = language_id(stored(spark, tmp_path, AWKWARD), F.lit(True), "lang").collect()
    assert len(got) == len(AWKWARD)
    without = [r for r in got if r.lang_pred == "und"]
    assert sorted(str(r.doc_id) for r in without) == ["1", "2", "3", "None"] and all(r.score == 0 for r in without)


def test_no_training_rows_and_empty_table(spark, tmp_path):
    got = language_id(stored(spark, tmp_path, [(1, "some text", None, "a")]), F.lit(True)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert language_id(stored(spark, tmp_path, []), F.lit(True)).collect() == []
