import numpy as np
from helpers import AWKWARD, stored

from usagelens.llm.classifier import SAMPLE, TERMS, Voter, labelled_sample, quality_scores, term_counts
from usagelens.llm.common import documents, id_remainder


def test_held_out_ranking(spark):
    folder = "/root/testdata/sf0.01"
    held_out = id_remainder("doc_id", 5) == 0
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality_scores(documents(spark, folder), labels, ~held_out, held_out.alias("held_out")).filter("held_out")
    rows = scored.join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97


def test_votes_equal_a_plain_search():
    texts = [f"Word {'!' * (i % 4)} {'#' * (i % 3)} {i} and {'|' * (i % 5)} some" for i in range(60)]
    counted = [term_counts([t]) for t in texts]
    labels = np.array([i % 2 for i in range(60)], float)
    voter = Voter([t for t, _ in counted], [c[0] for _, c in counted], labels, 8, 5)
    got = voter.scores(texts[:10] + ["", None])
    assert got[-1] == got[-2] == 0.5
    for text, score in zip(texts[:10], got):
        present, counts = term_counts([text])
        column = voter._column[present]
        known = column >= 0
        vector = voter._unit(voter._weighted(counts[:, known], voter._weight[column[known]]) @ voter._project[column[known]])[0]
        cosines = voter.vectors @ vector
        best = np.sort(cosines)[::-1][4]
        votes = np.where(cosines >= best, np.clip(cosines, 0, 1), 0).astype(float) ** 4
        assert abs(score - (votes * labels).sum() / votes.sum()) < 0.25 and 0 <= score <= 1


def test_counts_cover_the_whole_text():
    text = "Ab  cd 12, " * 40_000 + "#?~"
    present, counts = term_counts([text, "", None])
    assert present.max() < TERMS and counts[0].sum() > 100_000 and not counts[1:].any()


def test_sample_leaves_out_held_out_rows_and_odd_labels(spark):
    rows = [(i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (200, None, 0), (201, 7, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = labelled_sample(labels, id_remainder("doc_id", 5) != 0, SAMPLE).collect()
    assert 60 < len(got) < 100 and all(r.label == r.doc_id % 2 for r in got)
    assert len(labelled_sample(labels, id_remainder("doc_id", 5) != 0, 7).collect()) == 7


def test_awkward_rows_without_labels_and_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = stored(spark, tmp_path, AWKWARD)
    everything = id_remainder("doc_id", 5) >= 0
    got = quality_scores(docs, none, everything).collect()
    assert len(got) == len(AWKWARD) and all(r.score == 0.5 and r.predicted == 1 for r in got)
    some = spark.createDataFrame([(4, 1), (7, 0), (7, 1), (8, 0)], "doc_id long, quality int")
    got = quality_scores(docs, some, everything).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert quality_scores(stored(spark, tmp_path, []), some, everything).collect() == []
